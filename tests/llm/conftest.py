import pytest

#: (doc_id, text): nulls, empty and blank texts, repeated rows, copies, near copies, ties and long texts.
WORDS = [f"w{i % 37}x{i % 11}" for i in range(120)]


def edge_rows():
    base = " ".join(WORDS)
    near = " ".join(WORDS[:60] + ["changed"] + WORDS[61:])
    far = " ".join(WORDS[:60] + [f"z{i}" for i in range(60)])
    return [
        (1, base), (2, base), (3, near), (4, far), (5, None), (6, ""), (7, " \n\t "), (8, "one"), (9, "one two three"), (10, "one two three"), (2, base), (None, far + " tail"), (11, "é" * 300), (12, "a" * 5000),
        (13, "word " * 3000), (14, base.upper()), (15, "x\x00y \x1c \x85 z  <|endoftext|>  \U0001f600"), (16, "line\n" * 50),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark):
    df = spark.createDataFrame([(i, t, "en", None, "h", "clash") for i, t in edge_rows()], "doc_id long, text string, lang string, source string, host string, shard string")
    return df


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
