"""Text rules, query analysis and identities."""

import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from warraq.functions import identity, text
from warraq.operators import lexical


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("# أَحْمَدُ إلى هٰذَا النَّصِ", "احمد الي هذا النص"), ("### | title\n~~ more PageV01P002 x Milestone12 y", "title more x y"), ("### |EDITOR| a", "a"), ("ﬁne ـtext", "fine text"), ("  \x1c a \n b ", "a b")],
)
def test_normalize(spark, raw, expected):
    assert one(spark, text.normalize(F.col("x")), x=raw) == expected


def test_legacy_normalize_drops_milestones_and_lone_pipes(spark):
    assert one(spark, text.normalize_legacy(F.col("x")), x="# | a ms0067 | b a|b") == "a b a|b"


def test_query_terms(spark):
    expected = {"النَّهْر في النهر والجِسر": ["النهر", "الجسر"], "والجسر بالنهر للوادي": ["الجسر", "النهر", "الوادي"], "Word word WORD other": ["Word", "other"], "من في": ["من", "في"]}
    asked = spark.createDataFrame([(x,) for x in expected], "query string").withColumn("query_id", F.monotonically_increasing_id())
    assert {r.query: r.terms for r in lexical.analyze(asked).collect()} == expected


@pytest.mark.parametrize(("query", "limit", "uri"), [("", 10, None), ("x" * 501, 10, None), (" \t", 10, None), ("x", 0, None), ("x", 51, None), ("x", 10, "u" * 256)])
def test_requests_have_bounds(query, limit, uri):
    with pytest.raises(ValueError, match="must be between|blank"):
        lexical.check_request(query, limit, uri)
    assert lexical.check_request(" x ", 50, "u" * 255) == "x"


def test_half_even(spark):
    values = [0.0, 2.675, 0.0005, 0.0625, 0.1875, 0.3125, 0.4375, 1.0005, 2.5e-7, 151.0, 100 / 3, 123456.7895, -0.3125, -2.675, 1e15 + 0.5] + [k / 16 for k in range(200)] + [k / 37 for k in range(200)]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    assert [r[0] for r in df.select(text.half_even(F.col("x"))).collect()] == [round(x, 3) for x in values]


def test_tree_fingerprint(spark):
    names = "chunk_id string, quality_status string, sequence_no int, text_hash string, version_uri string, work_uri string"
    rows = [(f"c{i}", "ACCEPTED", i, f"h{i}", f"v{i % 3}", f"w{i % 2}") for i in range(50)]
    digest = lambda lines: hashlib.sha256("".join(lines).encode()).hexdigest()
    fours = lambda lines: [digest(lines[k : k + 4]) for k in range(0, len(lines), 4)]
    told = []
    for w, v in sorted({(r[5], r[4]) for r in rows}):
        own = sorted((r for r in rows if r[4:] == (v, w)), key=lambda r: (r[2], r[0]))
        runs = [digest(f'{{"chunk_id":"{c}","quality_status":"{q}","sequence_no":{n},"text_hash":"{h}","version_uri":"{v}","work_uri":"{w}"}}\n' for c, q, n, h, _, _ in own if n // 4 == k) for k in sorted({r[2] // 4 for r in own})]
        told.append(f'{{"digest":"{digest(runs)}","n_chunks":{len(own)},"version_uri":"{v}","work_uri":"{w}"}}')
    told = fours(told)
    while len(told) > 1:
        told = fours(told)
    found = identity.tree_fingerprint(spark.createDataFrame(rows[::-1], names), 4)
    assert (found.fingerprint, found.n_chunks) == (told[0], 50)
    assert identity.tree_fingerprint(spark.createDataFrame([], names)).n_chunks == 0
    with pytest.raises(ValueError, match="tree_fingerprint"):
        identity.EXACT_ROWS, before = 10, identity.EXACT_ROWS
        try:
            identity.chunk_fingerprint(spark.createDataFrame(rows, names))
        finally:
            identity.EXACT_ROWS = before


def test_query_without_terms_is_an_error(spark):
    with pytest.raises(Exception, match="searchable terms"):
        lexical.analyze(spark.createDataFrame([("... !",)], "query string")).collect()


@pytest.mark.parametrize(("x", "y", "n"), [("aaaa", "aa", 2), ("abab", "ab", 2), ("abc", "", 0), ("", "a", 0)])
def test_occurrences(spark, x, y, n):
    assert one(spark, text.occurrences(F.col("x"), F.col("y")), x=x, y=y) == n


def test_point_uuid_is_version_five(spark):
    name = hashlib.sha256(b"x").hexdigest()
    assert one(spark, identity.point_uuid(F.col("x")), x=name) == str(uuid.uuid5(uuid.UUID(identity.POINT_NAMESPACE), name))


def test_fingerprint_changes_with_a_hash(spark):
    row = ("c", "ACCEPTED", 0, "h", "v", "w")
    names = "chunk_id string, quality_status string, sequence_no int, text_hash string, version_uri string, work_uri string"
    a = identity.chunk_fingerprint(spark.createDataFrame([row], names)).first()
    b = identity.chunk_fingerprint(spark.createDataFrame([(*row[:3], "g", *row[4:])], names)).first()
    told = '{"chunk_id":"c","quality_status":"ACCEPTED","sequence_no":0,"text_hash":"h","version_uri":"v","work_uri":"w"}\n'
    assert a.fingerprint == hashlib.sha256(told.encode()).hexdigest() != b.fingerprint
    assert identity.chunk_fingerprint(spark.createDataFrame([], names)).first().fingerprint == hashlib.sha256(b"").hexdigest()
