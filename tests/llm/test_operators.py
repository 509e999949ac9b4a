"""The ten operators on edge cases and against slow versions."""

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import edge_rows
from warraq.llm import bpe, chat_format, decontaminate, hilbert_shards, near_dups, pairwise_quality, quality_rules, repeated_spans, site_text, token_planes

ODD = "ab  \n\t'sret.,!12é中  \x1c\x85"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=brute.key)


# 1 chat formatting


def test_chat_round_trip(spark):
    said = [(1, 1, "assistant", "a <b> # </turn> \\l \\"), (1, 0, "user", None), (1, 1, "assistant", "a <b> # </turn> \\l \\"), (2, None, None, "### user: x"), (None, 0, "assistant: x", "q"), (3, 0, "system", "")]
    df = spark.createDataFrame([(*r, "extra") for r in said], "conv_id long, turn long, role string, text string, formatted string")
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.render(chat_format.to_turns(df))).collect()}
    assert [tuple(t) for t in back[1].turns] == [("user", ""), ("assistant", said[0][3]), ("assistant", said[0][3])]
    assert back[1].loss_text == said[0][3] * 2
    assert tuple(back[2].turns[0]) == ("", "### user: x") and back[2].loss_text == ""
    assert tuple(back[None].turns[0]) == ("assistant: x", "q")
    assert chat_format.to_turns(df.limit(0)).collect() == []


def test_chat_layouts(spark):
    mixed = spark.createDataFrame(
        [("a", "p", "r", None, None, None), ("b", None, None, "do", "this", "done"), ("c", None, None, None, None, None)],
        "id string, prompt string, response string, instruction string, input string, output string",
    )
    found = {r.conv_id: r for r in chat_format.to_turns(mixed).collect()}
    assert (found["a"].layout, found["b"].layout, found["c"].layout) == ("prompt", "instruction", None)
    assert [t.text for t in found["b"].turns] == ["do\n\nthis", "done"]
    messages = spark.createDataFrame([("a", [("user", "x")])], "id string, messages array<struct<role:string,content:string>>")
    assert chat_format.to_turns(messages).first().turns[0].text == "x"
    shared = spark.createDataFrame([("a", [("human", "x"), ("gpt", "y")])], "id string, conversations array<struct<from:string,value:string>>")
    assert [t.role for t in chat_format.to_turns(shared).first().turns] == ["user", "assistant"]
    with pytest.raises(ValueError, match="no layout"):
        chat_format.to_turns(spark.range(1))


# 2 byte-level BPE


def test_tree_equals_whole():
    enc, lengths = bpe.encoding(public_tokenizers.path(bpe.RANKS))
    draw = random.Random(1)
    for _ in range(1500):
        text = "".join(draw.choice(ODD) for _ in range(draw.randint(0, 200)))
        ids = bpe.encode_text(text, enc, lengths, leaf=draw.choice([1, 2, 5, 16]))
        assert ids == enc.encode_ordinary(text) and bpe.decode_ids(ids, enc, leaf=3) == text.encode()


def test_round_trip(edge_docs, no_docs):
    enc, _ = bpe.encoding(public_tokenizers.path(bpe.RANKS))
    for r in bpe.decode(bpe.encode(bpe.round_trip(edge_docs))).collect():
        text = r.text or ""
        packed = np.array(enc.encode_ordinary(text), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert bytes(r.ids) == packed and bytes(r.decoded) == text.encode()
    assert bpe.round_trip(no_docs).count() == 0


# 3 token files


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def library_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_words_equal_whole(monkeypatch):
    monkeypatch.setattr(token_planes, "CACHE_BYTES", 5000)
    tokenizer, encoder, draw = library(), token_planes.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(2)
    parts = [*ODD, "  ", "\0", " \0", "\u180e", "<|endoftext|>", "<|endof", "word", "don't", "x" * 90]
    for _ in range(600):
        texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 40))) for _ in range(5)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [library_ids(tokenizer, x) for x in texts]
    assert max(map(len, encoder.known.ids)) <= token_planes.LONGEST and encoder.known.size < 50_000
    assert library_ids(tokenizer, "a <|endoftext|> b") == np.frombuffer(encoder.encode(["a <|endoftext|> b"])[0], "<u4").tolist() == [64, 220, 50256, 275]


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("n", [1, 7, 1000])
def test_planes(planes, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)
    assert (token_planes.unpack(token_planes.pack(ids, planes), n) == ids).all()


def test_token_files(spark, edge_docs, no_docs, tmp_path):
    token_planes.write(edge_docs, str(tmp_path / "a"), planes="bit", block=64)
    found = token_planes.documents(spark, str(tmp_path / "a")).orderBy("part", "ordinal").collect()
    tokenizer = library()
    start, seen = 0, []
    for r in found:
        assert r.start == start
        start += r.n_tokens
        seen.append((r.doc_id, r.n_tokens, r.ids_crc32))
    expected = []
    for i, t in edge_rows():
        ids = [*library_ids(tokenizer, t), 0]
        expected.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(seen, key=str) == sorted(expected, key=str)
    assert [x[0] for x in seen] == sorted((x[0] for x in seen), key=lambda i: (i is not None, i))
    assert spark.read.parquet(str(tmp_path / "a/index")).count() >= len(found)
    token_planes.write(no_docs, str(tmp_path / "b"))
    assert token_planes.documents(spark, str(tmp_path / "b")).count() == 0


def test_token_query_against_the_library(spark):
    folder, tokenizer, start = "/root/testdata/sf0.001", library(), 0
    found = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_planes.op3(spark, folder).collect()}
    for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect():
        ids = [*library_ids(tokenizer, r.text), 0]
        assert found.pop(r.doc_id) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not found


def test_starts_of_parts(spark):
    totals = spark.range(11).selectExpr("cast(id AS int) AS part", "id * id AS n")
    for fan in (2, 3, 1024):
        assert [r.before for r in token_planes.starts(totals, fan).orderBy("part").collect()] == [sum(k * k for k in range(i)) for i in range(11)]


# 4 sharding


def test_hilbert_steps_by_one(spark):
    grid = spark.range(4096).select((F.col("id") % 16).alias("a"), (F.floor(F.col("id") / 16) % 16).alias("b"), F.floor(F.col("id") / 256).alias("c"))
    order = grid.select("*", hilbert_shards.hilbert_index([F.col("a"), F.col("b"), F.col("c")]).alias("h")).orderBy("h").collect()
    assert [r.h for r in order] == list(range(4096))
    assert all(abs(x.a - y.a) + abs(x.b - y.b) + abs(x.c - y.c) == 1 for x, y in zip(order, order[1:], strict=False))


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_shards(edge_docs, no_docs, shards):
    placed = hilbert_shards.place(edge_docs, shards).collect()
    held = {s: sorted(r.slot for r in placed if r.shard == s) for s in range(shards)}
    assert all(v == list(range(len(v))) for v in held.values()) and max(map(len, held.values())) - min(map(len, held.values())) <= 1
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in placed), key=str) == sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in edge_rows()), key=str)
    cells = [(r.shard, r.cell) for r in placed]
    assert all(b >= a for (s, a), (t, b) in zip(sorted(cells), sorted(cells)[1:], strict=False) if t >= s)
    assert hilbert_shards.place(no_docs).count() == 0


@pytest.mark.parametrize("bound", [0, 100])
def test_equal_texts_stand_together(spark, tmp_path, monkeypatch, bound):
    monkeypatch.setattr(hilbert_shards, "BROADCAST_ROWS", bound)
    draw = random.Random(8)
    made = [(i, f"text {draw.randint(0, 12)}" if i % 3 else "hot", draw.choice(["en", "fr", None]), f"s{draw.randint(0, 3)}", "clash", i) for i in range(200)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, shard string, place int")
    placed = sorted(hilbert_shards.place(docs, 7).collect(), key=lambda r: (r.shard, r.slot))
    seen = [r.text_crc32 for r in placed]
    assert len({r.text_crc32 for r in placed}) == len({(r.cell, r.text_crc32) for r in placed}) < len({(r.lang, r.source, r.text_crc32) for r in placed})
    assert len({x for x, y in zip(seen, [None, *seen]) if x != y}) == sum(x != y for x, y in zip(seen, [None, *seen]))  # noqa: B905
    hilbert_shards.write_shards(docs, str(tmp_path / "out"), 7)
    written = spark.read.parquet(str(tmp_path / "out/rows"))
    assert sorted((r.doc_id, r.text, r.place, r.shard, r.slot, r.cell) for r in written.collect()) == sorted((r.doc_id, made[r.doc_id][1], r.doc_id, r.shard, r.slot, r.cell) for r in placed)
    for m in spark.read.parquet(str(tmp_path / "out/manifest")).collect():
        rows = [r for r in placed if r.shard == m.shard]
        ends = lambda c: ([*sorted(x for r in rows if (x := r[c]) is not None), None][0], ([None, *sorted(x for r in rows if (x := r[c]) is not None)])[-1])  # noqa: B023, E731
        assert [(m[f"min_{c}"], m[f"max_{c}"]) for c in ("cell", "size", "lang", "source")] == [ends(c) for c in ("cell", "size", "lang", "source")]
        assert (m.n_rows, m.n_bytes) == (len(rows), sum(r["size"] for r in rows))


def test_each_group_of_a_table_is_one_run(spark):
    placed = hilbert_shards.place(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).orderBy("shard", "slot").collect()
    seen = [(r["size"], r.text_crc32) for r in placed]
    assert sum(x != y for x, y in zip(seen, [None, *seen])) == len(set(seen)) < len(placed)  # noqa: B905


@pytest.mark.parametrize("n", [3, 4, 40])
def test_steps_follow_the_order_of_values(spark, n):
    df = spark.range(1000).select(F.format_string("v%03d", F.col("id") * F.col("id") % n).alias("c"))
    least = hilbert_shards.steps(df, "c", 2)
    values = sorted({r.c for r in df.collect()})
    assert least == sorted(least) and set(least) <= set(values) and len(least) == (len(values) - 1 if len(values) <= 4 else len(least)) <= 3


# 5 quality rules


def test_quality_edges(edge_docs, no_docs):
    found = quality_rules.annotate(edge_docs).collect()
    for r in found:
        words = brute.WORD.findall(r.text or "")
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        held = {i + k for i, w in enumerate(windows) for k in range(3) if windows.count(w) > 1} if len(words) < 400 else None
        assert r.n_words == len(words) and (held is None or r.n_repeat_words == len(held))
        assert not (r.base_failed and r.kept)
    by_id = {r.doc_id: r for r in found}
    assert by_id[5].base_failed and by_id[16].n_dup_lines == 49 and by_id[13].base_failed
    assert sorted(str(r.doc_id) for r in quality_rules.keep(edge_docs).collect()) == sorted(str(r.doc_id) for r in found if r.kept)
    assert quality_rules.keep(edge_docs).columns == edge_docs.columns and quality_rules.keep(no_docs).count() == 0


def test_languages_without_stop_words_here_are_not_held_to_them(spark):
    text = " ".join(f"slovo{i} " for i in range(60))
    docs = spark.createDataFrame([(1, text, "en"), (2, text, "cs"), (3, text, None), (4, "the " + text + " of and to a in", "en"), (5, "slovo", "cs"), (6, "slovo " * 60, "cs")], "doc_id long, text string, lang string")
    judged = {r.doc_id: r.kept for r in quality_rules.annotate(docs).collect()}
    assert judged == {1: False, 2: True, 3: False, 4: True, 5: False, 6: False}
    assert sorted(r.doc_id for r in quality_rules.keep(docs).collect()) == [2, 4]
    assert not quality_rules.annotate(docs.drop("lang")).filter("doc_id = 2").first().kept


# 6 decontamination


def test_decontamination(spark, edge_docs, no_docs):
    item = " ".join(f"Q{i}" for i in range(40))
    changed = item.replace("Q20", "other")
    docs = spark.createDataFrame([(1, f"a b {item} c"), (2, f"x {changed} y"), (3, " ".join(item.split()[:20])), (4, "tiny item"), (5, None), (1, f"a b {item} c"), (6, item)], "doc_id long, text string")
    items = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "tiny item"), (14, item)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.start, round(r.similarity, 3)) for r in decontaminate.contaminated(docs, items).collect()}
    assert found == {(1, 10): (2, 1.0), (1, 14): (2, 1.0), (2, 10): (1, round(31 / 41, 3)), (2, 14): (1, round(31 / 41, 3)), (4, 13): (0, 1.0), (6, 10): (0, 1.0), (6, 14): (0, 1.0)}
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [3, 5]
    assert decontaminate.contaminated(no_docs, items).count() == 0 and decontaminate.contaminated(edge_docs, items.limit(0)).count() == 0


def test_decontamination_of_reordered_items(spark):
    q, other = [f"Q{i}" for i in range(40)], [f"o{i}" for i in range(100)]
    swapped = " ".join(other[:50] + q[20:] + q[:20] + other[50:])
    assert [tuple(r) for r in decontaminate.contaminated(spark.createDataFrame([(1, swapped)], "doc_id long, text string"), spark.createDataFrame([(7, " ".join(q))], "item_id long, text string")).collect()] == [(1, 7, 50, 0.8)]


def test_decontamination_compares_all_windows(spark):
    draw, letters = random.Random(6), [f"v{i}" for i in range(400)]
    items = [(k, [draw.choice(letters) for _ in range(draw.choice([1, 3, 5, 9, 30, 60]))]) for k in range(25)]
    docs = []
    for i in range(60):
        words = []
        for _ in range(draw.randint(0, 3)):
            w = list(draw.choice(items)[1])
            cut = draw.randint(0, len(w))
            w = w[cut:] + w[:cut] if draw.random() < 0.5 else w
            for _ in range(draw.randint(0, 2)):
                w[draw.randrange(len(w))] = "edit"
            words += [*w[draw.randint(0, 1) :], *(draw.choice(letters) for _ in range(draw.randint(0, 9)))]
        docs.append((i, words))
    told = lambda rows: spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    found = {(r.doc_id, r.item_id): (r.start, r.similarity) for r in decontaminate.contaminated(told(docs), told(items).withColumnRenamed("doc_id", "item_id")).collect()}
    expected = {(i, k): windows for i, w in docs for k, item in items if (windows := brute.alike(w, item))}
    assert len(expected) > 20 and found.keys() == expected.keys()
    for pair, (start, similarity) in found.items():
        assert similarity == pytest.approx(max(expected[pair].values())) == pytest.approx(expected[pair][start])


def test_decontamination_of_rows_without_an_id_and_of_edits_at_ends(spark):
    q = [f"Q{i}" for i in range(73)]
    edited = ["x1", "x2", *q[2:20], *(f"n{i}" for i in range(5)), *q[20:71], "y1", "y2"]
    item = spark.createDataFrame([(7, " ".join(q), "clash")], "item_id long, text string, w string")
    made = [(1, "a b " + " ".join(edited) + " c"), (None, " ".join(q)), (None, "nothing " * 80), (2, " ".join(q)), (2, "other words"), (3, None), (3, "")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in made], "doc_id long, text string, row string, length int")
    best = brute.alike(made[0][1].split(), q)
    assert 0.75 < max(best.values()) < 0.8
    found = {r.doc_id: (r.item_id, r.start, r.similarity) for r in decontaminate.contaminated(docs, item).collect()}
    assert found == {1: (7, min(k for k in best if best[k] == max(best.values())), pytest.approx(max(best.values()))), None: (7, 0, 1.0), 2: (7, 0, 1.0)}
    left = decontaminate.clean(docs, item)
    assert left.columns == docs.columns and sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([made[2], made[4], made[5], made[6]], key=str)
    assert decontaminate.clean(docs, item.limit(0)).count() == len(made) and decontaminate.clean(docs.limit(0), item).count() == 0


def test_decontamination_of_long_items(spark):
    """Items of 20,000 words, with repeats and without, in seconds."""
    draw = random.Random(4)
    item = [f"u{draw.randint(0, 30_000)}" for _ in range(20_000)]
    again = ["one", "two", "three"] * 6_000
    edited = [f"e{i}" if i % 250 == 0 else w for i, w in enumerate(item)]
    docs = spark.createDataFrame([(1, " ".join(["a", "b", *item])), (2, " ".join(edited)), (3, " ".join(again[:-600])), (4, " ".join(again[:9_000]))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(again))], "item_id long, text string")
    shingles = lambda w: list(zip(*(w[k:] for k in range(5)), strict=False))
    began = time.perf_counter()
    found = {(r.doc_id, r.item_id): (r.start, r.similarity) for r in decontaminate.contaminated(docs, items).collect()}
    assert time.perf_counter() - began < 60
    assert found == {(1, 7): (2, 1.0), (2, 7): (0, pytest.approx(brute.weighted(shingles(edited), shingles(item)))), (3, 8): (0, pytest.approx(17_396 / 17_996))}


def test_features_number_the_occurrences_of_a_shingle(spark):
    lists = [([5, 7, 5, 5, 9, 7], [7, 5, 5, 1]), ([], [1]), ([3], [3, 3, 3]), ([2, 2], [2, 2]), ([], [])]
    df = spark.createDataFrame([(a, b) for a, b in lists], "a array<long>, b array<long>")
    out = df.select(F.expr(decontaminate._shared("a", "b")).alias("shared"), F.expr(decontaminate._features("a")).alias("f"), "a").collect()
    assert [r.shared for r in out] == [sum((Counter(a) & Counter(b)).values()) for a, b in lists]
    assert all(len(set(r.f)) == len(r.a) and set(r.a) <= set(r.f) for r in out)


def test_runs_of_several_sizes_in_one_pass(spark):
    words = [[], ["a"], ["a", "b", "c"], [f"w{i % 5}" for i in range(12)]]
    df = spark.createDataFrame([(w,) for w in words], "w array<string>")
    for sizes in ([5], [1, 3, 5], [2, 4]):
        once = df.select(F.size("w").alias("n"), F.posexplode(F.expr(decontaminate._all_runs(sizes))).alias("q", "h")).select("n", "h", F.expr(decontaminate._size_at(sizes)).alias("x")).select("n", "h", "x.size", "x.p")
        each = [df.select(F.size("w").alias("n"), F.posexplode(F.expr(decontaminate._runs("w", str(k)))).alias("p", "h")).select("n", "h", F.lit(k).alias("size"), "p") for k in sizes]
        assert rows(once) == sorted((r for e in each for r in rows(e)), key=brute.key)


def test_broadcasts_are_bounded_in_rows_and_in_values(spark, monkeypatch):
    df = spark.range(10).select("id", F.expr("sequence(1, 100)").alias("x"))
    told = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert told(decontaminate._near(df, "size(x)")) and told(decontaminate._near(df.limit(0), "size(x)"))
    monkeypatch.setattr(decontaminate, "BROADCAST_LONGS", 999)
    assert not told(decontaminate._near(df, "size(x)")) and told(decontaminate._near(df.select("id")))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 9)
    assert not told(decontaminate._near(df.select("id")))
    item = " ".join(f"Q{i}" for i in range(40))
    docs, items = spark.createDataFrame([(1, f"a {item}"), (2, "b")], "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert [tuple(r) for r in decontaminate.contaminated(docs, items).collect()] == [(1, 7, 1, 1.0)] and [r.doc_id for r in decontaminate.clean(docs, items).collect()] == [2]


def test_recall_of_fingerprints_near_the_threshold(spark):
    """Pairs of lists with similarity 0.75 to 0.8, and unrelated ones."""
    draw, made = random.Random(9), []
    while len(made) < 1500:
        n = draw.randint(7, 60)
        a = [draw.randint(0, 10**9) for _ in range(n)]
        if draw.random() < 0.3:
            a[: n // 3] = [1] * (n // 3)
        b = list(a)
        for _ in range(draw.randint(1, n // 4 + 1)):
            b[draw.randrange(n)] = draw.randint(0, 10**9)
        if 0.75 <= brute.weighted(a, b) <= 0.8:
            made.append((len(made), a, b))
    pairs = spark.createDataFrame(made, "i long, a array<long>, b array<long>")
    windows = pairs.select(F.lit(1).alias("length"), F.col("i").alias("key"), F.transform("a", lambda x: F.xxhash64(x)).alias("win"))
    items = pairs.select(F.col("i").alias("item_id"), F.lit(1).alias("length"), F.transform("b", lambda x: F.xxhash64(x)).alias("item"))
    near = decontaminate._near_pairs(windows, items)
    both = near.filter("key = item_id").count()
    assert both >= 0.99 * len(made) and near.count() - both < 0.001 * len(made) ** 2


def test_fingerprints_of_long_lists_agree_with_those_of_short_ones(spark):
    df = spark.range(1).select(F.expr("transform(sequence(1, 400), x -> xxhash64(x % 390))").alias("x"))
    out = df.select(F.expr(decontaminate.fingerprint("x").replace("65536", "1")).alias("slow"), F.expr(decontaminate.fingerprint("x")).alias("fast")).first()
    assert out.slow == out.fast


# 7 quality scores


def test_scores(spark, edge_docs, no_docs):
    draw = random.Random(3)
    good = [(i, " ".join(draw.choice(["the", "of", f"word{draw.randint(0, 400)}"]) for _ in range(80)), 1) for i in range(200)]
    bad = [(1000 + i, " ".join(draw.choice(["buy###", "click!!", "now%%%"]) for _ in range(80)), 0) for i in range(100)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = pairwise_quality.train(docs, labels)
    held = {i: q for i, _, q in good + bad if zlib.crc32(str(i).encode()) % 5 == 0}
    scores = {r.doc_id: r.score for r in pairwise_quality.score(docs, model).collect()}
    assert all((scores[i] >= pairwise_quality.CUT) == (q == 1) for i, q in held.items())
    edge = pairwise_quality.score(edge_docs, model).collect()
    assert len(edge) == len(edge_rows()) and all(0 <= r.score <= 1 for r in edge)
    assert pairwise_quality.score(no_docs, model).count() == 0
    flat = pairwise_quality.train(docs, labels.limit(0))
    assert {round(r.score, 9) for r in pairwise_quality.score(docs, flat).collect()} == {pairwise_quality.CUT}


def test_features_and_fit_against_slow_versions(edge_docs):
    import pyarrow as pa

    texts = [t for _, t in edge_rows()] + ["Buy NOW!!! ### 123", "the cat sat. the cat sat.\nthe end"]
    got = pairwise_quality.features(pa.array(texts, pa.string()))
    assert got == pytest.approx(np.array([brute.quality_features(t or "", pairwise_quality.STOP_WORDS) for t in texts]))
    draw = np.random.default_rng(1)
    x, y = draw.normal(size=(60, 4)), draw.integers(0, 2, 60)
    x[:, 0] += y
    x[5] = x[6]
    model = pairwise_quality.fit(x, y, float(y.mean()), pairs=200, steps=30)
    weights, cut = brute.pairwise_fit(x.tolist(), y.tolist(), float(y.mean()), 200, 30)
    assert model.weights == pytest.approx(weights, abs=1e-9) and model.cut == pytest.approx(cut, abs=1e-9)
    scores = model.score(x)
    assert scores[5] == scores[6] and model.score(np.array([x[0]])) == pytest.approx([1 / (1 + np.exp(-(model.raw(x[:1])[0] - cut) - np.log(0.3 / 0.7)))])


def test_repeated_ids_are_learned_from_once(spark):
    rows = [(i, "the good text of words" if i % 2 else "bad ### !!", i) for i in range(40)]
    docs = spark.createDataFrame(rows + [(3, f"copy {k}", 0) for k in range(30)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(i, i % 2, "clash") for i in range(40)], "doc_id long, quality int, text string")
    model = pairwise_quality.train(docs, labels)
    assert pairwise_quality.score(docs, model).count() == 70
    found = {r.doc_id: r.score for r in pairwise_quality.score(docs.filter("doc_id <> 3"), model).collect()}
    assert all((found[i] >= pairwise_quality.CUT) == (i % 2 == 1) for i in found)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rated = pairwise_quality.op7(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rated) >= 0.93 * len(rated)


# 8 repeated spans


def test_spans_against_slow_version(spark, edge_docs, no_docs):
    assert rows(repeated_spans.repeated_spans(edge_docs)) == sorted(brute.removed(edge_rows()), key=brute.key)
    draw, letters = random.Random(4), "abcdé ü"
    base = ["".join(draw.choice(letters) for _ in range(draw.randint(150, 900))) for _ in range(12)]
    made = []
    for i in range(60):
        parts = []
        for _ in range(draw.randint(0, 4)):
            b = draw.choice(base)
            a = draw.randint(0, len(b) - 1)
            parts += [b[a : draw.randint(a, len(b))], "".join(draw.choice(letters) for _ in range(draw.randint(0, 60)))]
        made.append((i, "".join(parts)))
    assert rows(repeated_spans.repeated_spans(spark.createDataFrame(made, "doc_id long, text string"))) == sorted(brute.removed(made), key=brute.key)
    assert repeated_spans.repeated_spans(no_docs).count() == 0


def test_hot_spans_against_slow_version(spark, monkeypatch):
    """Passages in most texts, alone, with different surroundings and as whole copies, with buckets of a few entries."""
    monkeypatch.setattr(repeated_spans, "BUCKET", 40)
    monkeypatch.setattr(repeated_spans, "SAMPLE", 2)
    draw, letters = random.Random(13), "abcdefgh ij"
    some = lambda n: "".join(draw.choice(letters) for _ in range(n))
    short, long, copy = some(230), some(700), some(500)
    made = [(i, [some(90) + short + some(draw.randint(0, 99)), some(50) + long + some(60), copy, some(300), some(20) + long[: draw.randint(190, 210)] + some(20)][i % 5]) for i in range(150)]
    seen = []
    plain = repeated_spans._hot
    monkeypatch.setattr(repeated_spans, "_hot", lambda *a: seen.append(plain(*a)) or seen[-1])
    assert rows(repeated_spans.repeated_spans(spark.createDataFrame(made, "doc_id long, text string"))) == sorted(brute.removed(made), key=brute.key)
    assert len(seen) == 2 and all(x.extra > 3 for x in seen)


def test_spans_dealt_twice_and_many_copies(spark, monkeypatch):
    """More buckets than one shuffle takes, and rows that agree in all, so often that one goes for all."""
    for name, value in (("BUCKET", 40), ("TEXT_BUCKET", 400), ("COARSE", 3), ("HOLD", 60), ("COPIES", 2)):
        monkeypatch.setattr(repeated_spans, name, value)
    draw, letters = random.Random(14), "abcdefgh ij"
    some = lambda n: "".join(draw.choice(letters) for _ in range(n))
    base, copy = [some(draw.randint(150, 600)) for _ in range(5)], some(400)
    made = [(i, some(draw.randint(0, 90)) + draw.choice(base)[draw.randint(0, 60) :] + some(draw.randint(0, 90))) for i in range(40)]
    made += [(90, copy)] * 7 + [(91, some(30) + copy[50:] + some(30)), (92, "short"), (None, some(300)), (None, base[0]), (None, base[0])] + [(93, "short")] * 5 + [(94, None)] * 6
    docs = spark.createDataFrame(made, "doc_id long, text string")
    assert rows(repeated_spans.repeated_spans(docs)) == sorted(brute.removed(made), key=brute.key)
    cut = repeated_spans.cut_repeats(docs).collect()
    marks = brute.removed_marks([(k, t) for k, (_, t) in enumerate(made)])
    assert sorted(((r.doc_id, r.text) for r in cut), key=str) == sorted(((i, None if t is None else brute.left_of(t, marks[k])) for k, (i, t) in enumerate(made)), key=str)


def test_dealing_takes_the_time_of_its_entries():
    """A slice of 5 MB at the number of buckets that 7 TB of text have: no look at buckets without entries."""
    import time

    draw = np.random.default_rng(1)
    n = 450_000
    ids, at = np.repeat(np.arange(1000), n // 1000), np.tile(np.arange(n // 1000) * 11, 1000)
    keys = {"name": [draw.integers(0, 1 << 63, n).astype(np.uint64)], "context": [draw.integers(0, 1 << 63, n).astype(np.uint64)]}
    began = time.perf_counter()
    done = list(repeated_spans._named([ids], [at], keys, 1_000_000, repeated_spans.Hot([], []), repeated_spans.COARSE))
    assert len(done) == repeated_spans.COARSE and time.perf_counter() - began < 3
    assert sum(len(x["name"]) for x in done) == 8 * n and sum(sum(map(len, (x["ids"], x["counts"], x["at"], x["name"], x["context"]))) for x in done) < 30 * n


def test_cover_is_complete():
    assert {(a - b) % repeated_spans.V for a in repeated_spans.COVER for b in repeated_spans.COVER} == set(range(repeated_spans.V))


def test_cut_keeps_columns_and_characters(edge_docs):
    cut = repeated_spans.cut_repeats(edge_docs)
    assert cut.columns == edge_docs.columns and cut.count() == len(edge_rows())
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[1] == "" and texts[8] == "one" and texts[5] is None


# 9 web pages


def test_pages(spark):
    article = "<html><head><title>no</title><style>x</style></head><body><nav><ul><li>menu</ul></nav><div class='ad'>buy</div><article><h1>T &amp; t</h1><p><b>One\n two<br>three</b> <i>x</i>y<p>Next<form>no</form><div id=comments>no</div><ul><li>a<li>b</ul></article><footer>&copy; z"
    plain = "<body><div><p>Site banner text</p></div><div><p>Own text {}</p></div>"
    made = [(1, "http://a.example/1", article, "x"), (1, "http://a.example/1", article, "x"), (2, None, None, "x"), (None, "bad url", "", "x"), (3, "http://a.example/2", "plain &lt;text&gt; <b", "x")]
    made += [(100 + i, "http://B.example/x", plain.format(i), "x") for i in range(8)]
    out = site_text.extract(spark.createDataFrame(made, "page_id long, url string, html string, text string")).collect()
    by_id = {r.page_id: r.text for r in out}
    assert len(out) == len(made) and by_id[1] == "T & t\n\nOne two three xy\n\nNext\n\na\n\nb"
    assert by_id[2] == by_id[None] == "" and by_id[3] == "plain <text>"
    assert [by_id[100 + i] for i in range(8)] == [f"Own text {i}" for i in range(8)]
    assert site_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("bound", [0, 100])
def test_recurrence_decides_in_and_around_articles(spark, monkeypatch, bound):
    monkeypatch.setattr(site_text, "BROADCAST_ROWS", bound)
    page = "<body><div><p>Bar</p></div><div><p>Outside {0}</p></div><article><div><p>Box</p></div><p>Inside {0}</p></article><article><p>Teaser {1}</p></article>"
    made = [(i, "http://a.example/x", page.format(i, i % 2)) for i in range(10)]
    copies = "<main><p>Heading</p><article><div><p>Copied one</p></div><p>Copied two</p></article></main><p>Own {0}</p>"
    made += [(100 + i, "http://b.example/x", copies.format(i)) for i in range(10)]
    by_id = {r.page_id: r.text.split("\n\n") for r in site_text.extract(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    assert all(by_id[i] == [f"Outside {i}", f"Inside {i}", f"Teaser {i % 2}"] for i in range(10))
    assert all(by_id[100 + i] == ["Heading", "Copied one", "Copied two", f"Own {i}"] for i in range(10))


@pytest.mark.parametrize("marks", [True, False])
def test_template_counts_against_a_slow_version(spark, marks):
    """Random well-formed pages of nested elements, some shared by many pages of a host, some that mark themselves or
    have a mark in a longer name, some filled from a stock."""
    draw, made = random.Random(10), []
    boxes = {h: [f"<div><p>{h} box {i}</p><section><p>more {i}</p></section></div>" for i in range(4)] for h in "ab"}

    def part(h, i, depth):
        kind = draw.random()
        if kind < 0.3:
            return draw.choice(boxes[h])
        if kind < 0.45:
            name = draw.choice(("ad", "x-footer", "stock9", "stock3"))
            return f'<div class="{name}">{h} says {draw.randint(0, 12)}</div>'
        if kind < 0.75 or not depth:
            return f"<p>page {i} says {draw.randint(0, 30)}</p>"
        name = draw.choice(["div", "section", "article", "main"])
        return f"<{name}>" + "".join(part(h, i, depth - 1) for _ in range(draw.randint(1, 3))) + f"</{name}>"

    for i in range(90):
        h = draw.choice("aab")
        made.append((i, f"http://{h}.example/{i}", "<html><body>" + "".join(part(h, i, 3) for _ in range(draw.randint(1, 4))) + "</body></html>", "clash", 1))
    made.append((99, None, "<body><p>alone</p></body>", "clash", 1))
    made += [(1000 * k + i, f"http://{'cd'[k > 2]}.example/{i}", f'<body><div class="ad">one</div><article><div class="x-footer">only {i % k}</div><p>x {i}</p></article></body>', "clash", 1) for k in (2, 50) for i in range(50)]
    out = site_text.extract(spark.createDataFrame(made, "page_id long, url string, html string, host string, blocks int"), marks=marks)
    # Digits do not tell slots apart.
    named = {"strong": ("ad",), "weak": ("x-footer",)} if marks else {}
    told = lambda host: [(i, host(i, u), x.replace("stock9", "stock").replace("stock3", "stock")) for i, u, x, _, _ in made]
    own = lambda i, u: (u or "").split("/")[2] if u else ""
    expected = brute.main_texts(told(own), site_text.SHARE, site_text.LEAST, **named)
    assert len(expected) == len(made) and {r.page_id: r.text for r in out.collect()} == expected
    alone = brute.main_texts(told(lambda i, u: str(i)), site_text.SHARE, site_text.LEAST, **named)
    assert sum(x != alone[i] for i, x in expected.items()) > 20


MAIN = ("<header><h1>{}</h1></header>", '<h1 class="entry-header">{}</h1>', '<section class="related-work">{}</section>', '<div class="share-prices">{}</div>', '<div id="form-and-function">{}</div>', '<div class="page-header no-sidebar">{}</div>')


@pytest.mark.parametrize("page", MAIN)
def test_names_alone_drop_no_main_text(spark, page):
    made = [(i, f"http://a.example/{i}", f"<body><nav>menu</nav><article>{page.format(f'Title {i}')}<p>Own {i} <span class=ad>buy</span> text</p></article>") for i in range(12)]
    out = site_text.extract(spark.createDataFrame(made, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in out.collect()} == {i: f"Title {i}\n\nOwn {i} text" for i in range(12)}


def test_recurrence_decides_without_names(spark):
    """On the given pages counts alone, with all names of tags, classes and roles switched off, give nearly all texts."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html")
    named = {r.page_id: r.text for r in site_text.extract(pages).collect()}
    counted = {r.page_id: r.text for r in site_text.extract(pages, marks=False).collect()}
    assert sum(counted[i] == x for i, x in named.items()) > 0.85 * len(named)
    assert all(len(counted[i]) >= len(x) for i, x in named.items())


def test_deep_and_long_pages_take_one_pass():
    import time

    began = time.perf_counter()
    deep = site_text.blocks("<div>" * 50_000 + "<p>" + "word " * 200_000 + "</p>" + "</div>" * 50_000)
    stray = site_text.blocks("<div>x" * 20_000 + "</i>" * 20_000 + "</article>" * 20_000)
    assert len(deep[0]) == 1 and len(deep[1]) == 50_001 and len(stray[0]) == 20_000
    n = 50_000
    for source in ("<div>" * n + "<dt></dt>" * n, "<dt><ul>" + "<div>" * n + "<dt></dt>" * n, "<i><div>" + "<b>" * n + "</i>" * n, "<p>" + "<b>" * n + "<div></div>" * n, "<table><tr>" + "<b>" * n + "<td></td><td>" * n):
        site_text.blocks(source + "end")
    assert time.perf_counter() - began < 40


# 10 near duplicates


@pytest.mark.parametrize(("short", "block"), [(48, 1024), (1, 2)])
def test_near_groups(spark, edge_docs, no_docs, monkeypatch, short, block):
    monkeypatch.setattr(near_dups, "SHORT", short)
    monkeypatch.setattr(near_dups, "BLOCK", block)
    draw = random.Random(5)
    family = [f"f{i}" for i in range(90)]
    made = edge_rows()
    for i in range(40):
        words = list(family)
        for _ in range(draw.randint(0, 4)):
            words[draw.randint(0, 89)] = f"e{draw.randint(0, 50)}"
        made.append((100 + i, " ".join(words)))
    df = spark.createDataFrame(made, "doc_id long, text string").withColumn("node", F.lit("clash"))
    groups, sizes = brute.near_groups(made)
    expected = sorted(((i, n, g if g is not None else i, i == g if g is not None else True) for (i, _), g, n in zip(made, groups, sizes, strict=True)), key=brute.key)
    assert rows(near_dups.near_dups(df).drop("row_key")) == expected
    assert near_dups.near_dups(no_docs).count() == 0
    kept = near_dups.keep_one(df).collect()
    assert len({r.doc_id for r in kept}) == len(kept)


def test_components_of_chains_stars_and_trees(spark):
    chain = [(i, i + 1) for i in range(700)]
    star = [(1000, 1000 + i) for i in range(1, 400)]
    draw = random.Random(11)
    tangle = [(draw.randint(3000, 3300), draw.randint(3000, 3300)) for _ in range(200)]
    roots = {r.node: r.root for r in near_dups.components(spark.createDataFrame(chain + star + tangle, "a long, b long")).collect()}
    at = {}

    def root(x):
        while at.setdefault(x, x) != x:
            x = at[x]
        return x

    for a, b in chain + star + tangle:
        a, b = root(a), root(b)
        at[max(a, b)] = min(a, b)
    assert roots == {x: root(x) for x in at if any(y != x for y in at if root(y) == root(x))}
    assert near_dups.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sets_with_one_hash_are_told_apart(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 7, 70), (2, 7, 71), (3, 7, 70), (4, 8, 80), (5, None, None)], "doc_id int, node long, check long")
    assert {r.doc_id: r.node for r in near_dups.told_apart(rows).collect()} == {1: 7, 2: 71, 3: 7, 4: 8, 5: None}


def test_recall_of_sketches_near_the_threshold(spark):
    """Pairs of texts with similarity 0.75 to 0.77, and as many just below it."""
    draw, made, linked = random.Random(12), [], 0
    while len(made) < 800:
        n = draw.randint(20, 200)
        a = [f"p{len(made)}x{k}" for k in range(n)]
        b = list(a)
        for _ in range(max(1, round(n * draw.uniform(0.02, 0.05)))):
            b[draw.randrange(n)] = f"y{draw.randint(0, 10**9)}"
        x, y = brute.shingle_set(" ".join(a)), brute.shingle_set(" ".join(b))
        if 0.73 <= len(x & y) / len(x | y) <= 0.77:
            linked += 100 * len(x & y) >= 75 * len(x | y)
            made += [(len(made), " ".join(a)), (len(made) + 1, " ".join(b))]
    found = near_dups.near_dups(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert 50 < linked == sum(r.component_id != r.doc_id for r in found)
