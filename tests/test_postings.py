"""The stored inverted index: the same ranking as a scan, with few texts read and nothing made twice."""

import random

import pytest
from pyspark.sql import functions as F

from warraq import queries as Q
from warraq import session
from warraq.operators import lexical, postings
from warraq.plans import corpus

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "chunk_id string, ingest_order long, sequence_no int, work_uri string, quality_status string, text_normalized string, section_text_normalized string"
COLUMNS = ("query_id", "rank", "chunk_id", "score", "matched_terms", "total_terms", "phrase_hits", "term_hits", "section_hits", "coverage", "hits")


def told(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*COLUMNS).collect())


def made(spark, n=700, seed=3):
    """Chunks in works, some rejected, with letters that lower-casing turns into others, orders far apart, nulls."""
    draw = random.Random(seed)
    syllables = ["ab", "Ab", "ba", "c", "नhe", "كتاب", "ال", "K", "İ", "x9", "zz", "rare"]
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randint(1, 3)))
    rows = []
    for i in range(n):
        text = " ".join(word() for _ in range(draw.randint(0, 25)))
        rows.append((f"id{i:04d}", i * draw.choice((1, 1, 1)) + (i // 50) * 1000, i % 40, f"w{i % 3}", draw.choice(("ACCEPTED", "REJECTED", "UNREVIEWED")), draw.choice((text, text, text, None, "")), draw.choice((word() + " " + word(), None, ""))))
    return spark.createDataFrame(rows, SCHEMA)


def asked(spark, seed=4):
    draw = random.Random(seed)
    texts = ["ab ba", "AB", "كتاب ال", "zz rare x9", "ab c K", "kelvin", "i̇", "abab abba Abc zzz", "c", "rareab rare abrare", "nothing here", "abcK", "x9x9 x9", "ab Ab"]
    rows = [(k, t, draw.choice((None, None, "w1"))) for k, t in enumerate(texts * 2)]
    return session.materialize(lexical.analyze(spark.createDataFrame(rows, "query_id long, query string, work_uri string"), composed=True))


@pytest.mark.parametrize(("limit", "most", "rejected"), [(3, 5, False), (10, None, True), (1, 40, False), (7, 7, True)])
def test_index_ranks_as_a_scan(spark, limit, most, rejected):
    chunks, queries = session.materialize(made(spark)), asked(spark)
    index = postings.build(chunks)
    expected = lexical.search_batch(lexical.allowed(chunks, include_rejected=rejected), queries, limit, most)
    assert told(postings.search_batch(index, chunks, queries, limit, most, rejected)) == told(expected)


def test_queries_in_slices_and_blocks_passed_over(spark, monkeypatch):
    chunks, queries = session.materialize(made(spark, 400, 8)), asked(spark, 9)
    index = postings.build(chunks)
    expected = told(lexical.search_batch(lexical.allowed(chunks), queries, 4, 6))
    monkeypatch.setattr(postings, "QUERIES", 5)
    monkeypatch.setattr(postings, "PUSHED", 0)
    assert told(postings.search_batch(index, chunks, queries, 4, 6)) == expected
    assert postings.search_batch(index, chunks, queries.limit(0), 4, 6).collect() == []
    none = postings.build(chunks.limit(0))
    assert postings.search_batch(none, chunks.limit(0), queries, 4, 6).collect() == []


def test_holding(spark):
    chunks = session.materialize(made(spark))
    index = postings.build(chunks)
    for term in ("ab", "CAB", "rareZZ", "k", "كتاب", "none"):
        low = F.lit(term.lower())
        scan = chunks.filter(F.contains(F.lower("text_normalized"), low) | F.contains(F.lower(F.coalesce("section_text_normalized", F.lit(""))), low))
        assert sorted(r.chunk_id for r in postings.holding(index, chunks, term).collect()) == sorted(r.chunk_id for r in scan.collect())


@pytest.mark.parametrize("limit", [5, 25])
def test_few_texts_are_read(spark, monkeypatch, limit):
    """What is asked for twice over at first, and beyond that only what may still enter."""
    chunks, index = corpus.indexed(spark, "/root/testdata/sf0.01")
    queries = session.materialize(lexical.analyze(corpus.queries(spark, "/root/testdata/sf0.01"), composed=True))
    read, plain = [], postings._scored
    monkeypatch.setattr(postings, "_scored", lambda c, pairs, q: read.append(pairs.count()) or plain(c, pairs, q))
    postings.search_batch(index, chunks, queries, limit).collect()
    assert 2 * limit * queries.count() >= read[0] and sum(read) <= 5 * limit * queries.count()


def test_a_second_search_makes_no_index_and_scans_no_text(spark, monkeypatch):
    chunks, index = corpus.indexed(spark, FOLDER)
    assert corpus.indexed(spark, FOLDER)[1] is index
    for name in ("build", "lists"):
        monkeypatch.setattr(postings, name, lambda *a: pytest.fail("an index was made"))
    assert Q.QUERIES["lexical_batch"](spark, FOLDER).count() > 0
    plan = postings.contenders(index, Q._analyzed(spark, FOLDER), 5)._jdf.queryExecution().executedPlan().toString()
    assert "text_normalized" not in plan and chunks._warraq_path not in plan


def test_an_index_outlives_the_query_that_made_it(spark):
    monkey = dict(corpus._indexed)
    corpus._indexed.clear()
    try:
        session.settled(spark, lambda: Q.QUERIES["lexical_trigram_candidates"](spark, FOLDER))
        assert corpus.indexed(spark, FOLDER)[0].count() > 0
    finally:
        corpus._indexed.update(monkey)
