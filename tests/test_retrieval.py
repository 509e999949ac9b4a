"""Scores, fusion, metrics and tuning against worked values."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from warraq import queries as Q
from warraq.functions.identity import BENCHMARK_FIELDS
from warraq.operators import dense, evaluate, fusion, hybrid, lexical, postings, present, runner
from warraq.session import materialize

FOLDER = "/root/testdata/sf0.001"


def test_score_of_terms_in_the_section_only(spark):
    rows = [("هذا حكم لطهارة مخصوصة", "كتاب الوضوء الباب الثالث في المياه", "المياه الوضوء", ["المياه", "الوضوء"])]
    pairs = spark.createDataFrame(rows, "text_normalized string, section_text_normalized string, normalized string, terms array<string>")
    r = lexical.score(pairs).first()
    assert (r.score, r.matched_terms, r.phrase_hits, r.term_hits, r.section_hits, r.coverage) == (151.0, 2, 0, 0, 2, 1.0)


@pytest.mark.parametrize(("limit", "asked", "expected"), [(10, None, (10, 500)), (1, None, (1, 250)), (100, 9000, (100, 5000)), (10, 3, (10, 10)), (10, 0, (10, 500))])
def test_limits(limit, asked, expected):
    assert lexical.limits(limit, asked) == expected


def test_limits_are_checked():
    with pytest.raises(ValueError):
        lexical.limits(101)


def ranking(spark, names):
    return spark.createDataFrame([(1, n, i + 1) for i, n in enumerate(names)], "query_id int, chunk_id string, rank int")


def order(df):
    return [r.chunk_id for r in df.orderBy("rank").collect()]


def test_fusion(spark):
    both = fusion.fuse(ranking(spark, ["shared", "lexical"]), ranking(spark, ["semantic", "shared"]))
    first = both.orderBy("rank").first()
    assert order(both)[0] == "shared" and set(order(both)) == {"shared", "lexical", "semantic"} and (first.lexical_rank, first.semantic_rank) == (1, 2)
    a, b = ranking(spark, ["l", "s"]), ranking(spark, ["s", "l"])
    assert order(fusion.fuse(a, b)) == ["l", "s"] and order(fusion.fuse(a, b, lexical_weight=0.2, semantic_weight=0.8)) == ["s", "l"]
    assert [r.score for r in fusion.fuse(a, b, lexical_weight=1, semantic_weight=3).collect()] == [r.score for r in fusion.fuse(a, b, lexical_weight=0.25, semantic_weight=0.75).collect()]


@pytest.mark.parametrize(("weights", "said"), [((-0.1, 1.1), "below zero"), ((0, 0), "no ranking"), ((float("nan"), 1), "finite")])
def test_bad_weights(weights, said):
    with pytest.raises(ValueError, match=said):
        fusion.shares([weights])


def test_metrics(spark):
    cases = spark.createDataFrame([("a", "direct", "easy", 5, 1), ("b", "broad", "hard", 5, 5), ("c", "direct", "easy", 5, 5)], "case_id string, query_type string, difficulty string, k int, max_rank int")
    hits = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, True), ("b", 1, True), ("b", 6, True)], "case_id string, rank int, relevant boolean")
    results = evaluate.case_results(cases, hits)
    found = {r.case_id: r for r in results.collect()}
    a, c = found["a"], found["c"]
    assert (a.hit, a.hit_at_1, a.hit_at_3, a.passed, a.first_rank, a.reciprocal_rank, a.relevant_count, a.precision_at_k) == (True, False, True, False, 2, 0.5, 2, 0.4)
    assert found["b"].relevant_count == 1 and (c.hit, c.first_rank, c.reciprocal_rank) == (False, None, 0.0)
    total = evaluate.summary(results).first()
    assert (total.n_cases, total.n_passed, total.mean_first_rank, total.mrr, total.all_passed) == (3, 1, 1.5, 0.5, False)
    assert evaluate.failed_gates(total, hit_rate=0.9, mrr=0.5) == ["hit_rate"]
    empty = evaluate.summary(results.limit(0)).first()
    assert (empty.n_cases, empty.pass_rate, empty.mean_first_rank, empty.all_passed) == (0, 0.0, None, True)
    assert {(r.slice, r.value): r.n_cases for r in evaluate.slices(results).collect()} == {("all", "all"): 3, ("query_type", "direct"): 2, ("query_type", "broad"): 1, ("difficulty", "easy"): 2, ("difficulty", "hard"): 1}


@pytest.mark.parametrize(
    ("rows", "winner"),
    [([(0.6, 0.4, 0.5, 0.9, 0.9, 0.9), (0.7, 0.3, 0.6, 0.1, 0.2, 0.1)], 1), ([(0.6, 0.4, 0.7, 0.3, 0.8, 0.2), (0.5, 0.5, 0.7, 0.4, 0.1, 0.1)], 1), ([(0.5, 0.5, 0.7, 0.7, 0.7, 0.7), (0.9, 0.1, 0.7, 0.7, 0.7, 0.7)], 1), ([(0.5, 0.5, 0.7, 0.7, 0.7, 0.7), (1.0, 1.0, 0.7, 0.7, 0.7, 0.6)], 0)],
)
def test_best_weights(spark, rows, winner):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "grid_position int, lexical double, semantic double, pass_rate double, hit_at_1_rate double, mrr double, mean_precision_at_k double")
    assert evaluate.best(df).first().grid_position == winner
    full = df.withColumns({c: F.lit(1) for c in ("label", "hit_rate", "hit_at_3_rate", "mean_first_rank", "failed_case_ids")})
    assert "grid_position" not in evaluate.compact(full).columns and evaluate.compact(full).count() == df.count()


def test_grid():
    assert evaluate.parse_weights("0.5,0.4") == ((0.5, 0.5), (0.4, 0.6))
    with pytest.raises(ValueError, match="shares of its own"):
        evaluate.checked_grid([(1, 1), (0.5, 0.5)])


def test_benchmark_file(spark, tmp_path):
    case = {"id": "a", "query": "q", "expected_section_contains": ["x"]}
    path = tmp_path / "b.json"
    path.write_text(json.dumps({"dataset_id": "d", "description": "d", "label_provenance": "l", "cases": [case]}))
    r = evaluate.load_benchmark(spark, str(path)).first()
    assert (r.k, r.max_rank, r.query_type, r.difficulty) == (5, 5, "direct", "medium")
    path.write_text(json.dumps({"dataset_id": "d", "description": "d", "label_provenance": "l", "cases": [case, case | {"k": 51}]}))
    with pytest.raises(ValueError):
        evaluate.load_benchmark(spark, str(path))
    good = {"dataset_id": "d", "description": "d", "label_provenance": "l", "schema_version": 2, "cases": [case]}
    for field, value in (("dataset_id", " "), ("description", 3), ("label_provenance", None), ("schema_version", True), ("schema_version", 0), ("schema_version", "1"), ("schema_version", 1.5), ("cases", []), ("cases", {})):
        path.write_text(json.dumps(good | {field: value}))
        with pytest.raises(ValueError, match=field):
            evaluate.load_benchmark(spark, str(path))
    path.write_text(json.dumps(good))
    assert evaluate.load_benchmark(spark, str(path)).count() == 1


def test_pages_must_be_known(spark):
    rows = [("a", ["x"], None, 125, 130)]
    case = spark.createDataFrame(rows, "case_id string, expected_section_contains array<string>, expected_volume int, expected_page_min int, expected_page_max int")
    ask = lambda page: case.select(evaluate.location_is_relevant(F.lit("p x"), F.lit(1), F.lit(page).cast("int"))).first()[0]
    assert [ask(p) for p in (120, 125, 130, 131, None)] == [False, True, True, False, False]


def placed_chunks(spark):
    rows = [(f"c{i}", f"h{i}", "w", "v", "REJECTED" if i == 3 else "ACCEPTED", i, i, ["p"], "p", 1, i, None, "s", [1.0, float(i)], f"word{i} text", "p") for i in range(4)]
    return spark.createDataFrame(rows, "chunk_id string, text_hash string, work_uri string, version_uri string, quality_status string, sequence_no int, ingest_order int, section_path array<string>, section_title string, volume int, page int, page_side string, source_text_sha256 string, embedding array<float>, text_normalized string, section_text_normalized string")


def test_benchmarks_run_by_retriever(spark, tmp_path):
    chunks, path = placed_chunks(spark), str(tmp_path)
    dense.build(chunks, F.col("embedding"), path, "c", "m", 2)
    cases = spark.createDataFrame([(0, "b", "word2", "w", ["p"], None, 2, 2, 1, 1, "direct", "easy"), (1, "a", "word1", None, ["p"], 1, 1, 1, 2, 2, "direct", "hard")], "position int, case_id string, query string, work_uri string, expected_section_contains array<string>, expected_volume int, expected_page_min int, expected_page_max int, k int, max_rank int, query_type string, difficulty string")
    probes = spark.createDataFrame([("b", [1.0, 2.0]), ("a", [1.0, 2.0])], "query_id string, query_vector array<float>")
    corpus = runner.Corpus(chunks, path, "c", "m", 2, probes)
    ranks = {}
    for name in runner.RETRIEVERS:
        told = runner.run_benchmark(cases, corpus, name)
        ranks[name] = {r.case_id: r.first_rank for r in told["cases"].collect()}
        assert runner.report(told["cases"]).count() == 1 + 4 + 2 and runner.report(told["cases"], failures_only=True).filter("part = 'case'").count() == 0 and runner.report(told["cases"], summary_only=True).count() == 5
        assert told["elapsed_seconds"] > 0 and told["summary"]["n_cases"] == 2 and told["retrieval_id"] == runner.RETRIEVERS[name][0]
    assert ranks == {"lexical": {"a": 1, "b": 1}, "semantic": {"a": 2, "b": 1}, "hybrid": {"a": 1, "b": 1}}
    with pytest.raises(ValueError, match="no retriever"):
        runner.run_benchmark(cases, corpus, "x")
    with pytest.raises(ValueError, match="no place"):
        runner.run_benchmark(cases.withColumn("expected_page_min", F.lit(9)), corpus, "lexical")
    stale = runner.Corpus(chunks.filter("sequence_no > 0"), path, "c", "m", 2, probes)
    with pytest.raises(ValueError, match="stale"):
        runner.run_benchmark(cases, stale, "semantic")
    with pytest.raises(Exception, match="expected results of 3"):
        evaluate.summary(told["cases"], 3).collect()


def test_failed_cases_stand_in_their_order(spark):
    cases = spark.createDataFrame([(i, i, "direct", "easy", 1, 1) for i in (10, 9, 2)], "case_id int, position int, query_type string, difficulty string, k int, max_rank int")
    none = spark.createDataFrame([], "query_id int, chunk_id string, rank int")
    sweep = lambda c: evaluate.sweep(c, none, none, none.select("query_id", "chunk_id"), [(1, 1)]).first().failed_case_ids
    assert sweep(cases.drop("position")) == "2,9,10" and sweep(cases.withColumn("position", -F.col("position"))) == "10,9,2"


def test_embedding_in_batches(spark):
    seen = dense.embed(spark.createDataFrame([("ab",), (None,), ("c",)], "t string").coalesce(1), "t", lambda: lambda texts: [[float(len(x)), float(len(texts))] for x in texts], batch=2)
    assert [list(r.embedding) for r in seen.collect()] == [[2.0, 2.0], [0.0, 2.0], [1.0, 1.0]]
    with pytest.raises(ValueError, match="batch"):
        dense.embed(seen, "t", None, batch=257)


def test_index_and_manifest(spark, tmp_path):
    chunks = placed_chunks(spark)
    path = str(tmp_path)
    assert dense.build(chunks, F.col("embedding"), path, "c", "m", 2) == 3
    dense.check_ready(spark, path, "c", "m", 2)
    dense.check_fresh(chunks, path, "c")
    with pytest.raises(ValueError, match="already exists"):
        dense.build(chunks, F.col("embedding"), path, "c", "m", 2)
    dense.check_ready(spark, path, "c", "m", 2)
    with pytest.raises(ValueError, match="stale"):
        dense.check_fresh(chunks.filter("sequence_no > 0"), path, "c")
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id int, query_vector array<float>")
    hits = dense.search(spark, path, "c", asked, "m", 2, 2, work_uri="w").orderBy("rank").collect()
    assert [(r.chunk_id, r.embedding_model, r.embedding_schema_version, r.section_path) for r in hits] == [("c2", "m", 1, ["p"]), ("c1", "m", 1, ["p"])]
    with pytest.raises(ValueError, match="not ready"):
        dense.search(spark, path, "c", asked, "other", 2)
    with pytest.raises(ValueError, match="have no"):
        dense.points(chunks.drop("page"), F.col("embedding"), "m")
    assert [r.chunk_id for r in dense.top_k(chunks, asked, 2).orderBy("rank").collect()] == ["c2", "c3"]


def test_bibliography(spark):
    rows = [("0595IbnRushdHafid.BidayatMujtahid", None), ("x", "t"), ("y", None)]
    out = present.with_bibliography(spark.createDataFrame(rows, "work_uri string, work_title string"), present.catalog(spark))
    found = {r.work_uri: r.bibliographic_provenance for r in out.collect()}
    assert [found[w].verification_status for w, _ in rows] == ["VERIFIED_EXTERNAL_CATALOG", "SOURCE_METADATA", "UNVERIFIED"]
    assert found[rows[0][0]].source_record_id == "cb32268155q"


def test_hybrid_search_fuses_more_than_it_returns(spark):
    """Chunk 29 is the 30th of both rankings, which have nothing else in common."""
    order = [*range(50, 79), 29, *range(79, 99), *range(29), *range(30, 50)]
    text = lambda i: "word" if i < 50 else "other"
    chunks = spark.createDataFrame([(f"c{i:02}", i, i, text(i), "", "w") for i in range(99)], "chunk_id string, ingest_order long, sequence_no int, text_normalized string, section_text_normalized string, work_uri string")
    vectors = spark.createDataFrame([(f"c{i:02}", [1.0, k / 100]) for k, i in enumerate(order)], "chunk_id string, embedding array<double>")
    queries = lexical.analyze(spark.createDataFrame([(1, "word", None)], "query_id int, query string, work_uri string"))
    probes = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query_vector array<double>")
    first = hybrid.search_batch(chunks, vectors, queries, probes).orderBy("rank").first()
    assert (first.chunk_id, first.lexical_rank, first.semantic_rank, first.score) == ("c29", 30, 30, pytest.approx(1 / 90))
    with pytest.raises(ValueError):
        hybrid.search_batch(chunks, vectors, queries, probes, limit=101)


@pytest.mark.parametrize("bound", [0, 1 << 20])
def test_nearest_by_blocks(spark, monkeypatch, bound):
    """The same scores, to the last bit, and ranks as by a fold over each pair: ties, zero and null vectors, works."""
    import random

    draw = random.Random(6)
    some = lambda: [float(draw.choice((-1, 0, 1, 2))) * draw.choice((1.0, 0.1)) for _ in range(7)]
    rows = [(f"c{i:03d}", f"w{i % 3}", draw.choice((some(), some(), [1.0, 2.0, 0.0, 0.0, 0.0, 0.0, 1.0], [0.0] * 7, None))) for i in range(300)]
    vectors = spark.createDataFrame(rows, "chunk_id string, work_uri string, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(k, some()[:6] + [3.0], draw.choice((None, "w1"))) for k in range(9)], "query_id long, query_vector array<float>, work string")
    told = lambda df: sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in df.collect())
    kept = vectors.filter("embedding is not null and exists(embedding, x -> x <> 0)").crossJoin(queries).filter("work is null or work = work_uri")
    norm = lambda c: F.sqrt(dense.dot(F.col(c), F.col(c)))
    scored = kept.withColumn("score", dense.dot(F.col("embedding"), F.col("query_vector")) / (norm("embedding") * norm("query_vector")))
    plain = sorted((r.query_id, -r.score, r.chunk_id) for r in scored.collect())
    monkeypatch.setattr(dense, "QUERY_BYTES", bound)
    found = dense.top_k(vectors, queries, 8, within=("work", "work_uri"))
    assert told(found) == [(q, k + 1, c, -s) for q in range(9) for k, (_, s, c) in enumerate([x for x in plain if x[0] == q][:8])]
    assert bound == 0 or "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString() and "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_blocks_and_pairs_agree_to_the_last_bit(spark, monkeypatch):
    vectors, queries = Q._vectors(spark, FOLDER), Q._probes(spark, FOLDER)
    one = sorted(map(tuple, dense.top_k(vectors, queries, 7).select("query_id", "rank", "chunk_id", "score").collect()))
    monkeypatch.setattr(dense, "QUERY_BYTES", 0)
    assert one == sorted(map(tuple, dense.top_k(vectors, queries, 7).select("query_id", "rank", "chunk_id", "score").collect()))


def test_a_report_tells_of_cases_and_their_times(spark, tmp_path):
    case = {"id": "a", "query": "word2 text", "work_uri": "w", "expected_section_contains": ["p"], "expected_page_min": 2, "expected_page_max": 2, "k": 3}
    file = tmp_path / "b.json"
    file.write_text(json.dumps({"dataset_id": "d", "description": "d", "label_provenance": "l", "schema_version": 2, "cases": [case, case | {"id": "b", "query": "word1", "k": 1}]}))
    cases, chunks = evaluate.load_benchmark(spark, str(file)), placed_chunks(spark).withColumn("status", F.col("quality_status"))
    versions = [("w", "v", "s", None, "ACCEPTED", "p", None), ("z", "y", "s", "m", "ACCEPTED", "p", "r")]
    held = spark.createDataFrame(versions, "work_uri string, version_uri string, source_text_sha256 string, source_metadata_sha256 string, quality_status string, provider string, release string")
    told = chunks.withColumn("part", F.lit(0)).withColumn("ingest_order", F.col("ingest_order").cast("long"))
    cases, chunks, lists = materialize(cases), materialize(chunks), materialize(postings.lists(told))
    index = postings.Index(lists, *map(materialize, (postings.heads(told), postings.words(lists))))
    corpus = runner.Corpus(chunks, lists=index, versions=held)
    out = runner.run_benchmark(cases, corpus, "lexical", at_once=2)
    rows = {r.case_id: r for r in out["cases"].collect()}
    a, b = rows["a"], rows["b"]
    assert (a.query, a.expected_section_contains, a.returned_results, a.top_section_paths, a.top_pages, a.first_rank) == ("word2 text", ["p"], 3, [["p"]] * 3, [2, 0, 1], 1)
    assert (b.returned_results, b.top_pages, b.first_rank, b.passed) == (1, [1], None, False) and min(a.latency_ms, b.latency_ms) > 0
    assert out["median_latency_ms"] == pytest.approx((a.latency_ms + b.latency_ms) / 2, abs=1e-3) and out["p95_latency_ms"] == max(a.latency_ms, b.latency_ms)
    named = [dict(zip(("work_uri", "version_uri", "source_text_sha256", "source_metadata_sha256", "quality_status", "provider", "release"), v, strict=True)) for v in versions]
    digest = lambda of: hashlib.sha256(json.dumps(of, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert sorted(named[0]) == list(BENCHMARK_FIELDS) and out["corpus_fingerprint"] == digest(named[:1])
    assert (out["dataset_id"], out["schema_version"], out["benchmark_sha256"], out["summary"]["n_hits"]) == ("d", 2, hashlib.sha256(file.read_bytes()).hexdigest(), 1)
    assert json.loads(runner.head(out))["retrieval_id"] == "deterministic_lexical_v2"
    # Together and without times: the same but for these.
    plain = runner.run_benchmark(cases.withColumn("work_uri", F.lit(None).cast("string")), corpus, "lexical", at_once=None)
    same = lambda df: sorted(df.drop("latency_ms").collect())
    assert same(plain["cases"]) == same(out["cases"]) and plain["corpus_fingerprint"] == digest(named) and plain["median_latency_ms"] is None


def test_text_of_a_query_that_is_embedded(spark):
    assert spark.createDataFrame([("  wadi  ",), ("أَنهار",)], "q string").select(dense.query_text(F.col("q"))).collect() == [("query: wadi",), ("query: انهار",)]
