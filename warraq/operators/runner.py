"""Whole benchmarks by retriever: label check, index check, ranking, metrics."""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from time import perf_counter

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from warraq.functions.identity import benchmark_fingerprint
from warraq.functions.text import normalize
from warraq.operators import dense, evaluate, fusion, lexical, postings
from warraq.session import discard, materialize


@dataclass(frozen=True)
class Corpus:
    """What retrievers search: chunks, and for vectors the written index, its model, and the queries' vectors
    (query_id, query_vector). ``lists``: the stored inverted index of the chunks; ``told``: their fingerprint as the
    store has it; ``versions``: with ``identity.BENCHMARK_FIELDS``, for the report's digest of the corpus."""

    chunks: DataFrame
    index_path: str = ""
    collection: str = ""
    model: str = ""
    dimension: int = 0
    probes: DataFrame | None = None
    lists: postings.Index | None = None
    told: Row | None = None
    versions: DataFrame | None = None

    def allowed(self) -> DataFrame:
        return lexical.allowed(self.chunks)

    def nearest(self, queries: DataFrame, limit: int) -> DataFrame:
        """Each query's vectors within its work, where it names one."""
        asked = self.probes.join(queries.select("query_id", F.col("work_uri").alias("__asked")), "query_id")
        spark = self.chunks.sparkSession
        dense.check_ready(spark, self.index_path, self.collection, self.model, self.dimension)
        held = spark.read.parquet(f"{self.index_path}/{self.collection}").select("embedding", "payload.*").filter(F.col("quality_status") != "REJECTED")
        return dense.top_k(held, asked, limit, within=("__asked", "work_uri"))


def _lexical(corpus: Corpus, queries: DataFrame, limit: int) -> DataFrame:
    return lexical.search_batch(corpus.allowed(), queries, limit) if corpus.lists is None else postings.search_batch(corpus.lists, corpus.chunks, queries, limit)


def _semantic(corpus: Corpus, queries: DataFrame, limit: int) -> DataFrame:
    return corpus.nearest(queries, limit)


def _hybrid(corpus: Corpus, queries: DataFrame, limit: int) -> DataFrame:
    size = fusion.pool_size(limit)
    return fusion.fuse(_lexical(corpus, queries, size), _semantic(corpus, queries, size), limit=limit)


#: (name in reports, a fixed value; whether it needs a fresh index; search).
RETRIEVERS: dict[str, tuple[str, bool, Callable[[Corpus, DataFrame, int], DataFrame]]] = {
    "lexical": ("deterministic_lexical_v2", False, _lexical),
    "semantic": ("semantic_multilingual_e5_large_v1", True, _semantic),
    "hybrid": ("hybrid_rrf_lexical_v2_e5_large_v1", True, _hybrid),
}


def places(chunks: DataFrame) -> DataFrame:
    return chunks.select("work_uri", "section_path", "volume", "page")


def _retriever(corpus: Corpus, name: str) -> Callable[[Corpus, DataFrame, int], DataFrame]:
    """A retriever's search, once its index is known to be fresh."""
    if name not in RETRIEVERS:
        raise ValueError(f"no retriever is called {name}; there are {', '.join(RETRIEVERS)}")
    _, needs_index, search = RETRIEVERS[name]
    if needs_index:
        dense.check_fresh(corpus.chunks, corpus.index_path, corpus.collection, corpus.told)
    return search


def _asked(cases: DataFrame) -> DataFrame:
    return lexical.analyze(cases.select(F.col("case_id").alias("query_id"), "query", "work_uri", "k"))


def found_together(cases: DataFrame, corpus: Corpus, retriever: str) -> DataFrame:
    """(query_id, chunk_id, rank). Cases of one k are searched together, for a ranking's pool follows from its length;
    k is 50 at most."""
    search, queries, found = _retriever(corpus, retriever), _asked(cases), None
    for (k,) in sorted(cases.select("k").distinct().collect()):
        # Written, for a union of rankings that are laid by query is not itself laid so.
        part = materialize(search(corpus, queries.filter(F.col("k") == k).drop("k"), k).select("query_id", "chunk_id", "rank"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        raise ValueError("the benchmark has no cases")
    return found


def found_by_case(cases: DataFrame, corpus: Corpus, retriever: str, at_once: int = 4) -> tuple[DataFrame, DataFrame]:
    """(query_id, chunk_id, rank) and (case_id, latency_ms), each case searched by jobs of its own.

    ``at_once`` cases are searched at a time, each in a scheduler pool of its own, so with spark.scheduler.mode=FAIR none
    waits behind the tasks of another. A case's time is that of its whole search, from plan to its k results, as the
    caller of one search has it; what comes to the driver is these results."""
    search, spark = _retriever(corpus, retriever), cases.sparkSession
    queries = materialize(_asked(cases))
    asked = cases.select("case_id", "k").collect()  # a benchmark is one file
    if not asked:
        raise ValueError("the benchmark has no cases")

    def one(place: int) -> tuple[list[Row], float]:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"case-{place % at_once}")
        case, k = asked[place]
        began = perf_counter()
        rows = search(corpus, queries.filter(F.col("query_id") == case).drop("k"), k).select("query_id", "chunk_id", "rank").collect()
        return rows, round(1000 * (perf_counter() - began), 3)

    with ThreadPoolExecutor(at_once) as threads:
        told = [t.result() for t in [threads.submit(inheritable_thread_target(spark)(one), k) for k in range(len(asked))]]
    discard(queries)
    kind = cases.schema["case_id"].dataType.simpleString()
    found = spark.createDataFrame([tuple(r) for rows, _ in told for r in rows], f"query_id {kind}, chunk_id string, rank int")
    return found, spark.createDataFrame([(r["case_id"], ms) for r, (_, ms) in zip(asked, told, strict=True)], f"case_id {kind}, latency_ms double")


def judged(cases: DataFrame, corpus: Corpus, found: DataFrame) -> DataFrame:
    """``evaluate.case_results`` of the benchmark's cases (as ``evaluate.load_benchmark`` gives them), with what a report
    says of a case besides: its query and expected sections, and how many results it got, their sections and pages."""
    held = found.join(corpus.chunks.select("chunk_id", "section_path", "volume", "page"), "chunk_id").withColumnRenamed("query_id", "case_id")
    path = normalize(F.array_join("section_path", " / "), composed=True)
    asked = cases.select("case_id", "k", "expected_section_contains", "expected_volume", "expected_page_min", "expected_page_max")
    hits = held.join(asked, "case_id").filter(F.col("rank") <= F.col("k")).withColumn("relevant", evaluate.location_is_relevant(path, F.col("volume"), F.col("page")))
    got = hits.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rank", "section_path", "page"))).alias("got"))
    seen = lambda field: F.coalesce(F.transform("got", lambda x: x[field]), F.array().cast(hits.schema[field].dataType.simpleString().join(("array<", ">"))))
    told = cases.select("case_id", "query", "expected_section_contains").join(got, "case_id", "left").select("case_id", "query", "expected_section_contains", F.greatest(F.size("got"), F.lit(0)).alias("returned_results"), seen("section_path").alias("top_section_paths"), seen("page").alias("top_pages"))
    return evaluate.case_results(cases, hits.select("case_id", "rank", "relevant")).join(told, "case_id")


def results(cases: DataFrame, corpus: Corpus, retriever: str) -> DataFrame:
    """``judged`` results of all cases, searched together."""
    return judged(cases, corpus, found_together(cases, corpus, retriever))


def run_benchmark(cases: DataFrame, corpus: Corpus, retriever: str, validate_labels: bool = True, at_once: int | None = 4) -> dict:
    """One report: what was run over what, the metrics of all cases, the median and 95th percentile of their times, the
    results by case (a written table) and the time that all searches took together. Without ``at_once`` the cases are
    searched together in one plan for each k, and have no times of their own."""
    if validate_labels:
        lost = evaluate.unlabelled(cases, places(corpus.chunks)).limit(1).collect()
        if lost:
            raise ValueError(f"no place of the corpus meets the case {lost[0]['case_id']}")
    began = perf_counter()
    if at_once:
        found, times = found_by_case(cases, corpus, retriever, at_once)
        by_case = materialize(judged(cases, corpus, found).join(times, "case_id", "left"))
    else:
        by_case = materialize(results(cases, corpus, retriever).withColumn("latency_ms", F.lit(None).cast("double")))
    elapsed = perf_counter() - began
    named = cases.select(*[F.col(c) if c in cases.columns else F.lit(None).alias(c) for c in ("dataset_id", "schema_version", "benchmark_sha256")]).first().asDict()
    told, times = evaluate.summary(by_case, cases.count()).first().asDict(), evaluate.latency(by_case, "latency_ms").first()
    return named | {
        "corpus_fingerprint": None if corpus.versions is None else benchmark_fingerprint(corpus.versions, cases),
        "retrieval_id": RETRIEVERS[retriever][0], "summary": told | {"n_hits": by_case.filter("hit").count()}, "median_latency_ms": times["median"], "p95_latency_ms": times["p95"],
        "cases": by_case, "elapsed_seconds": round(elapsed, 3),
    }


def failures(by_case: DataFrame) -> DataFrame:
    return by_case.filter(~F.col("passed"))


def head(told: dict) -> str:
    """What a report says of its run, as JSON: all but the cases and the metrics of ``report``."""
    return json.dumps({k: v for k, v in told.items() if k not in ("cases", "summary")}, ensure_ascii=False)


def report(by_case: DataFrame, summary_only: bool = False, failures_only: bool = False) -> DataFrame:
    """(part, json): the summary, each slice and, unless only the summary is asked for, each case (or failed case)."""
    line = lambda df, part: df.select(F.lit(part).alias("part"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
    out = line(evaluate.summary(by_case), "summary").union(line(evaluate.slices(by_case), "slice"))
    return out if summary_only else out.union(line(failures(by_case) if failures_only else by_case, "case"))
