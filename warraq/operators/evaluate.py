"""Retrieval metrics and weight sweeps over whole benchmarks, as single plans.

Cases carry case_id, query_type, difficulty, k and max_rank; hits carry case_id, rank and relevant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq.functions.text import half_even, normalize
from warraq.operators.fusion import merge, rank_fused, shares

DIFFICULTIES = ("easy", "medium", "hard")
CASE = (
    "id string, query string, work_uri string, expected_section_contains array<string>, k int, max_first_relevant_rank int, query_type string, difficulty string, expected_volume int, expected_page_min int, expected_page_max int, notes string"
)
BENCHMARK = f"schema_version int, dataset_id string, description string, label_provenance string, cases array<struct<{CASE.replace(' string', ':string').replace(' int', ':int').replace(' array', ':array')}>>"


def load_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a JSON benchmark with defaults filled in and the hash of the file's bytes; every
    rule a case breaks is an error."""
    told = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("benchmark_sha256"), F.decode("content", "UTF-8").alias("json"))
    broken = header_violations(told)
    if broken:
        raise ValueError(f"benchmark {path}: {broken[0]}")
    raw = told.select("benchmark_sha256", F.from_json("json", BENCHMARK, {"mode": "FAILFAST"}).alias("b"))
    version = F.coalesce("b.schema_version", F.lit(1)).alias("schema_version")
    cases = raw.select("benchmark_sha256", "b.dataset_id", version, F.posexplode_outer("b.cases").alias("position", "c")).select("benchmark_sha256", "dataset_id", "schema_version", "position", "c.*")
    k = F.coalesce("k", F.lit(5))
    filled = cases.withColumns({"query_type": F.coalesce("query_type", F.lit("direct")), "difficulty": F.coalesce("difficulty", F.lit("medium")), "k": k, "max_rank": F.coalesce("max_first_relevant_rank", k)}).withColumnRenamed("id", "case_id")
    broken = violations(filled).limit(1).collect()
    if broken:
        raise ValueError(f"benchmark case {broken[0]['case_id']}: {broken[0]['broken'][0]}")
    return filled.drop("max_first_relevant_rank")


def header_violations(told: DataFrame) -> list[str]:
    """The rules that a benchmark's fields outside its cases break; one row, of text ``json``."""
    value = F.try_parse_json("json")
    kind = lambda name: F.regexp_extract(F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant")), r"^\w+", 0)
    as_text = lambda name: F.try_variant_get(value, f"$.{name}", "string")
    rules = {f"{name} must be a string with more than blanks": (kind(name) != "STRING") | (F.trim(as_text(name)) == "") for name in ("dataset_id", "description", "label_provenance")}
    version = as_text("schema_version")
    rules |= {
        "schema_version must be a whole number from 1 on": version.isNotNull() & ((kind("schema_version") != "BIGINT") | (version.cast("long") < 1)) | (kind("schema_version") == "VOID"),
        "cases must be an array with a case": (kind("cases") != "ARRAY") | (F.try_variant_get(value, "$.cases[0]", "variant").isNull()),
    }
    optional = {"schema_version must be a whole number from 1 on": False}
    row = told.select(F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(optional.get(rule, True))), F.lit(rule)) for rule, broken in rules.items()])).alias("broken")).first()
    return list(row["broken"]) if row else ["the file is not there"]


def violations(cases: DataFrame) -> DataFrame:
    """(case_id, broken rules) of the cases that break any."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    rules = {
        "id must be a non-empty string": blank(F.col("case_id")),
        "query must be a non-empty string": blank(F.col("query")),
        "work_uri must be a non-empty string": F.col("work_uri").isNotNull() & blank(F.col("work_uri")),
        "expected_section_contains must be a non-empty array of non-empty strings": F.coalesce((F.size("expected_section_contains") < 1) | F.exists("expected_section_contains", blank), F.lit(True)),
        "k must be between 1 and 50": ~F.col("k").between(1, 50),
        "max_first_relevant_rank must be between 1 and k": ~F.col("max_rank").between(1, F.col("k")),
        "difficulty must be easy, medium, or hard": ~F.col("difficulty").isin(*DIFFICULTIES),
        "expected_page_min exceeds expected_page_max": F.coalesce(F.col("expected_page_min") > F.col("expected_page_max"), F.lit(False)),
    }
    twice = cases.groupBy("case_id").count().filter("count > 1").select("case_id", F.array(F.lit("duplicate benchmark case id")).alias("broken"))
    told = F.array_compact(F.array(*[F.when(broken, F.lit(rule)) for rule, broken in rules.items()]))
    return cases.select("case_id", told.alias("broken")).filter(F.size("broken") > 0).union(twice)


def location_is_relevant(path_normalized: Column, volume: Column, page: Column, composed: bool = False) -> Column:
    """Whether a chunk's place meets a case's expectations; a missing page meets no page bound."""
    held = F.forall("expected_section_contains", lambda e: F.contains(path_normalized, normalize(e, composed=True)))
    meets = lambda expected, test: F.col(expected).isNull() | F.coalesce(test, F.lit(False))
    return held & meets("expected_volume", volume == F.col("expected_volume")) & meets("expected_page_min", page >= F.col("expected_page_min")) & meets("expected_page_max", page <= F.col("expected_page_max"))


def unlabelled(cases: DataFrame, locations: DataFrame) -> DataFrame:
    """The cases that no place of the corpus can meet. Locations are distinct (work_uri, section_path,
    volume, page) rows; a case names its work, so the join is by work where it does."""
    path = normalize(F.array_join("section_path", " / "), composed=True)
    held = locations.select(F.col("work_uri").alias("__work"), path.alias("__path"), F.col("volume").alias("__volume"), F.col("page").alias("__page")).distinct()
    meets = location_is_relevant(F.col("__path"), F.col("__volume"), F.col("__page"))
    named = cases.filter("work_uri is not null").join(held, (F.col("work_uri") == F.col("__work")) & meets, "left_anti")
    return named.unionByName(cases.filter("work_uri is null").join(held, meets, "left_anti"))


def case_results(cases: DataFrame, hits: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """One row a case, with or without hits: first relevant rank, hit@k, @1, @3, passed, reciprocal rank
    and precision at k, whose denominator is k however few results came back."""
    joined = cases.join(hits.filter("relevant").select("case_id", *also, "rank"), ["case_id", *also], "left")
    inside = F.col("rank") <= F.col("k")
    keys = ["case_id", *also, "query_type", "difficulty", "k", "max_rank", *[c for c in ("position",) if c in cases.columns]]
    seen = joined.groupBy(*keys).agg(F.min(F.when(inside, F.col("rank"))).alias("first_rank"), F.count_if(F.coalesce(inside, F.lit(False))).cast("int").alias("relevant_count"))
    first = F.col("first_rank")
    within = lambda n: F.coalesce(first <= n, F.lit(False))
    return seen.withColumns(
        {
            "hit": first.isNotNull(), "hit_at_1": within(F.lit(1)), "hit_at_3": within(F.least(F.lit(3), F.col("k"))), "passed": within(F.col("max_rank")),
            "reciprocal_rank": F.coalesce(1.0 / first, F.lit(0.0)), "precision_at_k": F.col("relevant_count") / F.col("k"),
        }
    )


def _metrics() -> list[Column]:
    rate = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    return [
        F.count("*").alias("n_cases"), F.count_if("passed").alias("n_passed"), rate("passed").alias("pass_rate"), rate("hit").alias("hit_rate"), rate("hit_at_1").alias("hit_at_1_rate"), rate("hit_at_3").alias("hit_at_3_rate"),
        rate("reciprocal_rank").alias("mrr"), rate("precision_at_k").alias("mean_precision_at_k"), F.avg("first_rank").alias("mean_first_rank"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("all_passed"),
    ]


def summary(results: DataFrame, n_cases: int | None = None) -> DataFrame:
    """The metrics over all cases; with ``n_cases``, results of more or fewer cases are an error."""
    out = results.agg(*_metrics())
    if n_cases is None:
        return out
    lost = F.raise_error(F.concat(F.lit(f"expected results of {n_cases} cases, got "), F.col("n_cases").cast("string"))).cast("long")
    return out.withColumn("n_cases", F.when(F.col("n_cases") == n_cases, F.col("n_cases")).otherwise(lost))


def slices(results: DataFrame) -> DataFrame:
    """The metrics over all cases, by query type and by difficulty, in one pass."""
    sets = results.groupingSets([[], [F.col("query_type")], [F.col("difficulty")]], F.col("query_type"), F.col("difficulty"))
    kind = F.when(F.grouping_id() == 3, "all").when(F.grouping_id() == 1, "query_type").otherwise("difficulty")
    out = sets.agg(kind.alias("slice"), *_metrics())
    return out.withColumn("value", F.coalesce("query_type", "difficulty", F.lit("all"))).drop("query_type", "difficulty")


def latency(results: DataFrame, ms: str) -> DataFrame:
    """Median and nearest-rank 95th percentile."""
    told = results.agg(F.median(ms).alias("median"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {ms})").alias("p95"))
    return told.select(half_even(F.col("median")).alias("median"), half_even(F.col("p95")).alias("p95"))


def failed_gates(row, **minimum: float) -> list[str]:
    """The names of the minimum thresholds that a summary row does not reach."""
    for name, bound in minimum.items():
        if not 0 <= bound <= 1:
            raise ValueError(f"{name} must be between 0 and 1")
    return [name for name, bound in minimum.items() if row[name] < bound]


#: The default grid of (lexical, semantic) weights.
GRID = ((0.50, 0.50), (0.40, 0.60), (0.30, 0.70), (0.20, 0.80), (0.10, 0.90))


def parse_weights(text: str) -> tuple[tuple[float, float], ...]:
    """A grid from lexical weights between 0 and 1, as in ``0.5,0.4``."""
    found = [float(x) for x in text.split(",") if x.strip()]
    if any(not 0 <= x <= 1 for x in found):
        raise ValueError("weights must be between 0 and 1")
    return checked_grid([(x, 1 - x) for x in found])


def checked_grid(grid) -> tuple[tuple[float, float], ...]:
    """A grid with at least one pair, none of them the same as another but for scale."""
    pairs = tuple(grid)
    apart = {tuple(round(w, 8) for w in pair) for pair in shares(pairs)}
    if not pairs or len(apart) < len(pairs):
        raise ValueError("a grid needs pairs of weights, each with shares of its own")
    return pairs


def label(lexical: Column, semantic: Column) -> Column:
    return F.format_string("lexical_%.2f_semantic_%.2f", lexical, semantic)


def sweep(cases: DataFrame, lexical: DataFrame, semantic: DataFrame, relevant: DataFrame, grid=GRID) -> DataFrame:
    """One summary row a weight pair. Both rankings, which carry case_id as query_id, are merged once;
    only the fusion is done anew. ``relevant``: (query_id, chunk_id) pairs."""
    spark = cases.sparkSession
    pairs = checked_grid(grid)
    rows = [(i, float(a), float(b), *share) for i, ((a, b), share) in enumerate(zip(pairs, shares(pairs), strict=True))]
    pairs = spark.createDataFrame(rows, "grid_position int, lexical double, semantic double, lexical_weight double, semantic_weight double")
    most = cases.agg(F.max("k")).first()[0] or 1
    fused = rank_fused(merge(lexical, semantic).crossJoin(F.broadcast(pairs)), most, by=("grid_position", "query_id"))
    hits = fused.join(relevant.withColumn("relevant", F.lit(True)), ["query_id", "chunk_id"]).withColumnRenamed("query_id", "case_id").select("case_id", "grid_position", "rank", "relevant")
    results = case_results(cases.crossJoin(F.broadcast(pairs.select("grid_position"))), hits, also=("grid_position",))
    # In the order of the benchmark file where there is one, else of the ids themselves.
    order = "position" if "position" in cases.columns else "case_id"
    told = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.struct(F.col(order).alias("o"), F.col("case_id").cast("string").alias("id")))))
    failed = F.array_join(F.transform(told, lambda x: x["id"]), ",")
    return results.groupBy("grid_position").agg(*_metrics(), failed.alias("failed_case_ids")).join(F.broadcast(pairs.select("grid_position", "lexical", "semantic")), "grid_position").withColumn("label", label(F.col("lexical"), F.col("semantic")))


def best(candidates: DataFrame) -> DataFrame:
    """The best pair: pass rate, hit@1, MRR, precision, then the lesser semantic weight, then the first."""
    order = F.struct("pass_rate", "hit_at_1_rate", "mrr", "mean_precision_at_k", (-F.col("semantic")).alias("a"), (-F.col("grid_position")).alias("b"))
    return candidates.agg(F.max_by(F.struct(*candidates.columns), order).alias("best")).select("best.*")


def compact(candidates: DataFrame) -> DataFrame:
    """A sweep's rows without what only a full report has."""
    return candidates.select("label", "lexical", "semantic", "pass_rate", "hit_rate", "hit_at_1_rate", "hit_at_3_rate", "mrr", "mean_precision_at_k", "mean_first_rank", "failed_case_ids")
