"""Exact dense ranking by cosine, its index and the index's manifest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructType

from warraq.functions.identity import point_uuid, tree_fingerprint
from warraq.functions.text import normalize, strip

SCHEMA_VERSION = 1
STATES = ("BUILDING", "READY", "FAILED")
MANIFEST = "collection_name string, embedding_model string, embedding_dimension int, embedding_schema_version int, corpus_fingerprint string, point_count bigint, status string, last_error string"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def passage(text_normalized: Column, section_path: Column, composed: bool = False) -> Column:
    """The text that is embedded for a chunk."""
    section = F.coalesce(normalize(F.array_join(section_path, " / "), composed), F.lit(""))
    body = strip(text_normalized)
    return F.concat(F.lit("passage: "), F.when(section != "", F.concat(section, F.lit("\n"))).otherwise(""), body)


def query_text(query: Column, composed: bool = False) -> Column:
    return F.concat(F.lit("query: "), normalize(query, composed))


#: Bytes of query vectors that go to every task; more of them meet the vectors pair by pair.
QUERY_BYTES = 64 << 20
#: By how much a product of blocks may differ from the sum it stands for.
NEAR = 1e-9


class _Nearest:
    """The best rows of one query so far, by score and then by chunk_id."""

    def __init__(self, limit: int):
        self.limit, self.rows = limit, []

    def least(self) -> float:
        return self.rows[-1][0] if len(self.rows) == self.limit else -np.inf

    def add(self, rows: list[tuple]) -> None:
        self.rows = sorted(self.rows + rows, key=lambda r: (-r[0], r[1]))[: self.limit]


def _blocked(asked: list, columns: list[str], limit: int, within: str | None, kind: pa.DataType):
    """What a task does with its vectors: products of blocks select, sums in order tell the scores of what they select."""
    queries = np.array([r["query_vector"] for r in asked], np.float64)
    in_order = lambda x: np.cumsum(x, 1)[:, -1]  # noqa: E731  as a fold over the elements
    norms = np.sqrt(in_order(queries * queries))
    wanted = [r["__within"] for r in asked] if within else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, last = [_Nearest(limit) for _ in asked], None
        for batch in batches:
            last = batch
            column = batch.column("embedding")
            there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            flat = column.take(pa.array(there)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if not len(there):
                continue
            vectors = flat.reshape(len(there), -1)
            own = np.sqrt(in_order(vectors * vectors))
            with np.errstate(all="ignore"):
                near = (vectors @ queries.T) / (own[:, None] * norms[None, :])
            ids = batch.column("chunk_id").take(pa.array(there)).to_pylist()
            of = np.array(batch.column(within).take(pa.array(there)).to_pylist(), object) if within else None
            picked: list[tuple[int, np.ndarray]] = []
            for q, kept in enumerate(best):
                x = near[:, q] if wanted is None or wanted[q] is None else np.where(of == wanted[q], near[:, q], np.nan)
                fits = np.flatnonzero(x >= kept.least() - NEAR)
                if len(fits) > limit:
                    fits = fits[x[fits] >= np.partition(x[fits], len(fits) - limit)[len(fits) - limit] - NEAR]
                if len(fits):
                    picked.append((q, fits))
            if not picked:
                continue
            rows = np.unique(np.concatenate([x for _, x in picked]))
            held = pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(there[rows])) for c in columns], columns)
            for q, fits in picked:
                scores = in_order(vectors[fits] * queries[q]) / (own[fits] * norms[q])
                best[q].add([(float(s), ids[k], held, int(np.searchsorted(rows, k))) for s, k in zip(scores, fits.tolist(), strict=True)])
        if last is None:
            return
        for r, kept in zip(asked, best, strict=True):
            for score, _, held, k in kept.rows:
                yield pa.RecordBatch.from_arrays([*held.slice(k, 1).columns, pa.array([r["query_id"]], kind), pa.array([score])], [*columns, "query_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, limit: int = 10, within: tuple[str, str] | None = None) -> DataFrame:
    """(query_id, rank, score, vector columns): the nearest vectors of each query, exactly.

    Queries (query_id, query_vector) go to the vectors. Up to ``QUERY_BYTES`` of them, each task multiplies its vectors
    with them block by block and passes on no more than ``limit`` rows a query, so a row for a pair never is. What a
    block selects is scored by the sum in order that ``cosine`` stands for. More queries meet the vectors pair by pair.
    A vector without a direction (null or zero) is near nothing. ``within``: a column of the queries and one of the
    vectors; a query that has a value there is asked among the vectors that have it, too."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    size = queries.agg(F.sum(F.size("query_vector") * 8)).first()[0] or 0
    if size > QUERY_BYTES:
        found = _pairwise(vectors, queries, within)
    else:
        columns = [c for c in vectors.columns if c != "embedding"]
        told = F.col(within[0]).cast("string") if within else F.lit(None).cast("string")
        asked = queries.select("query_id", "query_vector", told.alias("__within")).collect()
        schema = StructType([f for f in vectors.schema if f.name != "embedding"]).add("query_id", queries.schema["query_id"].dataType).add("score", DoubleType())
        run = _blocked(asked, columns, limit, within[1] if within else None, to_arrow_type(queries.schema["query_id"].dataType))
        found = vectors.mapInArrow(run, schema) if asked else vectors.sparkSession.createDataFrame([], schema)
    return found.withColumn("rank", rank).filter(F.col("rank") <= limit)


def _pairwise(vectors: DataFrame, queries: DataFrame, within: tuple[str, str] | None) -> DataFrame:
    norm = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
    asked = queries.select("query_id", "query_vector", norm("query_vector").alias("__qn"), (F.col(within[0]) if within else F.lit(None)).cast("string").alias("__within"))
    pairs = vectors.withColumn("__n", norm("embedding")).filter("__n > 0").crossJoin(asked.filter("__qn > 0"))
    if within:
        pairs = pairs.filter(F.col("__within").isNull() | (F.col("__within") == F.col(within[1])))
    return pairs.withColumn("score", dot(F.col("embedding"), F.col("query_vector")) / (F.col("__n") * F.col("__qn"))).drop("embedding", "query_vector", "__n", "__qn", "__within")


def embed(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 8, to: str = "embedding") -> DataFrame:
    """Adds the vectors of a text column. ``load`` gives a function from texts to vectors, such as a model's; it is
    called once a task, and what it gives sees ``batch`` texts at a time."""
    if not 1 <= batch <= 256:
        raise ValueError("batch must be between 1 and 256")

    @F.pandas_udf("array<float>")
    def vectors(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for column in columns:
            texts = column.fillna("").tolist()
            yield pd.Series([v for k in range(0, len(texts), batch) for v in model(texts[k : k + batch])], dtype=object)

    return df.withColumn(to, vectors(F.col(text)))


PAYLOAD = ("chunk_id", "work_uri", "version_uri", "quality_status", "sequence_no", "volume", "page", "page_side", "section_path", "section_title", "text_hash", "source_text_sha256")


def points(chunks: DataFrame, embedding: Column, model: str) -> DataFrame:
    """Index rows: a stable id, the vector, and the payload that a hit carries. A column that is not there is an error."""
    lost = [c for c in PAYLOAD if c not in chunks.columns]
    if lost:
        raise ValueError(f"chunks have no {', '.join(lost)}")
    path = F.coalesce("section_path", F.array().cast("array<string>")).alias("section_path")
    held = F.struct(*[path if c == "section_path" else F.col(c) for c in PAYLOAD], F.lit(model).alias("embedding_model"), F.lit(SCHEMA_VERSION).alias("embedding_schema_version"))
    return chunks.filter(F.col("quality_status") != "REJECTED").select(point_uuid(F.col("chunk_id")).alias("point_id"), embedding.alias("embedding"), held.alias("payload"))


def write_manifest(spark: SparkSession, path: str, **values) -> None:
    row = {"embedding_schema_version": SCHEMA_VERSION, "last_error": None} | values
    if row["status"] not in STATES:
        raise ValueError(f"status must be one of {STATES}")
    names = [x.split()[0] for x in MANIFEST.split(", ")]
    spark.createDataFrame([tuple(row[n] for n in names)], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{row['collection_name']}")


def read_manifest(spark: SparkSession, path: str, collection: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest/{collection}")


def build(chunks: DataFrame, embedding: Column, path: str, collection: str, model: str, dimension: int, recreate: bool = False) -> int:
    """Writes the index and its manifest; refuses to replace one unless asked to, before it touches the
    manifest, so a refusal leaves a good index READY."""
    spark = chunks.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{collection}")
    if not recreate and target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        raise ValueError(f"collection {collection} already exists")
    kept = chunks.filter(F.col("quality_status") != "REJECTED")
    told = tree_fingerprint(kept)
    state = {"collection_name": collection, "embedding_model": model, "embedding_dimension": dimension, "corpus_fingerprint": told["fingerprint"], "point_count": told["n_chunks"]}
    write_manifest(spark, path, **state, status="BUILDING")
    try:
        points(chunks, embedding, model).write.mode("overwrite").parquet(f"{path}/{collection}")
        written = spark.read.parquet(f"{path}/{collection}").count()
        if written != told["n_chunks"]:
            raise ValueError(f"index holds {written} points, expected {told['n_chunks']}")
    except Exception as error:
        write_manifest(spark, path, **state | {"last_error": str(error)[:500]}, status="FAILED")
        raise
    write_manifest(spark, path, **state, status="READY")
    return written


def check_ready(spark: SparkSession, path: str, collection: str, model: str, dimension: int) -> None:
    row = read_manifest(spark, path, collection).first()
    if row["status"] != "READY" or row["embedding_model"] != model or row["embedding_dimension"] != dimension or row["embedding_schema_version"] != SCHEMA_VERSION:
        raise ValueError(f"index {collection} is not ready for {model} ({dimension}): {row.asDict()}")


def check_fresh(chunks: DataFrame, path: str, collection: str, told: Row | None = None) -> None:
    """The index must stand for exactly the chunks there are now. ``told``: their fingerprint, as ``Store.fingerprint``
    has it from digests that commits keep; else it is made from all chunks."""
    spark = chunks.sparkSession
    row, now = read_manifest(spark, path, collection).first(), told or tree_fingerprint(chunks.filter(F.col("quality_status") != "REJECTED"))
    held = spark.read.parquet(f"{path}/{collection}").count()
    if row["corpus_fingerprint"] != now["fingerprint"] or row["point_count"] != now["n_chunks"] or held != row["point_count"]:
        raise ValueError(f"index {collection} is stale")


def search(spark: SparkSession, path: str, collection: str, queries: DataFrame, model: str, dimension: int, limit: int = 10, work_uri: str | None = None, include_rejected: bool = False) -> DataFrame:
    """The nearest points of a written index that is READY for this model: (query_id, rank, score, payload columns)."""
    check_ready(spark, path, collection, model, dimension)
    held = spark.read.parquet(f"{path}/{collection}").select("embedding", "payload.*")
    if work_uri is not None:
        held = held.filter(F.col("work_uri") == work_uri)
    return top_k(held if include_rejected else held.filter(F.col("quality_status") != "REJECTED"), queries, limit)
