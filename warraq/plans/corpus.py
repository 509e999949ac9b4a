"""The retrieval model over the driver's tables: documents are chunks, their source a work, their
language an author, labels a review status, benchmark items queries. Their texts are known to be in
NFKC, so search text is derived without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq.functions import text as T
from warraq.functions.identity import chunk_id, sha256
from warraq.operators import postings
from warraq.operators.lexical import small
from warraq.session import keep, materialize, spread, table


def chunks(spark: SparkSession, folder: str, vectors: bool = False) -> DataFrame:
    docs, labels = spread(table(spark, folder, "documents")), table(spark, folder, "labels")
    status = F.when(F.col("toxic") == 1, "REJECTED").when(F.col("quality") == 1, "ACCEPTED").when(F.col("quality") == 0, "REVIEW_REQUIRED").otherwise("UNREVIEWED")
    held = docs.join(labels, "doc_id", "left")
    version = F.concat_ws(".", "lang", "source", F.lit("V1"))
    out = held.select(
        F.col("doc_id"), F.col("doc_id").alias("ingest_order"), F.col("doc_id").cast("int").alias("sequence_no"), F.col("lang").alias("author_uri"), F.concat_ws(".", "lang", "source").alias("work_uri"), version.alias("version_uri"),
        status.alias("quality_status"), F.array("lang", "source").alias("section_path"), F.col("text").alias("text_original"), F.col("n_chars"),
    )
    out = out.withColumns({"text_hash": sha256(F.col("text_original")), "text_normalized": T.normalize(F.col("text_original"), composed=True), "section_text_normalized": T.normalize(F.array_join("section_path", " "), composed=True)})
    out = out.withColumn("chunk_id", chunk_id(F.col("version_uri"), F.col("sequence_no"), F.col("text_hash")))
    if vectors:
        out = out.join(table(spark, folder, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id")
    return out


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk table as a store holds it, with its search texts, so that no search derives them anew."""
    return materialize(chunks(spark, folder))


#: (application, files and their times) of the chunk tables that were stored and indexed, with what was made.
_indexed: dict[tuple[str, str], tuple[DataFrame, postings.Index]] = {}


def indexed(spark: SparkSession, folder: str) -> tuple[DataFrame, postings.Index]:
    """The chunk table and its inverted index, as a store holds them: made once for the files that are there now, and
    read by every search of this program."""
    files = []
    for name in ("documents", "labels"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        status = [fs.getFileStatus(path), *(fs.listStatus(path) if fs.getFileStatus(path).isDirectory() else [])]
        files += [f"{x.getPath()} {x.getLen()} {x.getModificationTime()}" for x in status]
    key = (spark.sparkContext.applicationId, "\n".join(files))
    if key not in _indexed:
        chunks = stored(spark, folder)
        _indexed[key] = (chunks, postings.build(chunks))
        keep(chunks, *vars(_indexed[key][1]).values())
    return _indexed[key]


def queries(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, query, work_uri): the benchmark's items."""
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit(None).cast("string").alias("work_uri"))


def holding(chunks: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of the chunks whose original text holds a passage (query_id, passage) as a whole.

    A word inside a passage is a word of every text that holds it, so pairs meet by the longest such word and
    are then checked; a passage of fewer than three words is looked for in every chunk."""
    inner = F.filter(T.tokens(F.col("passage")), lambda w, i: (i > 0) & (i < F.size(T.tokens(F.col("passage"))) - 1))
    keyed = passages.withColumn("word", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    held = F.contains("text_original", "passage")
    words = chunks.select("chunk_id", "text_original", F.explode(F.array_distinct(T.tokens(F.col("text_original")))).alias("word"))
    found = words.join(small(keyed.filter("word is not null")), "word").filter(held).select("query_id", "chunk_id")
    rest = keyed.filter("word is null and passage is not null").drop("word")
    return found if rest.isEmpty() else found.union(chunks.join(small(rest), held).select("query_id", "chunk_id"))


def relevant(spark: SparkSession, folder: str, held: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id): documents that hold a whole item."""
    items = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    return holding(chunks(spark, folder) if held is None else held, items)


def telling(spark: SparkSession, folder: str, ranked: DataFrame) -> DataFrame:
    """Of ranked pairs (query_id, text_original) those whose text holds the whole item: ``relevant`` where only
    what a ranking gave is asked for, so no other text is looked at."""
    items = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("__item"))
    return ranked.join(small(items), "query_id").filter(F.contains("text_original", "__item")).drop("__item")


#: The same model as DuckDB SQL, to stand after WITH.
def _normalized(x: str) -> str:
    x = f"regexp_replace({x}, '(?:Page|Folio)V\\d+P\\d+[AB]?', ' ', 'g')"
    x = f"regexp_replace({x}, '\\bMilestone\\d+\\b', ' ', 'g')"
    x = f"regexp_replace({x}, '(?m)^(?:###\\s+\\|(?:EDITOR|PARATEXT|APPENDIX)\\|\\s*|###\\s+\\|+\\s*|#\\s+|~~)', '', 'g')"
    x = f"regexp_replace({x}, '(?m)^###\\s+\\$+\\s*', '', 'g')"
    x = f"regexp_replace({x}, '[{T.DIACRITICS[1:-1]}]', '', 'g')"
    x = f"replace(translate({x}, '{T.ALEFS}{T.YEH_IN}', '{T.ALEF * len(T.ALEFS)}{T.YEH}'), '{T.TATWEEL}', '')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


NORMALIZED = _normalized
CHUNKS_SQL = f"""chunks AS (
  SELECT *, sha256(version_uri || chr(10) || sequence_no::VARCHAR || chr(10) || text_hash) AS chunk_id FROM (
    SELECT d.doc_id, d.doc_id AS ingest_order, d.doc_id::INTEGER AS sequence_no, lang AS author_uri, lang || '.' || source AS work_uri, lang || '.' || source || '.V1' AS version_uri,
      CASE WHEN toxic = 1 THEN 'REJECTED' WHEN quality = 1 THEN 'ACCEPTED' WHEN quality = 0 THEN 'REVIEW_REQUIRED' ELSE 'UNREVIEWED' END AS quality_status,
      lang, source, text AS text_original, n_chars, sha256(text) AS text_hash, {_normalized("text")} AS text_normalized, lang || ' ' || source AS section_text_normalized
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id))"""
QUERIES_SQL = f"""raw_queries AS (
  SELECT item_id AS query_id, text AS query FROM benchmark
), tokens AS (
  SELECT query_id, query, {_normalized("query")} AS normalized, regexp_extract_all({_normalized("query")}, '{T.WORD}') AS found FROM raw_queries
), queries AS (
  SELECT query_id, query, normalized, list_filter(found, lambda t, i: list_position(list_transform(found, lambda x: lower(x)), lower(t)) = i) AS terms FROM tokens
)"""
#: How often y stands in x.
OCCURS = lambda x, y: f"((length({x}) - length(replace({x}, {y}, ''))) // length({y}))"
SCORED_SQL = f"""pairs AS (
  SELECT query_id, normalized, terms, len(terms) AS total_terms, c.*,
    len(list_filter(terms, lambda t: contains(lower(text_normalized), lower(t)) OR contains(lower(section_text_normalized), lower(t)))) AS hits,
    len(list_filter(terms, lambda t: contains(text_normalized, t) OR contains(section_text_normalized, t))) AS matched_terms,
    coalesce(list_sum(list_transform(terms, lambda t: {OCCURS("text_normalized", "t")})), 0) AS term_hits,
    len(list_filter(terms, lambda t: contains(section_text_normalized, t))) AS section_hits,
    {OCCURS("text_normalized", "normalized")} AS phrase_hits, {OCCURS("section_text_normalized", "normalized")} AS section_phrase
  FROM chunks c, queries
), scored AS (
  SELECT *, 100.0::DOUBLE * matched_terms / total_terms + 25.0 * least(phrase_hits, 3) + 2.0 * least(term_hits, 20) + 8.0 * section_hits + 35.0::DOUBLE * section_hits / total_terms + 20.0 * least(section_phrase, 2) AS score
  FROM pairs WHERE hits > 0
)"""


def ranked_sql(candidates: int, limit: int, where: str = "quality_status <> 'REJECTED'") -> str:
    return f"""candidates AS (
  SELECT * FROM scored WHERE {where} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, ingest_order) <= {candidates}
), lexical AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, matched_terms DESC, phrase_hits DESC, term_hits DESC, sequence_no, hits DESC, ingest_order) AS rank FROM candidates QUALIFY rank <= {limit}
)"""
