"""Tagged text and metadata files as DataFrames of whole files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq.functions.identity import sha256, source_key
from warraq.operators import ingest
from warraq.session import discard, materialize
from warraq.sources.store import STATUSES, Store


def clean(raw: Column) -> Column:
    """Without a byte order mark and with line feeds only, as hashes and offsets expect."""
    return F.regexp_replace(F.regexp_replace(raw, "^\\x{FEFF}", ""), "\\r\\n?", "\n")


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, raw) of whole UTF-8 files."""
    files = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), clean(F.col("value")).alias("raw"))
    return files


def documents(texts: DataFrame, versions: DataFrame, books: DataFrame | None = None, authors: DataFrame | None = None) -> DataFrame:
    """One row a text: URI parts, hashes, display fields and body. All frames are (key, raw); the key
    pairs a text with its metadata. URIs that do not agree are an error."""
    held = texts.select("key", F.col("raw").alias("text_raw"))
    for name, frame in (("version", versions), ("book", books), ("author", authors)):
        if frame is None:
            held = held.withColumns({f"{name}_metadata": F.create_map().cast("map<string,string>"), f"{name}_sha256": F.lit(None).cast("string")})
            continue
        maps = ingest.metadata_maps(frame, "key", "raw").withColumnRenamed("metadata", f"{name}_metadata")
        held = held.join(maps, "key", "left").join(frame.select("key", sha256(F.col("raw")).alias(f"{name}_sha256")), "key", "left")
        held = held.withColumn(f"{name}_metadata", F.coalesce(f"{name}_metadata", F.create_map().cast("map<string,string>")))
    uri = ingest.metadata_value(F.col("version_metadata"), "00#VERS#URI######")
    held = held.withColumn("uri", ingest.uri_parts(F.coalesce(uri, F.raise_error(F.lit("Version metadata is missing 00#VERS#URI######")).cast("string"))))

    def agreed(metadata: str, key: str, field: str) -> Column:
        told = ingest.metadata_value(F.col(metadata), key)
        return F.when(told.isNotNull() & (told != F.col(f"uri.{field}")), F.raise_error(F.concat(F.lit("URI "), told, F.lit(" does not match "), F.col(f"uri.{field}"))).cast("string")).otherwise(F.col(f"uri.{field}"))

    header, body = ingest.split_text(F.col("text_raw"))
    return held.select(
        agreed("author_metadata", "00#AUTH#URI######", "author_uri").alias("author_uri"),
        agreed("book_metadata", "00#BOOK#URI######", "work_uri").alias("work_uri"),
        "uri.version_uri", "uri.version_id", "uri.language_code",
        header.alias("text_header"), body.alias("body"), sha256(F.col("text_raw")).alias("source_text_sha256"),
        F.col("version_sha256").alias("source_metadata_sha256"), "book_sha256", "author_sha256", "version_metadata", "book_metadata", "author_metadata",
        ingest.metadata_value(F.col("author_metadata"), "10#AUTH#SHUHRA#AR", meaningful=True).alias("name_display"),
        ingest.death_year(F.col("author_metadata"), F.col("uri.author_uri")).alias("death_year_ah"),
        ingest.metadata_value(F.col("book_metadata"), "10#BOOK#TITLEA#AR", "10#BOOK#TITLEB#AR", meaningful=True).alias("title_display"),
        ingest.metadata_value(F.col("book_metadata"), "10#BOOK#GENRES###", meaningful=True).alias("genres"),
        ingest.quality_issues(F.col("version_metadata")).alias("quality_issues"),
    )


#: What a source's licence allows and asks for: known to be so, known not to be, or unknown.
RIGHTS = ("commercial_use_allowed", "attribution_required")


def right(told: bool | str | None) -> Column:
    """A right as it is told: yes, no or unknown as text, else true, false or null."""
    return ingest.optional_bool(F.lit(told)) if isinstance(told, str) else F.lit(told).cast("boolean")


def tables(docs: DataFrame, provider: str, source_url: str, release: str | None = None, quality_status: str = "UNREVIEWED", max_chars: int = 1800, **rights) -> dict[str, DataFrame]:
    """The rows that a store commits for ``documents``."""
    spark = docs.sparkSession
    told = {"provider": provider, "source_url": source_url, "release": release, "license": None, "copyright_status": None} | {k: v for k, v in rights.items() if k in ("license", "copyright_status")}
    one = spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in told.items()], *[right(rights.get(k)).alias(k) for k in RIGHTS])
    sources = one.withColumn("source_key", source_key(F.col("provider"), F.col("source_url"), F.col("release")))
    versions = docs.crossJoin(F.broadcast(sources.select("source_key"))).withColumn("quality_status", F.lit(quality_status)).withColumn("metadata", F.col("version_metadata"))
    return {
        "sources": sources,
        "authors": docs.select("author_uri", "name_display", "death_year_ah", F.col("author_metadata").alias("metadata"), F.col("author_sha256").alias("metadata_sha256")).dropDuplicates(["author_uri"]),
        "works": docs.select("work_uri", "author_uri", "title_display", "genres", F.col("book_metadata").alias("metadata"), F.col("book_sha256").alias("metadata_sha256")).dropDuplicates(["work_uri"]),
        "text_versions": versions,
        "chunks": ingest.chunk_all(docs.select("version_uri", "body"), max_chars),
    }


def ingest_files(spark: SparkSession, store: Store | None, texts: list[str], versions: list[str], books: list[str] | None = None, authors: list[str] | None = None, provider: str = "", source_url: str = "", max_chars: int = 1800, dry_run: bool = False, **told) -> dict:
    """Reads texts with their metadata files, which stand at the same places of the lists, and commits them.
    Hashes are those of the files as they are. A dry run reads and counts only; any other needs a source's URL.
    Gives the counts of ``ingest.summary`` by version, of headings of the older form, and the mode."""
    if any(len(x) != len(texts) for x in (versions, books or texts, authors or texts)):
        raise ValueError("each text needs one file of each kind of metadata")
    if not dry_run and not (source_url and store):
        raise ValueError("a store and source_url are needed unless dry_run is set")
    if told.get("quality_status", STATUSES[0]) not in STATUSES:
        raise ValueError(f"quality_status must be one of {', '.join(STATUSES)}")
    spark.range(1).select(*[right(told.get(k)).alias(k) for k in RIGHTS]).collect()  # an error before any file is read

    def read(paths: list[str]) -> DataFrame:
        parts = [read_files(spark, x).select(F.lit(str(k)).alias("key"), "raw") for k, x in enumerate(paths)]
        return reduce(DataFrame.unionByName, parts)

    docs = materialize(documents(read(texts), read(versions), read(books) if books else None, read(authors) if authors else None))
    rows = tables(docs, provider, source_url, max_chars=max_chars, **told)
    rows["chunks"] = materialize(rows["chunks"])
    counts = ingest.summary(rows["chunks"]).join(ingest.legacy_headings(docs), "version_uri", "right").fillna(0)
    found = {r["version_uri"]: {k: v for k, v in r.asDict().items() if k != "version_uri"} for r in counts.collect()}
    if not dry_run:
        store.commit(rows)
    discard(rows["chunks"])
    discard(docs)
    return {"mode": "dry-run" if dry_run else "persisted", "quality_status": told.get("quality_status", "UNREVIEWED"), "versions": found}
