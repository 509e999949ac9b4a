"""Hashes and identities as Column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from warraq.session import materialize, ranked

# Fixed value: the namespace of index points.
POINT_NAMESPACE = "df7db06bc9f74ecfae4c759ea9e51b6b"


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_id(version_uri: Column, sequence_no: Column, text_hash: Column) -> Column:
    return sha256(F.concat_ws("\n", version_uri, sequence_no.cast("string"), text_hash))


def point_uuid(name: Column) -> Column:
    """The version-5 UUID of a name in the points' namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(POINT_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12)
    )


def json_string(text: Column) -> Column:
    """A JSON string as Python writes it without ASCII escapes, null for null."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def source_key(provider: Column, source_url: Column, release: Column) -> Column:
    """Hash of a source's identity as JSON with sorted keys and blanks after separators."""
    value = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(json_string(c))
    return sha256(F.concat(F.lit('{"provider": '), value(provider), F.lit(', "release": '), value(release), F.lit(', "source_url": '), value(source_url), F.lit("}")))


FINGERPRINT_FIELDS = ("chunk_id", "quality_status", "sequence_no", "text_hash", "version_uri", "work_uri")


#: Rows that an exact digest takes at most: some 300 bytes a row in one value.
EXACT_ROWS = 1_000_000
#: Lines, or digests of lines, that a digest of the tree covers.
FAN = 4096


def _line() -> Column:
    return F.concat(F.to_json(F.struct(*[F.col(f) for f in FINGERPRINT_FIELDS])), F.lit("\n"))


def _bounded(df: DataFrame, by: tuple[str, ...] = ()) -> None:
    most = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0 if by else df.count()
    if most > EXACT_ROWS:
        raise ValueError(f"an exact fingerprint of {most} rows is one value by definition; take tree_fingerprint")


def chunk_fingerprint(chunks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One digest over all chunks in the order of work, version, sequence number and chunk id (or of
    each group of ``by``), of ``EXACT_ROWS`` chunks at most."""
    _bounded(chunks, by)
    row = F.struct("work_uri", "version_uri", "sequence_no", "chunk_id", _line().alias("line"))
    grouped = chunks.groupBy(*by) if by else chunks
    return grouped.agg(sha256(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["line"]), "")).alias("fingerprint"), F.count("*").alias("n_chunks"))


def version_digests(chunks: DataFrame, fan: int = FAN) -> DataFrame:
    """(work_uri, version_uri, digest, n_chunks), one row a version: the lines of ``chunk_fingerprint`` in order of
    sequence number and chunk id, ``fan`` sequence numbers to a digest, and one digest over these. A version's row
    depends on its own chunks alone, so a commit makes new ones for the versions that came and keeps the others."""
    keys = ("work_uri", "version_uri")
    row = F.struct("sequence_no", "chunk_id", _line().alias("line"))
    runs = chunks.groupBy(*keys, F.floor(F.col("sequence_no") / fan).alias("run")).agg(_digest(row).alias("line"), F.count("*").alias("n"))
    return runs.groupBy(*keys).agg(_digest(F.struct("run", "line")).alias("digest"), F.sum("n").alias("n_chunks"))


def _digest(row: Column) -> Column:
    """One digest over the lines of a group's rows, in the order of the fields before the line."""
    return sha256(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["line"]), ""))


def root(digests: DataFrame, fan: int = FAN) -> Row:
    """(fingerprint, n_chunks) of a corpus from the digests of its versions in order of work and version: ``fan`` of
    them to a digest, then ``fan`` digests to a digest, up to a single one. No task holds more than ``fan`` of them."""
    line = F.to_json(F.struct("digest", "n_chunks", "version_uri", "work_uri")).alias("line")
    held = ranked(digests.select("work_uri", "version_uri", "n_chunks", line), "work_uri", "version_uri")
    n, left = held.agg(F.coalesce(F.sum("n_chunks"), F.lit(0)), F.count("*")).first()
    if not left:
        return Row(fingerprint=hashlib.sha256(b"").hexdigest(), n_chunks=0)
    level = held.select("__place", "line")
    while True:
        level, left = materialize(level.groupBy(F.floor(F.col("__place") / fan).alias("run")).agg(_digest(F.struct("__place", "line")).alias("line")).withColumnRenamed("run", "__place")), -(-left // fan)
        if left == 1:
            return Row(fingerprint=level.first()["line"], n_chunks=n)


def tree_fingerprint(chunks: DataFrame, fan: int = FAN) -> Row:
    """(fingerprint, n_chunks) of any number of chunks: ``root`` of the digests of all versions, made anew."""
    return root(version_digests(chunks, fan), fan)


def corpus_fingerprint(versions: DataFrame) -> DataFrame:
    """One digest over (author, work, version, text hash, metadata hash, status, source) rows as a JSON
    array, nulls included; of ``EXACT_ROWS`` versions at most."""
    _bounded(versions)
    fields = sorted(("author_uri", "work_uri", "version_uri", "source_text_sha256", "source_metadata_sha256", "quality_status", "source_key"))
    line = F.to_json(F.struct(*[F.col(f) for f in fields]), {"ignoreNullFields": "false"})
    row = F.struct("version_uri", line.alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["line"]), ",")
    return versions.agg(sha256(F.concat(F.lit("["), joined, F.lit("]"))).alias("fingerprint"), F.count("*").alias("n_versions"))


BENCHMARK_FIELDS = ("provider", "quality_status", "release", "source_metadata_sha256", "source_text_sha256", "version_uri", "work_uri")


def benchmark_fingerprint(versions: DataFrame, cases: DataFrame) -> str:
    """The digest of the corpus that a benchmark is run over, in its report: all versions with their sources as a JSON
    array in order of work and version, or those of the works named where every case names one."""
    if cases.filter("work_uri is null").isEmpty():
        versions = versions.join(cases.select("work_uri").distinct(), "work_uri", "left_semi")
    _bounded(versions)
    line = F.to_json(F.struct(*[F.col(f) for f in BENCHMARK_FIELDS]), {"ignoreNullFields": "false"})
    row = F.struct("work_uri", "version_uri", line.alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["line"]), ",")
    return versions.agg(sha256(F.concat(F.lit("["), joined, F.lit("]")))).first()[0]
