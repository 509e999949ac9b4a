"""Exact deduplication against a persistent index of text digests, bucketed and sorted by digest.

``DigestIndex`` is a table in a folder: one row for each distinct text, in as many buckets as the session
has shuffle partitions when the index is made, sorted inside, with a partition a batch. A batch of new
data is reduced to one row a digest (map-side first, so a text that fills a third of it is no hot key),
meets the index in a sort-merge anti-join that moves the new rows only, and what is left is written as
the batch's partition in the same buckets. Texts are never shuffled, 32-byte digests are.

A batch is written to its own partition, cleared before, and its like is looked for in the other ones, so a
batch that died half-way, or is given twice, gives the same rows again. What an earlier batch has stays:
batches go from the most to the least preferred. Inside a batch the row with the largest doc_id stays.

Texts are equal when identical after lower-casing A-Z; a SHA-256 of 32 bytes stands for the text.

Edge cases: null text counts as empty, and empty texts are equal. A null doc_id is smaller than any other;
a group without other ids keeps one of its rows and names it by null. Of rows that agree in doc_id and text
one stays. Extra columns are ignored by ``duplicates`` and kept by ``fresh``. An empty table gives no rows.
"""

from __future__ import annotations

import re
import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq.session import materialize, new_path

#: Batches that the query deals the table into.
BATCHES = 4
_COLUMNS = "digest BINARY, doc_id BIGINT, row BIGINT"


def normal(text: Column) -> Column:
    """The text with A-Z in lower case; null is empty."""
    text = F.coalesce(text, F.lit(""))
    # Other capitals stay, so the session's own lower-casing will do only where there are none.
    return F.when(text.rlike(r"^\p{ASCII}*$"), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def digest(text: Column) -> Column:
    """32 bytes that stand for a text."""
    return F.unhex(F.sha2(normal(text), 256))


class DigestIndex:
    """An index of digests in a folder; opened again, it has the batches and the buckets it had."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        found = self._found()
        if found and buckets and found != buckets:
            raise ValueError(f"this index has {found} buckets; copy it by moved_to to have {buckets}")
        self.buckets = found or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"warraq_digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} ({_COLUMNS}, batch INT) USING parquet PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/buckets={self.buckets}'"
        )
        if found:
            spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    def _folder(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _remove(self, batch: int) -> None:
        """What an attempt at this batch has left."""
        self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (batch = {int(batch)})")
        folder, files = self._folder(f"{self.path}/buckets={self.buckets}/batch={int(batch)}")
        files.delete(folder, True)

    def _found(self) -> int | None:
        folder, files = self._folder(self.path)
        names = [x.getPath().getName() for x in files.listStatus(folder)] if files.exists(folder) else []
        return next((int(m[1]) for x in names if (m := re.fullmatch(r"buckets=(\d+)", x))), None)

    def rows(self) -> DataFrame:
        """(digest, doc_id, row, batch) of every distinct text."""
        return self.spark.table(self.name)

    def joined(self, digests: DataFrame, batch: int) -> DataFrame:
        """What ``add`` would enter as this batch."""
        best = F.max(F.struct("doc_id", (-F.col("row")).alias("row"))).alias("best")
        one = digests.groupBy("digest").agg(best).select("digest", F.col("best.doc_id").alias("doc_id"), (-F.col("best.row")).alias("row"))
        known = self.rows().filter(F.col("batch") != batch).select("digest")
        return one.hint("merge").join(known, "digest", "left_anti")

    def add(self, digests: DataFrame, batch: int) -> DataFrame:
        """Enters what is new among ``digests`` (digest, doc_id, row) as a batch, and gives the rows it entered. The
        rows' numbers tell apart those that agree in all else; the least stays."""
        new = self.joined(digests, batch).select("digest", "doc_id", "row", F.lit(batch).cast("int").alias("batch"))
        self._remove(batch)
        new.write.insertInto(self.name)
        return self.rows().filter(F.col("batch") == batch)

    def moved_to(self, path: str, buckets: int) -> DigestIndex:
        """A copy with other buckets, one file each, all batches in one: for an index that has outgrown its own."""
        other = DigestIndex(self.spark, path, buckets)
        other.add(self.rows().select("digest", "doc_id", "row"), 0)
        return other

    def close(self) -> None:
        """Forgets the table's name; the folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def fresh(docs: DataFrame, index: DigestIndex, batch: int) -> DataFrame:
    """The rows of a batch of documents whose texts the index had not seen, one of each text, with all their columns."""
    keyed = docs.withColumn("__digest", digest(F.col("text"))).withColumn("__id", F.col("doc_id").cast("long"))
    entered = index.add(keyed.select(F.col("__digest").alias("digest"), F.col("__id").alias("doc_id"), F.lit(0).cast("long").alias("row")), batch)
    entered = entered.select(F.col("digest").alias("__digest"), F.col("doc_id").alias("__entered"))
    one = keyed.dropDuplicates(["__digest", "__id"])
    return one.join(entered, (one["__digest"] == entered["__digest"]) & one["__id"].eqNullSafe(entered["__entered"]), "left_semi").select(*docs.columns)


def duplicates(docs: DataFrame, index: DigestIndex, batches: int = BATCHES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row; the index, which must be empty, is filled by
    batches of falling doc_id, so that of equal texts the largest doc_id is the one that it has."""
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row")))
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    step = (high - low) // batches + 1 if low is not None else 1
    # Ids are numbers, not places: batches of uneven size cost time, never a result.
    of = F.coalesce(F.floor((F.lit(high) - F.col("doc_id")) / step), F.lit(batches - 1)) if low is not None else F.lit(0)
    for batch in range(batches if low is not None else 1):
        index.add(rows.filter(of == batch), batch)
    sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
    # A table of its own, so that both sides of the join below are dealt out there and a hot digest's rows can be split.
    told = materialize(index.rows().select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row")).join(sizes.hint("merge"), "digest"))
    joined = rows.join(told.hint("merge"), "digest")
    return joined.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op11(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return duplicates(docs, DigestIndex(spark, new_path(spark, "digests")))


OP11_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY text) AS kept, sha256(text) AS text_sha256 FROM d
"""
