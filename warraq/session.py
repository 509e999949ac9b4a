"""What every job needs from its session: tables, the package on executors, cut lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_SHIPPED = "warraq.shipped"
#: Spark drops an execution's shuffle files at its end; whatever is read again is in a written table.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan dealt out anew where it has fewer splits than there are cores, as one small file has; a
    scan of many splits stays as it is, so no large table is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.select(df.columns[:1]).rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so Python workers can import it."""
    context = spark.sparkContext
    if context.getLocalProperty(_SHIPPED):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="warraq-"), f"warraq-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(_PACKAGE)))
    context.addPyFile(archive)
    context.setLocalProperty(_SHIPPED, "yes")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where none is set, a local master (tests) gets a
    temporary folder, and a cluster an error, for its machines would write to disks of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="warraq-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_lock = threading.Lock()
_writers: dict = {"n": 0, "before": None}
#: (application, path) of the tables that are still there.
_written: set[tuple[str, str]] = set()


#: Of each thread, the paths made inside its open calls of ``settled``.
_scopes = threading.local()


class _dropping_shuffles:
    """Turns the setting on while any thread writes a table; the last one to end puts back what was set."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        with _lock:
            if not _writers["n"]:
                _writers["before"] = self.spark.conf.get(_CLEANUP)
                self.spark.conf.set(_CLEANUP, "true")
            _writers["n"] += 1

    def __exit__(self, *_) -> None:
        with _lock:
            _writers["n"] -= 1
            if not _writers["n"]:
                self.spark.conf.set(_CLEANUP, _writers["before"])


def new_path(spark: SparkSession, name: str = "table") -> str:
    """A path of its own in the shared folder, which ``release`` deletes."""
    path = f"{shared_dir(spark).rstrip('/')}/warraq-{name}-{uuid.uuid4().hex}"
    for paths in getattr(_scopes, "open", []):
        paths.append(path)
    _written.add((spark.sparkContext.applicationId, path))
    return path


def materialize(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: lineage ends there, and a
    lost executor costs a re-read, not a recomputation. The table stays until ``discard`` or ``release``."""
    spark = df.sparkSession
    path = new_path(spark)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    with _dropping_shuffles(spark):
        writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._warraq_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _written.discard((spark.sparkContext.applicationId, path))


def discard(df: DataFrame) -> None:
    """Deletes what ``materialize`` wrote, once nothing reads it any more."""
    path = getattr(df, "_warraq_path", None)
    if path:
        _delete(df.sparkSession, path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives as a written table, without the tables that this thread wrote for it meanwhile."""
    paths: list[str] = []
    _scopes.open = [*getattr(_scopes, "open", []), paths]
    try:
        out = materialize(make())
    finally:
        _scopes.open = _scopes.open[:-1]
    for path in paths:
        if path != out._warraq_path:
            _delete(spark, path)
    return out


def keep(*tables: DataFrame) -> None:
    """Takes written tables out of the open calls of ``settled``, whose end would delete them."""
    paths = {getattr(t, "_warraq_path", None) for t in tables}
    for open_paths in getattr(_scopes, "open", []):
        open_paths[:] = [p for p in open_paths if p not in paths]


def release(spark: SparkSession) -> int:
    """Deletes all tables this application has left in the shared folder, and says how many. For the time
    when every result that reads them has been written; the end of the program calls it, too."""
    mine = [path for application, path in list(_written) if application == spark.sparkContext.applicationId]
    for path in mine:
        _delete(spark, path)
    return len(mine)


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        try:
            release(spark)
        except Exception:  # noqa: BLE001  the JVM may be gone already, and the folder with it
            pass


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """``df`` as a written table with ``__place``: each row's place, from 0, in the order of these columns.

    Rows are dealt by ranges of the whole order and sorted where they land, so a value that many rows share
    is split by the columns after it; a place is the row's number in its range plus the rows in the ranges
    before, of which there are no more than shuffle partitions."""
    number = 1 << 33
    laid = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.floor(F.col("__at") / number).cast("int")
    sizes = laid.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    out = laid.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn("__place", F.col("__before") + F.col("__at") % number)
    return out.drop("__part", "__before", "__at")
