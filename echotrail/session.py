"""Session settings the jobs rely on, and the size checks in front of every broadcast."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest side that a job may ship to every task, in bytes of payload.
BROADCAST_BYTES = 64 * 1024 * 1024


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that tasks can import it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(home):  # already inside an archive otherwise
        archive = shutil.make_archive(
            os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "echotrail"), "zip", os.path.dirname(home), os.path.basename(home))
        context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what results depend on: UTC time, the package on executors, a folder for cutting lineage.

    The checkpoint folder is the one the cluster names in ``spark.checkpoint.dir``.
    Only in local mode, where one machine holds everything, a temporary folder may stand in for it.
    """
    ship_package(spark)
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    jvm_context = spark.sparkContext._jsc.sc()
    if jvm_context.getCheckpointDir().isEmpty():
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not configured and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder so that later reads see one fixed copy."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet beside the checkpoints and read that table.

    For the batches of a stateful stream, whose plan must not run twice.
    """
    spark = prepare(df.sparkSession)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.append(path)
    return spark.read.schema(df.schema).parquet(path)


# Tables that ``written`` has made and nobody has dropped yet, oldest first.
_TABLES: list[str] = []


def drop_written(spark: SparkSession, used_by: DataFrame | None = None) -> None:
    """Delete the tables that ``written`` has made so far, for callers whose results are stored elsewhere.

    Tables that ``used_by`` still reads stay, and stay known.
    """
    files = used_by.inputFiles() if used_by is not None and _TABLES else []
    _delete(spark, [t for t in _TABLES if not any(os.path.basename(t) in f for f in files)])


def _delete(spark: SparkSession, tables: list[str]) -> None:
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(table)
        path.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(path, True)
        _TABLES.remove(table)


def discard(table: DataFrame) -> None:
    """Delete a table that ``written`` has made, when all that was read from it is stored elsewhere."""
    files = table.inputFiles()
    _delete(table.sparkSession, [t for t in _TABLES if any(os.path.basename(t) in f for f in files)])


@contextmanager
def kept_aside(spark: SparkSession):
    """Tables that ``written`` makes inside are deleted at the end, as after each batch of a stream."""
    before = set(_TABLES)
    try:
        yield
    finally:
        _delete(spark, [t for t in _TABLES if t not in before])


@contextmanager
def shuffles_deleted(spark: SparkSession):
    """Shuffle files of the actions inside are deleted when each ends, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fits_broadcast(df: DataFrame, row_bytes: int, limit: int | None = None) -> bool:
    """True when ``df`` is proven to hold at most ``limit`` bytes at ``row_bytes`` per row.

    Counts no further than one row past the bound, so the check stays cheap.
    """
    bound = max(1, (BROADCAST_BYTES if limit is None else limit) // max(1, row_bytes))
    return df.select(F.lit(1)).limit(bound + 1).count() <= bound


def small_side(df: DataFrame, row_bytes: int, limit: int | None = None) -> DataFrame:
    """Hint a broadcast only when the size check passes; otherwise Spark picks a shuffle join."""
    return F.broadcast(df) if fits_broadcast(df, row_bytes, limit) else df


def hint(df: DataFrame, small: bool) -> DataFrame:
    """Broadcast hint for a side whose size a caller has already bounded by a checked table."""
    return F.broadcast(df) if small else df


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Give CPU-heavy row work a full set of tasks when a scan has fewer splits than cores.

    A file with one large row group cannot be split by the reader. Large inputs have more splits
    than cores and pass through unchanged. ``scan`` must be a plain scan, ``key`` unique per row.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, key) if scan.rdd.getNumPartitions() < cores else scan
