"""Tables that are built once for a session and the state of a data folder, and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

_BUILT: dict[tuple, str] = {}
#: Where this is on, Spark drops a job's shuffle files as the job ends, not when the driver next collects garbage.
_DROPPED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where the session names none and runs on this machine alone."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="lipiflow-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def tasks_of(df: DataFrame) -> int:
    """Tasks to deal rows of df to: the session's shuffle partitions, or as many as df has input splits if that is more."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions(), 1)


def _write(df: DataFrame, path: str) -> None:
    """What df's job exchanged is on disk no longer than the job lasts: nothing but the written table is read again."""
    conf = df.sparkSession.conf
    before = conf.get(_DROPPED, "false")
    conf.set(_DROPPED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(_DROPPED, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and returns the table that reads it: lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/lipiflow/{name}-{uuid.uuid4().hex}"
    _write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_parts(rows: DataFrame, by: str, at_once: int) -> list[DataFrame]:
    """rows dealt by a column to as many parts as hold about `at_once` each: what the job of one exchanges is off the disk before the next."""
    n = max(1, -(-rows.count() // at_once))
    return [rows.where(F.pmod(F.xxhash64(by), F.lit(n)) == i) for i in range(n)]


def state_of(spark: SparkSession, folder: str) -> tuple:
    """Name, time of change, bytes and files of each table of a folder: two calls a table, however many files it has."""
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for s in fs.listStatus(top) if fs.exists(top) else []:
        size = fs.getContentSummary(s.getPath())
        found.append((s.getPath().getName(), s.getModificationTime(), size.getLength(), size.getFileCount()))
    return tuple(sorted(found))


def built_once(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table `name` of a data folder: written to the shared folder when it is first asked for, and again if it has gone or a table of the folder has changed.

    Expressions of the table are evaluated once for each of its rows; filters on them reach the scan of the stored table only.
    """
    key = (spark.sparkContext.applicationId, folder, name, state_of(spark, folder))
    if key in _BUILT:
        try:
            return spark.read.parquet(_BUILT[key])
        except AnalysisException:
            del _BUILT[key]
    path = f"{shared_dir(spark)}/lipiflow/{name}-{uuid.uuid4().hex}"
    _write(make(), path)
    _BUILT[key] = path
    return spark.read.parquet(path)
