"""Session helpers: shared folder, ANSI switch."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only in local mode, where one machine is all there is, and only if the session names no folder.
LOCAL_SHARED = "file:///tmp/checkpoints/nearbox"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = LOCAL_SHARED
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: later stages start there, also after an executor is lost."""
    spark = df.sparkSession
    path = new_shared_path(spark, name)
    df.write.option("compression", "snappy").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["written_to"] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove what written() wrote for these tables, once nothing reads them any more; other tables are left alone."""
    for df in tables:
        if path := df.__dict__.pop("written_to", None):
            jvm = df.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def bounded(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df marked for broadcast if it has at most so many rows, which is counted; else as it is, to be joined by shuffling."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def blocks(df: DataFrame, key: str, rows: int = 10_000) -> list[DataFrame]:
    """df in parts of about so many rows by the hash of key, for joins that can't go without a broadcast."""
    parts = max(1, -(-df.count() // rows))
    return [df] if parts == 1 else [df.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == k) for k in range(parts)]


@contextlib.contextmanager
def ansi_off(spark: SparkSession):
    """Expressions built inside wrap on overflow; the mode is captured when an expression is built."""
    key = "spark.sql.ansi.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)
