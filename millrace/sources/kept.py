"""Tables kept in the folder that driver and executors share: lineage ends there, and a lost executor loses nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder in local mode, and an error on a cluster, whose executors would not see each other's files."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir", None) or getattr(context, "_millrace_dir", None)
    if at is None:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = context._millrace_dir = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return at.rstrip("/")


def _held(spark: SparkSession) -> list[str]:
    context = spark.sparkContext
    if not hasattr(context, "_millrace_kept"):
        context._millrace_kept = []
    return context._millrace_kept


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written as a Parquet table of the shared folder and read again. It stays until dropped() or release()."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._kept_at = at
    _held(spark).append(at)
    return out


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(*tables: DataFrame) -> None:
    """Delete kept tables of which no later result is made."""
    for df in tables:
        at = getattr(df, "_kept_at", None)
        if at in _held(df.sparkSession):
            _delete(df.sparkSession, at)
            _held(df.sparkSession).remove(at)


def release(spark: SparkSession) -> None:
    """Delete every table kept so far; results that are not yet written and rest on them are lost."""
    while _held(spark):
        _delete(spark, _held(spark).pop())
