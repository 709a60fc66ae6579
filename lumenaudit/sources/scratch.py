"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names: spark.checkpoint.dir, else the context's own checkpoint folder. A temporary one serves local masters only (tests)."""
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="spark-lumenaudit-", dir="/tmp")
    return _own


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/lumenaudit/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors, and gives the planner real sizes."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*dfs: DataFrame) -> None:
    """Delete tables made by materialize() that no later plan reads."""
    for df in dfs:
        path = getattr(df, "_scratch", None)
        if path:
            delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
