"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing a table under `spark.checkpoint.dir` and reading it back, so a
lost executor costs a re-read, not a recomputation, and no block lives on one machine only.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`.

    Where it is unset a session on one machine gets a temporary folder; a cluster, whose machines
    would not share that folder, gets an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="skerry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/skerry-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet in the shared folder and read back with the same columns, and its folder."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    return written(df, name)[0]


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffles of plans that are gone: it does so when they are collected as garbage."""
    gc.collect()
    spark._jvm.System.gc()
