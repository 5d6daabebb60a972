"""A database for a session's own tables, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from .catalog import Database

_HELD: dict[str, Database] = {}


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


def database(spark: SparkSession) -> Database:
    app = spark.sparkContext.applicationId
    if app not in _HELD:
        _HELD[app] = Database(spark, f"{shared_dir(spark)}/skerry-db-{uuid.uuid4().hex}")
    return _HELD[app]


def imported(spark: SparkSession, sf_dir: str, name: str, like: str | None = None, make=None):
    """A table with the rows of a Parquet table, written once a session; make(frame) may shape it (under the name `like`)."""
    db = database(spark)
    key = f"{like or name}-{abs(hash(sf_dir)):x}"
    if not db.store.exists(f"{key}.tbl"):
        frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        cores = spark.sparkContext.defaultParallelism
        if len(frame.inputFiles()) < cores:  # a few small files would leave cores idle ever after
            frame = frame.repartition(cores)
        db.create_table(key, make(frame) if make else frame)
    return db.open_table(key)


def cloned(table):
    """A shallow clone to change freely: it shares the table's files."""
    db = database(table.spark)
    return db.clone_table(f"{table.name}-{uuid.uuid4().hex}", table)
