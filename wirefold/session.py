"""Session settings and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

def build_session(app: str = "wirefold", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join handling and a UTC clock; `conf` keys use `_` for `.`."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    for k, v in base.items():
        b = b.config(k, v)
    for k, v in conf.items():
        b = b.config(k.replace("_", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where the session names none, local mode takes a temporary one and a cluster is
    refused: its executors would write to folders that the others do not see."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    active = sc._jsc.sc().getCheckpointDir()
    if active.isDefined():
        return configured or active.get()
    if not configured and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = configured or tempfile.mkdtemp(prefix="wirefold-ckpt-")
    sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table that a job writes and reads back."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, and later branches all see one result."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
