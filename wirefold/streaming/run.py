"""Running streams to completion and following their progress."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wirefold.session import scratch_path

PROVIDER, PARTITIONS = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Settings for the queries started inside. A query takes them along when it starts; the session keeps its own."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def state_settings(spark: SparkSession) -> dict[str, str]:
    """State on local disk with changelogs in the checkpoint folder, which stateful processors need, and no more state
    partitions than twice the cores: each costs a store, and a Python worker, in every micro-batch of a drain."""
    most = 2 * spark.sparkContext.defaultParallelism
    return {PROVIDER: ROCKSDB, PARTITIONS: str(min(int(spark.conf.get(PARTITIONS)), most))}


class Progress:
    """One line per micro-batch: rows read, rows that the engine dropped as too late, rows held in state. Lines are
    gathered while the query runs, since the query itself keeps the last ones only."""

    def __init__(self, query: StreamingQuery):
        self.query, self.lines = query, {}

    def gather(self) -> None:
        for p in self.query.recentProgress:
            ops = p["stateOperators"]
            line = {"batch": p["batchId"], "rows": int(p["numInputRows"]),
                    "late": sum(int(s["numRowsDroppedByWatermark"]) for s in ops),
                    "state": sum(int(s["numRowsTotal"]) for s in ops)}
            if line["batch"] not in self.lines or line["rows"] >= self.lines[line["batch"]]["rows"]:
                self.lines[line["batch"]] = line

    def follow(self, every_s: float = 1.0) -> None:
        """Until the query ends."""
        while not self.query.awaitTermination(every_s):
            self.gather()
        self.gather()

    def counters(self) -> dict[str, int]:
        lines = [self.lines[b] for b in sorted(self.lines)]
        return {"input_rows": sum(p["rows"] for p in lines), "late_rows": sum(p["late"] for p in lines),
                "state_rows": lines[-1]["state"] if lines else 0, "batches": len(lines)}


def drain(df: DataFrame, name: str, by: list[str] | None = None) -> tuple[DataFrame, Progress]:
    """Processes everything available now into a parquet table in the shared folder and returns the table."""
    return drain_to(df, scratch_path(df.sparkSession, name), by)


def drain_to(df: DataFrame, path: str, by: list[str] | None = None) -> tuple[DataFrame, Progress]:
    """As `drain`, with the table in `path`/data, partitioned by `by`, and the state in `path`/state."""
    spark = df.sparkSession
    w = df.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/state")
    with settings(spark, state_settings(spark)):
        q = (w.partitionBy(*by) if by else w).outputMode("append").trigger(availableNow=True).start()
    progress = Progress(q)
    progress.follow()
    return spark.read.schema(df.schema).parquet(f"{path}/data"), progress


def open_groups(spark: SparkSession, checkpoint: str, keys: list[str], values: list[str]) -> DataFrame:
    """The groups that a finished streaming aggregate has not put out, as their keys and running values in order."""
    s = spark.read.format("statestore").load(checkpoint).select("key", "value")
    # by place: two counts have one name in the state
    named = [F.col(side).cast(T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, s.schema[side].dataType.fields)]))
             .alias(side) for side, names in (("key", keys), ("value", values))]
    return s.select(*named).select("key.*", "value.*")
