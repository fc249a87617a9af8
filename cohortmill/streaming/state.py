"""State kept for each key of a feed: when it was first and last seen, how often, and whether it is gone."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Times in the state are microseconds.
SEEN = "first long, last long, n long"
MADE = "key string, first long, last long, n long, status string"
OUT = "key string, first timestamp, last timestamp, n long, status string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Sightings(StatefulProcessor):
    """Of each key the first and the last time it was seen. A timer goes off ``gap`` seconds after the last one: then the key is GONE, until it is seen again. Late rows within the watermark
    count like others; the state of a key stays."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", SEEN)

    def _due(self, last: int) -> int:
        return -(-last // 1000) + 1000 * self.gap

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        old = self.seen.get() if self.seen.exists() else None
        first, last, n = (old[0], old[1], old[2]) if old else (None, None, 0)
        for r in rows:
            first, last, n = (r.at if first is None else min(first, r.at)), (r.at if last is None else max(last, r.at)), n + 1
        if old:
            self.handle.deleteTimer(self._due(old[1]))
        self.handle.registerTimer(self._due(last))
        self.seen.update((first, last, n))
        yield Row(key=key[0], first=first, last=last, n=n, status="LIVE")

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        first, last, n = self.seen.get()
        yield Row(key=key[0], first=first, last=last, n=n, status="GONE")

    def close(self) -> None:
        pass


def sightings(stream: DataFrame, gap: int, late: str) -> DataFrame:
    """(key string, ts) -> a row of OUT for each key of each batch in which it was seen or went."""
    keyed = stream.select("key", "ts", F.unix_micros("ts").alias("at")).withWatermark("ts", late).groupBy("key")
    made = keyed.transformWithState(Sightings(gap), outputStructType=MADE, outputMode="Update", timeMode="EventTime")
    return made.select("key", F.timestamp_micros("first").alias("first"), F.timestamp_micros("last").alias("last"), "n", "status")


def run(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str, gap: int, late: str) -> None:
    """Takes up what is new of a feed. Each batch is a folder, which a batch that runs again replaces; a restart goes on from the checkpoint."""

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        sightings(stream, gap, late).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def current(spark: SparkSession, out: str) -> DataFrame:
    """The newest row of each key. In one batch a key that was seen is not gone."""
    rows = spark.read.schema(f"{OUT}, batch long").parquet(out)
    order = F.struct("batch", (F.col("status") == "GONE"))
    return rows.groupBy("key").agg(F.max_by(F.struct("first", "last", "n", "status"), order).alias("x")).select("key", "x.*")


def of_table(events: DataFrame, gap: int, until: Column) -> DataFrame:
    """The same of a table of all events, as of a time that the watermark has reached."""
    a = events.groupBy("key").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    return a.withColumn("status", F.when(F.col("last") + F.make_dt_interval(secs=F.lit(gap)) <= until, "GONE").otherwise("LIVE"))
