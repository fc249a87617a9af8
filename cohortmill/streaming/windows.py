"""Streaming forms: windowed counts of events, sessions, snapshot appends and differences. ``state`` keeps state for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sets import difference


def tumbling(events: DataFrame, size: str, late: str = "10 minutes") -> DataFrame:
    return _keyed(events, late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str, step: str, late: str = "10 minutes") -> DataFrame:
    return _keyed(events, late).groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    return _keyed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def _keyed(events: DataFrame, late: str) -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", late) if e.isStreaming else e


def run_available(spark: SparkSession, source: str, schema, build, out: str, checkpoint: str, mode: str = "append") -> None:
    """Reads what a folder holds, applies ``build`` and appends to a table; a rerun takes up only what is new."""
    append_available(build(spark.readStream.schema(schema).parquet(source)), out, checkpoint, mode)


def append_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Appends what a stream makes of all that is there now."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def diff_feed(stream: DataFrame, state_path: str, out_path: str, checkpoint: str, key: str, value: str) -> None:
    """Each batch of a feed is compared with the state before it; changes are appended and the batch becomes the state, under a new name for each batch."""
    spark = stream.sparkSession

    def step(batch: DataFrame, n: int) -> None:
        old = spark.read.parquet(f"{state_path}/{n - 1}") if n else batch.limit(0)
        difference(old, batch, key, value).withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out_path}/batch={n}")
        batch.write.mode("overwrite").parquet(f"{state_path}/{n}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
