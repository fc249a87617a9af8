"""Results written by date and source, with an index that is counted while they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_with_index(rows: DataFrame, root: str, sources: list[str], run_date: str) -> DataFrame:
    """rows: (source, status, ...) of a run, each source a partition below the run's date. Only partitions that the rows have are replaced, so a run of some sources leaves the others' as they are.

    The index: run_date, source, rows, skipped, path, for each of ``sources``; its counts come from the pass that writes. Rows of a source that is not listed are an error before anything is
    written to it."""
    spark = rows.sparkSession
    seen = Observation()
    known = F.col("source").isin(*sources)
    checked = rows.withColumn("source", F.when(known, F.col("source")).otherwise(F.raise_error(F.concat(F.lit("source is not listed: "), F.coalesce("source", F.lit("null"))))))
    counts = [F.count_if((F.col("source") == s) & (F.col("status") == "skipped") if skipped else F.col("source") == s).alias(f"{i}_{int(skipped)}") for i, s in enumerate(sources) for skipped in (False, True)]
    out = checked.withColumn("run_date", F.lit(run_date)).observe(seen, *counts)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date", "source").parquet(f"{root}/verdicts")
    got = seen.get
    index = spark.createDataFrame([(run_date, s, got[f"{i}_0"] - got[f"{i}_1"], got[f"{i}_1"], f"verdicts/run_date={run_date}/source={s}") for i, s in enumerate(sources)], "run_date string, source string, rows long, skipped long, path string")
    index.coalesce(1).write.mode("overwrite").json(f"{root}/index/run_date={run_date}")
    return index


def latest(spark, root: str) -> DataFrame:
    """The index of the newest run."""
    i = spark.read.schema("source string, rows long, skipped long, path string, run_date string").json(f"{root}/index")
    return i.join(i.agg(F.max("run_date").alias("run_date")), "run_date")
