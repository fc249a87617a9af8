"""Snapshots and their forward returns: buckets of own verdicts and of the street's terciles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.asof import forward_return
from ..operators.rank import terciles

BUCKETS = ("BUY", "HOLD", "SELL", "EXCLUDED")
ORDERED = ("BUY", "HOLD", "SELL")


def bucket(verdict: Column) -> Column:
    return F.when(F.upper(verdict).startswith("EXCLUDED"), "EXCLUDED").otherwise(F.upper(verdict))


def snapshot_rows(rows: DataFrame, consensus: DataFrame, snapshot_date: Column, strategy: str) -> DataFrame:
    """Ranked, excluded and unrateable rows with the street's view."""
    v = F.when(F.col("status") == "ranked", F.upper("verdict")).when(F.col("status") == "excluded", F.concat(F.lit("EXCLUDED: "), "reason")).otherwise("UNRATEABLE")
    return rows.join(consensus, "ticker", "left").select(snapshot_date.alias("snapshot_date"), F.lit(strategy).alias("strategy"), "ticker", v.alias("verdict"), F.col("combined").alias("combined_rank"), F.col("mean").alias("street_mean"), F.col("n_analysts").cast("int").alias("n_analysts"))


def bucket_stats(returns: DataFrame, by: str, key: str = "strategy", buckets: tuple[str, ...] = BUCKETS) -> DataFrame:
    """(key, by, ret) -> key, bucket, n, mean, median, excess over the mean of all returns; empty buckets stay with nulls."""
    all_ = returns.where("ret is not null").groupBy(key).agg(F.avg("ret").alias("universe"))
    a = returns.where("ret is not null").groupBy(key, F.col(by).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean"), F.median("ret").alias("median"))
    frame = returns.select(key).distinct().select(key, F.explode(F.array(*map(F.lit, buckets))).alias("bucket"))
    out = frame.join(a, [key, "bucket"], "left").join(all_, key, "left")
    return out.select(key, "bucket", F.coalesce("n", F.lit(0)).alias("n"), "mean", "median", (F.col("mean") - F.col("universe")).alias("excess"))


def ordering(stats: DataFrame, key: str = "strategy", buckets: tuple[str, ...] = ORDERED) -> DataFrame:
    """Whether means fall strictly from bucket to bucket; null where one is empty."""
    m = [F.max(F.when(F.col("bucket") == b, F.col("mean"))) for b in buckets]
    return stats.groupBy(key).agg((m[0] > m[1]).alias("a"), (m[1] > m[2]).alias("b")).select(key, F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.col("a") & F.col("b")).alias("ordered"))


def score(snapshots: DataFrame, bars: DataFrame, months: int, today: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with returns, bucket statistics): the horizon ends months later, or today if that is earlier (partial)."""
    s = snapshots.withColumn("want_end", F.least(F.add_months("snapshot_date", months), today)).withColumn("partial", F.add_months("snapshot_date", months) > today)
    starts = s.select("ticker", F.col("snapshot_date").alias("start"), "want_end").distinct()
    r = forward_return(bars, starts).select("ticker", F.col("start").alias("snapshot_date"), "want_end", "status", "ret")
    street = terciles(s.select(F.concat_ws("|", "strategy", "snapshot_date").alias("run"), "strategy", "snapshot_date", "ticker", F.col("street_mean").alias("mean"))).select("strategy", "snapshot_date", "ticker", F.col("bucket").alias("street"))
    rows = s.join(r, ["ticker", "snapshot_date", "want_end"], "left").join(street, ["strategy", "snapshot_date", "ticker"], "left").withColumn("own", bucket(F.col("verdict")))
    return rows, bucket_stats(rows, "own")
