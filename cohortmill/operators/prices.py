"""Price operators: one window per name, newest bar first, then one aggregation over the same partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Trading days of a year; days of the momentum windows; of the high.
YEAR, HALF = 252, 126


def _guard(name: Column, ok: Column) -> Column:
    return F.when(ok, name)


def technical(bars: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key, day, close) -> one row for each key: n, last_close, sma_50, sma_200, pct_off_high, volatility, return_12m, return_6m, notes."""
    key = key or ["ticker"]
    w = W.partitionBy(*key).orderBy(F.desc("day"))
    b = bars.where("close is not null").withColumn("rn", F.row_number().over(w)).withColumn("log_return", F.ln(F.col("close") / F.lead("close").over(w)))
    close = F.col("close")
    of = lambda i: F.max(F.when(F.col("rn") == i, close))
    a = b.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.min("close").alias("low"), of(1).alias("last_close"), F.avg(F.when(F.col("rn") <= 50, close)).alias("a50"), F.avg(F.when(F.col("rn") <= 200, close)).alias("a200"),
        F.max(F.when(F.col("rn") <= YEAR, close)).alias("high"), F.stddev_samp("log_return").alias("sd"), of(YEAR + 1).alias("c12"), of(HALF + 1).alias("c6"),
    )
    last = F.col("last_close")
    cols = {
        "sma_50": _guard(F.col("a50"), F.col("n") >= 50), "sma_200": _guard(F.col("a200"), F.col("n") >= 200), "pct_off_high": _guard(last / F.col("high") - 1, F.col("high") > 0),
        "volatility": _guard(F.col("sd") * F.sqrt(F.lit(float(YEAR))), (F.col("low") > 0) & (F.col("n") >= 3)), "return_12m": _guard(last / F.col("c12") - 1, F.col("c12") > 0), "return_6m": _guard(last / F.col("c6") - 1, F.col("c6") > 0),
    }
    out = a.select(*key, "n", "last_close", *[c.alias(k) for k, c in cols.items()])
    return out.withColumn("notes", F.array_compact(F.array(*[F.when(F.col(k).isNull(), f"{k}: not enough usable prices") for k in cols])))


def month_end_closes(bars: DataFrame) -> DataFrame:
    """The last positive close of each month: ticker, month, day, close."""
    return bars.where("close > 0").groupBy("ticker", F.to_date(F.trunc("day", "MM")).alias("month")).agg(F.max("day").alias("day"), F.max_by("close", "day").alias("close"))


def running_mean(bars: DataFrame, n: int) -> DataFrame:
    """Mean of the last n closes at each bar; null before there are n."""
    w = W.partitionBy("ticker").orderBy("day").rowsBetween(-(n - 1), 0)
    return bars.select("ticker", "day", "close", F.when(F.count("close").over(w) == n, F.avg("close").over(w)).alias("mean"))


def max_drawdown(curve: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The deepest fall below the running maximum, the start of 1 included."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return curve.withColumn("peak", F.greatest(F.lit(1.0), F.max(value).over(w))).groupBy(key).agg(F.least(F.lit(0.0), F.min(F.col(value) / F.col("peak") - 1)).alias("max_drawdown"))
