"""Three dividend streaks that must not be merged: medians of payments, calendar sums, sums with a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _yearly(dividends: DataFrame, agg) -> DataFrame:
    return dividends.where("amount is not null and ex_date is not null").groupBy("ticker", F.year("ex_date").alias("year")).agg(agg.alias("paid"))


def _streak(years: DataFrame) -> DataFrame:
    """Strict rises in a row up to the newest year of each name."""
    w = W.partitionBy("ticker").orderBy("year")
    y = years.withColumn("before", F.lag("paid").over(w))
    broke = F.max(F.when(F.col("before").isNull() | (F.col("paid") <= F.col("before")), F.col("year"))).over(W.partitionBy("ticker"))
    return y.withColumn("broke", broke).groupBy("ticker").agg(F.count(F.lit(1)).alias("years"), F.count_if(F.col("year") > F.col("broke")).cast("int").alias("streak"))


def median_streak(dividends: DataFrame) -> DataFrame:
    """Median payment of each year, the newest year dropped as open."""
    y = _yearly(dividends, F.median("amount"))
    open_year = F.max("year").over(W.partitionBy("ticker"))
    return _streak(y.withColumn("open", open_year).where("year < open").drop("open")).select("ticker", "streak")


def calendar_streak(dividends: DataFrame, min_years: int = 1) -> DataFrame:
    """Sum of each calendar year, the newest dropped; null where complete years less one are below ``min_years``."""
    y = _yearly(dividends, F.sum("amount"))
    open_year = F.max("year").over(W.partitionBy("ticker"))
    s = _streak(y.withColumn("open", open_year).where("year < open").drop("open"))
    return s.select("ticker", F.when(F.col("years") - 1 >= min_years, F.col("streak")).alias("streak"))


def tolerant_streak(yearly: DataFrame, as_of_year: int, tolerance: float = 0.005) -> DataFrame:
    """(ticker, year, paid) before ``as_of_year``: a flat year ends the streak but is no cut; last_cut is the newest year that fell; null below three years."""
    w = W.partitionBy("ticker").orderBy("year")
    y = yearly.where(F.col("year") < as_of_year).withColumn("before", F.lag("paid").over(w))
    cut = F.col("paid") < F.col("before") * (1 - tolerance)
    rose = F.col("paid") > F.col("before") * (1 + tolerance)
    y = y.withColumn("broke", F.max(F.when(F.col("before").isNull() | ~rose, F.col("year"))).over(W.partitionBy("ticker")))
    a = y.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("year") > F.col("broke")).cast("int").alias("s"), F.max(F.when(cut, F.col("year"))).alias("c"))
    return a.select("ticker", F.when(F.col("n") >= 3, F.col("s")).alias("streak"), F.when(F.col("n") >= 3, F.col("c")).alias("last_cut"))


#: Streaks by the shape of a source's dividends; an unknown shape raises KeyError.
STREAKS = {"per_payment": median_streak, "calendar_sum": calendar_streak}
