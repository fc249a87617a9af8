"""As-of and range joins. The as-of forms are one union and one window by key: a single shuffle of the bars, whatever the number of dates. Only
``up_to``, which returns every pair, is a nested loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def backward(left: DataFrame, right: DataFrame, key: str, when: str, stamp: str, value: str, lag_days: int = 0) -> DataFrame:
    """Rows of ``left`` with the newest non-null ``value`` of ``right`` whose stamp plus the lag is not after the row's date."""
    r = right.where(F.col(value).isNotNull()).groupBy(key, F.date_add(F.col(stamp).cast("date"), lag_days).alias("__at")).agg(F.max_by(value, stamp).alias(value), F.max(stamp).alias(stamp))
    l_ = left.withColumn("__row", F.struct(*left.columns)).select(key, F.col(when).cast("date").alias("__at"), "__row", F.lit(1).alias("__side"))
    kind = dict(right.dtypes)
    both = l_.withColumns({value: F.lit(None).cast(kind[value]), stamp: F.lit(None).cast(kind[stamp])}).unionByName(r.withColumns({"__row": F.lit(None).cast(l_.schema["__row"].dataType), "__side": F.lit(0)}))
    w = W.partitionBy(key).orderBy("__at", "__side").rowsBetween(W.unboundedPreceding, 0)
    filled = both.withColumns({value: F.last(value, ignorenulls=True).over(w), stamp: F.last(stamp, ignorenulls=True).over(w)}).where("__side = 1")
    return filled.select("__row.*", stamp, value)


def forward_return(bars: DataFrame, starts: DataFrame, max_stale_days: int = 7) -> DataFrame:
    """starts: (ticker, start, want_end). First bar from the start on, last bar up to the end; UNRESOLVED where the name's last bar is older than allowed."""
    bar = F.struct("day", "close")
    s = starts.select("ticker", "start", "want_end").distinct()
    # One window of a name's bars and asked dates: the next bar seen from a start, the last one seen from an end, and the name's last.
    ends = [("start", F.col("start")), ("end", F.col("want_end"))]
    asked = s.select("ticker", F.explode(F.array(*[F.struct(at.alias("__at"), F.lit(2 * i).alias("__side"), F.struct("start", "want_end", F.lit(kind).alias("kind")).alias("__row")) for i, (kind, at) in enumerate(ends)])).alias("x")).select("ticker", "x.*")
    own = bars.where("close > 0").select("ticker", F.col("day").alias("__at"), F.lit(1).alias("__side"), bar.alias("bar"))
    both = asked.unionByName(own, allowMissingColumns=True)
    # What lies ahead is what came before in the opposite order: a frame that ends behind the last row would be read anew for each row.
    by, sofar = W.partitionBy("ticker"), (W.unboundedPreceding, 0)
    ahead, behind = (by.orderBy(F.desc("__at"), F.desc("__side")).rowsBetween(*sofar), by.orderBy("__at", "__side").rowsBetween(*sofar))
    seen = both.withColumns({"last_day": F.max("bar.day").over(by), "before": F.last("bar", ignorenulls=True).over(behind)}).withColumn("after", F.last("bar", ignorenulls=True).over(ahead)).where("__row is not null")
    of = lambda kind, c: F.max(F.when(F.col("__row.kind") == kind, F.col(c)))
    a = seen.groupBy("ticker", F.col("__row.start").alias("start"), F.col("__row.want_end").alias("want_end")).agg(of("start", "after").alias("first"), of("end", "before").alias("final"), F.max("last_day").alias("last_day"))
    # The last bar up to the end counts only if it is not before the first one.
    a = a.withColumn("p0", F.col("first.close")).withColumn("p1", F.when(F.col("final.day") >= F.col("first.day"), F.col("final.close")))
    stale = F.col("last_day").isNull() | (F.date_diff("want_end", "last_day") > max_stale_days)
    ok = ~stale & F.col("p0").isNotNull() & F.col("p1").isNotNull()
    return a.select("ticker", "start", "want_end", F.when(ok, "OK").otherwise("UNRESOLVED").alias("status"), F.when(ok, F.col("p1") / F.col("p0") - 1).alias("ret"))


def up_to(dates: DataFrame, bars: DataFrame) -> DataFrame:
    """A range join: each date with all bars up to it, as many rows as there are such pairs. ``dates`` is a schedule, broadcast: one small row for each date."""
    return bars.join(F.broadcast(dates), F.col("day") <= F.col("date"))


def at_dates(dates: DataFrame, bars: DataFrame, value: str) -> DataFrame:
    """(date) x (ticker, day, value): date, ticker, value of the last bar of each name up to each date. A name without one by then has no row. The bars are read once: each name's
    first one brings the dates, a schedule, into the window of its bars."""
    sched = dates.agg(F.collect_set("date").alias("__dates"))
    own = bars.where(F.col(value).isNotNull()).select("ticker", F.col("day").cast("date").alias("__at"), "day", F.col(value).alias("__value"))
    by = W.partitionBy("ticker")
    own = own.withColumn("__no", F.row_number().over(by.orderBy("day"))).crossJoin(F.broadcast(sched))
    bar = F.struct(F.col("__at"), F.lit(0).alias("__side"), F.col("__no"), F.col("__value"))
    asked = F.transform("__dates", lambda d: F.struct(d.alias("__at"), F.lit(1).alias("__side"), F.lit(0).alias("__no"), F.lit(None).cast(own.schema["__value"].dataType).alias("__value")))
    both = own.select("ticker", F.explode(F.when(F.col("__no") == 1, F.concat(F.array(bar), asked)).otherwise(F.array(bar))).alias("x")).select("ticker", "x.*")
    seen = both.withColumn("__value", F.last("__value", ignorenulls=True).over(by.orderBy("__at", "__side", "__no").rowsBetween(W.unboundedPreceding, 0)))
    return seen.where("__side = 1 and __value is not null").select(F.col("__at").alias("date"), "ticker", F.col("__value").alias(value))


def close_on_or_before(dates: DataFrame, bars: DataFrame) -> DataFrame:
    """(date) x (ticker, day, close): the last close of each name up to each date."""
    return at_dates(dates, bars, "close")
