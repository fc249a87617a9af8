"""Set-like operators: snapshot differences, containment, self joins, memberships."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def difference(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer: key, change (appeared, vanished, moved, unchanged), before, after."""
    j = old.select(key, F.col(value).alias("before"), F.lit(True).alias("in_old")).join(new.select(key, F.col(value).alias("after"), F.lit(True).alias("in_new")), key, "full_outer")
    change = F.when(F.col("in_old").isNull(), "appeared").when(F.col("in_new").isNull(), "vanished").when(F.col("before").eqNullSafe(F.col("after")), "unchanged").otherwise("moved")
    return j.select(key, change.alias("change"), "before", "after")


def churn(diff: DataFrame) -> DataFrame:
    """Counts of each change, and the share that is not unchanged."""
    return diff.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("appeared", "vanished", "moved", "unchanged")], F.avg((F.col("change") != "unchanged").cast("double")).alias("churn"))


def also_found_by(rows: DataFrame, key: str, source: str) -> DataFrame:
    """For each (source, key): the other sources that have the key, in order."""
    sources = rows.groupBy(key).agg(F.array_sort(F.collect_set(source)).alias("all"))
    return rows.select(source, key).distinct().join(sources, key).select(source, key, F.array_except("all", F.array(source)).alias("also"))


def covering(members: DataFrame, wanted: DataFrame, group: str, item: str) -> DataFrame:
    """Groups that contain every wanted item (relational division): counts, no arrays of members."""
    w = wanted.select(item).distinct()
    n = w.count()
    return members.join(w, item, "left_semi").groupBy(group).agg(F.count_distinct(item).alias("k")).where(F.col("k") == n).select(group)


def peers(cohort: DataFrame, ticker: str) -> DataFrame:
    """Every other row of a cohort."""
    return cohort.where(F.col("ticker") != ticker)


def integrity(outcomes: DataFrame, by: list[str], listed: int = 5) -> DataFrame:
    """Per group the number of names and the first few of them."""
    at = F.row_number().over(W.partitionBy(*by).orderBy("ticker"))
    # Of each group only its first names leave a task.
    first = outcomes.where("ticker is not null").select(*by, "ticker").withColumn("__at", at).where(F.col("__at") <= listed)
    names = first.groupBy(*[F.col(b).alias(f"__{b}") for b in by]).agg(F.array_sort(F.collect_list("ticker")).alias("names"))
    sizes = outcomes.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    same = [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by]
    return sizes.join(names, same, "left").select(*by, "n", F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def field_coverage(df: DataFrame, fields: list[str], threshold: float = 0.8, by: list[str] | None = None) -> DataFrame:
    """field, present, total, share, decision: IN from ``threshold`` on. With ``by``, for each of its groups."""
    by = by or []
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).isNotNull().alias("present")) for f in fields])
    a = df.select(*by, F.explode(cells).alias("x")).groupBy(*by, "x.field").agg(F.count_if(F.col("x.present")).alias("present"), F.count(F.lit(1)).alias("total"))
    return a.select(*by, "field", "present", "total", (F.col("present") / F.col("total")).alias("share"), F.when(F.col("present") / F.col("total") >= threshold, "IN").otherwise("OUT").alias("decision"))


def by_priority(rows: DataFrame, sources: DataFrame, today) -> DataFrame:
    """rows: (source, symbol, added date, note); sources: (source, priority from 0, window_days or null). One row for each symbol: symbol, source, added, note, found_by.

    Rows of a source older than its window are not seen; undated rows and sources without a window always are, and rows of sources that are not listed never. The first source by priority gives the row, its
    oldest one, ties by note; ``found_by`` are all sources that have the symbol, in that order. Minima and small sets only: no group is gathered, nothing is ordered as a whole."""
    seen = rows.join(F.broadcast(sources), "source")  # a few rows
    seen = seen.where(F.col("window_days").isNull() | F.col("added").isNull() | (F.date_diff(today, F.col("added")) <= F.col("window_days")))
    first = F.min(F.struct("priority", F.col("added").isNull().alias("undated"), "added", "note", "source"))
    a = seen.groupBy("symbol").agg(first.alias("x"), F.array_sort(F.collect_set(F.struct("priority", "source"))).alias("by"))
    return a.select("symbol", "x.source", "x.added", "x.note", F.transform("by", lambda b: b["source"]).alias("found_by"))


def found_elsewhere(merged: DataFrame) -> DataFrame:
    """Rows of ``by_priority`` -> source, symbol, others: each source's names, with the other sources that found them too."""
    e = merged.select("symbol", F.explode("found_by").alias("source"), "found_by")
    return e.select("source", "symbol", F.array_sort(F.array_except("found_by", F.array("source"))).alias("others"))
