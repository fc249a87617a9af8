"""Places in a group's order, for groups of any size.

Rows are range-partitioned by group, key and tie-break, as Spark cuts them, and written with the number of their range; so no task holds more than a range, however large a
group or a tie is. A range's places come from windows within it, and the counts of the ranges before it, a few rows for each group. Only keys that go on in the next range need
their counts from several: they stand at the ends of ranges, and are joined from a table of these ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.catalog import settled

ADDED = ("seq", "first", "same", "n")


def numbered(df: DataFrame, by: list[str], key: Column, tie: str, ranges: int | None = None) -> DataFrame:
    """The rows of ``df`` with seq, their place from 1 in ascending order of ``key`` (nulls last) and ``tie`` within ``by``; first, the place of the first of equal keys; same, how many
    are equal; n, the rows of the group. (first + (same - 1) / 2 is the average rank.) A null tie-break comes first. ``ranges``: as many as the shuffle has, if not given."""
    columns = df.columns
    order = [*[F.col(c) for c in by], F.col("__key").asc_nulls_last(), F.col(tie)]
    cut = df.withColumn("__key", key)
    cut = cut.repartitionByRange(*([ranges] if ranges else []), *order)
    t = settled(cut.withColumn("__range", F.spark_partition_id()))
    part = [*by, "__range"]
    inside = W.partitionBy(*part)
    t = t.withColumn("__at", F.row_number().over(inside.orderBy(F.col("__key").asc_nulls_last(), tie)))
    equal = W.partitionBy(*part, "__key")
    t = t.withColumns({"__first": F.min("__at").over(equal), "__same": F.count(F.lit(1)).over(equal)})
    # One row for each group and range: how many rows, and its first and last key with their counts.
    end = F.struct("__key", "__same", "__first")
    ends = t.groupBy(*part).agg(F.count(F.lit(1)).alias("__rows"), F.min_by(end, "__at").alias("__low"), F.max_by(end, "__at").alias("__high"))
    up = W.partitionBy(*by).orderBy("__range")
    ends = ends.withColumns({"__before": F.coalesce(F.sum("__rows").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("__rows").over(W.partitionBy(*by))})
    ends = settled(ends)
    low, high = F.col("__low"), F.col("__high")
    one = low["__first"] == high["__first"]
    edge = ends.select(*by, "__range", "__before", F.explode(F.when(one, F.array(low)).otherwise(F.array(low, high))).alias("x"))
    edge = edge.groupBy(*by, F.col("x.__key").alias("__key")).agg(F.count(F.lit(1)).alias("k"), F.min(F.col("__before") + F.col("x.__first")).alias("__x_first"), F.sum("x.__same").alias("__x_same")).where("k > 1").drop("k")
    j = t.join(ends.select(*[F.col(c).alias(f"__e_{c}") for c in part], "__before", "n"), [F.col(c).eqNullSafe(F.col(f"__e_{c}")) for c in part])
    edge = edge.select(*[F.col(c).alias(f"__x_{c}") for c in (*by, "__key")], "__x_first", "__x_same")
    j = j.join(edge, [F.col(c).eqNullSafe(F.col(f"__x_{c}")) for c in (*by, "__key")], "left")
    before = F.col("__before")
    return j.select(*columns, (before + F.col("__at")).cast("int").alias("seq"), F.coalesce("__x_first", before + F.col("__first")).cast("int").alias("first"), F.coalesce("__x_same", F.col("__same")).alias("same"), "n")
