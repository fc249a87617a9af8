"""Places over ranges against a plain sort."""

import random

import pytest
from pyspark.sql import functions as F

from cohortmill.operators import order, rank


def brute(rows):
    out = []
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is None, r[2] or 0, r[1]))
        keys = [r[2] for r in mine]
        out += [(*r, i + 1, keys.index(r[2]) + 1, keys.count(r[2]), len(mine)) for i, r in enumerate(mine)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("ranges", [None, 1, 3, 17])
def test_places_against_a_sort(spark, ranges):
    r = random.Random(7)
    rows = [(f"g{i % 3}", f"t{i:04d}", r.choice([1.0, 1.0, 2.5, float(r.randrange(40)), None])) for i in range(700)]
    rows += [("one", "only", 5.0), ("tie", "a", 1.0), ("tie", "b", 1.0), ("nulls", "x", None), ("nulls", "y", None), (None, "z", 1.0), (None, "w", 0.5)]
    rows += [("hot", f"h{i:04d}", 7.0) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, ticker string, value double").repartition(5)
    got = order.numbered(df, ["g"], F.col("value"), "ticker", ranges)
    assert got.columns == ["g", "ticker", "value", *order.ADDED]
    assert sorted((tuple(x) for x in got.collect()), key=repr) == brute(rows)


def test_ties_cross_ranges(spark):
    """A tie of all rows stands in several ranges, and still has one place and one count."""
    df = spark.range(1000).select(F.lit("g").alias("g"), F.format_string("t%04d", "id").alias("ticker"), F.lit(3.0).alias("value"))
    t = order.numbered(df, ["g"], F.col("value"), "ticker", 8)
    assert t.select("first", "same", "n").distinct().collect() == [(1, 1000, 1000)]
    assert [x.seq for x in t.orderBy("ticker").collect()] == list(range(1, 1001))
    plan = t._jdf.queryExecution().toString()
    assert "Window" in plan and "__range" in plan


def test_empty_and_no_keys(spark):
    empty = spark.createDataFrame([], "g string, ticker string, value double")
    assert order.numbered(empty, ["g"], F.col("value"), "ticker").count() == 0
    assert rank.terciles(spark.createDataFrame([("r", "A", None)], "run string, ticker string, mean double")).count() == 0
