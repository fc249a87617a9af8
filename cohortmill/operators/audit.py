"""Auditing cited figures against the ledger of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compare_cited


def resolved(output: Column, path: Column) -> Column:
    """The number at a dotted, indexed path ('a.b[0].c') of a JSON text; a last index may be negative; null where nothing is there."""
    negative = F.regexp_extract(path, r"\[(-[0-9]+)\]$", 1)
    stem = F.regexp_replace(path, r"\[-[0-9]+\]$", "")
    plain = F.call_function("get_json_object", output, F.concat(F.lit("$."), path))
    array = F.from_json(F.call_function("get_json_object", output, F.concat(F.lit("$."), stem)), "array<string>")
    last = F.try_element_at(array, F.when(negative != "", negative).try_cast("int"))
    return F.when(negative != "", last).otherwise(plain).try_cast("double")


def audit(figures: DataFrame, calls: DataFrame) -> DataFrame:
    """(figure_id, call_id, field_path, value) against (call_id, tool_name, output): figure_id, actual, state. Unknown calls are UNVERIFIABLE."""
    j = figures.join(calls, "call_id", "left").withColumn("actual", resolved(F.col("output"), F.col("field_path")))
    return j.select("figure_id", "call_id", "tool_name", F.col("value").alias("cited"), "actual", compare_cited(F.col("value"), F.col("actual")).alias("state"))


def known_calls(figures: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(figures with a known call, the rest)."""
    ids = calls.select("call_id").distinct()
    return figures.join(ids, "call_id", "left_semi"), figures.join(ids, "call_id", "left_anti")
