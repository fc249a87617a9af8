"""Reports as documents: one VARIANT for each run, in partitions of their tickers, read by paths.

A report keeps whatever fields it was written with; readers ask for paths and types, and what an older report lacks is null. Names of runs are UTC times that sort as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLUG = "yyyy-MM-dd'T'HH-mm-ss'Z'"
RECORD = ("ticker", "run_at", "strategy_id", "verdict", "confidence", "stances", "veto_triggers", "audit", "overrides")
# What a record keeps of an audit.
AUDIT = ("checked", "verified", "mismatched", "unverifiable")


def run_slug(run_at: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(run_at, F.current_timezone()), SLUG)


def save(reports: DataFrame, root: str) -> None:
    """(ticker, run_at timestamp, body JSON) appended. A body that is no JSON fails the write; a null one is stored as null."""
    out = reports.select(F.upper("ticker").alias("ticker"), run_slug(F.col("run_at")).alias("run"), "run_at", F.parse_json("body").alias("report"))
    out.repartition("ticker").sortWithinPartitions("ticker", "run").write.mode("append").partitionBy("ticker").parquet(f"{root}/reports")


def load(spark: SparkSession, root: str, ticker: str | None = None) -> DataFrame:
    """run, run_at, report, ticker: all reports, or those of one name, of which only its partition is read."""
    df = spark.read.schema("run string, run_at timestamp, report variant, ticker string").parquet(f"{root}/reports")
    return df if ticker is None else df.where(F.col("ticker") == ticker.upper())


def fields(reports: DataFrame, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """ticker, run and a column for each name: (path, type). A path that a report lacks, or a value of another type, is null."""
    return reports.select("ticker", "run", *[F.try_variant_get("report", path, kind).alias(name) for name, (path, kind) in paths.items()])


def triggers(flags: Column) -> Column:
    """The distinct triggers of an array of flags (struct with trigger), in the order in which they fired."""
    return F.array_distinct(F.transform(flags, lambda f: f["trigger"]))


def record(states: DataFrame) -> DataFrame:
    """The row that the history keeps of a finished run: (ticker, run_at, strategy_id, verdict, confidence, opinions array<struct<agent, stance>>, flags array<struct<trigger, note>>, audit
    map<string, int>, overrides map<string, string>) -> RECORD. Notes stay behind; of an audit its counts, null where there was none; the last opinion of an agent counts."""
    last = F.aggregate("opinions", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda acc, o: F.map_concat(F.map_filter(acc, lambda k, v: k != o["agent"]), F.create_map(o["agent"], o["stance"])))
    kept = F.map_filter("audit", lambda k, v: k.isin(*AUDIT))
    return states.select(
        F.upper("ticker").alias("ticker"), "run_at", "strategy_id", "verdict", "confidence", F.coalesce(last, F.create_map().cast("map<string,string>")).alias("stances"),
        F.coalesce(triggers(F.col("flags")), F.array().cast("array<string>")).alias("veto_triggers"), F.when(F.size(F.map_keys("audit")) > 0, kept).alias("audit"), F.coalesce("overrides", F.create_map().cast("map<string,string>")).alias("overrides"),
    )


def baseline(records: DataFrame) -> DataFrame:
    """The newest record of each ticker and strategy that a later run may be compared with: experiments (with overrides) and verdicts without a direction are none."""
    ok = (F.size(F.map_keys("overrides")) == 0) & (F.coalesce("verdict", F.lit("")) != "INSUFFICIENT_EVIDENCE")
    return records.where(ok).groupBy("ticker", "strategy_id").agg(F.max_by(F.struct("run_at", "verdict", "veto_triggers"), "run_at").alias("x")).select("ticker", "strategy_id", "x.*")
