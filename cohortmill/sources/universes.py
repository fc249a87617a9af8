"""Universes: named, versioned lists of symbols, as a table of manifests. Personal lists lie in a folder ``local`` below the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import ticker
from ..functions.text import member_hash

SCHEMA = "id string, display_name string, role string, description string, tickers array<string>, created string, rationale string"


def members(tickers: Column) -> Column:
    """Symbols as they are compared: trimmed, upper case, each once, in the given order; blank ones go."""
    return F.array_distinct(F.filter(F.transform(tickers, ticker), lambda t: t.isNotNull() & (t != "")))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The manifests of a folder, a JSON object in each file, with local boolean. Files that are no manifest give null rows, which ``listed`` drops."""
    r = spark.read.schema(SCHEMA).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder)
    return r.withColumn("local", F.input_file_name().contains("/local/"))


def save_local(manifests: DataFrame, folder: str) -> None:
    """Adds personal lists, members as they are compared, one file for each."""
    manifests.withColumn("tickers", members(F.col("tickers"))).repartition("id").write.mode("append").option("maxRecordsPerFile", 1).json(f"{folder}/local")


def listed(manifests: DataFrame) -> DataFrame:
    """Every usable manifest: its id ends in a version and it has a member. A missing display name is the id."""
    m = manifests.withColumn("tickers", members(F.col("tickers")))
    m = m.where(F.coalesce(F.col("id").rlike(r"_v[0-9]+$"), F.lit(False)) & (F.coalesce(F.size("tickers"), F.lit(0)) > 0))
    return m.withColumn("display_name", F.coalesce(F.nullif(F.trim("display_name"), F.lit("")), F.col("id"))).withColumn("hash", member_hash(F.col("tickers")))


def by_id(manifests: DataFrame, universe_id: str) -> DataFrame:
    """ord, ticker of one universe; a shared one goes before a personal one of the same id. An unknown id raises when the rows are read."""
    m = listed(manifests).where(F.col("id") == universe_id)
    one = m.agg(F.min_by("tickers", F.struct(F.coalesce("local", F.lit(False)), F.col("hash"))).alias("tickers"))
    found = F.when(F.col("tickers").isNull(), F.raise_error(F.lit(f"unknown universe {universe_id}")).cast("array<string>")).otherwise(F.col("tickers"))
    return one.select(F.posexplode(found).alias("ord", "ticker"))


def adhoc_id(tickers: Column) -> Column:
    """The id of a list without a name: the same for the same members in any order."""
    return F.concat(F.lit("adhoc:"), member_hash(members(tickers)))


def adhoc(tokens: DataFrame) -> DataFrame:
    """(request, ord, token) -> request, universe_id, ord, ticker: the list of each request, a symbol where it comes first, under an id made of its members."""
    t = tokens.select("request", ticker(F.col("token")).alias("ticker"), "ord").where("ticker <> ''").groupBy("request", "ticker").agg(F.min("ord").alias("ord"))
    whole = t.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("ord", "ticker"))).alias("list"))  # a request's own list
    named = whole.select("request", adhoc_id(F.transform("list", lambda x: x["ticker"])).alias("universe_id"), F.posexplode(F.transform("list", lambda x: x["ticker"])).alias("ord", "ticker"))
    return named


def resolve(spark: SparkSession, manifests: DataFrame, tickers: list[str] | None = None, universe_id: str | None = None) -> DataFrame:
    """universe_id, ord, ticker of a run: a given list, under its id or one made from its members; else the named manifest."""
    if tickers:
        t = spark.createDataFrame([(tickers,)], "tickers array<string>")
        name = F.lit(universe_id) if universe_id else adhoc_id(F.col("tickers"))
        return t.select(name.alias("universe_id"), F.posexplode(members(F.col("tickers"))).alias("ord", "ticker"))
    if not universe_id:
        raise ValueError("a list of symbols or the id of a universe is needed")
    return by_id(manifests, universe_id).select(F.lit(universe_id).alias("universe_id"), "ord", "ticker")
