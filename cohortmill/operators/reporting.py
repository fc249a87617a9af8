"""Views and summaries on the reporting side: sentiment, observations, reasons, lenses, anchors, guarded dimension rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clean import currency, positive

GRADES = ("strong_buy", "buy", "hold", "sell", "strong_sell")


def sentiment(trends: DataFrame) -> DataFrame:
    """ticker, period, total, bullish ratio to four places of the newest period that has any grade; missing counts are 0."""
    t = trends.withColumns({g: F.coalesce(g, F.lit(0)) for g in GRADES})
    t = t.withColumn("total", sum(F.col(g) for g in GRADES)).where("total > 0")
    x = t.groupBy("ticker").agg(F.max_by(F.struct("total", "strong_buy", "buy"), "period").alias("x"), F.max("period").alias("period"))
    return x.select("ticker", "period", F.col("x.total").alias("total"), F.bround((F.col("x.strong_buy") + F.col("x.buy")) / F.col("x.total"), 4).alias("bullish"))


def headlines(news: DataFrame, as_of: Column, days: int = 14, n: int = 5) -> DataFrame:
    """The newest headlines of each name within a window: newest first, ties by text."""
    x = news.where((F.date_diff(as_of, "published") >= 0) & (F.date_diff(as_of, "published") <= days))
    w = W.partitionBy("ticker").orderBy(F.desc("published"), "headline")
    x = x.withColumn("i", F.row_number().over(w)).where(F.col("i") <= n)
    return x.groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "headline"))), lambda s: s["headline"]).alias("headlines"))


def dividend_view(dividends: DataFrame) -> DataFrame:
    """ticker, n, earliest, latest, last_amounts: a map of each year to its last payment."""
    y = dividends.groupBy("ticker", F.year("ex_date").alias("year")).agg(F.count(F.lit(1)).alias("k"), F.min("ex_date").alias("a"), F.max("ex_date").alias("b"), F.max_by("amount", F.struct("ex_date", "amount")).alias("last"))
    return y.groupBy("ticker").agg(F.sum("k").alias("n"), F.min("a").alias("earliest"), F.max("b").alias("latest"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", "last")))).alias("last_amounts"))


def observations(obs: DataFrame) -> DataFrame:
    """(site, observed, ends) -> site, first_seen, last_seen, n_ends, first_end, current_end, slip_days, tally: later, earlier, same."""
    a = obs.groupBy("site").agg(F.min("observed").alias("first_seen"), F.max("observed").alias("last_seen"), F.count_distinct("ends").alias("n_ends"), F.min_by("ends", F.struct("observed", "ends")).alias("first_end"), F.max_by("ends", F.struct("observed", "ends")).alias("current_end"))
    slip = F.date_diff("current_end", "first_end")
    return a.withColumn("slip_days", slip).withColumn("tally", F.when(slip > 0, "later").when(slip < 0, "earlier").otherwise("same"))


def top_reasons(rows: DataFrame, n: int = 3) -> DataFrame:
    """The n most frequent reasons, ties by text. Counted before the order is taken."""
    return rows.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(n)


def best_lens(cells: DataFrame, order: list[str]) -> DataFrame:
    """(ticker, lens, position): the lens with the lowest position, ties by the given order; unranked cells take no part."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("lens"))
    return cells.where("position is not null").groupBy("ticker").agg(F.min_by(F.struct("lens", "position"), F.struct("position", place)).alias("x")).select("ticker", "x.*")


def suggested_first(rows: DataFrame, ids: list[str], key: str, order: str) -> DataFrame:
    """Suggested ids in their order, then the rest in the rows' own order."""
    place = F.array_position(F.array(*map(F.lit, ids)), F.col(key)) if ids else F.lit(0)
    return rows.withColumn("suggested", place > 0).orderBy(place == 0, place, order)


def anchors(funds: DataFrame) -> DataFrame:
    """Per kind: cheapest, dearest and largest fund, ties by symbol."""
    fee = lambda s: F.struct(s * F.col("fee"), F.col("ticker"))
    return funds.groupBy("kind").agg(F.min_by("ticker", F.when(F.col("fee").isNotNull(), fee(1.0))).alias("cheapest"), F.min_by("ticker", F.when(F.col("fee").isNotNull(), fee(-1.0))).alias("dearest"), F.min_by("ticker", F.when(F.col("size").isNotNull(), F.struct(-F.col("size"), F.col("ticker")))).alias("largest"))


def health(rows: DataFrame) -> DataFrame:
    """Counts of clean, degraded, failed and insufficient runs. rows: status, issues array."""
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if((F.col("status") == "OK") & (F.size("issues") == 0)).alias("clean"), F.count_if((F.col("status") == "OK") & (F.size("issues") > 0)).alias("degraded"), F.count_if(F.col("status") == "FETCH_ERROR").alias("fetch"), F.count_if(F.col("status") == "INSUFFICIENT").alias("insufficient"))


def guarded_static(rows: DataFrame) -> DataFrame:
    """(ticker, fee, size, size_currency, yield_pct): fake zero fees and implausible sizes are nulled, a size without a currency is nulled, percent becomes a fraction; notes say what was done."""
    fee, size, code = positive(F.col("fee")), F.when(F.col("size").between(1e7, 1.5e12), F.col("size")), currency(F.col("size_currency"))
    notes = F.array_compact(F.array(F.when(F.col("fee") <= 0, "fee of zero dropped"), F.when(F.col("size").isNotNull() & size.isNull(), "size out of range"), F.when(size.isNotNull() & code.isNull(), "size without currency")))
    return rows.select("ticker", fee.alias("fee"), F.when(code.isNotNull(), size).alias("size"), code.alias("size_currency"), (F.col("yield_pct") / 100).alias("yield"), notes.alias("notes"))


def new_rows(staging: DataFrame, master: DataFrame, keys: list[str]) -> DataFrame:
    """Staged rows whose trimmed, lower-case keys the master lacks."""
    norm = lambda df: df.withColumns({f"__{k}": F.lower(F.trim(F.col(k))) for k in keys})
    m = norm(master).select(*[f"__{k}" for k in keys]).distinct()
    return norm(staging).join(m, [f"__{k}" for k in keys], "left_anti").drop(*[f"__{k}" for k in keys])


def next_free_id(ids: DataFrame, key: str = "id") -> DataFrame:
    """stem, next_id: the first free version of each stem of '<stem>_v<n>'."""
    v = ids.select(F.regexp_extract(key, r"^(.*)_v(\d+)$", 1).alias("stem"), F.regexp_extract(key, r"^(.*)_v(\d+)$", 2).try_cast("int").alias("v")).where("v is not null").distinct()
    top = v.groupBy("stem").agg(F.max("v").alias("m"))
    free = top.select("stem", F.explode(F.sequence(F.lit(1), F.col("m") + 1)).alias("v")).join(v, ["stem", "v"], "left_anti")
    return free.groupBy("stem").agg(F.min("v").alias("v")).select("stem", F.concat("stem", F.lit("_v"), F.col("v").cast("string")).alias("next_id"))


def applicable_by(strategies: DataFrame, members: DataFrame) -> DataFrame:
    """strategies: (id, kinds array, lower case); members: (cohort, kind) -> cohort, id of what does not confirm as out of scope. The strategies are a few rows, those of a list."""
    one = members.groupBy("cohort").agg(F.count_distinct("kind").alias("k"), F.min("kind").alias("kind"))
    fits = (F.size("kinds") == 0) | (F.col("k") != 1) | F.array_contains("kinds", F.col("kind"))
    return one.join(F.broadcast(strategies), fits).select("cohort", "id")


def applicable(strategies: DataFrame, cohort: DataFrame) -> DataFrame:
    """Strategies (id, kinds array) that a cohort (kind of each member) does not confirm as out of scope: a cohort of one known kind must be among the kinds; an unscoped strategy fits any."""
    kinds = cohort.where("kind is not null").agg(F.collect_set(F.lower("kind")).alias("ks"))
    one = F.when(F.size("ks") == 1, F.get("ks", F.lit(0)))
    scoped = F.transform("kinds", lambda k: F.lower(F.trim(k)))
    return strategies.crossJoin(F.broadcast(kinds)).where((F.size("kinds") == 0) | one.isNull() | F.array_contains(scoped, F.coalesce(one, F.lit("")))).drop("ks")  # one row of at most a few kinds
