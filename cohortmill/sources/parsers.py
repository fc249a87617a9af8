"""Ingest parsers: holdings, scouted sheets, staging sections, statement payloads, feed snapshots. Rejected rows are kept with their reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clean import any_date, holdings_number, implausible_ticker, iso_date, number, positive, sentinel, ticker

PAYLOAD = "General struct<Code:string,Name:string,Sector:string,CurrencyCode:string,Type:string>, Highlights struct<MarketCapitalization:string,PERatio:string,DividendYield:string,EarningsShare:string>, Financials struct<Income_Statement:struct<yearly:map<string,struct<totalRevenue:string,operatingIncome:string,netIncome:string>>>>"


def annual_series(yearly: Column, field: str) -> Column:
    """Newest-first array of a map keyed by period date; holes dropped."""
    entries = F.reverse(F.array_sort(F.map_entries(yearly)))
    return F.filter(F.transform(entries, lambda e: number(e["value"][field])), lambda v: v.isNotNull())


def aligned_series(yearly: Column, field: str) -> Column:
    """Newest-first array of struct(period_end, value); holes kept."""
    entries = F.reverse(F.array_sort(F.map_entries(yearly)))
    return F.transform(entries, lambda e: F.struct(iso_date(e["key"]).alias("period_end"), number(e["value"][field]).alias("value")))


def fundamentals(payloads: DataFrame) -> DataFrame:
    """(ticker, json) -> the wide row of a nested payload."""
    p = payloads.withColumn("p", F.from_json("json", PAYLOAD))
    y = F.col("p.Financials.Income_Statement.yearly")
    return p.select(
        ticker(F.col("ticker")).alias("ticker"), sentinel(F.col("p.General.Name")).alias("company_name"), sentinel(F.col("p.General.Sector")).alias("sector"), sentinel(F.col("p.General.CurrencyCode")).alias("currency"), sentinel(F.col("p.General.Type")).alias("quote_type"),
        number(F.col("p.Highlights.MarketCapitalization")).alias("market_cap"), number(F.col("p.Highlights.PERatio")).alias("pe_ratio"), number(F.col("p.Highlights.DividendYield")).alias("dividend_yield"), number(F.col("p.Highlights.EarningsShare")).alias("eps"),
        annual_series(y, "totalRevenue").alias("total_revenue"), annual_series(y, "operatingIncome").alias("operating_income"), annual_series(y, "netIncome").alias("net_income"),
    )


def dividend_events(rows: DataFrame, start: str, end: str) -> DataFrame:
    """(ticker, json: an array of rows) -> ticker, ex_date, amount in a range; adjusted values that are not positive are dropped."""
    e = rows.select("ticker", F.explode(F.from_json("json", "array<struct<date:string,value:string,unadjustedValue:string>>")).alias("e"))
    e = e.select("ticker", iso_date(F.col("e.date")).alias("ex_date"), positive(number(F.col("e.value"))).alias("amount"))
    return e.where(F.col("amount").isNotNull() & F.col("ex_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def keep_first(df: DataFrame, key: list[str], order: str) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(order))).where("__n = 1").drop("__n")


def holdings(rows: DataFrame) -> DataFrame:
    """(ord, ticker, asset_type) -> ord, ticker, kind, skip_reason: type first, then symbol, then repeats."""
    kind = F.when(F.lower(F.trim("asset_type")).isin("stock", "etf"), F.lower(F.trim("asset_type")))
    t = ticker(holdings_number(F.col("ticker")))
    r = rows.select("ord", t.alias("ticker"), kind.alias("kind"))
    why = F.when(F.col("kind").isNull(), "unknown asset type").when(F.coalesce(F.col("ticker"), F.lit("")) == "", "no ticker").otherwise(implausible_ticker(F.col("ticker")))
    r = r.withColumn("why", why)
    first = F.row_number().over(W.partitionBy("ticker", F.col("why").isNull()).orderBy("ord"))
    return r.withColumn("i", first).select("ord", "ticker", "kind", F.coalesce("why", F.when(F.col("i") > 1, "duplicate")).alias("skip_reason"))


def scouted(rows: DataFrame, today: str, window_days: int) -> DataFrame:
    """(ord, added, listing, company) -> with skip_reason: rows before the window, without a date or without a listing."""
    d = any_date(F.col("added"))
    why = F.when(d.isNull(), "no date").when(F.date_diff(F.lit(today).cast("date"), d) > window_days, "before the window").when(~F.coalesce(F.trim("listing") != "", F.lit(False)), "no listing")
    return rows.select("ord", d.alias("added"), F.trim("listing").alias("listing"), "company", why.alias("skip_reason"))


def sections(rows: DataFrame, markers: list[str], stop: str = "RUN NOTES") -> DataFrame:
    """(doc, ord, first, ...) -> section of each row: the last marker above it; markers, the header below one and all from ``stop`` on are dropped."""
    w = W.partitionBy("doc").orderBy("ord")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    mark = F.when(F.trim("first").isin(*markers), F.trim("first"))
    r = rows.withColumn("mark", mark).withColumn("section", F.last("mark", ignorenulls=True).over(upto)).withColumn("stopped", F.max(F.trim("first") == stop).over(upto)).withColumn("header", F.lag("mark").over(w).isNotNull())
    return r.where(F.col("section").isNotNull() & F.col("mark").isNull() & ~F.col("stopped") & ~F.col("header")).drop("mark", "stopped", "header")


def flatten_feed(payloads: DataFrame) -> DataFrame:
    """(run_id, json) -> run_id, row json: rows of a GeoJSON collection, of a bare list, or of a result's records."""
    v = F.coalesce(
        F.from_json(F.get_json_object("json", "$.features[*].properties"), "array<string>"), F.from_json(F.get_json_object("json", "$.result.records"), "array<string>"), F.when(F.substring(F.trim("json"), 1, 1) == "[", F.from_json("json", "array<string>")),
    )
    return payloads.select("run_id", F.explode(v).alias("row"))
