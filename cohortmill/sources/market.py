"""The market tables as projections of a star schema of orders, suppliers and events, so that every operator has data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The last full year of the projected statements.
LAST_YEAR = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c, n: int):
    """To n places, the same in any engine: a half that is off by the last bits of a sum cannot fall on either side."""
    return F.floor(c * 10.0**n + 0.50001) / F.lit(10.0**n)


def _ticker(c: str):
    return F.concat(F.lit("S"), F.col(c).cast("string"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, day, close, volume: the day's mean unit price of a supplier's lines."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(_ticker("l_suppkey").alias("ticker"), F.col("l_shipdate").cast("date").alias("day")).agg(rounded(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 6).alias("close"), F.sum("l_quantity").cast("long").alias("volume"))


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, company_name, sector, currency, quote_type, market_cap: negative balances stand for unknown caps in some uses."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    j = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))  # nation and region have fixed sizes
    return j.select(_ticker("s_suppkey").alias("ticker"), F.col("s_name").alias("company_name"), F.col("r_name").alias("sector"), F.when(F.col("s_suppkey") % 7 == 0, "EUR").otherwise("USD").alias("currency"), F.when(F.col("s_suppkey") % 5 == 0, "ETF").otherwise("EQUITY").alias("quote_type"), F.col("s_acctbal").alias("market_cap"))


def annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, year, revenue, gross, tax of full years."""
    li = table(spark, sf_dir, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    y = li.groupBy(_ticker("l_suppkey").alias("ticker"), F.year("l_shipdate").alias("year")).agg(rounded(F.sum("l_extendedprice"), 4).alias("revenue"), rounded(F.sum(net), 4).alias("gross"), rounded(F.sum(F.col("l_extendedprice") * F.col("l_tax")), 4).alias("tax"), F.sum("l_quantity").alias("quantity"))
    return y.where(F.col("year") <= LAST_YEAR)


def series(annual_: DataFrame, columns: dict[str, str]) -> DataFrame:
    """ticker and arrays, newest first, of yearly columns (array name -> column)."""
    rows = F.reverse(F.array_sort(F.collect_list(F.struct("year", *dict.fromkeys(columns.values())))))
    a = annual_.groupBy("ticker").agg(rows.alias("rows"))
    return a.select("ticker", *[F.col("rows")[src].alias(name) for name, src in columns.items()])


def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, mean (1 best to 5 worst), n_analysts of customers, by the priority of their orders."""
    o = table(spark, sf_dir, "orders")
    digit = F.substring("o_orderpriority", 1, 1).cast("int")
    return o.groupBy(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker")).agg(rounded(F.avg(digit), 6).alias("mean"), F.count(F.lit(1)).alias("n_analysts"))


def dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, ex_date, amount: a supplier's returned lines."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return li.select(_ticker("l_suppkey").alias("ticker"), F.col("l_shipdate").cast("date").alias("ex_date"), F.col("l_quantity").alias("amount"))


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide inputs of factors and criteria, one row for each ticker."""
    from ..operators.prices import technical

    t = technical(bars(spark, sf_dir)).drop("notes", "n")
    s = series(annual(spark, sf_dir), {"total_revenue": "revenue", "operating_income": "gross", "pretax_income": "gross", "tax_provision": "tax", "invested_capital": "revenue"})
    i = instruments(spark, sf_dir)
    return i.join(t, "ticker", "left").join(s, "ticker", "left").withColumns({"pe_ratio": F.when(F.col("market_cap") > 0, F.col("market_cap") / 100), "total_debt": F.abs("market_cap") / 2, "total_cash": F.col("market_cap") / 10, "dividend_per_share": F.col("last_close") / 50, "payout_ratio": F.col("market_cap") / 10000})
