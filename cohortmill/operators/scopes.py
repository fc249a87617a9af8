"""Which fields of a wide row a reader may see, in which words, and what is withheld and why. Rows become maps; the allowed fields of each strategy are a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import implausible_fields
from ..functions.display import factor_value

# Fields shown under every strategy; a headline figure never shown, and the series to cite for it; fields shown in the instrument's currency; factors whose absolute values are shown.
CORE = ("ticker", "name", "market_cap", "pe_ratio", "free_cash_flow_annual", "eps")
HEADLINE, INSTEAD = "free_cash_flow", "free_cash_flow_annual"
IN_CURRENCY = ("market_cap", "enterprise_value")
ABSOLUTE = ("expense_ratio", "fund_size", "distribution_yield")
CHECKED = ("dividend_yield", "market_cap", "debt_to_equity", "price_to_book", "return_on_equity")


def as_map(df: DataFrame, fields: list[str]) -> Column:
    """map<field, text> of the fields that are not null."""
    return F.map_from_entries(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c), F.col(c).cast("string"))) for c in fields])))


def allowed(selections: DataFrame, core: tuple[str, ...] = CORE) -> DataFrame:
    """(strategy, field), the fields that a strategy's criteria read -> strategy, fields: with those shown under every strategy."""
    return selections.groupBy("strategy").agg(F.array_sort(F.array_distinct(F.concat(F.collect_set("field"), F.array(*map(F.lit, core))))).alias("fields"))  # a strategy's few fields


def scoped(rows: DataFrame, fields: list[str], scopes: DataFrame) -> DataFrame:
    """rows: (ticker, strategy, and the columns ``fields``); scopes: rows of ``allowed``. ticker, strategy, shown map<field, text>, withheld map<field, reason>.

    Shown are a strategy's own fields that are known; the headline cash flow and implausible values are withheld, with the reason, and only if the strategy would have shown them. A strategy
    without a scope shows nothing."""
    have = set(rows.columns)
    col = lambda c: F.col(c).cast("double") if c in have else F.lit(None).cast("double")
    flags = implausible_fields(*[col(c) for c in CHECKED])
    j = rows.withColumn("all", as_map(rows, fields)).withColumn("flags", flags).join(scopes, "strategy", "left")
    may = F.map_filter("all", lambda k, v: F.array_contains("fields", k))
    headline = F.map_filter(may, lambda k, v: k == HEADLINE)
    why = F.map_concat(F.transform_values(headline, lambda k, v: F.lit(f"one-offs of twelve months; cite {INSTEAD}")), F.transform_values(F.map_filter(may, lambda k, v: F.array_contains("flags", k)), lambda k, v: F.lit("implausible")))
    none = F.create_map().cast("map<string,string>")
    j = j.withColumn("may", may).withColumn("withheld", why)
    shown = F.map_filter("may", lambda k, v: ~F.array_contains(F.map_keys("withheld"), k))
    return j.select("ticker", "strategy", F.coalesce(shown, none).alias("shown"), F.coalesce("withheld", none).alias("withheld"))


def displays(rows: DataFrame, shown: str = "shown", currency: str = "currency") -> DataFrame:
    """The rows with ``display``: map<field, text> of those numbers that have a way to be written; money of the instrument with its currency, other fields without."""
    def text(k: Column, v: Column) -> Column:
        number = v.try_cast("double")
        return F.when(number.isNotNull(), factor_value(k, number, F.when(k.isin(*IN_CURRENCY), F.col(currency))))

    return rows.withColumn("display", F.map_filter(F.transform_values(shown, text), lambda k, v: v.isNotNull()))


def absolute_values(values: DataFrame, factors: tuple[str, ...] = ABSOLUTE) -> DataFrame:
    """(ticker, factor, value, source) of ranked names -> ticker, evidence array<struct<factor, value, provenance>>, in the order of factors: values that a reader may hold against the world,
    with where each came from, whatever that is. Unknown values and sources are left out; a name without any has no row."""
    ord_ = F.array_position(F.array(*map(F.lit, factors)), F.col("factor"))
    known = values.where(F.col("factor").isin(*factors) & F.col("value").isNotNull() & F.col("source").isNotNull())
    e = F.array_sort(F.collect_list(F.struct(ord_.alias("o"), "factor", "value", F.col("source").alias("provenance"))))
    return known.groupBy("ticker").agg(F.transform(e, lambda x: F.struct(x["factor"], x["value"], x["provenance"])).alias("evidence"))
