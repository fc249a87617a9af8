"""Factor registry: name -> (value column, direction, source column). Values are native Columns over the wide inputs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.statements import earnings_yield, price_to_book, return_on_equity, through_cycle_roic, trend_growth

c = F.col


@dataclass(frozen=True)
class Factor:
    name: str
    direction: str
    value: Callable[[], Column]
    source: Callable[[], Column] | None = None


def _static(field: str) -> Callable[[], Column]:
    """filled: from the static table; stale: withheld; else computed or abstained."""
    return lambda: F.coalesce(F.try_element_at(c("static_sources"), F.lit(field)), F.when(c(field).isNotNull(), "computed").otherwise("abstained"))


def _ey() -> Column:
    return earnings_yield(c("ebit"), c("market_cap"), c("total_debt"), c("total_cash"), c("pe_ratio"), c("fx_failed"))


_ALL = [
    Factor("earnings_yield", "high", lambda: _ey()["value"], lambda: _ey()["source"]),
    Factor("roic", "high", lambda: through_cycle_roic(c("operating_income"), c("tax_provision"), c("pretax_income"), c("invested_capital"))),
    Factor("momentum_12m", "high", lambda: c("return_12m")),
    Factor("momentum_6m", "high", lambda: c("return_6m")),
    Factor("low_volatility", "low", lambda: c("volatility")),
    Factor("net_payout_yield", "high", lambda: c("dividend_yield"), lambda: F.when(c("dividend_yield").isNotNull(), "dividend_yield_fallback").otherwise("abstained")),
    Factor("revenue_growth", "high", lambda: trend_growth(c("total_revenue"))),
    Factor("dividend_streak", "high", lambda: c("dividend_streak_years").cast("double")),
    Factor("distribution_yield", "high", lambda: c("dividend_yield"), _static("dividend_yield")),
    Factor("expense_ratio", "low", lambda: c("net_expense_ratio"), _static("net_expense_ratio")),
    Factor("fund_size", "high", lambda: c("fund_assets"), _static("fund_assets")),
    Factor("price_to_book", "low", lambda: price_to_book(c("price_to_book"), c("market_cap"), c("shareholders_equity"))),
    Factor("return_on_equity", "high", lambda: return_on_equity(c("return_on_equity"), c("net_income"), c("shareholders_equity"))),
    Factor("piotroski_f_score", "high", lambda: c("f_score").cast("double")),
    Factor("valuation_band_percentile", "low", lambda: c("band_percentile")),
]
FACTORS: dict[str, Factor] = {f.name: f for f in _ALL}
_KINDS = {"fx_failed": "boolean", "static_sources": "map<string,string>", "quote_type": "string", "sector": "string", "currency": "string"} | dict.fromkeys(("operating_income", "tax_provision", "pretax_income", "invested_capital", "total_revenue", "shareholders_equity", "net_income"), "array<double>")
_READ = ("ebit", "market_cap", "total_debt", "total_cash", "pe_ratio", "return_12m", "return_6m", "volatility", "dividend_yield", "dividend_streak_years", "net_expense_ratio", "fund_assets", "price_to_book", "return_on_equity", "f_score", "band_percentile", *_KINDS)


def register(name: str, direction: str, value: Callable[[], Column], source: Callable[[], Column] | None = None) -> None:
    FACTORS[name] = Factor(name, direction, value, source)


def columns() -> dict[str, str]:
    """The columns that factors read, and their types."""
    return {k: _KINDS.get(k, "double") for k in _READ}


def factor_cells(names: list[str]) -> Column:
    """array<struct<factor, high, value (finite or null), source>> over a row of wide inputs. Unknown names raise KeyError."""
    cells = []
    for f in (FACTORS[n] for n in names):
        v = f.value()
        v = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
        src = f.source() if f.source else F.when(v.isNotNull(), "computed").otherwise("abstained")
        cells.append(F.struct(F.lit(f.name).alias("factor"), F.lit(f.direction == "high").alias("high"), v.cast("double").alias("value"), src.alias("source")))
    return F.array(*cells)


def outcomes(inputs: DataFrame, names: list[str], key: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """LONG: key, factor, value (finite or null), source. Unknown names raise KeyError; input columns that are not there count as null."""
    full = inputs.withColumns({k: F.lit(None).cast(t) for k, t in columns().items() if k not in inputs.columns})
    return full.select(*key, F.explode(factor_cells(names)).alias("x")).select(*key, "x.factor", "x.value", "x.source")


def static_fill(inputs: DataFrame, static: DataFrame, today: Column, max_age_days: int = 90) -> DataFrame:
    """Fills funds' fee, size and yield from a small dimension: a plausible vendor value wins, a stale row is withheld, else the row fills.
    Adds static_sources map<string,string>: field -> 'static' or 'stale'."""
    fields = {"net_expense_ratio": "expense_ratio", "fund_assets": "fund_size", "dividend_yield": "distribution_yield"}
    s = static.select(F.upper("ticker").alias("__t"), *[F.col(v).alias(f"__{k}") for k, v in fields.items()], F.to_date(F.try_to_timestamp("as_of", F.lit("yyyy-MM-dd"))).alias("__as_of"))
    j = inputs.join(s, (F.upper("ticker") == F.col("__t")) & F.upper("quote_type").isin("ETF", "MUTUALFUND"), "left")
    stale = F.coalesce(F.date_diff(today, "__as_of") > max_age_days, F.lit(True))
    out, tags = {}, []
    for k in fields:
        vendor = F.col(k)
        ok = F.coalesce(vendor > 0 if k != "dividend_yield" else vendor.between(0, 1), F.lit(False))
        row = F.col(f"__{k}")
        fund = F.upper(F.col("quote_type")).isin("ETF", "MUTUALFUND")
        out[f"__new_{k}"] = F.when(~F.coalesce(fund, F.lit(False)) | ok, vendor).when(row.isNotNull() & ~stale, row)
        tags.append(F.when(F.coalesce(fund, F.lit(False)) & ~ok & row.isNotNull(), F.struct(F.lit(k), F.when(stale, "stale").otherwise("static"))))
    done = j.withColumns(out).withColumn("static_sources", F.map_from_entries(F.array_compact(F.array(*tags))))
    return done.withColumns({k: F.col(f"__new_{k}") for k in fields}).drop("__t", "__as_of", *[f"__{k}" for k in fields], *[f"__new_{k}" for k in fields])
