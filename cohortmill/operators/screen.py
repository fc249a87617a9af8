"""Three-valued criteria and confirmed-only gates.

A criterion is a struct (passed, observed, threshold, note, basis). passed is null where the evidence is
missing; only a confirmed false excludes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import asset_kind, currency
from ..functions.statements import fcf_series, mean_of, peg_with_earnings, through_cycle_roic, trend_growth
from ..functions.text import fixed

RESULT = "struct<passed:boolean,observed:double,threshold:double,note:string,basis:string>"


def level(t: float | Column) -> Column:
    """A threshold, given or of the row's own strategy."""
    return t.cast("double") if isinstance(t, Column) else F.lit(float(t))


def result(passed: Column, observed: Column, threshold: float | Column, note: Column | None = None, basis: Column | None = None) -> Column:
    text = F.lit(None).cast("string")
    return F.struct(passed.alias("passed"), observed.cast("double").alias("observed"), level(threshold).alias("threshold"), (text if note is None else note).alias("note"), (F.lit("") if basis is None else basis).alias("basis"))


@dataclass(frozen=True)
class Criterion:
    """build: threshold (a number, or a column of numbers) -> struct; requires: kinds of evidence; columns: fields it reads; low, high: bounds of a threshold."""

    name: str
    build: Callable[[float | Column], Column]
    requires: tuple[str, ...]
    columns: tuple[str, ...]
    low: float
    high: float


CRITERIA: dict[str, Criterion] = {}


def criterion(name: str, requires: tuple[str, ...], columns: tuple[str, ...], low: float, high: float):
    def add(build):
        CRITERIA[name] = Criterion(name, build, requires, columns, low, high)
        return build

    return add


def known_foreign() -> Column:
    """A known currency other than USD."""
    return F.coalesce(currency(F.col("currency")) != "USD", F.lit(False))


@criterion("min_dividend_yield", ("fundamentals", "prices"), ("dividend_per_share", "last_close"), 0, 1)
def min_dividend_yield(t: float) -> Column:
    dps, close = F.col("dividend_per_share"), F.col("last_close")
    seen = F.when(dps <= 0, F.lit(0.0)).when(close > 0, dps / close)
    return result(F.when(dps <= 0, F.lit(False)).otherwise(seen >= t), seen, t, F.when(seen.isNull(), "no dividend per share or price"))


@criterion("max_payout_ratio", ("fundamentals",), ("payout_ratio", "dividend_per_share"), 0, 5)
def max_payout_ratio(t: float) -> Column:
    payer = F.coalesce(F.col("dividend_per_share") > 0, F.lit(False))
    p = F.when(payer, F.col("payout_ratio"))
    return result(F.when(p < 0, F.lit(False)).otherwise(p <= t), p, t, F.when(~payer, "pays no dividend"))


@criterion("max_payout_ratio_fcf", ("fundamentals",), ("dividends_paid", "free_cash_flow_annual", "operating_cash_flow_annual", "capital_expenditure_annual", "payout_ratio", "dividend_per_share"), 0, 5)
def max_payout_ratio_fcf(t: float) -> Column:
    payer = F.coalesce(F.col("dividend_per_share") > 0, F.lit(False))
    fcf = fcf_series(F.col("free_cash_flow_annual"), F.col("operating_cash_flow_annual"), F.col("capital_expenditure_annual"))
    enough = F.coalesce(F.size(fcf) >= 2, F.lit(False))
    mean = F.when(enough, mean_of(fcf, 4))
    on_fcf = F.when(mean > 0, F.abs(F.col("dividends_paid")) / mean)
    basis = F.when(~payer, "").when(on_fcf.isNotNull(), "fcf").when(~enough & F.col("payout_ratio").isNotNull(), "eps").otherwise("abstained")
    seen = F.when(basis == "fcf", on_fcf).when(basis == "eps", F.col("payout_ratio"))
    return result(F.when(~payer, F.lit(True)).otherwise(seen <= t), seen, t, F.when(basis == "abstained", "free cash flow is not positive or not known"), basis)


@criterion("min_market_cap", ("fundamentals",), ("market_cap", "currency"), 0, 1e15)
def min_market_cap(t: float) -> Column:
    cap = F.when(~known_foreign(), F.col("market_cap"))
    return result(cap >= t, cap, t, F.when(known_foreign(), "reported in another currency"))


@criterion("min_revenue_cagr", ("fundamentals",), ("total_revenue",), -1, 5)
def min_revenue_cagr(t: float) -> Column:
    g = trend_growth(F.col("total_revenue"))
    return result(g >= t, g, t)


@criterion("min_roic", ("fundamentals",), ("operating_income", "tax_provision", "pretax_income", "invested_capital"), -1, 5)
def min_roic(t: float) -> Column:
    r = through_cycle_roic(F.col("operating_income"), F.col("tax_provision"), F.col("pretax_income"), F.col("invested_capital"))
    return result(r >= t, r, t)


@criterion("max_peg_ratio", ("fundamentals",), ("pe_ratio", "operating_income", "total_revenue"), 0, 100)
def max_peg_ratio(t: float) -> Column:
    p = peg_with_earnings(F.col("pe_ratio"), F.col("operating_income"), F.col("total_revenue"))
    return result(F.when(p["must_fail"], F.lit(False)).otherwise(p["value"] <= t), p["value"], t, F.when(p["must_fail"], "growth is not positive"))


@criterion("min_price_momentum", ("prices",), ("return_12m",), -1, 10)
def min_price_momentum(t: float) -> Column:
    return result(F.col("return_12m") >= t, F.col("return_12m"), t)


@criterion("min_dividend_streak", ("fundamentals",), ("dividend_streak_years",), 0, 200)
def min_dividend_streak(t: float) -> Column:
    return result(F.col("dividend_streak_years") >= t, F.col("dividend_streak_years"), t)


@criterion("min_dividend_growth_streak", ("dividends",), ("growth_streak",), 0, 200)
def min_dividend_growth_streak(t: float) -> Column:
    return result(F.col("growth_streak") >= F.floor(level(t)), F.col("growth_streak"), t)


@criterion("max_debt_to_market_cap", ("fundamentals",), ("total_debt", "market_cap"), 0, 100)
def max_debt_to_market_cap(t: float) -> Column:
    r = F.when(F.col("market_cap") > 0, F.col("total_debt") / F.col("market_cap"))
    return result(r <= t, r, t)


@criterion("min_f_score", ("fundamentals",), ("f_score",), 0, 9)
def min_f_score(t: float) -> Column:
    return result(F.col("f_score") >= t, F.col("f_score"), t)


@criterion("valuation_band_percentile", ("band",), ("band_percentile",), 0, 100)
def valuation_band_percentile(t: float) -> Column:
    return result(F.col("band_percentile") <= t, F.col("band_percentile"), t)


def validate(selections: list[tuple[str, float]], available: set[str] | None = None) -> None:
    """Raises ValueError for an unknown criterion, a threshold out of bounds, or evidence that is not there."""
    for name, t in selections:
        c = CRITERIA.get(name)
        if c is None:
            raise ValueError(f"unknown criterion {name}")
        if not c.low <= t <= c.high:
            raise ValueError(f"{name}: {t} is not within {c.low} and {c.high}")
        if available is not None and not set(c.requires) <= available:
            raise ValueError(f"{name} needs {sorted(set(c.requires) - available)}")


def required_evidence(selections: list[tuple[str, float]]) -> set[str]:
    return {e for name, _ in selections for e in CRITERIA[name].requires}


def selection_faults(selections: DataFrame, available: DataFrame) -> DataFrame:
    """selections: (strategy, criterion, threshold); available: (strategy, evidence), the kinds of evidence that a strategy's provider has. strategy, criterion, fault: an unknown criterion, a threshold
    out of its bounds or null, or the evidence that is not there, in order; sound ones have no row."""
    rows = [(c.name, list(c.requires), float(c.low), float(c.high)) for c in CRITERIA.values()]
    registry = F.broadcast(selections.sparkSession.createDataFrame(rows, "criterion string, requires array<string>, low double, high double"))  # the registry's few criteria
    have = available.groupBy("strategy").agg(F.collect_set("evidence").alias("have"))  # a few kinds
    j = selections.join(registry, "criterion", "left").join(have, "strategy", "left")
    gone = F.array_sort(F.array_except("requires", F.coalesce("have", F.array().cast("array<string>"))))
    fault = (
        F.when(F.col("requires").isNull(), F.concat(F.lit("unknown criterion "), F.coalesce("criterion", F.lit("null"))))
        .when(~F.coalesce(F.col("threshold").between(F.col("low"), F.col("high")), F.lit(False)), "threshold out of bounds")
        .when(F.size(gone) > 0, F.concat(F.lit("needs "), F.array_join(gone, ", ")))
    )
    return j.select("strategy", "criterion", fault.alias("fault")).where("fault is not null")


def evidence_of(selections: DataFrame) -> DataFrame:
    """(strategy, criterion) -> strategy, evidence, fields: what the criteria of each strategy need, in order. An unknown criterion needs nothing."""
    registry = selections.sparkSession.createDataFrame([(c.name, list(c.requires), list(c.columns)) for c in CRITERIA.values()], "criterion string, requires array<string>, columns array<string>")
    j = selections.select("strategy", "criterion").distinct().join(F.broadcast(registry), "criterion")  # the registry's few criteria
    whole = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    return j.groupBy("strategy").agg(whole("requires").alias("evidence"), whole("columns").alias("fields"))


def consumed_columns(selections: list[tuple[str, float]]) -> set[str]:
    return {c for name, _ in selections for c in CRITERIA[name].columns}


def run_screen(inputs: DataFrame, selections: list[tuple[str, float]], key: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """LONG: key, ord, criterion, passed, observed, threshold, note, basis. A column that the inputs lack counts as null."""
    validate(selections)
    kinds = {"currency": "string"} | {c: "array<double>" for c in ("free_cash_flow_annual", "operating_cash_flow_annual", "capital_expenditure_annual", "total_revenue", "operating_income", "tax_provision", "pretax_income", "invested_capital")}
    missing = {c: F.lit(None).cast(kinds.get(c, "double")) for c in sorted(consumed_columns(selections) | {"currency"}) if c not in inputs.columns}
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("criterion"), CRITERIA[n].build(t).cast(RESULT).alias("r")) for i, (n, t) in enumerate(selections)])
    return inputs.withColumns(missing).select(*key, F.explode(rows).alias("x")).select(*key, "x.ord", "x.criterion", "x.r.*")


def reason_of(name: Column, observed: Column, threshold: Column) -> Column:
    """Text of a confirmed fail."""
    return F.concat(name, F.lit(": "), F.when(observed.isNull(), "fails").otherwise(fixed(observed, 4)), F.lit(" against "), fixed(threshold, 4))


def reason() -> Column:
    return reason_of(F.col("criterion"), F.col("observed"), F.col("threshold"))


def evaluate(screen: DataFrame, key: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """key, n_evaluated, n_abstained, passes (null if nothing was evaluated), first_fail, borderline."""
    failed = F.col("passed") == F.lit(False)
    near = F.coalesce((F.try_divide(F.abs(F.col("observed") - F.col("threshold")), F.abs(F.col("threshold"))) <= 0.05) & (F.col("threshold") != 0), F.lit(False))
    return screen.groupBy(*key).agg(
        F.count("passed").cast("int").alias("n_evaluated"), F.count_if(F.col("passed").isNull()).cast("int").alias("n_abstained"), F.bool_and("passed").alias("passes"),
        F.min_by(F.when(failed, reason()), F.when(failed, F.col("ord"))).alias("first_fail"), F.bool_or(failed & near).alias("borderline"),
    )


def divergence_flag(screen: DataFrame, returns: DataFrame, floor: float = 0.30) -> DataFrame:
    """Names up by ``floor`` or more over a year that a criterion other than momentum confirms as failed."""
    bad = screen.groupBy("ticker").agg(F.bool_or((F.col("passed") == F.lit(False)) & (F.col("criterion") != "min_price_momentum")).alias("failed"))
    return returns.join(bad, "ticker", "left").select("ticker", (F.coalesce(F.col("return_12m") >= floor, F.lit(False)) & F.coalesce("failed", F.lit(False))).alias("diverges"))


def in_list(c: Column, values: list[str]) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(*[v.strip().lower() for v in values]), F.lit(False))


def not_in_list(c: Column, values: list[str]) -> Column:
    return F.coalesce(~F.lower(F.trim(c)).isin(*[v.strip().lower() for v in values]), F.lit(False))


@dataclass(frozen=True)
class Gates:
    """Ordered, confirmed-only gates of a rank strategy."""

    asset_kinds: tuple[str, ...] = ()
    min_market_cap: float | None = None
    exclude_sectors: tuple[str, ...] = ()
    include_sectors: tuple[str, ...] = ()
    max_payout: float | None = None


def gate_cells(inputs: DataFrame, gates: Gates) -> DataFrame:
    """LONG: ticker, ord, gate, state: PASS, FAIL or NOT-EVALUATED for each gate that the strategy sets."""
    cap = F.when(~known_foreign(), F.col("market_cap"))
    rows = []
    if gates.asset_kinds:
        rows.append(("asset_kind", not_in_list(asset_kind(F.col("quote_type")), list(gates.asset_kinds)), asset_kind(F.col("quote_type"))))
    if gates.min_market_cap is not None:
        rows.append(("market_cap", F.coalesce(cap < gates.min_market_cap, F.lit(False)), cap))
    if gates.exclude_sectors:
        rows.append(("sector_excluded", in_list(F.col("sector"), list(gates.exclude_sectors)), F.col("sector")))
    if gates.include_sectors:
        rows.append(("sector_scope", not_in_list(F.col("sector"), list(gates.include_sectors)), F.col("sector")))
    if gates.max_payout is not None:
        rows.append(("payout_uncovered", F.coalesce(F.col("payout_ratio") > gates.max_payout, F.lit(False)), F.col("payout_ratio")))
    if not rows:
        return inputs.select("ticker", F.lit(0).alias("ord"), F.lit("").alias("gate"), F.lit("").alias("state")).where("false")
    cells = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("gate"), F.when(fail, "FAIL").when(seen.isNull(), "NOT-EVALUATED").otherwise("PASS").alias("state")) for i, (n, fail, seen) in enumerate(rows)])
    return inputs.select("ticker", F.explode(cells).alias("x")).select("ticker", "x.*")


def first_gate(cells: DataFrame) -> DataFrame:
    """ticker, gate: the first confirmed fail, null where none."""
    return cells.groupBy("ticker").agg(F.min_by(F.when(F.col("state") == "FAIL", F.col("gate")), F.when(F.col("state") == "FAIL", F.col("ord"))).alias("gate"))
