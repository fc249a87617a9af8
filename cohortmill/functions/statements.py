"""Statement mathematics over annual series, newest first. Null is not false and zero is not null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Growth above which PEG does not count it; tax rates a cycle may show; divergence of trend and end points worth a warning.
GROWTH_CAP, TAX_CEILING, DIVERGENCE = 0.40, 0.60, 0.10


def at(series: Column, i: int) -> Column:
    """The i-th newest value, null beyond the end."""
    return F.get(series, F.lit(i))


def newest(series: Column, n: int) -> Column:
    return F.slice(series, 1, n)


def mean_of(series: Column, n: int) -> Column:
    """Mean of the n newest values; null when empty or when one of them is null."""
    s = newest(series, n)
    return F.when(F.size(s) > 0, F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.size(s))


def _points(series: Column, years: int) -> Column:
    s = newest(series, years + 1)
    return F.when((F.size(s) == years + 1) & F.forall(s, lambda v: F.coalesce(v > 0, F.lit(False))), s)


def trend_growth(series: Column, years: int = 3) -> Column:
    """Yearly growth of the least-squares line through the logarithms of years + 1 points."""
    n = years + 1
    square = sum((i - years / 2) ** 2 for i in range(n))
    weights = F.array(*[F.lit((years / 2 - i) / square) for i in range(n)])
    slope = F.aggregate(F.zip_with(_points(series, years), weights, lambda v, w: F.ln(v) * w), F.lit(0.0), lambda a, x: a + x)
    return F.exp(slope) - 1


def endpoint_growth(series: Column, years: int = 3) -> Column:
    p = _points(series, years)
    return F.pow(at(p, 0) / at(p, years), F.lit(1 / years)) - 1


def growth_diverges(series: Column, years: int = 3) -> Column:
    return F.abs(trend_growth(series, years) - endpoint_growth(series, years)) > DIVERGENCE


def nopat_roic(operating_income: Column, tax: Column, pretax: Column, capital: Column) -> Column:
    """Operating income after the year's own tax rate, held to [0, 1], on capital; no usable rate is none."""
    rate = F.coalesce(F.when((pretax != 0) & tax.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), tax / pretax))), F.lit(0.0))
    return F.when(capital != 0, operating_income * (1 - rate) / capital)


def through_cycle_roic(operating_income: Column, tax: Column, pretax: Column, capital: Column, years: int = 4) -> Column:
    """Mean operating income at the cycle's tax rate on the latest capital."""
    rate = F.when(mean_of(pretax, years) > 0, mean_of(tax, years) / mean_of(pretax, years))
    latest = at(capital, 0)
    return F.when((rate >= 0) & (rate <= TAX_CEILING) & (latest > 0), mean_of(operating_income, years) * (1 - rate) / latest)


def peg(pe: Column, growth: Column) -> Column:
    """struct(value, must_fail): growth that does not grow must fail; no ratio or no growth abstains."""
    value = F.when((growth > 0) & pe.isNotNull(), pe / (F.least(growth, F.lit(GROWTH_CAP)) * 100))
    return F.struct(value.alias("value"), F.coalesce(pe.isNotNull() & (growth <= 0), F.lit(False)).alias("must_fail"))


def peg_with_earnings(pe: Column, operating_income: Column, revenue: Column, years: int = 3) -> Column:
    """PEG on operating income where it has enough years, else on revenue. Earnings that are not positive throughout must fail."""
    enough = F.size(F.coalesce(operating_income, F.array().cast("array<double>"))) >= years + 1
    own = trend_growth(operating_income, years)
    on_earnings = F.when(own.isNull() & pe.isNotNull(), F.struct(F.lit(None).cast("double").alias("value"), F.lit(True).alias("must_fail"))).otherwise(peg(pe, own))
    return F.when(enough, on_earnings).otherwise(peg(pe, trend_growth(revenue, years)))


def fcf_series(fcf: Column, operating: Column, capex: Column) -> Column:
    """Free cash flow, else operating cash flow plus capital expenditure over the years both have."""
    both = F.least(F.size(operating), F.size(capex))
    made = F.zip_with(F.slice(operating, F.lit(1), F.greatest(both, F.lit(0))), F.slice(capex, F.lit(1), F.greatest(both, F.lit(0))), lambda a, b: a + b)
    return F.when(F.size(fcf) > 0, fcf).when(both > 0, made)


def through_cycle_fcf(series: Column, window: int = 4) -> Column:
    """struct(mean, n) of the newest years."""
    return F.struct(mean_of(series, window).alias("mean"), F.greatest(F.size(newest(series, window)), F.lit(0)).alias("n"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


F_CHECKS = ("roa_positive", "cfo_positive", "roa_up", "accruals", "leverage_down", "liquidity_up", "no_dilution", "margin_up", "turnover_up")


def f_score_checks(now: dict[str, Column], before: dict[str, Column]) -> Column:
    """Nine checks as array<boolean> in the order of F_CHECKS. now and before: ni, assets, ocf, ltd, ca, cl, shares, gp, revenue."""
    roa, roa0 = ratio(now["ni"], now["assets"]), ratio(before["ni"], before["assets"])
    lever, lever0 = ratio(now["ltd"], now["assets"]), ratio(before["ltd"], before["assets"])
    return F.array(
        roa > 0, now["ocf"] > 0, roa > roa0, now["ocf"] > now["ni"],
        lever < lever0, ratio(now["ca"], now["cl"]) > ratio(before["ca"], before["cl"]), now["shares"] <= before["shares"],
        ratio(now["gp"], now["revenue"]) > ratio(before["gp"], before["revenue"]), ratio(now["revenue"], now["assets"]) > ratio(before["revenue"], before["assets"]),
    )


def f_score(checks: Column, least: int = 5) -> Column:
    """struct(score, points, computed, unavailable): no score below ``least`` computed checks."""
    points, computed = F.size(F.filter(checks, lambda c: c)), F.size(F.filter(checks, lambda c: c.isNotNull()))
    return F.struct(F.when(computed >= least, points).alias("score"), points.alias("points"), computed.alias("computed"), (F.lit(len(F_CHECKS)) - computed).alias("unavailable"))


def enterprise_value(cap: Column, debt: Column, cash: Column, fx: Column | None = None) -> Column:
    fx = F.lit(1.0) if fx is None else fx
    return cap + debt * fx - cash * fx


def earnings_yield(ebit: Column, cap: Column, debt: Column, cash: Column, pe: Column, fx_failed: Column | None = None) -> Column:
    """struct(value, source) down a ladder: EBIT over enterprise value, over market cap, one over PE, abstained."""
    ev = enterprise_value(cap, debt, cash)
    lost = F.lit(False) if fx_failed is None else F.coalesce(fx_failed, F.lit(False))
    none = F.lit(None).cast("double")
    s = lambda v, src: F.struct(v.alias("value"), F.lit(src).alias("source"))
    return F.when(lost, s(none, "abstained")).when(ebit.isNotNull() & (ev > 0), s(ebit / ev, "ebit_ev")).when(ebit.isNotNull() & ev.isNotNull(), s(none, "abstained")).when(ebit.isNotNull() & (cap > 0), s(ebit / cap, "ebit_cap")).when(pe > 0, s(1 / pe, "pe")).otherwise(s(none, "abstained"))


def price_to_book(vendor: Column, cap: Column, equity: Column) -> Column:
    return F.coalesce(F.when(vendor > 0, vendor), F.when(at(equity, 0) > 0, cap / at(equity, 0)))


def return_on_equity(vendor: Column, net_income: Column, equity: Column) -> Column:
    mean = F.when(at(equity, 1).isNull(), at(equity, 0)).otherwise((at(equity, 0) + at(equity, 1)) / 2)
    return F.coalesce(vendor, F.when(mean > 0, at(net_income, 0) / mean))
