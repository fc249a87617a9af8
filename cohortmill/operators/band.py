"""The valuation band: where today's multiple stands among its month ends of some years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import backward
from .prices import month_end_closes
from .rank import newest, standing

#: Days from a statement's end until it counts as known; oldest month end that may stand for today.
LAG_DAYS, STALE_DAYS = 90, 45


def multiples(bars: DataFrame, statements: DataFrame, shares: DataFrame, years: int, as_of: Column) -> DataFrame:
    """statements: (ticker, period_end, value); shares: (ticker, shares, net_debt). ticker, day, multiple of each month end with a known positive value."""
    window = bars.where((F.col("day") > F.add_months(as_of, -12 * years)) & (F.col("day") <= as_of))
    ends = month_end_closes(window)
    known = backward(ends, statements, "ticker", "day", "period_end", "value", LAG_DAYS)
    m = known.join(shares, "ticker").withColumn("multiple", F.when(F.col("value") > 0, (F.col("close") * F.col("shares") + F.coalesce("net_debt", F.lit(0.0))) / F.col("value")))
    return m.select("ticker", "day", "multiple")


def band(bars: DataFrame, statements: DataFrame, shares: DataFrame, as_of: Column, years: int = 5, min_years: int = 3) -> DataFrame:
    """ticker, percentile, current, n_months, covered, note: the first reason to abstain, in order; standing: the percentile whether or not there is one."""
    m = newest(multiples(bars, statements, shares, years, as_of), "day", "multiple")
    a = m.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_months"), F.count("multiple").alias("covered"), F.min(F.when(F.col("multiple").isNotNull(), F.col("day"))).alias("first"), F.max(F.when(F.col("multiple").isNotNull(), F.col("day"))).alias("last"), F.max("current").alias("current"), standing("multiple", F.count("multiple")).alias("standing"))
    note = F.when(F.col("n_months") < 2, "fewer than two months").when(F.col("covered") < 2, "fewer than two covered months").when(F.months_between("last", "first") < 12 * min_years - 1, "span too short").when(F.col("covered") / F.col("n_months") < 0.5, "coverage below half").when(F.date_diff(as_of, "last") > STALE_DAYS, "newest month is stale")
    j = a.withColumn("note", note)
    return j.select("ticker", F.when(F.col("note").isNull(), F.col("standing")).alias("percentile"), F.when(F.col("note").isNull(), F.col("current")).alias("current"), "n_months", "covered", "note", "standing")


def choose_basis(ebit: Column, net_income: Column, debt: Column, cash: Column, debt_now: Column, cash_now: Column) -> Column:
    """struct(basis, net_debt_basis) from arrays of dated values: EBIT over enterprise value where EBIT and a net debt, dated or the latest, are known; else
    price over net income; else null. A net debt that is not known is never taken for zero."""
    some = lambda a: F.coalesce(F.size(F.filter(a, lambda v: v.isNotNull())) > 0, F.lit(False))
    out = lambda b, n: F.struct(F.lit(b).cast("string").alias("basis"), F.lit(n).alias("net_debt_basis"))
    dated, latest = some(debt) & some(cash), debt_now.isNotNull() & cash_now.isNotNull()
    return F.when(some(ebit) & dated, out("ev_ebit", "asof")).when(some(ebit) & latest, out("ev_ebit", "latest")).when(some(net_income), out("pe", "")).otherwise(out(None, ""))


def net_debt(basis: Column, debt_known: Column, cash_known: Column, debt_now: Column, cash_now: Column) -> Column:
    """Debt less cash as known at a day (asof) or held at the latest figures (latest); null where either is not known."""
    return F.when(basis == "asof", debt_known - cash_known).when(basis == "latest", debt_now - cash_now)
