"""Figures of a vendor's info map that has holes: which field is taken when the first one is missing. Zero is a figure; a fund's zero is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import asset_kind, dividend_yield, number

# The vendor's names of fields.
FORWARD_RATE, TRAILING_RATE, TRAILING_YIELD, PERCENT_YIELD, FUND_YIELD, PAYOUT, EPS, KIND = "dividendRate", "trailingAnnualDividendRate", "trailingAnnualDividendYield", "dividendYield", "yield", "payoutRatio", "trailingEps", "quoteType"


def figure(info: Column, name: str) -> Column:
    """A finite number of map<string, string>; null where it is missing or none."""
    return number(F.try_element_at(info, F.lit(name)))


def looks_like_fund(info: Column) -> Column:
    """By its type, or by the yield that only funds have, which stays when the type is dropped."""
    return F.coalesce(asset_kind(F.try_element_at(info, F.lit(KIND))).isin("etf", "fund", "mutualfund"), F.lit(False)) | figure(info, FUND_YIELD).isNotNull()


def dividend_per_share(info: Column) -> Column:
    return F.coalesce(figure(info, FORWARD_RATE), figure(info, TRAILING_RATE))


def distribution_yield(info: Column) -> Column:
    """The first positive one of a fund's yields, as a fraction."""
    up = lambda c: F.when(c > 0, c)
    return dividend_yield(F.coalesce(up(figure(info, FUND_YIELD)), up(figure(info, TRAILING_YIELD)), up(figure(info, PERCENT_YIELD) / 100)))


def yield_of(info: Column) -> Column:
    """A yield as a fraction, of a fund or of a share."""
    return F.when(looks_like_fund(info), distribution_yield(info)).otherwise(dividend_yield(F.coalesce(figure(info, TRAILING_YIELD), figure(info, PERCENT_YIELD) / 100)))


def payout_ratio(info: Column) -> Column:
    """The vendor's ratio, else dividends by positive earnings."""
    eps = figure(info, EPS)
    return F.coalesce(figure(info, PAYOUT), F.when(eps > 0, dividend_per_share(info) / eps))
