"""Declared schemas of the market tables."""

from __future__ import annotations

from pyspark.sql import types as T

_D, _S, _DT, _L, _I, _B = T.DoubleType(), T.StringType(), T.DateType(), T.LongType(), T.IntegerType(), T.BooleanType()
_SERIES = T.ArrayType(_D)


def _of(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


BARS = _of(ticker=_S, day=_DT, open=_D, high=_D, low=_D, close=_D, adj_close=_D, volume=_L)
DIVIDENDS = _of(ticker=_S, ex_date=_DT, amount=_D)
CONSENSUS = _of(ticker=_S, recommendation_mean=_D, n_analysts=_I, target_mean_price=_D, current_price=_D)
STATEMENTS = _of(ticker=_S, line=_S, period_end=_DT, value=_D)
NEWS = _of(ticker=_S, published=_DT, headline=_S, source=_S)
TRENDS = _of(ticker=_S, period=_S, strong_buy=_I, buy=_I, hold=_I, sell=_I, strong_sell=_I)
ETF_STATIC = _of(ticker=_S, expense_ratio=_D, fund_size=_D, distribution_yield=_D, share_class=_S, domicile=_S, source=_S, as_of=_S, fund_size_currency=_S)
SNAPSHOTS = _of(snapshot_date=_DT, strategy=_S, universe_id=_S, ticker=_S, company_name=_S, verdict=_S, combined_rank=_D, price=_D, street_mean=_D, n_analysts=_I, target_mean=_D, notes=_S)
VERDICT_HISTORY = _of(ticker=_S, strategy_id=_S, run_at=_S, verdict=_S, confidence=_D, is_override=_B)
CALLS = _of(call_id=_S, tool_name=_S, output=_S)
FIGURES = _of(figure_id=_S, call_id=_S, field_path=_S, value=_D)
UNIVERSE = _of(universe_id=_S, ord=_I, ticker=_S)
#: Annual lines, newest first, as arrays of an instrument.
SERIES = ("total_revenue", "operating_income", "tax_provision", "pretax_income", "invested_capital", "shareholders_equity", "net_income", "free_cash_flow_annual", "operating_cash_flow_annual", "capital_expenditure_annual", "total_assets", "long_term_debt", "current_assets", "current_liabilities", "shares", "gross_profit")
SCALARS = ("market_cap", "dividend_yield", "dividend_per_share", "payout_ratio", "eps", "pe_ratio", "free_cash_flow", "dividends_paid", "total_debt", "total_cash", "debt_to_equity", "price_to_book", "return_on_equity", "net_expense_ratio", "fund_assets", "ebit")
INSTRUMENTS = T.StructType([*(T.StructField(c, _S) for c in ("ticker", "company_name", "sector", "currency", "financial_currency", "quote_type")), *(T.StructField(c, _D) for c in SCALARS), T.StructField("dividend_streak_years", _I), T.StructField("last_dividend_reduction_year", _I), *(T.StructField(c, _SERIES) for c in SERIES)])
