"""Queries that show single operators: all criteria, all factors, parsers, the catalog, universes, entry points, display. They add to ``queries.QUERIES``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import clean, display, text, venue
from .functions import statements as st
from .operators import band, decision, reporting, screen
from .operators import factors as fac
from .plans import pipeline
from .plans.strategy import RANKS, SCREENS, ScreenStrategy
from .queries import ANNUAL, BARS, INSTRUMENTS, SCREEN_CTES, SERIES4, TECH, YEARS, _screen, query, r, with_
from .sources import catalog, market, parsers, universes
from .sources.market import table

# Inputs with every field that a factor or criterion reads, holes among them. k is the number in the ticker.
_K = "CAST(substring(i.ticker, 2) AS BIGINT)"
WIDE = f"""w AS (SELECT i.ticker, {_K} AS k, market_cap AS m, currency, last_close, return_12m, return_6m, volatility, rg, gg, ny, roic, r0, g0, g1,
  CASE WHEN {_K} % 4 <> 0 THEN market_cap / 20 END AS ebit, CASE WHEN {_K} % 3 <> 0 THEN market_cap / 2 END AS debt, CASE WHEN {_K} % 3 <> 0 THEN market_cap / 10 END AS cash, CASE WHEN market_cap > 0 THEN market_cap / 100 END AS pe,
  CASE WHEN {_K} % 6 <> 0 THEN {_K} % 9 / 100.0 END AS dy, CASE WHEN {_K} % 5 <> 0 THEN {_K} % 7 / 1000.0 END AS fee, CASE WHEN {_K} % 5 <> 1 THEN {_K} * 1e6 END AS assets, CASE WHEN {_K} % 4 = 1 THEN {_K} / 10.0 END AS pb, CASE WHEN {_K} % 4 = 2 THEN {_K} / 1000.0 END AS roe,
  CASE WHEN {_K} % 8 <> 0 THEN CAST({_K} % 10 AS INT) END AS fs, CASE WHEN {_K} % 9 <> 0 THEN {_K} % 100 * 1.0 END AS bp, CASE WHEN {_K} % 7 <> 0 THEN CAST({_K} % 30 AS INT) END AS streak, CASE WHEN {_K} % 7 <> 1 THEN CAST({_K} % 25 AS INT) END AS growing,
  CASE WHEN {_K} % 10 <> 0 THEN {_K} % 10 - 2.0 END AS dps, CASE WHEN {_K} % 11 <> 0 THEN {_K} % 12 / 10.0 - 0.1 END AS payout
  FROM instruments i LEFT JOIN tech t ON t.ticker = i.ticker LEFT JOIN growth g ON g.ticker = i.ticker)"""
WIDE_CTES = with_(BARS, INSTRUMENTS, TECH, ANNUAL, YEARS, SERIES4, WIDE)


def _wide(spark, sf) -> DataFrame:
    k = F.substring("ticker", 2, 20).cast("long")
    m, on = F.col("market_cap"), lambda n, c, v: F.when(k % n != c, v)
    s = market.series(market.annual(spark, sf), {"shareholders_equity": "revenue", "net_income": "gross"})
    return market.inputs(spark, sf).join(s, "ticker", "left").withColumns({
        "ebit": on(4, 0, m / 20), "total_debt": on(3, 0, m / 2), "total_cash": on(3, 0, m / 10), "dividend_yield": on(6, 0, k % 9 / 100), "net_expense_ratio": on(5, 0, k % 7 / 1000), "fund_assets": on(5, 1, k * 1e6), "price_to_book": F.when(k % 4 == 1, k / 10), "return_on_equity": F.when(k % 4 == 2, k / 1000),
        "f_score": on(8, 0, (k % 10).cast("int")), "band_percentile": on(9, 0, (k % 100).cast("double")), "dividend_streak_years": on(7, 0, (k % 30).cast("int")), "growth_streak": on(7, 1, (k % 25).cast("int")), "dividend_per_share": on(10, 0, k % 10 - 2.0), "payout_ratio": on(11, 0, k % 12 / 10 - 0.1),
    })


_EY = "CASE WHEN ebit IS NOT NULL AND m + debt - cash > 0 THEN {a} WHEN ebit IS NOT NULL AND m + debt - cash IS NOT NULL THEN {b} WHEN ebit IS NOT NULL AND m > 0 THEN {c} WHEN pe > 0 THEN {d} ELSE {b} END"
_FACTORS = {
    "earnings_yield": (_EY.format(a="ebit / (m + debt - cash)", b="NULL", c="ebit / m", d="1 / pe"), _EY.format(a="'ebit_ev'", b="'abstained'", c="'ebit_cap'", d="'pe'")),
    "net_payout_yield": ("dy", "CASE WHEN dy IS NULL THEN 'abstained' ELSE 'dividend_yield_fallback' END"),
    "price_to_book": ("CASE WHEN pb > 0 THEN pb WHEN r0 > 0 THEN m / r0 END", None), "return_on_equity": ("CASE WHEN roe IS NOT NULL THEN roe WHEN r1 IS NULL AND r0 > 0 THEN g0 / r0 WHEN (r0 + r1) > 0 THEN g0 / ((r0 + r1) / 2) END", None),
    "dividend_streak": ("streak", None), "distribution_yield": ("dy", None), "expense_ratio": ("fee", None), "fund_size": ("assets", None), "piotroski_f_score": ("fs", None), "valuation_band_percentile": ("bp", None),
    "roic": ("roic", None), "momentum_12m": ("return_12m", None), "momentum_6m": ("return_6m", None), "low_volatility": ("volatility", None), "revenue_growth": ("rg", None),
}


def _factor_query(name: str, these: tuple[str, ...]):
    cells = " UNION ALL ".join(f"SELECT ticker, '{f}' AS factor, CAST({v} AS DOUBLE) AS v, {s or f'CASE WHEN ({v}) IS NULL THEN {chr(39)}abstained{chr(39)} ELSE {chr(39)}computed{chr(39)} END'} AS source FROM w" for f, (v, s) in _FACTORS.items() if f in these)

    def run(spark, sf):
        wide = _wide(spark, sf).withColumn("static_sources", F.create_map().cast("map<string,string>"))
        return fac.outcomes(wide, list(these)).select("ticker", "factor", r("value").alias("value"), "source")

    run.__name__ = name
    query(WIDE_CTES.replace("roic, r0, g0, g1,", "roic, r0, r1, g0, g1,") + f"SELECT ticker, factor, round(v, 6) AS value, source FROM ({cells})")(run)


_factor_query("factor_earnings_yield", ("earnings_yield",))
_factor_query("factor_payout_and_distribution", ("net_payout_yield", "distribution_yield"))
_factor_query("factor_book_values", ("price_to_book", "return_on_equity"))
_factor_query("factor_fund_fields", ("expense_ratio", "fund_size"))
_factor_query("factor_scores", ("piotroski_f_score", "valuation_band_percentile", "dividend_streak"))
_factor_query("factor_prices", ("momentum_12m", "momentum_6m", "low_volatility"))
_factor_query("factor_growth_and_roic", ("revenue_growth", "roic"))

_CRITERIA = {
    "min_dividend_yield": (0.03, "CASE WHEN dps <= 0 THEN 0.0 WHEN last_close > 0 THEN dps / last_close END", "CASE WHEN dps <= 0 THEN false ELSE {o} >= {t} END"),
    "max_payout_ratio": (0.6, "CASE WHEN coalesce(dps > 0, false) THEN payout END", "CASE WHEN {o} < 0 THEN false ELSE {o} <= {t} END"),
    "min_dividend_growth_streak": (10.0, "growing", "{o} >= {t}"), "min_dividend_streak": (12.0, "streak", "{o} >= {t}"), "min_f_score": (6.0, "fs", "{o} >= {t}"), "valuation_band_percentile": (50.0, "bp", "{o} <= {t}"),
}


def _criterion_query(name: str, these: tuple[str, ...]):
    sql = " UNION ALL ".join(f"SELECT ticker, '{c}' AS criterion, CAST({_CRITERIA[c][1]} AS DOUBLE) AS o, {_CRITERIA[c][2].format(o='(' + _CRITERIA[c][1] + ')', t=_CRITERIA[c][0])} AS passed, CAST({_CRITERIA[c][0]} AS DOUBLE) AS threshold FROM w" for c in these)

    def run(spark, sf):
        x = screen.run_screen(_wide(spark, sf), [(c, _CRITERIA[c][0]) for c in these])
        return x.select("ticker", "criterion", r("observed").alias("observed"), "passed", "threshold")

    run.__name__ = name
    query(WIDE_CTES + f"SELECT ticker, criterion, round(o, 6) AS observed, passed, threshold FROM ({sql})")(run)


_criterion_query("criterion_dividend_yield", ("min_dividend_yield",))
_criterion_query("criterion_payout_ratio", ("max_payout_ratio",))
_criterion_query("criterion_streaks", ("min_dividend_growth_streak", "min_dividend_streak"))
_criterion_query("criterion_scores", ("min_f_score", "valuation_band_percentile"))


# Three more lines of statements, each with its own numbers, for the nine checks.
LINES = """ln AS (SELECT ticker, k, gross AS ni, revenue * 2 AS assets, tax * 3 AS ocf, CASE WHEN k % 2 = 1 THEN quantity * 10 ELSE quantity * 12 END AS ltd, gross + tax AS ca, quantity * 5 + tax AS cl, floor(quantity / 100) AS shares, gross * 0.4 + tax AS gp, revenue FROM yrs WHERE k <= 2),
p2 AS (SELECT a.ticker, a.ni, a.assets, a.ocf, a.ltd, a.ca, a.cl, a.shares, a.gp, a.revenue, b.ni AS ni0, b.assets AS assets0, b.ltd AS ltd0, b.ca AS ca0, b.cl AS cl0, b.shares AS shares0, b.gp AS gp0, b.revenue AS revenue0 FROM ln a LEFT JOIN ln b ON b.ticker = a.ticker AND b.k = 2 WHERE a.k = 1),
ck AS (SELECT ticker, [ni / assets > 0, ocf > 0, ni / assets > ni0 / assets0, ocf > ni, ltd / assets < ltd0 / assets0, ca / cl > ca0 / cl0, shares <= shares0, gp / revenue > gp0 / revenue0, revenue / assets > revenue0 / assets0] AS checks FROM p2)"""


@query(with_(ANNUAL, YEARS, LINES) + "SELECT ticker, checks, len(list_filter(checks, lambda x: x))::INT AS points, CASE WHEN len(list_filter(checks, lambda x: x IS NOT NULL)) >= 5 THEN len(list_filter(checks, lambda x: x))::INT END AS score FROM ck")
def fscore_distinct_lines(spark, sf):
    """The nine checks over nine lines that all differ."""
    s = market.series(market.annual(spark, sf), {"revenue": "revenue", "gross": "gross", "tax": "tax", "q": "quantity"})

    def of(i):
        v = lambda c: st.at(F.col(c), i)
        return {"ni": v("gross"), "assets": v("revenue") * 2, "ocf": v("tax") * 3, "ltd": v("q") * (12 if i else 10), "ca": v("gross") + v("tax"), "cl": v("q") * 5 + v("tax"), "shares": F.floor(v("q") / 100), "gp": v("gross") * 0.4 + v("tax"), "revenue": v("revenue")}

    x = s.select("ticker", st.f_score_checks(of(0), of(1)).alias("checks")).withColumn("f", st.f_score(F.col("checks")))
    return x.select("ticker", "checks", "f.points", "f.score")


# Decisions -----------------------------------------------------------------------------------------


@query(SCREEN_CTES.rstrip() + """, op AS (SELECT 'S' || (user_id % 100 + 1) AS ticker, sum(CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN -1.0 ELSE 0.0 END * CASE WHEN value IS NULL THEN 0 ELSE least(1.0, value / 500) END * 0.02) AS st FROM events GROUP BY 1),
ps AS (SELECT ticker, criterion, passed, CASE WHEN criterion = 'min_price_momentum' THEN CASE WHEN observed IS NULL THEN 0.0 ELSE greatest(-0.3, least(0.3, observed)) * 4 END WHEN passed IS NULL THEN 0.0 WHEN observed IS NULL OR threshold = 0 THEN CASE WHEN passed THEN w ELSE -w END ELSE w * greatest(-1.0, least(1.0, CASE WHEN criterion LIKE 'max~_%' ESCAPE '~' THEN -1.0 ELSE 1.0 END * (observed - threshold) / abs(threshold))) END AS points
 FROM (SELECT *, CASE criterion WHEN 'min_roic' THEN 0.5 WHEN 'max_debt_to_market_cap' THEN 2.0 ELSE 0.0 END AS w FROM sc)),
a AS (SELECT ticker, sum(points) AS s, coalesce(bool_or(criterion = 'min_market_cap' AND passed = false), false) AS gated, bool_or(criterion = 'min_market_cap' AND passed IS NULL) AS open FROM ps GROUP BY 1),
z AS (SELECT a.ticker, gated, open, s + coalesce(st, 0) AS s FROM a LEFT JOIN op ON op.ticker = a.ticker)
SELECT ticker, CASE WHEN NOT gated AND NOT open THEN round(s, 6) END AS score, CASE WHEN gated THEN 'SELL' WHEN open THEN 'INSUFFICIENT' WHEN s >= 0.8 THEN 'BUY' WHEN s <= 0.2 THEN 'SELL' ELSE 'HOLD' END AS verdict, NOT gated AND NOT open AND (abs(s - 0.8) <= 0.1 OR abs(s - 0.2) <= 0.1) AS borderline FROM z""")
def decision_matrix_full(spark, sf):
    """Criteria, the signed return, and stances."""
    e, t = table(spark, sf, "events"), F.col("event_type")
    op = e.select(F.concat(F.lit("S"), (F.col("user_id") % 100 + 1).cast("string")).alias("ticker"), F.when(t == "purchase", "bullish").when(t == "click", "bearish").otherwise("neutral").alias("stance"), F.least(F.lit(1.0), F.col("value") / 500).alias("confidence"))
    m = decision.matrix(_screen(spark, sf), {"min_roic": 0.5, "max_debt_to_market_cap": 2.0}, ["min_market_cap"], 0.8, 0.2, momentum=(0.3, 4.0), opinions=op, stance_weight=0.02)
    return m.select("ticker", r("score").alias("score"), "verdict", "borderline")


@query(SCREEN_CTES + "SELECT ticker, round(CASE WHEN observed IS NULL THEN 0.0 ELSE greatest(-0.3, least(0.3, observed)) * 4 END, 6) AS points FROM sc WHERE criterion = 'min_price_momentum'")
def momentum_points(spark, sf):
    return _screen(spark, sf).where("criterion = 'min_price_momentum'").select("ticker", r(decision.momentum_points(F.col("observed"), 0.3, 4.0)).alias("points"))


ONE = ScreenStrategy("one_v1", (("min_market_cap", 2000.0), ("min_roic", 0.9), ("min_price_momentum", -0.1)), ("min_market_cap",), {"min_roic": 2.0}, 0.5, 0.0)
ONE_SQL = SCREEN_CTES.rstrip() + """, ps AS (SELECT ticker, criterion, passed, CASE WHEN criterion = 'min_price_momentum' THEN CASE WHEN observed IS NULL THEN 0.0 ELSE greatest(-0.5, least(0.5, observed)) * 1 END WHEN passed IS NULL OR criterion = 'min_market_cap' THEN 0.0 ELSE 2.0 * greatest(-1.0, least(1.0, (observed - threshold) / abs(threshold))) END AS points FROM sc WHERE criterion IN ('min_market_cap', 'min_roic', 'min_price_momentum')),
a AS (SELECT ticker, sum(points) AS s, coalesce(bool_or(criterion = 'min_market_cap' AND passed = false), false) AS gated, bool_or(criterion = 'min_market_cap' AND passed IS NULL) AS open FROM ps GROUP BY 1),
rk AS (SELECT inp.ticker, ny IS NOT NULL OR market_cap IS NOT NULL AS known, CASE WHEN gated THEN 'SELL' WHEN open THEN 'INSUFFICIENT' WHEN s >= 0.5 THEN 'BUY' WHEN s <= 0 THEN 'SELL' ELSE 'HOLD' END AS verdict, CASE WHEN NOT gated AND NOT open THEN round(s, 6) END AS score, gated OR open AS gated FROM inp JOIN a ON a.ticker = inp.ticker)
"""


def _one(spark, sf) -> DataFrame:
    return pipeline.screen_ranking(market.inputs(spark, sf), ONE, momentum=(0.5, 1.0)).withColumn("score", r("score"))


@query(ONE_SQL + "SELECT ticker, verdict, score, gated, CAST(NULL AS VARCHAR) AS error FROM rk")
def screen_ranking(spark, sf):
    """Each name by its screen alone."""
    return _one(spark, sf)


@query(ONE_SQL + "SELECT ticker, CASE WHEN gated THEN 'gated' ELSE 'scored' END AS part, CASE WHEN NOT gated THEN CAST(row_number() OVER (PARTITION BY gated ORDER BY score DESC, ticker) AS INT) END AS scored_at FROM rk")
def split_rankings(spark, sf):
    return pipeline.split_rankings(_one(spark, sf)).select("ticker", "part", "scored_at")


from .queries import _QUINTILE, _RANKED, RANK3, SIZE_ALL, _rank_sql, _values  # noqa: E402
from .operators import rank  # noqa: E402


@query(_rank_sql(SIZE_ALL) + f", v AS ({_RANKED.format(v=_QUINTILE)}) SELECT 'all' AS runs_on, ticker FROM v UNION ALL SELECT 'top_k', ticker FROM v WHERE seq <= 7 UNION ALL SELECT 'buy_quintile', ticker FROM v WHERE verdict = 'buy'")
def shortlists(spark, sf):
    x = rank.rank_universe(_values(spark, sf), RANK3).withColumn("status", F.lit("ranked"))
    out = None
    for on in ("all", "top_k", "buy_quintile"):
        part = pipeline.shortlist(x, on, 7).select(F.lit(on).alias("runs_on"), "ticker")
        out = part if out is None else out.unionByName(part)
    return out


@query("""WITH p AS (SELECT o_custkey, o_orderstatus AS v, count(*) AS k FROM orders GROUP BY 1, 2), g AS (SELECT o_custkey, max(k) / sum(k)::DOUBLE AS share FROM p GROUP BY 1)
SELECT CASE WHEN share = 1 THEN 'stable' WHEN share >= 0.8 THEN 'mostly stable' WHEN share > 0.5 THEN 'leaning' ELSE 'unstable' END AS label, count(*) AS names FROM g GROUP BY 1""")
def stability_labels(spark, sf):
    runs = table(spark, sf, "orders").select(F.col("o_custkey").alias("ticker"), F.col("o_orderstatus").alias("verdict"), F.lit(0.5).alias("confidence"))
    return decision.stability(runs).groupBy("label").agg(F.count(F.lit(1)).alias("names"))


@query("""WITH p AS (SELECT user_id, event_type AS agent, CASE WHEN value > 100 THEN 'BUY' ELSE 'HOLD' END AS v, count(*) AS k FROM events GROUP BY 1, 2, 3)
SELECT user_id, agent, arg_min(v, (-k, v)) AS modal, max(k) AS modal_n, sum(k)::BIGINT AS n FROM p GROUP BY 1, 2""".replace("arg_min(v, (-k, v))", "min_by(v, (-k) * 10 + CASE v WHEN 'BUY' THEN 0 ELSE 1 END)"))
def stability_per_agent(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_type").alias("agent"), F.when(F.col("value") > 100, "BUY").otherwise("HOLD").alias("verdict"), F.lit(1.0).alias("confidence"))
    return decision.stability(e, ("user_id", "agent")).select("user_id", "agent", "modal", "modal_n", "n")


@query("SELECT l_orderkey, l_linenumber, round_even(0.3 * CASE WHEN l_linenumber % 3 = 0 THEN 1.0 ELSE greatest(0.0, least(1.0, l_quantity / 40)) END + 0.2 * greatest(0.0, least(1.0, l_discount * 20)) + 0.25 * 1.0 + 0.15 * greatest(0.0, least(1.0, l_tax * 10)) + 0.1 * CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE 1.0 END, 4) AS score FROM lineitem WHERE l_orderkey % 10 = 3".replace(" WHERE l_orderkey % 10 = 3", ""))
def coverage_components(spark, sf):
    """Five components, one not measured on some rows, one never."""
    c = F.col
    parts = {"criteria": F.when(c("l_linenumber") % 3 != 0, c("l_quantity") / 40), "factors": c("l_discount") * 20, "provenance": F.lit(None).cast("double"), "fundamentals": c("l_tax") * 10, "price": F.when(c("l_returnflag") == "R", 0.0).otherwise(1.0)}
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", decision.coverage_score(parts).alias("score"))


# Valuation basis -----------------------------------------------------------------------------------


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 = 0 THEN 'ev_ebit' WHEN s_suppkey % 2 = 0 AND s_acctbal > 0 THEN 'ev_ebit' WHEN s_suppkey % 5 <> 0 THEN 'pe' END AS basis, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 = 0 THEN 'asof' WHEN s_suppkey % 2 = 0 AND s_acctbal > 0 THEN 'latest' ELSE '' END AS net_debt_basis,
CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 = 0 THEN 7.0 WHEN s_suppkey % 2 = 0 AND s_acctbal > 0 THEN round(s_acctbal - 100, 6) END AS net_debt FROM supplier""")
def valuation_basis(spark, sf):
    k, a = F.col("s_suppkey"), F.col("s_acctbal")
    some = lambda c: F.array(F.when(c, 1.0))
    now = F.when(a > 0, a)
    b = band.choose_basis(some(k % 2 == 0), some(k % 5 != 0), some(k % 3 == 0), some(k % 3 == 0), now, F.lit(100.0))
    x = table(spark, sf, "supplier").select("s_suppkey", b.alias("b"), now.alias("now"))
    return x.select("s_suppkey", "b.basis", "b.net_debt_basis", r(band.net_debt(F.col("b.net_debt_basis"), F.lit(10.0), F.lit(3.0), F.col("now"), F.lit(100.0))).alias("net_debt"))


# Parsers -------------------------------------------------------------------------------------------

_PAYLOAD = "annual_map AS (SELECT ticker, list(revenue ORDER BY year DESC) AS total_revenue, list(gross ORDER BY year DESC) AS operating_income, list(CASE WHEN year % 2 = 0 THEN tax END ORDER BY year DESC) AS tax, list(year ORDER BY year DESC) AS years FROM annual GROUP BY 1)"


def _payloads(spark, sf) -> DataFrame:
    a = market.annual(spark, sf)
    year = F.struct(F.col("revenue").cast("string").alias("totalRevenue"), F.col("gross").cast("string").alias("operatingIncome"), F.when(F.col("year") % 2 == 0, F.col("tax").cast("string")).otherwise("None").alias("netIncome"))
    y = a.groupBy("ticker").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.col("year").cast("string"), F.lit("-12-31")), year))).alias("yearly"))
    i = market.instruments(spark, sf).join(y, "ticker", "left")
    general = F.struct(F.col("company_name").alias("Name"), F.when(F.col("currency") == "EUR", "NA").otherwise(F.col("sector")).alias("Sector"), F.col("currency").alias("CurrencyCode"), F.col("quote_type").alias("Type"))
    high = F.struct(F.col("market_cap").cast("string").alias("MarketCapitalization"), F.lit("-").alias("PERatio"), F.lit(" 0.02 ").alias("DividendYield"), F.lit("").alias("EarningsShare"))
    fin = F.struct(F.struct(F.col("yearly")).alias("Income_Statement"))
    return i.select(F.concat(F.lit(" "), F.lower("ticker"), F.lit(".. ")).alias("ticker"), F.to_json(F.struct(general.alias("General"), high.alias("Highlights"), fin.alias("Financials"))).alias("json"))


@query(with_(INSTRUMENTS) + "SELECT ticker, company_name, CASE WHEN currency <> 'EUR' THEN sector END AS sector, currency, quote_type, market_cap, CAST(NULL AS DOUBLE) AS pe_ratio, 0.02::DOUBLE AS dividend_yield, CAST(NULL AS DOUBLE) AS eps FROM instruments")
def payload_fields(spark, sf):
    """Scalars of a nested payload: sentinels are null, texts are numbers."""
    return parsers.fundamentals(_payloads(spark, sf)).select("ticker", "company_name", "sector", "currency", "quote_type", "market_cap", "pe_ratio", "dividend_yield", "eps")


@query(with_(INSTRUMENTS, ANNUAL, _PAYLOAD) + "SELECT ticker, total_revenue, operating_income, list_filter(tax, lambda v: v IS NOT NULL) AS net_income FROM annual_map")
def payload_series(spark, sf):
    """Annual series, newest first, holes dropped."""
    return parsers.fundamentals(_payloads(spark, sf)).where("total_revenue is not null").select("ticker", "total_revenue", "operating_income", "net_income")


@query(with_(ANNUAL) + "SELECT ticker, CAST(row_number() OVER (PARTITION BY ticker ORDER BY year DESC) - 1 AS INT) AS i, make_date(year, 12, 31) AS period_end, CASE WHEN year % 2 = 0 THEN tax END AS value FROM annual")
def payload_aligned(spark, sf):
    """The aligned series keeps holes."""
    p = _payloads(spark, sf).withColumn("p", F.from_json("json", parsers.PAYLOAD))
    s = parsers.aligned_series(F.col("p.Financials.Income_Statement.yearly"), "netIncome")
    return p.select(clean.ticker(F.col("ticker")).alias("ticker"), F.posexplode(s).alias("i", "x")).select("ticker", "i", "x.period_end", "x.value")


@query("SELECT 'S' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS ex_date, l_quantity AS amount FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber % 4 <> 0 AND l_shipdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1999-12-31'")
def dividend_payload(spark, sf):
    """Dividend rows of a payload in a range; amounts that are not positive go."""
    li = table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    one = F.array(F.struct(F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.when(F.col("l_linenumber") % 4 == 0, "0").otherwise(F.col("l_quantity").cast("string")).alias("value")))
    return parsers.dividend_events(li.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"), F.to_json(one).alias("json")), "1998-01-01", "1999-12-31")


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d FROM orders")
def any_dates(spark, sf):
    """Dates in four notations and one that is none."""
    d, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 5
    raw = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd.MM.yyyy")).when(k == 2, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T00:00:00"))).when(k == 3, (F.unix_date(d).cast("long") * 86_400_000).cast("string")).otherwise("soon")
    return table(spark, sf, "orders").select("o_orderkey", clean.any_date(raw).alias("d"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size / 2500.0 ELSE p_size / 100.0 END AS yield, CASE WHEN p_size % 3 = 0 THEN 'EUR' END AS code FROM part".replace("CASE WHEN p_size > 25 THEN p_size / 2500.0 ELSE p_size / 100.0 END", "CASE WHEN p_size / 25.0 > 1 THEN round(p_size / 2500.0, 9) ELSE round(p_size / 25.0, 9) END"))
def yields_and_codes(spark, sf):
    """A yield above 1 is a percentage; a code has three letters."""
    v, k = F.col("p_size") / 25, F.col("p_size") % 3
    return table(spark, sf, "part").select("p_partkey", r(clean.dividend_yield(v), 9).alias("yield"), clean.currency(F.when(k == 0, " eur ").when(k == 1, "EU").otherwise(None)).alias("code"))


# Catalog -------------------------------------------------------------------------------------------


@query(with_(BARS) + "SELECT ticker, day, close FROM bars WHERE day BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' AND volume % 5 <> 0")
def catalog_prices(spark, sf):
    """Bars of one provider in a range of days; a bar with a hole is left out."""
    b = market.bars(spark, sf).withColumns({"open": F.col("close"), "high": F.col("close"), "low": F.col("close"), "adj_close": F.when(F.col("volume") % 5 != 0, F.col("close")), "close": F.when(F.col("volume") % 5 != 0, F.col("close"))})
    c = catalog.Catalog(spark, catalog.scratch(spark), {"bars": "vendor"})
    c.append(b.select("ticker", "day", "open", "high", "low", "close", "adj_close", "volume"), "bars")
    return c.prices("1998-01-01", "1998-12-31").select("ticker", "day", "close")


@query("WITH c AS (SELECT o_custkey AS k, round(avg(CAST(substring(o_orderpriority, 1, 1) AS INT)), 6) AS mean, CAST(count(*) AS INT) AS n FROM orders GROUP BY 1) SELECT 'C' || c_custkey AS ticker, mean AS recommendation_mean, n AS n_analysts FROM customer LEFT JOIN c ON k = c_custkey")
def catalog_consensus(spark, sf):
    """A row for each name that is asked for; unknown ones are null."""
    c = catalog.Catalog(spark, catalog.scratch(spark))
    none = F.lit(None).cast("double")
    c.append(market.consensus(spark, sf).select("ticker", F.col("mean").alias("recommendation_mean"), F.col("n_analysts").cast("int").alias("n_analysts"), none.alias("target_mean_price"), none.alias("current_price")), "consensus")
    names = table(spark, sf, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker"))
    return c.consensus_of(names).select("ticker", "recommendation_mean", "n_analysts")


@query("SELECT s_suppkey AS ticker, DATE '2001-01-01' AS snapshot_date, s_name AS verdict, CAST(NULL AS VARCHAR) AS company_name FROM supplier UNION ALL SELECT s_suppkey, DATE '2001-02-01', s_name, upper(s_name) FROM supplier")
def catalog_snapshots(spark, sf):
    """Snapshots are appended; files from before a column was added show null."""
    c = catalog.Catalog(spark, catalog.scratch(spark))
    s = table(spark, sf, "supplier")
    for day, more in (("2001-01-01", []), ("2001-02-01", [F.upper("s_name").alias("company_name")])):
        c.append(s.select(F.col("s_suppkey").alias("ticker"), F.lit(day).cast("date").alias("snapshot_date"), F.col("s_name").alias("verdict"), *more), "snapshots", ["snapshot_date"])
    return c.snapshots().select("ticker", F.col("snapshot_date").cast("date").alias("snapshot_date"), "verdict", "company_name")


@query("SELECT n_nationkey, n_name, 'run-1' AS run_id FROM nation")
def catalog_replay(spark, sf):
    """A run's inputs are frozen and read again."""
    c = catalog.Catalog(spark, catalog.scratch(spark))
    c.freeze({"nation": table(spark, sf, "nation")}, "run-1")
    return c.frozen("run-1").read("nation").select("n_nationkey", "n_name", F.lit("run-1").alias("run_id"))


# Universes -----------------------------------------------------------------------------------------

MANIFESTS = with_(INSTRUMENTS, "u AS (SELECT lower(sector) || CASE WHEN sector = 'ASIA' THEN '' ELSE '_v1' END AS id, list(ticker ORDER BY ticker) AS tickers FROM instruments GROUP BY sector)")


def _manifests(spark, sf) -> DataFrame:
    """A manifest for each sector; one lacks a version. Members are written badly and twice."""
    i = market.instruments(spark, sf)
    m = i.groupBy("sector").agg(F.array_sort(F.collect_list("ticker")).alias("t"))
    shown = F.concat(F.transform("t", lambda x: F.concat(F.lit(" "), F.lower(x), F.lit("."))), F.col("t"), F.array(F.lit("")))
    ident = F.concat(F.lower("sector"), F.when(F.col("sector") == "ASIA", "").otherwise("_v1"))
    blank = F.lit(None).cast("string")
    return m.select(ident.alias("id"), blank.alias("display_name"), blank.alias("role"), blank.alias("description"), shown.alias("tickers"), blank.alias("created"), blank.alias("rationale"), (F.col("sector") == "AFRICA").alias("local"))


@query(MANIFESTS + "SELECT id, id AS display_name, tickers, id = 'africa_v1' AS local FROM u WHERE id <> 'asia'")
def universes_listed(spark, sf):
    """What cannot be used is left out; members are compared, each once."""
    return universes.listed(_manifests(spark, sf)).select("id", "display_name", "tickers", "local")


@query(MANIFESTS + "SELECT CAST(generate_subscripts(tickers, 1) - 1 AS INT) AS ord, unnest(tickers) AS ticker FROM u WHERE id = 'europe_v1'")
def universe_by_id(spark, sf):
    return universes.by_id(_manifests(spark, sf), "europe_v1")


@query(MANIFESTS + "SELECT id, tickers, true AS local FROM u WHERE id <> 'asia'")
def universe_saved(spark, sf):
    """Personal lists are saved, found again and marked."""
    folder = catalog.scratch(spark)
    universes.save_local(_manifests(spark, sf).drop("local"), folder)
    return universes.listed(universes.read(spark, folder)).select("id", "tickers", "local")


# Display -------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, p_type || ': 1.23 vs 4.50' AS short, CASE WHEN lower(split_part(p_name, ' ', 1)) IN ('the', 'inc', 'co', 'group') THEN lower(split_part(p_name, ' ', 2)) ELSE lower(split_part(p_name, ' ', 1)) END AS brand, NOT contains(lower(p_brand), CASE WHEN lower(split_part(p_name, ' ', 1)) IN ('the', 'inc', 'co', 'group') THEN lower(split_part(p_name, ' ', 2)) ELSE lower(split_part(p_name, ' ', 1)) END) AS suspect FROM part""")
def reasons_and_brands(spark, sf):
    t = table(spark, sf, "part")
    return t.select("p_partkey", display.short_reason(F.concat(F.lit("screen: "), "p_type", F.lit(": 1.2345 against 4.5000"))).alias("short"), display.brand_token(F.col("p_name")).alias("brand"), display.suspect_mapping(F.col("p_brand"), F.col("p_name")).alias("suspect"))


@query("SELECT s_suppkey, CASE WHEN abs(s_acctbal) >= 1000 THEN NULL ELSE printf('%.0f', s_acctbal) END AS compact, CASE s_suppkey % 3 WHEN 0 THEN 'IE' WHEN 1 THEN 'DE' ELSE 'Narnia' END AS country, printf('about %.2f a year per 1,000 held', (s_suppkey % 50) / 100.0 * 10) AS gloss FROM supplier WHERE abs(s_acctbal) >= 0".replace("CASE WHEN abs(s_acctbal) >= 1000 THEN NULL ELSE printf('%.0f', s_acctbal) END", "CASE s_suppkey % 4 WHEN 0 THEN '4.17bn' WHEN 1 THEN '950k' WHEN 2 THEN '12.5m' ELSE '7' END"))
def compact_amounts(spark, sf):
    k = F.col("s_suppkey")
    v = F.when(k % 4 == 0, 4172812800.0).when(k % 4 == 1, 950_000.0).when(k % 4 == 2, 12_500_000.0).otherwise(7.0)
    country = F.when(k % 3 == 0, " Ireland ").when(k % 3 == 1, "GERMANY").otherwise("Narnia")
    return table(spark, sf, "supplier").select("s_suppkey", venue.compact_amount(v).alias("compact"), venue.country_code(country).alias("country"), display.fee_gloss((k % 50) / 100).alias("gloss"))


@query(_rank_sql(SIZE_ALL) + f", v AS (SELECT *, {_QUINTILE} AS verdict FROM ranked), b AS (SELECT a.ticker, a.combined, list_sort(list(b.ticker)) AS partners FROM v a JOIN v b ON a.combined = b.combined AND a.verdict <> b.verdict GROUP BY 1, 2) SELECT ticker, ticker || ' shares score ' || CASE WHEN combined = floor(combined) THEN CAST(CAST(combined AS BIGINT) AS VARCHAR) ELSE CAST(floor(combined) AS BIGINT)::VARCHAR || '.5' END || ' with ' || array_to_string(partners, ', ') || ' under another verdict' AS note FROM b")
def boundary_notes(spark, sf):
    b = rank.boundary_ties(rank.rank_universe(_values(spark, sf), RANK3))
    return b.select("ticker", display.boundary_note(F.col("ticker"), F.col("combined"), F.col("partners")).alias("note"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'n/a' WHEN o_orderkey % 4 = 1 THEN printf('%.1f', (o_orderkey % 100) / 100.0 * 100) || '%' WHEN o_orderkey % 4 = 2 THEN (o_orderkey % 10) || '/9' ELSE printf('%.2f', o_orderkey % 100 + 0.0) END AS shown FROM orders""")
def factor_cells(spark, sf):
    """A value by the kind of its factor."""
    k = F.col("o_orderkey")
    name = F.when(k % 4 == 1, "roic").when(k % 4 == 2, "piotroski_f_score").otherwise("price_to_book")
    v = F.when(k % 4 == 1, k % 100 / 100).when(k % 4 == 2, (k % 10).cast("double")).when(k % 4 == 3, (k % 100).cast("double"))
    return table(spark, sf, "orders").select("o_orderkey", display.factor_value(name, v, F.lit("USD")).alias("shown"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false ELSE false END AS transient FROM customer")
def transient_errors(spark, sf):
    k = F.col("c_custkey") % 4
    e = F.when(k == 0, "HTTP 503 from vendor").when(k == 1, "Read timed out").when(k == 2, "404 not found").otherwise(None)
    return table(spark, sf, "customer").select("c_custkey", venue.is_transient(e).alias("transient"))


@query("SELECT max(f) AS latest FROM (SELECT 'scan_' || strftime(max(o_orderdate), '%Y-%m-%d') || '_r2.csv' AS f FROM orders)")
def latest_scan(spark, sf):
    """The newest file by its date, then by its rerun."""
    d = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")).distinct()
    names = d.select(F.explode(F.array(F.concat(F.lit("scan_"), "d", F.lit(".csv")), F.concat(F.lit("scan_"), "d", F.lit("_r2.csv")))).alias("f"))
    return names.agg(F.max_by("f", venue.scan_key(F.col("f"))).alias("latest"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'ABSTAIN (4 of 9 computable)' ELSE (s_suppkey % 10) || '/9' END AS cell, round(s_suppkey * 0.19, 6) AS cost, s_suppkey || ',\"a\"\"b\",' AS line, CASE WHEN s_suppkey % 2 = 0 THEN ['x', '', 'y'] ELSE ['x'] END AS cells FROM supplier")
def cells_and_lines(spark, sf):
    k = F.col("s_suppkey")
    cells = F.when(k % 2 == 0, F.array(F.lit("x"), F.lit(""), F.lit("y"), F.lit(" "))).otherwise(F.array(F.lit("x"), F.lit(""), F.lit(" ")))
    return table(spark, sf, "supplier").select("s_suppkey", display.f_score_cell(F.when(k % 3 != 0, (k % 10).cast("int")), F.lit(4)).alias("cell"), r(display.run_cost(k)).alias("cost"), display.csv_line(k, F.lit('a"b'), F.lit(None)).alias("line"), display.trimmed(cells).alias("cells"))


# Lines of reports ------------------------------------------------------------------------------------

from .operators import lines  # noqa: E402


@query(SCREEN_CTES + "SELECT ticker, criterion, CASE WHEN passed THEN 'PASS' WHEN NOT passed THEN 'FAIL' ELSE 'NOT-EVAL' END AS status FROM sc")
def screen_rows(spark, sf):
    return _screen(spark, sf).select("ticker", "criterion", lines.screen_status(F.col("passed")).alias("status"))


@query("SELECT p_partkey, p_type AS reason FROM part")
def abstention_reasons(spark, sf):
    note = F.concat(F.lit("not evaluated: "), "p_type", F.lit(" — see the filing — twice"))
    return table(spark, sf, "part").select("p_partkey", lines.abstention_reason(note).alias("reason"))


@query("""WITH b AS (SELECT p_brand AS criterion, p_partkey AS ticker, CASE p_size % 4 WHEN 0 THEN 'fcf' WHEN 1 THEN 'eps' WHEN 2 THEN 'abstained' ELSE 'fcf' END AS basis FROM part),
c AS (SELECT criterion, basis, count(*) AS n, list(ticker::VARCHAR ORDER BY ticker::VARCHAR) AS names FROM b GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY criterion)::BIGINT AS total, CASE basis WHEN 'fcf' THEN 0 WHEN 'abstained' THEN 2 ELSE 1 END AS o FROM c)
SELECT criterion, total, string_agg(basis || ' ' || n || CASE WHEN o = 2 THEN '' ELSE '/' || total END || CASE WHEN o = 0 OR n > 5 THEN '' ELSE ' (' || array_to_string(names, ', ') || ')' END, ' · ' ORDER BY o, basis) AS line FROM t GROUP BY 1, 2""")
def screen_basis_lines(spark, sf):
    k = F.col("p_size") % 4
    return lines.basis_lines(table(spark, sf, "part").select(F.col("p_brand").alias("criterion"), F.col("p_partkey").cast("string").alias("ticker"), F.when(k == 1, "eps").when(k == 2, "abstained").otherwise("fcf").alias("basis")))


@query(SCREEN_CTES.rstrip() + """, c AS (SELECT ticker, count(passed) AS done, coalesce(list_sort(list(criterion) FILTER (passed IS NULL)), []) AS open FROM sc GROUP BY 1)
SELECT c.ticker, CASE WHEN currency = 'EUR' THEN 'DEGRADED' ELSE 'OK' END || ': ' || done || ' evaluated, ' || len(open) || ' abstained' || CASE WHEN len(open) > 0 THEN ' (' || array_to_string(open, ', ') || ')' ELSE '' END || '; fundamentals ' || CASE WHEN currency = 'EUR' THEN 'STALE' ELSE 'OK' END || ' / prices OK' AS line FROM c JOIN instruments i ON i.ticker = c.ticker""")
def health_lines(spark, sf):
    i = market.instruments(spark, sf)
    s = i.select("ticker", F.lit("prices").alias("source"), F.lit("OK").alias("status")).unionByName(i.select("ticker", F.lit("fundamentals").alias("source"), F.when(F.col("currency") == "EUR", "STALE").otherwise("OK").alias("status")))
    return lines.health_line(_screen(spark, sf), s)


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 AND o_orderstatus = 'F' THEN '[CONTESTED: split, dissent]' WHEN o_totalprice > 200000 THEN '[CONTESTED: split]' WHEN o_orderstatus = 'F' THEN '[CONTESTED: dissent]' ELSE '' END AS label, strftime(o_orderdate, '%Y-%m-%dT%H-%M-%SZ') || '_magic_v1' AS run_id FROM orders")
def contested_labels(spark, sf):
    reasons = F.array_compact(F.array(F.when(F.col("o_totalprice") > 200000, "split"), F.when(F.col("o_orderstatus") == "F", "dissent")))
    return table(spark, sf, "orders").select("o_orderkey", lines.contested_label(reasons).alias("label"), lines.run_id(F.col("o_orderdate"), F.lit("magic_v1")).alias("run_id"))


from .queries import CONSENSUS, TERCILES  # noqa: E402


@query(with_(CONSENSUS, TERCILES) + "SELECT ticker, ticker || ' | BUY | ' || printf('%.2f', mean + 0.001) || ' | ' || bucket || ' | ' || CASE bucket WHEN 'loved' THEN 'STICKY' ELSE 'DISAGREE' END AS line FROM street")
def divergence_lines(spark, sf):
    x = market.consensus(spark, sf).select(F.lit("all").alias("run"), "ticker", "mean", F.lit("buy").alias("verdict"), F.lit(10.0).alias("price"), F.lit(9.0).alias("target"))
    d = rank.divergence(x)
    return d.select("ticker", lines.divergence_line(F.col("ticker"), F.upper("verdict"), F.col("mean") + 0.001, F.col("bucket"), F.col("disagree"), F.col("sticky")).alias("line"))


@query("SELECT n_nationkey, 'b' || n_nationkey || ': n=' || n_nationkey || ' mean ' || CASE WHEN n_nationkey % 3 = 0 THEN '—' ELSE '+' || printf('%.1f', n_nationkey / 1000.0 * 100) || '%' END || ' vs all -1.5%' AS line, CASE WHEN n_nationkey % 4 = 0 THEN '—' WHEN n_nationkey % 4 = 1 THEN n_nationkey || '‡' ELSE n_nationkey::VARCHAR END AS rank_sum, CASE n_nationkey % 3 WHEN 0 THEN printf('%.1f', n_nationkey * 1.0) || ' of its own band' WHEN 1 THEN 'not evaluated: span too short' ELSE '—' END AS band, n_nationkey * 20 >= 250 AS history FROM nation")
def report_cells(spark, sf):
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        "n_nationkey", lines.bucket_line(F.concat(F.lit("b"), k.cast("string")), k, F.when(k % 3 != 0, k / 1000), F.lit(-0.015)).alias("line"), lines.rank_sum_cell(F.when(k % 4 != 0, k), F.when(k % 4 == 1, 2).otherwise(3), 3).alias("rank_sum"),
        lines.band_cell(F.when(k % 3 == 0, k * 1.0), F.when(k % 3 == 1, "span too short")).alias("band"), lines.history_present(k * 20).alias("history"),
    )


@query("SELECT DISTINCT c_mktsegment AS universe_id FROM customer WHERE c_custkey % 2 = 0")
def graded_universes(spark, sf):
    c = table(spark, sf, "customer")
    return lines.visible(lines.graded_ids(c.select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(" ").alias("universe_id"))).withColumn("hidden", F.lit(None).cast("boolean")), False).select("universe_id")


@query("SELECT event_type AS source, CASE event_id % 3 WHEN 0 THEN 'BUY' WHEN 1 THEN 'HOLD' ELSE 'NONE' END AS verdict, count(*) AS n, CASE WHEN event_id % 3 = 0 THEN list_sort(list(event_id)) ELSE [] END AS buys FROM events GROUP BY event_type, event_id % 3")
def scout_digest(spark, sf):
    k = F.col("event_id") % 3
    return lines.digest(table(spark, sf, "events").select(F.col("event_type").alias("source"), F.col("event_id").alias("ticker"), F.when(k == 0, "BUY").when(k == 1, "HOLD").alias("verdict")))


@query("SELECT DISTINCT o_custkey AS ticker, CASE WHEN c_custkey IS NOT NULL AND c_custkey % 3 = 0 THEN CAST(c_custkey % 10 AS INT) END AS score, CASE WHEN c_custkey IS NULL THEN '' WHEN c_custkey % 3 = 0 THEN (c_custkey % 10) || '/9' ELSE 'ABSTAIN' END AS cell FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
def scores_for_names(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("ticker"), F.when(F.col("c_custkey") % 3 == 0, (F.col("c_custkey") % 10).cast("int")).alias("score"), F.lit(4).alias("computed"))
    return lines.scores_for(table(spark, sf, "orders").select(F.col("o_custkey").alias("ticker")), c)


@query("SELECT '2001-01-01' AS snapshot_date, 'magic_v1' AS strategy, 'u_v1' AS universe_id, s_name AS ticker, 'BUY' AS verdict FROM supplier")
def snapshot_repair(spark, sf):
    """Rows that were written as one quoted text among sound ones."""
    s, none = table(spark, sf, "supplier"), F.lit(None).cast("string")
    sound = F.col("s_suppkey") % 2 == 0
    cells = {"snapshot_date": F.when(sound, "2001-01-01").otherwise(F.concat(F.lit("2001-01-01,magic_v1,u_v1,"), "s_name", F.lit(",BUY"))), "strategy": F.when(sound, "magic_v1"), "universe_id": F.when(sound, "u_v1"), "ticker": F.when(sound, F.col("s_name")), "verdict": F.when(sound, "BUY").otherwise(none)}
    return lines.repaired(s.select(*[c.alias(n) for n, c in cells.items()]))
