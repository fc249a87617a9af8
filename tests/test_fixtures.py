"""Hand-checked values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortmill.functions import clean, text
from cohortmill.functions import statements as st
from cohortmill.operators import asof, audit, band, decision, dividends, prices, rank, screen, sets
from cohortmill.plans import backtest, pipeline, scoreboard
from cohortmill.plans.strategy import RANKS, SCREENS, RankStrategy, ScreenStrategy, differences, next_version, parse
from cohortmill.sources import parsers

D = dt.date.fromisoformat


def values(spark, rows, names):
    return spark.createDataFrame([("r", t, n, v) for t, *vs in rows for n, v in zip(names, vs, strict=True)], "run string, ticker string, factor string, value double")


def by(df, key="ticker"):
    return {x[key]: x for x in df.collect()}


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def arr(*v):
    return F.array(*[F.lit(x).cast("double") for x in v])


def test_rank_sum_and_order(spark):
    v = values(spark, [("A", 0.10, 0.30), ("B", 0.12, 0.20), ("C", 0.05, 0.10)], ["ey", "roic"])
    r = rank.rank_universe(v, [rank.FactorSpec("ey"), rank.FactorSpec("roic")], rank.Cut("top_k", k=1)).orderBy("seq").collect()
    assert [(x.ticker, x.combined, x.position, x.verdict) for x in r] == [("A", 3.0, 1, "buy"), ("B", 3.0, 1, "hold"), ("C", 6.0, 3, "hold")]
    assert [x.tied for x in r] == [True, True, False]


def test_rank_low_and_ties(spark):
    r = by(rank.factor_ranks(values(spark, [("A", 0.1), ("B", 0.2), ("C", 0.4)], ["vol"]), [rank.FactorSpec("vol", "low")]))
    assert [r[t]["rank"] for t in "ABC"] == [1.0, 2.0, 3.0]
    r = by(rank.factor_ranks(values(spark, [("A", 0.2), ("B", 0.2), ("C", 0.1)], ["roic"]), [rank.FactorSpec("roic")]))
    assert [r[t]["rank"] for t in "ABC"] == [1.5, 1.5, 3.0]


def test_quintile_and_sizes(spark):
    r = by(rank.rank_universe(values(spark, [(f"T{i}", float(i)) for i in range(10)], ["roic"]), [rank.FactorSpec("roic")]))
    assert {t for t, x in r.items() if x.verdict == "buy"} == {"T9", "T8"} and {t for t, x in r.items() if x.verdict == "sell"} == {"T1", "T0"}
    for n, buys, sells in ((16, 4, 3), (6, 2, 1)):
        x = [y.verdict for y in rank.rank_universe(values(spark, [(f"T{i:02}", float(i)) for i in range(n)], ["roic"]), [rank.FactorSpec("roic")]).collect()]
        assert (x.count("buy"), x.count("sell")) == (buys, sells)


def test_missing_modes(spark):
    v = values(spark, [("GOOD", 0.3, 1.0), ("NODATA", None, 2.0)], ["roic", "ey"])
    worst = by(rank.factor_ranks(v, [rank.FactorSpec("roic"), rank.FactorSpec("ey")]).where("factor = 'roic'"))
    assert worst["NODATA"]["rank"] == 2.0
    drop = [rank.FactorSpec("roic", "high", "exclude"), rank.FactorSpec("ey")]
    assert [x.ticker for x in rank.rank_universe(v, drop).collect()] == ["GOOD"]
    gone = rank.excluded(v, drop).first()
    assert (gone.ticker, gone.n) == ("NODATA", 2) and "roic" in gone.reason
    neutral = by(rank.rank_universe(v, [rank.FactorSpec("roic", "high", "neutral"), rank.FactorSpec("ey")]))
    assert neutral["NODATA"].combined == 2.0  # rank 1 of ey, imputed by itself


def test_top_percentile_is_half_even(spark):
    v = values(spark, [(f"T{i}", float(i)) for i in range(10)], ["f"])
    r = rank.rank_universe(v, [rank.FactorSpec("f")], rank.Cut("top_percentile", share=0.25)).collect()
    assert sum(x.verdict == "buy" for x in r) == 2


def test_terciles_push_past_ties(spark):
    df = spark.createDataFrame([("r", f"T{i}", float(m)) for i, m in enumerate((1, 1, 1, 2, 3, 4))], "run string, ticker string, mean double")
    assert [x.bucket for x in rank.terciles(df).orderBy("ticker").collect()] == ["loved"] * 3 + ["middle", "least", "least"]


def test_divergence(spark):
    df = spark.createDataFrame([("r", "LOVE", 1.1, "SELL", 100.0, 90.0), ("r", "MID", 2.0, "HOLD", 100.0, 120.0), ("r", "HATE", 3.0, "BUY", 100.0, 120.0), ("r", "NONE", None, "BUY", 1.0, 2.0)], "run string, ticker string, mean double, verdict string, price double, target double")
    r = rank.divergence(df).collect()
    assert r[-1].ticker == "NONE"
    x = {y.ticker: (y.disagree, y.sticky) for y in r}
    assert x == {"LOVE": (True, True), "MID": (False, False), "HATE": (True, False), "NONE": (False, False)}
    # HOLD on a loved name and BUY on a middle one disagree too; a target at the price sticks; verdicts without a place never disagree.
    df = spark.createDataFrame([("r", "A", 1.1, "HOLD", 100.0, 100.0), ("r", "B", 2.0, "buy", 100.0, 90.0), ("r", "C", 3.0, "SELL", 100.0, 90.0), ("q", "D", 1.0, "EXCLUDED: gate", 1.0, 2.0), ("q", "E", 2.0, "BUY", 1.0, None), ("q", "F", 3.0, "UNRATEABLE", None, 2.0)], "run string, ticker string, mean double, verdict string, price double, target double")
    x = {y.ticker: (y.disagree, y.sticky) for y in rank.divergence(df).collect()}
    assert x == {"A": (True, True), "B": (True, False), "C": (False, False), "D": (False, False), "E": (True, False), "F": (False, False)}


def test_boundary_ties_of_three_verdicts(spark):
    """Each name of a score meets the names of the other verdicts that the score stands on."""
    rows = [("r", t, 5.0, v) for t, v in (("A", "buy"), ("B", "buy"), ("C", "hold"), ("D", "sell"))] + [("r", "E", 6.0, "sell"), ("q", "A", 5.0, "buy")]
    got = {(x.run, x.ticker): x.partners for x in rank.boundary_ties(spark.createDataFrame(rows, "run string, ticker string, combined double, verdict string")).collect()}
    assert got == {("r", "A"): ["C", "D"], ("r", "B"): ["C", "D"], ("r", "C"): ["A", "B", "D"], ("r", "D"): ["A", "B", "C"]}


def test_growth_and_roic(spark):
    x = one(spark, g=st.trend_growth(arr(133.1, 121.0, 110.0, 100.0)), short=st.trend_growth(arr(1.0, 2.0)), neg=st.trend_growth(arr(1.0, -1.0, 2.0, 3.0)), roic=st.through_cycle_roic(arr(400, 300, 200, 100), arr(80, 60, 40, 20), arr(400, 300, 200, 100), arr(1000)), high=st.through_cycle_roic(arr(1, 1, 1, 1), arr(9, 9, 9, 9), arr(10, 10, 10, 10), arr(1)), n=st.nopat_roic(F.lit(100.0), F.lit(-5.0), F.lit(50.0), F.lit(200.0)))
    assert x.g == pytest.approx(0.1) and x.short is None and x.neg is None and x.roic == pytest.approx(250 * 0.8 / 1000) and x.high is None and x.n == pytest.approx(0.5)


def test_peg(spark):
    nul = F.lit(None).cast("double")
    x = one(spark, a=st.peg(F.lit(20.0), F.lit(0.1)), b=st.peg(F.lit(20.0), F.lit(-0.1)), c=st.peg(F.lit(20.0), nul), d=st.peg(nul, F.lit(-0.1)), e=st.peg(F.lit(20.0), F.lit(0.9)))
    assert (x.a.value, x.a.must_fail) == (pytest.approx(2.0), False) and (x.b.value, x.b.must_fail) == (None, True)
    assert (x.c.value, x.c.must_fail) == (None, False) and (x.d.value, x.d.must_fail) == (None, False) and x.e.value == pytest.approx(0.5)


def test_earnings_yield_ladder(spark):
    n, v = F.lit(None).cast("double"), lambda x: F.lit(float(x))
    x = one(spark, a=st.earnings_yield(v(100), v(1000), n, n, n), b=st.earnings_yield(n, v(1000), n, n, v(20)), c=st.earnings_yield(v(100), v(1000), v(200), v(50), v(20)), d=st.earnings_yield(v(100), v(10), v(0), v(50), v(20)))
    assert (x.a.value, x.b.value) == (pytest.approx(0.1), pytest.approx(0.05)) and x.c.source == "ebit_ev" and x.c.value == pytest.approx(100 / 1150) and x.d.value is None


LINES = ("ni", "assets", "ocf", "ltd", "ca", "cl", "shares", "gp", "revenue")


def f_score(spark, rows):
    get = lambda i: {k: F.lit(None if rows.get(k) is None else float(rows[k][i])).cast("double") for k in LINES}
    return one(spark, c=st.f_score_checks(get(0), get(1))).c, one(spark, f=st.f_score(st.f_score_checks(get(0), get(1)))).f


STRONG = {"ni": (100, 50), "assets": (1000, 900), "ocf": (150, 120), "ltd": (100, 200), "ca": (400, 300), "cl": (200, 250), "shares": (90, 100), "gp": (500, 300), "revenue": (1000, 800)}


def test_f_score(spark):
    assert f_score(spark, STRONG)[1].score == 9
    weak = {"ni": (80, 100), "assets": (1200, 1000), "ocf": (60, 90), "ltd": (400, 300), "ca": (300, 400), "cl": (300, 300), "shares": (110, 100), "gp": (400, 400), "revenue": (1000, 800)}
    assert [i for i, c in enumerate(f_score(spark, weak)[0]) if c][:2] == [0, 1]
    five = {k: STRONG[k] for k in ("ni", "assets", "ocf", "revenue")}
    f = f_score(spark, five)[1]
    assert (f.score is not None, f.computed) == (True, 5)
    four = {k: STRONG[k] for k in ("ni", "assets", "ocf")}
    f = f_score(spark, four)[1]
    assert (f.score, f.computed) == (None, 4)
    zero = f_score(spark, STRONG | {"ltd": (0, 0)})
    assert zero[0][4] is False and zero[1].score == 8


def test_streaks(spark):
    d = spark.createDataFrame([("A", D(f"{y}-0{m}-01"), float(a)) for y, a in ((2015, 1), (2016, 2), (2017, 3), (2018, 4), (2019, 1)) for m in (1, 2)], "ticker string, ex_date date, amount double")
    assert dividends.median_streak(d).first().streak == 3 and dividends.calendar_streak(d, 3).first().streak == 3 and dividends.calendar_streak(d, 4).first().streak is None
    y = spark.createDataFrame([("A", 2015, 1.0), ("A", 2016, 0.5), ("A", 2017, 1.0), ("A", 2018, 1.001), ("A", 2019, 2.0)], "ticker string, year int, paid double")
    x = dividends.tolerant_streak(y, 2020).first()
    assert (x.streak, x.last_cut) == (1, 2016)
    with pytest.raises(KeyError):
        dividends.STREAKS["other"]


def test_screen_is_three_valued(spark):
    s = "ticker string, dividend_per_share double, last_close double, market_cap double, currency string"
    df = spark.createDataFrame([("ZERO", 0.0, 10.0, 9e9, "USD"), ("NULL", None, 10.0, None, "USD"), ("FX", 1.0, 10.0, 1.0, "EUR"), ("OK", 1.0, 10.0, 9e9, "USD")], s)
    x = {(r.ticker, r.criterion): (r.passed, r.observed) for r in screen.run_screen(df, [("min_dividend_yield", 0.05), ("min_market_cap", 1e9)]).collect()}
    assert x[("ZERO", "min_dividend_yield")] == (False, 0.0) and x[("NULL", "min_dividend_yield")] == (None, None)
    assert x[("FX", "min_market_cap")] == (None, None) and x[("OK", "min_market_cap")][0] is True
    e = by(screen.evaluate(screen.run_screen(df, [("min_dividend_yield", 0.05), ("min_market_cap", 1e9)])))
    assert e["NULL"].passes is None and e["ZERO"].first_fail.startswith("min_dividend_yield") and e["FX"].passes is True
    for bad in ([("nothing", 1.0)], [("min_roic", 99.0)]):
        with pytest.raises(ValueError):
            screen.validate(bad)
    with pytest.raises(ValueError):
        screen.validate([("min_price_momentum", 0.1)], {"fundamentals"})


def test_pipeline_fixture(spark):
    base = [("A", 3000.0, 10.0, [3000.0, 2800, 2600, 2400], [600.0, 560, 520, 480], [2900.0, 2700, 2500, 2300]), ("B", 1500.0, 20.0, [1500.0, 1450, 1400, 1350], [300.0, 290, 280, 270], [1450.0, 1400, 1350, 1300]), ("C", 500.0, 40.0, [500.0, 490, 480, 470], [100.0, 98, 96, 94], [480.0, 470, 460, 450])]
    rows = [(t, e, p, [float(x) for x in o], [float(x) for x in tx], [float(x) for x in pt], [5000.0] * 4, 2e10, "Technology", "USD", 120.0) for t, e, p, o, tx, pt in base] + [("DEAD", *[None] * 10)]
    df = spark.createDataFrame(rows, "ticker string, ebit double, pe_ratio double, operating_income array<double>, tax_provision array<double>, pretax_income array<double>, invested_capital array<double>, market_cap double, sector string, currency string, last_close double")
    x = by(pipeline.rank(df, RANKS["magic_formula_v1"]).rows)
    assert (x["A"].verdict, x["A"].seq, x["B"].seq) == ("buy", 1, 2)
    assert x["C"].status == "excluded" and "min_roic" in x["C"].reason and x["DEAD"].status == "unrateable"
    c = pipeline.check(df, pipeline.rank(df, RANKS["magic_formula_v1"]), RANKS["magic_formula_v1"], "B")
    assert by(c["factors"], "factor")["roic"].better == 1
    g = pipeline.multi(df, [RANKS["magic_formula_v1"], RANKS["magic_formula_v1"]]).collect()
    assert [r.ticker for r in g][:2] == ["A", "B"]


def _months(spark, closes):
    days = [dt.date(2021 + (5 + i) // 12, (5 + i) % 12 + 1, 28) for i in range(61)]
    days[-1] = D("2026-06-30")
    bars = spark.createDataFrame([("X", d, float(c)) for d, c in zip(days, closes, strict=True)], "ticker string, day date, close double")
    stm = spark.createDataFrame([("X", D(f"{y}-12-31"), 100.0) for y in range(2018, 2026)], "ticker string, period_end date, value double")
    sh = spark.createDataFrame([("X", 10.0, 150.0)], "ticker string, shares double, net_debt double")
    return band.band(bars, stm, sh, F.lit("2026-06-30").cast("date")).first()


def test_valuation_band(spark):
    flat = _months(spark, [100] * 61)
    assert flat.percentile == 50.0 and flat.current == pytest.approx(11.5)
    assert _months(spark, [50 + i for i in range(61)]).percentile > 95 and _months(spark, [110 - i for i in range(61)]).percentile < 5


def test_backtest_fixture(spark):
    px = [("A", y, c) for y, c in ((2020, 100), (2021, 120), (2022, 150), (2023, 140))] + [("B", y, c) for y, c in ((2020, 100), (2021, 105), (2022, 103), (2023, 110))]
    bars = spark.createDataFrame([(t, D(f"{y}-01-01"), float(c)) for t, y, c in px], "ticker string, day date, close double")
    dates = spark.createDataFrame([(D(f"{y}-01-01"),) for y in (2021, 2022, 2023)], "date date")
    upto = asof.up_to(dates, bars).groupBy("date", "ticker").agg((F.max_by("close", "day") / F.min_by("close", "day") - 1).alias("value")).withColumn("factor", F.lit("f"))
    p = backtest.periods(bars, dates, upto, [rank.FactorSpec("f", "high", "exclude")], rank.Cut("top_k", k=1))
    r = p.orderBy("date").collect()
    assert r[0].ret == pytest.approx(0.25) and r[1].ret == pytest.approx(140 / 150 - 1) and r[0].benchmark == pytest.approx((0.25 + (103 / 105 - 1)) / 2)
    s = backtest.summary(p).first()
    assert s.hit_rate == 0.5 and 0.05 < s.annualised < 0.11 and s.max_drawdown < 0


def test_scoreboard_returns(spark):
    bars = spark.createDataFrame([("A", D("2026-01-05"), 100.0), ("A", D("2026-07-05"), 150.0), ("A", D("2026-07-10"), 155.0), ("GONE", D("2026-01-05"), 10.0), ("GONE", D("2026-02-01"), 9.0)], "ticker string, day date, close double")
    starts = spark.createDataFrame([("A", D("2026-01-05"), D("2026-07-05")), ("GONE", D("2026-01-05"), D("2026-07-05")), ("NONE", D("2026-01-05"), D("2026-07-05"))], "ticker string, start date, want_end date")
    x = by(asof.forward_return(bars, starts))
    assert (x["A"].status, x["A"].ret) == ("OK", pytest.approx(0.5)) and (x["GONE"].status, x["GONE"].ret) == ("UNRESOLVED", None) and x["NONE"].status == "UNRESOLVED"
    rets = spark.createDataFrame([("s", "BUY", 0.5), ("s", "BUY", 0.2), ("s", "HOLD", 0.1), ("s", "SELL", -0.2), ("s", "EXCLUDED", None)], "strategy string, own string, ret double")
    stats = scoreboard.bucket_stats(rets, "own")
    b = by(stats, "bucket")
    assert (b["BUY"].n, b["BUY"].mean) == (2, pytest.approx(0.35)) and b["SELL"].mean == pytest.approx(-0.2) and b["BUY"].excess == pytest.approx(0.35 - 0.15)
    assert scoreboard.ordering(stats).first().ordered is True
    # Excluded names have a bucket of their own, beside the order of the others.
    assert b["EXCLUDED"].n == 0 and b["EXCLUDED"].mean is None
    more = scoreboard.bucket_stats(rets.union(spark.createDataFrame([("s", "EXCLUDED", 0.9)], rets.schema)), "own")
    e = by(more, "bucket")["EXCLUDED"]
    assert (e.n, e.mean, e.excess) == (1, pytest.approx(0.9), pytest.approx(0.9 - 0.3)) and scoreboard.ordering(more).first().ordered is True


def test_prices_abstain(spark):
    b = spark.createDataFrame([("SHORT", D("2020-01-01"), 1.0), ("BAD", D("2020-01-01"), 1.0), ("BAD", D("2020-01-02"), 0.0), ("BAD", D("2020-01-03"), 2.0)], "ticker string, day date, close double")
    x = by(prices.technical(b.where("close > 0 or ticker <> 'BAD'")))
    assert x["SHORT"].volatility is None and x["SHORT"].sma_50 is None and len(x["SHORT"].notes) >= 4


def test_clean_and_text(spark):
    lit = F.lit
    x = one(spark, a=clean.sentinel(lit(" n/a ")), b=clean.number(lit(" 12.5 ")), c=clean.number(lit("NaN")), d=clean.ticker(lit(" brk.b.. ")), e=clean.holdings_number(lit("1,211.0")), f=clean.any_date(lit("31.12.2024")), g=clean.any_date(lit("1735603200000")), h=clean.currency(lit(" usd ")), i=clean.asset_kind(lit("ETF")), j=clean.implausible_ticker(lit("a/b")), k=clean.present(lit("0")))
    assert (x.a, x.b, x.c, x.d, x.e, x.f, x.g, x.h, x.i, x.j, x.k) == (None, 12.5, None, "BRK.B", "1211", D("2024-12-31"), D("2024-12-31"), "USD", "etf", "path separator", True)
    y = one(spark, a=text.ordinal(lit(11)), b=text.ordinal(lit(22)), c=text.score_text(lit(11.0)), d=text.score_text(lit(11.5)), e=text.large_currency(lit(149.8e9), lit("USD")), f=text.percent(lit(0.22)), g=text.compare_cited(lit(12.3), lit(12.34)), h=text.compare_cited(lit(1234.0), lit(12.34)), i=text.compare_cited(lit(5.0), lit(12.34)), j=text.compare_cited(lit(None).cast("double"), lit(1.0)), k=text.without_citations(lit("Up 5% [call_12: a.b] , well.")))
    assert (y.a, y.b, y.c, y.d, y.e, y.f) == ("11th", "22nd", "11", "11.5", "USD 149.8bn", "22.0%")
    assert (y.g, y.h, y.i, y.j, y.k) == ("VERIFIED", "UNIT_SCALED", "MISMATCH", "UNVERIFIABLE", "Up 5%, well.")


def test_audit_paths(spark):
    calls = spark.createDataFrame([("c1", "t", '{"a": {"b": [1.5, 2.5, 3.5]}}')], "call_id string, tool_name string, output string")
    figs = spark.createDataFrame([("f1", "c1", "a.b[0]", 1.5), ("f2", "c1", "a.b[-1]", 3.5), ("f3", "c1", "a.x", 1.0), ("f4", "zz", "a.b[0]", 1.5)], "figure_id string, call_id string, field_path string, value double")
    assert {r.figure_id: r.state for r in audit.audit(figs, calls).collect()} == {"f1": "VERIFIED", "f2": "VERIFIED", "f3": "UNVERIFIABLE", "f4": "UNVERIFIABLE"}


def test_parsers(spark):
    p = spark.createDataFrame([("x.us", '{"General":{"Name":"X Co","Sector":"NA","CurrencyCode":"USD","Type":"ETF"},"Highlights":{"MarketCapitalization":"100","PERatio":"None"},"Financials":{"Income_Statement":{"yearly":{"2022-12-31":{"totalRevenue":"5"},"2023-12-31":{"totalRevenue":"6"},"2021-12-31":{"totalRevenue":null}}}}}')], "ticker string, json string")
    x = parsers.fundamentals(p).first()
    assert (x.ticker, x.sector, x.market_cap, x.pe_ratio, x.total_revenue) == ("X.US", None, 100.0, None, [6.0, 5.0])
    d = parsers.dividend_events(spark.createDataFrame([("X", '[{"date":"2023-01-05","value":"1.5"},{"date":"2023-02-05","value":"0"},{"date":"2019-01-05","value":"1"}]')], "ticker string, json string"), "2020-01-01", "2024-01-01").collect()
    assert [(r.ex_date, r.amount) for r in d] == [(D("2023-01-05"), 1.5)]
    feed = spark.createDataFrame([("r1", '{"features":[{"properties":{"id":1}},{"properties":{"id":2}}]}'), ("r2", '[{"id":3}]')], "run_id string, json string")
    assert parsers.flatten_feed(feed).count() == 3
    s = parsers.scouted(spark.createDataFrame([(1, "2024-01-10", "AAA", "a"), (2, "2023-01-01", "BBB", "b"), (3, "x", "CCC", "c"), (4, "2024-01-09", " ", "d")], "ord int, added string, listing string, company string"), "2024-01-15", 30)
    assert [r.skip_reason for r in s.orderBy("ord").collect()] == [None, "before the window", "no date", "no listing"]


def test_sets(spark):
    a, b = spark.createDataFrame([("x", 1), ("y", 2), ("z", None)], "k string, v int"), spark.createDataFrame([("y", 3), ("z", None), ("w", 1)], "k string, v int")
    diff = sets.difference(a, b, "k", "v")
    assert {r.k: r.change for r in diff.collect()} == {"x": "vanished", "y": "moved", "z": "unchanged", "w": "appeared"}
    assert sets.churn(diff).first().churn == 0.75


def test_decisions(spark):
    x = one(spark, a=decision.exceeds(F.lit("BUY"), F.lit("SELL")), b=decision.exceeds(F.lit("HOLD"), F.lit(None).cast("string")), c=decision.criterion_points(F.lit("max_peg_ratio"), F.lit(True), F.lit(1.0), F.lit(2.0), F.lit(4.0)), d=decision.criterion_points(F.lit("min_x"), F.lit(False), F.lit(None).cast("double"), F.lit(2.0), F.lit(4.0)))
    assert (x.a, x.b, x.c, x.d) == (True, False, 2.0, -4.0)
    with pytest.raises(Exception, match="not on the ladder"):
        one(spark, a=decision.exceeds(F.lit("MAYBE"), F.lit("SELL")))
    runs = spark.createDataFrame([("T", v, 0.5) for v in ("SELL", "BUY")], "ticker string, verdict string, confidence double")
    assert decision.stability(runs).first().modal == "BUY"


def test_strategies():
    assert len(RANKS) == 10 and len(SCREENS) == 5
    s = next_version(RANKS["etf_core_v1"], missing="worst")
    assert s.id == "etf_core_v2" and set(differences(RANKS["etf_core_v1"], s)) == {"id", "missing"}
    assert isinstance(parse('{"id": "a_v1", "factors": ["roic"], "cut": {"kind": "top_k", "k": 3}, "gates": {"asset_kinds": ["equity"]}}'), RankStrategy)
    assert isinstance(parse('{"id": "b_v1", "criteria": {"min_roic": 0.1}}'), ScreenStrategy)
    for bad in ('{"id": "a", "factors": ["roic"]}', '{"id": "a_v1", "factors": ["zzz"]}', '{"id": "a_v1", "criteria": {"zzz": 1}}'):
        with pytest.raises(ValueError):
            parse(bad)


def test_catalog(spark, tmp_path):
    from cohortmill.sources.catalog import Catalog, schema_marker, upgraded

    c = Catalog(spark, f"file://{tmp_path}")
    old = spark.createDataFrame([("2020-01-01", "s_v1", "A")], "snapshot_date string, strategy string, ticker string")
    new = spark.createDataFrame([("2020-02-01", "s_v1", "B", 1.5)], "snapshot_date string, strategy string, ticker string, price double")
    c.append(old, "snapshots", ["strategy"])
    c.append(new, "snapshots", ["strategy"])
    x = {r.ticker: r.price for r in c.snapshots(strategy="s_v1").collect()}
    assert x == {"A": None, "B": 1.5} and upgraded(old, new.schema).columns == new.columns and schema_marker(old) != schema_marker(new)
    c.freeze({"bars": spark.createDataFrame([("A", D("2020-01-01"), 1.0, 1.0, 1.0, 1.0, 1.0, 1), ("A", D("2020-01-02"), 1.0, 1.0, 1.0, None, 1.0, 1)], "ticker string, day date, open double, high double, low double, close double, adj_close double, volume long")}, "r1")
    assert c.frozen("r1").prices("2020-01-01", "2020-12-31").count() == 1


def test_streams_equal_batches(spark, tmp_path):
    from cohortmill.streaming import windows

    src = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{src}/events.parquet")
    out, ck = f"file://{tmp_path}/out", f"file://{tmp_path}/ck"
    (tmp_path / "in").mkdir()
    events.write.mode("overwrite").parquet(f"file://{tmp_path}/in")
    windows.run_available(spark, f"file://{tmp_path}/in", events.schema, lambda s: windows.tumbling(s, "1 hour"), out, ck)
    got, want = spark.read.parquet(out), windows.tumbling(events, "1 hour")
    assert got.subtract(want).count() == 0 and 0 < got.count() <= want.count()  # windows still open under the watermark wait


def test_venues(spark):
    from cohortmill.functions import venue

    cells = {"NYSE: BRK.B": "BRK-B", "ETR: 1BR / NYSE: ABC": "ABC", "Sony (TSE 6758)": "6758.T", " aapl ": "AAPL", "no symbol at all": None, "": None, "ETR: 1BR": "1BR.DE"}
    df = spark.createDataFrame([(k,) for k in cells], "c string").select("c", venue.parse_ticker(F.col("c")).alias("t"))
    assert {r.c: r.t for r in df.collect()} == cells
    x = one(spark, a=venue.compact_amount(F.lit(4172812800.0)), b=venue.compact_amount(F.lit(4e6)), c=venue.country_code(F.lit("ireland")), d=venue.country_code(F.lit("Chile")), e=venue.is_transient(F.lit("Read timed out")), f=venue.scan_key(F.lit("scan_2026-01-05_r2.csv")), g=venue.query_symbol(F.lit("SAP.DE")))
    assert (x.a, x.b, x.c, x.d, x.e, x.f.rerun, x.g) == ("4.17bn", "4m", "IE", "Chile", True, 2, "SAP.XETRA")


def test_narration_flags(spark):
    from cohortmill.operators import narration

    ranked = spark.createDataFrame([("r", "AAA", 3, 4.0, 1, "buy"), ("r", "BBB", 3, 6.0, 2, "hold"), ("r", "CCC", 3, 8.0, 3, "sell")], "run string, ticker string, n int, combined double, position int, verdict string")
    ranks = spark.createDataFrame([("r", t, f, v) for t, vs in (("AAA", (1.0, 2.5)), ("BBB", (2.0, 2.5)), ("CCC", (3.0, 1.0))) for f, v in zip(("momentum", "size"), vs, strict=True)], "run string, ticker string, factor string, rank double")
    words = ((("momentum",), ("momentum",)), (("size",), ("size",)))
    text_ = "AAA has the best momentum. It ranks 2nd on size. BBB ranks 3rd on momentum. CCC is a BUY. Its rank-sum is 4.0. Its rank-sum is 5.5. AAA and BBB and CCC rank 9th on momentum. Not the best size."
    n = spark.createDataFrame([("r", "AAA", text_)], "run string, ticker string, narrative string")
    got = {r.i: r.reason for r in narration.check(n, ranked, ranks, words).collect()}
    assert {i for i, f in got.items() if f} == {2, 3, 5} and got[2] == "rank: cited 3, is 2" and got[6] is None
    out = narration.annotated(n, narration.check(n, ranked, ranks, words)).first().narrative
    assert out.startswith(text_) and out.count("narration check") == 3


def test_reporting(spark):
    from cohortmill.operators import reporting

    t = spark.createDataFrame([("A", "2024-01", 1, 1, 2, 0, 0), ("A", "2024-02", 0, 0, None, 0, 0)], "ticker string, period string, strong_buy int, buy int, hold int, sell int, strong_sell int")
    x = reporting.sentiment(t).first()
    assert (x.period, x.total, x.bullish) == ("2024-01", 4, 0.5)
    s = spark.createDataFrame([(1, "c"), (2, "a"), (3, "b")], "ord int, id string")
    assert [r.id for r in reporting.suggested_first(s, ["b", "zz", "c"], "id", "ord").collect()] == ["b", "c", "a"]
    st_ = spark.createDataFrame([("x", ["equity"]), ("y", ["ETF"]), ("z", [])], "id string, kinds array<string>")
    c = spark.createDataFrame([("etf",), (None,)], "kind string")
    assert {r.id for r in reporting.applicable(st_, c).collect()} == {"y", "z"}
    h = spark.createDataFrame([("OK", []), ("OK", ["late"]), ("FETCH_ERROR", [])], "status string, issues array<string>")
    assert reporting.health(h).first().asDict() == {"total": 3, "clean": 1, "degraded": 1, "fetch": 1, "insufficient": 0}
    news = spark.createDataFrame([("A", D("2024-01-10"), "b"), ("A", D("2024-01-10"), "a"), ("A", D("2023-01-10"), "old")], "ticker string, published date, headline string")
    assert reporting.headlines(news, F.lit("2024-01-12").cast("date")).first().headlines == ["a", "b"]


def test_display_and_review(spark):
    from cohortmill.functions import display
    from cohortmill.operators import review

    lit = F.lit
    x = one(spark, a=display.brand_token(lit("The Coca Cola Co.")), b=display.suspect_mapping(lit("Pepsi Inc"), lit("The Coca Cola Co.")), c=display.factor_value(lit("roic"), lit(0.22), lit("USD")), d=display.factor_value(lit("piotroski_f_score"), lit(7.0), lit("USD")), e=display.glyphs(F.array(lit(True), lit(False), lit(None).cast("boolean"))), f=display.f_score_cell(lit(None).cast("int"), lit(4)), g=display.csv_line(lit("a,b"), lit(None).cast("string"), lit(1)), h=display.trimmed(F.array(lit("a"), lit(""), lit("b"), lit(" "))), i=display.short_reason(lit("screen: min_roic: 0.1234 against 0.1200")), j=display.fee_gloss(lit(0.2)))
    assert (x.a, x.b, x.c, x.d, x.e) == ("coca", True, "22.0%", "7/9", "P-?") and x.f.startswith("ABSTAIN") and x.g == '"a,b",,1' and x.h == ["a", "", "b"] and x.i == "min_roic: 0.12 vs 0.12" and "2.00" in x.j
    y = one(spark, a=review.contested(F.array(lit("flip")), lit(True), lit(0.5)), b=review.contested(F.array().cast("array<string>"), lit(False), lit(0.5)))
    assert y.a == ["veto: flip", "dissent", "confidence in the middle"] and y.b == []
    issues = spark.createDataFrame([("s", 1, "LATE"), ("s", 2, "FETCH_ERROR"), ("t", 1, "LATE")], "source string, ord int, reason string")
    assert review.banner(issues).first().banner == "s: FETCH_ERROR" and review.banner(issues.where("source = 't'")).first().banner is None


def test_universes(spark):
    from cohortmill.sources import universes as u

    rows = [("energy_v1", "", None, None, [" shel.l ", "BP.L.", "BP.L", ""], None, None, False), ("energy_v1", None, None, None, ["XOM"], None, None, True), ("bare", None, None, None, ["A"], None, None, False), ("none_v1", None, None, None, ["", None], None, None, False), (None, None, None, None, ["A"], None, None, False), ("null_v2", None, None, None, None, None, None, False)]
    m = spark.createDataFrame(rows, u.SCHEMA + ", local boolean")
    assert {(r.id, r.display_name, tuple(r.tickers), r.local) for r in u.listed(m).collect()} == {("energy_v1", "energy_v1", ("SHEL.L", "BP.L"), False), ("energy_v1", "energy_v1", ("XOM",), True)}
    assert [(r.ord, r.ticker) for r in u.by_id(m, "energy_v1").orderBy("ord").collect()] == [(0, "SHEL.L"), (1, "BP.L")]
    with pytest.raises(Exception, match="unknown universe other_v1"):
        u.by_id(m, "other_v1").collect()
    with pytest.raises(ValueError, match="a list"):
        u.resolve(spark, m)
    one, two = (u.resolve(spark, m, t).first().universe_id for t in (["a", "B"], ["b", "A.", "a"]))
    assert one == two and one.startswith("adhoc:") and u.resolve(spark, m, ["a"], "mine_v1").first().universe_id == "mine_v1"


def test_matrix_follows_the_signed_return(spark):
    rows = [("UP", 0, "min_price_momentum", True, 0.9, 0.0), ("DOWN", 0, "min_price_momentum", False, -0.2, 0.0), ("GAP", 0, "min_price_momentum", None, None, 0.0)]
    s = spark.createDataFrame(rows, "ticker string, ord int, criterion string, passed boolean, observed double, threshold double")
    op = spark.createDataFrame([("GAP", "bullish", 0.5), ("GAP", "bearish", 0.25), ("UP", "abstain", 1.0)], "ticker string, stance string, confidence double")
    got = {r.ticker: (round(r.score, 9), r.verdict, r.borderline) for r in decision.matrix(s, {}, [], 1.0, -0.5, 0.1, momentum=(0.5, 4.0), opinions=op, stance_weight=2.0).collect()}
    assert got == {"UP": (2.0, "BUY", False), "DOWN": (-0.8, "SELL", False), "GAP": (0.5, "HOLD", False)}


def test_unknown_tax_is_no_rate(spark):
    d = spark.createDataFrame([(100.0, None, 50.0, 1000.0), (100.0, 25.0, 50.0, 1000.0), (100.0, 25.0, None, 1000.0)], "oi double, tax double, pretax double, capital double")
    assert [r.v for r in d.select(st.nopat_roic(*map(F.col, ("oi", "tax", "pretax", "capital"))).alias("v")).collect()] == [0.1, 0.05, 0.1]


def test_numbers_are_cut_by_their_exact_value(spark):
    import random

    rng = random.Random(5)
    values = [14.85, 14.95, 278.25, 278.15, 0.5, 1.5, 2.5, 0.05, -0.04, 0.0, 9.95, 9.96, 99.95, 999.95, 0.125, 1e15 + 0.5, 123456789012.25, 1e17, *[rng.randrange(10**7) / 100 for _ in range(400)], *[-rng.randrange(10**6) / 1000 for _ in range(200)], *[rng.random() * 10 ** rng.randrange(12) for _ in range(400)]]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for d in (0, 1, 2, 4):
        got = df.select("v", text.fixed(F.col("v"), d).alias("t")).collect()
        assert [r.t for r in got] == [f"{r.v:.{d}f}" for r in got]
    money = df.where("v = 14.85").select(text.large_currency(F.col("v") * 1e6, F.lit("USD")).alias("t"), text.percent(F.lit(0.00125)).alias("p")).first()
    assert (money.t, money.p) == ("USD 14.8m", "0.1%")
