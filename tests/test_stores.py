"""Feeds with faults, appends that happen once, outputs with an index, reports as documents, scopes of fields, merged sources, state of a feed."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from cohortmill.operators import scopes, sets
from cohortmill.sources import commits, feeds, outputs, reports
from cohortmill.streaming import state

D = dt.date.fromisoformat


# Feeds ------------------------------------------------------------------------------------------


def test_feeds_with_faults(spark, tmp_path):
    files = {"good/a.txt": '{"ticker": "A", "value": 1.5}\n\n{"ticker": "B", "value": 2}\n', "broken/x.txt": '{"ticker": "A", "value": 3}\n{"ticker": "B", "val\n', "typed/x.txt": '{"ticker": "A", "value": "many"}\n', "empty/x.txt": "\n\n", "secret/x.txt": '{"ticker": "Z"}\n'}
    for name, text in files.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    wanted = spark.createDataFrame([("good", True), ("broken", True), ("typed", True), ("empty", True), ("gone", True), ("secret", False)], "source string, has_key boolean")
    lines = feeds.feed_lines(spark, f"file://{tmp_path}", ["good", "broken", "typed", "empty", "gone", "secret"])
    rows, done = feeds.gathered(wanted, lines, "ticker string, value double")
    assert sorted(tuple(r) for r in rows.collect()) == [("broken", "A", 3.0), ("good", "A", 1.5), ("good", "B", 2.0)]
    got = {r.source: (r.status, r.n, r.n_bad) for r in done.collect()}
    assert got == {"good": ("OK", 2, 0), "broken": ("FETCH_ERROR", 1, 1), "typed": ("FETCH_ERROR", 0, 1), "empty": ("EMPTY_RESPONSE", 0, 0), "gone": ("FETCH_ERROR", 0, 0), "secret": ("MISSING_KEY", 0, 0)}
    members = spark.createDataFrame([("x", "A"), ("x", "B"), ("y", "A"), ("z", "A")], "cohort string, ticker string")
    needs = spark.createDataFrame([("x", "good"), ("x", "secret"), ("x", "empty"), ("y", "good")], "cohort string, source string")
    per = {(r.cohort, r.ticker): (r.degraded, [(i.source, i.reason) for i in r.issues]) for r in feeds.issues(members, needs, done).collect()}
    assert per["x", "B"] == (True, [("empty", "EMPTY_RESPONSE"), ("secret", "MISSING_KEY")]) and per["y", "A"] == (False, []) and per["z", "A"] == (False, [])


# Appends ----------------------------------------------------------------------------------------


def test_appends_happen_once(spark, tmp_path):
    root, schema = f"file://{tmp_path}/log", "ticker string, agree boolean"
    df = lambda *t: spark.createDataFrame([(x, True) for x in t], schema)
    rows = lambda: sorted((r.run, r.ticker) for r in commits.committed(spark, root, schema).collect())
    assert rows() == []
    assert commits.append_once(df("A", "B"), root, "r1") and rows() == [("r1", "A"), ("r1", "B")]
    assert not commits.append_once(df("A", "B", "C"), root, "r1") and rows() == [("r1", "A"), ("r1", "B")]
    # A job that dies after its rows are written and before its manifest.
    attempt, n = commits.write_attempt(df("X"), root, "r2")
    assert n == 1 and rows() == [("r1", "A"), ("r1", "B")]
    assert commits.append_once(df("C"), root, "r2") and rows()[-1] == ("r2", "C") and len(rows()) == 3
    # Two attempts at one time: one is committed.
    a, b = commits.write_attempt(df("D"), root, "r3"), commits.write_attempt(df("D"), root, "r3")
    assert [commits.publish(spark, root, "r3", *x) for x in (a, b)] == [True, False] and rows().count(("r3", "D")) == 1
    assert {(r.run, r.n) for r in commits.manifests(spark, root).collect()} == {("r1", 2), ("r2", 1), ("r3", 1)}

    def fail(x):
        raise ValueError("lost")

    with pytest.raises(Exception, match="lost"):
        commits.append_once(df("E").select(F.udf(fail, "string")("ticker").alias("ticker"), "agree"), root, "r4")
    assert len(rows()) == 4
    assert commits.append_once(df("E"), root, "r4") and rows()[-1] == ("r4", "E")
    assert commits.append_once(df(), root, "r5") and len(rows()) == 5


# Outputs ----------------------------------------------------------------------------------------


def test_outputs_and_index(spark, tmp_path):
    root, schema = f"file://{tmp_path}/scout", "source string, status string, ticker string"
    rows = spark.createDataFrame([("ft", "graded", "A"), ("ft", "skipped", "?"), ("scan", "graded", "B")], schema)
    i = {r.source: (r.rows, r.skipped) for r in outputs.write_with_index(rows, root, ["ft", "scan", "none"], "2026-01-05").collect()}
    assert i == {"ft": (1, 1), "scan": (1, 0), "none": (0, 0)}
    outputs.write_with_index(rows.where("source = 'scan'"), root, ["ft", "scan", "none"], "2026-01-12")
    # A rerun of one source of a day replaces that source's rows only.
    outputs.write_with_index(spark.createDataFrame([("ft", "graded", "C")], schema), root, ["ft"], "2026-01-05")
    got = sorted((str(r.run_date), r.source, r.ticker) for r in spark.read.parquet(f"{root}/verdicts").collect())
    assert got == [("2026-01-05", "ft", "C"), ("2026-01-05", "scan", "B"), ("2026-01-12", "scan", "B")]
    assert {str(r.run_date) for r in outputs.latest(spark, root).collect()} == {"2026-01-12"}
    with pytest.raises(Exception, match="not listed"):
        outputs.write_with_index(rows, root, ["ft"], "2026-01-19")


# Reports ----------------------------------------------------------------------------------------


def test_reports_as_documents(spark, tmp_path):
    root = f"file://{tmp_path}"
    body = lambda **k: json.dumps(k)
    rows = [("aa", "2026-01-05 10:00:00", body(decision={"verdict": "buy", "confidence": 0.7}, flags=["x"])), ("AA", "2026-01-06 10:00:00", body(decision={"verdict": "hold"}, extra=[1, {"k": 2}])), ("BB", "2026-01-05 10:00:00", None)]
    reports.save(spark.createDataFrame(rows, "ticker string, at string, body string").select("ticker", F.col("at").cast("timestamp").alias("run_at"), "body"), root)
    reports.save(spark.createDataFrame([("CC", body(decision="odd"))], "ticker string, body string").select("ticker", F.lit("2026-01-07 00:00:00").cast("timestamp").alias("run_at"), "body"), root)
    paths = {"verdict": ("$.decision.verdict", "string"), "confidence": ("$.decision.confidence", "double"), "k": ("$.extra[1].k", "int")}
    got = [tuple(r) for r in reports.fields(reports.load(spark, root), paths).orderBy("ticker", "run").collect()]
    assert got == [("AA", "2026-01-05T10-00-00Z", "buy", 0.7, None), ("AA", "2026-01-06T10-00-00Z", "hold", None, 2), ("BB", "2026-01-05T10-00-00Z", None, None, None), ("CC", "2026-01-07T00-00-00Z", None, None, None)]
    one = reports.load(spark, root, "aa")
    assert one.count() == 2 and "PartitionFilters: [isnotnull(ticker" in one._jdf.queryExecution().executedPlan().toString()


def test_records(spark):
    schema = "ticker string, run_at timestamp, strategy_id string, verdict string, confidence double, opinions array<struct<agent:string,stance:string>>, flags array<struct<trigger:string,note:string>>, audit map<string,int>, overrides map<string,string>"
    at = lambda d: dt.datetime(2026, 1, d)
    rows = [
        ("a", at(1), "s", "BUY", 0.5, [("f", "bullish"), ("t", "neutral"), ("f", "bearish")], [("stale", "1"), ("flip", "2"), ("stale", "3")], {"checked": 3, "verified": 2, "prose": 9}, None),
        ("a", at(2), "s", "SELL", None, None, None, None, {"w": "1"}), ("a", at(3), "s", "INSUFFICIENT_EVIDENCE", None, [], [], {}, {}), ("a", at(4), "t", None, None, [], [], None, {}),
    ]
    rec = reports.record(spark.createDataFrame(rows, schema))
    r = {x.run_at.day: x for x in rec.collect()}
    assert tuple(rec.columns) == reports.RECORD and r[1].ticker == "A" and r[1].stances == {"f": "bearish", "t": "neutral"} and r[1].veto_triggers == ["stale", "flip"] and r[1].audit == {"checked": 3, "verified": 2}
    assert (r[2].stances, r[2].veto_triggers, r[2].audit, r[2].overrides) == ({}, [], None, {"w": "1"}) and r[3].audit is None
    b = {(x.ticker, x.strategy_id): (x.run_at.day, x.verdict) for x in reports.baseline(rec).collect()}
    assert b == {("A", "s"): (1, "BUY"), ("A", "t"): (4, None)}


# Scopes -----------------------------------------------------------------------------------------


def test_scopes_and_displays(spark):
    scopes_ = scopes.allowed(spark.createDataFrame([("income", "dividend_yield"), ("income", "free_cash_flow"), ("growth", "total_debt")], "strategy string, field string"))
    rows = spark.createDataFrame([("A", "income", 149.8e9, 0.239, -12e9, 5.0, "USD"), ("A", "growth", 149.8e9, 0.239, -12e9, 5.0, "USD"), ("B", "income", -1.0, 0.03, None, None, None), ("C", "none", 1.0, None, None, None, None)], "ticker string, strategy string, market_cap double, dividend_yield double, free_cash_flow double, total_debt double, currency string")
    s = scopes.scoped(rows, ["market_cap", "dividend_yield", "free_cash_flow", "total_debt"], scopes_)
    got = {(r.ticker, r.strategy): (set(r.shown), r.withheld) for r in s.collect()}
    assert got["A", "income"][0] == {"market_cap"} and set(got["A", "income"][1]) == {"free_cash_flow", "dividend_yield"} and got["A", "income"][1]["dividend_yield"] == "implausible"
    assert got["A", "growth"] == ({"market_cap", "total_debt"}, {}) and got["B", "income"] == ({"dividend_yield"}, {"market_cap": "implausible"}) and got["C", "none"] == (set(), {})
    x = scopes.displays(s.join(rows.select("ticker", "strategy", "currency"), ["ticker", "strategy"]))
    d = {(r.ticker, r.strategy): r.display for r in x.collect()}
    assert d["A", "growth"]["market_cap"] == "USD 149.8bn" and d["A", "growth"]["total_debt"] == "5.00" and d["B", "income"] == {"dividend_yield": "3.0%"}
    v = spark.createDataFrame([("F", "fund_size", 5e9, "static"), ("F", "expense_ratio", 0.07, "computed"), ("F", "momentum_12m", 0.1, "computed"), ("G", "fund_size", None, "abstained"), ("H", "fund_size", 1.0, None)], "ticker string, factor string, value double, source string")
    assert [(r.ticker, [(e.factor, e.value, e.provenance) for e in r.evidence]) for r in scopes.absolute_values(v).collect()] == [("F", [("expense_ratio", 0.07, "computed"), ("fund_size", 5e9, "static")])]


# Sources by priority ----------------------------------------------------------------------------


def test_sources_by_priority(spark):
    src = spark.createDataFrame([("holdings", 0, None), ("ft", 1, 8), ("scan", 2, None)], "source string, priority int, window_days int")
    rows = spark.createDataFrame([("scan", "A", D("2026-01-01"), "s"), ("ft", "A", D("2026-01-20"), "f"), ("ft", "A", D("2026-01-18"), "g"), ("ft", "B", D("2026-01-01"), "old"), ("scan", "B", None, "n"), ("holdings", "C", None, "h"), ("ft", "C", None, "u"), ("news", "D", None, "?")], "source string, symbol string, added date, note string")
    m = sets.by_priority(rows, src, F.lit("2026-01-21").cast("date"))
    assert {r.symbol: (r.source, r.note, r.found_by) for r in m.collect()} == {"A": ("ft", "g", ["ft", "scan"]), "B": ("scan", "n", ["scan"]), "C": ("holdings", "h", ["holdings", "ft"])}
    assert {(r.source, r.symbol): r.others for r in sets.found_elsewhere(m).collect()}["ft", "C"] == ["holdings"]


# State of a feed --------------------------------------------------------------------------------


def test_state_of_a_feed_and_restart(spark, tmp_path):
    """Three lots of a feed, a restart before each: the state is that of all events at once."""
    t0 = dt.datetime(2026, 1, 1)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    lots = [[("a", 0), ("b", 5), ("a", 7)], [("a", 60), ("c", 61), ("a", 58)], [("c", 200), ("d", 201)]]
    src = f"{tmp_path}/in"
    for lot in lots:
        spark.createDataFrame([(k, at(m)) for k, m in lot], "key string, ts timestamp").coalesce(1).write.mode("append").parquet(src)
        state.run(spark, spark.readStream.schema("key string, ts timestamp").parquet(src), f"{tmp_path}/out", f"{tmp_path}/ck", 30 * 60, "0 seconds")
    got = {r.key: tuple(r)[1:] for r in state.current(spark, f"{tmp_path}/out").collect()}
    want = {r.key: tuple(r)[1:] for r in state.of_table(spark.createDataFrame([(k, at(m)) for lot in lots for k, m in lot], "key string, ts timestamp"), 30 * 60, F.lit(at(201))).collect()}
    # A row behind the watermark of its time is late, and not seen: none here but a's, of the batch that moves it.
    assert got == want and got["a"][3] == "GONE" and got["d"][3] == "LIVE"
