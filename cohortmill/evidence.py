"""Queries of what stands around the ranks: feeds and their faults, stores, scopes, merged sources, a feed's state. They add to ``queries.QUERIES``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import vendor
from .operators import lines, reporting, scopes, screen, sets
from .plans.strategy import RANKS
from .queries import BARS, INSTRUMENTS, TECH, query, r, with_
from .sources import catalog, commits, feeds, market, outputs, reports, universes
from .sources.market import table
from .streaming import state, windows

# Feeds: each kind of event is a source; one of them has lines cut short, one has only blank lines, one has no key, and one is never sent.
FEED = "event_id long, value double"
_OUTCOME = """f AS (SELECT event_type AS source, event_id, value, event_type = 'error' AND event_id % 97 = 0 AS bad FROM events WHERE event_type NOT IN ('signup', 'view')),
 o AS (SELECT 'click' AS source, true AS has_key UNION ALL SELECT 'error', true UNION ALL SELECT 'purchase', true UNION ALL SELECT 'view', true UNION ALL SELECT 'never', true UNION ALL SELECT 'signup', false),
 d AS (SELECT source, has_key, count(event_id) FILTER (NOT bad) AS n, count(event_id) FILTER (bad) AS n_bad FROM o LEFT JOIN f USING (source) GROUP BY 1, 2),
 oc AS (SELECT source, CASE WHEN NOT has_key THEN 'MISSING_KEY' WHEN source = 'never' OR n_bad > 0 THEN 'FETCH_ERROR' WHEN n = 0 THEN 'EMPTY_RESPONSE' ELSE 'OK' END AS status, n, n_bad FROM d)"""


def _feed(spark, sf) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "events")
    line = F.to_json(F.struct("event_id", "value"))
    line = F.when(F.col("event_type") == "view", " ").when((F.col("event_type") == "error") & (F.col("event_id") % 97 == 0), F.expr("left(to_json(struct(event_id, value)), 12)")).otherwise(line)
    wanted = spark.createDataFrame([(s, s != "signup") for s in ("click", "error", "purchase", "view", "never", "signup")], "source string, has_key boolean")
    return wanted, e.select(F.col("event_type").alias("source"), line.alias("line"))


@query(with_(_OUTCOME) + "SELECT source, status, n, n_bad FROM oc")
def feed_outcomes(spark, sf):
    """What became of each source asked for."""
    return feeds.gathered(*_feed(spark, sf), FEED)[1].select("source", "status", "n", "n_bad")


@query(with_(_OUTCOME) + "SELECT source, event_id, round(value, 6) AS value FROM f WHERE NOT bad")
def feed_rows(spark, sf):
    """The readable rows of all sources that may be read; a broken line costs itself only."""
    return feeds.gathered(*_feed(spark, sf), FEED)[0].select("source", "event_id", r("value").alias("value"))


@query(with_(_OUTCOME) + """SELECT n_name AS cohort, 'S' || s_suppkey AS ticker, len(i) > 0 AS degraded, i AS issues FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN (
 SELECT k, coalesce(list(source || ':' || status ORDER BY source) FILTER (status <> 'OK'), []) AS i FROM (VALUES (0, 'click'), (0, 'error'), (1, 'purchase'), (1, 'click'), (2, 'view'), (2, 'never'), (2, 'signup')) AS v(k, source) JOIN oc USING (source) GROUP BY k) ON k = n_nationkey % 3""")
def feed_issues(spark, sf):
    """Names that a fault degrades: those of cohorts that ask the source that has it."""
    done = feeds.gathered(*_feed(spark, sf), FEED)[1]
    n = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("cohort"))
    asked = {0: ["click", "error"], 1: ["purchase", "click"], 2: ["view", "never", "signup"]}
    pairs = spark.createDataFrame([(k, s) for k, ss in asked.items() for s in ss], "k int, source string")
    needs = n.join(pairs, F.col("n_nationkey") % 3 == F.col("k")).select("cohort", "source")
    members = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("cohort", F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"))
    x = feeds.issues(members, needs, done)
    return x.select("cohort", "ticker", "degraded", F.transform("issues", lambda i: F.concat(i["source"], F.lit(":"), i["reason"])).alias("issues"))


# Stores ------------------------------------------------------------------------------------------


@query("SELECT 'y' || year(o_orderdate) AS run, 'C' || o_custkey AS ticker, o_orderstatus AS agreement, count(*) AS n FROM orders WHERE year(o_orderdate) < 1996 GROUP BY 1, 2, 3")
def agreement_log(spark, sf):
    """The runs of four years, of which one is appended twice, one only after an attempt that died, and a fifth dies."""
    o = table(spark, sf, "orders")
    root, schema = catalog.scratch(spark), "ticker string, agreement string"
    for y in (1992, 1993, 1994, 1995):
        rows = o.where(F.year("o_orderdate") == y).select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker"), F.col("o_orderstatus").alias("agreement"))
        if y == 1994:
            commits.write_attempt(rows, root, f"y{y}")
        commits.append_once(rows, root, f"y{y}")
        if y == 1993:
            commits.append_once(rows.union(rows), root, f"y{y}")
    commits.write_attempt(o.where(F.year("o_orderdate") == 1996).select(F.lit("X").alias("ticker"), F.lit("Y").alias("agreement")), root, "y1996")
    return commits.committed(spark, root, schema).groupBy("run", "ticker", "agreement").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT '2026-01-05' AS run_date, event_type AS source, count(*) FILTER (event_id % 11 <> 0) AS rows, count(*) FILTER (event_id % 11 = 0) AS skipped, 'verdicts/run_date=2026-01-05/source=' || event_type AS path FROM events GROUP BY event_type UNION ALL SELECT '2026-01-05', 'holdings', 0, 0, 'verdicts/run_date=2026-01-05/source=holdings'")
def scout_index(spark, sf):
    """The index of a run's outputs, counted while they are written."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.when(F.col("event_id") % 11 == 0, "skipped").otherwise("graded").alias("status"), F.col("event_id").alias("ticker"))
    return outputs.write_with_index(e, catalog.scratch(spark), ["click", "error", "purchase", "signup", "view", "holdings"], "2026-01-05")


@query("SELECT event_type AS source, CASE WHEN event_id % 11 = 0 THEN 'skipped' ELSE 'graded' END AS status, event_id AS ticker FROM events WHERE event_type <> 'error' OR event_id % 2 = 0")
def scout_outputs(spark, sf):
    """Two runs of a day: the second one writes one source again, and leaves the others' rows."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.when(F.col("event_id") % 11 == 0, "skipped").otherwise("graded").alias("status"), F.col("event_id").alias("ticker"))
    root, all_ = catalog.scratch(spark), ["click", "error", "purchase", "signup", "view"]
    outputs.write_with_index(e, root, all_, "2026-01-05")
    outputs.write_with_index(e.where("source = 'error' and ticker % 2 = 0"), root, all_, "2026-01-05")
    return spark.read.schema("status string, ticker long, run_date string, source string").parquet(f"{root}/verdicts").select("source", "status", "ticker")


def _documents(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    body = F.concat(F.lit('{"run": {"k": '), F.get_json_object("props", "$.k"), F.when(F.col("event_type") == "error", F.lit("}}")).otherwise(F.concat(F.lit(', "kind": "'), "event_type", F.lit('"}, "values": ['), F.round("value", 2).cast("string"), F.lit(", 1]}"))))
    return e.select(F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("ticker"), F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()).alias("run_at"), body.alias("body"))


@query("""SELECT 'U' || user_id % 20 AS ticker, strftime(ts, '%Y-%m-%dT%H-%M-%SZ') AS run, CAST(json_extract(props, '$.k') AS INT) AS k, CASE WHEN event_type <> 'error' THEN event_type END AS kind, CASE WHEN event_type <> 'error' THEN round(value, 6) END AS value FROM events""")
def report_fields(spark, sf):
    """Fields of reports stored as documents, of which older ones lack some."""
    root = catalog.scratch(spark)
    reports.save(_documents(spark, sf), root)
    x = reports.fields(reports.load(spark, root), {"k": ("$.run.k", "int"), "kind": ("$.run.kind", "string"), "value": ("$.values[0]", "double")})
    return x.withColumn("value", r("value"))


@query("""SELECT strftime(ts, '%Y-%m-%dT%H-%M-%SZ') AS run, CAST(json_extract(props, '$.k') AS INT) AS k FROM events WHERE user_id % 20 = 7""")
def reports_of_one(spark, sf):
    """The reports of one name: its partition is all that is read."""
    root = catalog.scratch(spark)
    reports.save(_documents(spark, sf), root)
    return reports.fields(reports.load(spark, root, "u7"), {"k": ("$.run.k", "int")}).select("run", "k")


_STATES = """s AS (SELECT o_custkey, o_orderstatus AS strategy_id, max(o_orderdate) AS run_at, arg_max(o_totalprice, o_orderkey) AS price, count(*) AS n FROM orders GROUP BY 1, 2),
 t AS (SELECT o_custkey, o_orderstatus AS strategy_id, substring(o_orderpriority, 3) AS trigger, min(o_orderkey) AS first FROM orders GROUP BY 1, 2, 3),
 p AS (SELECT o_custkey, o_orderstatus AS strategy_id, 'clerk' || o_orderkey % 3 AS agent, arg_max(substring(o_orderpriority, 3), o_orderkey) AS stance FROM orders GROUP BY 1, 2, 3),
 rec AS (SELECT 'C' || s.o_custkey AS ticker, s.strategy_id, run_at, CASE WHEN price > 400000 THEN 'INSUFFICIENT_EVIDENCE' WHEN price > 200000 THEN 'BUY' ELSE 'SELL' END AS verdict, (SELECT list(trigger ORDER BY first) FROM t WHERE t.o_custkey = s.o_custkey AND t.strategy_id = s.strategy_id) AS veto_triggers,
  (SELECT list(agent || '=' || stance ORDER BY agent) FROM p WHERE p.o_custkey = s.o_custkey AND p.strategy_id = s.strategy_id) AS stances, n, s.o_custkey % 13 = 0 AS experiment FROM s)"""


def _records(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    by = F.array_sort(F.collect_list(F.struct("o_orderkey", F.substring("o_orderpriority", 3, 20).alias("what"), F.concat(F.lit("clerk"), (F.col("o_orderkey") % 3).cast("string")).alias("agent"))))
    g = o.groupBy("o_custkey", F.col("o_orderstatus").alias("strategy_id")).agg(F.max(F.col("o_orderdate").cast("timestamp")).alias("run_at"), F.max_by("o_totalprice", "o_orderkey").alias("price"), by.alias("x"), F.count(F.lit(1)).cast("int").alias("n"))
    states = g.select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("ticker"), "run_at", "strategy_id", F.when(F.col("price") > 400000, "INSUFFICIENT_EVIDENCE").when(F.col("price") > 200000, "BUY").otherwise("SELL").alias("verdict"), F.lit(0.5).alias("confidence"),
        F.transform("x", lambda y: F.struct(y["agent"].alias("agent"), y["what"].alias("stance"))).alias("opinions"), F.transform("x", lambda y: F.struct(y["what"].alias("trigger"), y["agent"].alias("note"))).alias("flags"),
        F.create_map(F.lit("checked"), F.col("n"), F.lit("prose"), F.lit(1)).alias("audit"), F.when(F.col("o_custkey") % 13 == 0, F.create_map(F.lit("weight"), F.lit("2"))).alias("overrides"),
    )
    return reports.record(states)


@query(with_(_STATES) + "SELECT ticker, strategy_id, verdict, veto_triggers, stances, CAST(n AS INT) AS checked, experiment FROM rec")
def verdict_records(spark, sf):
    """What the history keeps of finished runs: the triggers in the order in which they first fired, the last stance of each agent, counts of the audit."""
    x = _records(spark, sf)
    stances = F.transform(F.array_sort(F.map_keys("stances")), lambda k: F.concat(k, F.lit("="), F.col("stances")[k]))
    return x.select("ticker", "strategy_id", "verdict", "veto_triggers", stances.alias("stances"), F.col("audit")["checked"].alias("checked"), (F.size(F.map_keys("overrides")) > 0).alias("experiment"))


@query(with_(_STATES) + "SELECT ticker, strategy_id, CAST(run_at AS DATE) AS run_day, verdict FROM rec WHERE NOT experiment AND verdict <> 'INSUFFICIENT_EVIDENCE'")
def verdict_baselines(spark, sf):
    """The runs that later ones may be compared with."""
    return reports.baseline(_records(spark, sf)).select("ticker", "strategy_id", F.col("run_at").cast("date").alias("run_day"), "verdict")


# Scopes ------------------------------------------------------------------------------------------

_SCOPES = {"income": ["dividend_yield", "free_cash_flow", "payout_ratio"], "value": ["price_to_book", "total_debt"], "core": []}
_SCOPED = """x AS (SELECT i.ticker, i.currency, i.market_cap * 1000000 AS market_cap, CASE WHEN market_cap > 0 THEN market_cap / 100 END AS pe_ratio, CAST(substring(i.ticker, 2) AS INT) % 25 / 100.0 AS dividend_yield, market_cap * 10 AS free_cash_flow, abs(market_cap) / 2 AS total_debt, market_cap / 10000 AS payout_ratio, CASE WHEN CAST(substring(i.ticker, 2) AS INT) % 4 > 0 THEN CAST(substring(i.ticker, 2) AS INT) * 7.0 % 130 END AS price_to_book FROM instruments i),
 l AS (SELECT ticker, currency, unnest(['market_cap', 'pe_ratio', 'dividend_yield', 'free_cash_flow', 'total_debt', 'payout_ratio', 'price_to_book']) AS field, unnest([market_cap, pe_ratio, dividend_yield, free_cash_flow, total_debt, payout_ratio, price_to_book]) AS v FROM x),
 a AS (SELECT * FROM (VALUES ('income', 'dividend_yield'), ('income', 'free_cash_flow'), ('income', 'payout_ratio'), ('value', 'price_to_book'), ('value', 'total_debt'), ('income', 'market_cap'), ('income', 'pe_ratio'), ('value', 'market_cap'), ('value', 'pe_ratio'), ('core', 'market_cap'), ('core', 'pe_ratio')) AS s(strategy, field)),
 w AS (SELECT *, CASE WHEN field = 'free_cash_flow' THEN 'headline' WHEN (field = 'dividend_yield' AND v > 0.15) OR (field = 'market_cap' AND v < 0) OR (field = 'price_to_book' AND v > 100) THEN 'implausible' END AS why FROM l JOIN a USING (field) WHERE v IS NOT NULL)"""


def _scoped(spark, sf) -> DataFrame:
    k = F.col("ticker").substr(2, 20).cast("int")
    i = market.instruments(spark, sf)
    x = i.select("ticker", "currency", F.when(F.col("market_cap") > 0, F.col("market_cap") / 100).alias("pe_ratio"), (k % 25 / 100).alias("dividend_yield"), (F.col("market_cap") * 10).alias("free_cash_flow"), (F.abs("market_cap") / 2).alias("total_debt"), (F.col("market_cap") / 10000).alias("payout_ratio"), F.when(k % 4 > 0, k * 7.0 % 130).alias("price_to_book"), (F.col("market_cap") * 1000000).alias("market_cap"))
    chosen = spark.createDataFrame([(s, f) for s, fs in _SCOPES.items() for f in fs or ["market_cap"]], "strategy string, field string")
    rows = x.crossJoin(F.broadcast(chosen.select("strategy").distinct()))  # three strategies
    fields = ["market_cap", "pe_ratio", "dividend_yield", "free_cash_flow", "total_debt", "payout_ratio", "price_to_book"]
    return scopes.displays(scopes.scoped(rows, fields, scopes.allowed(chosen)).join(x.select("ticker", "currency"), "ticker"))


@query(with_(INSTRUMENTS, _SCOPED) + "SELECT ticker, strategy, field, why AS withheld FROM w")
def scoped_fields(spark, sf):
    """Fields that a strategy's reader may see, and those of its own that are withheld, with the reason."""
    x = _scoped(spark, sf)
    shown = x.select("ticker", "strategy", F.explode(F.map_keys("shown")).alias("field"), F.lit(None).cast("string").alias("withheld"))
    gone = x.select("ticker", "strategy", F.explode("withheld").alias("field", "why")).select("ticker", "strategy", "field", F.when(F.col("why").startswith("one-offs"), "headline").otherwise(F.col("why")).alias("withheld"))
    return shown.unionByName(gone)


@query(with_(INSTRUMENTS, _SCOPED) + """SELECT ticker, strategy, field, CASE field WHEN 'market_cap' THEN currency || ' ' || CASE WHEN v >= 1e9 THEN printf('%.1fbn', v / 1e9) WHEN v >= 1e6 THEN printf('%.1fm', v / 1e6) ELSE printf('%.0f', v) END
 WHEN 'dividend_yield' THEN printf('%.1f', v * 100) || '%' END AS text FROM w WHERE why IS NULL AND field IN ('market_cap', 'dividend_yield')""")
def display_maps(spark, sf):
    """What a reader quotes: money with the instrument's currency, yields as percent."""
    return _scoped(spark, sf).select("ticker", "strategy", F.explode("display").alias("field", "text")).where(F.col("field").isin("market_cap", "dividend_yield"))


@query(with_(INSTRUMENTS, BARS, TECH) + """, v AS (SELECT ticker, CAST(substring(ticker, 2) AS INT) AS k FROM instruments) SELECT ticker, list_filter([CASE WHEN k % 3 > 0 THEN 'expense_ratio:' || CASE WHEN k % 2 = 0 THEN 'static' ELSE 'computed' END END, CASE WHEN k % 5 > 0 THEN 'fund_size:computed' END], lambda x: x IS NOT NULL) AS evidence FROM v WHERE k % 3 > 0 OR k % 5 > 0""")
def static_evidence(spark, sf):
    """Absolute values of funds with where they came from; gaps are left out."""
    k = F.col("ticker").substr(2, 20).cast("int")
    cells = F.array(F.struct(F.lit("fund_size").alias("factor"), F.when(k % 5 > 0, k * 1e6).alias("value"), F.lit("computed").alias("source")), F.struct(F.lit("expense_ratio").alias("factor"), F.when(k % 3 > 0, k / 100).alias("value"), F.when(k % 2 == 0, "static").otherwise("computed").alias("source")), F.struct(F.lit("momentum_12m").alias("factor"), F.lit(0.1).alias("value"), F.lit("computed").alias("source")))
    v = market.instruments(spark, sf).select("ticker", F.explode(cells).alias("x")).select("ticker", "x.*")
    return scopes.absolute_values(v).select("ticker", F.transform("evidence", lambda e: F.concat(e["factor"], F.lit(":"), e["provenance"])).alias("evidence"))


_INFO = """i AS (SELECT event_id AS k, user_id, value, event_type FROM events), m AS (SELECT k, CASE WHEN k % 3 > 0 THEN value END AS rate, CASE WHEN k % 4 > 0 THEN value / 2 END AS trailing_rate, CASE WHEN k % 5 = 1 THEN 0.0 WHEN k % 5 > 1 THEN value / 1000 END AS trailing_yield, CASE WHEN k % 7 > 0 THEN value / 10 END AS percent, CASE WHEN k % 6 = 0 THEN value / 500 WHEN k % 6 = 1 THEN 0.0 END AS fund_yield, CASE WHEN k % 8 = 0 THEN value / 100 END AS payout, CASE WHEN k % 9 > 0 THEN value - 10 END AS eps, CASE WHEN k % 10 = 0 THEN 'ETF' WHEN k % 10 < 5 THEN 'EQUITY' END AS kind FROM i)"""


@query(with_(_INFO) + """, c AS (SELECT *, coalesce(kind = 'ETF', false) OR fund_yield IS NOT NULL AS fund, coalesce(rate, trailing_rate) AS dps FROM m), y AS (SELECT *, CASE WHEN fund THEN coalesce(CASE WHEN fund_yield > 0 THEN fund_yield END, CASE WHEN trailing_yield > 0 THEN trailing_yield END, CASE WHEN percent > 0 THEN percent / 100 END) ELSE coalesce(trailing_yield, percent / 100) END AS raw FROM c)
SELECT k, fund, round(dps, 6) AS dps, round(CASE WHEN raw > 1 THEN raw / 100 ELSE raw END, 6) AS dividend_yield, round(coalesce(payout, CASE WHEN eps > 0 THEN dps / eps END), 6) AS payout_ratio FROM y""")
def vendor_figures(spark, sf):
    """Dividends, yields and payouts of a vendor's info with holes in every field."""
    k, v = F.col("event_id"), F.col("value")
    pairs = {
        vendor.FORWARD_RATE: F.when(k % 3 > 0, v), vendor.TRAILING_RATE: F.when(k % 4 > 0, v / 2), vendor.TRAILING_YIELD: F.when(k % 5 == 1, F.lit(0.0)).when(k % 5 > 1, v / 1000), vendor.PERCENT_YIELD: F.when(k % 7 > 0, v / 10),
        vendor.FUND_YIELD: F.when(k % 6 == 0, v / 500).when(k % 6 == 1, F.lit(0.0)), vendor.PAYOUT: F.when(k % 8 == 0, v / 100), vendor.EPS: F.when(k % 9 > 0, v - 10), vendor.KIND: F.when(k % 10 == 0, "ETF").when(k % 10 < 5, "EQUITY"),
    }
    x = table(spark, sf, "events").select(k.alias("k"), F.map_from_entries(F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(n), c.cast("string"))) for n, c in pairs.items()]))).alias("info"))
    i = F.col("info")
    return x.select("k", vendor.looks_like_fund(i).alias("fund"), r(vendor.dividend_per_share(i)).alias("dps"), r(vendor.yield_of(i)).alias("dividend_yield"), r(vendor.payout_ratio(i)).alias("payout_ratio"))


# Sources and lists -------------------------------------------------------------------------------

_MERGED = """src AS (SELECT * FROM (VALUES ('purchase', 0, NULL), ('click', 1, 3), ('view', 2, 10), ('error', 3, NULL)) AS s(source, priority, days)), e AS (SELECT 'U' || user_id AS symbol, event_type AS source, CASE WHEN event_id % 6 > 0 THEN CAST(ts AS DATE) END AS added, 'n' || event_id % 50 AS note, priority, days FROM events JOIN src ON source = event_type),
 seen AS (SELECT * FROM e WHERE days IS NULL OR added IS NULL OR date_diff('day', added, (SELECT CAST(max(ts) AS DATE) FROM events)) <= days)"""


@query(with_(_MERGED) + """SELECT symbol, source, added, note, (SELECT list(source ORDER BY priority) FROM (SELECT DISTINCT symbol AS s, source, priority FROM seen) d WHERE d.s = x.symbol) AS found_by FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY priority, added IS NULL, added, note) AS i FROM seen) x WHERE i = 1""")
def sources_merged(spark, sf):
    """One row for each name of four sources: the first source's, within its window, with all that found it."""
    return sets.by_priority(*_merged(spark, sf))


def _merged(spark, sf):
    e = table(spark, sf, "events")
    rows = e.select(F.col("event_type").alias("source"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"), F.when(F.col("event_id") % 6 > 0, F.col("ts").cast("date")).alias("added"), F.concat(F.lit("n"), (F.col("event_id") % 50).cast("string")).alias("note"))
    src = spark.createDataFrame([("purchase", 0, None), ("click", 1, 3), ("view", 2, 10), ("error", 3, None)], "source string, priority int, window_days int")
    return rows, src, F.lit(e.agg(F.max(F.col("ts").cast("date"))).first()[0])


@query(with_(_MERGED, "d AS (SELECT DISTINCT symbol, source FROM seen)") + "SELECT a.source, a.symbol, coalesce(list(b.source ORDER BY b.source) FILTER (b.source IS NOT NULL), []) AS others FROM d a LEFT JOIN d b ON b.symbol = a.symbol AND b.source <> a.source GROUP BY 1, 2")
def found_elsewhere(spark, sf):
    """Each source's names with the other sources that have them."""
    return sets.found_elsewhere(sets.by_priority(*_merged(spark, sf)))


_REGISTRY = "reg AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c.name}', {list(c.requires)!r}, {list(c.columns)!r})" for i, c in enumerate(screen.CRITERIA.values())) + ") AS v(i, criterion, requires, columns))"


@query(with_(_REGISTRY, f"sel AS (SELECT DISTINCT p_brand AS strategy, requires, columns FROM part JOIN reg ON i = p_partkey % {len(screen.CRITERIA)} WHERE p_size % 10 = 0)") + "SELECT strategy, (SELECT list(DISTINCT x ORDER BY x) FROM (SELECT unnest(flatten(list(requires))) AS x)) AS evidence, (SELECT list(DISTINCT x ORDER BY x) FROM (SELECT unnest(flatten(list(columns))) AS x)) AS fields FROM sel GROUP BY strategy")
def required_evidence(spark, sf):
    """What kinds of evidence, and which fields, each list of criteria needs."""
    names = spark.createDataFrame(list(enumerate(screen.CRITERIA)), "i int, criterion string")
    sel = table(spark, sf, "part").where("p_size % 10 = 0").withColumn("i", (F.col("p_partkey") % len(screen.CRITERIA)).cast("int")).join(F.broadcast(names), "i").select(F.col("p_brand").alias("strategy"), "criterion")  # the registry's few criteria
    return screen.evidence_of(sel)


_BOUNDS = "reg AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c.name}', {sorted(c.requires)!r}, {float(c.low)}, {float(c.high)})" for i, c in enumerate(screen.CRITERIA.values())) + ") AS v(i, criterion, requires, low, high))"


@query(with_(_BOUNDS, f"s AS (SELECT p_partkey AS strategy, CASE WHEN p_partkey % 17 = 0 THEN 'min_luck' ELSE criterion END AS criterion, requires, low, high, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size * 3.0 - 20 END AS threshold, p_partkey % 3 AS have FROM part LEFT JOIN reg ON i = p_partkey % {len(screen.CRITERIA)})",
 "f AS (SELECT strategy, criterion, CASE WHEN criterion = 'min_luck' THEN 'unknown criterion min_luck' WHEN threshold IS NULL OR threshold NOT BETWEEN low AND high THEN 'threshold out of bounds' WHEN len(list_filter(requires, lambda x: NOT list_contains(CASE have WHEN 0 THEN ['fundamentals'] WHEN 1 THEN ['fundamentals', 'prices', 'dividends', 'band'] ELSE [] END, x))) > 0 THEN 'needs ' || array_to_string(list_filter(requires, lambda x: NOT list_contains(CASE have WHEN 0 THEN ['fundamentals'] WHEN 1 THEN ['fundamentals', 'prices', 'dividends', 'band'] ELSE [] END, x)), ', ') END AS fault FROM s)") + "SELECT strategy, criterion, fault FROM f WHERE fault IS NOT NULL")
def selection_faults(spark, sf):
    """What is wrong with the criteria that strategies select: one criterion for each part, with thresholds and evidence of all kinds."""
    k = F.col("p_partkey")
    names = spark.createDataFrame(list(enumerate(screen.CRITERIA)), "i int, name string")
    p = table(spark, sf, "part").withColumn("i", (k % len(screen.CRITERIA)).cast("int")).join(F.broadcast(names), "i")
    sel = p.select(k.alias("strategy"), F.when(k % 17 == 0, "min_luck").otherwise(F.col("name")).alias("criterion"), F.when(k % 11 != 0, F.col("p_size") * 3.0 - 20).alias("threshold"))
    have = p.select(k.alias("strategy"), F.explode(F.when(k % 3 == 0, F.array(F.lit("fundamentals"))).when(k % 3 == 1, F.array(*map(F.lit, ("fundamentals", "prices", "dividends", "band")))).otherwise(F.array().cast("array<string>"))).alias("evidence"))
    return screen.selection_faults(sel, have)


_REQUESTS = """q AS (SELECT o_custkey AS request, o_orderkey AS ord, CASE WHEN o_orderkey % 17 = 0 THEN ' a/b.py' WHEN o_orderkey % 19 = 0 THEN '-x' WHEN o_orderkey % 23 = 0 THEN ' ' ELSE 'T' || o_orderkey % 40 || CASE WHEN o_orderkey % 3 = 0 THEN '.' ELSE '' END END AS token FROM orders)"""


def _requests(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    token = F.when(k % 17 == 0, " a/b.py").when(k % 19 == 0, "-x").when(k % 23 == 0, " ").otherwise(F.concat(F.lit("t"), (k % 40).cast("string"), F.when(k % 3 == 0, ".").otherwise("")))
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("request"), k.alias("ord"), token.alias("token"))


@query(with_(_REQUESTS) + """, b AS (SELECT request, arg_min(CASE WHEN token = ' a/b.py' THEN 'a/b.py: path separator' ELSE '-x: leading dash' END, ord) FILTER (token IN (' a/b.py', '-x')) AS bad FROM q GROUP BY 1)
SELECT c_custkey AS request, CASE WHEN bad IS NOT NULL THEN bad WHEN b.request IS NOT NULL AND c_custkey % 5 = 0 THEN 'either symbols or a universe' ELSE 'symbols or a universe are needed' END AS fault FROM customer LEFT JOIN b ON b.request = c_custkey WHERE bad IS NOT NULL OR (b.request IS NOT NULL AND c_custkey % 5 = 0) OR (b.request IS NULL AND c_custkey % 5 <> 0)""")
def argument_faults(spark, sf):
    """What is wrong with each request of symbols or a universe; sound ones have no row."""
    wanted = table(spark, sf, "customer").select(F.col("c_custkey").alias("request"), F.when(F.col("c_custkey") % 5 == 0, "growth_v1").alias("universe_id"))
    return lines.request_faults(wanted, _requests(spark, sf))


@query(with_(_REQUESTS, "g AS (SELECT request, upper(rtrim(trim(token), '.')) AS ticker, min(ord) AS o FROM q WHERE token NOT IN (' ', '-x', ' a/b.py') GROUP BY 1, 2)", "h AS (SELECT request, 'adhoc:' || substring(sha256(string_agg(ticker, ',' ORDER BY ticker)), 1, 8) AS universe_id FROM g GROUP BY 1)") + "SELECT request, universe_id, CAST(row_number() OVER (PARTITION BY request ORDER BY o) - 1 AS INT) AS ord, ticker FROM g JOIN h USING (request)")
def universe_adhoc(spark, sf):
    """The lists of requests, each symbol once, under ids made of their members."""
    t = _requests(spark, sf).where(~F.col("token").isin(" ", "-x", " a/b.py"))
    return universes.adhoc(t)


@query(with_(INSTRUMENTS, "s AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', {[k.lower() for k in x.gates.asset_kinds]!r})" for i, x in RANKS.items()) + ") AS v(id, kinds))", "c AS (SELECT company_name[-1:] || sector AS cohort, count(DISTINCT quote_type) AS k, lower(min(quote_type)) AS kind FROM instruments GROUP BY 1)") + "SELECT cohort, id FROM c, s WHERE len(kinds) = 0 OR k > 1 OR list_contains(kinds, kind)")
def applicable_strategies(spark, sf):
    """Strategies that each cohort may be graded under: a cohort of one known kind must be among a strategy's kinds."""
    s = spark.createDataFrame([(i, [k.lower() for k in x.gates.asset_kinds]) for i, x in RANKS.items()], "id string, kinds array<string>")
    m = market.instruments(spark, sf).select(F.concat(F.right("company_name", F.lit(1)), "sector").alias("cohort"), F.lower("quote_type").alias("kind"))
    return reporting.applicable_by(s, m)


# State -------------------------------------------------------------------------------------------


@query("""SELECT 'U' || user_id AS key, min(ts) AS first, max(ts) AS last, count(*) AS n, CASE WHEN max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE THEN 'GONE' ELSE 'LIVE' END AS status FROM events GROUP BY 1""")
def feed_state(spark, sf):
    """A stream over the events, with the state of each user kept and timers for those that go."""
    files = f"{sf}/events*"  # the table may be a file or a folder
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(files).select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    out = catalog.scratch(spark)
    state.run(spark, stream, f"{out}/rows", f"{out}/checkpoint", 12 * 3600, "10 minutes")
    return state.current(spark, f"{out}/rows").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last")})

def _streamed(spark, sf, build) -> DataFrame:
    """What a stream over the events appends: windows that the watermark has closed."""
    schema, out = spark.read.parquet(f"{sf}/events.parquet").schema, catalog.scratch(spark)
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events*").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")  # the table may be a file or a folder
    windows.append_available(build(stream), f"{out}/rows", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows")


_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@query(f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 HOUR, any_value(ts)) + INTERVAL 1 HOUR <= {_CLOSED}")
def stream_tumbling(spark, sf):
    return _streamed(spark, sf, lambda e: windows.tumbling(e, "1 hour")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", r("total").alias("total"))


@query(f"""WITH g AS (SELECT user_id, ts, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE, false) AS gap FROM events)),
 w AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM g GROUP BY user_id, s) SELECT user_id, start, "end", n FROM w WHERE "end" <= {_CLOSED}""")
def stream_sessions(spark, sf):
    return _streamed(spark, sf, lambda e: windows.sessions(e, "30 minutes")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
