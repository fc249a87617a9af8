"""Many cohorts under many strategies in one plan.

Strategies are rows: their gates, thresholds, factors and cuts are columns that a name's row meets, so the plan has the same size for one strategy and for a hundred. A run is a
(cohort, strategy) pair. A name's gates, screen and factors come from one row without a join back; ranks, ties and cuts are keyed by the run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import asset_kind
from ..operators.factors import columns as factor_columns
from ..operators.factors import factor_cells
from ..operators.rank import excluded_of, rank_values
from ..operators.screen import CRITERIA, RESULT, consumed_columns, known_foreign, reason_of
from ..sources.catalog import settled
from .strategy import SCREENS, RankStrategy, ScreenStrategy

GATE = "struct<asset_kinds:array<string>,min_market_cap:double,exclude_sectors:array<string>,include_sectors:array<string>,max_payout:double>"
CUT = "struct<kind:string,k:int,share:double>"
STRATEGY = f"strategy string, gates {GATE}, screen array<string>, thresholds map<string,double>, factors array<string>, missing string, cut {CUT}"
_STRINGS = ("quote_type", "sector", "currency")
_KNOWN = ("market_cap", "total_revenue", "operating_income", "dividend_yield", "pe_ratio")


@dataclass
class Grades:
    """rows: cohort, strategy, ticker, status (ranked, excluded, unrateable), reason, seq, position, tied, combined, verdict, n; values: cohort, strategy, ticker, factor, value, source of
    the names that take part."""

    rows: DataFrame
    values: DataFrame


def strategy_rows(spark: SparkSession, strategies: list[RankStrategy], screens: dict[str, ScreenStrategy] = SCREENS) -> DataFrame:
    """One small row for each strategy, the first of an id."""
    first = {s.id: s for s in reversed(strategies)}
    low = lambda names: [n.strip().lower() for n in names] or None
    rows = []
    for s in first.values():
        g, criteria = s.gates, screens[s.screen].criteria if s.screen else ()
        rows.append((s.id, (low(g.asset_kinds), g.min_market_cap, low(g.exclude_sectors), low(g.include_sectors), g.max_payout), [c for c, _ in criteria], {c: float(t) for c, t in criteria}, list(s.factors), s.missing, (s.cut.kind, s.cut.k, s.cut.share)))
    return spark.createDataFrame(rows, STRATEGY)


def unrateable() -> Column:
    """No price, and nothing known of the name."""
    return F.col("last_close").isNull() & F.coalesce(*[F.col(c).cast("string") for c in _KNOWN]).isNull()


def first_gate() -> Column:
    """The first gate that a row's own strategy sets and its facts confirm as failed; null where none."""
    g, kind, sector = F.col("gates"), F.lower(F.trim(asset_kind(F.col("quote_type")))), F.lower(F.trim("sector"))
    cap = F.when(~known_foreign(), F.col("market_cap"))
    fails = (
        ("asset_kind", ~F.array_contains(g["asset_kinds"], kind)),
        ("market_cap", cap < g["min_market_cap"]),
        ("sector_excluded", F.array_contains(g["exclude_sectors"], sector)),
        ("sector_scope", ~F.array_contains(g["include_sectors"], sector)),
        ("payout_uncovered", F.col("payout_ratio") > g["max_payout"]),
    )
    return F.coalesce(*[F.when(fail, F.lit(name)) for name, fail in fails])


def first_fail(names: list[str]) -> Column:
    """The reason of the first criterion, in the order of a row's own screen, that is confirmed as failed under its own threshold; null where none."""
    if not names:
        return F.lit(None).cast("string")
    threshold = lambda n: F.try_element_at("thresholds", F.lit(n))
    cells = F.array(*[F.when(threshold(n).isNotNull(), F.struct(F.array_position("screen", F.lit(n)).alias("ord"), F.lit(n).alias("criterion"), CRITERIA[n].build(threshold(n)).cast(RESULT).alias("r"))) for n in names])
    worst = F.array_min(F.transform(F.filter(cells, lambda x: x["r"]["passed"] == F.lit(False)), lambda x: F.struct(x["ord"], reason_of(x["criterion"], x["r"]["observed"], x["r"]["threshold"]).alias("reason"))))
    return worst["reason"]


def wide(inputs: DataFrame, criteria: list[str], factors: list[str]) -> DataFrame:
    """Inputs with every column that gates, criteria and factors read; what is not there is null."""
    kinds = dict.fromkeys(_STRINGS, "string") | {c: "array<double>" for c in ("free_cash_flow_annual", "operating_cash_flow_annual", "capital_expenditure_annual", "total_revenue", "operating_income", "tax_provision", "pretax_income", "invested_capital")}
    need = {"last_close", "payout_ratio", *_KNOWN, *_STRINGS, *consumed_columns([(c, 0.0) for c in criteria])}
    extra = {c: kinds.get(c, "double") for c in need} | factor_columns()
    return inputs.withColumns({c: F.lit(None).cast(t) for c, t in sorted(extra.items()) if c not in inputs.columns})


def grade(members: DataFrame, lenses: DataFrame, inputs: DataFrame, strategies: list[RankStrategy], screens: dict[str, ScreenStrategy] = SCREENS) -> Grades:
    """members: (cohort, ticker); lenses: (cohort, strategy), which strategies a cohort is graded under; inputs: one wide row for each ticker.

    A member without inputs is unrateable. A strategy that is not among ``strategies`` grades nothing."""
    spark = inputs.sparkSession
    criteria = sorted({c for s in strategies if s.screen for c, _ in screens[s.screen].criteria})
    factors = list(dict.fromkeys(f for s in strategies for f in s.factors))
    # As many rows as there are strategies in the list.
    runs = lenses.select("cohort", "strategy").distinct().join(F.broadcast(strategy_rows(spark, strategies, screens)), "strategy")
    named = members.select("cohort", "ticker").distinct().join(wide(inputs, criteria, factors), "ticker", "left").withColumn("cells", factor_cells(factors))
    j = named.join(runs, "cohort").withColumn("shell", unrateable())
    gate, fail = first_gate(), first_fail(criteria)
    j = j.withColumn("gate", F.when(~F.col("shell"), gate)).withColumn("fail", F.when(~F.col("shell") & F.col("gate").isNull(), fail))
    status = F.when(F.col("shell"), "unrateable").when(F.col("gate").isNotNull() | F.col("fail").isNotNull(), "excluded")
    why = F.when(F.col("shell"), "no data").when(F.col("gate").isNotNull(), F.concat(F.lit("gate: "), "gate")).when(F.col("fail").isNotNull(), F.concat(F.lit("screen: "), "fail"))
    chosen = F.filter("cells", lambda x: F.array_contains("factors", x["factor"]))
    state = settled(j.select("cohort", "strategy", "ticker", status.alias("status"), why.alias("reason"), F.when(status.isNull(), chosen).alias("cells"), "factors", "missing", "cut"))
    run = F.struct("cohort", "strategy").alias("run")
    values = state.where("status is null").select(run, "ticker", "missing", "cut", "factors", F.explode("cells").alias("x")).select("run", "ticker", "missing", "cut", "factors", "x.*")
    values = values.withColumn("ord", F.array_position("factors", F.col("factor"))).drop("factors")
    ranked = rank_values(values)
    gone = excluded_of(values)
    key = [F.col("run.cohort").alias("cohort"), F.col("run.strategy").alias("strategy"), "ticker"]
    rows = ranked.select(*key, F.lit("ranked").alias("status"), F.lit(None).cast("string").alias("reason"), "seq", "position", "tied", "combined", "verdict", "n")
    rows = rows.unionByName(state.where("status is not null").select("cohort", "strategy", "ticker", "status", "reason"), allowMissingColumns=True)
    rows = rows.unionByName(gone.select(*key, F.lit("excluded").alias("status"), "reason"), allowMissingColumns=True)
    return Grades(rows, values.select(*key, "factor", "value", "source"))


def best_first(rows: DataFrame, ids: list[str]) -> DataFrame:
    """rows of ``grade`` -> cohort, ticker, graded (strategies that ranked it), rank_sum (null if none did), comparable (all of its cohort's did), cells map<strategy, struct<status,
    position, n, verdict, reason>>; in the order of a report: most graded, then the smallest sum, then the name."""
    cell = F.struct("status", "position", "n", "verdict", "reason")
    known = rows.where(F.col("strategy").isin(ids))
    asked = known.groupBy("cohort").agg(F.count_distinct("strategy").alias("asked"))
    out = known.groupBy("cohort", "ticker").agg(F.count("position").cast("int").alias("graded"), F.sum("position").alias("rank_sum"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("strategy", cell.alias("cell"))))).alias("cells"))
    return out.join(asked, "cohort").withColumn("comparable", F.col("graded") == F.col("asked")).drop("asked").orderBy("cohort", F.desc("graded"), F.col("rank_sum").asc_nulls_last(), "ticker")


def holdings(parsed: DataFrame, inputs: DataFrame, lenses: dict[str, list[str]], strategies: list[RankStrategy], scores: DataFrame, screens: dict[str, ScreenStrategy] = SCREENS) -> DataFrame:
    """Grades a list of holdings: parsed (ord, ticker, kind, skip_reason), lenses kind -> strategies, scores (ticker, score, computed, checks).

    One row for each name graded, with its cell under each lens of its kind, and one for each line skipped, with the reason and no grade. Kinds are cohorts of their own. The score stands
    beside the grades of stocks and moves none."""
    spark = inputs.sparkSession
    live = parsed.where("skip_reason is null")
    pairs = spark.createDataFrame([(k, s) for k, ids in lenses.items() for s in ids], "cohort string, strategy string")
    grades = grade(live.select(F.col("kind").alias("cohort"), "ticker"), pairs, inputs, strategies, screens)
    g = best_first(grades.rows, [s for ids in lenses.values() for s in ids])
    shown = F.when(F.col("score").isNotNull(), F.concat(F.col("score").cast("string"), F.lit("/9"))).when(F.col("computed").isNotNull(), F.concat(F.lit("abstained ("), F.col("computed").cast("string"), F.lit("/9 computable)"))).otherwise("no data")
    out = live.select("ord", "ticker", "kind").join(g.withColumnRenamed("cohort", "kind"), ["kind", "ticker"], "left").join(scores.select("ticker", "score", "computed", "checks"), "ticker", "left")
    out = out.select("ord", F.lit("graded").alias("status"), "kind", "ticker", "rank_sum", F.coalesce("graded", F.lit(0)).alias("graded_by"), F.coalesce("comparable", F.lit(False)).alias("comparable"), "cells", F.when(F.col("kind") == "stock", shown).alias("f_score"), F.when(F.col("kind") == "stock", F.col("checks")).alias("f_checks"))
    skipped = parsed.where("skip_reason is not null").select("ord", F.lit("skipped").alias("status"), "kind", "ticker", "skip_reason")
    return out.unionByName(skipped, allowMissingColumns=True)
