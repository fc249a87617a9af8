"""The cohort query: gates, screen, factors, ranks, verdicts; every name comes out with a status and a reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.factors import outcomes
from ..operators.order import numbered
from ..operators.screen import gate_cells, run_screen
from .cohorts import Grades, grade
from .strategy import SCREENS, RankStrategy, ScreenStrategy


@dataclass
class RankResult:
    """rows: ticker, status (ranked, excluded, unrateable), reason, seq, position, tied, combined, verdict; factors: LONG values; screen: LONG results."""

    rows: DataFrame
    factors: DataFrame
    screen: DataFrame | None


def rank(inputs: DataFrame, strategy: RankStrategy, screens: dict[str, ScreenStrategy] = SCREENS) -> RankResult:
    """All names of ``inputs`` as one cohort under one strategy."""
    g = _all_under(inputs, [strategy], screens)
    screen = run_screen(inputs, list(screens[strategy.screen].criteria)) if strategy.screen else None
    return RankResult(g.rows.select("ticker", "status", "reason", "seq", "position", "tied", "combined", "verdict"), g.values.select("ticker", "factor", "value", "source"), screen)


def _all_under(inputs: DataFrame, strategies: list[RankStrategy], screens: dict[str, ScreenStrategy]) -> Grades:
    ids = list(dict.fromkeys(s.id for s in strategies))
    lenses = inputs.sparkSession.createDataFrame([("all", i) for i in ids], "cohort string, strategy string")
    return grade(inputs.select(F.lit("all").alias("cohort"), "ticker"), lenses, inputs, strategies, screens)


def multi(inputs: DataFrame, strategies: list[RankStrategy], screens: dict[str, ScreenStrategy] = SCREENS) -> DataFrame:
    """The grid: ticker, one struct (position, verdict, status) for each strategy, n_ranked, rank_sum, in order, of one plan whatever the number of strategies; positions are summed only
    where ranked."""
    ids = list(dict.fromkeys(s.id for s in strategies))
    return grid(_all_under(inputs, strategies, screens).rows.select("ticker", "strategy", "position", "verdict", "status"), ids)


def grid(cells: DataFrame, ids: list[str]) -> DataFrame:
    wide = cells.groupBy("ticker").pivot("strategy", ids).agg(F.first(F.struct("position", "verdict", "status")))
    sums = cells.groupBy("ticker").agg(F.count("position").cast("int").alias("n_ranked"), F.sum("position").alias("rank_sum"))
    return wide.join(sums, "ticker").orderBy(F.desc("n_ranked"), "rank_sum", "ticker")


def check(inputs: DataFrame, cohort: RankResult, strategy: RankStrategy, ticker: str, screens: dict[str, ScreenStrategy] = SCREENS) -> dict[str, DataFrame]:
    """The single-name diagnostic: its gates, its screen, and each factor's value with the number of cohort values strictly better."""
    one = inputs.where(F.col("ticker") == ticker)
    mine = outcomes(one, list(strategy.factors)).select("factor", F.col("value").alias("own"), "source")
    spec = one.sparkSession.createDataFrame([(s.name, s.direction == "high") for s in strategy.specs()], "factor string, high boolean")
    vals = cohort.factors.where("value is not null").select("factor", "value").join(mine, "factor").join(F.broadcast(spec), "factor")
    better = F.when(F.col("high"), F.col("value") > F.col("own")).otherwise(F.col("value") < F.col("own"))
    place = vals.groupBy("factor").agg(F.count_if(better).alias("better"), F.count(F.lit(1)).alias("n"))
    record = cohort.rows.where(F.col("ticker") == ticker)
    out = {"gates": gate_cells(one, strategy.gates), "factors": mine.join(place, "factor", "left"), "record": record}
    if strategy.screen:
        out["screen"] = run_screen(one, list(screens[strategy.screen].criteria))
    return out


def shortlist(rows: DataFrame, runs_on: str, k: int = 0) -> DataFrame:
    """The ranked names that a closer look is run on: all, the first ``k``, or those rated buy."""
    live = rows.where("status = 'ranked'")
    if runs_on == "all":
        return live
    return live.where(F.col("seq") <= k) if runs_on == "top_k" else live.where("verdict = 'buy'")


def screen_ranking(inputs: DataFrame, strategy: ScreenStrategy, momentum: tuple[float, float] = (0.5, 0.0), key_fields: tuple[str, ...] = ("market_cap", "total_revenue", "operating_income")) -> DataFrame:
    """ticker, verdict, score, gated, error of each name by its screen alone. A name without any statement is 'unknown' with an error."""
    from ..operators.decision import matrix

    known = F.coalesce(*[F.col(c).cast("string") for c in key_fields]).isNotNull()
    m = matrix(run_screen(inputs, list(strategy.criteria)), strategy.weights, list(strategy.gating), strategy.buy, strategy.sell, momentum=momentum)
    j = inputs.select("ticker", known.alias("known")).join(m, "ticker", "left")
    return j.select("ticker", F.when(F.col("known"), F.col("verdict")).otherwise("unknown").alias("verdict"), F.when(F.col("known"), F.col("score")).alias("score"), (F.col("known") & F.col("score").isNull()).alias("gated"), F.when(~F.col("known"), "no fundamentals").alias("error"))


def split_rankings(rankings: DataFrame) -> DataFrame:
    """Adds part: scored, gated or other. Of the scored, the highest score comes first, ties by symbol; ``scored_at`` is the place from 1."""
    part = F.when(F.col("gated"), "gated").when(F.col("error").isNotNull() | F.col("score").isNull(), "other").otherwise("scored")
    r = numbered(rankings.withColumn("part", part), ["part"], -F.col("score"), "ticker")
    return r.withColumn("scored_at", F.when(F.col("part") == "scored", F.col("seq"))).drop("seq", "first", "same", "n")
