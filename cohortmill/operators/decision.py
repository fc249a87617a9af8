"""Decision operators: gating, matrix, disposition, vetoes, stability, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gating(screen: DataFrame, names: list[str]) -> DataFrame:
    """ticker, failed, not_evaluated (names in order), ceiling ('SELL' or null), insufficient. A confirmed fail outranks a null."""
    g = screen.where(F.col("criterion").isin(*names))
    pick = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("ord", "criterion")))), lambda s: s["criterion"])
    a = g.groupBy("ticker").agg(pick(F.col("passed") == F.lit(False)).alias("failed"), pick(F.col("passed").isNull()).alias("not_evaluated"))
    return a.withColumn("ceiling", F.when(F.size("failed") > 0, "SELL")).withColumn("insufficient", F.size("not_evaluated") > 0)


def criterion_points(criterion: Column, passed: Column, observed: Column, threshold: Column, weight: Column) -> Column:
    """weight x margin held to [-1, 1], towards the better side; null 0; without a margin plus or minus the weight."""
    sign = F.when(criterion.startswith("max_"), -1.0).otherwise(1.0)
    margin = F.when(observed.isNotNull() & (threshold != 0), sign * (observed - threshold) / F.abs(threshold))
    return F.when(passed.isNull(), 0.0).when(margin.isNull(), F.when(passed, weight).otherwise(-weight)).otherwise(weight * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), margin)))


#: What a stance counts.
STANCES = {"bullish": 1.0, "neutral": 0.0, "bearish": -1.0}


def momentum_points(observed: Column, cap: float, weight: float) -> Column:
    """The signed return held to [-cap, cap], times the weight; an unknown return is worth nothing."""
    return F.when(observed.isNull(), 0.0).otherwise(F.greatest(F.lit(-cap), F.least(F.lit(cap), observed)) * weight)  # least and greatest skip nulls


def stance_points(opinions: DataFrame, weight: float) -> DataFrame:
    """(ticker, stance, confidence) -> ticker, stance_total: each stance times its confidence and the weight; one that is unknown counts nothing."""
    n = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STANCES.items() for x in kv]), F.lower("stance")), F.lit(0.0))
    return opinions.groupBy("ticker").agg(F.sum(n * F.coalesce("confidence", F.lit(0.0)) * weight).alias("stance_total"))


def matrix(screen: DataFrame, weights: dict[str, float], gates: list[str], buy: float, sell: float, borderline: float = 0.1, momentum: tuple[float, float] = (0.5, 0.0), opinions: DataFrame | None = None, stance_weight: float = 0.0) -> DataFrame:
    """ticker, score (null where a gate failed or could not be evaluated), verdict, borderline. momentum: (cap, weight) of the signed return;
    opinions: (ticker, stance, confidence) that tilt the score. Without opinions it is the matrix of the screen alone."""
    w = F.broadcast(screen.sparkSession.createDataFrame(sorted(weights.items()), "criterion string, weight double"))  # a strategy's criteria
    plain = criterion_points(F.col("criterion"), F.col("passed"), F.col("observed"), F.col("threshold"), F.coalesce("weight", F.lit(0.0)))
    s = screen.join(w, "criterion", "left").withColumn("points", F.when(F.col("criterion") == "min_price_momentum", momentum_points(F.col("observed"), *momentum)).otherwise(plain))
    g = F.col("criterion").isin(*gates)
    a = s.groupBy("ticker").agg(F.sum("points").alias("total"), F.coalesce(F.bool_or(g & (F.col("passed") == F.lit(False))), F.lit(False)).alias("gated"), F.bool_or(g & F.col("passed").isNull()).alias("open"))
    if opinions is not None:
        a = a.join(stance_points(opinions, stance_weight), "ticker", "left").withColumn("total", F.col("total") + F.coalesce("stance_total", F.lit(0.0)))
    score = F.when(~F.col("gated") & ~F.col("open"), F.col("total"))
    v = F.when(F.col("gated"), "SELL").when(F.col("open"), "INSUFFICIENT").when(score >= buy, "BUY").when(score <= sell, "SELL").otherwise("HOLD")
    near = F.coalesce((F.abs(score - buy) <= borderline) | (F.abs(score - sell) <= borderline), F.lit(False))
    return a.select("ticker", score.alias("score"), v.alias("verdict"), near.alias("borderline"))


_LADDER = ("SELL", "HOLD", "BUY")


def exceeds(recommendation: Column, ceiling: Column) -> Column:
    """Whether a recommendation stands above the ceiling; a word off the ladder raises."""
    place = lambda c: F.when(c.isNull(), F.lit(None).cast("int")).otherwise(F.when(F.upper(c).isin(*_LADDER), F.array_position(F.array(*map(F.lit, _LADDER)), F.upper(c))).otherwise(F.raise_error(F.concat(F.lit("not on the ladder: "), c)).cast("int")))
    return F.coalesce(place(recommendation) > place(ceiling), F.lit(False))


def stability(runs: DataFrame, key: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """(key, verdict, confidence) -> key, n, modal (most frequent, ties alphabetical), modal_n, mean, population sd, min, max, label, distribution ('BUY:2;HOLD:1')."""
    per = runs.groupBy(*key, "verdict").agg(F.count(F.lit(1)).alias("k"), F.sum("confidence").alias("s"), F.sum(F.col("confidence") * F.col("confidence")).alias("q"), F.count("confidence").alias("m"), F.min("confidence").alias("lo"), F.max("confidence").alias("hi"))
    a = per.groupBy(*key).agg(
        F.sum("k").alias("n"), F.min_by("verdict", F.struct(-F.col("k"), F.col("verdict"))).alias("modal"), F.max("k").alias("modal_n"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("lo").alias("lowest"), F.max("hi").alias("highest"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("verdict", "k"))), lambda x: F.concat_ws(":", x["verdict"], x["k"].cast("string"))), ";").alias("distribution"),
    )
    mean = F.col("s") / F.col("m")
    share = F.col("modal_n") / F.col("n")
    label = F.when(share == 1, "stable").when(share >= 0.8, "mostly stable").when(share > 0.5, "leaning").otherwise("unstable")
    return a.select(*key, "n", "modal", "modal_n", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("m") - mean * mean)).alias("sd"), "lowest", "highest", label.alias("label"), "distribution")


#: Weights of the coverage components.
COVERAGE = {"criteria": 0.30, "factors": 0.20, "provenance": 0.25, "fundamentals": 0.15, "price": 0.10}


def coverage_score(parts: dict[str, Column]) -> Column:
    """Weighted sum of components, each held to [0, 1]; one that was not measured counts 1."""
    total = sum(F.lit(w) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(parts[k], F.lit(1.0)))) for k, w in COVERAGE.items())
    return F.bround(total, 4)


def vetoes(flags: dict[str, Column]) -> Column:
    """Names of the triggers that fired, in the given order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), k) for k, c in flags.items()]))


def latest_directional(history: DataFrame) -> DataFrame:
    """The newest BUY, HOLD or SELL of each (ticker, strategy_id) that is no override. history: run_at, seq, verdict, is_override."""
    h = history.where(F.upper("verdict").isin(*_LADDER) & ~F.coalesce("is_override", F.lit(False)))
    return h.groupBy("ticker", "strategy_id").agg(F.max_by(F.struct("verdict", "run_at"), F.struct("run_at", "seq")).alias("x")).select("ticker", "strategy_id", "x.*")


def consensus_stance(opinions: DataFrame) -> DataFrame:
    """Majority of stances that do not abstain; ties are neutral. opinions: (ticker, stance in bullish, bearish, neutral, abstain)."""
    a = opinions.groupBy("ticker").agg(F.count_if(F.col("stance") == "bullish").alias("up"), F.count_if(F.col("stance") == "bearish").alias("down"), F.count_if(F.col("stance") == "neutral").alias("flat"))
    v = F.when((F.col("up") > F.col("down")) & (F.col("up") > F.col("flat")), "bullish").when((F.col("down") > F.col("up")) & (F.col("down") > F.col("flat")), "bearish").otherwise("neutral")
    return a.select("ticker", v.alias("stance"))
