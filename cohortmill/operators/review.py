"""Review of runs: agreement of two verdicts, source states, contested decisions, the decision ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decision import exceeds

#: Issues that degrade a source.
DEGRADING = ("FETCH_ERROR", "EMPTY_RESPONSE")


def agreement(rows: DataFrame) -> DataFrame:
    """(ticker, ranker, panel): state AGREE, DISAGREE or NOT-RUN."""
    return rows.withColumn("state", F.when(F.col("panel").isNull(), "NOT-RUN").when(F.upper("ranker") == F.upper("panel"), "AGREE").otherwise("DISAGREE"))


def agreement_counts(rows: DataFrame) -> DataFrame:
    a = agreement(rows)
    return a.agg(*[F.count_if(F.col("state") == s).alias(s.lower().replace("-", "_")) for s in ("AGREE", "DISAGREE", "NOT-RUN")])


def source_status(issues: DataFrame) -> DataFrame:
    """(source, ord, reason): the first degrading reason of each source, else its first reason."""
    bad = F.col("reason").isin(*DEGRADING)
    return issues.groupBy("source").agg(F.min_by("reason", F.struct(~bad, F.col("ord"))).alias("reason"), F.bool_or(bad).alias("degraded"))


def banner(issues: DataFrame) -> DataFrame:
    """One text of the degraded sources, in order; null where there is none."""
    s = source_status(issues).where("degraded")
    return s.agg(F.array_join(F.array_sort(F.collect_list(F.concat("source", F.lit(": "), "reason"))), "; ").alias("banner")).select(F.nullif("banner", F.lit("")).alias("banner"))


def contested(vetoes: Column, dissent: Column, confidence: Column, band: tuple[float, float] = (0.45, 0.55)) -> Column:
    """Reasons: vetoes and dissent are primary; a middling confidence only adds to them."""
    primary = F.array_compact(F.concat(F.transform(vetoes, lambda v: F.concat(F.lit("veto: "), v)), F.array(F.when(F.coalesce(dissent, F.lit(False)), "dissent"))))
    return F.when((F.size(primary) > 0) & confidence.between(*band), F.concat(primary, F.array(F.lit("confidence in the middle")))).otherwise(primary)


def decided(rows: DataFrame) -> DataFrame:
    """(ticker, base, ceiling, insufficient, vetoed) -> final verdict and why, from the top of the ladder: a confirmed ceiling, missing evidence, vetoes, the base."""
    above = exceeds(F.col("base"), F.col("ceiling"))
    final = F.when(F.col("ceiling").isNotNull(), F.when(above, F.upper("ceiling")).otherwise(F.upper("base"))).when(F.col("insufficient"), "INSUFFICIENT").when(F.size("vetoed") > 0, F.when(F.upper("base") == "BUY", "HOLD").otherwise(F.upper("base"))).otherwise(F.upper("base"))
    why = F.when(F.col("ceiling").isNotNull(), F.when(above, "ceiling").otherwise("base")).when(F.col("insufficient"), "evidence").when((F.size("vetoed") > 0) & (F.upper("base") == "BUY"), "veto").otherwise("base")
    return rows.select("ticker", final.alias("verdict"), why.alias("why"), (F.col("ceiling").isNotNull() | F.col("insufficient")).alias("gated"))


def footnotes(ranked: DataFrame, screen: DataFrame) -> DataFrame:
    """One row for each ranked name and criterion that abstained."""
    return screen.where("passed is null").join(ranked.where("status = 'ranked'").select("ticker"), "ticker", "left_semi").select("ticker", "criterion", F.coalesce("note", F.lit("no evidence")).alias("note"))


def pointer(screen: DataFrame, gates: DataFrame) -> DataFrame:
    """ticker, would_exclude: what would exclude a name, gates first; a list, never a verdict."""
    g = gates.where("state = 'FAIL'").select("ticker", F.struct(F.lit(0).alias("k"), "ord", F.col("gate").alias("what")).alias("x"))
    s = screen.where("passed = false").select("ticker", F.struct(F.lit(1).alias("k"), "ord", F.col("criterion").alias("what")).alias("x"))
    return g.unionByName(s).groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["what"]).alias("would_exclude"))


def per_agent(records: DataFrame, agents: list[str]) -> DataFrame:
    """(ticker, agent, stance): ticker, and each agent's most frequent stance, ties alphabetical."""
    c = records.groupBy("ticker", "agent", "stance").agg(F.count(F.lit(1)).alias("k"))
    m = c.groupBy("ticker", "agent").agg(F.min_by("stance", F.struct(-F.col("k"), F.col("stance"))).alias("modal"))
    return m.groupBy("ticker").pivot("agent", agents).agg(F.first("modal"))
