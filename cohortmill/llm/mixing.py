"""Mixing sources to target weights by Pfair scheduling.

A source's documents are cut into half blocks, one for each slot. Time is cut into periods. Where a period ends, each source stands at one
of the two whole numbers of half blocks around its exact share, by rounding the running sum of all shares; so any period can be worked out by itself, from the
weights alone. In it, half block j of a source with q of the period's P slots is released at
slot floor((j - 1) P / q) and due by slot ceil(j P / q); the earliest deadline goes first, ties by the later
release, then by name. On one processor no deadline is missed: a source is within one half block of a straight line from where it stands at
one end of the period to where it stands at the other, and that line within another of its exact share. So each source keeps within less than
one block of its target at any slot, however many there are. A period has two slots for the smallest weight, but no more than a task can hold.
The weights are exact fractions (to 2^-100, where their common denominator is longer). Tasks schedule the periods; the rows of
(source, half block, slot) are joined with the documents, and no source is gathered: a document's place within its
source comes from counts of hash buckets and its place in its own bucket. The driver holds one small row for each source.

A source that runs out leaves its slots free and the others move up, still in proportion. No
document is dropped or repeated. Sources without a given weight share what is left equally by count
of documents. A null source is a source of its own. Documents of a source are ordered by a hash of their id, then the id; rows
that share an id stand in any order. Null, empty and very long texts do not matter: texts are not read. Extra columns are not read
by ``positions`` and pass through ``mix``. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import floor, lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

#: Documents in a block, two slots; slots of a period, at least; documents for each hash bucket of a source; sources whose rows are broadcast, at most.
BLOCK_DOCS, PERIOD, BUCKET_DOCS, BROADCAST_SOURCES = 32, 4096, 20_000, 100_000
#: Slots of a period, at most: what a task schedules at a time.
LONGEST = 1 << 20


def ranked(sources) -> list:
    return sorted(sources, key=lambda s: (s is None, str(s)))


def parts(weights: dict) -> dict:
    """Whole numbers in proportion to the weights; exact unless their common denominator passes 128 bits."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = 1
    for w in exact.values():
        scale = lcm(scale, w.denominator)
        if scale.bit_length() > 128:
            scale = 1 << 100
            break
    return {s: max(1, floor(w * scale)) for s, w in exact.items()}


def slots_of(shares: list[int], blocks: list[int]) -> list[np.ndarray]:
    """The slot of each half block of each source in a period of sum(shares) slots: earliest deadline first among those released.
    ``blocks``: how many there are of the shares; a source that has fewer runs out."""
    total, out = sum(shares), [np.zeros(n, np.int64) for n in blocks]
    later = [(0, i, 1) for i, n in enumerate(blocks) if n]
    ready: list[tuple] = []
    t = 0
    while later or ready:
        if not ready:
            t = max(t, later[0][0])
        while later and later[0][0] <= t:
            release, i, j = heapq.heappop(later)
            heapq.heappush(ready, (-(-j * total // shares[i]), -release, i, j))
        i, j = heapq.heappop(ready)[2:]
        out[i][j - 1] = t
        if j < blocks[i]:
            heapq.heappush(later, (j * total // shares[i], i, j + 1))
        t += 1
    return out


def period(weights: list[int]) -> int:
    """Slots of a period: PERIOD, or as many as give the smallest weight two, LONGEST at most. Beyond, a smaller weight has a slot in some periods and none in others; where it stands
    when a period ends is within one half block of its share all the same."""
    return min(LONGEST, max(PERIOD, -(-2 * sum(weights) // min(weights))))


def stands(weights: list[int], slots: int) -> list[int]:
    """Half blocks of each source by a slot that ends a period: the running sum of the shares is rounded down, so that each is within one of
    its exact share and together they are ``slots``."""
    total, run, before, out = sum(weights), 0, 0, []
    for w in weights:
        run += w
        now = slots * run // total
        out.append(now - before)
        before = now
    return out


def schedule(spark: SparkSession, weights: list[int], halves: list[int]) -> DataFrame:
    """of int, half long, slot long: the slot of each of the ``halves`` of each source, from 1 and from 0. Each task has some periods."""
    size = period(weights)
    total = sum(weights)
    periods = max(-(-n * total // (w * size)) for w, n in zip(weights, halves, strict=True)) + 1

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                begin, end = stands(weights, k * size), stands(weights, (k + 1) * size)
                live = [min(e, n) - min(b, n) for b, e, n in zip(begin, end, halves, strict=True)]
                some = [i for i, n in enumerate(live) if n]
                if not some:
                    continue
                shares = [e - b for b, e in zip(begin, end, strict=True)]
                at = slots_of(shares, live)
                yield pa.record_batch(
                    [pa.array(np.repeat(np.array(some, np.int32), [live[i] for i in some])), pa.array(np.concatenate([begin[i] + 1 + np.arange(live[i]) for i in some])), pa.array(np.concatenate([k * size + at[i] for i in some]))],
                    names=["of", "half", "slot"],
                )

    return spark.range(0, periods, 1, min(periods, int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(run, "of int, half long, slot long")


def root(n: int) -> Fraction:
    """The usual target weight of a source of n documents: large sources weigh less than their size."""
    return Fraction(max(n, 1) ** 0.5).limit_denominator(10**6)


def positions(docs: DataFrame, weights: dict | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(doc_id, source) -> doc_id, source, block long (from 1 within the source), slot long, place long (within the slot).

    The order of (slot, place) is the mixture. A slot holds half a block."""
    spark = docs.sparkSession
    # A source's documents are shuffled by a hash of their id, in buckets of about BUCKET_DOCS.
    size = {r.source: r["count"] for r in docs.groupBy("source").count().collect()}
    if not size:
        return spark.createDataFrame([], "doc_id long, source string, block long, slot long, place long")
    weights = weights or {s: root(n) for s, n in size.items()}
    rest = sum(weights.values()) or 1
    exact = parts({s: weights.get(s) or Fraction(n, sum(size.values())) * rest for s, n in size.items()})
    names, half_docs = ranked(size), max(1, block_docs // 2)
    slots = schedule(spark, [exact[s] for s in names], [-(-size[s] // half_docs) for s in names])
    plan = spark.createDataFrame([(s, i, 1 + size[s] // BUCKET_DOCS) for i, s in enumerate(names)], "plan_source string, nr int, buckets long")
    plan = F.broadcast(plan) if len(names) <= BROADCAST_SOURCES else plan
    d = docs.select("doc_id", "source").join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    d = d.withColumn("hash", F.xxhash64(F.lit(11), "doc_id")).withColumn("bucket", F.pmod("hash", "buckets"))
    sizes = d.groupBy("nr", "bucket").count()
    before = sizes.withColumn("before", F.coalesce(F.sum("count").over(W.partitionBy("nr").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select(F.col("nr").alias("s"), F.col("bucket").alias("b"), "before")
    d = d.withColumn("at", F.row_number().over(W.partitionBy("nr", "bucket").orderBy("hash", "doc_id")))
    d = d.join(before, (F.col("nr") == F.col("s")) & (F.col("bucket") == F.col("b")))
    number = F.col("before") + F.col("at") - 1
    d = d.select("doc_id", "source", "nr", (F.floor(number / block_docs) + 1).alias("block"), (F.floor(number / half_docs) + 1).alias("nth"), (number % half_docs).alias("place"))
    return d.join(slots, (F.col("nr") == F.col("of")) & (F.col("nth") == F.col("half"))).select("doc_id", "source", "block", "slot", "place")


def mix(docs: DataFrame, weights: dict | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The rows of ``docs`` with all their columns, in the order of the mixture, over range partitions. Rows that share an id keep together."""
    order = positions(docs, weights, block_docs).groupBy("doc_id").agg(F.min(F.struct("slot", "place")).alias("__at"))
    joined = docs.join(order.withColumnRenamed("doc_id", "__id"), F.col("doc_id").eqNullSafe(F.col("__id")))
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = joined.select(*docs.columns, F.col("__at.slot").alias("__slot"), F.col("__at.place").alias("__place"))
    return placed.repartitionByRange(n, "__slot", "__place").sortWithinPartitions("__slot", "__place").drop("__slot", "__place")


def op5_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot of every document when sources are mixed by the root of their sizes."""
    return positions(table(spark, sf_dir, "documents"))
