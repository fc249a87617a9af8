"""Connected components of a table of links, by alternating stars.

Links are first contracted within partitions of about ``PART_LINKS`` links by union-find; up to that many
links in all, this is the whole work. Beyond, large-star and small-star rounds join
each node with the smallest of its neighbours until nothing changes. Minima come from partial
aggregations and joins, so a node of very many links is not gathered.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

PART_LINKS = 500_000


def contract(batches):
    """Each node's smallest fellow among the links of a partition."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """links: two columns of long. node, component: each linked node but the smallest ones, with the smallest it is connected to."""
    a, b = links.columns
    e = materialise(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")), "links")
    n = e.count()
    parts = max(1, -(-n // PART_LINKS))
    # One part must be one task, or links would be left between parts.
    whole, e = e, materialise((e.coalesce(1) if parts == 1 else e.repartition(parts, "u")).mapInArrow(contract, "u long, v long"), "links")
    discard(whole)
    before = None
    while parts > 1:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        old, e = e, materialise(small.where("u <> v").distinct(), "links")
        discard(old)
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
