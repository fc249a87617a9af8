"""Periodic runs of words in whole texts, by probing a harmonic grid.

A run of period p that is three periods long or more holds a grid point g = jp with g, g + p and g + 2p inside it, whatever its place:
the first one at or after its start. There words are equal at g and g + p, and at g + p and g + 2p. So for each p only n / p grid points
are looked at, n log n in all, in array operations over many periods at once. Points that pass are extended by comparing the text with itself p words
on, in chunks that double. A point g whose words up to g + 2p lie in a run found before is passed over: it can only give that run again, or
one of a multiple of its period.

Words are `[^\\x20\\x09-\\x0D]+`, by their bytes, case kept. Null and empty texts have no words and no runs; their collapsed text is empty.
Very long texts are worked whole, with grid points in slices of bounded size. Of runs that tie for the greatest exponent the one of smallest start
is taken, then of smallest period. Repeated rows are each worked; a null doc_id is kept. Further columns are not read. An empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Numbering, table

#: Words of a run, at least; periods of a run, at least; grid points looked at in one step; bytes of results in a batch.
LEAST, TIMES, STEP, BATCH_BYTES = 24, 3, 1 << 20, 8 << 20


def stretch(words: np.ndarray, g: int, p: int) -> tuple[int, int]:
    """Where the words around ``g`` that repeat after ``p`` begin and end: the widest [start, end) with words p apart equal. words[g] equals words[g + p]."""
    n, start, at, chunk = len(words), g, g + 1, 32
    while start > 0:
        low = max(0, start - chunk)
        off = np.flatnonzero(words[low:start] != words[low + p : start + p])
        if len(off):
            start = low + int(off[-1]) + 1
            break
        start, chunk = low, 2 * chunk
    chunk = 32
    while at + p < n:
        top = min(n - p, at + chunk)
        off = np.flatnonzero(words[at:top] != words[at + p : top + p])
        if len(off):
            at += int(off[0])
            break
        at, chunk = top, 2 * chunk
    return start, at + p


def grid(first: int, n: int, times: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Periods and grid points of the periods from ``first`` on, below its double, that fit in a step; and the period to go on with."""
    top = min(2 * first, n // times + 1)
    # n / first points at most for each period.
    top = min(top, first + max(1, STEP * first // n))
    p = np.arange(first, top)
    points = n // p - 1  # g + 2p stays below n, or equals it
    points = np.where((points + 1) * p == n, points - 1, points)
    ends = np.cumsum(points)
    periods = np.repeat(p, points)
    return periods, (np.arange(int(ends[-1])) - np.repeat(ends - points, points)) * periods, top


def find_runs(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``words``, whole numbers, by start and period: the longest stretches whose words repeat after ``period``, their
    smallest one, of ``least`` words and ``times`` periods (3 or more) at least."""
    n, found, first = len(words), [], 1
    if n < max(least, times):
        return found
    reach = np.zeros(n, np.int64)  # the furthest end of the runs that hold a word
    while first <= n // times:
        p, g, first = grid(first, n, times)
        x = words[g]
        keep = np.flatnonzero(x == words[g + p])
        p, g = p[keep], g[keep]
        keep = (words[g] == words[g + 2 * p]) & (words[g + p // 2] == words[g + p // 2 + p]) & (reach[g] <= g + 2 * p)
        p, g = p[keep].tolist(), g[keep].tolist()
        done, of = 0, 0  # the last stretch of this period, found to be a run or not, ends there
        for q, i in zip(p, g, strict=True):
            if (q == of and i + q < done) or reach[i] > i + 2 * q:
                continue
            start, end = stretch(words, i, q)
            done, of = end, q
            if end - start >= max(least, times * q) and reach[start] < end:
                found.append((start, end - start, q))
                np.maximum(reach[start:end], end, out=reach[start:end])
    return sorted(found, key=lambda r: (r[0], r[2]))


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stand in a run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) > 0


def repeat_words(n: int, h: int) -> np.ndarray | None:
    """The planted repetition of the query: the numbers of the words that stand in each place, or None where a document keeps its own."""
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS = pa.list_(RUN)
OUT = pa.schema([("doc_id", pa.int64()), ("runs", RUNS), ("best", RUN), ("collapsed", pa.binary())])


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, planted: bool = False) -> DataFrame:
    """(doc_id, text) -> doc_id, runs array<struct<start, length, period>>, best: the run of greatest length / period, collapsed: the words joined by
    spaces, each run cut to its first period. With ``planted``, the words of one document in ten are first made to repeat, as ``repeat_words`` says."""

    def run(batches):
        rows, size = [], 0

        def batch():
            made = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), OUT, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(made, schema=OUT)

        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                doc_id, words = doc_id.as_py(), (text.as_py() or b"").split()
                at = repeat_words(len(words), zlib.crc32(str(doc_id).encode())) if planted and doc_id is not None else None
                if at is not None:
                    words = [words[i] for i in at.tolist()]
                number = Numbering()
                runs = find_runs(np.fromiter(map(number.__getitem__, words), np.int32, len(words)), least, times)
                if runs:
                    gone = dropped(len(words), runs).tolist()
                    words = [w for w, out in zip(words, gone, strict=True) if not out]
                named = [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs]
                best = min(named, key=lambda r: (-Fraction(r["length"], r["period"]), r["start"], r["period"]), default=None)
                rows.append((doc_id, named, best, b" ".join(words)))
                size += len(rows[-1][3]) + 32
                if size >= BATCH_BYTES:
                    yield batch()
                    size = 0
        if rows:
            yield batch()

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    runs = "struct<start:long,length:long,period:long>"
    return d.mapInArrow(run, f"doc_id long, runs array<{runs}>, best {runs}, collapsed binary")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, one in ten of them made to repeat: their number, the one of greatest exponent, digests of all and of the collapsed text."""
    found = periodic_runs(table(spark, sf_dir, "documents"), planted=True)
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    best = F.col("best")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
