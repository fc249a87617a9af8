"""Approximate nearest neighbours: an inverted file of product-quantised residuals with exact reranking.

Coarse centroids and the residuals' codebooks are fitted on a bounded sample; every vector is indexed. Each vector is coded by its cell and the nearest entries of its
residual's parts; codes are then regrouped by cell, so a cell is a list, in blocks. Queries are packed by the cells they probe and meet the lists in a join. There, asymmetric distances come
from a query's tables of inner products with the codebooks, for all vectors of a list by look-ups; those under the query's bound are measured exactly in double precision. The bound is
the distance that a share of the sample's codes lies under; that share, and the share of cells to probe, are what the sample's own exact neighbours need. The best of each task are merged for each
query. A cell's size is no bound: a large one is many blocks. A query that comes out with too few is searched again, in all cells and exactly.

Vectors that are null, all zero, or hold a null or non-finite component take no part, nor do those
of another length than the most frequent one (the smallest such on a tie). Null ids take no part.
Repeated ids are separate rows; a query skips all rows of its own id. Ties go to the smaller id.
With fewer candidates than k, all are returned. An empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, table

#: Vectors that the centroids and codebooks are fitted on, at most; those of them whose codes give a query its bound; cells, at most; vectors in a block; queries that meet it at once; queries
#: whose best a task holds before it hands them on.
SAMPLE_ROWS, BOUND_ROWS, CELLS, BLOCK_ROWS, TOGETHER, HELD = 16384, 4096, 4096, 4096, 128, 50_000
#: Parts of a residual, one byte each; shares of the sample's neighbours that lie in the probed cells, and under the bound.
PARTS, PROBED, BOUNDED = 16, 0.97, 0.99
_INDEX = "cell int, n int, ids binary, codes binary, vectors binary"


class Model(NamedTuple):
    """Centroids; codebooks of a residual's parts; share of the cells to probe; share of all codes under a query's bound; codes, cells and squared lengths of part of the sample."""

    cells: np.ndarray
    books: list
    probe: float
    bound: float
    codes: np.ndarray
    cell: np.ndarray
    lengths: np.ndarray

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = _nearest(x, self.cells)
        rest = x - self.cells[cell]
        return cell, np.stack([_nearest(r, b) for r, b in zip(self.parts(rest), self.books, strict=True)], axis=1).astype(np.uint8)

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        edges = np.cumsum([0, *(b.shape[1] for b in self.books)])
        return [x[:, a:z] for a, z in zip(edges, edges[1:], strict=False)]

    def squares(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared lengths of the vectors that the codes stand for."""
        return ((self.cells[cell] + np.concatenate([b[codes[:, p]] for p, b in enumerate(self.books)], axis=1)) ** 2).sum(1)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """For each part, -2 times the inner products of queries with the entries of its codebook."""
        return [-2 * x @ b.T for x, b in zip(self.parts(q), self.books, strict=True)]


def asymmetric(tables: list[np.ndarray], base: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Squared distances of queries to coded vectors, less the query's squared length; ``base``: -2 times the inner products of queries with the vectors' centroids."""
    out = base + lengths[None, :]
    for p, t in enumerate(tables):
        out += t[:, codes[:, p]]
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and size(embedding) > 0")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.coalesce(fine, F.lit(False))).where(F.exists("embedding", lambda x: x != 0))
    dims = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return v.where(F.size("embedding") == (dims.d if dims else 0))


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin(np.einsum("ij,ij->i", c, c)[None, :] - 2 * x @ c.T, axis=1)


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        a = np.concatenate([_nearest(x[i : i + 4096], c) for i in range(0, len(x), 4096)])
        n = np.bincount(a, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, a, x)
        full = n > 0
        c[full] = sums[full] / n[full, None]
        if not full.all():
            c[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return c


def shares(x: np.ndarray, model: Model, k: int, seed: int) -> tuple[float, float]:
    """Of the sample's own exact neighbours, the share of the cells, nearest first, that holds PROBED, and the share of all codes, nearest first, that BOUNDED are among."""
    rng = np.random.default_rng(seed)
    cell, codes = model.coded(x)
    lengths = model.squares(cell, codes)
    places, ranks = [], []
    for i in rng.choice(len(x), min(256, len(x)), replace=False):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        best = np.argsort(d)[: min(k, len(x) - 1)]
        order = np.argsort(np.argsort(((model.cells - x[i]) ** 2).sum(1)))
        places += order[cell[best]].tolist()
        q = x[i : i + 1]
        a = asymmetric(model.tables(q), -2 * (q @ model.cells.T)[:, cell], codes, lengths)[0]
        ranks += np.searchsorted(np.sort(a), a[best]).tolist()
    if not places:
        return 1.0, 1.0
    # A few places more than the neighbours need, so that a bound holds k of them at least.
    return float(1 + np.quantile(places, PROBED)) / len(model.cells), min(1.0, float(1 + 2 * k + np.quantile(ranks, BOUNDED)) / len(x))


def fit(vectors: DataFrame, n_cells: int | None = None, n_parts: int = PARTS, k: int = 10, seed: int = 7) -> Model | None:
    """The model, from a bounded sample: the SAMPLE_ROWS rows of the smallest hashes, wherever they stand in the table."""
    n = vectors.count()
    if not n:
        return None
    # The filter leaves little more than the sample to the sort.
    h = F.xxhash64(F.lit(3), "vec_id")
    few = vectors.where(F.pmod(h, F.lit(1 << 30)) < min(1.0, 1.2 * SAMPLE_ROWS / n + 1000 / n) * (1 << 30))
    rows = few.orderBy(F.pmod(h, F.lit(1 << 30)), "vec_id").limit(SAMPLE_ROWS).collect()
    x = np.array([r.embedding for r in rows], np.float32)
    cells = kmeans(x, n_cells or max(1, min(CELLS, len(x) // 8, int(4 * n**0.5))), seed)
    rest = x - cells[_nearest(x, cells)]
    books = [kmeans(np.ascontiguousarray(p), 256, seed + i) for i, p in enumerate(np.array_split(rest, min(n_parts, x.shape[1]), axis=1))]
    none = np.zeros(0, np.int64)
    model = Model(cells, books, 1.0, 1.0, none, none, none)
    cell, codes = model.coded(x[:BOUND_ROWS])
    probe, bound = shares(x, model, k, seed)
    return Model(cells, books, probe, bound, codes, cell, model.squares(cell, codes))


def index(vectors: DataFrame, model: Model) -> DataFrame:
    """Lists of all vectors by cell, in blocks of about BLOCK_ROWS: cell, n, ids, codes, vectors (float64)."""
    # Bounded: at most CELLS centroids, 256 entries for each part and BOUND_ROWS codes.
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    names = ["cell", "n", "ids", "codes", "vectors"]

    def code(batches):
        m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(len(ids), -1)
            cell, codes = m.coded(x.astype(np.float32))
            order = np.lexsort((ids, cell))
            starts = np.flatnonzero(np.diff(cell[order], prepend=-1))
            out: list[tuple] = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
                for i in range(a, b, BLOCK_ROWS):
                    at = order[i : min(b, i + BLOCK_ROWS)]
                    out.append((int(cell[at[0]]), len(at), ids[at].tobytes(), codes[at].tobytes(), x[at].tobytes()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=names)

    def whole(t: pa.Table) -> pa.Table:
        cols = {c: t.column(c).to_pylist() for c in names}
        return pa.table([pa.array([cols["cell"][0]], pa.int32()), pa.array([sum(cols["n"])], pa.int32()), *[pa.array([b"".join(cols[c])], pa.binary()) for c in names[2:]]], names=names)

    pieces = materialise(vectors.mapInArrow(code, _INDEX), "ivf-pieces")
    # A large cell is dealt over as many blocks as it fills.
    sizes = pieces.groupBy("cell").agg(F.ceil(F.sum("n") / BLOCK_ROWS).alias("blocks"))
    dealt = pieces.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("ids"), F.col("blocks")))  # one row for each of the bounded centroids
    return dealt.select("cell", "block", *names[1:]).groupBy("cell", "block").applyInArrow(whole, _INDEX)


def search(queries: DataFrame, blocks: DataFrame, model: Model, k: int = 10, exact: bool = False, tally=None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query among the vectors of the probed cells under its bound; with ``exact``, among all. ``tally``, an accumulator, counts the vectors that are
    measured exactly.

    A query probes the nearest cells, as many as the model's share says, and further ones until they hold 4 (k + 1) vectors."""
    sizes = np.zeros(len(model.cells), np.int64)
    for r in blocks.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most one row for each of the bounded centroids
        sizes[r.cell] = r.n
    shared = queries.sparkSession.sparkContext.broadcast((model, sizes))

    def probed(batches):
        m, size = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                ids = part.column(0).to_numpy()
                x = part.column(1).flatten().to_numpy().reshape(len(ids), -1)
                f = x.astype(np.float32)
                inner = -2 * f @ m.cells.T
                near = np.argsort(np.einsum("ij,ij->i", m.cells, m.cells)[None, :] + inner, axis=1, kind="stable")
                held = np.cumsum(size[near], axis=1)
                # The place of the last cell each query probes.
                last = np.maximum(int(np.ceil(m.probe * len(m.cells))), 1 + np.argmax(held >= min(4 * (k + 1), int(size.sum())), axis=1))
                bound = np.full(len(ids), np.inf, np.float32)
                if exact:
                    last[:] = len(m.cells)
                elif m.bound < 1:
                    nth = min(len(m.codes) - 1, int(np.ceil(m.bound * len(m.codes))))
                    for i in range(0, len(ids), 64):
                        a = asymmetric(m.tables(f[i : i + 64]), inner[i : i + 64][:, m.cell], m.codes, m.lengths)
                        bound[i : i + 64] = np.partition(a, nth, axis=1)[:, nth]
                q, place = np.nonzero(np.arange(len(m.cells))[None, :] < last[:, None])
                cell = near[q, place]
                keep = size[cell] > 0
                q, cell = q[keep], cell[keep]
                order = np.argsort(cell, kind="stable")
                starts = np.flatnonzero(np.diff(cell[order], prepend=-1))
                out = []
                for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
                    for i in range(a, b, TOGETHER):
                        at = q[order[i : min(b, i + TOGETHER)]]
                        out.append((int(cell[order[a]]), ids[at].tobytes(), x[at].tobytes(), bound[at].tobytes()))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["cell", "q_ids", "q_vectors", "bounds"])

    def meet(batches):
        m, _ = shared.value
        d = m.cells.shape[1]
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of each query, the best of the task's blocks so far

        def out():
            n = [len(v[0]) for v in held.values()]
            yield pa.record_batch([pa.array(np.repeat(np.array(list(held), np.int64), n)), pa.array(np.concatenate([v[0] for v in held.values()])), pa.array(np.concatenate([v[1] for v in held.values()]))], names=["query_id", "vec_id", "score"])
            held.clear()

        for batch in batches:
            for cell, ids_, codes_, vecs_, q_ids, q_vecs, bounds in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("cell", "ids", "codes", "vectors", "q_ids", "q_vectors", "bounds")), strict=True):
                ids, qi = np.frombuffer(ids_, np.int64), np.frombuffer(q_ids, np.int64)
                codes = np.frombuffer(codes_, np.uint8).reshape(len(ids), -1)
                x, qx = np.frombuffer(vecs_, np.float64).reshape(-1, d), np.frombuffer(q_vecs, np.float64).reshape(-1, d)
                f = qx.astype(np.float32)
                bound = np.frombuffer(bounds, np.float32)
                if np.isinf(bound).all():
                    close = np.ones((len(qi), len(ids)), bool)
                else:
                    cells = np.full(len(ids), cell)
                    close = asymmetric(m.tables(f), -2 * (f @ m.cells[cell])[:, None], codes, m.squares(cells, codes)) <= bound[:, None]
                close &= qi[:, None] != ids[None, :]
                for i in np.flatnonzero(close.any(axis=1)).tolist():
                    pick = np.flatnonzero(close[i])
                    if tally is not None:
                        tally.add(len(pick))
                    one, dist, near = int(qi[i]), np.sqrt(((x[pick] - qx[i]) ** 2).sum(1)), ids[pick]
                    if one in held:
                        near, dist = np.concatenate([held[one][0], near]), np.concatenate([held[one][1], dist])
                    best = np.lexsort((near, dist))[:k]
                    held[one] = near[best], dist[best]
            if len(held) >= HELD:
                yield from out()
        if held:
            yield from out()

    packed = queries.mapInArrow(probed, "cell int, q_ids binary, q_vectors binary, bounds binary")
    best = blocks.join(packed, "cell").select("cell", "ids", "codes", "vectors", "q_ids", "q_vectors", "bounds").mapInArrow(meet, "query_id long, vec_id long, score double")
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, n_cells: int | None = None, n_parts: int = PARTS, tally=None) -> DataFrame:
    """The k nearest rows of ``vectors`` to each row of ``queries``; both (vec_id, embedding) as ``usable`` gives them."""
    model = fit(vectors, n_cells, n_parts, k)
    if model is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blocks = materialise(index(vectors, model), "ivf")
    found = materialise(search(queries, blocks, model, k, tally=tally), "ivf-found")
    # Queries with fewer than k, though there are more: once more, among all.
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    again = queries.join(full, "vec_id", "left_anti").select(*queries.columns)
    if again.isEmpty():
        return found
    return found.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").select(*found.columns).unionByName(search(again, blocks, model, k, exact=True))


def op8_ivfpq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of each vector whose id is divisible by 100, among all others."""
    v = usable(table(spark, sf_dir, "embeddings"))
    return nearest(v, v.where(F.col("vec_id") % 100 == 0))
