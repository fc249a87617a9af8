"""Exact self-join of texts by the Jaccard similarity of their word shingles, and its components.

1. Texts of equal sets form a class. Blocks of documents send the shingles of their classes to buckets by ranges
   of the hash; in its bucket each shingle is counted over the whole corpus, and what blocks get back are the
   shingles that more than one class holds, with their counts. A shingle of one class comes first in the rare-first order,
   and finds nothing.
2. Each class gives its prefix: with n shingles and threshold t, the first n - ceil(t n) + 1 in that
   order; two sets that are similar enough share one. Of a pair, the shorter set must show it within its first
   n - ceil(2 t / (1 + t) n) + 1. Places count the shingles of one class too, so a set whose prefix has nothing else is in no list.
3. In each shingle's posting list, classes stand by their places: those with the least of their own come first. Each is paired with the
   first of its list and with the one before it. A pair must allow for the overlap by its lengths, by what each has behind the common shingle, and
   by what both have before it, which the other lacks (suffix filter: parities of both sets' sizes in hash ranges count more such elements).
   What is left is verified on whole sets, each pair once. The links give first components.
4. In longer lists, all pairs of different components that pass the same filters are verified, but for those that already were. A pair within a component cannot change
   the components, so a group of near copies costs links in proportion to its size and no link between components is lost.

A null or empty text has an empty set and no links. A null doc_id takes no part; its component is
null. Rows that repeat an id are separate texts of one document: what either links with is
connected. Ties in the order are broken by the hash. Very long texts are taken whole. An empty table gives no rows. Extra columns are not read.
Candidates are found by 48 bits of the hashes, and verified by 64.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, pack_columns, slices, table, unpack_columns
from .components import components
from .shingles import shingle_set
from .wordblocks import bucket_count

#: Threshold as a fraction; words of a shingle; hash ranges of the suffix filter, a bit each; shingles in a block.
NUMERATOR, DENOMINATOR, WORDS, BITS, BLOCK_SHINGLES = 3, 4, 5, 512, 2_000_000
#: Bits of a hash that the candidate search compares; buckets, at most: 200 MB of text for each at 100 TB.
SHORT, BUCKETS = 48, 1 << 19


def class_id(s: np.ndarray) -> int:
    """63 bits of a digest of a sorted set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little") >> 1


_SENT = "key long, block long, payload binary, doc_ids array<long>, sizes array<int>, classes array<long>"
_ARROW = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("payload", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("classes", pa.list_(pa.int64()))])


def sent(docs: DataFrame, words: int, buckets: int) -> DataFrame:
    """A row for each block (key < 0) with its documents' ids, set sizes and classes; and for each bucket of it one with the
    shingles of its classes: hashes in order, and which of the block's classes holds each."""
    bounds = np.array([-(-(b << SHORT) // buckets) for b in range(buckets + 1)], np.uint64)

    def run(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        ids, sizes, classes, sets, seen, total = [], [], [], [], set(), 0

        def close():
            block = (part << 32) + made
            rows: list[list] = [[-1 - block], [block], [None], [ids], [sizes], [classes]]
            if sets:
                h = np.concatenate(sets) >> np.uint64(64 - SHORT)
                of = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
                order = np.argsort(h)
                h, of = h[order], of[order]
                cuts = np.searchsorted(h, bounds)
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    x = slice(cuts[b], cuts[b + 1])
                    for k, v in enumerate((b, block, pack_columns(np.diff(h[x], prepend=np.uint64(0)), of[x]), None, None, None)):
                        rows[k].append(v)
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, _ARROW, strict=True)], schema=_ARROW)

        for batch in slices(batches):
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle_set(text, words)
                cls = class_id(s) if len(s) else None
                ids.append(d)
                sizes.append(len(s))
                classes.append(cls)
                if d is not None and cls is not None and cls not in seen:
                    seen.add(cls)
                    sets.append(s)
                    total += len(s)
                if total >= BLOCK_SHINGLES or len(ids) >= BLOCK_SHINGLES:
                    yield close()
                    made += 1
                    ids, sizes, classes, sets, seen, total = [], [], [], [], set(), 0
        if ids:
            yield close()

    return docs.select("doc_id", "text").mapInArrow(run, _SENT)


def counted(rows: DataFrame) -> DataFrame:
    """In each bucket shingles are counted; each of its rows keeps those that it does not hold alone: hashes, classes, counts."""

    def run(t: pa.Table) -> pa.Table:
        if t.column("key")[0].as_py() < 0:
            return t.cast(_ARROW)
        parts = [unpack_columns(p) for p in t.column("payload").to_pylist()]
        h = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        order = np.argsort(h)
        v = h[order]
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        times = np.diff(np.append(first, len(v)))
        count = np.empty(len(v), np.int64)
        count[order] = np.repeat(times, times)
        payloads, at = [], 0
        for _, of in parts:
            x = slice(at, at + len(of))
            at += len(of)
            keep = count[x] > 1
            payloads.append(pack_columns(np.diff(h[x][keep], prepend=np.uint64(0)), of[keep], count[x][keep]) if keep.any() else None)
        return t.set_column(2, "payload", pa.array(payloads, pa.binary())).cast(_ARROW)

    return rows.groupBy("key").applyInArrow(run, _SENT)


def prefix_size(n, num: int, den: int):
    return n - -(-num * n // den) + 1


def listed(rows: DataFrame, num: int, den: int) -> DataFrame:
    """doc_id, n, cls of each document; and, with a null doc_id, shingle, place, n, cls of the shared shingles in the prefix of each class of each block."""

    def run(t: pa.Table) -> pa.Table:
        row = [k < 0 for k in t.column("key").to_pylist()].index(True)
        sizes, classes = t.column("sizes")[row].as_py(), t.column("classes")[row].as_py()
        doc_ids = t.column("doc_ids")[row].as_py()
        place_of: dict[int, int] = {}
        for d, n, c in zip(doc_ids, sizes, classes, strict=True):
            if d is not None and c is not None:
                place_of.setdefault(c, n)
        cls, size = np.fromiter(place_of, np.int64, len(place_of)), np.fromiter(place_of.values(), np.int64, len(place_of))
        parts = [unpack_columns(p) for p in t.column("payload").to_pylist() if p is not None]
        if parts:
            h = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
            of, count = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (1, 2))
            order = np.lexsort((h, count, of))
            h, of = h[order], of[order]
            shared = np.bincount(of, minlength=len(cls))
            place = np.arange(len(of)) - (np.cumsum(shared) - shared)[of] + (size - shared)[of]
            keep = place < prefix_size(size, num, den)[of]
            h, of, place = h[keep].astype(np.int64), of[keep], place[keep]
        else:
            h = of = place = np.zeros(0, np.int64)
        m, none = len(doc_ids), [None] * len(doc_ids)
        return pa.table(
            [pa.array([*doc_ids, *[None] * len(of)], pa.int64()), pa.array([*sizes, *size[of].tolist()], pa.int32()), pa.array([*classes, *cls[of].tolist()], pa.int64()), pa.concat_arrays([pa.array(none, pa.int64()), pa.array(h)]), pa.concat_arrays([pa.nulls(m, pa.int32()), pa.array(place.astype(np.int32))])],
            names=["doc_id", "n", "cls", "shingle", "place"],
        )

    return rows.where("key < 0 or payload is not null").groupBy("block").applyInArrow(run, "doc_id long, n int, cls long, shingle long, place int")


def least_overlap(m: int, n: int, num: int, den: int) -> int:
    """The smallest overlap of sets of m and n for which den * overlap >= num * union."""
    return -(-num * (m + n) // (num + den))


def may_link(n, p, m, q, num: int, den: int):
    """Whether sets of n and m, whose first common shingle has places p and q, may reach the threshold."""
    need = -(-num * (n + m) // (num + den))
    short, at = np.minimum(n, m), np.where(n <= m, p, q)
    found = short - -(-2 * num * short // (num + den)) + 1
    return (den * short >= num * np.maximum(n, m)) & (np.minimum(n - p, m - q) >= need) & (p + q <= n + m - 2 * need) & (at < found)


def may_link_column(n, p, m, q, num: int, den: int):
    """The same for columns."""
    n, p, m, q = (F.col(c) for c in (n, p, m, q))
    need = F.ceil(F.lit(num) * (n + m) / F.lit(num + den))
    short = F.least(n, m)
    found = short - F.ceil(F.lit(2 * num) * short / F.lit(num + den)) + 1
    return (den * short >= num * F.greatest(n, m)) & (F.least(n - p, m - q) >= need) & (p + q <= n + m - 2 * need) & (F.when(n <= m, p).otherwise(q) < found)


def list_pairs(num: int, den: int):
    """Over rows by (shingle, place, n, cls): pairs (a, b) of each class with the first of its list and the one before it, with place -1; and the rows of lists
    of three or more: b the shingle, a the class."""

    def run(batches):
        head = None  # shingle, class, n, place of the first and of the last row of the list so far, and its length
        for batch in batches:
            if not batch.num_rows:
                continue
            s, c, n, p = (batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("shingle", "cls", "n", "place"))
            old, length = 0, 0
            if head is not None:
                old, length = 2, head[1]
                s, c, n, p = (np.concatenate([a, b]) for a, b in zip(head[0], (s, c, n, p), strict=True))
            # A class that several blocks hold stands in a list several times, one after the other.
            again = np.concatenate([[False], (s[1:] == s[:-1]) & (c[1:] == c[:-1])])
            again[:old] = False
            if again.any():
                s, c, n, p = s[~again], c[~again], n[~again], p[~again]
            start = np.concatenate([[True], s[1:] != s[:-1]])
            first = np.flatnonzero(start)
            run_of = np.cumsum(start) - 1
            index = np.arange(len(s)) - first[run_of]
            if old:
                index[run_of == 0] += length - 2
                index[:2] = (0, length - 1)
            new = np.arange(len(s)) >= old
            pairs: list[list] = [[], []]
            for at, before in (((x := np.flatnonzero(new & (index >= 1))), first[run_of[x]]), ((y := np.flatnonzero(new & (index >= 2))), y - 1)):
                ok = may_link(n[at], p[at], n[before], p[before], num, den)
                pairs[0].append(c[at[ok]])
                pairs[1].append(c[before[ok]])
            a, b = np.concatenate(pairs[0]), np.concatenate(pairs[1])
            ab = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            none = np.zeros(ab.shape[1], np.int64)
            third = np.flatnonzero(new & (index == 2))
            x = np.concatenate([third - 2, third - 1, np.flatnonzero(new & (index >= 2))])
            yield pa.record_batch([pa.array(np.concatenate([u, v])) for u, v in ((ab[0], c[x]), (ab[1], s[x]), (none, n[x]), (none - 1, p[x]))], names=["a", "b", "n", "place"])
            last = len(s) - 1
            top = first[-1]
            head = (tuple(np.array([v[top], v[last]]) for v in (s, c, n, p)), int(index[last]) + 1)

    return run


def parities(s: np.ndarray) -> list[int]:
    """The parity of the set's size in each hash range, packed."""
    odd = (np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).tolist()


def fits(a, b, n_a, n_b, num: int, den: int):
    """Whether the parities leave room for enough overlap."""
    apart = sum(F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(BITS // 64))
    return apart <= n_a + n_b - 2 * F.ceil(F.lit(num) * (n_a + n_b) / F.lit(num + den))


def packed_texts(docs: DataFrame, of: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """cls, n, parity, packed: a compressed text for each wanted class. of: (cls, doc_id), one document for each class."""

    def run(batches):
        for batch in slices(batches):
            rows: list[tuple] = []
            for text, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle_set(text, words)
                if len(s) and class_id(s) == want:
                    rows.append((want, len(s), parities(s), zstandard.ZstdCompressor(3).compress(text.encode("utf-8", "surrogatepass"))))
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()))], names=["cls", "n", "parity", "packed"])

    ids = of.join(wanted, "cls")
    return docs.join(ids, "doc_id").select("text", "cls").mapInArrow(run, "cls long, n long, parity array<long>, packed binary").dropDuplicates(["cls"])


def verified(pairs: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    known = texts.select("cls", "n", "parity")
    pairs = pairs.join(known.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("parity").alias("p_a")), "a").join(known.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("parity").alias("p_b")), "b")
    pairs = pairs.where(fits(F.col("p_a"), F.col("p_b"), F.col("n_a"), F.col("n_b"), num, den)).select("a", "b")
    # One text travels with its pair to where the other one is.
    both = pairs.join(texts.select(F.col("cls").alias("a"), F.col("packed").alias("t_a")), "a").join(texts.select(F.col("cls").alias("b"), F.col("packed").alias("t_b")), "b")

    def run(batches):
        held: dict[int, np.ndarray] = {}

        def of(key, data):
            if key not in held:
                if len(held) > 200:
                    held.clear()
                held[key] = shingle_set(zstandard.ZstdDecompressor().decompress(data).decode("utf-8", "surrogatepass"), words)
            return held[key]

        for batch in slices(batches):
            a, b, ta, tb = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "b", "t_a", "t_b"))
            ok = []
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                s, t = of(x, ta[i]), of(y, tb[i])
                common = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(den * common >= num * (len(s) + len(t) - common))
            yield pa.record_batch([pa.array([v for v, k in zip(c, ok, strict=True) if k], pa.int64()) for c in (a, b)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def across(longer: DataFrame, comp: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: the pairs of different components in the lists that pass the filters. Of each list the largest component is only compared with the others."""
    placed = longer.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    placed = materialise(placed.select("shingle", "cls", "n", "place", "component"), "placed")
    sizes = placed.groupBy("shingle", "component").count()
    most = sizes.groupBy("shingle").agg(F.max_by("component", F.struct("count", "component")).alias("most"), F.count(F.lit(1)).alias("k")).where("k > 1").select("shingle", "most")
    mixed = placed.join(most, "shingle")
    x, y = mixed.where("component <> most").alias("x"), mixed.alias("y")
    once = F.expr("x.shingle = y.shingle and x.component <> y.component and (y.component = y.most or x.cls < y.cls)")
    found = x.join(y, once & may_link_column("x.n", "x.place", "y.n", "y.place", num, den))
    return found.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct()


def near_components(docs: DataFrame, words: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id, a row for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialise(listed(counted(sent(docs, words, bucket_count(docs))), num, den), "listed")
    h = rows.where("shingle is null").select("doc_id", "n", "cls")
    lists = rows.where("shingle is not null").repartition("shingle").sortWithinPartitions("shingle", "place", "n", "cls")
    made = materialise(lists.select("shingle", "cls", "n", "place").mapInArrow(list_pairs(num, den), "a long, b long, n long, place long"), "made")
    pairs = materialise(made.where("place < 0").select("a", "b").distinct(), "pairs")
    longer = made.where("place >= 0").select(F.col("b").alias("shingle"), F.col("a").alias("cls"), "n", "place")
    of = h.where("doc_id is not null and cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).union(longer.select("cls")).distinct()
    texts = materialise(packed_texts(docs, of, wanted, words), "texts")
    first = links = materialise(verified(pairs, texts, words, num, den), "links")
    more = materialise(across(longer, components(links), num, den).join(pairs, ["a", "b"], "left_anti"), "more")
    links = links.union(verified(more, texts, words, num, den))
    # Rows that share an id are one document.
    twice = h.where("doc_id is not null and cls is not null").groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b").select("a", "b")
    several = h.join(h.groupBy("doc_id").agg(F.min("cls").alias("a"), F.countDistinct("cls").alias("k")).where("k > 2"), "doc_id").where("cls is not null").select("a", F.col("cls").alias("b"))
    final = components(links.union(twice).union(several))
    known = h.join(final.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    known = materialise(known, "components")
    for done in (rows, made, pairs, texts, first, more, final):
        discard(done)
    least = known.where("cls is not null and doc_id is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    out = known.join(least, "component", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("cls").isNotNull(), F.col("least")), F.col("doc_id"))))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose 5-word shingles have a Jaccard similarity of 0.75 or more, as components."""
    return near_components(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
r AS (SELECT DISTINCT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.doc_id = d.doc_id
"""
