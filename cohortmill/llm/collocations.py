"""Phrase collocations of each language, by level-wise passes.

A language's words go once through an exchange of distinct words: blocks of text name their words by place in a list of their own, buckets
meet each distinct word once, count it, and give the frequent ones a number; blocks get the numbers back and are written as sequences of numbers, with 0
where a piece ends or a word is rare. Nothing else reads a text again. A phrase of k words is counted only where both phrases of k - 1 words
in it are frequent: for pairs the numbers say so; for longer ones a table of bits of the frequent phrases of the level before is
broadcast. Its size has a bound (``TABLE_BITS``): more phrases than it has room for let some more through, which their own
counts then stop, so results are exact at any size. Counts are summed in a block, then in buckets by a hash of the phrase; a phrase that is everywhere
costs an entry for each block. Scores come from joins of the level tables: a phrase of k words with its first and its last k - 1.

Null languages are `und`; null and empty texts have no words. Very long texts are blocks of their own. Repeated rows count each time. A null doc_id is no matter, ids
and further columns are not read. Of cuts that tie the shortest first part is taken; phrases that tie stand in byte order. An empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Numbering, discard, materialise, pack_columns, pack_ints, pack_words, shuffle_partitions, table, unpack_columns, unpack_ints, unpack_words

#: How often a phrase must stand; words of the longest; phrases listed for a language; how many in 100 of a phrase's places a longer one must have to stand for it.
LEAST, WORDS, TOP, WITHIN = 30, 4, 2000, 80
#: Bytes of text in a block and for a bucket; buckets, at most; phrases merged at a time; bits of the broadcast table, at most, and for each phrase; bytes of one part of it.
BLOCK_BYTES, BUCKET_BYTES, BUCKETS, MERGED, TABLE_BITS, BITS_EACH, PART = 32 << 20, 4 << 20, 1 << 19, 1 << 21, 1 << 30, 16, 1 << 16

#: What ends a piece, and what stands between words.
ENDS, SPACES = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
_TABLE = bytes.maketrans(ENDS + SPACES, b"\n" * len(ENDS) + b" " * len(SPACES))

#: bucket -1: a block's sequence (n words, payload); else some of its words (payload) and their places and counts.
RAW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("lang", pa.string()), ("n", pa.int64()), ("payload", pa.binary()), ("counts", pa.binary())])
RAW_SQL = "block long, bucket int, lang string, n long, payload binary, counts binary"


def mixed(*ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of phrases, given by the numbers of their words."""
    h = np.full(len(ids[0]), len(ids), np.uint64)
    for x in ids:
        h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def word_blocks(docs: DataFrame, buckets: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(text binary, lang) -> rows of RAW: a task's texts of one language are gathered to blocks of ``block_bytes``."""

    def close(block: int, lang: str, numbers: Numbering, seqs: list) -> Iterator[pa.RecordBatch]:
        seq = np.concatenate(seqs)
        seq = seq[seq != 1]  # 0: the end of a piece; 1: what stands between two spaces
        count = np.bincount(seq, minlength=len(numbers))
        words = list(numbers)
        order = np.argsort(-count[2:], kind="stable") + 2
        place = np.zeros(len(words), np.uint32)
        place[order] = np.arange(1, len(order) + 1, dtype=np.uint32)
        seq = place[seq]
        twice = np.flatnonzero((seq[1:] == 0) & (seq[:-1] == 0))
        seq = np.delete(seq, twice)
        salt = zlib.crc32(lang.encode("utf-8", "surrogatepass"))
        where = np.fromiter((zlib.crc32(words[i], salt) % buckets for i in order.tolist()), np.int64, len(order))
        by = np.argsort(where, kind="stable")
        cuts = np.flatnonzero(np.diff(where[by], prepend=-1, append=-1))
        rows = [(block, -1, lang, int(count[2:].sum()), pack_ints(seq), None)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            at = by[a:b]
            rows.append((block, int(where[at[0]]), lang, None, pack_words([words[i] for i in order[at].tolist()]), pack_columns(at, count[order[at]])))
        yield _batch(RAW, rows)

    def run(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        open_: dict[str, list] = {}
        held = 0

        def shut(lang: str):
            nonlocal made, held
            numbers, seqs, size = open_.pop(lang)
            held -= size
            made += 1
            yield from close((part << 32) + made, lang, numbers, seqs)

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                raw = (text.as_py() or b"").lower().translate(_TABLE)  # lower() changes A-Z alone
                if lang not in open_:
                    numbers = Numbering()
                    open_[lang] = [numbers, [], 0]
                    numbers[b"\n"], numbers[b""]  # noqa: B018
                mine = open_[lang]
                pieces = (raw.replace(b"\n", b" \n ") + b" \n").split(b" ")
                mine[1].append(np.fromiter(map(mine[0].__getitem__, pieces), np.uint32, len(pieces)))
                mine[2] += len(raw)
                held += len(raw)
                # The largest goes when all together are as large as two blocks.
                if mine[2] >= block_bytes:
                    yield from shut(lang)
                elif held >= 2 * block_bytes:
                    yield from shut(max(open_, key=lambda x: open_[x][2]))
        for lang in list(open_):
            yield from shut(lang)

    return docs.mapInArrow(run, RAW_SQL)


#: block: a block's words (payload: places and numbers, 0 for rare ones); none: frequent words of the bucket (payload), and numbers and counts.
ANSWER = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("payload", pa.binary()), ("counts", pa.binary())])
ANSWER_SQL = "block long, lang string, payload binary, counts binary"


def number_words(raw: DataFrame, buckets: int, least: int) -> DataFrame:
    """Counts each bucket's distinct words and numbers those that stand ``least`` times: 1 + bucket + rank * buckets."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Numbering] = {}
        parts, sums = [], []
        for batch in batches:
            for block, lang, payload, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "lang", "payload", "counts")), strict=True):
                words = unpack_words(payload)
                numbers = seen.setdefault(lang, Numbering())
                parts.append((block, lang, np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), unpack_columns(counts)))
        total = {lang: np.zeros(len(numbers), np.int64) for lang, numbers in seen.items()}
        for _, lang, at, (_, count) in parts:
            np.add.at(total[lang], at, count.astype(np.int64))
        rank, ids, rows = 0, {}, []
        for lang in sorted(seen):
            words = list(seen[lang])
            kept = sorted(np.flatnonzero(total[lang] >= least).tolist(), key=words.__getitem__)
            ids[lang] = np.zeros(len(words), np.uint64)
            ids[lang][kept] = np.uint64(1 + key[0].as_py()) + (rank + np.arange(len(kept), dtype=np.uint64)) * np.uint64(buckets)
            rank += len(kept)
            if kept:
                sums.append((None, lang, pack_words([words[i] for i in kept]), pack_columns(ids[lang][kept], total[lang][kept])))
        for block, lang, at, (places, _) in parts:
            mine = ids[lang][at]
            some = np.flatnonzero(mine)
            if len(some):
                rows.append((block, lang, pack_columns(places[some], mine[some]), None))
        for rows_ in (sums, rows):
            for i in range(0, len(rows_), 5000):
                yield _batch(ANSWER, rows_[i : i + 5000])

    return raw.groupBy("bucket").applyInArrow(run, ANSWER_SQL)


#: A block's sequence (bucket -1, payload) or counts of some of its phrases (bucket, payload).
CODED = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])
CODED_SQL = "bucket int, payload binary"


def distinct(seq: np.ndarray, at: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct phrases of ``k`` words that begin at the places ``at`` of a sequence of small numbers: their words, and how often each stands."""
    code = seq[at].astype(np.uint64)
    for j in range(1, k):
        code = code << np.uint64(32) | seq[at + j]
        if j < k - 1:
            code = np.unique(code, return_inverse=True)[1].astype(np.uint64)
    _, first, count = np.unique(code, return_index=True, return_counts=True)
    return [seq[at[first] + j] for j in range(k)], count


def counted(names: np.ndarray, seq: np.ndarray, at: np.ndarray, k: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of CODED: phrases of ``k`` words at the places ``at``, by buckets, sorted by their words."""
    if not len(at):
        return
    words, count = distinct(seq, at, k)
    ids = [names[w] for w in words]
    where = (mixed(*ids) % np.uint64(buckets)).astype(np.int64)
    by = np.lexsort((*ids[::-1], where))
    ids, count, where = [x[by] for x in ids], count[by], where[by]
    cuts = np.flatnonzero(np.diff(where, prepend=-1, append=-1))
    rows = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        first = ids[0][a:b]
        rows.append((int(where[a]), pack_columns(np.diff(first, prepend=np.uint64(0)), *[x[a:b] for x in ids[1:]], count[a:b])))
        if len(rows) == 2000:
            yield _batch(CODED, rows)
            rows = []
    if rows:
        yield _batch(CODED, rows)


def code_blocks(raw: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """Each block's sequence in numbers of words, kept where two frequent words meet, and the counts of its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, places, ids = None, [], []
        for batch in batches:
            for kind, payload in zip(batch.column("kind").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if kind == 0:
                    seq = unpack_ints(payload)
                else:
                    a, b = unpack_columns(payload)
                    places.append(a)
                    ids.append(b)
        if seq is None or not places:
            return
        places, ids = np.concatenate(places), np.concatenate(ids)
        # Small numbers within the block, by frequency; 0 stands for rare words and the ends of pieces.
        by = np.argsort(places)
        small = np.zeros(int(seq.max()) + 1, np.uint32)
        small[places[by].astype(np.int64) + 1] = np.arange(1, len(by) + 1, dtype=np.uint32)
        names = np.concatenate([np.zeros(1, np.uint64), ids[by]])
        seq = small[seq]
        # Words without a frequent neighbour are in no phrase.
        beside = np.zeros(len(seq), bool)
        pair = (seq[:-1] > 0) & (seq[1:] > 0)
        beside[:-1] |= pair
        beside[1:] |= pair
        seq = np.where(beside, seq, 0)
        seq = np.delete(seq, np.flatnonzero((seq[1:] == 0) & (seq[:-1] == 0)))
        at = np.flatnonzero((seq[:-1] > 0) & (seq[1:] > 0))
        if len(at):
            # Names, then the sequence: two parts, the first one's length before them.
            a, b = pack_columns(names), pack_ints(seq)
            yield _batch(CODED, [(-1, len(a).to_bytes(8, "little") + a + b)])
            yield from counted(names, seq, at, 2, buckets)

    both = raw.select("block", F.lit(0).alias("kind"), "payload").union(answers.select("block", F.lit(1), "payload"))
    return both.groupBy("block").applyInArrow(run, CODED_SQL)


def longer(coded: DataFrame, k: int, bits, buckets: int) -> DataFrame:
    """The counts of phrases of ``k`` words of each block where the bit table has both phrases of k - 1 words."""

    def run(batches):
        held = bits.value
        top = np.uint64(8 * len(held) - 1)
        for batch in batches:
            for payload in batch.column(0):
                data = payload.as_py()
                n = int.from_bytes(data[:8], "little")
                (names,), seq = unpack_columns(data[8 : 8 + n]), unpack_ints(data[8 + n :])
                if len(seq) < k:
                    continue
                ids = names[seq]
                m = len(seq) - k + 2
                h = mixed(*[ids[j : j + m] for j in range(k - 1)]) & top
                known = (held[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                for j in range(k - 1):
                    known &= seq[j : j + m] > 0
                yield from counted(names, seq, np.flatnonzero(known[:-1] & known[1:]), k, buckets)

    return coded.where("bucket < 0").select("payload").mapInArrow(run, CODED_SQL)


def merge(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Sums the counts (the last column) of equal phrases."""
    cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
    by = np.lexsort(cols[-2::-1])
    cols = [c[by] for c in cols]
    new = np.ones(len(by), bool)
    if len(by):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:-1]])
    first = np.flatnonzero(new)
    return [c[first] for c in cols[:-1]] + [np.add.reduceat(cols[-1], first) if len(by) else cols[-1]]


def frequent(coded: DataFrame, k: int, least: int) -> DataFrame:
    """w1, ..., wk, a: phrases of ``k`` words that stand ``least`` times in all blocks, each met in one bucket."""
    names = [*[f"w{i}" for i in range(1, k + 1)], "a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for payload in batch.column("payload"):
                first, *rest = unpack_columns(payload.as_py())
                parts.append([np.cumsum(first, dtype=np.uint64), *rest])
                size += len(first)
                if size >= MERGED and len(parts) > 1:
                    parts = [merge(parts)]
                    size = 0 if len(parts[0][0]) * 2 > MERGED else len(parts[0][0])
        cols = merge(parts)
        keep = cols[-1] >= least
        yield pa.RecordBatch.from_arrays([pa.array(c[keep].astype(np.int64)) for c in cols], names=names)

    return coded.where("bucket >= 0").groupBy("bucket").applyInArrow(run, ", ".join(f"{c} long" for c in names))


def bit_table(phrases: DataFrame, k: int, n: int):
    """The phrases' bits, broadcast: at most TABLE_BITS of them, BITS_EACH for a phrase where there is room. Tasks make parts of it, which are joined by buckets."""
    spark = phrases.sparkSession
    size = min(TABLE_BITS, 1 << max(8 * PART, BITS_EACH * n - 1).bit_length())
    top = np.uint64(size - 1)

    def make(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            h = mixed(*[batch.column(j).to_numpy().astype(np.uint64) for j in range(k)]) & top
            part = (h // np.uint64(8 * PART)).astype(np.int64)
            for p in np.unique(part).tolist():
                x = h[part == p] % np.uint64(8 * PART)
                np.bitwise_or.at(held.setdefault(p, np.zeros(PART, np.uint8)), (x >> np.uint64(3)).astype(np.int64), np.uint8(1) << (x & np.uint64(7)).astype(np.uint8))
        for p, bits in held.items():
            yield pa.record_batch([pa.array([p], pa.int64()), pa.array([bits.tobytes()], pa.binary())], names=["part", "bits"])

    def both(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(PART, np.uint8)
        for batch in batches:
            for b in batch.column("bits"):
                bits |= np.frombuffer(b.as_py(), np.uint8)
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int64()), pa.array([bits.tobytes()], pa.binary())], names=["part", "bits"])

    table_ = np.zeros(size // 8, np.uint8)
    words = [f"w{i}" for i in range(1, k + 1)]
    # As many parts as the table has, whatever the number of phrases.
    for r in phrases.select(*words).mapInArrow(make, "part long, bits binary").groupBy("part").applyInArrow(both, "part long, bits binary").toLocalIterator():
        table_[r.part * PART : (r.part + 1) * PART] = np.frombuffer(bytes(r.bits), np.uint8)
    return spark.sparkContext.broadcast(table_)


def level_tables(docs: DataFrame, least: int = LEAST, most: int = WORDS, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, dict[int, DataFrame]]:
    """(text, lang) -> totals (lang, n) and, by k, the frequent phrases of k words: 1: (w1, lang, word, a), k: (w1, ..., wk, a)."""
    d = docs.select(F.col("text").cast("binary").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(min(BUCKETS, max(64, 2 * shuffle_partitions(docs.sparkSession), total // bucket_bytes)))
    raw = materialise(word_blocks(d, buckets, block_bytes), "phrase-words")
    n = materialise(raw.where("bucket < 0").groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    answers = materialise(number_words(raw.where("bucket >= 0"), buckets, least), "phrase-numbers")

    def listed(batches):
        for batch in batches:
            for lang, payload, counts in zip(*(batch.column(c).to_pylist() for c in ("lang", "payload", "counts")), strict=True):
                words, (ids, count) = unpack_words(payload), unpack_columns(counts)
                yield pa.record_batch([pa.array(ids.astype(np.int64)), pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()), pa.array(count.astype(np.int64))], names=["w1", "lang", "word", "a"])

    levels = {1: materialise(answers.where("block is null").mapInArrow(listed, "w1 long, lang string, word binary, a long"), "phrases-1")}
    coded = materialise(code_blocks(raw.where("bucket < 0"), answers.where("block is not null"), buckets), "phrase-blocks")
    discard(raw)
    discard(answers)
    levels[2] = materialise(frequent(coded, 2, least), "phrases-2")
    for k in range(3, most + 1):
        bits = bit_table(levels[k - 1], k - 1, levels[k - 1].count())
        levels[k] = materialise(frequent(longer(coded, k, bits, buckets), k, least), f"phrases-{k}")
        bits.unpersist()
    discard(coded)
    return n, levels


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(2000000 a / (l + r)), exact."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", wide(a) * F.lit(2_000_000).cast("decimal(8,0)"), wide(left) + wide(right))


def best_cut(cuts: list[tuple[Column, Column]]) -> Column:
    """The cut (k, l, r, score) of the lowest score, then the smallest k."""
    return F.array_min(F.array(*[F.struct(score(F.col("a"), x, y).alias("score"), F.lit(k).alias("k"), x.alias("l"), y.alias("r")) for k, (x, y) in enumerate(cuts, 1)]))


def scored(levels: dict[int, DataFrame]) -> dict[int, DataFrame]:
    """Each level's phrases with their text, their lowest-scoring cut, and what the next level takes from them: the counts of their beginnings
    (heads) and ends (tails), by number of words, and their last word."""
    one = levels[1]
    x = one.select("w1", "lang", F.col("word").alias("head"), F.col("a").alias("l"))
    y = one.select(F.col("w1").alias("w2"), F.col("word").alias("last"), F.col("a").alias("r"))
    two = levels[2].join(x, "w1").join(y, "w2")
    two = two.select("w1", "w2", "a", "lang", F.concat("head", F.lit(b" "), "last").alias("phrase"), "last", F.array("l").alias("heads"), F.array("r").alias("tails"), best_cut([(F.col("l"), F.col("r"))]).alias("cut"))
    out = {2: two}
    for k in range(3, max(levels) + 1):
        before, words = materialise(out[k - 1], f"scored-{k - 1}"), [f"w{i}" for i in range(1, k + 1)]
        out[k - 1] = before
        head = before.select(*words[:-1], "lang", F.col("phrase").alias("front"), F.concat("heads", F.array("a")).alias("heads"))
        tail = before.select(*[F.col(w).alias(words[i + 1]) for i, w in enumerate(words[:-1])], "last", F.concat("tails", F.array("a")).alias("tails"))
        both = levels[k].join(head, words[:-1]).join(tail, words[1:])
        # heads[i], tails[i]: the counts of the first and the last i + 1 words.
        cuts = [(F.col("heads")[i], F.col("tails")[k - 2 - i]) for i in range(k - 1)]
        out[k] = both.select(*words, "a", "lang", F.concat("front", F.lit(b" "), "last").alias("phrase"), "last", "heads", "tails", best_cut(cuts).alias("cut"))
    return out


def within_longer(phrases: dict[int, DataFrame], within: int = WITHIN) -> DataFrame:
    """Phrases of all levels but those that a longer one stands for. A phrase that is in one of more words is in one that is a word longer, and as frequent at least."""
    kept = []
    for k, mine in phrases.items():
        words = [f"w{i}" for i in range(1, k + 1)]
        if k + 1 in phrases:
            up = phrases[k + 1]
            over = up.select(*words, "a").union(up.select(*[F.col(f"w{i + 1}").alias(f"w{i}") for i in range(1, k + 1)], "a")).groupBy(*words).agg(F.max("a").alias("longest"))
            mine = mine.join(over, words, "left")
            wide = lambda c, by: F.col(c).cast("decimal(20,0)") * F.lit(by).cast("decimal(4,0)")
            mine = mine.where(F.col("longest").isNull() | (wide("longest", 100) < wide("a", within)))
        kept.append(mine.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score")))
    out = kept[0]
    for more in kept[1:]:
        out = out.union(more)
    return out


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, most: int = WORDS, within: int = WITHIN, **sizes) -> DataFrame:
    """(text, lang) -> lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases."""
    n, levels = level_tables(docs, least, most, **sizes)
    best = within_longer(scored(levels), within)
    w = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language over all documents."""
    return collocations(table(spark, sf_dir, "documents"))


#: Grams of up to five words are made by lists, so the SQL is for small tables.
OP13_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
), lists as (
  select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces
), ns as (
  select lang, sum(len(w))::bigint as n from lists group by lang
), grams as (
  select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) as g from lists, (select unnest([1, 2, 3, 4]) as k) ks where len(w) >= k
), f as (
  select lang, k, g, count(*)::bigint as a from grams group by all having count(*) >= 30
), cuts as (
  select c.lang, c.k, c.g, c.a, x.k as cut, x.a as l, y.a as r, (2000000 * c.a::hugeint // (x.a + y.a))::bigint as score
  from f c join f x on x.lang = c.lang and x.k < c.k and x.g = c.g[1:x.k] join f y on y.lang = c.lang and y.k = c.k - x.k and y.g = c.g[x.k + 1:c.k]
), best as (
  select * from cuts qualify row_number() over (partition by lang, g order by score, cut) = 1
), up as (
  select lang, part, max(a) as longest from (
    select lang, a, unnest([g[1:k - 1], g[2:k]]) as part from f where k > 2) group by all
), kept as (
  select b.* from best b left join up u on u.lang = b.lang and u.part = b.g where u.longest is null or 100 * u.longest < 80 * b.a
)
select lang, rank, phrase, a, l, r, n, score from (
  select k.lang, row_number() over (partition by k.lang order by score desc, a desc, array_to_string(g, ' ')) as rank, array_to_string(g, ' ') as phrase, a, l, r, n, score
  from kept k join ns on ns.lang = k.lang) where rank <= 2000
"""
