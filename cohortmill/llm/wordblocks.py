"""Global distinct-word exchange.

Documents are read in blocks of a bounded number of bytes. Within a block each word is named by its
place in the block's own word list, so that a document is a row of small integers (its positions).
The block's words are dealt over buckets by a hash; in its bucket each distinct word is met once for
the whole corpus, whatever its frequency, and what is worked out for it goes back to the blocks that
hold it. The integer rows travel beside, compressed, and meet the answers in the last exchange.

No key is hot: a word has one entry for each block that holds it, and the number of buckets grows
with the bytes of text.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, Numbering, pack_places, pack_words, shuffle_partitions, slices, unpack_places, unpack_words

#: Bytes of text in a block, and of text for one bucket.
BLOCK_BYTES = 32 << 20
BUCKET_BYTES = 4 << 20
#: Bytes of text whose words are numbered at a time.
NUMBER_BYTES = 4 << 20

#: bucket < 0: a block's documents; otherwise some of its words.
SCHEMA = "key long, block long, bucket int, places binary, payload binary, doc_ids array<long>, sizes array<int>, extra array<long>"
ARROW = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("bucket", pa.int32()), ("places", pa.binary()), ("payload", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("extra", pa.list_(pa.int64()))])


def bucket_count(docs: DataFrame, most: int = 65536) -> int:
    """Buckets for a table of (doc_id, text): one for so many bytes of text, bounded on both sides."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(min(most, max(64, 2 * shuffle_partitions(docs.sparkSession), total // BUCKET_BYTES)))


def _emit(block: int, words: Numbering, ids: list, seqs: list, extra: list, buckets: int, weights: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    sizes = [len(s) for s in seqs]
    seq = np.concatenate(seqs) if seqs else np.zeros(0, np.uint32)
    seqs.clear()
    chunks = [slice(i, i + CHUNK) for i in range(0, len(seq), CHUNK)]
    times = np.zeros(len(words), np.int64)
    for c in chunks:
        times += np.bincount(seq[c], minlength=len(words))
    # Frequent words get the small numbers.
    order = np.argsort(-times, kind="stable")
    names = list(words)
    keys = [names[i] for i in order.tolist()]
    number = np.empty(len(keys), np.uint32)
    number[order] = np.arange(len(keys), dtype=np.uint32)
    for c in chunks:
        seq[c] = number[seq[c]]
    weights = None if weights is None else weights[order]
    where = np.fromiter((zlib.crc32(k) % buckets for k in keys), np.int32, len(keys))
    order = np.argsort(where, kind="stable")
    cuts = np.searchsorted(where[order], np.arange(buckets + 1))
    rows: dict[str, list] = {f.name: [] for f in ARROW}

    def add(**row):
        for k, v in rows.items():
            v.append(row.get(k))

    add(key=-1 - block, block=block, bucket=-1, payload=pack_places(seq), doc_ids=ids, sizes=sizes, extra=extra)
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        at = order[cuts[b] : cuts[b + 1]]
        add(key=b, block=block, bucket=b, places=pack_places(np.diff(at, prepend=0)), payload=pack_words([keys[i] for i in at.tolist()]), extra=None if weights is None else weights[at].tolist())
    yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in ARROW], schema=ARROW)


def blocks(docs: DataFrame, split: Callable[[str], list[bytes]], buckets: int, counted: str | None = None, tag: str | None = None, block_bytes: int = BLOCK_BYTES, number: Callable[[list[str], Numbering], list[np.ndarray]] | None = None) -> DataFrame:
    """docs: (doc_id, text[, counted]); null text is empty. With ``counted`` a word's row carries how often the
    documents where that column is true hold it, and the documents' row carries, for each, twice its bytes, and one more if it is true. With
    ``tag`` it carries that long column of each document instead. ``number`` numbers the words of some texts at once, as
    they would be after ``split``."""

    def run(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        words, ids, seqs, flags, lengths, tags, size = Numbering(), [], [], [], [], [], 0
        waiting, since = [], 0

        def flush():
            nonlocal since
            if waiting:
                seqs.extend(number(waiting, words))
            waiting.clear()
            since = 0

        def close():
            flush()
            weights = None
            if counted:
                weights = np.zeros(len(words), np.int64)
                for s, f in zip(seqs, flags, strict=True):
                    if f:
                        weights += np.bincount(s, minlength=len(words)) if 4 * len(s) > len(words) else 0
                        if 4 * len(s) <= len(words):
                            np.add.at(weights, s, 1)
            return _emit((part << 32) + made, words, ids, seqs, tags if tag else [int(f) + 2 * n for f, n in zip(flags, lengths, strict=True)], buckets, weights)

        for cols in (b.to_pydict() for b in slices(batches)):
            for i, (d, text) in enumerate(zip(cols["doc_id"], cols["text"], strict=True)):
                if number:
                    waiting.append(text or "")
                    since += len(text or "")
                    if since >= NUMBER_BYTES:
                        flush()
                else:
                    pieces = split(text or "")
                    seqs.append(np.fromiter(map(words.__getitem__, pieces), np.uint32, len(pieces)))
                ids.append(d)
                flags.append(bool(cols[counted][i]) if counted else False)
                if tag:
                    tags.append(cols[tag][i])
                size += len(text or "")
                lengths.append(0 if not text else len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass")))
                if size >= block_bytes:
                    yield from close()
                    made += 1
                    words, ids, seqs, flags, lengths, tags, size = Numbering(), [], [], [], [], [], 0
        if ids:
            yield from close()

    return docs.select("doc_id", "text", *[c for c in (counted, tag) if c]).mapInArrow(run, SCHEMA)


def each_word(blocks_: DataFrame, answer: Callable, summary: Callable[[], bytes] | None = None) -> DataFrame:
    """In each bucket ``answer(distinct words, ...)`` is called once. It gets the distinct words and, for each row of the
    bucket, (places of the row's words among them, the row's counts); it returns for each row (payload, extra). After it,
    ``summary()`` gives the payload of one more row of the bucket, of no block."""

    def run(t: pa.Table) -> pa.Table:
        if t.column("bucket")[0].as_py() < 0:
            return t.cast(ARROW)
        seen = Numbering()
        at = []
        for p in t.column("payload").to_pylist():
            w = unpack_words(p)
            at.append(np.fromiter(map(seen.__getitem__, w), np.int64, len(w)))
        counts = [None if x is None else np.array(x, np.int64) for x in t.column("extra").to_pylist()]
        made = answer(list(seen), at, counts)
        if callable(summary):
            extra_row = summary()
            t = pa.concat_tables([t, pa.table([pa.array([v], f.type) for v, f in zip((t.column("key")[0].as_py(), None, t.column("bucket")[0].as_py(), None, None, None, None, None), ARROW, strict=True)], schema=ARROW)])
            made = [*made, (extra_row, None)]
        return pa.table([t.column("key"), t.column("block"), t.column("bucket"), t.column("places"), pa.array([m[0] for m in made], pa.binary()), t.column("doc_ids"), t.column("sizes"), pa.array([m[1] for m in made], pa.list_(pa.int64()))], schema=ARROW)

    return blocks_.groupBy("key").applyInArrow(run, SCHEMA)


def places_of(data: bytes) -> np.ndarray:
    """Where in its block's word list the words of a row stand."""
    return np.cumsum(unpack_places(data), dtype=np.int64)


def each_block(answered: DataFrame, finish: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """All rows of a block meet again: one with its documents, the others with the answers for its words. ``finish`` makes
    the block's result in batches, so that it is never whole in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from finish(pa.Table.from_batches(batches))

    return answered.drop("key").groupBy("block").applyInArrow(run, schema)
