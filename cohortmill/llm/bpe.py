"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

A text is cut into words: pieces that begin with a space and end before the next space that has a
visible character behind it. The pre-token pattern always breaks there, so a word holds whole
pre-tokens and its encoding does not depend on its neighbours. Words go through the exchange of
``wordblocks`` with their positions; each distinct word is encoded once in its bucket, the ids come
back to the blocks, and each document is put together again by position. Decoding looks ids up in
the token-byte table, whose size is the vocabulary's, and joins the bytes.

Null or empty text: no tokens, the digests of empty input. Null doc_id: kept as null. Repeated rows
are encoded row by row. Further columns are not read. Any text is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pack_ints, table, unpack_ints, unpack_places
from .wordblocks import blocks, bucket_count, each_block, each_word, places_of

#: Ids of a batch of results.
BATCH_IDS = 500_000
_BREAK = re.compile(r" (?=[^\s\x1c-\x1f\x85])")


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes and its id on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def split_words(text: str) -> list[bytes]:
    """The words of a text, in order; joined they are the text."""
    if "  " in text or "\n" in text or "\t" in text or not text.isascii() or not text.isprintable():
        first, *rest = _BREAK.split(text)
    else:
        first, *rest = text.split(" ")
        if rest and not rest[-1]:
            first, *rest = _BREAK.split(text)
    out = [first.encode("utf-8", "surrogatepass")] if first else []
    out += [b" " + w.encode("utf-8", "surrogatepass") for w in rest]
    return out


def encoder(ranks: dict[bytes, int], pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(doc_id, text) -> doc_id, token_ids array<int>, decoded binary: the ids of the whole text, and its bytes made again from them."""
    return _encode(docs, ranks, pattern, lambda found, decode: [_lists(found), pa.array([decode(f) for f in found], pa.binary())], "token_ids array<int>, decoded binary")


def encode_digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, ids: bool = False, tag: str | None = None) -> DataFrame:
    """(doc_id, text[, tag]) -> doc_id[, tag], n_tokens, ids_sha256, decoded_sha256[, token_ids]: the same with digests. ``tag`` is a long column that goes along."""

    def make(found, decode):
        made = [pa.array([len(f) for f in found], pa.int64()), pa.array([hashlib.sha256(",".join(map(str, f.tolist())).encode()).hexdigest() for f in found]), pa.array([hashlib.sha256(decode(f)).hexdigest() for f in found])]
        return [*made, _lists(found)] if ids else made

    return _encode(docs, ranks, pattern, make, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * ids, tag)


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(f) for f in found])])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *[f.astype(np.int32) for f in found]])))


def _encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, make, made: str, tag: str | None = None) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    docs = docs.select("doc_id", "text", *[tag] * bool(tag))
    schema = "doc_id long, " + f"{tag} long, " * bool(tag) + made
    # The vocabulary's size is fixed by the rank file, so the broadcast does not grow with the corpus.
    shared = spark.sparkContext.broadcast((ranks, pattern))
    held: dict = {}

    def answer(words, at, counts):
        if "enc" not in held:
            held["enc"] = encoder(*shared.value)
        ids = held["enc"].encode_ordinary_batch([w.decode("utf-8", "surrogatepass") for w in words], num_threads=1)
        out = []
        for a in at:
            rows = [ids[i] for i in a.tolist()]
            flat = np.fromiter((x for r in rows for x in r), np.uint32)
            out.append((pack_ints(np.concatenate([np.array([len(rows), *map(len, rows)], np.uint32), flat])), None))
        return out

    def finish(t: pa.Table):
        if "bytes" not in held:
            by_id = [b""] * (1 + max(shared.value[0].values()))
            for k, v in shared.value[0].items():
                by_id[v] = k
            held["bytes"] = by_id
        by_id = held["bytes"]
        is_docs = [b < 0 for b in t.column("bucket").to_pylist()]
        row = is_docs.index(True)
        payloads, places = t.column("payload"), t.column("places")
        parts = [(places_of(places[i].as_py()), unpack_ints(payloads[i].as_py())) for i, d in enumerate(is_docs) if not d]
        n_words = sum(len(p) for p, _ in parts)
        length, start = np.zeros(n_words, np.int64), np.zeros(n_words, np.int64)
        pools, base = [], 0
        for p, v in parts:
            n = int(v[0])
            lens = v[1 : 1 + n].astype(np.int64)
            length[p] = lens
            start[p] = base + np.cumsum(lens) - lens
            pools.append(v[1 + n :])
            base += len(v) - 1 - n
        pool = np.concatenate(pools) if pools else np.zeros(0, np.uint32)
        seq = unpack_places(payloads[row].as_py())
        doc_ids, sizes, tags = (t.column(c)[row].as_py() for c in ("doc_ids", "sizes", "extra"))
        del parts, pools, payloads, places, t
        found: list[np.ndarray] = []
        at = held_ids = first = 0
        for k, n in enumerate(sizes):
            w = seq[at : at + n]
            at += n
            lens = length[w]
            ends = np.cumsum(lens)
            total = int(ends[-1]) if n else 0
            found.append(pool[np.repeat(start[w] - (ends - lens), lens) + np.arange(total)])
            held_ids += total
            if held_ids >= BATCH_IDS or k + 1 == len(sizes):
                carried = [pa.array(v[first : k + 1], pa.int64()) for v in ((doc_ids, tags) if tag else (doc_ids,))]
                yield pa.RecordBatch.from_arrays([*carried, *make(found, lambda ids: b"".join(map(by_id.__getitem__, ids.tolist())))], names=names)
                found, held_ids, first = [], 0, k + 1

    names = [c.split()[0] for c in schema.split(", ")]
    n = bucket_count(docs)
    return each_block(each_word(blocks(docs, split_words, n, tag=tag), answer), finish, schema)


def op9_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents in the many-language byte-level vocabulary, and back."""
    import public_tokenizers as P

    return encode_digests(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"), load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
