"""Scoring texts by online logistic context mixing.

A text is a row of tokens: lower-case words, then an end. Counts of all training tokens come from the
exchange of ``wordblocks``, where each distinct word is met once. A token is coded in binary decisions: seven bits
lead to one of 128 leaves - a frequent word, the end, words of one kind of ending, or
unknown words. Each bit is predicted from hashed contexts: none, the leaf before, the two leaves before, and the
document so far. The predictions are mixed in the logistic domain with weights gated by the bit's
place and by how much of the document has been seen there, and an adaptive table refines the mixture.
Weights and table are learned from additive sums over all training texts, in one pass: a Newton step for each gate from the weights NEAR, which fits of such texts have, and the table's hits there. Within a kind of ending, a word has its share of the training count; an
unknown word is spelled in bits, predicted from the bytes before it and mixed likewise.

One more decision comes before these: whether the context of the two whole words before shows the word. What these contexts have shown is counted
exactly over all training texts, in tables dealt over buckets by a hash of the context, which grow with the corpus; a token gets back how often its
context stands there and how often with its word. The chance of the decision starts from the context's confidence and is refined online along the document, in the
logistic domain, by what the contexts before were worth. A training text is not evidence for itself: its own counts are left out.

The leaves' tables and weights are bounded, additive over blocks and buckets; so are the weights of the spelling, learned by one such step from sums over all distinct training words.
The probabilities of all texts of tokens add up to one at most.

Null text is empty: an end alone. Null doc_id: kept, held out or not by the text ''. Equal texts that are both held out or both learned from have equal
scores; rows that repeat count as often as they stand. Without training tokens all words are unknown. Very long texts are scored whole, and ties do not arise. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import copy
import hashlib
import pickle
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Numbering, discard, fold, materialise, pack_columns, pack_words, table, unpack_columns, unpack_places, unpack_words
from .shingles import mix
from .wordblocks import blocks, bucket_count, each_block, each_word, places_of

END = b"\n"
#: Leaves; frequent words; contexts of two leaves; longest context of bytes, and contexts of two bytes and of each further length; tokens of a step of the document's history.
LEAVES, TOP, PAIRS, ORDERS, SPELL, STEP = 128, 63, 4096, 4, 1 << 14, 32
LEVELS = 7
UNKNOWN = LEAVES - 1
KINDS = LEAVES - TOP - 2
#: Tokens and words to spell at a time; distinct bytes in their contexts that a task holds.
STEP_TOKENS, STEP_WORDS, SPELL_GRAMS = 50_000, 20_000, 1 << 20
#: The mixing weights that learning starts from: of the predictions without context, after one and after two leaves, of the document, and the constant.
NEAR = (-0.4, 0.2, 0.6, 0.5, -0.1)
#: Bits of a hashed context of two words; tokens whose keys are sorted at a time; tokens of a document that refine the trust in its contexts, and at what rate.
CONTEXT, SLICE_TOKENS, HISTORY, RATE = 34, 500_000, 24, 0.25
#: Bytes of text in a block.
LM_BLOCK = 16 << 20
_CHUNK = 1 << 15
#: Gates by how many earlier tokens of the document came by a node, 255 for more; steps of a context's count, 127 for more.
GATES = np.minimum(np.log2(np.arange(256, dtype=np.float32) + 1) / 1.5, 5).astype(np.int64)
#: The least number of tokens for each gate but the first.
MORE = np.searchsorted(GATES, np.arange(1, 6)).tolist()
#: -0.5 where a leaf's turn at a level is right, else 0.5.
HALF = (0.5 - (np.arange(LEAVES) >> np.arange(LEVELS)[::-1, None] & 1)).astype(np.float32)
CONFIDENCE = np.minimum(np.ceil(np.log2(np.arange(128) + 1)), LEVELS).astype(np.int64)


def split_tokens(text: str) -> list[bytes]:
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


#: What a byte is: white space (0) or of a word (1).
_KIND = bytes(0 if i in b" \t\n\v\f\r" else 1 for i in range(256))


def number_tokens(texts: list[str], words: Numbering) -> list[np.ndarray]:
    """For each text the numbers of its tokens, those of ``split_tokens``. A word is looked up once, however often the texts have it."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    joined = (END.join(raw) + END).lower()
    data, kind = np.frombuffer(joined, np.uint8), np.frombuffer(joined.translate(_KIND), np.uint8).copy()
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1) - 1
    word = kind == 1
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    first[ends], last[ends], kind[ends] = True, True, 1
    first = np.flatnonzero(first)
    places = np.append(0, np.cumsum(np.flatnonzero(last) + 1 - first))
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(places), pa.py_buffer(data[kind > 0])]).dictionary_encode()
    names = coded.dictionary
    at, held = np.frombuffer(names.buffers()[1], np.int64)[: len(names) + 1].tolist(), names.buffers()[2].to_pybytes()
    distinct = [held[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    new = [w for w in distinct if w not in words]
    words.update(zip(new, range(len(words), len(words) + len(new)), strict=True))
    number = np.fromiter(map(words.__getitem__, distinct), np.uint32, len(distinct))
    return np.split(number[coded.indices.to_numpy()], np.searchsorted(first, ends[:-1], side="right"))


def kind_of(word: bytes) -> int:
    """Words are grouped by their last two bytes."""
    return zlib.crc32(word[-2:]) % KINDS


def _pack(x) -> bytes:
    return zstandard.ZstdCompressor(3).compress(pickle.dumps(x, protocol=5))


def _unpack(b: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(b))


def stretch(p):
    return np.log(p / (1 - p))


def squash(x):
    return 1 / (1 + np.exp(-x))


class Tree:
    """Chances of a right turn at each node of each context, from counts of leaves; stretched, with the counts of the nodes."""

    def __init__(self, counts: np.ndarray, levels: int, prior: Tree | None = None):
        """counts: [contexts, 2**levels]."""
        self.levels, self.turn, self.seen = levels, [], []
        for j in range(levels):
            halves = counts.reshape(len(counts), 1 << (j + 1), -1).sum(2, dtype=np.float64)
            right, total = halves[:, 1::2], halves[:, ::2] + halves[:, 1::2]
            back = 0.5 if prior is None else squash(prior.turn[j].reshape(1, -1).astype(np.float64))
            self.turn.append(stretch(np.clip((right + 0.5 * back) / (total + 0.5), 1e-6, 1 - 1e-6)).astype(np.float32).ravel())
            self.seen.append(total.astype(np.float32).ravel())

    def small(self) -> Tree:
        """The same in half the bytes."""
        out = copy.copy(self)
        out.turn, out.seen = ([np.minimum(x, 60_000).astype(np.float16) for x in v] for v in (self.turn, self.seen))
        return out


def spell_keys(words: list[bytes]) -> np.ndarray:
    """For each byte of all words, each ended by a zero byte: the byte, and above it the ORDERS bytes before it in the word, the nearest lowest."""
    data = np.frombuffer(b"\0".join(words) + b"\0", np.uint8).astype(np.int64)
    place = np.arange(len(data)) - np.maximum.accumulate(np.where(np.concatenate([[True], data[:-1] == 0]), np.arange(len(data)), 0))
    out = data.copy()
    for k in range(1, ORDERS + 1):
        out[k:] |= np.where(place[k:] >= k, data[:-k], 0) << 8 * k
    return out


def spell_contexts(keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """(byte, contexts of one to ORDERS bytes) of each key."""
    out, h = [keys & 255], np.zeros(len(keys), np.int64)
    for k in range(1, ORDERS + 1):
        before = keys >> 8 * k & 255
        h = (h * 0x2545F491 + before + 1) & 0xFFFFFFFF if k > 1 else before
        out.append(h if k == 1 else (h * 0x9E3779B1 & 0xFFFFFFFF) >> 18)
    return tuple(out)


def spell_grams(lists: Iterable[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct keys of all words and how often each stands, some at a time: few, for most words are made of the same pieces."""
    held, n = [], 0

    def merged():
        keys, times = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        order = np.argsort(keys)
        k = keys[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        return k[first], np.add.reduceat(times[order], first)

    for words in lists:
        for i in range(0, len(words), STEP_WORDS):
            keys = spell_keys(words[i : i + STEP_WORDS])
            held.append((keys, np.ones(len(keys), np.int64)))
            n += len(keys)
            if n > SPELL_GRAMS:
                held = [merged()]
                n = len(held[0][0])
                if n > SPELL_GRAMS // 2:
                    yield held.pop()
                    n = 0
    if held:
        yield merged()


SPELL_SIZES = ((0, 256), *((256 + i * SPELL, 256 + (i + 1) * SPELL) for i in range(ORDERS - 1)))


def spell_counts(words: list[bytes]) -> np.ndarray:
    return gram_table(spell_grams([words]))


def gram_table(grams: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """How often each byte stands in each context, from distinct keys and their times."""
    out = np.zeros(SPELL_SIZES[-1][1] * 256, np.uint32)
    for keys, times in grams:
        data, *ctx = spell_contexts(keys)
        for c, (a, b) in zip(ctx, SPELL_SIZES, strict=True):
            out[a * 256 : b * 256] += np.bincount(c * 256 + data, weights=times, minlength=(b - a) * 256).astype(np.uint32)
    return out


class Mixer:
    """Gated logistic mixing of predictions with an adaptive refinement."""

    def __init__(self, gates: int, inputs: int):
        self.w = np.full((gates, inputs), 1.0 / inputs, np.float32)
        self.bins = np.tile(np.linspace(-8, 8, 33), (gates, 1)).astype(np.float32)
        self.hits = np.zeros((gates, 33, 2), np.float64)

    def mixed(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        z = np.zeros(len(gate), np.float32)
        for v, w in zip(x, np.ascontiguousarray(self.w.T), strict=True):
            z += v * w.take(gate)
        return np.clip(z, -12, 12, out=z)

    def refine(self) -> None:
        """The adaptive table from its hits."""
        centre = squash(np.linspace(-8, 8, 33))[None, :]
        n = self.hits.sum(2)
        self.bins = stretch(np.clip((self.hits[:, :, 1] + 20 * centre) / (n + 20), 1e-6, 1 - 1e-6)).astype(np.float32)

    def inverse(self, x: list[np.ndarray], gate: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """One over the probability of each bit."""
        return self.inverse_of(self.mixed(x, gate), gate, np.where(bit > 0, -0.5, 0.5).astype(np.float32))

    def inverse_of(self, z: np.ndarray, gate: np.ndarray, half: np.ndarray) -> np.ndarray:
        """The same from the mixed predictions, which are overwritten; ``half``: -0.5 for a right turn, else 0.5."""
        at = place_of(z)
        at += gate * 33
        z += self.bins.ravel().take(at)
        z *= half
        np.exp(z, out=z)
        z += 1
        return z


def place_of(z: np.ndarray) -> np.ndarray:
    """The row of the adaptive table for each mixed prediction."""
    at = np.clip(z, -8, 8)
    at += 8
    at *= 2
    return np.rint(at, out=at).astype(np.int64)


class Sums:
    """Additive sums over bits for each gate: slopes and curvatures of a mixer's weights, and hits of its adaptive table."""

    def __init__(self, gates: int, inputs: int):
        self.slope, self.curve, self.hits = np.zeros((gates, inputs)), np.zeros((gates, inputs, inputs)), np.zeros((gates, 33, 2))

    def gather(self, mixer: Mixer, x: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, times: np.ndarray | None = None) -> None:
        """``times``: how often each bit stands; once without it."""
        key = (gate * 2 + bit).astype(np.uint8)
        order = np.argsort(key, kind="stable")
        cuts = np.searchsorted(key.take(order), np.arange(2 * len(self.slope) + 1)).tolist()
        spans = [(g, slice(cuts[2 * g], cuts[2 * g + 2])) for g in range(len(self.slope)) if cuts[2 * g] < cuts[2 * g + 2]]
        every, z, right = np.empty((len(x), len(order)), np.float32), np.empty(len(order), np.float32), np.zeros(len(order), np.float32)
        for row, v in zip(every, x, strict=True):
            v.take(order, out=row, mode="clip")
        for g, of in spans:
            np.matmul(mixer.w[g], every[:, of], out=z[of])
        np.clip(z, -12, 12, out=z)
        at = place_of(z)
        at *= 2
        for g, of in spans:
            at[of] += g * 66
            at[cuts[2 * g + 1] : of.stop] += 1
            right[cuts[2 * g + 1] : of.stop] = 1
        times = None if times is None else times.take(order)
        self.hits += np.bincount(at, weights=times, minlength=self.hits.size).reshape(self.hits.shape)
        p = squash(z)
        err, spread = right - p, p * (1 - p)
        if times is not None:
            err, spread = err * times.astype(np.float32), spread * times.astype(np.float32)
        # Products of a few rows with one are faster than those of a few with a few.
        for g, of in spans:
            self.slope[g] += every[:, of] @ err[of]
        for i, v in enumerate(every):
            v = v * spread
            for g, of in spans:
                column = every[: i + 1, of] @ v[of]
                self.curve[g, : i + 1, i] += column
                self.curve[g, i, :i] += column[:i]

    def add(self, other: Sums) -> None:
        self.slope += other.slope
        self.curve += other.curve
        self.hits += other.hits


def newton(mixer: Mixer, sums: Sums) -> None:
    """One step of Newton's method for each gate, from sums over all bits under the mixer's weights, and their hits."""
    step = np.stack([np.linalg.solve(c + 4 * np.eye(len(c)), s) for c, s in zip(sums.curve, sums.slope, strict=True)])
    mixer.w = (mixer.w + step).astype(np.float32)
    mixer.hits = sums.hits
    mixer.refine()


def settle(mixer: Mixer, sums: Sums) -> None:
    """The leaves' mixer from the sums over all training texts."""
    newton(mixer, sums)


def _spell_inputs(trees: list[Tree], contexts, level: int, data, drop: bool):
    node = data >> (8 - level)
    bit = data >> (7 - level) & 1
    x, seen = [], None
    for t, c in zip(trees, contexts, strict=True):
        at = c * (1 << level) + node
        v, n = t.turn[level][at], t.seen[level][at]
        if drop:  # the word's own count, once, is not evidence
            p = np.clip((squash(v.astype(np.float64)) * (n + 0.5) - bit * 1.0), 0, None)
            v = stretch(np.clip(np.where(n > 1.5, p / np.maximum(n - 0.5, 0.5), 0.5), 1e-4, 1 - 1e-4)).astype(np.float32)
            n = n - 1
        x.append(v)
        seen = n
    gate = level * 4 + np.minimum(np.log2(np.maximum(seen, 0) + 1) / 3, 3).astype(np.int64)
    return x, gate, bit


class Model:
    def __init__(self, n: int, v: int, top: list[bytes], kinds: np.ndarray):
        """n: training tokens; v: distinct ones; kinds: training counts of the words of each kind but the top ones."""
        self.n, self.v, self.top, self.kinds = n, v, {w: i for i, w in enumerate(top)}, kinds
        self.trees: list[Tree] = []
        self.mixer = Mixer(LEVELS * 6, len(NEAR))
        self.mixer.w[:] = NEAR
        self.spell: list[Tree] = []
        self.spell_mixer = Mixer(8 * 4, ORDERS)

    def set_spelling(self, counts: np.ndarray, words: list[bytes] = ()) -> None:
        """counts: of all training words; words: those that the mixing weights are learned from here (``spelling_sums`` has the sums over tables of them)."""
        c = counts.reshape(-1, 256)
        base = Tree(c[:256].sum(0, keepdims=True), 8)
        self.spell = [Tree(c[a:b], 8, base) for a, b in SPELL_SIZES]
        if words:
            newton(self.spell_mixer, self.spell_gathered(spell_grams([words])))

    def spell_gathered(self, grams: Iterable[tuple[np.ndarray, np.ndarray]]) -> Sums:
        """What words add to the sums that the spelling's mixer is learned from, from their distinct keys and times; each word's own count is left out."""
        out = Sums(*self.spell_mixer.w.shape)
        for keys, times in grams:
            for i in range(0, len(keys), STEP_TOKENS):
                data, *ctx = spell_contexts(keys[i : i + STEP_TOKENS])
                for level in range(8):
                    out.gather(self.spell_mixer, *_spell_inputs(self.spell, ctx, level, data, True), times[i : i + STEP_TOKENS])
        return out

    def spelled(self, words: list[bytes]) -> np.ndarray:
        """Log2 of the probability of each word's spelling."""
        if len(words) > STEP_WORDS:
            return np.concatenate([self.spelled(words[i : i + STEP_WORDS]) for i in range(0, len(words), STEP_WORDS)])
        if not words:
            return np.zeros(0)
        keys = spell_keys(words)
        distinct, back = np.unique(keys, return_inverse=True)
        data, *ctx = spell_contexts(distinct)
        total = np.ones(len(data))
        for level in range(8):
            total *= self.spell_mixer.inverse(*_spell_inputs(self.spell, ctx, level, data, False))
        ends = np.flatnonzero(keys & 255 == 0)
        return np.diff(np.concatenate([[0.0], np.cumsum(-np.log2(total)[back])[ends]]))

    def set_contexts(self, counts: np.ndarray) -> None:
        c = counts.reshape(-1, LEAVES)
        none = Tree(c[:LEAVES].sum(0, keepdims=True), LEVELS)
        self.trees = [none, Tree(c[:LEAVES], LEVELS, none), Tree(c[LEAVES:], LEVELS, none)]

    def histories(self, leaf: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """For each token the row of its document's history, and for each level the document's prediction and the gate by (node, row).

        A row is a step of a document; all first steps, which have no history, share the first row. So there is one row for each
        STEP tokens at most, and what depends on row and node alone is worked out once for all tokens of the step."""
        more = np.maximum(-(-sizes // STEP) - 1, 0)
        first = np.cumsum(more) - more
        step = (np.arange(len(leaf)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // STEP
        row = np.repeat(first + 1, sizes) + step
        kept = np.flatnonzero(step < np.repeat(more, sizes))
        rows = int(more.sum()) + 1
        total = np.bincount(leaf[kept] * rows + row[kept], minlength=LEAVES * rows).astype(np.int32).reshape(LEAVES, rows)
        np.cumsum(total, axis=1, out=total)
        total[:, 1:] -= np.repeat(total[:, first], more, axis=1)  # of the document's earlier steps
        row -= 1
        row[step == 0] = 0
        tables: list[tuple[np.ndarray, np.ndarray]] = []
        for j in reversed(range(LEVELS)):
            left, right = total[::2], total[1::2]
            total = left + right
            p = 2 * squash(self.trees[0].turn[j])[:, None]
            doc = right.astype(np.float32) + p
            doc /= left.astype(np.float32) + (2 - p)
            np.clip(np.log(doc, out=doc), -9.21024, 9.21024, out=doc)
            gate = np.full(total.shape, j * 6, np.uint8)
            for least in MORE:
                gate += total >= least
            tables.append((doc, gate.astype(np.int64)))
        return row, tables[::-1]

    def inputs(self, leaf: np.ndarray, sizes: np.ndarray):
        """For each level: the predictions, gates and bits of all tokens."""
        row, tables = self.histories(leaf, sizes)
        # A context, then the leaf: shifted right, the context and the node.
        one, two = (c * LEAVES + leaf for c in contexts(leaf, sizes))
        constant = np.full(len(leaf), 0.3, np.float32)
        for j, (doc, gates) in enumerate(tables):
            none, *more = (t.turn[j] for t in self.trees)
            node = leaf >> (LEVELS - j)
            at = node * doc.shape[1] + row
            x = [none.take(node), *(t.take(c >> (LEVELS - j)) for t, c in zip(more, (one, two), strict=True)), doc.ravel().take(at), constant]
            yield x, gates.ravel().take(at), leaf >> (LEVELS - 1 - j) & 1

    def gathered(self, leaf: np.ndarray, sizes: np.ndarray) -> Sums:
        """What the documents add to the sums that the mixer is learned from."""
        out = Sums(*self.mixer.w.shape)
        for x, gate, bit in self.inputs(leaf, sizes):
            out.gather(self.mixer, x, gate, bit)
        return out

    def coded(self, leaf: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log2 of the probability of each leaf."""
        row, tables = self.histories(leaf, sizes)
        one, two = (c * LEAVES + leaf for c in contexts(leaf, sizes))
        w_none, w_one, w_two, w_doc, w_constant = np.ascontiguousarray(self.mixer.w.T)
        total = np.ones(len(leaf))
        for j, (doc, gates) in enumerate(tables):
            none, after_one, after_two = (t.turn[j] for t in self.trees)
            # What is the same for all tokens at a node in a step is mixed once.
            doc *= w_doc.take(gates)
            doc += (w_none[:, None] * none + (w_constant * np.float32(0.3))[:, None]).ravel().take(gates * len(none) + np.arange(len(none))[:, None])
            at = (leaf >> (LEVELS - j)) * doc.shape[1] + row
            z, gate = doc.ravel().take(at), gates.ravel().take(at)
            for w, t, c in ((w_one, after_one, one), (w_two, after_two, two)):
                v = t.take(c >> (LEVELS - j))
                v *= w.take(gate)
                z += v
            np.clip(z, -12, 12, out=z)
            total *= self.mixer.inverse_of(z, gate, HALF[j].take(leaf))
        return -np.log2(total)


def contexts(leaf: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leaf before each token, and a hash of the two before; a document begins as after an end."""
    starts = np.cumsum(sizes) - sizes
    one = np.concatenate([[TOP], leaf[:-1]]).astype(np.int64)
    one[starts] = TOP
    two = np.concatenate([[TOP], one[:-1]])
    two[starts] = TOP
    return one, (two * LEAVES + one) * 0x9E3779B1 % (1 << 32) >> 20


def sum_tables(rows: DataFrame, cells: int) -> np.ndarray:
    """Sums additive tables of ``cells`` numbers, given in parts (part, counts). Bounded by the size of one table."""

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(_CHUNK, np.int64)
        for c in t.column("counts"):
            p = _unpack(c.as_py())
            total[: len(p)] += p
        return pa.table([t.column("part").slice(0, 1), t.column("salt").slice(0, 1), pa.array([_pack(total)], pa.binary())], names=["part", "salt", "counts"])

    schema = "part int, salt int, counts binary"
    some = rows.select("part", F.pmod(F.xxhash64("counts"), F.lit(16)).cast("int").alias("salt"), "counts").groupBy("part", "salt").applyInArrow(add, schema)
    out = np.zeros(-(-cells // _CHUNK) * _CHUNK, np.int64)
    for r in some.withColumn("salt", F.lit(0)).groupBy("part", "salt").applyInArrow(add, schema).collect():
        out[r.part * _CHUNK : (r.part + 1) * _CHUNK] = _unpack(bytes(r.counts))
    return out[:cells]


def _parts(counts: np.ndarray) -> list[tuple[int, bytes]]:
    small = np.uint32 if not len(counts) or counts.max() < 2**32 else np.int64
    return [(i // _CHUNK, _pack(p.astype(small))) for i in range(0, len(counts), _CHUNK) if (p := counts[i : i + _CHUNK]).any()]


def count_words(docs: DataFrame):
    """Rows of the exchange with the training count of each word, and of each bucket a summary."""
    n = bucket_count(docs)

    class State:
        summary: dict = {}

    def answer(words, at, counts):
        total = np.zeros(len(words), np.int64)
        for a, c in zip(at, counts, strict=True):
            total[a] += c
        kind = np.fromiter(map(kind_of, words), np.uint8, len(words))
        best = np.argsort(-total, kind="stable")[: TOP + 1]
        named = total == 0
        named[best] = True
        ending = [i for i, w in enumerate(words) if w == END]
        named[ending] = True
        known = [w for w, c in zip(words, total.tolist(), strict=True) if c and w != END]
        State.summary = {
            "n": int(total.sum()), "v": int((total > 0).sum()), "top": [(int(total[i]), words[i]) for i in best.tolist() if total[i] and words[i] != END],
            "kinds": np.bincount(kind, weights=np.where(np.isin(np.arange(len(words)), ending), 0, total), minlength=KINDS), "words": pack_words(known),
        }
        number = np.where(total > 0, np.cumsum(total > 0) - 1, -1)
        mark = np.fromiter((int.from_bytes(hashlib.blake2b(w, digest_size=5).digest(), "little") for w in words), np.uint64, len(words))
        out = []
        for a in at:
            c = total[a]
            where = np.flatnonzero(named[a])
            out.append((_pack((np.minimum(c, 255).astype(np.uint8), c[c >= 255], kind[a], where, [words[a[i]] for i in where.tolist()], number[a], mark[a])), None))
        return out

    return each_word(blocks(docs, split_tokens, n, "train", block_bytes=LM_BLOCK, number=number_tokens), answer, lambda: pickle.dumps(State.summary, protocol=5))


def _summaries(counted: DataFrame) -> DataFrame:
    """n, v, top and kinds (packed) of each bucket, and as part -1 the distinct keys of the spelling of some buckets' training words, and their times."""

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            words: list[bytes] = []
            for bucket, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = pickle.loads(p)
                words.append(s.pop("words"))
                rows.append((None, _pack(s | {"of": {bucket: s["v"]}})))
            rows += [(-1, pack_columns(np.diff(k, prepend=0), n)) for k, n in spell_grams(map(unpack_words, words))]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "counts"])

    return counted.where("block is null").select("bucket", "payload").mapInArrow(run, "part int, counts binary")


def _grams(batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for p in batch.column(0):
            k, n = unpack_columns(p.as_py())
            yield np.cumsum(k).astype(np.int64), n.astype(np.int64)


def spelling_parts(parts: DataFrame) -> DataFrame:
    """The spelling table of all distinct training words, in parts that add up; each task hands on one table at most."""

    def run(batches):
        rows = _parts(gram_table(_grams(batches)))
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "counts"])

    return parts.where("part = -1").select("counts").mapInArrow(run, "part int, counts binary")


def _merged(rows: DataFrame) -> dict:
    """Merges the buckets' summaries in executors, then here: each merged one is as small as one bucket's, but for a number for each bucket."""

    def merge(many: list[dict]) -> dict:
        top = sorted((t for m in many for t in m["top"]), key=lambda t: (-t[0], t[1]))[: TOP + 1]
        return {"of": {b: v for m in many for b, v in m["of"].items()}, "n": sum(m["n"] for m in many), "v": sum(m["v"] for m in many), "top": top, "kinds": sum((m["kinds"] for m in many), np.zeros(KINDS))}

    def run(batches):
        many = [_unpack(c) for b in batches for c in b.column(0).to_pylist()]
        if many:
            yield pa.record_batch([pa.array([_pack(merge(many))], pa.binary())], names=["counts"])

    return merge([_unpack(bytes(r.counts)) for r in rows.where("part is null").select("counts").mapInArrow(run, "counts binary").collect()])


_DONE = "block long, doc_ids array<long>, flags array<long>, sizes array<int>, seq binary, words binary, base array<double>, known array<long>, unknown binary, part int, counts binary"


class Words:
    """What is known of the words of a block, by their numbers in it: training count, leaf, log2 of the share within the leaf, number in the corpus (-1: unknown), hash, place among the unknown ones."""

    def __init__(self, m: int):
        self.count, self.leaf, self.share = np.zeros(m, np.int64), np.zeros(m, np.uint8), np.zeros(m, np.float32)
        self.number, self.mark, self.unknown = np.full(m, -1, np.int64), np.zeros(m, np.uint64), np.zeros(m, np.uint32)


def place_tokens(counted: DataFrame, model: Model, offsets: np.ndarray) -> DataFrame:
    """For each block its documents' tokens, the words' marks and sums, and its parts of the context table. ``offsets``: the number of the first word of each bucket."""
    shared = counted.sparkSession.sparkContext.broadcast((model.n, model.v, model.top, model.kinds, offsets))

    def finish(t: pa.Table):
        n_all, v_all, top, kinds, first = shared.value
        buckets = t.column("bucket").to_pylist()
        is_docs = [b < 0 for b in buckets]
        row = is_docs.index(True)
        payloads, places = t.column("payload"), t.column("places")
        parts = [(buckets[i], places_of(places[i].as_py()), _unpack(payloads[i].as_py())) for i, d in enumerate(is_docs) if not d]
        w = Words(sum(len(p) for _, p, _ in parts))
        unknown: list[bytes] = []
        for b, p, (small, big, kind, where, names, number, mark) in parts:
            c = small.astype(np.int64)
            c[small == 255] = big
            w.count[p], w.leaf[p] = c, TOP + 1 + kind
            w.share[p] = np.log2(np.maximum(c, 1) / np.maximum(kinds[kind], 1))
            w.number[p] = np.where(number < 0, -1, number + first[b])
            w.mark[p] = mark
            for i, name in zip(p[where].tolist(), names, strict=True):
                if name == END:
                    w.leaf[i], w.share[i] = TOP, 0.0
                elif name in top:
                    w.leaf[i], w.share[i] = top[name], 0.0
                elif w.count[i] == 0:
                    w.leaf[i], w.share[i] = UNKNOWN, 0.0
                    w.unknown[i] = len(unknown)
                    unknown.append(name)
        packed_seq = payloads[row].as_py()
        seq = unpack_places(packed_seq)
        sizes = np.array(t.column("sizes")[row].as_py(), np.int64)
        flags = np.array(t.column("extra")[row].as_py(), np.int64)
        ends = np.cumsum(sizes)
        base, known = np.empty(len(sizes)), np.empty(len(sizes), np.int64)
        logs = np.log10((w.count + 0.1) / (n_all + 0.1 * (v_all + 1)))
        table = np.zeros((LEAVES + PAIRS) * LEAVES, np.int64)
        del parts, payloads, places
        for at, to, begin, end in slices(sizes, SLICE_TOKENS):
            per = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)[ends[at:to] - begin - 1]]))  # noqa: B023, E731
            c, leaves, size = w.count[seq[begin:end]], w.leaf[seq[begin:end]], sizes[at:to]
            base[at:to], known[at:to] = per(logs[seq[begin:end]]), per(c > 0)
            # A word that was seen once stands for those never seen.
            taught = np.where((c == 1) & (leaves > TOP), UNKNOWN, leaves).astype(np.int64)
            one, two = contexts(taught, size)
            train = np.repeat(flags[at:to] & 1 > 0, size)
            table += np.bincount(one[train] * LEAVES + taught[train], minlength=len(table))
            table += np.bincount((two[train] + LEAVES) * LEAVES + taught[train], minlength=len(table))
        out = {"block": [t.column("block")[row].as_py()], "doc_ids": [t.column("doc_ids")[row].as_py()], "flags": [flags.tolist()], "sizes": [sizes.tolist()], "seq": [packed_seq], "words": [_pack(w)], "base": [base.tolist()], "known": [known.tolist()], "unknown": [pack_words(unknown)], "part": [None], "counts": [None]}
        for part, data in _parts(table):
            for k in out:
                out[k].append({"part": part, "counts": data}.get(k))
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(v, ty) for v, ty in zip(out.values(), types, strict=True)], names=list(out))

    return each_block(counted.where("block is not null"), finish, _DONE)


# Contexts of two words -----------------------------------------------------------------------------


def gram_keys(w: Words, seq: np.ndarray, sizes: np.ndarray, id_bits: int) -> np.ndarray:
    """For each token: a hash of the two words before it in CONTEXT bits, then the number of its word (all ones: unknown)."""
    mark = w.mark[seq]
    starts = np.cumsum(sizes) - sizes
    one = np.concatenate([[np.uint64(0)], mark[:-1]])
    one[starts] = 0
    two = np.concatenate([[np.uint64(0)], one[:-1]])
    two[starts] = 0
    context = mix(mix(two + np.uint64(1)) + one) >> np.uint64(64 - CONTEXT)
    number = w.number[seq]
    return context << np.uint64(id_bits) | np.where(number < 0, (1 << id_bits) - 1, number).astype(np.uint64)


def grams(placed: DataFrame, id_bits: int, buckets: int) -> DataFrame:
    """bucket, block, nth, payload: of each slice of a block the distinct keys in order and how many training tokens have each, by ranges of the context."""
    bounds = np.array([-(-(b << CONTEXT) // buckets) << id_bits for b in range(buckets)], np.uint64)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                seq, w = unpack_places(r["seq"]), _unpack(r["words"])
                sizes, train = np.array(r["sizes"], np.int64), np.array(r["flags"], np.int64) & 1 > 0
                for nth, (at, to, begin, end) in enumerate(slices(sizes, SLICE_TOKENS)):
                    keys = gram_keys(w, seq[begin:end], sizes[at:to], id_bits)
                    v, weight = np.unique(keys, return_counts=True)
                    held, times = np.unique(keys[~np.repeat(train[at:to], sizes[at:to])], return_counts=True)
                    weight[np.searchsorted(v, held)] -= times
                    cuts = np.append(np.searchsorted(v, bounds), len(v))
                    rows = [(b, r["block"], nth, pack_columns(np.diff(v[cuts[b] : cuts[b + 1]], prepend=np.uint64(0)), weight[cuts[b] : cuts[b + 1]])) for b in np.flatnonzero(np.diff(cuts)).tolist()]
                    yield pa.record_batch([pa.array([x[i] for x in rows], ty) for i, ty in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names=["bucket", "block", "nth", "payload"])

    return placed.where("part is null").select("block", "flags", "sizes", "seq", "words").mapInArrow(run, "bucket int, block long, nth int, payload binary")


def gram_counts(sent: DataFrame, id_bits: int) -> DataFrame:
    """block, nth, bucket, payload: for each row the training counts of its keys and of their contexts; and, without a block, what the bucket has of hits."""

    def run(t: pa.Table) -> pa.Table:
        parts = [unpack_columns(p) for p in t.column("payload").to_pylist()]
        keys = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        order = np.argsort(keys)
        v = keys[order]
        weight = np.concatenate([p[1] for p in parts]).astype(np.int64)[order]
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        n = np.add.reduceat(weight, first)
        context = v[first] >> np.uint64(id_bits)
        begin = np.concatenate([[True], context[1:] != context[:-1]])
        d = np.add.reduceat(n, np.flatnonzero(begin))[np.cumsum(begin) - 1]
        # Of training tokens whose context has others: how many of those others show the same word.
        confidence = confident(np.maximum(d - 1, 0))
        again = np.bincount(confidence, weights=np.where(n > 1, n, 0), minlength=LEVELS + 1)
        often = np.bincount(confidence, weights=np.where(d > 1, n, 0), minlength=LEVELS + 1)
        back = np.empty((2, len(v)), np.int64)
        back[:, order] = np.repeat(np.stack([n, d]), np.diff(np.append(first, len(v))), axis=1)
        ends = np.cumsum([len(p[0]) for p in parts])
        payloads = [pack_columns(back[0, e - len(p[0]) : e], back[1, e - len(p[0]) : e]) for e, p in zip(ends.tolist(), parts, strict=True)]
        return pa.table([pa.array([*t.column("block").to_pylist(), None], pa.int64()), pa.array([*t.column("nth").to_pylist(), None], pa.int32()), pa.array([*t.column("bucket").to_pylist(), None], pa.int32()), pa.array([*payloads, pickle.dumps((again, often))], pa.binary())], names=["block", "nth", "bucket", "payload"])

    return sent.groupBy("bucket").applyInArrow(run, "block long, nth int, bucket int, payload binary")


def confident(d: np.ndarray) -> np.ndarray:
    """Steps of a context's count: 0 for none, to LEVELS."""
    return CONFIDENCE.take(np.minimum(d, 127))


def hit_odds(counts: DataFrame) -> np.ndarray:
    """Log-odds, by steps of a context's count, that a context that has shown words shows the next one again. A bounded row for each task."""

    def run(batches):
        total = np.zeros((2, LEVELS + 1))
        for batch in batches:
            for p in batch.column(0).to_pylist():
                total += np.stack(pickle.loads(p))
        yield pa.record_batch([pa.array([pickle.dumps(total)], pa.binary())], names=["sums"])

    total = np.zeros((2, LEVELS + 1))
    for r in counts.where("block is null").select("payload").mapInArrow(run, "sums binary").collect():
        total += pickle.loads(bytes(r.sums))
    return stretch(np.clip((total[0] + 0.2) / (total[1] + 1), 1e-6, 1 - 1e-6))


def own_counts(index: np.ndarray, context: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token how many of its document have its number ``index``, and how many its ``context``, which grows with the index."""
    both = doc * (int(index.max()) + 1 if len(index) else 1) + index
    order = np.argsort(both)
    k, doc, context = both[order], doc[order], context[order]

    def runs(change):
        times = np.diff(np.append(np.flatnonzero(np.concatenate([[True], change])), len(k)))
        out = np.empty(len(k), np.int64)
        out[order] = np.repeat(times, times)
        return out

    return runs(k[1:] != k[:-1]), runs((context[1:] != context[:-1]) | (doc[1:] != doc[:-1]))


def refined(low: np.ndarray, n: np.ndarray, d: np.ndarray, sizes: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Log2 of each token's probability. ``low``: the same from the bits alone; ``n`` of the ``d`` tokens that other texts show in its context are its word.

    The chance that the context is right starts from its confidence and is refined online, by how much better than the bits the contexts of the HISTORY tokens before it
    in its document were."""
    seen = np.flatnonzero(d > 0)
    old, n, d = low[seen], n[seen], d[seen]
    right = n > 0
    high = np.where(right, n, 1) / d
    gain = np.zeros(len(low))
    gain[seen] = np.where(right, np.clip(np.log2(high) - old, -8, 8), np.clip(-40.0 - old, -8, 8))
    sums = np.concatenate([[0.0], np.cumsum(gain)])
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)[seen]
    history = sums[seen] - sums[np.maximum(start, seen - HISTORY)]
    off = np.exp(-np.clip(odds[confident(d)] + RATE * history, -14, 14))  # odds against the context
    out = low.copy()
    out[seen] = np.log2(np.where(right, high + off * np.exp2(old), off) / (1 + off)) + np.where(right, 0.0, old)
    return out


def slices(sizes: np.ndarray, step: int | None = None):
    """Some documents at a time: (first, behind the last, first token, behind the last)."""
    step = step or STEP_TOKENS
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        begin = int(ends[at] - sizes[at])
        to = max(at + 1, int(np.searchsorted(ends, begin + step)))
        yield at, to, begin, int(ends[to - 1])
        at = to


def gather(placed: DataFrame, model: Model) -> Sums:
    """The sums over the training documents of all blocks; each task hands on one row of bounded size."""
    slim = copy.copy(model)
    slim.spell = []
    shared = placed.sparkSession.sparkContext.broadcast(_pack(slim))

    def run(batches):
        m = _unpack(shared.value)
        total = Sums(*m.mixer.w.shape)
        for batch in batches:
            for r in batch.to_pylist():
                sizes = np.array(r["sizes"], np.int64)
                train = np.array(r["flags"], np.int64) & 1 > 0
                if not train.any():
                    continue
                leaf = _unpack(r["words"]).leaf[unpack_places(r["seq"])][np.repeat(train, sizes)]
                sizes = sizes[train]
                for at, to, begin, end in slices(sizes):
                    total.add(m.gathered(leaf[begin:end].astype(np.int64), sizes[at:to]))
        yield pa.record_batch([pa.array([_pack(total)], pa.binary())], names=["sums"])

    total = Sums(*model.mixer.w.shape)
    for r in placed.where("part is null").select("flags", "sizes", "seq", "words").mapInArrow(run, "sums binary").collect():
        total.add(_unpack(bytes(r.sums)))
    shared.destroy()
    return total


def spelling_sums(parts: DataFrame, model: Model) -> Sums:
    """The sums over all distinct training words; each task hands on one row of bounded size."""
    slim = Model(0, 0, [], np.zeros(KINDS))
    slim.spell, slim.spell_mixer = [t.small() for t in model.spell], model.spell_mixer
    shared = parts.sparkSession.sparkContext.broadcast(_pack(slim))

    def run(batches):
        m = _unpack(shared.value)
        yield pa.record_batch([pa.array([_pack(m.spell_gathered(_grams(batches)))], pa.binary())], names=["sums"])

    total = Sums(*model.spell_mixer.w.shape)
    for r in parts.where("part = -1").select("counts").mapInArrow(run, "sums binary").collect():
        total.add(_unpack(bytes(r.sums)))
    shared.destroy()
    return total


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def score_blocks(placed: DataFrame, counts: DataFrame, model: Model, odds: np.ndarray, id_bits: int) -> DataFrame:
    """The scores of each block's documents, from its tokens and what its keys were counted."""
    slim = copy.copy(model)
    slim.spell = [t.small() for t in model.spell]
    shared = placed.sparkSession.sparkContext.broadcast(_pack((slim, odds)))
    names = [c.split()[0] for c in _SCORED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, odds = _unpack(shared.value)
        t = pa.Table.from_batches(batches)
        row = [s is not None for s in t.column("seq").to_pylist()].index(True)
        r = t.slice(row, 1).to_pylist()[0]
        found: dict[int, list] = {}
        for nth, bucket, p in zip(*(t.column(c).to_pylist() for c in ("nth", "bucket", "payload")), strict=True):
            if nth is not None:
                found.setdefault(nth, []).append((bucket, p))
        del t
        seq, w = unpack_places(r["seq"]), _unpack(r["words"])
        sizes, flags = np.array(r["sizes"], np.int64), np.array(r["flags"], np.int64)
        spelled = m.spelled(unpack_words(r["unknown"]))
        for nth, (at, to, begin, end) in enumerate(slices(sizes, SLICE_TOKENS)):
            part, size = seq[begin:end], sizes[at:to]
            low = w.share[part].astype(np.float64)
            leaf = w.leaf[part]
            oov = np.flatnonzero(leaf == UNKNOWN)
            low[oov] = spelled[w.unknown[part[oov]]]
            unique, back = np.unique(gram_keys(w, part, size, id_bits), return_inverse=True)
            columns = [unpack_columns(p) for _, p in sorted(found[nth])]
            n, d = (np.concatenate([c[i] for c in columns]).astype(np.int64)[back] for i in (0, 1))
            context = unique >> np.uint64(id_bits)
            context = np.cumsum(np.concatenate([[False], context[1:] != context[:-1]]))
            bits, train = np.empty(to - at), flags[at:to] & 1
            for a, b, x, y in slices(size):
                low[x:y] += m.coded(leaf[x:y].astype(np.int64), size[a:b])
                doc = np.repeat(np.arange(b - a), size[a:b])
                # What a training text has added is no evidence for itself.
                own = [o * train[a:b].take(doc) for o in own_counts(back[x:y], context[back[x:y]], doc)]
                bits[a:b] = np.bincount(doc, weights=refined(low[x:y], n[x:y] - own[0], d[x:y] - own[1], size[a:b], odds), minlength=b - a)
            yield pa.RecordBatch.from_arrays(
                [pa.array(r["doc_ids"][at:to], pa.int64()), pa.array(flags[at:to] & 1 == 0), pa.array(size), pa.array(r["known"][at:to], pa.int64()), pa.array([m.n] * (to - at), pa.int64()), pa.array(r["base"][at:to], pa.float64()), pa.array(bits * np.log10(2)), pa.array(-bits / np.maximum(flags[at:to] >> 1, 1))],
                names=names,
            )

    docs = placed.where("part is null").select("block", "doc_ids", "flags", "sizes", "seq", "words", "base", "known", "unknown")
    return docs.unionByName(counts.where("block is not null"), allowMissingColumns=True).groupBy("block").applyInArrow(run, _SCORED)


def score(docs: DataFrame, train) -> DataFrame:
    """(doc_id, text) -> the scores of every text; learns from those where the Column ``train`` holds."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", train.alias("train"))
    counted = materialise(count_words(d), "counted")
    parts = materialise(_summaries(counted), "summaries")
    s = _merged(parts)
    top = [w for _, w in s["top"][:TOP]]
    kinds = s["kinds"].copy()
    for c, w in s["top"][:TOP]:
        kinds[kind_of(w)] -= c
    model = Model(s["n"], s["v"], top, kinds)
    model.set_spelling(sum_tables(spelling_parts(parts), SPELL_SIZES[-1][1] * 256))
    if model.v:
        newton(model.spell_mixer, spelling_sums(parts, model))
    known = s["of"]
    ends = np.zeros(max(known, default=-1) + 2, np.int64)
    ends[[b + 1 for b in known]] = list(known.values())
    id_bits = (model.v + 1).bit_length()
    placed = materialise(place_tokens(counted, model, np.cumsum(ends)), "placed")
    discard(counted)
    model.set_contexts(sum_tables(placed.where("part is not null").select("part", "counts"), (LEAVES + PAIRS) * LEAVES))
    if model.n:
        settle(model.mixer, gather(placed, model))
    counts = materialise(gram_counts(grams(placed, id_bits, bucket_count(d, 1 << 19)), id_bits), "gram-counts")
    return score_blocks(placed, counts, model, hit_odds(counts), id_bits)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log10 probability of every document; one in ten is held out from learning."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fold(F.col("doc_id"), 10) != 0)
