"""The text operators against brute force, on fixtures with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import html as html_lib
import math
import random
import struct
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from cohortmill.llm import ann, bpe, components, html, licenses, lm_score, mixing, ngram_join, spotsigs, toxicity, warc
from cohortmill.llm.common import CHUNK, TAKE_DOCS, fresh_path, pack_places, pack_words, slices, unpack_places, unpack_words
from cohortmill.llm.shingles import shingle_set

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(3)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(120)]


def text(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(t, k, seed):
    w, r = t.split(), random.Random(seed)
    for _ in range(k):
        w[r.randrange(len(w))] = "new" + str(r.randrange(99))
    return " ".join(w)


def corpus():
    r = random.Random(6)
    rows = [(i, text(r.randint(1, 60), i), "en", f"s{i % 3}", 1) for i in range(40)]
    base = text(80, 777)
    rows += [(100 + i, edited(base, i % 4, i), "en", "hot", 1) for i in range(25)]
    rows += [(200, None, "en", "hot", 1), (201, "", None, None, 1), (202, "   \n\t ", "en", "hot", 1), (203, base, "en", "hot", 1), (203, base, "en", "hot", 1), (204, text(4000, 5), "de", "hot", 1), (205, "Ünï çödé 漢字  x\x00y 😀", "fr", "hot", 1), (206, "a b c", "en", "hot", 1), (207, "A  B\nC", "en", "hot", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(4)


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def words(t):
    return (t or "").encode("utf-8", "surrogatepass").lower().split()


# 9: byte-level BPE -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers as P

    return bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN


def test_bpe_matches_library(spark, docs, vocabulary):
    enc = bpe.encoder(*vocabulary)
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(docs, *vocabulary).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = collections.Counter((d, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) for d, t, *_ in corpus() for ids in [enc.encode_ordinary(t or "")])
    assert got == want
    full = {r.doc_id: r for r in bpe.encode(docs, *vocabulary).collect()}
    assert bytes(full[205].decoded).decode() == corpus()[-3][1] and full[200].token_ids == []
    assert bpe.encode(empty(spark), *vocabulary).count() == 0


def test_bpe_words_do_not_depend_on_neighbours(vocabulary):
    enc, r = bpe.encoder(*vocabulary), random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "b'", "'s", "é", "漢", "1", "　", "\x1c", "\x85", "\xa0", "!", " x", "\r", "😀"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert b"".join(bpe.split_words(t)) == t.encode()
        assert [i for w in bpe.split_words(t) for i in enc.encode_ordinary(w.decode())] == enc.encode_ordinary(t)


def test_packing():
    for v in ([], [0], [191, 192, 70000, 4194303], [1 << 31]):
        assert unpack_places(pack_places(np.array(v, np.uint32))).tolist() == v
    for w in ([], [b""], [b"a", b"\0", b""], [b"x" * 1000, b"y"]):
        assert unpack_words(pack_words(w)) == w


# 4: n-gram Jaccard join ----------------------------------------------------------------------------


def brute_components(rows, num=3, den=4):
    sets = []
    for _, t, *_ in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = {d: d for d, *_ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if k and den * k >= num * len(a | sets[j]):
                x, y = root(rows[i][0]), root(rows[j][0])
                parent[max(x, y)] = min(x, y)
    return collections.Counter((r[0], len(s), root(r[0])) for r, s in zip(rows, sets, strict=True))


def test_ngram_join_is_exact(spark, docs):
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_components(docs).collect())
    assert got == brute_components(corpus())


def test_ngram_join_edges(spark):
    rows = [(None, "a b c d e f", "", "", 0), (1, "a b c d e f", "", "", 0), (2, "A B c d e f", "", "", 0)]
    got = {r.doc_id: r.component_id for r in ngram_join.near_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {None: None, 1: 1, 2: 1}
    assert ngram_join.near_components(empty(spark)).count() == 0


def test_large_group_needs_few_pairs(spark, monkeypatch):
    """A group of near copies is verified by pairs in proportion to its size."""
    base, seen = text(120, 9), []
    plain = ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *a: (seen.append(pairs.count()), plain(pairs, *a))[1])
    for n in (300, 600, 1200):
        rows = [(i, edited(base, 1 + i % 3, i), "", "", 0) for i in range(n)]
        seen.clear()
        got = {r.component_id for r in ngram_join.near_components(spark.createDataFrame(rows, DOCS)).collect()}
        assert sum(seen) < 12 * n
        if n == 300:
            assert got == {c for _, _, c in brute_components(rows)}


def test_repeated_ids_long_texts_and_clashing_columns(spark):
    long = text(6000, 77)
    rows = [(1, long, "x", 1), (2, edited(long, 20, 3), "x", 1), (3, text(50, 1), "x", 1), (3, long, "x", 1), (4, text(50, 1), "x", 1), (5, "a b", "x", 1), (6, "A  b", "x", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, cls string, shingle long")
    got = {(r.doc_id, r.component_id) for r in ngram_join.near_components(d).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5)}


def test_components_by_stars(spark, monkeypatch):
    monkeypatch.setattr(components, "PART_LINKS", 10)
    links = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(1, 30)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 30)}


def test_shingles_follow_words():
    for t in ("", " ", "a", "a b c d e", "x " * 9, "The the THE the the the", "é\x0bB\x0cc d\te f"):
        w = words(t)
        assert len(shingle_set(t)) == len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())


# 1: toxicity ------------------------------------------------------------------------------------------


def test_toxicity_generalises(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        w = text(40, 5000 + i).split()
        toxic = i % 6 == 0
        if toxic:
            w.insert(r.randrange(40), r.choice(["scumbagzz", "vileness"]) if i % 12 else "frobn" + r.choice("abcdefghijklmnop") + r.choice("abc"))
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None, "", "", 0), (901, "", "", "", 0), (902, "frobnzq here", "", "", 0)]
    d, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {x.doc_id: x.toxicity for x in toxicity.scored(d, toxicity.fit(d, lab, toxicity.learnable)).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((out[i] >= 0.5) == (i % 6 == 0) for i in held)
    assert right / len(held) > 0.95 and out[902] >= 0.5 and out[900] < 0.5 and out[901] < 0.5
    assert {0.0} == {x.toxicity for x in toxicity.scored(d, toxicity.fit(d, lab.where("toxic = 0"))).collect()}
    assert toxicity.scored(empty(spark), None).columns[-1] == "toxicity"


def test_toxicity_patterns_and_edges(spark):
    fired = lambda t: {toxicity.PATTERNS[i - toxicity.LEXICON][0] for i in toxicity.observed(t, {}) if i >= toxicity.LEXICON}
    assert fired("plain words, 3 of them! AB") == set() and fired("") == set()
    assert fired("STOP THAT what!! sh1t noooooo i d i o t") == {p[0] for p in toxicity.PATTERNS}
    rows = [(1, "same text", "a"), (1, "same text", "b"), (2, "same text", "c"), (None, None, "d"), (3, "word " * 50_000, "e")]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxicity string")
    lab = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.scored(d, toxicity.fit(d, lab)).collect()
    assert len(out) == 5 and {x.toxicity for x in out if x.text == "same text"} == {out[0].toxicity} and all(0 <= x.toxicity <= 1 for x in out)


def test_label_model_is_expectation_maximisation():
    """Two voters without correlation to discount: against the plain update by loops."""
    votes, truth = np.array([[1, 1], [1, 0], [0, 1], [0, 0], [0, 0], [1, 1]], float), np.array([1, 1, 0, 0, 0, 1.0])
    post, rate, _ = toxicity.label_model(votes, truth, rounds=1)
    t = np.clip(truth, 0.02, 0.98)
    for c, side in enumerate((1 - t, t)):
        for j in range(2):
            assert abs(rate[c, j] - (sum(s * v[j] for s, v in zip(side, votes, strict=True)) + 0.5) / (side.sum() + 1)) < 1e-9
    rest = votes - np.stack([1 - t, t]).T @ rate
    weight = [max(1, sum(abs((rest[:, j] * rest[:, k]).sum()) / math.sqrt((rest[:, j] ** 2).sum() * (rest[:, k] ** 2).sum()) for k in range(2))) ** -toxicity.SHARED for j in range(2)]
    for v, p in zip(votes, post, strict=True):
        odds = t.mean() / (1 - t.mean())
        for j in range(2):
            a, b = (rate[1, j], rate[0, j]) if v[j] else (1 - rate[1, j], 1 - rate[0, j])
            odds *= (a / b) ** weight[j]
        assert abs(p - odds / (1 + odds)) < 1e-6


def test_label_model_discounts_copies():
    r = np.random.default_rng(0)
    truth = (r.random(2000) < 0.3).astype(float)
    good = (r.random(2000) < np.where(truth > 0, 0.9, 0.05)).astype(float)
    other = (r.random(2000) < np.where(truth > 0, 0.8, 0.1)).astype(float)
    votes = np.stack([good, good, good, other], axis=1)
    post, rate, discount = toxicity.label_model(votes, np.clip(votes.mean(1), 0, 1))
    assert discount[0] < 0.6 and discount[3] > discount[0] and ((post > 0.5) == (truth > 0)).mean() > 0.9 and rate[1, 0] > rate[0, 0]


# 3: LM scoring ----------------------------------------------------------------------------------------


def test_lm_counts_and_base(spark, docs):
    train = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 10 != 0
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm_score.score(docs, train).collect()))
    toks = [(d, [*words(t), b"\n"]) for d, t, *_ in corpus()]
    c = collections.Counter(w for d, ws in toks if zlib.crc32(str(d).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((d, zlib.crc32(str(d).encode()) % 10 == 0, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for d, ws in toks)
    assert got == want


def test_lm_spelling_learns_from_every_word(spark):
    words = [f"w{i:05d}".encode() for i in range(7000)]
    rows = [(i, " ".join(f"w{k:05d}" for k in range(i * 700, i * 700 + 700))) for i in range(10)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("train", F.lit(True))
    parts = lm_score._summaries(lm_score.count_words(d))
    model = lm_score.Model(1, 1, [], np.ones(lm_score.KINDS))
    model.set_spelling(lm_score.spell_counts(words))
    assert lm_score.spelling_sums(parts, model).hits.sum() == 8 * sum(len(w) + 1 for w in words)


def test_lm_spelling_meets_each_context_once(monkeypatch):
    """Sums over the distinct bytes in their contexts are those over all bytes, also if few fit at a time."""
    words = [f"w{i % 5000:05d}".encode() for i in range(7000)] + [b"a\0b", b"\xc3\xa9"]
    keys = lm_score.spell_keys(words)
    model = lm_score.Model(1, 1, [], np.ones(lm_score.KINDS))
    model.set_spelling(lm_score.spell_counts(words))
    want = model.spell_gathered([(keys, np.ones(len(keys), np.int64))])
    met, gather = [], lm_score.Sums.gather
    monkeypatch.setattr(lm_score.Sums, "gather", lambda self, mixer, x, gate, bit, times=None: (met.append(len(bit)), gather(self, mixer, x, gate, bit, times)))
    for most in (1 << 20, 50):
        monkeypatch.setattr(lm_score, "SPELL_GRAMS", most)
        met.clear()
        got = model.spell_gathered(lm_score.spell_grams([words[:3000], [], words[3000:]]))
        assert (got.hits == want.hits).all() and np.allclose(got.slope, want.slope, rtol=1e-3, atol=1e-2) and np.allclose(got.curve, want.curve, rtol=1e-3, atol=1e-2)
        assert sum(met) < 8 * len(keys) / 2
        assert (lm_score.spell_counts(words) == lm_score.gram_table([(keys, np.ones(len(keys), np.int64))])).all()
    assert lm_score.spell_counts(words).sum() == lm_score.ORDERS * len(keys)


def test_lm_number_tokens():
    r = random.Random(3)
    signs = [*" \t\n\v\f\r", "a", "B", "é", "É", "\u3000", "\0", "\x1c", "\x85", "\xa0", "\ud800", "😀"]
    texts = [[""], ["", ""], *([["".join(r.choice(signs) for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 6))] for _ in range(500)])]
    for some in texts:
        words, want = lm_score.Numbering(), lm_score.Numbering()
        got = lm_score.number_tokens(some, words)
        assert [x.tolist() for x in got] == [[want[w] for w in lm_score.split_tokens(t)] for t in some] and list(words) == list(want)


def test_lm_scores_are_probabilities(spark):
    """Over all texts of at most two tokens from a small vocabulary the probabilities add up to one at most."""
    r = random.Random(8)
    vocab = ["aa", "bb", "cc", "dd"]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(0, 3))), "", "", 0) for i in range(300)]
    probe = [""] + vocab + [f"{a} {b}" for a in vocab for b in vocab]
    rows += [(1000 + i, t, "", "", 0) for i, t in enumerate(probe)]
    got = {x.doc_id: x.score for x in lm_score.score(spark.createDataFrame(rows, DOCS), F.col("doc_id") < 1000).collect()}
    total = sum(10 ** got[1000 + i] for i in range(len(probe)))
    assert 0.3 < total <= 1.0
    assert lm_score.score(empty(spark), F.lit(True)).count() == 0


def test_lm_contexts_are_counted_exactly(spark, docs, monkeypatch):
    """Counts of contexts and of their words, as the scorer sees them, against counters over all training texts without the text itself."""
    toks = {d: [*words(t), b"\n"] for d, t, *_ in corpus()}
    rows = sorted({r[0]: r for r in corpus()}.values(), key=lambda r: r[0])
    d = spark.createDataFrame(rows, DOCS).repartition(3)
    monkeypatch.setattr(lm_score, "refined", lambda low, n, d, sizes, odds: n + d * 1e-3)  # same tasks' closure: sums of n and d stand for the score
    train = {i for i in toks if zlib.crc32(str(i).encode()) % 10}
    grams = {i: collections.Counter((([b"", b"", *t][k]), ([b"", b"", *t][k + 1]), w) for k, w in enumerate(t)) for i, t in toks.items()}
    whole = collections.Counter()
    for i in train:
        whole.update(grams[i])
    heads = collections.Counter()
    for (a, b, _), c in whole.items():
        heads[a, b] += c
    got = {r.doc_id: r.score / math.log10(2) for r in lm_score.score(d, F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 10 != 0).collect()}
    for i, t in toks.items():
        own = grams[i] if i in train else collections.Counter()
        mine = collections.Counter()
        for (a, b, _), c in own.items():
            mine[a, b] += c
        padded = [b"", b"", *t]
        want = sum(whole[padded[k], padded[k + 1], w] - own[padded[k], padded[k + 1], w] + 1e-3 * (heads[padded[k], padded[k + 1]] - mine[padded[k], padded[k + 1]]) for k, w in enumerate(t))
        assert abs(got[i] - want) < 1e-6, i


def test_lm_spelling_adds_up():
    m = lm_score.Model(1, 1, [], np.ones(lm_score.KINDS))
    m.set_spelling(lm_score.spell_counts([b"abba", b"ab", b"ba"] * 50), [b"abba", b"ab"])
    one = [bytes([i]) for i in range(1, 256)]
    assert sum(2.0 ** m.spelled(one)) < 1.0 and m.spelled([b"ab"])[0] > m.spelled([b"zq"])[0]


def test_lm_history_is_worked_out_once_a_step(monkeypatch):
    """Coded and gathered bits are those of the definition, token by token; logarithms are taken once a step and node, not once a token and level."""
    rng, c = np.random.default_rng(7), lm_score
    sizes = np.array([1, 32, 33, 200, 5, 64, 65, 1, 700])
    leaf = np.minimum(rng.geometric(0.05, sizes.sum()) - 1, c.LEAVES - 1)
    m = c.Model(1, 1, [], np.ones(c.KINDS))
    m.set_contexts(rng.integers(0, 5, (c.LEAVES + c.PAIRS) * c.LEAVES))
    m.mixer.w += rng.normal(0, 0.1, m.mixer.w.shape).astype(np.float32)
    m.mixer.bins += rng.normal(0, 0.1, m.mixer.bins.shape).astype(np.float32)
    one, two = c.contexts(leaf, sizes)
    starts, want, sums = np.repeat(np.cumsum(sizes) - sizes, sizes), np.zeros(len(leaf)), c.Sums(*m.mixer.w.shape)
    for i, x in enumerate(leaf.tolist()):
        before = leaf[starts[i] : i - (i - starts[i]) % c.STEP]
        for j in range(c.LEVELS):
            node, bit = x >> (c.LEVELS - j), x >> (c.LEVELS - 1 - j) & 1
            here = before[before >> (c.LEVELS - j) == node] >> (c.LEVELS - 1 - j) & 1
            none, after_one, after_two = (t.turn[j][a] for t, a in zip(m.trees, (node, (one[i] << j) + node, (two[i] << j) + node), strict=True))
            p = 2 * c.squash(float(none))
            v = np.array([none, after_one, after_two, np.clip(np.log((here.sum() + p) / (len(here) - here.sum() + 2 - p)), -9.21024, 9.21024), 0.3])
            g = j * 6 + int(c.GATES[min(len(here), 255)])
            z = float(np.clip(m.mixer.w[g] @ v, -12, 12))
            place = int(c.place_of(np.array([z]))[0])
            want[i] += np.log2(c.squash((z + float(m.mixer.bins[g, place])) / 2 * (1 if bit else -1)))
            sums.slope[g] += v * (bit - c.squash(z))
            sums.curve[g] += np.outer(v, v) * c.squash(z) * (1 - c.squash(z))
            sums.hits[g, place, bit] += 1
    met, log = [], np.log
    monkeypatch.setattr(np, "log", lambda x, **k: (met.append(np.size(x)), log(x, **k))[1])
    got, gathered = m.coded(leaf, sizes), m.gathered(leaf, sizes)
    assert sum(met) <= 2 * (c.LEAVES - 1) * (1 + len(leaf) // c.STEP) < 2 * c.LEVELS * len(leaf)
    assert np.abs(got - want).max() < 1e-3
    assert np.allclose(gathered.slope, sums.slope, atol=1e-2) and np.allclose(gathered.curve, sums.curve, rtol=1e-3, atol=1e-2) and (gathered.hits == sums.hits).all()


def test_lm_contexts_are_refined_online():
    rng, sizes = np.random.default_rng(3), np.array([1, 40, 7, 90])
    low = np.append(-rng.exponential(9, sizes.sum() - 1), -5000.0)  # the last: a long word, spelled
    d = rng.integers(0, 9, len(low))
    n = np.minimum(rng.integers(0, 9, len(low)), d)
    n[-1] = d[-1] = 2
    odds, starts = rng.normal(0, 2, lm_score.LEVELS + 1), np.repeat(np.cumsum(sizes) - sizes, sizes)
    high = [np.log2(a / b) if a else -40.0 for a, b in zip(n, np.maximum(d, 1), strict=True)]
    gain = [float(np.clip(h - x, -8, 8)) if b else 0.0 for h, x, b in zip(high, low, d, strict=True)]
    want = low.copy()
    for i in np.flatnonzero(d):
        z = np.clip(odds[lm_score.confident(d[i])] + lm_score.RATE * sum(gain[max(starts[i], i - lm_score.HISTORY) : i]), -14, 14)
        on, off = -np.logaddexp(0, -z) / np.log(2), -np.logaddexp(0, z) / np.log(2)
        want[i] = np.logaddexp2(on + high[i], off + low[i]) if n[i] else off + low[i]
    assert np.allclose(lm_score.refined(low, n, d, sizes, odds), want)


def test_lm_own_counts():
    doc, index = np.repeat([0, 1], [5, 4]), np.array([3, 1, 3, 2, 0, 3, 3, 1, 0])
    own, of_context = lm_score.own_counts(index, index // 2, doc)
    assert own.tolist() == [2, 1, 2, 1, 1, 2, 2, 1, 1] and of_context.tolist() == [3, 2, 3, 3, 2, 2, 2, 2, 2]


def test_lm_mixer_learns_from_all_blocks(spark, monkeypatch):
    """Weights do not depend on how documents lie in blocks, and neither a long nor a held-out start leaves them untrained."""
    monkeypatch.setattr(lm_score, "STEP_TOKENS", 1000)
    seen = []
    settle, near = lm_score.settle, np.array(lm_score.NEAR)
    monkeypatch.setattr(lm_score, "settle", lambda m, s: (settle(m, s), seen.append((m.w.copy(), m.hits.copy()))))
    rows = [(0, " ".join(["x y"] * 160_000), "", "", 0)] + [(i, text(60, i), "", "", 0) for i in range(1, 200)]
    tokens = 320_001 + 199 * 61
    for r in (rows, rows[::-1]):
        lm_score.score(spark.createDataFrame(r, DOCS).repartitionByRange(3, "doc_id"), F.lit(True)).count()
    lm_score.score(spark.createDataFrame(rows, DOCS).coalesce(1), F.col("doc_id") > 50).count()
    (w, hits), (other, _), (late, late_hits) = seen
    assert hits.sum() == lm_score.LEVELS * tokens and late_hits.sum() == lm_score.LEVELS * 149 * 61
    assert np.abs(w - other).max() < 1e-2 and np.abs(w - near).max() > 0.05 and np.abs(late - near).max() > 0.05


# 5: mixing ----------------------------------------------------------------------------------------------


def test_periods_are_earliest_deadline_first():
    """Against an interleaving by brute force: at each slot the released half block that is due first."""
    for shares in ([5, 3, 2], [1, 1, 1, 4], [7], [40, 1, 1, 1, 9], [1] * 50):
        total, at = sum(shares), mixing.slots_of(shares, shares)
        given = {int(t): (i, j) for i, v in enumerate(at) for j, t in enumerate(v, 1)}
        todo = {(i, j) for i, q in enumerate(shares) for j in range(1, q + 1)}
        assert sorted(given) == list(range(total))
        for t in range(total):
            free = [(-(-j * total // shares[i]), -((j - 1) * total // shares[i]), i, j) for i, j in todo if (j - 1) * total // shares[i] <= t]
            assert given[t] == min(free)[2:]
            todo.remove(given[t])


def test_pfair_keeps_given_weights_for_ever(spark):
    """Less than one block, two slots, from the weights as given, over many periods: skewed, tiny, irrational and very many ones."""
    hot = {f"s{i}": math.sqrt(n) for i, n in enumerate([33_000] + [3_500] * 19)}
    for w, n in ((hot, 40_000), ({"a": 1, "b": 1e-3, None: 0.3}, 60_000), ({f"t{i}": 1 + i % 7 for i in range(5000)}, 80_000), ({"one": 2}, 9000), ({"big": 1000} | {f"u{i}": 1 for i in range(4096)}, 20_000)):
        exact, total = mixing.parts(w), sum(w.values())
        names = list(w)
        weights = [exact[s] for s in names]
        slots = collections.defaultdict(list)
        for r in mixing.schedule(spark, weights, [math.ceil(n * w[s] / total) for s in names]).orderBy("slot").collect():
            slots[names[r["of"]]].append((r.slot, r.half))
        assert len({t for v in slots.values() for t, _ in v}) == sum(map(len, slots.values()))
        for s in names:
            at = np.array([t for t, _ in slots[s]])
            assert [h for _, h in slots[s]] == list(range(1, len(at) + 1))
            j = np.arange(1, len(at) + 1)
            assert (np.abs(j - (at + 1) * w[s] / total) < 2).all() and (np.abs(j - 1 - at * w[s] / total) < 2).all()


def test_positions_hold_every_document(spark, docs):
    p = mixing.positions(docs, block_docs=3).collect()
    assert collections.Counter(x.doc_id for x in p) == collections.Counter(r[0] for r in corpus())
    assert max(collections.Counter((x.slot, x.place) for x in p).values()) == 1
    by_slot = collections.defaultdict(set)
    for x in p:
        by_slot[x.slot].add(x.source)
    assert all(len(s) == 1 for s in by_slot.values()) and None in {x.source for x in p}
    assert mixing.mix(docs).count() == len(corpus()) and mixing.mix(docs).columns == docs.columns
    assert mixing.positions(empty(spark)).count() == 0


def test_pfair_with_weights_too_small_for_a_period(spark, monkeypatch):
    """Where a period is bounded, a source of a tiny weight has no slot in most periods, and still keeps within less than a block of its share."""
    monkeypatch.setattr(mixing, "PERIOD", 16)
    monkeypatch.setattr(mixing, "LONGEST", 64)
    weights, halves = [1000, 300, 1], [5000, 1500, 5]
    assert mixing.period(weights) == 64
    rows = mixing.schedule(spark, weights, halves).collect()
    assert sorted((r.of, r.half) for r in rows) == [(i, j) for i, n in enumerate(halves) for j in range(1, n + 1)]
    at = {r.slot: r.of for r in rows}
    assert len(at) == len(rows)
    done, total = [0, 0, 0], sum(weights)
    for t in range(6000):
        done[at[t]] += 1
        assert all(abs(d - (t + 1) * w / total) < 2 for d, w in zip(done, weights, strict=True))
    assert mixing.period([10**9, 1]) == 64


def test_mixing_with_clashing_columns_and_repeats(spark):
    rows = [(i % 70, f"t{i}", f"s{i % 3}", "x", i, i) for i in range(100)] + [(None, None, None, "y", 1, 2)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, slot string, place long, nr int")
    out = mixing.mix(d, block_docs=4)
    assert out.columns == d.columns and sorted(map(tuple, out.collect()), key=str) == sorted(rows, key=str)
    assert mixing.positions(d).count() == 101


# 6: spot signatures ---------------------------------------------------------------------------------


def test_edited_texts_and_likeness(spark, docs):
    rows = sorted({r[0]: r for r in corpus()}.values(), key=lambda r: r[0], reverse=True)
    d = spark.createDataFrame(rows, DOCS).repartition(3)
    got = {x.doc_id: x for x in spotsigs.edited_fingerprints(d).collect()}
    for i, (doc_id, t, *_) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        h = len(t) // 2
        assert got[doc_id].n_chars == len(t)
        assert got[doc_id].edited_sha256 == hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()
        of = lambda f: set(f.split(",")) - {""}
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        mine = of(got[doc_id].fingerprint)
        assert abs(got[doc_id].near_edited - like(mine, of(got[doc_id].edited_fingerprint))) < 1e-12
        assert abs(got[doc_id].near_next - like(mine, of(got[rows[(i + 1) % len(rows)][0]].fingerprint))) < 1e-12
    assert got[206].fingerprint == got[207].fingerprint  # case and white space are not content
    assert got[200].fingerprint == "" and got[200].near_edited == 1.0
    single = spotsigs.edited_fingerprints(spark.createDataFrame([(5, "the cat sat on the mat with a hat", "", "", 0)], DOCS)).first()
    assert single.near_next == 1.0
    assert spotsigs.edited_fingerprints(empty(spark)).count() == 0
    assert spotsigs.edited_fingerprints(docs).count() == len(corpus())
    null_ids = spark.createDataFrame([(None, "the a b", "", "", 0), (None, "the c d", "", "", 0), (1, "x", "", "", 0)], DOCS)
    assert spotsigs.edited_fingerprints(null_ids).count() == 3


def test_signatures(spark):
    got = spark.createDataFrame([("The quick, brown fox is very lazy.",), ("quick the brown fox",)], "t string").select(spotsigs.fingerprint(F.col("t")).alias("p")).collect()
    h = lambda *w: spark.range(1).select(F.hash(*map(F.lit, w))).first()[0]
    assert got[0].p == sorted({h("the", "quick", "brown"), h("is", "very", "lazy")}) and got[1].p == [h("the", "brown", "fox")]


def test_similar_pairs(spark, docs):
    sets = docs.select("doc_id", spotsigs.fingerprint(F.col("text")).alias("prints"))
    pairs, members = spotsigs.similar_pairs(sets, 0.5)
    rows = {r.doc_id: set(r.prints) for r in sets.collect() if r.prints}
    rep = {r.doc_id: r.representative for r in members.collect()}
    want = set()
    reps = sorted(set(rep.values()))
    for i, a in enumerate(reps):
        for b in reps[:i]:
            if len(rows[a] & rows[b]) / len(rows[a] | rows[b]) >= 0.5:
                want.add(frozenset((a, b)))
    assert {frozenset((r.a, r.b)) for r in pairs.collect()} == want and want


# 7: WARC --------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, digest string"


def pages():
    big = "<p>" + "x" * 200 + "</p>"
    return [(3, "http://a/1", big, "clash"), (1, "http://a/2", big, None), (7, None, big, None), (8, "u\nv%", "short", None), (9, "u", "short", None), (10, "u", None, None), (11, "u", "é" * 60, None), (12, "u", "y" * 100_000, None), (1, "http://a/2", big, None), (None, "n", big, None)]


def test_warc_round_trip(spark):
    path = fresh_path(spark, "warc")
    warc.write_archives(spark.createDataFrame(pages(), PAGES).repartition(3), path)
    got = collections.Counter((r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload is not None) for r in warc.read_archives(spark, path).collect())
    want = collections.Counter()
    for p, u, h, _ in pages():
        b = (h or "").encode()
        same = [q for q, _, g, _ in pages() if g == h and q is not None]
        refers = min(same) if len(b) >= 100 and same and p != min(same) else None
        want[(p, u, "revisit" if refers is not None else "response", refers, len(b), hashlib.sha256(b).hexdigest(), refers is None)] += 1
    assert got == want


def test_warc_rolls_archives(spark):
    d = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i} " + text(60, i) + "</p>") for i in range(80)] + [(100 + i, None, "<p>" + "same " * 40 + "</p>") for i in range(40)], "page_id long, url string, html string").coalesce(1)
    path = fresh_path(spark, "warc")
    warc.write_archives(d, path, archive_bytes=2000)
    assert spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).count() > 4
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_archives(spark, path).collect()}
    assert got == {i: ("response", None) for i in range(80)} | {100: ("response", None)} | {100 + i: ("revisit", 100) for i in range(1, 40)}


def test_warc_empty(spark):
    path = fresh_path(spark, "warc")
    warc.write_archives(empty(spark, PAGES), path)
    assert warc.read_archives(spark, path).count() == 0


def archive(*records, dictionary=True):
    d = b"dictionary bytes " * 20
    z = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d))
    return (struct.pack("<II", warc.DICTIONARY_MAGIC, len(d)) + d if dictionary else b"") + b"".join(z.compress(r) for r in records)


def test_warc_faults():
    good = warc._record(1, "u", b"body", hashlib.sha256(b"body").hexdigest(), None, "1970-01-01T00:00:00Z")
    assert next(warc.parse_archive(archive(good)))["payload"] == b"body"
    bad = [archive(good, dictionary=False), archive(good)[:-3], archive(good) + b"xx", archive(good.replace(b"Content-Length: 4", b"Content-Length: 5")), archive(good.replace(b"body", b"bodi")), archive(good.replace(b"WARC-Date", b"WARC-Dat")), archive(b"WARC/1.1\r\nno head"), archive(good[:-1])]
    for data in bad:
        with pytest.raises((warc.BadRecord, zstandard.ZstdError)):
            list(warc.parse_archive(data))


# 8: nearest neighbours ----------------------------------------------------------------------------------


def test_ann_recall_and_ties(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(800, 12))
    x[100:400] = x[100]  # a hot vector
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(900, None, 0), (901, [0.0] * 12, 0), (902, [float("nan")] + [1.0] * 11, 0), (903, [None] + [1.0] * 11, 0), (904, [1.0, 2.0], 0), (905, [float("inf")] * 12, 0), (None, [1.0] * 12, 0)]
    v = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert v.count() == 800
    got = collections.defaultdict(list)
    for q in ann.nearest(v, v.where("vec_id % 50 = 0")).collect():
        got[q.query_id].append((q.rank, q.vec_id, q.score))
    hit = 0
    for q, found in got.items():
        found.sort()
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(d)), d))[:10].tolist()
        assert len(found) == 10 and all(abs(s - d[i]) < 1e-9 for _, i, s in found)
        assert [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        hit += len(set(best) & {i for _, i, _ in found})
        if 100 <= q < 400:
            assert [i for _, i, _ in found] == best
    assert len(got) == 16 and hit >= 0.9 * 160


def test_ann_few(spark):
    v = ann.usable(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0]), (2, [5.0, 5.0])], "vec_id long, embedding array<double>"))
    assert [(r.rank, r.vec_id) for r in ann.nearest(v, v.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    none = ann.usable(empty(spark, "vec_id long, embedding array<double>"))
    assert ann.nearest(none, none).count() == 0


# 10: HTML --------------------------------------------------------------------------------------------------


def page(i, body, extra=""):
    return f'<!DOCTYPE html><html><head><title>t{i}</title><style>p{{}}</style><script>var a="</p>";f({i})</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad {i} --><div class="ad">Buy now</div><div id="cookie-notice">We use cookies</div>{body}<aside>See also</aside><form><input>Search</form><div class="comments"><p>nice</p></div><footer>&copy; host</footer>{extra}</body></html>'


def test_html_article():
    t = html.main_text(page(1, "<article><h1>A &amp;amp; B</h1><p><b>One<br>two\n three<p>Four&nbsp;five &#233;&am</article>"))
    assert t == "A &amp; B One two three Four five é&am"
    assert html.main_text("") == "" and html.main_text("plain < text") == "plain < text"
    assert html.main_text("<nav><article><p>x</article>") == "x" and html.main_text("<article><p>cut <b") == "cut"
    assert html.main_text("<article><div class='share'>no</div><p>yes</p><script>x</script></article>") == "yes"
    long = " ".join(WORDS * 400)
    assert html.main_text(page(2, f"<article><p>{long}</p></article>")) == long


def test_html_attributes_are_read_one_after_the_other():
    marks = ("title='the hidden gem'", 'aria-hidden="false"', 'data-id="comments"', "", 'data-role=navigation', 'class="section-header"', "alt=\"class='ad'\"", 'id="share-price-history"', "data-class='menu'")
    body = "".join(f"<p {m}>par {i}</p>" for i, m in enumerate(marks))
    assert html.main_text(f"<article>{body}<p class='x ad'>no</p><p hidden>no</p><p HIDDEN=''>no</p><div id=comments>no</div></article>") == " ".join(f"par {i}" for i in range(len(marks)))
    assert html.marks_of("CLASS=a class=b id='x y' hidden") == {"class": "a", "id": "x y", "hidden": ""}


def test_html_templates_find_slots_without_articles(spark):
    rows = [(i, f"http://h.example/{i}", page(i, f"<div class='top'><span>Site name</span></div><div class='body-text'><p>{text(30, i)}</p><p>{text(20, i + 500)}</p></div>"), "x") for i in range(12)]
    rows += [(50, None, None, "x"), (51, "http://one.example/", page(51, "<article><p>alone</p></article>"), "x"), (52, "bad url", "", "x"), (0, "http://h.example/0", rows[0][2], "x")]
    got = collections.defaultdict(list)
    for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect():
        got[r.page_id].append((r.text, r.n_chars))
    for i in range(12):
        want = f"{text(30, i)} {text(20, i + 500)}"
        assert set(got[i]) == {(want, len(want))}
    assert len(got[0]) == 2 and got[50] == [("", 0)] and got[51] == [("alone", 5)] and got[52] == [("", 0)]
    assert html.extract(empty(spark, "page_id long, url string, html string")).count() == 0


def test_html_classes_are_those_of_brute_force(spark):
    """Occurrence vectors, classes, their validity and nesting, and the slots, worked out page by page."""
    r, rows = random.Random(2), []
    for h in range(3):
        for i in range(9):
            items = "".join(f"<li>item {r.randint(0, 3)}</li>" for _ in range(r.randint(1, 4)))
            body = f"<div class='main-part'>{''.join(f'<p>{text(r.randint(3, 12), 1000 * h + 10 * i + j)}</p>' for j in range(r.randint(1, 3)))}</div>"
            extra = "<section><h2>Note</h2><em>x</em></section>" if i % 2 else ""
            rows.append((100 * h + i, f"http://h{h}.example/{i}", f"<html><body><div class=top><ul>{items}</ul><b>Home</b></div>{body if h else '<article>' + body + '</article>'}{extra}<div class=low><i>end</i></div></body></html>"))
    got = {x.host: (x.slot, set(x.fixed or ())) for x in html.templates(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    for h in range(3):
        pages = {i: html.occurrences(p) for i, u, p in rows if u.startswith(f"http://h{h}.")}
        tokens = {t: o for page in pages.values() for t, o in page.items()}
        depth = {t: max(page[t][2] for page in pages.values() if t in page) for t in tokens}
        mass = {t: sum(page[t][3] for page in pages.values() if t in page) for t in tokens}
        vector = {t: tuple(page.get(t, [0])[0] for page in pages.values()) for t in tokens}
        classes = collections.defaultdict(set)
        for t, v in vector.items():
            if 2 * sum(x > 0 for x in v) >= len(pages):
                classes[v].add(t)
        classes = {v: c for v, c in classes.items() if len(c) >= 2}
        of = {t: v for v, c in classes.items() for t in c}
        valid = {t for v, c in classes.items() if len({of.get(tokens[t][4]) for t in c} - {v}) <= 1 for t in c}
        most = max(mass[t] for t in valid)
        seen = {t: sum(x > 0 for x in vector[t]) for t in valid}
        fit = [t for t in valid if tokens[t][1] == 2 or tokens[t][1] == 1 and mass[t] >= html.MASS * most]
        slot = max(fit, key=lambda t: (tokens[t][1] == 2, -depth[t] if tokens[t][1] == 2 else depth[t], seen[t], t))
        assert got[f"h{h}.example"] == (slot, {t for t in valid if tokens[t][1] == 0 and seen[t] == len(pages)})


def test_html_entities_round_trip(spark):
    body = "a < b & c > d \"q\" 'x' é 漢"
    assert html.main_text(f"<article><p>{html_lib.escape(body)}</p></article>") == body


# 2: licences -------------------------------------------------------------------------------------------------


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, "r/LICENSE", mit), (2, "r/a/x.py", "code"), (3, "r/a/b/y.py", "more code"), (4, "r/a/LICENSE", "Licensed under the Apache License, Version 2.0."), (5, "r/a/b/z.py", "# Released under the MIT License.\n" + "code line\n" * 50), (6, "q/w.py", None), (7, None, ""), (8, "r/n.py", "the licence to speak freely is old")]
    out = {x.doc_id: x for x in licenses.inherit(licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"))).collect()}
    assert out[1].own == "MIT" and out[1].declares and out[4].own == "Apache-2.0"
    assert (out[2].inherited, out[2].from_dir) == ("Apache-2.0", "r/a") and out[3].inherited == "Apache-2.0"
    assert out[5].own == "MIT" and not out[5].declares and out[6].inherited is None and out[7].inherited is None and out[8].own is None and out[8].inherited == "MIT"


def test_wrapped_licence_texts_declare(spark):
    wrapped = lambda t: "\n".join(t[i : i + 70] for i in range(0, len(t), 70))
    rows = [(i, f"{n}/sub/readme", wrapped("Copyright (c) 1999 A. Person\n\n" + t), "x") for i, (n, t) in enumerate(sorted(licenses.BODIES.items()))]
    rows += [(100 + i, f"{n}/sub/deep/code", "plain words", "x") for i, n in enumerate(sorted(licenses.BODIES))]
    rows += [(103, "MIT/sub/deep/code", "plain words", "x"), (300, None, None, "x"), (301, "x/y", "", "x"), (302, "x/z", "word " * 30_000 + "licensed under the MIT License.", "x")]
    got = collections.defaultdict(list)
    for r in licenses.inherit(licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string, own string"))).collect():
        got[r.doc_id].append(r)
    for i, n in enumerate(sorted(licenses.BODIES)):
        assert got[i][0].own == n and got[i][0].declares and {(r.inherited, r.from_dir) for r in got[100 + i]} == {(n, f"{n}/sub")}
    assert len(got[103]) == 2 and got[300][0].inherited is None and got[301][0].own is None and got[302][0].own is None
    assert licenses.inherit(licenses.scan(empty(spark, "doc_id long, path string, text string"))).count() == 0


def test_cosine_is_that_of_brute_force():
    s = licenses.Scanner(licenses.TEMPLATES, licenses.BODIES)
    r = random.Random(5)
    vocabulary = sorted({w for _, words in s.parts for w in words if " " not in w}) + ["other", "thing"]
    for _ in range(60):
        t = " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 40)))
        weights = lambda c: {w: (1 + math.log(n)) * s.idf.get(w, s.unseen) for w, n in c.items()}
        v = weights(licenses._words(t))
        near = []
        for name, words in s.parts:
            u = weights(words)
            near.append((-round(sum(x * u.get(w, 0) for w, x in v.items()) / math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in u.values())), 9), name))
        assert round(s.best(t)[1], 9) == -min(near)[0]


def test_license_templates_find_themselves():
    s = licenses.Scanner(licenses.TEMPLATES, licenses.BODIES)
    for name, t in licenses.TEMPLATES.items():
        assert s.scan(t)[0] == name


# the pipeline --------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rows = [r for r in corpus()]
    for i in range(60):
        rows.append((3000 + i, text(30, 9000 + i) + (" scumbagzz " if i % 3 == 0 else ""), "en", "t", 1))
    d = str(tmp_path)
    spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("component_id", "toxicity", "__toxicity", "slot", "position", "row")}).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(3000 + i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = cp.drop_toxic(spark, docs, d)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {r[0] for r in rows if not (r[0] >= 3000 and (r[0] - 3000) % 3 == 0)}
    one = cp.keep_one_of_near(spark, docs, d)
    comp = {(i, c) for i, _, c in brute_components(rows)}
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(i for i, c in comp if i == c)
    out = cp.run(spark, d)
    places = sorted((r.position, r.doc_id) for r in out.collect())
    assert [p for p, _ in places] == list(range(len(places)))
    mixed = spark.read.parquet(f"{d}/documents.parquet").where(F.col("doc_id").isin([i for _, i in places if i is not None])).dropDuplicates(["doc_id"])
    order = {r.doc_id: (r.slot, r.place) for r in mixing.positions(mixed).collect()}
    if len(order) == len(places):
        assert [order[i] for _, i in places] == sorted(order.values())
    assert out.count() == len({i for i, _, c in brute_components([r for r in rows if r[0] in ids]) if i == c})


def test_places_in_the_mixture_shuffle_no_text(spark, tmp_path):
    import corpus_pipeline as cp

    rows = [(i, f"text {i}" if i % 7 else None, "en", "t", 1) for i in range(200)]
    d = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, DOCS).repartition(9).write.parquet(d)
    docs = spark.read.parquet(d)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = cp.placed(docs)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning(file" not in plan
        want = docs.orderBy("_metadata.file_path", "_metadata.row_index").select("doc_id", "text").collect()
        assert sorted((r.position, r.doc_id, r.text or "") for r in got.collect()) == [(i, r.doc_id, r.text or "") for i, r in enumerate(want)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_places_are_packed_without_large_copies():
    import tracemalloc

    r = np.random.default_rng(5)
    v = np.where(r.random(8 * CHUNK + 3) < 0.95, r.integers(0, 192, 8 * CHUNK + 3), r.integers(0, 64 << 16, 8 * CHUNK + 3)).astype(np.uint32)
    tracemalloc.start()
    try:
        packed = pack_places(v)
        assert tracemalloc.get_traced_memory()[1] < 1.5 * v.nbytes
    finally:
        tracemalloc.stop()
    assert (unpack_places(packed) == v).all() and packed[0] == 1


def test_slices_keep_all_rows():
    import pyarrow as pa

    sizes = [2 * TAKE_DOCS + 5, 0, 1, TAKE_DOCS]
    batches = [pa.record_batch([pa.array([f"{k} {i}" for i in range(n)], pa.string())], names=["text"]) for k, n in enumerate(sizes)]
    got = list(slices(batches))
    assert [b.num_rows for b in got] == [TAKE_DOCS, TAKE_DOCS, 5, 1, TAKE_DOCS]
    assert [t for b in got for t in b.column(0).to_pylist()] == [f"{k} {i}" for k, n in enumerate(sizes) for i in range(n)]


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp

    d = str(tmp_path)
    empty(spark).write.parquet(f"{d}/documents.parquet")
    empty(spark, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert cp.run(spark, d).count() == 0


def test_ann_repeated_ids_and_other_lengths(spark):
    rows = [(i, [float(i), 1.0, 0.5]) for i in range(1, 60)] + [(100, [3.0, 1.0, 0.5]), (100, [4.0, 1.0, 0.5]), (200, [1.0]), (300, None), (400, [0.0, 0.0, 0.0]), (500, [float("nan"), 1.0, 1.0])]
    d = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    v = ann.usable(d)
    got = ann.nearest(v, v.where("vec_id in (100, 200, 300, 400)")).collect()
    assert {r.query_id for r in got} == {100} and all(r.vec_id not in (200, 300, 400, 500) for r in got)


CONTRACTS = {
    "op1_": "doc_id bigint, held_out boolean, score double, predicted int", "op3_": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op4_": "doc_id bigint, n_shingles bigint, component_id bigint", "op6_": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op7_": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint", "op8_": "query_id bigint, rank int, vec_id bigint, score double", "op9_": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", "op10_": "page_id bigint, url string, text string, n_chars bigint",
}


def test_columns_and_types_of_the_contracts(spark):
    from cohortmill.llm.queries import QUERIES

    for prefix, want in CONTRACTS.items():
        (name,) = [n for n in QUERIES if n.startswith(prefix)]
        got = dict(QUERIES[name](spark, "/root/testdata/sf0.001").dtypes)
        assert dict(c.split() for c in want.split(", ")).items() <= got.items(), name


def test_schema_of_queries_is_the_contract(spark):
    from cohortmill.llm.queries import QUERIES

    assert [n.split("_")[0] for n in QUERIES] and {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


def test_html_template_alone_decides_without_article_or_names(spark):
    """Ten hosts whose class names mean nothing and whose pages have no article: with the template, what stands on all pages goes, menus, adverts in the text and notices; without it, it stays."""
    r, rows, want = random.Random(12), [], {}
    for h in range(10):
        menu, advert, notice = (f"{w} " + text(9, 100 * h + i) for i, w in enumerate(("Menu", "Advert", "Notice")))
        for p in range(12):
            title, body = text(4, 7000 + 20 * h + p), [text(r.randint(20, 40), 90000 + 1000 * h + 20 * p + j) for j in range(3)]
            page = f'<html><body><div class="x1"><div class="q{h}">{menu}</div><div class="z9"><h1>{title}</h1><p>{body[0]}</p><div class="m4">{advert}</div><p>{body[1]}</p><p>{body[2]}</p></div><div class="u2">{notice}</div></div></body></html>'
            rows.append((100 * h + p, f"https://host{h}.example/{p}", page))
            want[100 * h + p] = " ".join([title, *body])
    got = {x.page_id: x.text for x in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == want
    assert sum(html.main_text(p) != want[i] for i, _, p in rows) == len(rows)


def test_html_long_and_broken_pages_cost_linear_time():
    """Deep nesting, quotes that never close and tags that never end: ten times the page takes some ten times as long, and never minutes."""
    import time

    for make in (lambda n: "<div>a" * n, lambda n: '<a "' * n, lambda n: '<a ">" ' * n, lambda n: "<a" * n, lambda n: "</x>" * n + "<i>" * n + "</q>" * n, lambda n: "<div>" * n + "text" + "</div>" * n):
        began = time.time()
        page = make(50_000)
        html.main_text(page)
        html.occurrences(page)
        assert time.time() - began < 20
    assert html.main_text("<div>a" * 50_000) == " ".join(["a"] * 50_000)
    assert html.main_text("x<b>y" + '<a "') == "xy"
