"""Operators 11 to 13 against brute force and SQL, on fixtures with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from compare import oracle, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortmill.llm import collocations, periodic_runs, shuffle_shards
from cohortmill.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CONTRACTS = {
    "op11_shuffle_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op12_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op13_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
}


def corpus():
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    out = []
    for i in range(160):
        words = [r.choice(vocabulary[: r.choice([3, 40])]) for _ in range(r.randint(1, 90))]
        if i % 4 == 0:
            words += [r.choice(vocabulary) for _ in range(r.randint(1, 6))] * r.randint(3, 12)
        t = "".join(w + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "; "]) for w in words)
        out.append((i, t.upper() if i % 9 == 0 else t, r.choice(["en", "de", None]), "hot" if i % 3 else "s", 1))
    out += [(200 + i, " ".join(["a b c"] * (9 + i) + ["rest"] * i + ["d e"] * 15 + [f"q{i}"] * 30), "de", "s", 1) for i in range(6)]
    out += [(300, None, "en", None, 1), (301, "", "fr", "s", 1), (302, " \n\t. ", None, "s", 1), (None, "a b " * 40, "en", "s", 1), (303, "x y z " * 9000, "en", "s", 1), (304, "Ünï çödé 漢字\x00 😀 Ünï çödé", "fr", "s", 1)]
    return out + [(305, "same text here " * 12, "en", "hot", 1)] * 60


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5)


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    clash = {c: F.lit("clash") for c in ("shard", "slot", "bucket", "record", "code", "runs", "best", "word", "phrase", "block", "rank")}
    docs.withColumns(clash).write.parquet(f"{d}/documents.parquet")
    return d


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_contracts_and_empty_tables(spark, folder, tmp_path):
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    for name, want in CONTRACTS.items():
        assert dict(QUERIES[name](spark, folder).dtypes) == dict(c.split() for c in want.split(", ")), name
        none = QUERIES[name](spark, str(tmp_path))
        assert none.count() == 0 and dict(none.dtypes) == dict(c.split() for c in want.split(", ")), name


# 11: shards -------------------------------------------------------------------------------------


def test_shards_hold_every_row_once_in_gapless_slots(spark, folder):
    got = QUERIES["op11_shuffle_shards"](spark, folder).collect()
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in corpus())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = collections.defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(8)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_against_a_plain_two_pass_shuffle(spark, folder):
    """The same permutation from the hashes alone: buckets in order, each sorted and shuffled, cut into shards."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = shuffle_shards.shuffled(docs, 3, 7, 4000)
    assert out.columns == [*docs.columns, "shard_", "slot_"]
    placed, code = shuffle_shards.placed(docs, 7)
    size = shuffle_shards.record_size(F.col("text"))
    all_ = [(r[0], r[1], r[2], r[3]) for r in placed.select(code, F.xxhash64("text"), "doc_id", size).collect()]
    n_buckets = -(-sum(r[3] for r in all_) // 4000)
    assert n_buckets > 5
    buckets = collections.defaultdict(list)
    for r in sorted(all_, key=lambda r: r[:2]):
        buckets[r[0] % n_buckets].append(r[2])
    order = []
    for b in sorted(buckets):
        at = np.arange(len(buckets[b]))
        np.random.Generator(np.random.PCG64([7, b])).shuffle(at)
        order += [buckets[b][i] for i in at]
    n, want, slots = len(order), [], collections.Counter()
    for p, d in enumerate(order):
        want.append((d, p * 3 // n, slots[p * 3 // n]))
        slots[p * 3 // n] += 1
    got = [(r.doc_id, r["shard_"], r["slot_"]) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    again = [(r.doc_id, r["shard_"], r["slot_"]) for r in shuffle_shards.shuffled(docs, 3, 7, 4000).collect()]
    other = [(r.doc_id, r["shard_"], r["slot_"]) for r in shuffle_shards.shuffled(docs, 3, 8, 4000).collect()]
    assert sorted(again, key=repr) == sorted(got, key=repr) != sorted(other, key=repr)


def test_shards_scatter_copies_and_more_shards_than_rows(spark, docs, tmp_path):
    same = spark.createDataFrame([(1, "copy", "en", "hot", 1)] * 3000, DOCS)
    out = shuffle_shards.write_shards(same, f"file://{tmp_path}/a", 8, 1, 500)
    assert [r["count"] for r in out.groupBy("shard").count().collect()] == [375] * 8
    sizes = [r["count"] for r in out.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= 8
    few = shuffle_shards.write_shards(spark.createDataFrame(corpus()[:3], DOCS), f"file://{tmp_path}/b", 8)
    assert sorted(r.slot for r in few.collect()) == [0, 0, 0] and few.select("shard").distinct().count() == 3
    # Neighbours in the table are not neighbours in the shards.
    ids = [r.doc_id for r in shuffle_shards.shuffled(spark.range(2000).selectExpr("id as doc_id", "'t' as text"), 1).orderBy("slot").collect()]
    assert sum(abs(a - b) == 1 for a, b in zip(ids, ids[1:], strict=False)) < 20


# 12: periodic runs ------------------------------------------------------------------------------


def smallest_period(w):
    f = [0]
    for i in range(1, len(w)):
        k = f[-1]
        while k and w[i] != w[k]:
            k = f[k - 1]
        f.append(k + (w[i] == w[k]))
    return len(w) - f[-1]


def brute_runs(w, least=24, times=3):
    out = []
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i > s and i + p - s >= max(least, times * p) and smallest_period(w[s : i + p]) == p:
                out.append((s, i + p - s, p))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 12)), max_size=8), st.sampled_from([3, 9, 24]))
def test_runs_against_brute_force(parts, least):
    w = [x for block, n in parts for x in block * n]
    assert periodic_runs.find_runs(np.array(w, np.int32), least) == brute_runs(w, least)


def test_runs_do_not_depend_on_the_step(monkeypatch):
    w = np.array(([1, 2, 3] * 30 + list(range(10, 60))) * 4 + [7] * 500)
    want = periodic_runs.find_runs(w)
    assert want == brute_runs(w.tolist())
    monkeypatch.setattr(periodic_runs, "STEP", 50)
    assert periodic_runs.find_runs(w) == want


def brute_op12(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w and doc_id is not None:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_of_documents(spark, folder):
    small = [r for r in corpus() if r[0] != 303]
    cols = [c.split()[0] for c in CONTRACTS["op12_periodic_runs"].split(", ")]
    got = [tuple(r[c] for c in cols) for r in QUERIES["op12_periodic_runs"](spark, folder).collect()]
    long = [r for r in got if r[0] == 303]
    assert [r[1:6] for r in long] == [(1, 0, 27000, 3, 9000000)]
    want = [brute_op12(d, t) for d, t, *_ in small]
    assert collections.Counter(r for r in got if r[0] != 303) == collections.Counter(want)
    assert sum(r[1] > 0 for r in want) > 30 and any(r[1] > 1 for r in want) and any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in small)


def test_runs_of_the_small_table(spark):
    cols = [c.split()[0] for c in CONTRACTS["op12_periodic_runs"].split(", ")]
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: tuple(r[c] for c in cols) for r in QUERIES["op12_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    some = [r for r in table if len(r.text or "") < 6000]
    assert len(got) == len(table) and all(got[r.doc_id] == brute_op12(r.doc_id, r.text) for r in some) and len(some) > 100


# 13: collocations -------------------------------------------------------------------------------


def brute_phrases(docs, least, top, most=4, within=80):
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, t, lang, *_ in docs:
        lang = lang or "und"
        low = (t or "").encode().lower()
        for piece in low.translate(bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"\n" * 10)).split(b"\n"):
            w = [x for x in piece.replace(b"\t", b" ").split(b" ") if x]
            n[lang] += len(w)
            for k in range(1, most + 1):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        kept = {g: a for g, a in f.items() if a >= least and len(g) > 1}
        inside = collections.Counter()
        for g, a in kept.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    inside[g[i : i + k]] = max(inside[g[i : i + k]], a)
        mine = []
        for g, a in kept.items():
            if inside[g] and 100 * inside[g] >= within * a:
                continue
            score, _, left, right = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            mine.append((-score, -a, b" ".join(g), left, right))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(mine)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 700, "bucket_bytes": 100}])
def test_phrases_against_brute_force(spark, docs, sizes):
    cols = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    for least, top in ((3, 40), (30, 2000)):
        got = sorted(tuple(r[c] for c in cols) for r in collocations.collocations(docs, top, least, **sizes).collect())
        assert got == brute_phrases(corpus(), least, top)
        assert len(got) > 60 or least == 30


def test_phrases_when_the_broadcast_table_is_full(spark, docs, monkeypatch):
    """A table with fewer bits than phrases lets others through, whose own counts stop them."""
    monkeypatch.setattr(collocations, "PART", 1)
    monkeypatch.setattr(collocations, "TABLE_BITS", 8)
    cols = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    got = sorted(tuple(r[c] for c in cols) for r in collocations.collocations(docs, 100, 3).collect())
    assert got == brute_phrases(corpus(), 3, 100)


def test_phrases_by_sql(spark, folder):
    cols, got = rows(QUERIES["op13_collocations"](spark, "/root/testdata/sf0.001"))
    assert got == oracle("/root/testdata/sf0.001", collocations.OP13_SQL, cols) and got


def test_exact_scores_beyond_64_bits(spark):
    big = 6 * 10**13
    d = spark.createDataFrame([(big, big, big + 1), (30, 31, 34)], "a long, l long, r long")
    assert [r[0] for r in d.select(collocations.score(F.col("a"), F.col("l"), F.col("r"))).collect()] == [2000000 * big // (2 * big + 1), 2000000 * 30 // 65]
