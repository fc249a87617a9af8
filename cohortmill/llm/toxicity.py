"""Toxicity by weak supervision.

Voters are lexicons, patterns and signs of clean texts. Lexicons are mined from labelled rows: words and word beginnings that mark the toxic
class, in bands of strength; a voter fires when a text holds as many of them as it asks for. Patterns look for shouting, exclaiming, masked, drawn-out and
spaced-out words, whatever the words. Two voters fire on texts that hold no strong entry, and no entry at all. A generative label model (a latent class with two
states) estimates by expectation maximisation how often each voter fires in either class, starting from the
labelled rows; labels keep a share in these estimates, so that the classes stay what the labels mean, and do not vote themselves. The voters' correlations, given the class, discount those that repeat each other. A
linear classifier over the lexicon's features and the votes is then trained on the posterior labels
and scores every text. Scoring is one pass over the documents without a shuffle.

Counts for the lexicon cover the labelled rows that may be learned from, up to SAMPLE_ROWS of them by a hash of
their id; model, lexicon and votes are bounded by parameters. An entry must stand in LEAST_FAMILIES families of toxic
texts, told apart by the smallest hash of their words, so that words which only copies of one text share do not count. Labels, lang, source and doc_id are no
inputs of a score. Null text is empty. A null or empty text gets the score of a text without
features. Null or conflicting labels: null ones teach nothing, repeated ones count each. Without labels of both classes every
score is the prior, 0 where there is none. Very long texts are scored whole; equal texts have equal scores, rows that repeat are scored each. An empty table gives no rows. Extra columns
are not read; a column of the score's name gives way.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, materialise, slices, table

#: Labelled rows learned from, and lexicon entries, at most; rows that must hold an entry, at least.
SAMPLE_ROWS, LEXICON, LEAST_ROWS, LEAST_FAMILIES = 24_000, 20_000, 4, 4
#: Letters of word beginnings; log-odds from which bands begin; numbers of entries that voters ask for.
BEGINNINGS, BANDS, ASKS = (4, 5, 6, 7), (1.5, 3.0, 4.5), (1, 2, 4)
#: Share of the labels in the estimates of the voters' rates; power of a voter's summed correlations that divides its vote (1: copies count as one).
ANCHOR, SHARED = 0.5, 0.8

# Patterns that voters look for, whatever the words; each asks for so many matches.
PATTERNS = (
    ("shouting", re.compile(r"\b[A-Z]{4,}\b"), 2),
    ("exclaiming", re.compile(r"[!?]{2,}"), 1),
    ("masked", re.compile(r"[A-Za-z][0-9@$*#]+[A-Za-z]"), 1),
    ("drawn out", re.compile(r"([A-Za-z])\1{3,}"), 1),
    ("spaced out", re.compile(r"\b(?:[A-Za-z][ .-]){4,}[A-Za-z]\b"), 1),
)
_WORD = re.compile(r"[^\W_]+")


def features(text: str) -> set[str]:
    """Distinct words ('=word') and beginnings of longer words ('^begin') of a text, lower case."""
    words = set(_WORD.findall(text.lower()))
    out = {"=" + w for w in words}
    for n in BEGINNINGS:
        out.update(["^" + w[:n] for w in words if len(w) > n])
    return out


def found(text: str, lexicon: dict[str, int]) -> list[int]:
    """The lexicon's entries that a text holds."""
    words = set(_WORD.findall(text.lower()))
    get = lexicon.get
    hits = {get("=" + w) for w in words}
    for n in BEGINNINGS:
        hits.update([get("^" + b) for b in {w[:n] for w in words if len(w) > n}])
    hits.discard(None)
    return sorted(hits)


def observed(text: str, lexicon: dict[str, int]) -> list[int]:
    """The lexicon's entries and, from LEXICON on, the patterns that a text holds."""
    fired = []
    for i, (_, pattern, asked) in enumerate(PATTERNS):
        matches = pattern.finditer(text)
        if all(next(matches, None) for _ in range(asked)):
            fired.append(LEXICON + i)
    return found(text, lexicon) + fired


class Model:
    """Lexicon, voters, label model and classifier. Voters: lexicons by kind, strength and number of entries asked for; patterns; and, for the clean class, texts
    that hold no strong entry, and no entry at all."""

    def __init__(self, lexicon: dict[str, int], odds: np.ndarray, prior: float):
        self.lexicon, self.odds, self.prior = lexicon, odds, prior
        self.words = np.zeros(len(odds), bool)
        for k, i in lexicon.items():
            self.words[i] = k[0] == "="
        self.voters = [(kind, band, ask) for kind in (True, False) for band in BANDS for ask in ASKS]
        self.w = np.zeros(len(odds) + len(self.voters) + len(PATTERNS) + 2 + 1)

    def votes(self, hits: list[int]) -> np.ndarray:
        """1 where a voter fires, else 0."""
        h = np.asarray(hits, np.int64)
        fired = np.isin(LEXICON + np.arange(len(PATTERNS)), h)
        h = h[h < LEXICON]
        odds, word = self.odds[h], self.words[h]
        lexicons = [((odds >= band) & (word == kind)).sum() >= ask for kind, band, ask in self.voters]
        return np.array([*lexicons, *fired, not (odds >= BANDS[1]).any(), not len(h)], float)

    def row(self, hits: list[int]) -> tuple[np.ndarray, np.ndarray]:
        v = self.votes(hits)
        n = len(self.odds)
        at = np.concatenate([[h for h in hits if h < LEXICON], n + np.flatnonzero(v), [n + len(v)]]).astype(np.int64)
        return at, np.ones(len(at))

    def score(self, hits: list[int]) -> float:
        at, x = self.row(hits)
        return float(1 / (1 + np.exp(-np.clip(self.w[at] @ x, -40, 40))))


def label_model(votes: np.ndarray, truth: np.ndarray, rounds: int = 25, anchor: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior, rate of firing by class [2, voters], discount of each voter) by expectation maximisation. ``truth`` starts it: from it the voters' first rates come, and it keeps
    the share ``anchor`` of them; it does not vote."""
    post = np.clip(truth.astype(float), 0.02, 0.98)
    discount = np.ones(votes.shape[1])
    rate = np.zeros((2, votes.shape[1]))
    for i in range(rounds):
        side = anchor * np.clip(truth, 0.02, 0.98) + (1 - anchor) * post
        side = np.stack([1 - side, side])
        rate = np.clip((side @ votes + 0.5) / (side.sum(1)[:, None] + 1), 1e-4, 1 - 1e-4)
        if i % 5 == 0:
            # Correlation of the votes that is left once the class is known.
            rest = votes - side.T @ rate
            norm = np.sqrt((rest**2).sum(0)) + 1e-9
            corr = np.abs((rest.T @ rest) / norm[:, None] / norm[None, :])
            discount = np.maximum(corr.sum(1), 1) ** -SHARED
        prior = np.clip(post.mean(), 1e-4, 1 - 1e-4)
        on, off = np.log(rate[1] / rate[0]), np.log((1 - rate[1]) / (1 - rate[0]))
        logit = np.log(prior / (1 - prior)) + (votes * on + (1 - votes) * off) @ discount
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return post, rate, discount


def _train_linear(model: Model, hits: list[list[int]], target: np.ndarray, epochs: int = 60, rate: float = 0.5, l2: float = 2e-5) -> None:
    rows = [model.row(h)[0] for h in hits]
    at, ends = np.concatenate(rows), np.cumsum([len(r) for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    starts = ends - [len(r) for r in rows]
    per = np.sqrt(np.bincount(at, minlength=len(model.w)) + 1)  # rare entries learn as fast as frequent ones
    # Start from each entry's own evidence.
    model.w[: len(model.odds)] = np.where(model.odds > 0, 0.3 * model.odds, 0.0)
    model.w[-1] = np.log(model.prior / (1 - model.prior))
    for _ in range(epochs):
        z = np.add.reduceat(model.w[at], starts)
        err = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - target
        grad = np.bincount(at, weights=err[owner], minlength=len(model.w))
        model.w -= rate * (grad / per / np.sqrt(len(rows)) * 4 + l2 * per * model.w)


def fit(docs: DataFrame, labels: DataFrame, learn=None) -> Model | None:
    """A model from the labelled rows for which ``learn`` (a Column of doc_id) holds."""
    lab = labels.select(F.col("doc_id").alias("l_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and l_id is not null")
    if learn is not None:
        lab = lab.where(learn(F.col("l_id")))
    n = lab.count()
    lab = lab.where(F.pmod(F.xxhash64("l_id"), F.lit(1 << 20)) < (1 << 20) * min(1.0, SAMPLE_ROWS / max(n, 1)))
    # SAMPLE_ROWS small rows, about, whatever the corpus: the texts are not shuffled.
    known = docs.select("doc_id", "text").join(F.broadcast(lab), F.col("doc_id") == F.col("l_id")).select(F.coalesce("text", F.lit("")).alias("text"), "toxic")
    known = materialise(known, "labelled")

    def count(batches):
        for batch in batches:
            tally: dict[str, list[int]] = {}
            for text, toxic in ((t, x) for b in slices([batch]) for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                has = features(text)
                family = 1 << min((zlib.crc32(f.encode()) for f in has if f[0] == "="), default=0) % 63 if toxic > 0 else 0
                for f in (*has, ""):
                    v = tally.setdefault(f, [0, 0, 0])
                    v[toxic > 0] += 1
                    v[2] |= family
            yield pa.record_batch([pa.array(list(tally), pa.string()), *(pa.array([v[i] for v in tally.values()], pa.int64()) for i in range(3))], names=["f", "clean", "toxic", "families"])

    tallies = known.mapInArrow(count, "f string, clean long, toxic long, families long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.bit_count(F.bit_or("families")).alias("families"))
    tallies = tallies.where(F.col("clean") + F.col("toxic") >= LEAST_ROWS)
    total = tallies.where("f = ''").first()
    if not total or not total.clean or not total.toxic:
        return None
    odds = F.log((F.col("toxic") + 0.5) / (total.toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (total.clean + 1.0))
    strong = tallies.where("f <> ''").withColumn("odds", odds).where(F.col("odds") >= BANDS[0]).where((F.col("toxic") >= LEAST_ROWS) & (F.col("families") >= LEAST_FAMILIES))
    top = strong.orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "f").limit(LEXICON).collect()
    lexicon = {r.f: i for i, r in enumerate(top)}
    model = Model(lexicon, np.array([r.odds for r in top], float), total.toxic / (total.toxic + total.clean))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # LEXICON entries at most

    def look(batches):
        for batch in slices(batches):
            yield pa.record_batch([pa.array([observed(t, shared.value) for t in batch.column(0).to_pylist()], pa.list_(pa.int32())), batch.column(1)], names=["hits", "toxic"])

    seen = known.mapInArrow(look, "hits array<int>, toxic int").collect()  # SAMPLE_ROWS rows, about, of small integers
    hits, truth = [r.hits for r in seen], np.array([float(r.toxic > 0) for r in seen])
    post, _, _ = label_model(np.stack([model.votes(h) for h in hits]), truth, anchor=ANCHOR)
    _train_linear(model, hits, post)
    return model


def scored(docs: DataFrame, model: Model | None, name: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` and, called ``name``, a score between 0 and 1 of each whole text. A column of that name gives way."""
    docs = docs.select(*[c for c in docs.columns if c != name])
    # Bounded by LEXICON.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            s = [0.0 if m is None else m.score(observed(t or "", m.lexicon)) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, name])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def learnable(doc_id):
    return fold(doc_id, 5) != 0


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document; one in five is held out from learning."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    model = fit(docs, table(spark, sf_dir, "labels"), learnable)
    return scored(docs, model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
