"""The corpus pipeline: toxic documents go, near duplicates are thinned to one of each group, sources are mixed to target
weights, and texts become token ids. Each stage takes (spark, docs, sf_dir); its result is written and read again as the
next stage's documents. All columns of documents pass through the first three stages, extra ones too, whatever their names; the last
one returns ids and digests with each document's position in the mixture.

Null and empty texts stay and have no tokens. Rows without an id stay. Of rows that repeat an id one stays, the smallest by all its columns.
Very long texts are taken whole. An empty table gives no rows. Ties: the smallest id stays; the mixture breaks them by a hash of the id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortmill.llm import bpe, mixing, ngram_join, toxicity
from cohortmill.llm.common import materialise, table

#: Documents of this score or more are rejected.
TOXIC = 0.5
#: The stages hold models and joins that SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name.lower() in [c.lower() for c in docs.columns]:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from four in five of the labelled ones, does not reject. Null texts stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.learnable)
    name = unused(docs, "toxicity")
    return toxicity.scored(docs, model, name).where(F.col(name) < TOXIC).drop(name)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id. Documents without words, or without an id, stay."""
    groups = materialise(ngram_join.near_components(docs), "groups")
    gone = groups.where("doc_id is not null and doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = groups.where("doc_id = component_id and n_shingles > 0").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return kept
    # Ids that repeat: the smallest row stays.
    one = kept.join(twice, "doc_id", "left_semi").select(*docs.columns).groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("__row")).select("__row.*")
    return kept.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(one)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture."""
    return mixing.mix(docs)


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, text, position: the place in the order of the files that ``docs`` was read from, from 0. A row for each file is summed
    and broadcast: the driver lists the files anyway, and texts are not shuffled for their place."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    files = docs.select(F.col("_metadata.file_path").alias("of")).groupBy("of").count()
    before = F.coalesce(F.sum("count").over(W.orderBy("of").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return d.join(F.broadcast(files.select("of", before.alias("before"))), F.col("file") == F.col("of")).select("doc_id", "text", (F.col("before") + F.col("row")).alias("position"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, position, n_tokens, ids_sha256, decoded_sha256, token_ids of every document; position is its place in the mixture."""
    import public_tokenizers as P

    return bpe.encode_digests(placed(docs), bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN, ids=True, tag="position")


STAGES = [("toxicity", drop_toxic), ("near_duplicates", keep_one_of_near), ("mixing", mix_sources), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
