"""A global shuffle of a table into shards, in two passes over external storage.

First pass: a seeded hash of each record scatters the table uniformly over buckets of a size that fits a task's memory. Second pass: the records of a bucket are put in the order
of their hashes and then shuffled by Fisher and Yates with a generator seeded by the seed and the bucket, and written. Buckets follow one another, so a record's
place in its bucket and the counts of the buckets before it are its position in one permutation of the whole table; shard s has the positions from
ceil(s N / S) on, so counts of shards are at most one apart (law ``rows``), and slots within a shard have no gaps.

A record is known by its place, the file and row it was read from, besides its id: copies of one record, however many, scatter like
any others, and a task that is run again scatters its rows alike. A table that was not read from files is written first. The same files (but for the UUIDs that
writers put in their names), seed and bucket size give the same shards.

Null, empty and very long texts are records like any others; a record is never cut, so a bucket holds one longer than the bucket size whole. A null doc_id is kept, as are
repeated rows. Columns of the table keep their names, whatever they are; ``shard`` and ``slot`` give way to them by trailing underscores. An empty table gives
no rows. Shards beyond the number of records stay empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path, materialise, table

#: Shards; bytes of text in a bucket; buckets whose counts are summed before the others'; what is not read of a file's name.
SHARDS, BUCKET_BYTES, GROUP = 8, 8 << 20, 1024
UUID = "[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}"


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores after it until no column has it."""
    while name.lower() in [c.lower() for c in columns]:
        name += "_"
    return name


def record_size(text: Column) -> Column:
    """Bytes of the text, and one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def placed(docs: DataFrame, seed: int) -> tuple[DataFrame, Column]:
    """The table, from files, and a hash of each record's id and place."""

    def code(d: DataFrame) -> Column:
        at = d.metadataColumn("_metadata")
        return F.xxhash64(F.lit(seed), F.col("doc_id"), F.regexp_replace(at["file_name"], UUID, ""), at["row_index"])

    try:
        docs.select(code(docs)).schema  # noqa: B018
    except AnalysisException:  # not read from files
        docs = materialise(docs, "unplaced")
    return docs, code(docs)


def offsets(counts: DataFrame) -> DataFrame:
    """(bucket, n) -> bucket, before: the sum of n of the buckets before it, summed by groups of buckets first."""
    group = F.floor(F.col("bucket") / GROUP)
    c = counts.withColumn("of", group)
    upto = W.orderBy("of").rowsBetween(W.unboundedPreceding, -1)
    whole = c.groupBy("of").agg(F.sum("n").alias("n")).select("of", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum("n").over(W.partitionBy("of").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return c.withColumn("inner", inner).join(whole, "of").select("bucket", (F.col("base") + F.col("inner")).alias("before"))


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of ``docs`` with their shard and their slot in it, in the order of the shards within each partition. Texts of ``bucket_bytes`` meet in a task."""
    columns = docs.columns
    docs, code = placed(docs, seed)
    total, n = docs.agg(F.sum(record_size(F.col("text"))), F.count(F.lit(1))).first()
    shard, slot = unused(columns, "shard"), unused(columns, "slot")
    schema = T.StructType([*docs.schema.fields, T.StructField(shard, T.IntegerType()), T.StructField(slot, T.LongType())])
    if not n:
        return docs.sparkSession.createDataFrame([], schema)
    buckets = max(1, -(-total // bucket_bytes))
    bucket = F.pmod(code, F.lit(buckets)).alias("bucket")
    before = offsets(materialise(docs.select(bucket).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket-counts"))
    records = docs.select(bucket, code.alias("code"), F.xxhash64("text").alias("tie"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("record"))

    def permute(key, mine: pa.Table, counts: pa.Table) -> pa.Table:
        first = counts.column("before")[0].as_py()
        order = np.lexsort((mine.column("tie").to_numpy(), mine.column("code").to_numpy()))
        np.random.Generator(np.random.PCG64([seed & (2**63 - 1), key[0].as_py()])).shuffle(order)  # Fisher and Yates
        at = first + np.arange(len(order), dtype=object if n * shards >= 2**62 else np.int64)
        s = at * shards // n
        slots = at - -(-s * n // shards)
        rows = mine.column("record").combine_chunks()
        rows = (rows if isinstance(rows, pa.Array) else pa.concat_arrays(rows.chunks)).take(pa.array(order))
        return pa.table([*rows.flatten(), pa.array(s, pa.int32()), pa.array(slots, pa.int64())], names=[*columns, shard, slot])

    return records.groupBy("bucket").cogroup(before.groupBy("bucket")).applyInArrow(permute, schema)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes the shuffled table as Parquet, a folder for each shard, and gives it as read back. Within a file, rows stand by slot."""
    out = shuffled(docs, shards, seed, bucket_bytes)
    shard = out.columns[-2]
    out.write.partitionBy(shard).option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path).select(*[F.col(f"`{c}`") for c in out.columns])


def op11_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written in a random order into eight shards of equal counts: sizes, checksums, shards and slots as read back."""
    out = write_shards(table(spark, sf_dir, "documents"), fresh_path(spark, "shards"))
    shard, slot = out.columns[-2:]
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), record_size(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"),
        F.col(shard).cast("int").alias("shard"), F.col(slot).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
