"""Helpers shared by the text operators: work folders, materialised tables, Arrow packing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents taken from a batch at a time, and integers worked on at a time, where a whole batch or block would need memory for its copies.
TAKE_DOCS, CHUNK = 1000, 1 << 19


def work_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``. Where it is unset, a temporary folder in local mode, whose
    tasks share the machine; on a cluster an error, for others could not read what is written there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cohortmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut and every later
    reader sees the same rows, even after an executor is lost."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by ``materialise``, once nothing will read it."""
    jvm = df.sparkSession.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id, k: int):
    """crc32 of the decimal doc_id, modulo k: 0 is held out. A null doc_id counts as the text ''."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")) % k


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, some at a time."""
    return (b.slice(i, TAKE_DOCS) for b in batches for i in range(0, b.num_rows, TAKE_DOCS))


class Numbering(dict):
    """Numbers keys in order of first use."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def pack_ints(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, byte planes apart, compressed."""
    v = np.ascontiguousarray(values, dtype="<u4")
    planes = v.view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(3).compress(np.ascontiguousarray(planes).tobytes())


def unpack_ints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def pack_places(values: np.ndarray) -> bytes:
    """Small integers, most of them below 192: one byte each for those, three for others below 4,194,304."""
    v = np.ascontiguousarray(values, dtype="<u4")
    if len(v) and int(v.max()) >= 64 << 16:
        return b"\0" + pack_ints(v)
    first, low, high = np.empty(len(v), np.uint8), [], []
    for i in range(0, len(v), CHUNK):
        x = v[i : i + CHUNK]
        first[i : i + CHUNK] = np.where(x < 192, x, 192 + (x >> 16))
        more = x[x >= 192]
        low.append((more & 255).astype(np.uint8))
        high.append((more >> 8 & 255).astype(np.uint8))
    return b"\1" + zstandard.ZstdCompressor(5).compress(b"".join([np.uint32(len(v)).tobytes(), first, *low, *high]))


def unpack_places(data: bytes) -> np.ndarray:
    if data[0] == 0:
        return unpack_ints(data[1:])
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    n = int(raw[:4].view("<u4")[0])
    v = raw[4 : 4 + n].astype(np.uint32)
    big = v >= 192
    m = int(big.sum())
    v[big] = (v[big] - 192 << 16) + raw[4 + n : 4 + n + m] + (raw[4 + n + m :].astype(np.uint32) << 8)
    return v


def pack_words(words: list[bytes]) -> bytes:
    """Byte strings of any content: ended by zero bytes where none holds one, else count, lengths, bytes; compressed."""
    ended = b"\0".join(words) + b"\0" if words else b""
    if ended.count(b"\0") == len(words):
        return b"\1" + zstandard.ZstdCompressor(5).compress(ended)
    lens = np.fromiter(map(len, words), "<u4", len(words))
    return b"\0" + zstandard.ZstdCompressor(5).compress(np.uint32(len(words)).tobytes() + lens.tobytes() + b"".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data[1:])
    if data[0] == 1:
        return raw.split(b"\0")[:-1]
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n
    starts = np.concatenate([[4 + 4 * n], ends[:-1]]) if n else ends
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def pack_columns(*columns: np.ndarray) -> bytes:
    """Columns of as many unsigned integers each, byte planes apart, compressed."""
    out = [np.uint32(len(columns[0])).tobytes()]
    for c in columns:
        v = np.ascontiguousarray(c, "<u8")
        width = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
        out += [bytes([width]), np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()]
    return zstandard.ZstdCompressor(1).compress(b"".join(out))


def unpack_columns(data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n, at, out = int(raw[:4].view("<u4")[0]), 4, []
    while at < len(raw):
        width = int(raw[at])
        v = np.zeros((n, 8), np.uint8)
        v[:, :width] = raw[at + 1 : at + 1 + n * width].reshape(width, n).T
        out.append(v.view("<u8").ravel())
        at += 1 + n * width
    return out


def record_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
