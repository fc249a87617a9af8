"""WARC archives compressed with Zstandard and a shared dictionary.

An archive starts with a skippable frame that holds the dictionary; each record follows in a frame
of its own. Spark's text writer makes the files, so they reach any store Spark can write to. The
writer ends each row with a line feed; it falls into a one-byte skippable frame that closes each
row, so that the files stay valid Zstandard streams. Reading loads the dictionary from the leading
frame, decodes frame by frame and checks version, required headers, lengths and payload digests.

Records with equal payloads of ``revisit_from`` bytes or more are written once: the one with the
smallest id is a response, the others are revisits that refer to it. The digest of a group is found
by a partial aggregation; a frequent payload costs one small row for each task.

Null html is an empty payload. Null url: no target header. Null page_id: kept as null; among equal
payloads it is a revisit of the smallest id, and a response where no id is known. Rows that repeat
the smallest id with the same payload are all responses. Further columns are not read. Very long payloads are written
whole, in an archive that ends with them. An empty table gives no archives and no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, table

DICTIONARY_MAGIC, PADDING_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
_PADDING = struct.pack("<II", PADDING_MAGIC, 1)
_ID = "urn:page:"
#: Payloads from which the dictionary is trained, at most, and its size.
DICTIONARY_SAMPLES, DICTIONARY_BYTES, SAMPLE_BYTES = 256, 32 << 10, 16 << 10
#: Bytes from which an archive is closed and another begun; tasks that the copies of a payload are dealt over.
ARCHIVE_BYTES, SALTS = 128 << 20, 16
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


class BadRecord(ValueError):
    """An archive that breaks the format."""


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded number of payloads; the record's fixed text where they are too few."""
    rows = pages.where(F.octet_length("html") > 64).select(F.substring("html", 1, SAMPLE_BYTES).alias("h")).limit(DICTIONARY_SAMPLES).collect()
    samples = [_record(i, "http://host/", r.h.encode()[:SAMPLE_BYTES], "0" * 64, None, "1970-01-01T00:00:00Z") for i, r in enumerate(rows)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return _record(0, "http://host/", b"<!DOCTYPE html><html><head></head><body></body></html>", "0" * 64, None, "1970-01-01T00:00:00Z")


def _record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{'none' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_originals(pages: DataFrame, revisit_from: int = 100) -> DataFrame:
    """page_id, url, html, digest, refers_to: null for a response."""
    p = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2(F.encode("html", "utf-8"), 256)).withColumn("key", F.when(F.octet_length("html") >= revisit_from, F.col("digest")))
    groups = p.where("key is not null").groupBy("key").agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original"))
    # Copies of a frequent payload are dealt over SALTS tasks; short payloads, which refer to nothing, by their ids.
    p = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))).withColumn("key", F.coalesce("key", F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))))
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return p.join(groups, ["key", "salt"], "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, path: str, revisit_from: int = 100, date: str = "1970-01-01T00:00:00Z", level: int = 3, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Archives of (page_id, url, html) rows: each task begins another when one has ``archive_bytes``, so that a reader's task holds one of bounded size."""
    # The dictionary has DICTIONARY_BYTES at most, whatever the corpus.
    shared = pages.sparkSession.sparkContext.broadcast(train_dictionary(pages))

    def run(batches):
        data = shared.value
        made = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(data), write_checksum=True)
        first = struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data
        archive, nth, size = 0, 0, 0
        for batch in batches:
            frames, archives, places = [], [], []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page_id, url, html, digest, refers = row
                if size >= archive_bytes:
                    archive, size = archive + 1, 0
                frames.append((b"" if size else first) + made.compress(_record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers, date)) + _PADDING)
                archives.append(archive)
                places.append(nth)
                size, nth = size + len(frames[-1]), nth + 1
            if frames:
                yield pa.record_batch([pa.array(archives, pa.int32()), pa.array(places, pa.int64()), pa.array(frames, pa.binary())], names=["archive", "nth", "frame"])

    framed = with_originals(pages, revisit_from).mapInArrow(run, "archive int, nth long, frame binary").sortWithinPartitions("archive", "nth")
    framed.select("archive", F.col("frame").cast("string").alias("frame")).write.partitionBy("archive").option("lineSep", "\n").text(path)


def frames(data: memoryview) -> Iterator[tuple[int, int, int]]:
    """(magic, start of content, end) of each frame; a data frame's content starts with its magic."""
    at, n = 0, len(data)
    while at < n:
        if n - at < 8:
            raise BadRecord(f"{n - at} bytes behind the last frame")
        magic, size = struct.unpack_from("<II", data, at)
        if magic >> 4 == 0x184D2A5:
            yield magic, at + 8, at + 8 + size
            at += 8 + size
        elif magic == FRAME_MAGIC:
            start = at
            head = data[at : at + 18]
            at += zstandard.frame_header_size(head)
            last = False
            while not last:
                if at + 3 > n:
                    raise BadRecord("a frame is cut short")
                b = int.from_bytes(data[at : at + 3], "little")
                last, kind, size = bool(b & 1), b >> 1 & 3, b >> 3
                at += 3 + (1 if kind == 1 else size)
            at += 4 * zstandard.get_frame_parameters(head).has_checksum
            yield magic, start, at
        else:
            raise BadRecord(f"unknown magic {magic:#x} at {at}")
        if at > n:
            raise BadRecord("a frame is cut short")


def parse_record(raw: bytes) -> dict:
    """The record's fields; BadRecord where version, headers, lengths or digest are wrong."""
    cut = raw.find(b"\r\n\r\n")
    if cut < 0 or not raw.startswith(b"WARC/1."):
        raise BadRecord("no WARC head")
    head = {}
    for line in raw[:cut].decode().split("\r\n")[1:]:
        k, sep, v = line.partition(": ")
        if not sep:
            raise BadRecord(f"bad header line {line!r}")
        head[k.lower()] = v
    for k in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if k not in head:
            raise BadRecord(f"no {k}")
    size = int(head["content-length"])
    if len(raw) != cut + 4 + size + 4 or raw[-4:] != b"\r\n\r\n":
        raise BadRecord(f"Content-Length says {size}, the block has {len(raw) - cut - 8}")
    block = raw[cut + 4 : -4]
    split = block.find(b"\r\n\r\n")
    http = dict(x.partition(b": ")[::2] for x in block[:split].split(b"\r\n")[1:])
    length, payload, digest = int(http[b"Content-Length"]), block[split + 4 :], head["warc-payload-digest"].removeprefix("sha256:")
    kind = head["warc-type"]
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise BadRecord("the payload is not the one that was digested")
    if kind == "revisit" and (payload or "warc-refers-to" not in head or "warc-profile" not in head):
        raise BadRecord("a revisit needs a reference and no payload")
    number = lambda k: None if k not in head or (v := head[k].strip("<>").removeprefix(_ID)) == "none" else int(v)
    url = head.get("warc-target-uri")
    return {"page_id": number("warc-record-id"), "url": url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"), "record_type": kind, "refers_to": number("warc-refers-to"), "payload_bytes": length, "payload_digest": digest, "payload": payload if kind == "response" else None}


def parse_archive(data: bytes) -> Iterator[dict]:
    view, d = memoryview(data), None
    for magic, a, b in frames(view):
        if magic == DICTIONARY_MAGIC:
            if a != 8:
                raise BadRecord("the dictionary is not the leading frame")
            d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[a:b])))
        elif magic == FRAME_MAGIC:
            if d is None:
                raise BadRecord("no dictionary in the leading frame")
            yield parse_record(d.decompress(view[a:b]))


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives below ``path``."""
    schema = RECORD if payloads else RECORD.rpartition(",")[0]
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: len(names)]

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows: list[dict] = []
                for r in parse_archive(data.as_buffer().to_pybytes()):
                    rows.append(r)
                    if len(rows) == 500:
                        yield pa.record_batch([pa.array([x[n] for x in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array([x[n] for x in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, schema)


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back from the archives."""
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
o AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY html) END AS first_id FROM p)
SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM o
"""
