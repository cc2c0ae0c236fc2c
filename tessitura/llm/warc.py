"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

An archive is written with Spark's text sink, whose rows are raw bytes here and whose line separator is an empty
skippable frame, which every Zstandard reader passes over; so archives go to any file system that Spark writes to. (A cast
from binary to string keeps the bytes: Spark's strings are not validated when they are made, and the sink writes them as
they are. The tests compare whole archives byte by byte through their digests.) An archive holds the pages of one partition, that
is at most spark.sql.files.maxPartitionBytes of input before compression; only a larger single page makes a larger one.
It is read as a binary file: the dictionary comes from the leading skippable frame, each further frame is found by its
block headers and decoded alone, and the record in it is validated: version, mandatory fields, the declared length against the
block, the closing blank lines, and the payload's digest.

Records with equal payloads of `revisit_bytes` or more: that with the smallest id is the response, the others are
revisits of it without a payload. Defined results: a null payload counts as empty; rows that repeat both id and payload are
the same record and share its type; a null id is never the smallest, unless all are null, then all are responses; a null
url has no target field; an empty table has no archive and gives an empty result; other columns are not archived.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm.common import scratch_dir, ship, spread_join, staged, table

DICTIONARY_MAGIC = bytes.fromhex("5d2a4d18")
FRAME_MAGIC = bytes.fromhex("28b52ffd")
#: An empty skippable frame, as text because it is the sink's line separator.
SEPARATOR = "P*M\x18\0\0\0\0"
VERSION = "WARC/1.1"
URN = "urn:page:"
DATE = "1970-01-01T00:00:00Z"
#: Bounds of the dictionary's training sample and size.
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 256, 16_384, 32_768
#: Up to so many revisits their list is broadcast (about 64 bytes each).
BROADCAST_ROWS = 500_000
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


def dictionary(pages: DataFrame, id_col: str = "page_id", payload: str = "html") -> bytes:
    """Trained on a bounded sample of pages, chosen by the hash of their ids: a share of them that makes about the sample's
    size, so tasks send no more than that to the driver however many they are."""
    share = min(1.0, SAMPLE_PAGES / max(pages.count(), 1))
    chosen = F.pmod(F.xxhash64(id_col), F.lit(1 << 40)) <= int(share * (1 << 40))
    some = pages.where(chosen & (F.length(payload) > 0)).select(F.substring(payload, 1, SAMPLE_CHARS)).limit(2 * SAMPLE_PAGES).collect()
    samples = sorted(r[0].encode() for r in some)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their text itself serves
        return b"".join(samples)[:DICTIONARY_BYTES]


def revisits(pages: DataFrame, id_col: str = "page_id", payload: str = "html", revisit_bytes: int = 100) -> DataFrame:
    """(id, digest, first): the rows that revisit the record `first`."""
    p = staged(pages.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(payload), F.lit("")), 256).alias("digest"))
               .where(F.octet_length(F.coalesce(F.col(payload), F.lit(""))) >= revisit_bytes), "warc-digests")
    first = staged(p.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null"), "warc-first")
    return spread_join(p, first, "digest", p.count()).where(~F.col("id").eqNullSafe(F.col("first"))).select("id", "digest", "first").distinct()


def _record(kind: str, name, url: str | None, digest: str, size: int, first, payload: bytes) -> bytes:
    fields = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{URN}{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        fields.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~-._"))
    fields += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        fields += [f"WARC-Refers-To: <{URN}{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    fields += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return f"{VERSION}\r\n".encode() + "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", payload: str = "html", revisit_bytes: int = 100) -> None:
    """One archive for each partition of pages."""
    spark = ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    shared = dictionary(pages, id_col, payload)
    known = staged(revisits(pages, id_col, payload, revisit_bytes), "warc-revisits")
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    rows = rows.join(known.select(F.col("id").alias("id2"), F.col("digest").alias("digest2"), "first"), F.col("id").eqNullSafe(F.col("id2")) & (F.col("digest") == F.col("digest2")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zdict = zstandard.ZstdCompressionDict(shared) if shared else None
        zip_ = zstandard.ZstdCompressor(level=3, dict_data=zdict, write_checksum=True)
        out = [DICTIONARY_MAGIC + len(shared).to_bytes(4, "little") + shared]
        size = 0
        begun = False
        for b in batches:
            for name, at, text, digest, first in zip(*(b.column(c).to_pylist() for c in ("id", "url", "payload", "digest", "first"))):
                data = text.encode()
                kind = "response" if first is None else "revisit"
                frame = zip_.compress(_record(kind, "" if name is None else name, at, digest, len(data), first, data if first is None else b""))
                out.append(frame)
                size += len(frame)
                begun = True
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
                    out, size = [], 0
        if begun and out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    frames = rows.select("id", "url", "payload", "digest", "first").mapInArrow(run, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def frames(data: memoryview) -> Iterator[tuple[int, int, bool]]:
    """(start, end, skippable) of each frame, from the magic numbers and block headers."""
    at = 0
    while at < len(data):
        magic = bytes(data[at : at + 4])
        if magic[1:] == DICTIONARY_MAGIC[1:] and magic[0] >> 4 == 5:
            end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            skippable = True
        elif magic == FRAME_MAGIC:
            info = data[at + 4]
            single, has_sum, dict_flag, size_flag = info >> 5 & 1, info >> 2 & 1, info & 3, info >> 6
            end = at + 5 + (not single) + (0, 1, 2, 4)[dict_flag] + ((1 if single else 0), 2, 4, 8)[size_flag]
            last = False
            while not last:
                if end + 3 > len(data):
                    raise ValueError(f"frame at {at} is cut short")
                head = int.from_bytes(data[end : end + 3], "little")
                last = bool(head & 1)
                end += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
            end += 4 * has_sum
            skippable = False
        else:
            raise ValueError(f"no frame at {at}")
        if end > len(data):
            raise ValueError(f"frame at {at} is cut short")
        yield at, end, skippable
        at = end


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload of a record; ValueError says what is wrong with it."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or lines[0] != VERSION:
        raise ValueError(f"not a {VERSION} record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    for name in MANDATORY:
        if name not in fields:
            raise ValueError(f"{name} is missing")
    n = int(fields["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes, Content-Length {n}")
    payload = rest[:n].partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response":
        if str(len(payload)) != fields["X-Payload-Length"]:
            raise ValueError(f"payload of {len(payload)} bytes, {fields['X-Payload-Length']} declared")
        if "sha256:" + hashlib.sha256(payload).hexdigest() != fields["WARC-Payload-Digest"]:
            raise ValueError("payload digest differs")
    return fields, payload


def records(data: bytes) -> Iterator[tuple[dict[str, str] | None, bytes, str | None]]:
    """(fields, payload, error) of each record of an archive."""
    view = memoryview(data)
    unzip = zstandard.ZstdDecompressor()
    try:
        for i, (a, b, skippable) in enumerate(frames(view)):
            if skippable:
                if i == 0 and bytes(view[a : a + 4]) == DICTIONARY_MAGIC and b - a > 8:
                    unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[a + 8 : b])))
                continue
            try:
                fields, payload = parse(unzip.decompress(view[a:b]))
                yield fields, payload, None
            except (ValueError, zstandard.ZstdError) as e:
                yield None, b"", str(e)
    except ValueError as e:  # what follows can't be found
        yield None, b"", str(e)


SCHEMA = "archive string, record_type string, record_id string, refers_to string, target_uri string, payload_bytes bigint, payload_digest string, payload binary, error string"


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each record of the archives in path; a broken one has its error."""
    fields = [x.split() for x in SCHEMA.split(", ")]
    names = [n for n, _ in fields]
    types = [{"bigint": pa.int64(), "binary": pa.binary()}.get(t, pa.string()) for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bare(x: str | None) -> str | None:
            return x[1 + len(URN) : -1] if x else x

        for b in batches:
            for at, content in zip(b.column("path").to_pylist(), b.column("content")):
                rows, size = [], 0
                for f, payload, error in records(content.as_py()):
                    f = f or {}
                    n = f.get("X-Payload-Length")
                    rows.append((at, f.get("WARC-Type"), bare(f.get("WARC-Record-ID")), bare(f.get("WARC-Refers-To")), f.get("WARC-Target-URI"), n and int(n), f.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None, payload if payloads else None, error))
                    size += len(payload) if payloads else 200
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    files = ship(spark).read.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), path)
    back = read(spark, path, payloads=False)
    page = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("record_id"))
    return back.select(page.try_cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").try_cast("long").alias("refers_to"))


OP4_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
q as (select page_id, strlen(html) as payload_bytes, sha256(html) as payload_digest from p),
r as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as first from q)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
  case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
  case when first is not null and page_id is distinct from first then first end as refers_to
from r
"""
