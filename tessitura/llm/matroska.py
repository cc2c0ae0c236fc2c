"""Matroska media columns: muxing bytes as 8-bit PCM, and parsing files into packet tables.

`mux` stores a payload as packets of 576 samples in SimpleBlocks of up to eight, laced by fixed size, EBML and Xiph
sizes in turn, in clusters of up to 32 blocks, with a cue for each cluster. `demux` reads any file of this structure:
variable-length ids and sizes (also of unknown size, up to the next element that can't be a child), clusters, block
groups and simple blocks, the four kinds of lacing, and cues; it gives each packet's track, timestamp and byte range.

Defined results: a null text counts as empty; an empty payload is one packet of padding; equal texts give equal
files; repeated rows keep a row each; an empty table gives an empty result; other columns are ignored. A broken
file raises ValueError with the offset.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import words
from tessitura.llm.common import ship, staged, table

PACKET, LACE, BLOCKS, RATE = 576, 8, 32, 8000
MS = PACKET * 1000 // RATE
#: Element ids, as the format fixes them.
EBML, DOCTYPE, SEGMENT, INFO, SCALE, DURATION = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, ENTRY, NUMBER, UID, TYPE, CODEC, AUDIO, FREQUENCY, CHANNELS, DEPTH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE, GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, POINT, CUE_TIME, CUE_PLACES, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
PARENTS = {SEGMENT, INFO, TRACKS, ENTRY, AUDIO, CLUSTER, GROUP, CUES, POINT, CUE_PLACES}
TOP = {INFO, TRACKS, CLUSTER, CUES}


def vint(n: int, width: int = 0) -> bytes:
    """A size: one marker bit after width - 1 zero bits, then the number."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(name: int, body: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def _uint(name: int, n: int) -> bytes:
    return element(name, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


_HEAD = element(EBML, _uint(0x4286, 1) + _uint(0x42F7, 1) + _uint(0x42F2, 4) + _uint(0x42F3, 8) + element(DOCTYPE, b"matroska") + _uint(0x4287, 4) + _uint(0x4285, 2))
_TRACKS = element(TRACKS, element(ENTRY, _uint(NUMBER, 1) + _uint(UID, 1) + _uint(TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, element(FREQUENCY, struct.pack(">f", RATE)) + _uint(CHANNELS, 1) + _uint(DEPTH, 8))))
#: By number of packets in the block and kind of lacing (0 fixed, 1 EBML, 2 Xiph): flags and the sizes after them.
_LACING = {(n, k): bytes([0x80]) if n == 1 else (bytes([0x84, n - 1]) if k == 0 else bytes([0x86, n - 1]) + vint(PACKET) + b"\xbf" * (n - 2) if k == 1 else bytes([0x82, n - 1]) + bytes([255] * (PACKET // 255) + [PACKET % 255]) * (n - 1)) for n in range(1, LACE + 1) for k in range(3)}


def padded(data: bytes) -> bytes:
    return data + b"\xff" * ((-len(data) % PACKET) if data else PACKET)


def mux(payload: bytes) -> bytes:
    """payload: a positive multiple of the packet size."""
    per_block, per_cluster = PACKET * LACE, PACKET * LACE * BLOCKS
    info = element(INFO, _uint(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) // PACKET * MS)) + element(0x4D80, b"pcm") + element(0x5741, b"pcm"))
    parts, at, cues = [info, _TRACKS], len(info) + len(_TRACKS), []
    for c in range(0, len(payload), per_cluster):
        time, inside = c // PACKET * MS, []
        for k, a in enumerate(range(c, min(c + per_cluster, len(payload)), per_block)):
            data = payload[a : min(a + per_block, c + per_cluster)]
            inside.append(element(SIMPLE, b"\x81" + struct.pack(">h", k * LACE * MS) + _LACING[len(data) // PACKET, k % 3] + data))
        cluster = element(CLUSTER, _uint(TIMESTAMP, time) + b"".join(inside))
        cues.append(element(POINT, _uint(CUE_TIME, time) + element(CUE_PLACES, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(parts))


@dataclass
class File:
    """Packets are (track, timestamp in ms, start, end, cluster)."""

    packets: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    blocks: int = 0
    tracks: dict[int, dict] = field(default_factory=dict)
    duration: float = 0.0


def _id(data: bytes, at: int) -> tuple[int, int]:
    width = 9 - data[at].bit_length()
    if width > 4:
        raise ValueError(f"no element id at {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def _size(data: bytes, at: int) -> tuple[int | None, int]:
    """None: unknown."""
    width = 9 - data[at].bit_length()
    if width > 8:
        raise ValueError(f"no size at {at}")
    n = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def _laces(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """Sizes of the packets of a block and where the first begins."""
    if not kind:
        return [end - at], at
    n, at = data[at] + 1, at + 1
    if kind == 2:
        if (end - at) % n:
            raise ValueError(f"uneven fixed lacing at {at}")
        return [(end - at) // n] * n, at
    sizes = []
    for i in range(n - 1):
        if kind == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            width = 9 - data[at].bit_length()
            got, at = _size(data, at)
            got = (1 << 7 * width) - 1 if got is None else got
            size = got if not i else sizes[-1] + got - ((1 << 7 * width - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"laced sizes exceed the block before {end}")
    return sizes, at


def demux(data: bytes) -> File:
    out = File()
    try:
        name, at = _id(data, 0)
        if name != EBML:
            raise ValueError("no EBML header at 0")
        n, at = _size(data, at)
        at += n
        name, at = _id(data, at)
        if name != SEGMENT:
            raise ValueError(f"no segment at {at}")
        n, at = _size(data, at)
        _walk(data, at, len(data) if n is None else at + n, SEGMENT, out, {"segment": at, "time": 0, "scale": 1_000_000, "n": -1})
    except IndexError:
        raise ValueError("the file is cut short") from None
    return out


def _walk(data: bytes, at: int, end: int, parent: int, out: File, now: dict) -> int:
    if end > len(data):
        raise ValueError(f"element ends at {end} of {len(data)}")
    while at < end:
        begin = at
        name, at = _id(data, at)
        if parent == CLUSTER and name in TOP:  # a cluster of unknown size ends here
            return begin
        n, at = _size(data, at)
        stop = end if n is None else at + n
        if stop > end:
            raise ValueError(f"element at {begin} passes its parent's end")
        if name in PARENTS:
            if name == CLUSTER:
                out.clusters.append(begin - now["segment"])
                now["n"] += 1
            elif name == ENTRY:
                now["track"] = {}
            stop = _walk(data, at, stop, name, out, now)
            if name == ENTRY:
                out.tracks[now["track"].get("number", 0)] = now["track"]
            elif name == POINT:
                out.cues.append((now.get("cue_time", 0), now.get("cue_track", 0), now.get("cue_cluster", 0)))
        elif name in (SIMPLE, BLOCK):
            track, p = _size(data, at)
            rel, flags = struct.unpack_from(">hB", data, p)
            sizes, p = _laces(data, p + 3, stop, flags >> 1 & 3)
            step = out.tracks.get(track, {}).get("ms", 0)
            for i, size in enumerate(sizes):
                out.packets.append((track, now["time"] + rel + i * step, p, p + size, now["n"]))
                p += size
            out.blocks += 1
        else:
            body = data[at:stop]
            if name == TIMESTAMP:
                now["time"] = int.from_bytes(body, "big")
            elif name == DURATION:
                out.duration = struct.unpack(">d" if len(body) == 8 else ">f", body)[0]
            elif name == NUMBER:
                now["track"] |= {"number": int.from_bytes(body, "big"), "ms": MS}
            elif name == CODEC:
                now["track"]["codec"] = body.decode()
            elif name == DEPTH:
                now["track"]["depth"] = int.from_bytes(body, "big")
            elif name == CUE_TIME:
                now["cue_time"] = int.from_bytes(body, "big")
            elif name == CUE_TRACK:
                now["cue_track"] = int.from_bytes(body, "big")
            elif name == CUE_CLUSTER:
                now["cue_cluster"] = int.from_bytes(body, "big")
        at = stop
    return at


def store(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, media)."""
    ship(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.chunks(batches, "text"):
            data = [(x or "").encode() for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(x) for x in data], pa.int64()), pa.array([mux(padded(x)) for x in data], pa.binary())], ["id", "n_bytes", "media"])

    return d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, n_bytes bigint, media binary")


def packets(media: DataFrame) -> DataFrame:
    """The packet table of (id, media) rows."""
    kind = media.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data in zip(b.column("id"), b.column("media")):
                if rows := demux(data.as_py()).packets:
                    cols = [pa.array(c, pa.int64()) for c in zip(*rows)]
                    yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(rows), b.column("id").type), *cols], ["id", "track", "timestamp_ms", "start", "end", "cluster"])

    return media.select("id", "media").mapInArrow(run, f"id {kind}, track bigint, timestamp_ms bigint, start bigint, end bigint, cluster bigint")


def features(media: DataFrame) -> DataFrame:
    """(id, n_bytes, media) to digests and features of the payload as its packets give it."""
    kind = media.schema["id"].dataType.simpleString()
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def one(data: bytes) -> tuple:
        f = demux(data)
        payload = b"".join(data[a:b] for _, _, a, b, _ in f.packets)
        x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
        crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
        feature = f"packets={len(f.packets)};blocks={f.blocks};clusters={len(f.clusters)};cues={len(f.cues)};cues_hit={sum(c in f.clusters for _, _, c in f.cues) if len(f.clusters) < 64 else len({*f.clusters} & {c for _, _, c in f.cues})};ms={int(f.duration)};last_ms={f.packets[-1][1]};sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = list(zip(*(one(x.as_py()) for x in b.column("media")))) or [()] * 6
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), *(pa.array(c, t) for c, t in zip(made, types))], names)

    return media.select("id", "n_bytes", "media").mapInArrow(run, f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(staged(store(table(spark, sf_dir, "documents")), "media")).withColumnRenamed("id", "doc_id")
