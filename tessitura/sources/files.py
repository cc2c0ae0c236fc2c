"""Package trees, tag blocks, PCM and stream files as DataFrames, and their writers.

Files come through Spark's binaryFile source, so any file system it knows works; parsers run per file in Arrow
batches, and a broken file gives a row with its error, not a failed job. Writers hand bytes to Spark's sinks or, for single
files, to the Hadoop file system in the task that has them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.functions import media
from tessitura.functions.levels import cue_sample
from tessitura.operators import documents
from tessitura.operators.codec import FrameCoder, Reader, Tables, Writer

# The package suffix and the largest manifest; limits of tags and pictures; magic words of the formats;
# sample rates by their code; extensions of sound and pictures.
SUFFIX, MANIFEST_NAME, MANIFEST_BYTES = ".mpack", "manifest.json", 16 << 20
KEY_BYTES, VALUE_BYTES, TAGS, PICTURE_BYTES = 256, 1 << 20, 4096, 32 << 20
FLAC_MAGIC, APE_MAGIC, STREAM_MAGIC = b"fLaC", b"APETAGEX", b"MPCK"
RATES = (44100, 48000, 37800, 32000)
AUDIO = ("flac", "wav", "ogg", "mp3", "m4a")
#: Of a cue sheet's commands in a track.
CUE_KEYS = {"TITLE": "Title", "PERFORMER": "Artist", "SONGWRITER": "Songwriter", "ISRC": "ISRC"}
PICTURES = ("jpg", "jpeg", "png", "gif", "webp", "bmp")


def binaries(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """(package, json, manifest_sha256, m, problems, fingerprint): manifests of packages that aren't inside another package."""
    f = binaries(spark, path, MANIFEST_NAME).where(F.col("length") <= MANIFEST_BYTES)
    f = f.withColumn("package", F.regexp_replace("path", f"/{MANIFEST_NAME}$", "")).where(F.endswith("package", F.lit(SUFFIX)) & ~F.regexp_replace("package", "/[^/]*$", "").rlike(r"\.mpack(/|$)"))
    d = documents.parsed(f.select("package", F.decode("content", "UTF-8").alias("json"), F.sha2("content", 256).alias("manifest_sha256")))
    return d.withColumns({"problems": documents.problems(F.col("m")), "fingerprint": documents.fingerprint(F.col("m"))})


def package_files(spark: SparkSession, path: str) -> DataFrame:
    """(package, path, sha256, size) of every file in a package."""
    f = binaries(spark, path).select("length", "content", F.regexp_extract("path", r"^(.*?\.mpack)/(.*)$", 1).alias("package"), F.regexp_extract("path", r"^(.*?\.mpack)/(.*)$", 2).alias("file"))
    return f.where("package <> ''").select("package", F.col("file").alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def classified(files: DataFrame, path: str = "path") -> DataFrame:
    """`kind`, `disc` and guessed number and title of files in an import folder."""
    name, folder = F.substring_index(path, "/", -1), F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    ext = media.extension(F.col(path))
    kind = F.when(ext.isin(*AUDIO), "audio").when(ext.isin(*PICTURES), "artwork").when(ext == "lrc", "lyrics").when(ext == "pdf", "booklet").otherwise("extra")
    audio = kind == "audio"
    return files.withColumns({"kind": kind, "disc": F.when(audio, media.disc_of(folder)), "number": F.when(audio, media.name_number(name)), "title": F.when(audio, media.name_title(name))})


# ---- tags -------------------------------------------------------------------

def _tag(key: str, value: bytes, binary: bool = False) -> tuple[str, str | None, bytes | None, bool]:
    if not 1 <= len(key) <= KEY_BYTES or not all(" " <= c <= "~" for c in key) or (not binary and len(value) > VALUE_BYTES):
        raise ValueError(f"tag {key[:40]!r} is out of bounds")
    return (key, None, value, True) if binary else (key, value.split(b"\0")[0].decode(), None, False)


def vorbis_comment(data: bytes) -> list[tuple]:
    """Vendor, count, then 'KEY=value' entries, each with its length in four little-endian bytes."""
    def take(at: int) -> tuple[bytes, int]:
        n = int.from_bytes(data[at : at + 4], "little")
        if at + 4 + n > len(data):
            raise ValueError(f"comment at {at} passes the end")
        return data[at + 4 : at + 4 + n], at + 4 + n

    _, at = take(0)
    count, at = int.from_bytes(data[at : at + 4], "little"), at + 4
    if count > TAGS:
        raise ValueError("too many comments")
    out = []
    for _ in range(count):
        entry, at = take(at)
        key, eq, value = entry.partition(b"=")
        if eq:
            out.append(_tag(key.decode("ascii"), value))
    return out


def flac_blocks(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(type, body) of each metadata block."""
    if data[:4] != FLAC_MAGIC:
        raise ValueError("no FLAC file")
    at, last = 4, False
    while not last:
        if at + 4 > len(data):
            raise ValueError("metadata is cut short")
        last, kind, n = bool(data[at] & 128), data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        if at + 4 + n > len(data):
            raise ValueError(f"block at {at} passes the end")
        yield kind, data[at + 4 : at + 4 + n]
        at += 4 + n


def flac_tags(data: bytes) -> list[tuple]:
    return [t for kind, body in flac_blocks(data) if kind == 4 for t in vorbis_comment(body)]


def flac_stream(data: bytes) -> dict:
    body = next((b for k, b in flac_blocks(data) if k == 0), b"")
    if len(body) < 18:
        raise ValueError("no stream info")
    bits = int.from_bytes(body[10:18], "big")
    return {"rate": bits >> 44, "channels": (bits >> 41 & 7) + 1, "depth": (bits >> 36 & 31) + 1, "samples": bits & (1 << 36) - 1}


def flac_pictures(data: bytes) -> list[dict]:
    out = []
    for kind, b in flac_blocks(data):
        if kind == 6:
            at, parts = 4, []
            for _ in range(2):
                n = int.from_bytes(b[at : at + 4], "big")
                parts.append(b[at + 4 : at + 4 + n].decode())
                at += 4 + n
            n = int.from_bytes(b[at + 16 : at + 20], "big")
            if n > PICTURE_BYTES or at + 20 + n > len(b):
                raise ValueError("picture is out of bounds")
            out.append({"type": int.from_bytes(b[:4], "big"), "mime": parts[0], "description": parts[1], "data": b[at + 20 : at + 20 + n]})
    return out


def ape_tags(data: bytes) -> list[tuple]:
    """The tag at the end of a file; values joined by NUL are repeated keys."""
    foot = data[-32:]
    if foot[:8] != APE_MAGIC:
        return []
    size, count = struct.unpack("<II", foot[12:20])
    if size < 32 or size > len(data) or count > TAGS:
        raise ValueError("tag size is out of bounds")
    at, end, out = len(data) - size, len(data) - 32, []
    for _ in range(count):
        if at + 8 > end:
            raise ValueError("item is cut short")
        n, flags = struct.unpack_from("<II", data, at)
        stop = data.index(b"\0", at + 8, end)
        key, value = data[at + 8 : stop].decode("ascii"), data[stop + 1 : stop + 1 + n]
        if stop + 1 + n > end:
            raise ValueError("item passes the end")
        binary = flags >> 1 & 3 == 1
        out += [_tag(key, value, True)] if binary else [_tag(key, v) for v in value.split(b"\0")]
        at = stop + 1 + n
    return out


def with_ape_tags(data: bytes, tags: Iterable[tuple[str, str]]) -> bytes:
    """data with its tag replaced; repeated keys (any case) become one item under the first spelling."""
    if data[-32:-24] == APE_MAGIC:
        size, _, flags = struct.unpack("<III", data[-20:-8])
        data = data[: len(data) - size - (32 if flags >> 31 else 0)]
    items: dict[str, tuple[str, list[str]]] = {}
    for k, v in tags:
        items.setdefault(k.lower(), (k, []))[1].append(v)
    body = b""
    for k, vs in items.values():
        value = "\0".join(vs).encode()
        body += struct.pack("<II", len(value), 0) + k.encode("ascii") + b"\0" + value
    end = lambda flags: APE_MAGIC + struct.pack("<IIII", 2000, len(body) + 32, len(items), flags) + bytes(8)
    return data + end(0xA0000000) + body + end(0x80000000)


TAG_ROWS = "path string, pos int, key string, value string, binary binary, is_binary boolean, error string"


def tags(files: DataFrame) -> DataFrame:
    """Long tag rows of binary files (path, content); the format is told by the file's first bytes."""

    def one(data: bytes) -> list[tuple]:
        return flac_tags(data) if data[:4] == FLAC_MAGIC else ape_tags(data)

    return _per_file(files, TAG_ROWS, one, lambda path, i, t, error: (path, i, *(t or (None, None, None, None)), error))


def _per_file(files: DataFrame, schema: str, work: Callable[[bytes], Iterable], row: Callable) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, data in zip(b["path"], b["content"]):
                rows = []
                try:
                    for i, t in enumerate(work(bytes(data))):
                        rows.append(row(path, i, t, None))
                except (ValueError, IndexError, struct.error) as e:
                    rows.append(row(path, len(rows), None, str(e) or type(e).__name__))
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


# ---- PCM --------------------------------------------------------------------

def wav(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples (rows of channels, floats in -1..1) of integer 8, 16, 24, 32 and float 32 bit files."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no WAVE file")
    at, fmt = 12, None
    while at + 8 <= len(data):
        name, n = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = data[at + 8 : at + 8 + n]
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", body)
            if fmt[0] == 0xFFFE and len(body) >= 26:
                fmt = (int.from_bytes(body[24:26], "little"), *fmt[1:])
        elif name == b"data":
            if fmt is None:
                raise ValueError("samples before their format")
            kind, channels, rate, _, _, bits = fmt
            width = bits // 8 * channels
            body = body[: len(body) // width * width] if width else b""
            if (kind, bits) == (1, 8):
                x = (np.frombuffer(body, np.uint8).astype(np.float32) - 128) / 128
            elif (kind, bits) == (1, 16):
                x = np.frombuffer(body, "<i2").astype(np.float32) / 2**15
            elif (kind, bits) == (1, 24):
                b = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
                x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(np.float32) / 2**23
            elif (kind, bits) == (1, 32):
                x = (np.frombuffer(body, "<i4") / 2**31).astype(np.float32)
            elif (kind, bits) == (3, 32):
                x = np.frombuffer(body, "<f4")
            else:
                raise ValueError(f"samples of kind {kind} with {bits} bits")
            return rate, x.reshape(-1, channels)
        at += 8 + n + n % 2
    raise ValueError("no samples")


def to_wav(x: np.ndarray, rate: int, bits: int = 16) -> bytes:
    """Integer or (32 bit) float samples; integers are clipped."""
    x = np.atleast_2d(np.asarray(x, np.float64).T).T
    if bits == 32:
        kind, data = 3, x.astype("<f4").tobytes()
    else:
        top = 2 ** (bits - 1)
        q = np.clip(np.rint(x * top), -top, top - 1).astype(np.int64)
        kind = 1
        data = (q + 128).astype(np.uint8).tobytes() if bits == 8 else q.astype("<i2").tobytes() if bits == 16 else (q.reshape(-1, 1) >> np.array([0, 8, 16]) & 255).astype(np.uint8).tobytes()
    width = bits // 8 * x.shape[1]
    fmt = struct.pack("<HHIIHH", kind, x.shape[1], rate, rate * width, width, bits)
    return b"RIFF" + struct.pack("<I", 36 + len(data) + len(data) % 2) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def pcm_frames(files: DataFrame, size: int = 1152) -> DataFrame:
    """Frames of so many samples, left and right (mono twice), with their mid and side."""

    def work(data: bytes) -> Iterator[tuple]:
        rate, x = wav(data)
        l, r = x[:, 0].astype(float), x[:, -1].astype(float)
        for i in range(0, len(x), size):
            a, b = l[i : i + size], r[i : i + size]
            yield rate, a.tolist(), b.tolist(), ((a + b) / 2).tolist(), ((a - b) / 2).tolist()

    return _per_file(files, "path string, frame_no bigint, rate int, l array<double>, r array<double>, m array<double>, s array<double>, error string", work,
                     lambda path, i, t, error: (path, i, *(t or (None, None, None, None, None)), error))


def wav_files(frames: DataFrame, bits: int = 16, scale: float = 1.0) -> DataFrame:
    """(path, content): a WAV file of each path's frames (path, frame_no, rate, l, r) in order, scaled and clipped."""

    def run(names: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("frame_no", kind="stable")
        x = np.stack([np.concatenate([np.zeros(0), *p[c]]) for c in ("l", "r")], axis=1) * scale
        return pd.DataFrame({"path": [names[0]], "content": [to_wav(np.clip(x, -1, 1) if bits == 32 else x, int(p["rate"].iloc[0]), bits)]})

    return frames.select("path", "frame_no", "rate", "l", "r").groupBy("path").applyInPandas(run, "path string, content binary")


# ---- block streams -----------------------------------------------------------

def varint(data: bytes, at: int) -> tuple[int, int]:
    n = 0
    while True:
        b = data[at]
        n, at = n << 7 | b & 127, at + 1
        if b < 128:
            return n, at


def to_varint(n: int) -> bytes:
    out = [n & 127]
    while n := n >> 7:
        out.append(n & 127 | 128)
    return bytes(reversed(out))


def skip_id3(data: bytes) -> int:
    """Where the file begins after a leading ID3v2 tag."""
    if data[:3] != b"ID3":
        return 0
    size = 0
    for b in data[6:10]:
        if b > 127:
            raise ValueError("tag size isn't synchsafe")
        size = size << 7 | b
    return 10 + size + (10 if data[5] & 16 else 0)


def stream_blocks(data: bytes) -> Iterator[tuple[str, int, int, bytes]]:
    """(key, offset, size, payload) up to the end block; a size counts its key and itself."""
    at = skip_id3(data)
    if data[at : at + 4] != STREAM_MAGIC:
        raise ValueError("no block stream")
    at += 4
    while at < len(data):
        key = data[at : at + 2]
        if len(key) < 2 or not all(65 <= c <= 90 for c in key):
            raise ValueError(f"no block key at {at}")
        size, body = varint(data, at + 2)
        if size < body - at or at + size > len(data):
            raise ValueError(f"block at {at} passes the end")
        yield key.decode(), at, size, data[body : at + size]
        if key == b"SE":
            return
        at += size


def block(key: str, payload: bytes, with_crc: bool = False, least: int = 0) -> bytes:
    """A block; with a checksum before its payload, and zeros after it up to `least` bytes of checksum and payload."""
    checksum = zlib.crc32(payload).to_bytes(4, "big") if with_crc else b""
    payload = (checksum + payload).ljust(least, b"\0")
    for width in range(1, 10):  # the size counts its own bytes
        size = to_varint(2 + width + len(payload))
        if len(size) == width:
            return key.encode() + size + payload
    raise ValueError("block is too large")


def stream_header(payload: bytes) -> dict:
    """Of an SH block: its checksum must hold, rate, bands and channels must be possible."""
    if int.from_bytes(payload[:4], "big") != zlib.crc32(payload[4:]):
        raise ValueError("header checksum differs")
    samples, at = varint(payload, 5)
    silence, at = varint(payload, at)
    bits = int.from_bytes(payload[at : at + 2], "big")
    out = {"version": payload[4], "samples": samples, "silence": silence, "rate": RATES[bits >> 13] if bits >> 13 < 4 else 0, "bands": (bits >> 8 & 31) + 1, "channels": (bits >> 4 & 15) + 1, "mid_side": bool(bits >> 3 & 1), "block_power": 2 * (bits & 7)}
    if not out["rate"] or out["bands"] > 32 or out["channels"] > 2:
        raise ValueError("header is out of bounds")
    return out


def header_payload(samples: int, silence: int, rate: int, bands: int, channels: int, mid_side: bool, block_power: int, version: int = 8) -> bytes:
    bits = RATES.index(rate) << 13 | bands - 1 << 8 | channels - 1 << 4 | mid_side << 3 | block_power // 2
    return bytes([version]) + to_varint(samples) + to_varint(silence) + bits.to_bytes(2, "big")


def gains(payload: bytes) -> dict:
    """Of an RG block, in 1/256 dB; nothing where its version is unknown."""
    return dict(zip(("title_gain", "title_peak", "album_gain", "album_peak"), struct.unpack_from(">hHhH", payload, 1))) if payload[0] == 1 else {}


def gain_payload(title_gain: int = 0, title_peak: int = 0, album_gain: int = 0, album_peak: int = 0) -> bytes:
    return struct.pack(">BhHhH", 1, title_gain, title_peak, album_gain, album_peak)


def encoder_info(payload: bytes) -> dict:
    """Of an EI block: profile in eighths, whether noise is substituted, and the packed version."""
    return {"profile": (payload[0] >> 1) / 8, "noise": bool(payload[0] & 1), "version": int.from_bytes(payload[1:4], "big") << 8}


def encoder_payload(profile: float, noise: bool, major: int, minor: int, build: int) -> bytes:
    return bytes([int(profile * 8 + 0.5) << 1 | noise, major, minor, build])


def seek_payload(offsets: list[int], power: int) -> bytes:
    """An ST block: number of entries, power of two of frames between them, the first two offsets, then second differences
    with their sign in the low bit."""
    w = Writer()
    for b in to_varint(len(offsets)):
        w.put(b, 8)
    w.put(power, 4)
    for o in offsets[:2]:
        for b in to_varint(o):
            w.put(b, 8)
    for i in range(2, len(offsets)):
        d = offsets[i] - 2 * offsets[i - 1] + offsets[i - 2]
        w.golomb(-2 * d + 1 if d < 0 else 2 * d, 12)
    return w.data()


def seek_offsets(payload: bytes, most: int = 65536) -> tuple[list[int], int]:
    """Offsets and power of an ST block. A table of more than `most` entries is thinned by powers of two."""
    r = Reader(payload)

    def number() -> int:
        n = 0
        while (b := r.get(8)) > 127:
            n = n << 7 | b & 127
        return n << 7 | b

    size, power = number(), r.get(4)
    out = [number() for _ in range(min(size, 2))]
    while len(out) < size:
        code = r.golomb(12)
        out.append((-(code >> 1) if code & 1 else code >> 1) + 2 * out[-1] - out[-2])
    thin = 0
    while size > most << thin:
        thin += 1
    return out[:: 1 << thin], power + thin


# Samples of a frame, and what the older stream's last frame lacks where it isn't exact.
FRAME_SAMPLES, SYNTH_DELAY, OLD_MAGIC = 1152, 481, b"MP+"


def old_header(data: bytes) -> dict:
    """Of a stream before version 8: one header of 32-bit words, each with its bytes reversed. Gains are converted to steps of
    1/256 dB."""
    at = skip_id3(data)
    if data[at : at + 3] != OLD_MAGIC or data[at + 3] & 15 != 7:
        raise ValueError("no stream of version 7")
    words = data[at + 4 : at + 28]
    if len(words) < 24:
        raise ValueError("header ends early")
    r = Reader(b"".join(words[i : i + 4][::-1] for i in range(0, 24, 4)))
    frames = r.get(32)
    r.get(1)
    out = {"version": 7, "mid_side": bool(r.get(1)), "bands": r.get(6), "profile": r.get(4)}
    r.get(2)
    out["rate"] = RATES[r.get(2)]
    r.get(16)
    raw = {k: r.get(16) for k in ("title_gain", "title_peak", "album_gain", "album_peak")}
    for k, v in raw.items():
        if v and k.endswith("gain"):
            v = int((64.82 - (v - 65536 if v > 32767 else v) / 100) * 256 + 0.5)
            v = v if 0 <= v < 1 << 16 else 0
        elif v:
            v = int(np.log10(v) * 20 * 256 + 0.5)
        out[k] = v
    exact, last = r.get(1), r.get(11)
    out["exact"], out["fast_seek"] = bool(exact), bool(r.get(1))
    r.get(19)
    out["encoder"] = r.get(8)
    if last > FRAME_SAMPLES:
        raise ValueError("last frame is too long")
    out["samples"] = frames * FRAME_SAMPLES - (FRAME_SAMPLES - (last or FRAME_SAMPLES) if exact else SYNTH_DELAY)
    out["channels"], out["block_power"] = 2, 0
    if not 0 < out["bands"] < 32:
        raise ValueError("header is out of bounds")
    return out


def old_header_data(frames: int, bands: int, profile: int, rate: int, last: int, encoder: int, mid_side: bool = True, gains: tuple[int, int, int, int] = (0, 0, 0, 0)) -> bytes:
    """The same header, exact to the sample."""
    w = Writer()
    for v, n in ((frames, 32), (0, 1), (mid_side, 1), (bands, 6), (profile, 4), (0, 2), (RATES.index(rate), 2), (0, 16), *((g, 16) for g in gains), (1, 1), (last, 11), (0, 1), (0, 19), (encoder, 8), (0, 24)):
        w.put(int(v), n)
    words = w.data()
    return OLD_MAGIC + bytes([7]) + b"".join(words[i : i + 4][::-1] for i in range(0, len(words), 4))


HEADERS = "path string, version int, samples bigint, silence bigint, rate int, bands int, channels int, mid_side boolean, block_power int, profile double, encoder int, title_gain int, title_peak int, album_gain int, album_peak int, bitrate double, blocks int, error string"


def stream_headers(files: DataFrame) -> DataFrame:
    """One row for each stream file of either version: its header, gains, encoder and average bit rate, its number of sound
    blocks, and `error` where a block or the header is broken, or sound comes before the header."""
    names = [x.split()[0] for x in HEADERS.split(", ")][1:-1]

    def work(data: bytes) -> Iterator[dict]:
        at = skip_id3(data)
        if data[at : at + 3] == OLD_MAGIC:
            out = old_header(data) | {"silence": 0, "blocks": 0}
        else:
            out = {"blocks": 0}
            for key, _, _, payload in stream_blocks(data):
                if key == "SH":
                    out |= stream_header(payload)
                elif key == "RG":
                    out |= gains(payload)
                elif key == "EI":
                    info = encoder_info(payload)
                    out |= {"profile": info["profile"], "encoder": info["version"]}
                elif key == "AP":
                    if "samples" not in out:
                        raise ValueError("sound before the header")
                    out["blocks"] += 1
            if "samples" not in out:
                raise ValueError("no header")
        played = out["samples"] - out["silence"]
        out["bitrate"] = (len(data) - at) * 8.0 * out["rate"] / played if played > 0 else 0.0
        yield out

    return _per_file(files, HEADERS, work, lambda path, i, t, error: (path, *((t or {}).get(n) for n in names), error))


def blocks(files: DataFrame) -> DataFrame:
    return _per_file(files, "path string, ordinal int, key string, offset bigint, size bigint, payload binary, error string", stream_blocks,
                     lambda path, i, t, error: (path, i, *(t or (None, None, None, None)), error))


def stream_checks(files: DataFrame, tables: Tables | None = None) -> DataFrame:
    """(path, frames, blocks, error): whole streams of version 8 decoded down to their samples, without making sound of them.
    The header's number of samples tells how many frames there must be."""
    tables = tables or Tables()

    def work(data: bytes) -> Iterator[tuple]:
        header, frames, n = None, 0, 0
        for key, _, _, payload in stream_blocks(data):
            if key == "SH":
                header = stream_header(payload)
                total = -(-header["samples"] // FRAME_SAMPLES)
            elif key == "AP":
                if header is None:
                    raise ValueError("sound before the header")
                here = min(1 << header["block_power"], total - frames)
                r, coder = Reader(payload), FrameCoder(header["bands"] - 1, header["mid_side"], tables)
                for _ in range(here):
                    coder.read(r)
                if here <= 0 or len(r.bits) - r.at >= 8:
                    raise ValueError(f"block {n} has bits left over")
                frames, n = frames + here, n + 1
        if header is None or frames != total:
            raise ValueError("the stream ends early")
        yield frames, n

    return _per_file(files, "path string, frames bigint, blocks bigint, error string", work, lambda path, i, t, error: (path, *(t or (None, None)), error))


def cut_stream(data: bytes, first: int, last: int) -> bytes:
    """Samples first to last (exclusive; 0: the end) of a stream of version 8, cut at whole blocks: the header tells how many
    samples of the first block are silence and how many there are in all. Gains are dropped, the encoder is kept."""
    parts = list(stream_blocks(data))
    h = stream_header(next(p for k, *_, p in parts if k == "SH"))
    last, first = (last + h["silence"]) if last else h["samples"], first + h["silence"]
    if not 0 <= first < last <= h["samples"]:
        raise ValueError("samples out of the stream")
    size = FRAME_SAMPLES << h["block_power"]
    start = first // size
    sound = [(k, p) for k, *_, p in parts if k == "AP"][start : -(-last // size)]
    head = header_payload(last - start * size, first % size, h["rate"], h["bands"], h["channels"], h["mid_side"], h["block_power"])
    out = STREAM_MAGIC + block("SH", head, True) + block("RG", gain_payload()) + b"".join(block(k, p) for k, *_, p in parts if k == "EI")
    offsets = []
    for k, p in sound:
        offsets.append(len(out))
        out += block(k, p)
    return out + block("ST", seek_payload(offsets, 0)) + block("SE", b"")


def tagged(files: DataFrame, tags_: DataFrame) -> DataFrame:
    """(path, content, sha256): files (path, content) with the APE tag of their rows in tags_ (path, pos, key, value)."""
    t = tags_.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "value"))).alias("tags"))

    @F.pandas_udf("binary")
    def run(content: pd.Series, rows: pd.Series) -> pd.Series:
        return pd.Series([with_ape_tags(bytes(c), [(x["key"], x["value"]) for x in r]) for c, r in zip(content, rows)])

    d = files.join(t, "path").select("path", run("content", "tags").alias("content"))
    return d.withColumn("sha256", F.sha2("content", 256))


def write_files(files: DataFrame, path: str = "path", content: str = "content") -> None:
    """Each row's bytes to its path, by the task that has them and through Arrow's file systems. A file is written beside its
    place and moved there, so a task that runs again leaves whole files."""
    out = files.select(F.col(path).alias("path"), F.col(content).alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                system, at = fs.FileSystem.from_uri(p if "://" in p else "file://" + p.removeprefix("file:"))
                system.create_dir(at.rsplit("/", 1)[0], recursive=True)
                part = f"{at}.part{zlib.crc32(bytes(c))}"
                with system.open_output_stream(part) as f:
                    f.write(bytes(c))
                system.move(part, at)
            yield pd.DataFrame({"n": [len(b)]})

    out.mapInPandas(run, "n bigint").agg(F.sum("n")).collect()


# ---- chapters ----------------------------------------------------------------

def ini_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of text files, lines numbered from 1."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", r"\r?\n").alias("lines"))
    return t.select("file", F.posexplode("lines").alias("at", "text")).select("file", (F.col("at") + 1).alias("line"), "text")


def ini_entries(lines: DataFrame) -> DataFrame:
    """(file, section, key, value): sections hold for the lines after them; keys without regard to case, comments go."""
    t = F.trim(F.regexp_replace("text", r"^\s*[#;].*$|\s[;#].*$", ""))
    d = lines.withColumn("t", t).withColumn("head", F.nullif(F.regexp_extract("t", r"^\[(.*)\]$", 1), F.lit("")))
    d = d.withColumn("section", F.last("head", ignorenulls=True).over(W.partitionBy("file").orderBy("line")))
    d = d.where("head is null and t like '%=%'")
    return d.select("file", "line", F.lower("section").alias("section"), F.lower(F.trim(F.substring_index("t", "=", 1))).alias("key"), F.regexp_replace(F.trim(F.regexp_extract("t", r"^[^=]*=(.*)$", 1)), r'^"(.*)"$|^\'(.*)\'$', "$1$2").alias("value"))


def chapters(entries: DataFrame) -> DataFrame:
    """Sections named by their first sample, in order, with their tags."""
    d = entries.where(F.col("section").rlike("^[0-9]+$"))
    return d.groupBy("file", F.col("section").cast("long").alias("sample")).agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("tags"))


def cue_entries(lines: DataFrame, rate: int) -> DataFrame:
    """(file, track, sample, tags) of cue sheets: a track's place in minutes, seconds and 75ths, its number of the sheet's
    tracks, and the values of its commands."""
    t = F.trim("text")
    word = F.upper(F.regexp_extract(t, r"^(\S+)", 1))
    d = lines.withColumns({"word": word, "rest": F.trim(F.regexp_replace(t, r"^\S+", ""))})
    number = F.when(F.col("word") == "TRACK", F.regexp_extract("rest", r"^([0-9]+)", 1).try_cast("int"))
    d = d.withColumn("track", F.last(number, ignorenulls=True).over(W.partitionBy("file").orderBy("line"))).where("track is not null")
    time = lambda i: F.regexp_extract("rest", r"^01\s+([0-9]+):([0-9]{2}):([0-9]{2})$", i).try_cast("long")
    frame = F.when(F.col("word") == "INDEX", (time(1) * 60 + time(2)) * 75 + time(3))
    value = F.regexp_replace("rest", '^"(.*)"$', "$1")
    pair = F.when(F.col("word").isin(*CUE_KEYS), F.struct(F.element_at(F.create_map(*(F.lit(x) for kv in CUE_KEYS.items() for x in kv)), F.col("word")).alias("key"), value.alias("value")))
    g = d.groupBy("file", "track").agg(F.max(frame).alias("frame"), F.array_sort(F.collect_list(pair)).alias("tags"))
    n = F.count("*").over(W.partitionBy("file"))
    place = F.row_number().over(W.partitionBy("file").orderBy("track"))
    g = g.withColumn("tags", F.concat(F.array(F.struct(F.lit("Track").alias("key"), F.concat_ws("/", place, n).alias("value"))), "tags"))
    return g.select("file", "track", cue_sample(F.col("frame"), F.lit(rate)).alias("sample"), "tags")


def chapter_lines(rows: DataFrame) -> DataFrame:
    """The text of chapters, one line a row in order, for a text sink."""
    line = F.concat(F.array(F.concat(F.lit("["), "sample", F.lit("]"))), F.transform("tags", lambda t: F.concat_ws("=", t["key"], t["value"])))
    return rows.select("file", "sample", F.posexplode(line).alias("n", "value")).orderBy("file", "sample", "n").select("value")


def byte_column(c: Column, at: int, n: int) -> Column:
    """Big-endian number of n bytes at an offset, as an expression: fixed fields need no parser."""
    return F.conv(F.hex(F.substring(c, at + 1, n)), 16, 10).cast("long")


def flac_rate(content: Column) -> Column:
    """Sample rate of a FLAC file whose first block is the stream info."""
    return F.when(F.hex(F.substring(content, 1, 4)) == "664C6143", F.shiftright(byte_column(content, 18, 3), 4))
