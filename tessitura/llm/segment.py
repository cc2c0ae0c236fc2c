"""SentencePiece encoding and decoding with N-best segmentation.

A normalised text is a lattice: nodes between characters, an edge for each piece with its score, and for a character
without a piece an edge with a score below all others, written in byte pieces (or the unknown piece). The forward
Viterbi pass gives the best score from the start to each node; going back from the end, A-star search uses those
scores as its estimate of the rest, which is exact, so it settles the N best paths in order and expands little else.

Scores are the model's own. Those of a unigram model are log probabilities, and the best path is its encoding. The
models at hand are BPE models, whose scores are merge ranks and whose own encoding is no best path but what merging in
the order of the ranks leaves: there the best path by the sum of ranks is another, longer segmentation of the same text
(README has the shares). Both decode to the same text.

Where two neighbouring characters stand side by side in no piece of the vocabulary, every path passes between them: the
lattice of a text is a chain of independent ones, cut there (before a word's space mark, after a line feed, before most
punctuation). Each distinct one is searched once; the N best segmentations of the text are those of the chain: only the
N - 1 links whose second-best path loses least can differ from their best one, and the combinations of their paths are
searched.

Defined results: null text counts as empty; an empty text has no ids, score 0 and no alternatives; ties between paths
go to the one found first, which is the same on each run; repeated rows keep a row each; an empty table gives an empty
result; other columns are ignored. Decoding gives the text back, but for space marks (U+2581) in it, which become spaces.
"""

from __future__ import annotations

import heapq
import json
import zlib
from array import array
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import words
from tessitura.llm.common import ship, table

MARK = "▁"
#: Characters below this, and the space mark in the last place, have their neighbours in a table.
_TABLE = 0x300
Path = tuple[float, tuple[int, ...]]


def _place(chars: np.ndarray) -> np.ndarray:
    """Where in the table a character is; out of it if it has none."""
    out = chars.astype(np.int64)
    out[out == _TABLE - 1] = _TABLE
    out[out == ord(MARK)] = _TABLE - 1
    return out


class Lattice:
    """The search over one vocabulary: piece -> (id, score)."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int] | None, unknown: int):
        self.pieces, self.byte_ids, self.unknown = pieces, byte_ids, unknown
        #: Every beginning of a piece; with the piece's ids and score where it is one itself.
        self.heads: dict[str, tuple] = {p[:i]: () for p in pieces for i in range(1, len(p))}
        self.heads |= {p: ((i,), s) for p, (i, s) in pieces.items()}
        self.low = min((s for _, s in pieces.values()), default=0.0) - 10.0
        pairs = {(ord(a) << 21) | ord(b) for p in pieces for a, b in zip(p, p[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.near = np.zeros((_TABLE, _TABLE), bool)
        a, b = _place(self.pairs >> 21), _place(self.pairs & 0x1FFFFF)
        known = (a < _TABLE) & (b < _TABLE)
        self.near[a[known], b[known]] = True

    def joined(self, chars: np.ndarray) -> np.ndarray:
        """For each neighbouring two of the characters whether some piece has them side by side."""
        place = _place(chars)
        a, b = place[:-1], place[1:]
        out = self.near[np.minimum(a, _TABLE - 1), np.minimum(b, _TABLE - 1)]
        rare = np.flatnonzero((a >= _TABLE) | (b >= _TABLE))
        out[rare] = np.isin(chars[rare].astype(np.int64) << 21 | chars[rare + 1], self.pairs)
        return out

    def without_piece(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in char.encode()) if self.byte_ids else (self.unknown,)

    def best(self, text: str, n: int) -> list[Path]:
        """The n best segmentations, best first."""
        size = len(text)
        if not size:
            return [(0.0, ())]
        score = [0.0] + [-np.inf] * size
        into: list[list[tuple[int, tuple[int, ...], float]]] = [[] for _ in range(size + 1)]
        get = self.heads.get
        for i in range(size):
            at, j = score[i], i + 1
            single = e = get(text[i])
            while e is not None:
                if e:
                    ids, s = e
                    into[j].append((i, ids, s))
                    if at + s > score[j]:
                        score[j] = at + s
                j += 1
                if j > size:
                    break
                e = get(text[i:j])
            if not single:
                into[i + 1].append((i, self.without_piece(text[i]), self.low))
                score[i + 1] = max(score[i + 1], at + self.low)
        out: list[Path] = []
        # of equal estimates the one nearest the start goes first, so ties don't widen the search
        heap: list = [(-score[size], size, 0, 0.0, None)]
        count = 1
        while heap and len(out) < n:
            _, node, _, done, tail = heapq.heappop(heap)
            if node == 0:
                ids: list[int] = []
                while tail:
                    ids += tail[0]
                    tail = tail[1]
                out.append((done, tuple(ids)))
                continue
            for i, own, s in into[node]:
                heapq.heappush(heap, (-(score[i] + done + s), i, count, done + s, (own, tail)))
                count += 1
        return out


_loaded: dict[str, tuple] = {}


def load(path: str) -> tuple:
    """The processor and the lattice of a model file."""
    if path not in _loaded:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        by_byte = {sp.id_to_piece(i): i for i in range(sp.vocab_size()) if sp.is_byte(i)}
        byte_ids = [by_byte[f"<0x{b:02X}>"] for b in range(256)] if len(by_byte) == 256 else None
        _loaded[path] = sp, Lattice({sp.id_to_piece(i): (i, sp.get_score(i)) for i in plain}, byte_ids, sp.unk_id())
    return _loaded[path]


def links(texts: list[str], lattice: Lattice) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Normalised texts as chains of independent lattices: distinct links, their index at each place, text offsets."""
    joined = "".join(texts)
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) for t in texts])
    if not len(chars):
        return [], np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    cut = ~lattice.joined(chars)
    cut[ends[(ends > 0) & (ends < len(chars))] - 1] = True  # a text begins a chain of its own
    at = np.flatnonzero(cut) + 1
    sep = next(c for c in range(0x10FFFF, 0, -1) if chr(c) not in joined)
    marked = np.insert(chars, at, sep).tobytes().decode("utf-32-le")
    distinct, index, _ = words.coded(pc.split_pattern(pa.array([marked], pa.large_string()), chr(sep)))
    offsets = np.searchsorted(np.concatenate([[0], at]), np.concatenate([[0], ends]))
    return distinct, index, offsets


def combined(base: float, open_: list[tuple[int, list[Path]]], n: int) -> list[tuple[float, dict[int, tuple[int, ...]]]]:
    """The n best of a chain whose best scores `base`, given the places that may differ from it with their paths: score
    and the ids at the places that do."""
    made = []
    for choice in product(*(range(len(p)) for _, p in open_)):
        made.append((base + sum(p[c][0] - p[0][0] for c, (_, p) in zip(choice, open_)), choice))
    made.sort(key=lambda x: (-x[0], x[1]))
    return [(s, {k: p[c][1] for c, (k, p) in zip(choice, open_) if c}) for s, choice in made[:n]]


_caches: dict[str, words.Cache] = {}


def _cache(model: str) -> words.Cache:
    """For each link the ids of its best path as bytes, the score, and what the second best loses."""
    if model not in _caches:
        lattice = load(model)[1]

        def one(text: str) -> tuple[bytes, float, float]:
            p = lattice.best(text, 2)
            return array("i", p[0][1]).tobytes(), p[0][0], p[0][0] - p[1][0] if len(p) > 1 else np.inf

        _caches[model] = words.Cache(lambda ws: [one(w) for w in ws], limit=300_000)
    return _caches[model]


def segmented(texts: list[str], model: str, n_best: int) -> tuple[np.ndarray, np.ndarray, list[float], list[list[dict]]]:
    """Ids of all texts in a row, where each text begins among them, its best score, and its next n_best - 1
    segmentations as edits of the best."""
    sp, lattice = load(model)
    distinct, index, offsets = links([n if t else "" for n, t in zip(sp.normalize(texts), texts)], lattice)
    found = _cache(model).get(distinct)
    ids, at = words.spread([f[0] for f in found], index, offsets)
    size = np.fromiter((len(f[0]) // 4 for f in found), np.int64, len(found))
    top = np.fromiter((f[1] for f in found), np.float64, len(found))
    loss = np.fromiter((f[2] for f in found), np.float64, len(found))[index]
    before = np.concatenate([[0], np.cumsum(size[index])])
    total = np.concatenate([[0.0], np.cumsum(top[index])])
    scores, others = [], []
    for i, j in zip(offsets[:-1], offsets[1:]):
        base, mine = float(total[j] - total[i]), loss[i:j]
        scores.append(base)
        keep = min(n_best - 1, len(mine))
        edge = np.partition(mine, keep - 1)[keep - 1] if keep else -np.inf
        near = np.flatnonzero(mine <= edge) if edge < np.inf else np.flatnonzero(mine < np.inf)
        near = near[np.argsort(mine[near], kind="stable")][:keep]
        places = [(int(k), lattice.best(distinct[index[i + k]], n_best)) for k in near]
        others.append([{"score": s, "edits": [{"at": int(before[i + k] - before[i]), "n": int(size[index[i + k]]), "ids": list(new)} for k, new in sorted(e.items())]} for s, e in combined(base, places, n_best)[1:]])
    return ids, at, scores, others


ALTERNATIVES = "array<struct<score:double,edits:array<struct<at:int,n:int,ids:array<int>>>>>"
_EDIT = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])
_ALTERNATIVE = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(_EDIT))]))


def encode(docs: DataFrame, model: str, n_best: int = 3, id_col: str = "doc_id", text: str = "text", back: bool = False, chunk: int = 1_000_000) -> DataFrame:
    """(id, ids, score, alternatives): the best segmentation, and the next n_best - 1 as edits of it (at token `at`, n
    tokens become ids). With `back` also `decoded`, what the ids give back, made in the same pass. A worker has about `chunk`
    bytes of text in work at once."""
    ship(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.chunks(batches, "text", chunk):
            ids, at, scores, others = segmented(b.column("text").to_pylist(), model, n_best)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
            out = [b.column("id"), lists, pa.array(scores, pa.float64()), pa.array(others, _ALTERNATIVE)]
            if back:
                sp, _ = load(model)
                out.append(pa.array([sp.decode(ids[i:j].tolist()) for i, j in zip(at[:-1], at[1:])], pa.string()))
            yield pa.RecordBatch.from_arrays(out, names)

    names = ["id", "ids", "score", "alternatives"] + ["decoded"] * back
    return d.mapInArrow(words.frugal(run), f"id {d.schema['id'].dataType.simpleString()}, ids array<int>, score double, alternatives {ALTERNATIVES}" + ", decoded string" * back)


def summary(docs: DataFrame, model: str, n_best: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_crc32, score, next_scores, edits, round_trip): what `encode` gives, digested where it is made,
    and whether decoding its ids gives the text back."""
    ship(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    names = ["id", "n_tokens", "ids_crc32", "score", "next_scores", "edits", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, _ = load(model)
        for b in words.chunks(batches, "text", 4_000_000):
            texts = b.column("text").to_pylist()
            ids, at, scores, others = segmented(texts, model, n_best)
            raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
            same = [sp.decode(ids[i:j].tolist()) == t.replace(MARK, " ") for i, j, t in zip(at[:-1], at[1:], texts)]
            yield pa.RecordBatch.from_arrays([
                b.column("id"), pa.array(np.diff(at)), pa.array([zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(at[:-1], at[1:])], pa.int64()), pa.array(scores, pa.float64()),
                pa.array([[a["score"] for a in o] for o in others], pa.list_(pa.float64())), pa.array([json.dumps([a["edits"] for a in o]) for o in others], pa.string()), pa.array(same, pa.bool_()),
            ], names)

    return d.mapInArrow(words.frugal(run), f"id {d.schema['id'].dataType.simpleString()}, n_tokens bigint, ids_crc32 bigint, score double, next_scores array<double>, edits string, round_trip boolean")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded (any columns, one of them ids) with `decoded`, the text of the ids."""
    ship(encoded.sparkSession)
    cols = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, _ = load(model)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([sp.decode(x or []) for x in part.column("ids").to_pylist()], pa.string())], [*cols, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{schema}, decoded string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_segment(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    return summary(table(spark, sf_dir, "documents"), model or default_model()).withColumnRenamed("id", "doc_id")
