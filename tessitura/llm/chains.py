"""Toxicity by classifier chains.

Categories are predicted one after another, each by a linear model (logistic regression) over word features and the
probabilities of the categories before it. While fitting, those probabilities come from models that haven't seen the
row: the sample is cut in folds, and each fold is predicted by a model of the others. The models of the chain are then
fitted on the whole sample, and each category's threshold is the one with the best F1 on the out-of-fold probabilities.

Features are known by their 32-bit checksum. Those of a text are its distinct words (letters of any script, case folded), their beginnings of 4 to 6 letters,
its runs of signs (their first three) and whether it has words in capitals;
of those in the sample the `features` with the largest chi-squared statistic against the category are used.

The models are fitted on at most `sample` labelled rows for each value of each category, chosen by the hash of the id, and on
no more of their documents than have `SAMPLE_BYTES` of features; the driver gets their checksums, four bytes a feature. The
tables at hand label two categories, low quality and toxicity; `fit` takes any number. Everything else, the scoring of all texts, is distributed.

Defined results: null and empty texts have no feature and so the base rate; a category without both values in the sample
has its rate as probability and rejects nothing; labels that are null take no part, ids with several label rows or
documents take part with each that differs; repeated rows keep a row each; an empty table gives an empty result; `score` ignores
other columns, `clean` keeps them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import words
from tessitura.llm.common import give_back, ship, staged, table

SAMPLE, FEATURES, FOLDS = 2_500, 1_024, 3
#: The sample's features that the driver takes at most.
SAMPLE_BYTES = 96 << 20
#: It comes to the driver in parts of about so many bytes, however many partitions the shuffle has.
PART_BYTES = 2 << 20
#: A feature speaks for or against a category from this chi-squared statistic on (odds of chance below 1 in 10,000).
STRONG = 15.1
_LETTERS = re.compile(r"[^\W\d_]+")


_SIGNS = re.compile(r"[^\w\s]+")


def atoms(word: str) -> set[str]:
    """Of what stands between two spaces: its words, its runs of signs and whether it is in capitals."""
    out = {w.lower() for w in _LETTERS.findall(word)}
    out.update("~" + x[:3] for x in _SIGNS.findall(word))
    if len(word) > 3 and word.isupper():
        out.add("^")
    return out


def expanded(atom: str) -> list[str]:
    """An atom, and the beginnings of a word."""
    return [atom, *(atom[:n] + "*" for n in (4, 5, 6) if len(atom) > n)] if atom[0] not in "~^" else [atom]


def code(feature: str) -> int:
    return zlib.crc32(feature.encode())


def features(word: str) -> set[int]:
    return {code(f) for a in atoms(word) for f in expanded(a)}


def codes(text: str) -> np.ndarray:
    """The features of a text, sorted."""
    return np.unique(np.array([f for w in {*text.split()} for f in features(w)], np.uint32))


@dataclass(frozen=True)
class Link:
    """One category's model: weights by feature, one for each earlier category, and the bias."""

    category: str
    weights: dict[int, float]
    earlier: tuple[float, ...]
    bias: float
    threshold: float


class _Matrix:
    """Binary features by row, and dense columns."""

    def __init__(self, row: np.ndarray, col: np.ndarray, width: int, dense: np.ndarray):
        self.n, self.width, self.dense, self.row, self.col = len(dense), width, dense, row, col

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n) + self.dense @ w[self.width :]

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.col, g[self.row], self.width), g @ self.dense])

    def part(self, keep: np.ndarray) -> "_Matrix":
        there = keep[self.row]
        return _Matrix((np.cumsum(keep) - 1)[self.row[there]], self.col[there], self.width, self.dense[keep])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _logistic(x: _Matrix, y: np.ndarray, ridge: float = 1.0, rounds: int = 150) -> np.ndarray:
    """Weights and bias; gradient steps scaled by their running size."""
    w, seen = np.zeros(x.width + x.dense.shape[1] + 1), 0.0
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    w[-1] = np.log(rate / (1 - rate))
    for i in range(rounds if len(y) else 0):
        err = _sigmoid(x.times(w[:-1]) + w[-1]) - y
        g = np.append(x.back(err) + ridge * w[:-1], err.sum()) / len(y)
        seen = 0.9 * seen + 0.1 * g * g
        w -= 0.3 / (1 + i / 50) * g / (np.sqrt(seen) + 1e-4) * 0.3
    return w


class _Sample:
    """All rows' features in a row, by their number among the distinct ones, and the row of each."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        flat = np.concatenate([np.zeros(0, np.uint32), *rows])
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
        self.names = np.unique(flat)
        self.code = np.empty(len(flat), np.int32)
        for i in range(0, len(flat), 1 << 18):  # places are 64-bit numbers: a part at a time
            self.code[i : i + (1 << 18)] = np.searchsorted(self.names, flat[i : i + (1 << 18)])

    def select(self, keep: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
        """The features that speak most for or against y in the rows to keep, sorted."""
        n, p, m = keep.sum(), y[keep].sum(), len(self.names)
        all_, pos = self.counts(keep, m), self.counts(keep & (y > 0), m).astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            chi = np.nan_to_num(n * (pos * (n - p) - (all_ - pos) * p) ** 2 / (p * (n - p) * all_ * (n - all_)))
        chi[(all_ < 3) | (all_ >= n)] = 0
        strong = np.flatnonzero(chi >= STRONG)
        return np.sort(self.names[strong[np.lexsort((self.names[strong], -chi[strong]))][:most]])

    def counts(self, keep: np.ndarray, m: int) -> np.ndarray:
        out = np.zeros(m, np.int64)
        for i in range(0, len(self.code), 1 << 18):
            out += np.bincount(self.code[i : i + (1 << 18)][keep[self.row[i : i + (1 << 18)]]], minlength=m)
        return out

    def matrix(self, names: np.ndarray, earlier: np.ndarray) -> _Matrix:
        number = np.full(len(self.names), -1, np.int32)
        number[np.searchsorted(self.names, names)] = np.arange(len(names))
        at = number[self.code]
        hit = at >= 0
        return _Matrix(self.row[hit], at[hit], len(names), earlier)


def fit(sample: list[tuple[np.ndarray, tuple[int, ...]]], categories: list[str], most: int = FEATURES, folds: int = FOLDS) -> list[Link]:
    """sample: the features of each text, sorted, and its category values."""
    rows = _Sample([c for c, _ in sample])
    fold = np.array([zlib.crc32(c.tobytes()) % folds for c, _ in sample], np.int64)
    everywhere = np.ones(len(sample), bool)
    earlier = np.zeros((len(sample), 0))
    chain = []
    for k, name in enumerate(categories):
        y = np.array([v[k] for _, v in sample], float)
        if not len(y) or y.min() == y.max():
            rate = np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6)
            chain.append(Link(name, {}, (0.0,) * k, float(np.log(rate / (1 - rate))), 2.0))
            earlier = np.column_stack([earlier, np.full(len(y), rate)])
            continue
        out_of_fold = np.zeros(len(y))
        for f in range(folds):
            train = fold != f
            if not train.any() or train.all():
                continue
            x = rows.matrix(rows.select(train, y, most), earlier)
            w = _logistic(x.part(train), y[train])
            out_of_fold[~train] = _sigmoid(x.times(w[:-1]) + w[-1])[~train]
        names = rows.select(everywhere, y, most)
        w = _logistic(rows.matrix(names, earlier), y)
        m = len(names)
        chain.append(Link(name, dict(zip(names.tolist(), w[:m].tolist())), tuple(w[m:-1].tolist()), float(w[-1]), _threshold(out_of_fold, y)))
        earlier = np.column_stack([earlier, out_of_fold])
    return chain


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Halfway between the probabilities around the cut with the best F1."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    i = int(np.argmax(f1))
    return float((p[order[i]] + (p[order[i + 1]] if i + 1 < len(y) else 0.0)) / 2)


def training_rows(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> list[tuple[np.ndarray, tuple[int, ...]]]:
    """The bounded sample: up to `sample` rows for each value of each category, and of the documents that have their ids, in
    the order of the ids' hashes, as many as have `SAMPLE_BYTES` of features together."""
    named = labels.select(F.col(id_col).alias("id"), *(c.cast("int").alias(f"y{i}") for i, c in enumerate(categories.values()))).dropna()
    picks = [named.where(f"y{i} = {v}").orderBy(F.xxhash64("id"), "id").limit(sample) for i in range(len(categories)) for v in (0, 1)]
    some = reduce(DataFrame.unionByName, picks).distinct()
    d = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(some), "id")
    ys = [f"y{i}" for i in range(len(categories))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.chunks(batches, "text"):
            distinct, index, offsets = words.split(b.column("text"))
            got, at = words.spread([tuple(features(w)) for w in distinct], index, offsets, np.uint32)
            rows = [np.unique(got[i:j]).tobytes() for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), b.column("place"), *(b.column(y) for y in ys)], ["features", "place", *ys])

    d = d.withColumn("place", F.xxhash64("id")).drop("id")
    made = d.mapInArrow(words.frugal(run), "features binary, place bigint, " + ", ".join(f"{y} int" for y in ys))
    made = staged(made.distinct(), "chain-sample").withColumn("tie", F.xxhash64("features"))
    # an id may have many documents: the least places first, as many as fit
    sizes = made.select("place", "tie", (F.length("features") + 64).alias("size")).orderBy("place", "tie").limit(4 * len(categories) * sample).collect()
    ends = np.cumsum([r.size for r in sizes])
    fits = int(np.searchsorted(ends, SAMPLE_BYTES, "right"))
    if not fits:
        return []
    last = sizes[fits - 1]
    few = made.where((F.col("place") < last.place) | (F.col("place") == last.place) & (F.col("tie") <= last.tie)).drop("place", "tie")
    rows = few.coalesce(1 + int(ends[fits - 1]) // PART_BYTES).toArrow()
    marks = list(zip(*(rows.column(y).to_pylist() for y in ys)))
    return [(np.frombuffer(c, np.uint32), v) for c, v in sorted(zip(rows.column("features").to_pylist(), marks))]


def score(docs: DataFrame, chain: list[Link], id_col: str | None = "doc_id", text: str = "text") -> DataFrame:
    """p_<category> and is_<category> for each row; with an id column that column first, else all of docs."""
    ship(docs.sparkSession)
    d = docs.select(id_col, text) if id_col else docs
    keep = [c for c in d.columns if c != text or not id_col]
    schema = ", ".join([*(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in keep), *(f"p_{x.category} double, is_{x.category} int" for x in chain)])
    names = [*keep, *(f"{p}_{x.category}" for x in chain for p in ("p", "is"))]
    # one list of (feature number, weight in each link) for every feature that some link uses
    all_ = sorted({f for x in chain for f in x.weights})
    number = {f: i for i, f in enumerate(all_)}
    weights = np.array([[x.weights.get(f, 0.0) for f in all_] for x in chain]).reshape(len(chain), len(all_))
    plain = [(x.earlier, x.bias, x.threshold) for x in chain]

    def numbered(word: str) -> bytes:
        own = sorted(number[f] for f in features(word) if f in number)
        return np.array(own, np.int32).tobytes() if own else b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = words.Cache(lambda ws: [numbered(w) for w in ws], limit=400_000)
        for b in words.chunks(batches, text):
            distinct, index, offsets = words.split(b.column(text))
            got, at = words.spread(cache.get(distinct), index, offsets)
            row = np.repeat(np.arange(b.num_rows), np.diff(at))
            pairs = np.unique(row * max(len(all_), 1) + got)
            row, got = pairs // max(len(all_), 1), pairs % max(len(all_), 1)
            cols, ps = [b.column(c) for c in keep], []
            for k, (earlier, bias, threshold) in enumerate(plain):
                z = np.bincount(row, weights[k][got], b.num_rows) if len(row) else np.zeros(b.num_rows)
                p = _sigmoid(z + bias + sum((w * q for w, q in zip(earlier, ps)), np.zeros(b.num_rows)))
                ps.append(p)
                cols += [pa.array(p), pa.array((p >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names)

    return d.mapInArrow(words.frugal(run), schema)


def chain_for(docs: DataFrame, labels: DataFrame) -> list[Link]:
    """Low quality first, then toxicity given the probability of low quality."""
    categories = {"junk": 1 - F.col("quality"), "toxic": F.col("toxic")}
    chain = fit(training_rows(docs, labels, categories), list(categories))
    give_back(docs.sparkSession)
    return chain


def clean(docs: DataFrame, chain: list[Link]) -> DataFrame:
    """docs without the toxic ones; all columns are kept."""
    scored = score(docs.withColumnsRenamed({c: f"__{c}" for c in docs.columns if c != "text"}), chain, None)
    return scored.where("is_toxic = 0").select(*(F.col(c if c == "text" else f"__{c}").alias(c) for c in docs.columns))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    s = score(docs, chain_for(docs, labels))
    return s.select("doc_id", F.round("p_junk", 6).alias("p_junk"), F.round("p_toxic", 6).alias("p_toxic"), F.col("is_toxic").alias("toxic"))
