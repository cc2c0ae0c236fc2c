"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

Codes: on a bounded sample the vectors are centred and a rotation is learned by iterative quantisation, alternating the
signs of the rotated sample with the orthogonal Procrustes solution; several rotations from different starts, learned
alike, give `bits` bits. Index: a code is split into substrings of 16 bits, each with a table from value to rows, for
every row, in blocks of bounded size. Search: a code within Hamming radius r of the query has by the pigeonhole principle
a substring within r // m of the query's, m substrings; all values within that distance are probed, the rows found
are checked on the whole code, and those within r are ranked by exact distance. The radius is the one that holds all but
`miss` of the true neighbours of about `SAMPLE_QUERIES` rows of the sample, found by brute force among all rows. Queries with fewer than k rows found in the radius are searched again with
a larger one, until k are found or all rows are.

Equal vectors are one entry; of its ids, the k + 1 least are kept, as no other can be among the k nearest.

Two plans look the same thing up. Where the sample says that probing reaches at most `SPARSE` of the rows, the index is one
table of (substring number and value, code, entry) and the probed values of all queries join it by key; a pair that
several substrings find counts at the first, so nothing is made distinct; values that very many rows share are salted. Queries
that find fewer than k neighbours so go on in the other plan. There, queries meet blocks of the index in blocks, and no task
sees all queries or all rows; it costs queries times rows, and is for data in which the neighbours are so far that no
plan can avoid most rows: for vectors without structure the radius is about 0.4 of the bits, and a substring of a random
code lies within 0.4 of its own 16 bits with a probability of 0.1 to 0.2, in one of 16 substrings nearly always.

Defined results: null vectors, zero vectors, and those with null or non-finite components or another length than the most
common one take no part; ties go to the smaller id; rows that repeat an id and its vector are one; with fewer than k
other rows all are given; without rows the result is empty; other columns are ignored. A null id takes no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.llm.common import ship, staged, table

#: Bounds of the training sample, and rows of an index and a query block.
SAMPLE, SAMPLE_QUERIES, INDEX_BLOCK, QUERY_BLOCK = 8_000, 200, 16_384, 2_048
PART = 16
#: The plan by key is taken where probing reaches at most this share of rows with at most so many values a query.
SPARSE, PROBES = 0.1, 20_000
#: A substring value of more than one row in HOT is dealt to SALTS places.
HOT, SALTS = 1_000, 64


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    planes: np.ndarray
    radius: int
    #: The share of the sample's rows that probing reaches.
    reached: float = 1.0

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Rows of 16-bit substrings."""
        bits = (x - self.mean) @ self.planes > 0
        return np.packbits(bits, axis=1, bitorder="little").view("<u2")


def _rotation(x: np.ndarray, seed: int, rounds: int = 20) -> np.ndarray:
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.sign(x @ r).T @ x)
        r = (u @ v).T
    return r


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def fit(x: np.ndarray, k: int = 10, bits: int = 256, miss: float = 0.02) -> Model:
    """x: the sample, rows of vectors."""
    mean = x.mean(axis=0)
    c = x - mean
    planes = np.concatenate([_rotation(c, s) for s in range(-(-bits // x.shape[1]))], axis=1)
    planes = planes[:, : planes.shape[1] // PART * PART] if planes.shape[1] >= PART else np.pad(planes, ((0, 0), (0, PART - planes.shape[1])))
    model = Model(mean, planes, 0)
    codes = model.codes(x)
    seen, asked = [], range(0, len(x), max(1, len(x) // SAMPLE_QUERIES))
    for i in asked:
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(x) - 1)]
        seen += hamming(codes[near], codes[i]).tolist()
    radius = int(np.quantile(seen, 1 - miss, method="higher")) if seen else planes.shape[1]
    return measured(Model(mean, planes, radius), x)


def measured(model: Model, x: np.ndarray) -> Model:
    """The model with the share of the sample's rows that probing reaches."""
    codes = model.codes(x)
    far = limits(model.radius, codes.shape[1])
    near = [(np.bitwise_count(codes ^ codes[i]) <= far).any(axis=1).mean() for i in range(0, len(x), max(1, len(x) // SAMPLE_QUERIES))]
    return replace(model, reached=float(np.mean(near)) if near else 1.0)


def tuned(model: Model, e: DataFrame, x: np.ndarray, k: int, miss: float) -> Model:
    """The model with the radius that holds all but `miss` of the true neighbours of a bounded number of the sample's rows among
    all rows of e (vec): one pass over them, which keeps the k + 1 nearest of each in every batch."""
    ask = x[:: max(1, len(x) // SAMPLE_QUERIES)]
    codes = model.codes(ask)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            v = np.stack(b["vec"].to_numpy())
            own = model.codes(v)
            for i, (a, c) in enumerate(zip(ask, codes)):
                d = ((v - a) ** 2).sum(axis=1)
                near = np.argpartition(d, k)[: k + 1] if len(d) > k + 1 else np.arange(len(d))
                yield pd.DataFrame({"i": i, "d": d[near], "h": hamming(own[near], c)})

    near = e.select("vec").mapInPandas(run, "i int, d double, h bigint")
    # the row itself is the nearest
    near = near.withColumn("r", F.row_number().over(W.partitionBy("i").orderBy("d", "h"))).where(F.col("r").between(2, k + 1))
    counts = sorted((r.h, r["count"]) for r in near.groupBy("h").count().collect())
    total, held = sum(n for _, n in counts), 0
    for h, n in counts:
        held += n
        if held >= (1 - miss) * total:
            return measured(replace(model, radius=int(h)), x)
    return model


def limits(radius: int, parts: int) -> np.ndarray:
    """How far each substring is probed (-1: not): with radius = parts * q + a, one of the first a + 1 substrings is within q
    or one of the others within q - 1."""
    q, a = divmod(radius, parts)
    return np.where(np.arange(parts) <= a, q, q - 1)


@lru_cache
def masks(weight: int) -> np.ndarray:
    """All substrings with so many bits set."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(PART), weight)], np.uint16) if weight <= PART else np.zeros(0, np.uint16)


class Index:
    """The tables of a block of codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = np.argsort(codes, axis=0, kind="stable").T
        values = np.take_along_axis(codes.T, self.order, axis=1)
        self.starts = np.stack([np.searchsorted(v, np.arange((1 << PART) + 1, dtype=np.int64)) for v in values]) if len(codes) else None

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code differs in at most `radius` bits."""
        if not len(self.codes):
            return np.zeros(0, np.int64)
        hit = np.zeros(len(self.codes), bool)
        for j, far in enumerate(limits(radius, self.codes.shape[1])):
            if far >= PART:
                hit[:] = True
                break
            for weight in range(far + 1):
                values = (masks(weight) ^ code[j]).astype(np.int64)
                lo, n = self.starts[j][values], self.starts[j][values + 1] - self.starts[j][values]
                lo, n = lo[n > 0], n[n > 0]
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                hit[self.order[j][at]] = True
        rows = np.flatnonzero(hit)
        return rows[hamming(self.codes[rows], code) <= radius]


def entries(rows: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec, ids): the distinct vectors that take part with their k + 1 least ids."""
    d = rows.select(F.col(id_col).alias("id"), F.transform(vector, lambda x: x.cast("double") + F.lit(0.0)).alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    d = d.where(F.col("id").isNotNull() & fine)
    # least ids in two steps, so that a vector that very many rows share isn't sorted in one task
    d = d.withColumn("h", F.xxhash64("vec")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16))).distinct()
    rank = F.row_number().over(W.partitionBy("h", "vec", "salt").orderBy("id"))
    d = d.withColumn("r", rank).where(F.col("r") <= k + 1)
    rank = F.row_number().over(W.partitionBy("h", "vec").orderBy("id"))
    d = d.withColumn("r", rank).where(F.col("r") <= k + 1)
    return d.groupBy("h", "vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).drop("h")


def probes(code: np.ndarray, radius: int) -> np.ndarray:
    """Keys (substring number and value) of all values within the substrings' limits."""
    out = [(masks(w) ^ code[j]).astype(np.int64) + (j << PART) for j, far in enumerate(limits(radius, len(code))) for w in range(far + 1)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _coded(rows: DataFrame, model: Model, key: str, queries: bool) -> DataFrame:
    """(key, code, keys): the code as 64-bit words, and the keys of its own substrings, or those that a query probes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            codes = model.codes(np.stack(b["vec"].to_numpy()))
            words = np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -codes.shape[1] % 4)))).view(np.int64)
            keys = [probes(c, model.radius) for c in codes] if queries else list(codes.astype(np.int64) + (np.arange(codes.shape[1]) << PART))
            yield pd.DataFrame({key: b[key], "code": list(words), "keys": keys})

    return rows.select(key, "vec").mapInPandas(run, f"{key} bigint, code array<bigint>, keys array<bigint>")


def by_key(e: DataFrame, q: DataFrame, model: Model) -> DataFrame:
    """(qentry, entry) within the radius: the probed values of the queries q (qentry, vec) joined to the tables of e (entry,
    vec)."""
    parts = model.planes.shape[1] // PART
    tables = staged(_coded(e, model, "entry", False).select("entry", "code", F.explode("keys").alias("key")), "mih-tables")
    asked = _coded(q, model, "qentry", True).select("qentry", F.col("code").alias("qcode"), F.explode("keys").alias("key"))
    hot = [r.key for r in tables.groupBy("key").count().where(F.col("count") * HOT > tables.count()).select("key").collect()]
    salts = F.when(F.col("key").isin(hot), SALTS).otherwise(1) if hot else F.lit(1)
    left = tables.withColumn("salt", F.pmod(F.xxhash64("entry"), salts).cast("int"))
    right = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    differ = F.zip_with("code", "qcode", lambda a, b: a.bitwiseXOR(b))
    d = left.join(right, ["key", "salt"]).withColumn("x", differ)
    d = d.where(F.aggregate("x", F.lit(0), lambda s, v: s + F.bit_count(v)) <= model.radius)
    # of the substrings that find a pair the first one counts
    part = lambda j: F.bit_count(F.shiftrightunsigned(F.get("x", F.lit(j // 4)), PART * (j % 4)).bitwiseAND(F.lit((1 << PART) - 1)))
    first = F.coalesce(*(F.when(part(j) <= int(far), j) for j, far in enumerate(limits(model.radius, parts)) if far >= 0))
    return d.where(F.shiftright("key", PART) == first).select("qentry", "entry")


def search(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", bits: int = 256, miss: float = 0.02) -> DataFrame:
    """(query_id, rank, <id_col>, score) for each query, a row of the same columns."""
    ship(rows.sparkSession)
    e = staged(entries(rows, k, id_col, vector).withColumn("entry", F.xxhash64("vec")), "mih-entries")
    common = e.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"query_id {kind}, rank int, {id_col} {kind}, score double"
    if common is None:
        return rows.sparkSession.createDataFrame([], schema)
    e = e.where(F.size("vec") == common.n)
    # a share of the entries, by their hash, that makes about the sample's size
    share = F.pmod(F.xxhash64("entry", F.lit(3)), F.lit(1 << 40)) <= int(min(1.0, SAMPLE / common["count"]) * (1 << 40))
    sample = e.where(share).select("vec").limit(2 * SAMPLE).collect()
    x = np.array(sorted(r.vec for r in sample))
    model = tuned(fit(x, k, bits, miss), e, x, k, miss)
    # queries by distinct vector: their ids are only needed at the end
    q = queries.select(F.col(id_col).alias("query_id"), F.transform(vector, lambda x: x.cast("double") + F.lit(0.0)).alias("vec")).where("query_id is not null").distinct()
    q = staged(q.join(e.select("vec", "entry"), "vec").withColumnRenamed("entry", "qentry"), "mih-queries")
    distinct = q.select("vec", "qentry").distinct()
    keyed = model.reached <= SPARSE and sum(len(masks(w)) for far in limits(model.radius, model.planes.shape[1] // PART) for w in range(far + 1)) <= PROBES
    if not keyed:
        found = by_block(e, distinct, model, k, common["count"], kind)
    else:
        pairs = staged(by_key(e.select("entry", "vec"), distinct, model), "mih-pairs")
        # the query's own entry holds the query's id, so k + 1 entries give k others
        enough = staged(pairs.groupBy("qentry").count().where(F.col("count") > k).select("qentry"), "mih-enough")
        apart = F.sqrt(F.aggregate(F.zip_with("vec", "qvec", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
        near = pairs.join(enough, "qentry", "left_semi").join(e.select("entry", "ids", "vec"), "entry").join(distinct.select("qentry", F.col("vec").alias("qvec")), "qentry")
        near = near.select("qentry", F.explode("ids").alias("id"), apart.alias("score"))
        left = staged(distinct.join(enough, "qentry", "left_anti"), "mih-open")
        found = near.unionByName(by_block(e, left, model, k, common["count"], kind)) if left.count() else near
    # per query vector k + 1 rows suffice: the query itself may be one of them
    best = found.withColumn("r", F.row_number().over(W.partitionBy("qentry").orderBy("score", "id"))).where(F.col("r") <= k + 1).drop("r")
    hits = q.select("query_id", "qentry").join(best, "qentry").where("id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def by_block(e: DataFrame, distinct: DataFrame, model: Model, k: int, n: int, kind: str) -> DataFrame:
    """(qentry, id, score) of the queries (vec, qentry): blocks of the index meet blocks of queries, and a query's radius grows
    in a block until k are found there."""
    n_blocks = max(1, -(-n // INDEX_BLOCK))
    index = e.withColumn("block", F.pmod(F.xxhash64("entry", F.lit(1)), F.lit(n_blocks)))
    n_queries = max(1, -(-distinct.count() // QUERY_BLOCK))
    distinct = distinct.withColumn("qblock", F.pmod(F.xxhash64("qentry", F.lit(2)), F.lit(n_queries)))
    left = index.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1)))).select("block", F.col("qblock").cast("long"), "ids", "vec")
    right = distinct.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).select(F.col("block").cast("long"), "qblock", "qentry", "vec")

    def run(mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out_q, out_i, out_d = [], [], []
        if len(mine) and len(asked):
            x = np.stack(mine["vec"].to_numpy())
            ids = mine["ids"].to_numpy()
            table_ = Index(model.codes(x))
            ask = np.stack(asked["vec"].to_numpy())
            for entry, v, code in zip(asked["qentry"], ask, model.codes(ask)):
                radius = model.radius
                while True:
                    found = table_.within(code, radius)
                    if len(found) > k or len(found) == len(x):
                        break
                    radius = min(radius + PART, model.planes.shape[1])
                score = np.sqrt(((x[found] - v) ** 2).sum(axis=1))
                if len(found) > k + 1:
                    edge = np.partition(score, k)[k]
                    found, score = found[score <= edge], score[score <= edge]
                for i, s in zip(found, score):
                    out_q += [entry] * len(ids[i])
                    out_i += list(ids[i])
                    out_d += [s] * len(ids[i])
        return pd.DataFrame({"qentry": np.array(out_q, np.int64), "id": out_i, "score": np.array(out_d, np.float64)})

    return left.groupBy("block", "qblock").cogroup(right.groupBy("block", "qblock")).applyInPandas(run, f"qentry bigint, id {kind}, score double")


def op10_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return search(e, e.where("vec_id % 100 = 0"))
