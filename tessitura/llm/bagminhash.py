"""Near-duplicates by weighted Jaccard similarity of word shingles, found with BagMinHash.

A document is the multiset of its runs of five words (ASCII white space separates words, case is folded; fewer words
make one run). Its signature follows BagMinHash: the weight axis is cut at 0, 1, 2, 4, 8, ...; each element and
interval has its own Poisson process in time, with the interval's width as intensity, so that wide intervals are
worked through at once and not unit by unit; each point also draws the unit of weight it belongs to and counts if the
document's weight covers it, and a slot of the signature. A slot keeps the earliest point. Two signatures agree in
a slot with the probability of the weighted Jaccard similarity, sum of minima over sum of maxima.
Points are drawn up to a time at which slots are expected to be full; documents with an empty slot go on.

64 slots make 16 bands of 4, so a pair at similarity 0.8 shares a band with probability 0.9998. Then, on distinct texts:
1. In every bucket (band value) of two or more, each member is compared with the least member: exact similarity of
   the multisets. Links at or above the threshold give components.
2. In buckets that still hold several components, members outside the largest one are compared with all members of
   other components, in blocks of bounded size. So every pair that shares a band is compared, but for pairs already
   known to be connected, and groups of copies never turn into all their pairs.
The class of a document is its component over all texts.

Defined results: null text counts as empty; texts without a word are near-duplicates only of equal texts; equal
texts, repeated rows included, are one class; the class id is the least document id in it (null if all are null);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import words
from tessitura.llm.common import hot_keys, packed, ship, spread_join, staged, table
from tessitura.llm.components import components

WORDS, SLOTS, ROWS, THRESHOLD = 5, 64, 4, 0.8
BANDS = SLOTS // ROWS
#: Elements keep 44 bits of their hash beside the row number in a chunk.
BITS = 44
#: A block of the exact comparison holds about so many bytes of shingles and at most so many documents.
BLOCK_BYTES, BLOCK_ROWS = 4_000_000, 512
#: Up to so many ids (24 bytes each) are broadcast.
BROADCAST_ROWS = 500_000

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((x >> _U(11)).astype(np.float64) + 1) * 2.0**-53


def bags(texts: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, element and weight of the shingles of the texts, sorted by row and element."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.utf8_lower(texts)))
    distinct, index, offsets = words.coded(lists)
    hashes = pd.util.hash_array(np.array(distinct, dtype=object), categorize=False) if distinct else np.zeros(0, _U)
    w = hashes[index]
    n = np.diff(offsets)
    n = np.where(pc.equal(pc.binary_length(pc.ascii_trim_whitespace(texts)), 0).to_numpy(zero_copy_only=False), 0, n)
    runs = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    rows = np.repeat(np.arange(len(n)), runs)
    first = np.repeat(offsets[:-1], runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    last = np.repeat(offsets[:-1] + n, runs)
    h = np.zeros(len(rows), _U)
    for j in range(k):
        at = first + j
        there = at < last
        h = np.where(there, mix(h * _U(0x9E3779B97F4A7C15) + w[np.minimum(at, max(len(w) - 1, 0))] + _U(j + 1)), h) if len(w) else h
    keys = np.sort(rows.astype(_U) << _U(BITS) | h >> _U(64 - BITS))
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    weight = np.diff(np.append(starts, len(keys)))
    keys = keys[starts]
    return (keys >> _U(BITS)).astype(np.int64), keys & _U((1 << BITS) - 1), weight


def signatures(rows: np.ndarray, elements: np.ndarray, weight: np.ndarray, n: int, slots: int = SLOTS, spread: float = 3.0) -> np.ndarray:
    """n * slots hashes; a row without elements has zeros."""
    total = np.bincount(rows, weight, n)
    limit = np.divide(slots * (np.log(slots) + spread), total, out=np.zeros(n), where=total > 0)
    best = np.full(n * slots, np.iinfo(_U).max, _U)
    # one process for each element and weight interval: [0, 1), [1, 2), [2, 4), ...
    level = np.ceil(np.log2(weight)).astype(np.int64) + 1 if len(weight) else np.zeros(0, np.int64)
    which = np.repeat(np.arange(len(rows)), level)
    step = np.arange(level.sum()) - np.repeat(np.cumsum(level) - level, level)
    low = np.where(step == 0, 0, 2.0 ** (step - 1))
    width = np.where(step <= 1, 1.0, low)
    row, w = rows[which], weight[which]
    state = mix(elements[which] * _U(0x9E3779B97F4A7C15) + step.astype(_U))
    time = np.zeros(len(row))
    scale = np.divide(2.0**31, limit, out=np.zeros(n), where=limit > 0)
    while len(row):
        state = mix(state + _U(0x632BE59BD9B4E019))
        time = time - np.log(unit(state)) / width
        go = time <= limit[row]
        row, w, low, width, state, time = row[go], w[go], low[go], width[go], state[go], time[go]
        other = mix(state ^ _U(0xD6E8FEB86659FD93))
        inside = low + np.floor(width * (other >> _U(40)).astype(np.float64) * 2.0**-24) < w
        slot = (other & _U(0xFFFFF)).astype(np.int64) % slots
        key = (time * scale[row]).astype(_U) << _U(32) | (mix(other) & _U(0xFFFFFFFF))
        np.minimum.at(best, (row * slots + slot)[inside], key[inside])
    best = best.reshape(n, slots)
    open_ = np.flatnonzero((best == np.iinfo(_U).max).any(axis=1) & (total > 0))
    out = np.where((total > 0)[:, None], best & _U(0xFFFFFFFF), _U(0))
    if len(open_):
        mine = np.isin(rows, open_)
        out[open_] = signatures(np.searchsorted(open_, rows[mine]), elements[mine], weight[mine], len(open_), slots, 2 * (np.log(slots) + spread) - np.log(slots))
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    n = len(sig)
    parts = sig.reshape(n, BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U), (n, BANDS)).copy()
    for r in range(ROWS):
        h = mix(h * _U(0x9E3779B97F4A7C15) + parts[:, :, r])
    return h.view(np.int64)


def node(text: str) -> F.Column:
    """The node of a document: a digest of its text."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def keys(docs: DataFrame) -> DataFrame:
    """(node, text) to (node, bands); null bands for texts without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.chunks(batches, "text"):
            n = b.num_rows
            rows, elements, weight = bags(b.column("text"))
            made = bands(signatures(rows, elements, weight, n))
            full = np.bincount(rows, minlength=n) > 0
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(made.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column("node"), pc.if_else(pa.array(full), lists, pa.scalar(None, lists.type))], ["node", "bands"])

    return docs.select("node", "text").mapInArrow(words.frugal(run), "node binary, bands array<bigint>")


def shingles(docs: DataFrame) -> DataFrame:
    """(node, text) to (node, bag): the multiset as sorted 8-byte hashes, the j-th copy of an element hashed with j,
    so that the weighted similarity of two texts is the plain Jaccard similarity of these sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.chunks(batches, "text"):
            rows, elements, weight = bags(b.column("text"))
            copy = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
            h = mix(np.repeat(elements, weight) * _U(0x9E3779B97F4A7C15) + copy.astype(_U))
            rows = np.repeat(rows, weight)
            h = h[np.lexsort((h, rows))]
            ends = np.searchsorted(rows, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([h[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:])], pa.binary())], ["node", "bag"])

    return docs.select("node", "text").mapInArrow(words.frugal(run), "node binary, bag binary")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets."""
    if not len(a) or not len(b):
        return 0.0
    at = np.searchsorted(a, b)
    common = int(np.count_nonzero(a[np.minimum(at, len(a) - 1)] == b))
    return common / (len(a) + len(b) - common)


def _near(a: bytes, b: bytes, threshold: float) -> bool:
    x, y = np.frombuffer(a, _U), np.frombuffer(b, _U)
    return min(len(x), len(y)) >= threshold * max(len(x), len(y)) and similarity(x, y) >= threshold


#: Places that the pairs of a hot lead go to.
SALTS = 64


def links(pairs: DataFrame, bag: DataFrame, threshold: float) -> DataFrame:
    """Of (u, v) pairs those whose bags are similar enough. No two have the same v often; a u in many of them is salted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [_near(x.as_buffer(), y.as_buffer(), threshold) for x, y in zip(b.column("x"), b.column("y"))]
            out = pa.Table.from_batches([b.select(["u", "v"])]).filter(pa.array(keep, pa.bool_()))
            yield from out.to_batches()

    pairs = staged(pairs, "near-pairs")
    hot = hot_keys(pairs.groupBy("u").agg(F.count("*").alias("n")), "u", pairs.count())
    salts = F.when(F.col("u").isin(hot), SALTS).otherwise(1) if hot else F.lit(1)
    left = bag.select(F.col("node").alias("u"), F.col("bag").alias("x")).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    p = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), salts).cast("int"))
    p = p.join(bag.select(F.col("node").alias("v"), F.col("bag").alias("y")), "v").join(left, ["u", "salt"])
    return p.select("u", "v", "x", "y").mapInArrow(run, "u binary, v binary")


def rest(members: DataFrame, bag: DataFrame, threshold: float) -> DataFrame:
    """Links (u, v) between labels inside buckets that hold several. members: (key, node, lead, label)."""
    members = staged(members, "near-labelled")
    by = members.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = by.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("labels")).where("labels > 1 and n > 2").drop("labels")
    m = spread_join(members, staged(mixed, "near-mixed"), "key", members.count()).drop("n").join(bag.select("node", F.length("bag").alias("size")), "node")
    m = staged(m.withColumn("minor", F.col("label") != F.col("main")), "near-rest")

    def blocks(of: F.Column) -> F.Column:
        return F.greatest(F.ceil(F.sum(F.when(of, F.col("size"))) / BLOCK_BYTES), F.ceil(F.count_if(of) / BLOCK_ROWS)).cast("int")

    sizes = m.groupBy("key").agg(blocks(F.col("minor")).alias("left"), blocks(F.lit(True)).alias("right"), F.count("*").alias("n"))
    m = spread_join(m, staged(sizes, "near-blocks"), "key", m.count()).drop("n")
    m = m.withColumns({"hl": F.pmod(F.xxhash64("node"), F.col("left")), "hr": F.pmod(F.xxhash64("node", F.lit(1)), F.col("right"))})
    left = m.where("minor").withColumn("hr", F.explode(F.expr("sequence(0L, right - 1)"))).withColumn("side", F.lit(True))
    right = m.withColumn("hl", F.explode(F.expr("sequence(0L, left - 1)"))).withColumn("side", F.lit(False))
    cols = ["key", "hl", "hr", "side", "node", "label", "lead", "minor"]
    both = left.select(*cols).unionByName(right.select(*cols)).join(bag, "node")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # labels joined in this group need no further link here
        root: dict[bytes, bytes] = {}

        def find(x: bytes) -> bytes:
            while root.get(x, x) != x:
                x = root[x]
            return x

        a, b = pdf[pdf.side], pdf[~pdf.side]
        bag_b = [np.frombuffer(x, _U) for x in b.bag]
        size_b = np.array([len(x) for x in bag_b], dtype=np.int64)
        label_b, node_b, lead_b, minor_b = b.label.to_numpy(), b.node.to_numpy(), b.lead.to_numpy(), b.minor.to_numpy()
        # which documents of the right side hold a shingle: one pass gives all overlaps of a left document
        flat = np.concatenate(bag_b) if len(bag_b) else np.zeros(0, _U)
        owner = np.repeat(np.arange(len(bag_b)), size_b)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        found = []
        for node, label, lead, bag_ in zip(a.node, a.label, a.lead, a.bag):
            x = np.frombuffer(bag_, _U)
            lo, hi = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
            n = hi - lo
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            common = np.bincount(owner[at], minlength=len(bag_b))
            near = np.flatnonzero(common >= threshold * (len(x) + size_b - common))
            for j in near:
                if label_b[j] != label and lead_b[j] != node and lead != node_b[j] and (not minor_b[j] or node < node_b[j]) and find(label) != find(label_b[j]):
                    root[find(label)] = find(label_b[j])
                    found.append((label, label_b[j]))
        return pd.DataFrame(found, columns=["u", "v"])

    return both.groupBy("key", "hl", "hr").applyInPandas(run, "u binary, v binary").distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, node (digest of the text), class (least node of the component), class_id, class_size."""
    ship(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("id"), node(text).alias("node"), F.col(text).alias("text"))
    ids = d.select("id", "node")
    k = staged(keys(d).groupBy("node").agg(F.first("bands").alias("bands")), "near-bands")
    total = k.where("bands is not null").count() * BANDS
    k = k.select("node", F.explode("bands").alias("key"))
    buckets = staged(k.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lead")).where("n > 1"), "near-buckets")
    members = staged(spread_join(k, buckets, "key", total).drop("n"), "near-members")
    nodes = staged(members.select("node").distinct(), "near-nodes")
    wanted = F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS else nodes
    bag = staged(shingles(d.join(wanted, "node", "left_semi")).groupBy("node").agg(F.first("bag").alias("bag")), "near-bags")
    pairs = members.where("node <> lead").select(F.col("lead").alias("u"), F.col("node").alias("v")).distinct()
    label = components(links(pairs, bag, threshold), "near-links")
    members = members.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    more = components(rest(members, bag, threshold), "near-rest-links")
    label = staged(_composed(label, more), "near-labels")
    return _by_document(staged(ids, "near-ids"), label).select(F.col("id").alias(id_col), "node", "class", "class_id", "class_size")


def _by_document(ids: DataFrame, label: DataFrame) -> DataFrame:
    """ids (id, node) with class, class_id and class_size. Sizes and least ids are counted by text, then, over the texts
    that have a link, by class; no join sees the rows of a class in one task."""
    texts = staged(ids.groupBy("node").agg(F.min("id").alias("low"), F.count("*").alias("n")), "near-texts")
    # label leaves out nodes that are their own label
    linked = label.unionByName(label.select(F.col("label").alias("node"), "label").distinct()).distinct()
    linked = staged(texts.join(linked, "node").withColumnRenamed("label", "class"), "near-linked")
    c = staged(linked.groupBy("class").agg(F.min("low").alias("class_id"), F.sum("n").alias("class_size"), F.count("*").alias("n")), "near-sizes")
    found = spread_join(linked.select("node", "class", F.col("n").alias("copies")), c, "class", linked.count()).drop("n").withColumnRenamed("copies", "n")
    alone = texts.join(linked.select("node"), "node", "left_anti").select("node", F.col("node").alias("class"), F.col("low").alias("class_id"), F.col("n").alias("class_size"), "n")
    facts = staged(found.select(alone.columns).unionByName(alone), "near-facts")
    return spread_join(ids, facts, "node", ids.count()).drop("n")


def _composed(label: DataFrame, more: DataFrame) -> DataFrame:
    """First labels, then the labels of labels."""
    m = more.select(F.col("node").alias("label"), F.col("label").alias("last"))
    first = label.join(m, "label", "left").select("node", F.coalesce("last", "label").alias("label"))
    # labels of the first round that are nodes themselves, and nodes without a link in it
    own = more.join(label.select("node"), "node", "left_anti")
    return first.unionByName(own)


def kept(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without all but one document of each class: the one with the class id, or one of the rows that repeat
    it. All columns are kept, whatever their names."""
    c = staged(classes(docs, id_col, text, threshold).where("class_size > 1"), "near-classes")
    c = c.withColumnRenamed(id_col, "id").withColumn("own", F.col("id").eqNullSafe(F.col("class_id")))
    d = packed(docs, id=docs[id_col], node=node(text))
    gone = staged(c.where("not own").select(F.col("id").alias("gone_id"), F.col("node").alias("gone_node")).distinct(), "near-gone")
    few = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    d = d.join(few, d["id"].eqNullSafe(F.col("gone_id")) & (F.col("node") == F.col("gone_node")), "left_anti")
    # rows of one class that share the class id: of the least text among them one row stays
    again = c.where("own").groupBy("class").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1")
    again = staged(c.where("own").select("class", "node").distinct().join(again, "class").select("node", (F.col("node") == F.col("first")).alias("stays")), "near-again")
    if again.count():
        one = d.join(again.where("stays"), "node").groupBy("node").agg(F.first("row").alias("row"))
        d = d.join(again, "node", "left_anti").select("row").unionByName(one.select("row"))
    return d.select(*(F.col(f"row.`{x}`").alias(x) for x in docs.columns))


def op9_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = classes(table(spark, sf_dir, "documents"))
    return c.select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("kept"))
