"""Order-dependent operators: delta codes, positions, lookups, intervals, envelopes and renumbering.

All partition by a key (a file, a track, a queue) and order inside it, so a key's rows meet in one task; the keys are
many and each is bounded by one file's length. Lookups are arithmetic or window-based, never range-condition joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def folded(rows: DataFrame, key: str, order: str, inputs: list[str], schema: str, start: Callable[[], Any], step: Callable[..., tuple[Any, tuple]]) -> DataFrame:
    """(key, order, schema's columns): step(state, *inputs) gives the next state and a row's values, from start() at each key's
    first row. One sorted pass over a partition, with one key's state in memory: for what no window function can carry."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = [key, order, *(x.split()[0] for x in schema.split(", "))]
    d = rows.select(key, order, *inputs).repartition(F.col(key)).sortWithinPartitions(key, order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, first = None, None, True
        for b in batches:
            out = []
            for k, o, *values in zip(b[key], b[order], *(b[c] for c in inputs)):
                if first or k != now:
                    now, state, first = k, start(), False
                state, made = step(state, *values)
                out.append((k, o, *made))
            yield pd.DataFrame(out, columns=names)

    return d.mapInPandas(run, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, {schema}")


def second_difference(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """`delta`: t[i] - 2 t[i-1] + t[i-2], with what is before the start as 0, and `coded` with its sign in the low bit."""
    w = W.partitionBy(key).orderBy(order)
    d = F.col(value) - 2 * F.lag(value, 1, 0).over(w) + F.lag(value, 2, 0).over(w)
    return rows.withColumn("delta", d).withColumn("coded", F.when(F.col("delta") < 0, -2 * F.col("delta") + 1).otherwise(2 * F.col("delta")))


def from_second_difference(rows: DataFrame, key: str, order: str, delta: str) -> DataFrame:
    """The inverse: running sums of running sums."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("first", F.sum(delta).over(w)).withColumn("value", F.sum("first").over(w)).drop("first")


def thinned(rows: DataFrame, order: str, power: int) -> DataFrame:
    """Every 2**power-th entry of restored values, renumbered."""
    return rows.where(F.col(order) % (1 << power) == 0).withColumn(order, F.shiftright(F.col(order), power))


def modular_chain(rows: DataFrame, key: str, order: Column, delta: str, modulus: int = 128) -> DataFrame:
    """Values coded as differences modulo a power of two."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("value", F.pmod(F.sum(delta).over(w), F.lit(modulus)))


def positions(frames: DataFrame, key: str, order: str, length: str, skip: int, total: Column | None = None) -> DataFrame:
    """Each frame's first kept sample and number of kept samples, when `skip` leading samples and those past `total` go."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(length).over(w)
    d = frames.withColumn("end", end - skip).withColumn("from", F.greatest(F.col("end") - F.col(length), F.lit(0)))
    last = F.col("end") if total is None else F.least(F.col("end"), total)
    return d.withColumn("kept", F.greatest(last - F.col("from"), F.lit(0))).drop("end")


def seek_entries(frames: DataFrame, order: str, power: int) -> DataFrame:
    """Every 2**power-th frame."""
    return frames.where(F.col(order) % (1 << power) == 0)


def seek(requests: DataFrame, entries: DataFrame, key: str, sample: str, frame_samples: int, power: int, delay: int = 0) -> DataFrame:
    """The last seek entry (key, entry, offset) at or before the frame of each request: the entry's number is arithmetic,
    so the as-of lookup is an equi-join; a request past the end takes the last entry."""
    last = entries.groupBy(key).agg(F.max("entry").alias("last"))
    want = F.greatest(F.floor(F.greatest(F.col(sample) - delay, F.lit(0)) / frame_samples / (1 << power)), F.lit(0)).cast("long")
    r = requests.join(last, key).withColumn("entry", F.least(want, F.col("last"))).drop("last")
    return r.join(entries, [key, "entry"])


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with `value` of the latest right row at or before, per key: both sides in one sorted pass."""
    both = left.select(key, at, F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    other = right.select(key, at, F.lit(0).alias("__side"), F.lit(None).cast(both.schema["__row"].dataType).alias("__row"), F.col(value).alias("__v"))
    w = W.partitionBy(key).orderBy(at, "__side").rowsBetween(W.unboundedPreceding, 0)
    d = both.unionByName(other).withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    return d.select("__row.*", F.col("__v").alias(value))


def offsets(queue: DataFrame, key: str, order: str, length: str) -> DataFrame:
    """`start` and `end` of each item of a queue: prefix sums."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return queue.withColumn("end", F.sum(length).over(w)).withColumn("start", F.col("end") - F.col(length))


def split_at(frames: DataFrame, marks: DataFrame, key: str, start: str, length: str, mark: str) -> DataFrame:
    """Frames cut at the marks inside them: (key, from, to, chapter), chapter being the last mark at or before `from` (null
    before the first). A frame meets only the marks of its own stretch, found by the mark's frame number, so the join is
    an equi-join; frames all have the same length but for the last of a key."""
    size = frames.groupBy(key).agg(F.max(length).alias("size"))
    f = frames.join(size, key).withColumn("slot", F.floor(F.col(start) / F.col("size")))
    m = marks.select(key, F.col(mark).alias("mark")).distinct().join(size, key).withColumn("slot", F.floor(F.col("mark") / F.col("size"))).drop("size")
    inside = f.join(m, [key, "slot"], "left").groupBy(key, "slot", start, length).agg(F.array_sort(F.collect_list("mark")).alias("marks"))
    end = F.col(start) + F.col(length)
    cuts = F.array_distinct(F.concat(F.array(start), F.filter("marks", lambda x: (x > F.col(start)) & (x < end))))
    p = inside.withColumn("cuts", cuts).select(key, F.explode(F.transform("cuts", lambda c, i: F.struct(c.alias("from"), F.coalesce(F.get("cuts", i + 1), end).alias("to")))).alias("p")).select(key, "p.*")
    first = marks.select(key, F.col(mark).alias("from"), F.col(mark).alias("chapter")).distinct()
    return as_of(p, first, key, "from", "chapter")


def current_item(positions_: DataFrame, queue: DataFrame, key: str, at: str, item: str) -> DataFrame:
    """The queue item that plays at each position: intervals begin at `start`; before the first begins none plays."""
    return as_of(positions_, queue.select(key, F.col("start").alias(at), item), key, at, item)


def differences(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 0) -> DataFrame:
    """Where two streams differ by more than the tolerance, or one has no sample."""
    x, y = a.select(*keys, F.col(value).alias("a")), b.select(*keys, F.col(value).alias("b"))
    return x.join(y, keys, "full").where(F.col("a").isNull() | F.col("b").isNull() | (F.abs(F.col("a") - F.col("b")) > tolerance))


def peaks(samples: DataFrame, levels: list[str], value: str) -> DataFrame:
    """The largest magnitude for each prefix of the levels (title in chapter in album, say), and over all."""
    return samples.rollup(*levels).agg(F.max(F.abs(value)).alias("peak"))


def faded(samples: DataFrame, key: str, at: str, value: str, fade_in: int, fade_out: int) -> DataFrame:
    """Linear envelopes over the first and last samples of each key."""
    n = F.max(at).over(W.partitionBy(key)) + 1
    gain = F.least(F.lit(1.0), (F.col(at) + 1) / F.lit(fade_in + 1), (n - F.col(at)) / F.lit(fade_out + 1))
    return samples.withColumn("faded", F.col(value) * gain)


def renumbered(tracks: DataFrame, disc: str, number: str, path: str) -> DataFrame:
    """Numbers as they are where each track of a disc has one and no two are equal, else 1..n by number (missing last)
    and path."""
    all_ = W.partitionBy(disc)
    bad = (F.min(F.coalesce(number, F.lit(0))).over(all_) <= 0) | (F.count("*").over(all_) > F.size(F.collect_set(number).over(all_)))
    order = F.when(F.col(number) > 0, F.col(number)).otherwise(2147483647)
    return tracks.withColumn("track", F.when(bad, F.row_number().over(all_.orderBy(order, path))).otherwise(F.col(number)))


def carried(rows: DataFrame, key: str, order: str, section: str) -> DataFrame:
    """A section line holds for the lines after it."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("in_section", F.last(section, ignorenulls=True).over(w))


def cut(frames: DataFrame, key: str, order: str, first: int, last: int) -> DataFrame:
    """Frames of a range, renumbered from 0."""
    return frames.where(F.col(order).between(first, last)).withColumn("frame", F.col(order) - first)


def blocks_read(reads: DataFrame, start: str, length: str, block: int = 65536) -> DataFrame:
    """The aligned blocks that reads touch, each once."""
    first, last = F.floor(F.col(start) / block), F.floor((F.col(start) + F.col(length) - 1) / block)
    return reads.where(F.col(length) > 0).select(F.explode(F.sequence(first, last)).alias("block")).distinct()
