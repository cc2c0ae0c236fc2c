"""Play queues, bounded buffers and gapless programs.

A queue is a struct of `items` and `index`, the place of the current item (-1: none). Edits are pure functions of it, so a
log of edits is a fold over a queue's rows in order; a queue's log is bounded by what one listener does.
A buffer is a walk between two barriers; its level is carried from row to row in one sorted pass over a partition, with
one level in memory whatever a key's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EDITS = ("play_now", "play_next", "enqueue", "next", "previous", "move_to", "remove_at", "clear")


def _queue(items: Column, index: Column) -> Column:
    return F.struct(items.alias("items"), index.cast("int").alias("index"))


def empty(kind: str) -> Column:
    return _queue(F.array().cast(f"array<{kind}>"), F.lit(-1))


def play_now(q: Column, item: Column) -> Column:
    return _queue(F.array(item), F.lit(0))


def play_next(q: Column, item: Column) -> Column:
    """After the current item; in an empty queue it becomes the current one."""
    at = F.array_insert(q["items"], q["index"] + 2, item)
    return F.when(F.size(q["items"]) == 0, play_now(q, item)).otherwise(_queue(at, q["index"]))


def enqueue(q: Column, item: Column) -> Column:
    return _queue(F.concat(q["items"], F.array(item)), q["index"])


def move_to(q: Column, at: Column) -> Column:
    """Out of bounds nothing moves."""
    return _queue(q["items"], F.when((at >= 0) & (at < F.size(q["items"])), at).otherwise(q["index"]))


def next_item(q: Column) -> Column:
    return move_to(q, q["index"] + 1)


def previous_item(q: Column) -> Column:
    return move_to(q, q["index"] - 1)


def remove_at(q: Column, at: Column) -> Column:
    """The current item stays current; where it is removed, the one that takes its place is."""
    n = F.size(q["items"])
    left = F.filter(q["items"], lambda _, i: i != at)
    index = F.when(at < q["index"], q["index"] - 1).when(at == q["index"], F.least(q["index"], n - 2)).otherwise(q["index"])
    return F.when((at >= 0) & (at < n), _queue(left, index)).otherwise(q)


def edited(edits: DataFrame, key: str, order: str, item: str, at: str, op: str = "op") -> DataFrame:
    """(key, items, index): each queue after all its edits, from an empty one."""
    kind = edits.schema[item].dataType.simpleString()
    log = edits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(op).alias("op"), F.col(item).alias("item"), F.col(at).alias("at")))).alias("log"))

    def step(q: Column, e: Column) -> Column:
        out = {"play_now": play_now(q, e["item"]), "play_next": play_next(q, e["item"]), "enqueue": enqueue(q, e["item"]), "next": next_item(q), "previous": previous_item(q), "move_to": move_to(q, e["at"]), "remove_at": remove_at(q, e["at"]), "clear": empty(kind)}
        new = F.when(F.lit(False), q)
        for name, value in out.items():
            new = new.when(e["op"] == name, value)
        return new.otherwise(q)

    return log.select(key, F.aggregate("log", empty(kind), step).alias("q")).select(key, "q.items", "q.index")


def play_order(tracks: DataFrame, key: str, disc: str, number: str) -> DataFrame:
    """`place` of each track in its release: by disc, then number."""
    return tracks.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(disc, number)) - 1)


def program(queue: DataFrame, key: str, order: str, length: str, head: str, tail: str) -> DataFrame:
    """Gapless play: each item's `start` and `end` in the joint program, its silence at head and tail left out. The next item
    is heard from the sample at which the one before ends."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    kept = F.greatest(F.col(length) - F.col(head) - F.col(tail), F.lit(0))
    return queue.withColumn("end", F.sum(kept).over(w)).withColumn("start", F.col("end") - kept)


def ring_fill(writes: DataFrame, key: str, order: str, capacity: float, high: float, low: float) -> DataFrame:
    """A bounded buffer over a sequence of writes (amount above 0) and reads (below): (key, at, moved, level, paused, missing).
    What doesn't fit is dropped, reads get what there is; `missing` is what a write lost or a read must fill with silence.
    `paused` tells whether the producer stands still: from the high mark until the low mark."""
    kind = writes.schema[key].dataType.simpleString()
    rows = writes.select(F.col(key).alias("k"), F.col(order).cast("long").alias("at"), F.col("amount").cast("double").alias("amount"))
    rows = rows.repartition("k").sortWithinPartitions("k", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, level, paused = None, 0.0, False
        for b in batches:
            moved, levels, stands, missing = [], [], [], []
            for k, amount in zip(b.column("k").to_pylist(), b.column("amount").to_pylist()):
                if k != now:
                    now, level, paused = k, 0.0, False
                new = max(0.0, min(capacity, level + amount))
                paused = new >= high * capacity or (paused and new > low * capacity)
                moved.append(new - level)
                missing.append(max(0.0, level + amount - capacity, -level - amount))
                level = new
                levels.append(level)
                stands.append(paused)
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("at"), pa.array(moved, pa.float64()), pa.array(levels, pa.float64()), pa.array(stands, pa.bool_()), pa.array(missing, pa.float64())], ["k", "at", "moved", "level", "paused", "missing"])

    out = rows.mapInArrow(run, f"k {kind}, at bigint, moved double, level double, paused boolean, missing double")
    return out.withColumnRenamed("k", key)


def cached_blocks(reads: DataFrame, key: str, order: str, start: str, length: str, block: int = 65536, slots: int = 16) -> DataFrame:
    """(key, order, block, hit): the aligned blocks that each client's reads ask for, one after the other, against its cache of
    so many blocks that drops the one that came first. Whether a block is there depends on the fetches since its own, so this
    is one sorted pass with a client's cache as its state."""
    first, last = F.floor(F.col(start) / block), F.floor((F.col(start) + F.col(length) - 1) / block)
    asked = reads.where(F.col(length) > 0).select(F.col(key).alias("k"), F.col(order).alias("o"), F.explode(F.sequence(first, last)).alias("block"))
    asked = asked.repartition("k").sortWithinPartitions("k", "o", "block")
    kinds = [reads.schema[c].dataType.simpleString() for c in (key, order)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[int, None] = {}
        now, begun = None, False
        for b in batches:
            hits = []
            for k, x in zip(b.column("k").to_pylist(), b.column("block").to_pylist()):
                if not begun or k != now:
                    now, begun, cache = k, True, {}
                hits.append(x in cache)
                if not hits[-1]:
                    cache[x] = None
                    if len(cache) > slots:
                        del cache[next(iter(cache))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hits, pa.bool_())], ["k", "o", "block", "hit"])

    return asked.mapInArrow(run, f"k {kinds[0]}, o {kinds[1]}, block bigint, hit boolean").withColumnsRenamed({"k": key, "o": order})
