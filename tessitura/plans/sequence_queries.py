"""Ordered-sequence queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessitura.operators import queues
from tessitura.operators import sequences as ops
from tessitura.plans.catalog_tables import read
from tessitura.plans.registry import query

_EVENTS = "with e as (select user_id, event_id, cast(round(value * 100) as bigint) as v from events)"


def _events(spark, sf_dir):
    return read(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.col("value") * 100).cast("long").alias("v"))


@query("seek_deltas", _EVENTS + """, d as (select *, v - 2 * coalesce(lag(v, 1) over w, 0) + coalesce(lag(v, 2) over w, 0) as delta from e window w as (partition by user_id order by event_id))
select *, case when delta < 0 then -2 * delta + 1 else 2 * delta end as coded from d""")
def seek_deltas(spark, sf_dir):
    return ops.second_difference(_events(spark, sf_dir), "user_id", "event_id", "v")


@query("seek_restored", _EVENTS + "select user_id, event_id, v, v as value from e")
def seek_restored(spark, sf_dir):
    d = ops.second_difference(_events(spark, sf_dir), "user_id", "event_id", "v").drop("coded")
    return ops.from_second_difference(d, "user_id", "event_id", "delta").drop("delta")


@query("scale_chain", _EVENTS + "select user_id, event_id, v, cast(((sum(v) over (partition by user_id order by event_id)) % 128 + 128) % 128 as bigint) as value from e")
def scale_chain(spark, sf_dir):
    return ops.modular_chain(_events(spark, sf_dir), "user_id", F.col("event_id"), "v")


@query("frame_positions", """
with f as (select user_id, event_id, 1152 as n, sum(1152) over (partition by user_id order by event_id) - 481 as last from events),
g as (select *, greatest(last - n, 0) as "from" from f)
select user_id, event_id, n, cast("from" as bigint) as "from", cast(greatest(least(last, 10000) - "from", 0) as bigint) as kept from g""")
def frame_positions(spark, sf_dir):
    f = read(spark, sf_dir, "events").select("user_id", "event_id", F.lit(1152).alias("n"))
    return ops.positions(f, "user_id", "event_id", "n", 481, F.lit(10000))


_FRAMES = "select user_id, row_number() over (partition by user_id order by event_id) - 1 as frame, event_id as offset_ from events"


@query("seek_table", f"select user_id, frame, offset_ from ({_FRAMES}) where frame % 4 = 0")
def seek_table(spark, sf_dir):
    return ops.seek_entries(_frames(spark, sf_dir), "frame", 2)


def _frames(spark, sf_dir):
    from pyspark.sql import Window as W

    return read(spark, sf_dir, "events").select("user_id", (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("frame"), F.col("event_id").alias("offset_"))


@query("seek_lookup", f"""
with s as (select user_id, frame // 4 as entry, offset_ from ({_FRAMES}) where frame % 4 = 0),
r as (select user_id, event_id, event_id * 3 % 20000 as sample from events)
select r.user_id, r.event_id, r.sample, s.entry, s.offset_ from r, lateral (select max(entry) as entry from s where s.user_id = r.user_id and s.entry * 4 <= greatest(r.sample - 481, 0) // 1152) m join s on s.user_id = r.user_id and s.entry = m.entry""")
def seek_lookup(spark, sf_dir):
    entries = ops.seek_entries(_frames(spark, sf_dir), "frame", 2).select("user_id", F.floor(F.col("frame") / 4).alias("entry"), "offset_")
    r = read(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * 3 % 20000).alias("sample"))
    return ops.seek(r, entries, "user_id", "sample", 1152, 2, 481)


@query("as_of_purchase", """
with l as (select user_id, event_id, value from events where event_type <> 'purchase'), r as (select user_id, event_id, value as last_value from events where event_type = 'purchase')
select l.user_id, l.event_id, l.value, r.last_value from l asof left join r on l.user_id = r.user_id and l.event_id >= r.event_id""")
def as_of_purchase(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type")
    return ops.as_of(e.where("event_type <> 'purchase'").drop("event_type"), e.where("event_type = 'purchase'").select("user_id", "event_id", F.col("value").alias("last_value")), "user_id", "event_id", "last_value")


_QUEUE = "with q as (select l_orderkey, part, line, cast(sum(len_) over (partition by l_orderkey order by line) as bigint) as last, len_ from (select l_orderkey, l_linenumber as line, min(l_partkey) as part, cast(min(l_quantity) as bigint) as len_ from lineitem group by 1, 2))"


def _queue(spark, sf_dir):
    q = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("line")).agg(F.min("l_partkey").alias("part"), F.min("l_quantity").cast("long").alias("len_"))
    return ops.offsets(q, "l_orderkey", "line", "len_")


@query("queue_offsets", _QUEUE + 'select l_orderkey, line, part, len_, last as "end", last - len_ as start from q')
def queue_offsets(spark, sf_dir):
    return _queue(spark, sf_dir)


@query("queue_current", _QUEUE + """, p as (select o_orderkey as l_orderkey, o_orderkey % 90 as start from orders)
select p.l_orderkey, p.start, (select max(line) from q where q.l_orderkey = p.l_orderkey and last - len_ <= p.start) as line from p""")
def queue_current(spark, sf_dir):
    p = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 90).alias("start"))
    return ops.current_item(p, _queue(spark, sf_dir), "l_orderkey", "start", "line")


@query("stream_differences", "select event_id, value as a, case when event_id % 7 <> 0 then value + case when event_id % 5 = 0 then 1 else 0 end end as b from events where event_id % 7 = 0 or event_id % 5 = 0")
def stream_differences(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "value")
    other = e.where("event_id % 7 <> 0").withColumn("value", F.col("value") + F.when(F.col("event_id") % 5 == 0, 1).otherwise(0))
    return ops.differences(e, other, ["event_id"], "value", 0.5)


@query("peak_levels", "select event_type, user_id, max(abs(value)) as peak from events group by rollup (event_type, user_id)")
def peak_levels(spark, sf_dir):
    return ops.peaks(read(spark, sf_dir, "events"), ["event_type", "user_id"], "value")


@query("fade_envelope", """
with s as (select user_id, row_number() over (partition by user_id order by event_id) - 1 as pos, value from events)
select user_id, pos, round(value * least(1.0::double, (pos + 1) / 4.0::double, (max(pos) over (partition by user_id) + 1 - pos) / 3.0::double), 9) as faded from s""")
def fade_envelope(spark, sf_dir):
    s = _frames(spark, sf_dir).withColumnRenamed("frame", "pos").join(read(spark, sf_dir, "events").select(F.col("event_id").alias("offset_"), "value"), "offset_")
    return ops.faded(s, "user_id", "pos", "value", 3, 2).select("user_id", "pos", F.round("faded", 9).alias("faded"))


@query("track_renumber", """
with t as (select l_orderkey as disc, case when l_orderkey % 3 = 0 then 0 else l_linenumber end as number, l_partkey || '/' || l_suppkey || '/' || l_extendedprice as path from lineitem),
b as (select *, min(number) over (partition by disc) <= 0 or count(*) over (partition by disc) > (select count(distinct number) from t u where u.disc = t.disc) as bad from t)
select disc, path, cast(case when bad then row_number() over (partition by disc order by case when number > 0 then number else 2147483647 end, path) else number end as int) as track from b""")
def track_renumber(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    t = line.select(F.col("l_orderkey").alias("disc"), F.when(F.col("l_orderkey") % 3 == 0, 0).otherwise(F.col("l_linenumber")).alias("number"), F.concat_ws("/", "l_partkey", "l_suppkey", "l_extendedprice").alias("path"))
    return ops.renumbered(t, "disc", "number", "path").select("disc", "path", "track")


@query("section_carry", "select user_id, event_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by event_id) as in_section from events")
def section_carry(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("section"))
    return ops.carried(e, "user_id", "event_id", "section").drop("section")


@query("frame_cut", f"select user_id, offset_, frame - 2 as frame from ({_FRAMES}) where frame between 2 and 5")
def frame_cut(spark, sf_dir):
    f = _frames(spark, sf_dir).withColumnRenamed("frame", "n")
    return ops.cut(f, "user_id", "n", 2, 5).drop("n")


@query("ring_levels", """
with recursive e as (select user_id, event_id, case when event_id % 3 = 0 then -1.5::double else 1.0::double end as amount, row_number() over (partition by user_id order by event_id) as rn from events),
r as (select user_id, event_id, rn, amount, greatest(0.0::double, amount) as level, greatest(0.0::double, amount) as moved, false as paused from e where rn = 1
  union all select e.user_id, e.event_id, e.rn, e.amount, greatest(0.0::double, least(8.0::double, r.level + e.amount)), greatest(0.0::double, least(8.0::double, r.level + e.amount)) - r.level,
    case when greatest(0.0::double, least(8.0::double, r.level + e.amount)) >= 6.4 then true when greatest(0.0::double, least(8.0::double, r.level + e.amount)) <= 1.6 then false else r.paused end
  from r join e on e.user_id = r.user_id and e.rn = r.rn + 1)
select user_id, event_id as at, moved, level, paused, abs(amount - moved) as missing from r""")
def ring_levels(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, -1.5).otherwise(1.0).alias("amount"))
    return queues.ring_fill(e, "user_id", "event_id", 8, 0.8, 0.2)


@query("queue_edits", """
with q as (select l_orderkey, list(p order by line) as v from (select l_orderkey, l_linenumber as line, min(l_partkey) as p from lineitem group by 1, 2) group by 1)
select l_orderkey, array_to_string(case when l_orderkey % 5 = 0 then [-2] else v end, ',') as items, cast(case when l_orderkey % 5 = 0 then 0 else least(len(v) - 1, 1) end as int) as index from q""")
def queue_edits(spark, sf_dir):
    """Each order's items are put in line, one more is played next, then the second is chosen, the first removed, the next
    chosen; every fifth queue is then given up for another item."""
    line = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("item"))
    put = line.select("l_orderkey", F.col("n").cast("int").alias("n"), F.lit("enqueue").alias("op"), "item", F.lit(0).alias("at"))
    step = lambda n, op, item, at: F.struct(F.lit(n).alias("n"), F.lit(op).alias("op"), F.lit(item).cast("bigint").alias("item"), F.lit(at).alias("at"))
    after = F.array(step(100, "play_next", -1, 0), step(101, "move_to", None, 1), step(102, "remove_at", None, 0), step(103, "next", None, 0), step(104, "move_to", None, 99))
    end = F.array(step(105, "clear", None, 0), step(106, "play_next", -2, 0), step(107, "previous", None, 0))
    rest = line.select("l_orderkey").distinct().select("l_orderkey", F.explode(F.when(F.col("l_orderkey") % 5 == 0, F.concat(after, end)).otherwise(after)).alias("s")).select("l_orderkey", "s.*")
    q = queues.edited(put.unionByName(rest), "l_orderkey", "n", "item", "at")
    return q.select("l_orderkey", F.array_join("items", ",").alias("items"), "index")


@query("gapless_program", _QUEUE.replace("with q as", "with q0 as") + """, k as (select l_orderkey, line, greatest(len_ - line - part % 3, 0) as kept from q0),
e as (select l_orderkey, line, kept, cast(sum(kept) over (partition by l_orderkey order by line) as bigint) as last from k) select l_orderkey, line, last as "end", cast(last - kept as bigint) as start from e""")
def gapless_program(spark, sf_dir):
    q = _queue(spark, sf_dir).drop("start", "end").withColumns({"head": F.col("line"), "tail": F.col("part") % 3})
    return queues.program(q, "l_orderkey", "line", "len_", "head", "tail").select("l_orderkey", "line", "end", "start")


@query("play_order", "select l_orderkey, disc, line, row_number() over (partition by l_orderkey order by disc, line) - 1 as place from (select distinct l_orderkey, l_linenumber as line, case when l_linenumber % 2 = 0 then 1 else 2 end as disc from lineitem)")
def play_order(spark, sf_dir):
    t = read(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(2).alias("disc"), F.col("l_linenumber").alias("line")).distinct()
    return queues.play_order(t, "l_orderkey", "disc", "line").withColumn("place", F.col("place").cast("long"))


@query("cached_blocks")
def cached_blocks(spark, sf_dir):
    r = read(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * 7919 % 3000000).alias("s"), (F.col("event_id") % 200000).alias("n"))
    return queues.cached_blocks(r, "user_id", "event_id", "s", "n")


@query("seek_thinned", _EVENTS + ", n as (select user_id, v, row_number() over (partition by user_id order by event_id) - 1 as i from e) select user_id, i // 4 as entry, v as value from n where i % 4 = 0")
def seek_thinned(spark, sf_dir):
    from pyspark.sql import Window as W

    e = _events(spark, sf_dir).withColumn("entry", (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).cast("long"))
    d = ops.from_second_difference(ops.second_difference(e, "user_id", "entry", "v"), "user_id", "entry", "delta")
    return ops.thinned(d, "entry", 2).select("user_id", "entry", "value")


@query("frame_chapters", f"""
with f as (select user_id, frame * 100 as "from", frame * 100 + 100 as "to" from ({_FRAMES})), m as (select distinct user_id, event_id * 37 % 900 as mark from events),
c as (select f.user_id, f."from" as a, f."to" as b, m.mark from f left join m on m.user_id = f.user_id and m.mark > f."from" and m.mark < f."to"),
s as (select user_id, a as s, b from c union select user_id, mark, b from c where mark is not null),
p as (select user_id, s as "from", coalesce(lead(s) over (partition by user_id, b order by s), b) as "to" from s)
select p.*, (select max(mark) from m where m.user_id = p.user_id and m.mark <= p."from") as chapter from p""")
def frame_chapters(spark, sf_dir):
    f = _frames(spark, sf_dir).select("user_id", (F.col("frame") * 100).alias("start"), F.lit(100).cast("long").alias("len_"))
    m = read(spark, sf_dir, "events").select("user_id", (F.col("event_id") * 37 % 900).alias("mark"))
    return ops.split_at(f, m, "user_id", "start", "len_", "mark")


@query("blocks_read", "with r as (select event_id * 1000 % 5000000 as s, event_id % 200000 as n from events) select distinct b as block from (select unnest(range(cast(s // 65536 as bigint), cast((s + n - 1) // 65536 + 1 as bigint))) as b from r where n > 0)")
def blocks_read(spark, sf_dir):
    r = read(spark, sf_dir, "events").select((F.col("event_id") * 1000 % 5000000).alias("s"), (F.col("event_id") % 200000).alias("n"))
    return ops.blocks_read(r, "s", "n")
