"""Mixing sources to target weights along a time-varying curriculum.

Sources, by code point with null last, weigh 1, 2, 3, repeating, and share all words; a source's target stops at
`max_epochs` times its size and the excess goes to the others by weight until none is above (water filling, in
closed form over the sources sorted by cap per weight).

A source's rate over training progress t in [0, 1] is target * (1 + slope * (2 t - 1)), with slopes -1/2, 0, 1/2
repeating, so its cumulative demand is target * (t + slope * (t**2 - t)). The documents of a source stand in an order
drawn by hash; word c of its stream, repeated as often as the target asks, is trained on at the t at which the
cumulative demand reaches c: the integral inverted by its quadratic formula. Each copy of a document has the position
of its own first word, `source_size` words after the copy before; copies sorted by position are the training order.

The running word counts per source come from two levels: a source of n documents has the square root of n bins of
about as many documents each; sums by bin give the bin's start, and a window inside the bin the rest. The draw takes in
id and text, and rows alike in id, source and text are one row with a count until the counts are done. No task sees a
whole source, nor more than the square root of its rows at once. The table of sources, one row each, is sorted in one task.

Defined results: a null or empty text has size 0 and takes 0; where all sizes are 0 so are the targets; null
sources are one source; documents with equal draws are alike; repeated rows each have a place; an empty table gives
an empty result; of the input's columns only the named ones are used, and `apply` keeps all others, whatever their names.
All of it is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.llm.common import packed, staged, table

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, max_epochs: int = 3) -> DataFrame:
    """sizes (source, size) by document to one row per source: rank, rows, source_size, weight, slope, target."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    s = s.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("weight", F.col("rank") % 3 + 1).withColumn("slope", ((F.col("rank") % 3) - 1) / F.lit(2.0))
    s = s.withColumn("cap", F.col("source_size") * max_epochs)
    by = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("open", F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing)))
    total = F.sum("source_size").over(W.partitionBy())
    # the level at which this source and all later ones would stand if all earlier ones were at their caps
    s = s.withColumn("level", (total - F.col("capped")) / F.col("open"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    level = F.coalesce(F.first(fits, ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.lit(0.0))
    s = s.withColumn("final", level)
    s = s.withColumn("target", F.least(F.col("final") * F.col("weight"), F.col("cap").cast("double")))
    return s.select("source", "rank", "rows", "source_size", "weight", "slope", "target")


def position(words: Column, target: Column, slope: Column) -> Column:
    """The t in [0, 1] at which the cumulative demand reaches so many words."""
    x = F.least(words / target, F.lit(1.0))
    return F.when(target > 0, 2 * x / (1 - slope + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * x)))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", max_epochs: int = 3) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words, repeats counted), `whole` (full repeats),
    `part` (words of the last, partial one), `positions` (of each copy's first word, in order), `position` (the first of
    them, null if none is taken), `start` (the source's words before it), `slope`, `draw`, and `tie`, a digest of the text."""
    d = docs.select(
        F.col(id_col).alias("id"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(text), F.lit(""))).alias("tie"),
    )
    d = staged(d, "mix-sizes")
    t = staged(targets(d, max_epochs), "mix-targets")
    d = d.groupBy("id", "source", "size", "tie").agg(F.count("*").alias("n"))
    d = d.withColumn("draw", F.sha2(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), "tie"), 256))
    d = d.join(t, d["source"].eqNullSafe(t["source"])).drop(t["source"])
    # the first 28 bits of the draw as a fraction choose the bin, so bins follow each other in the drawn order
    share = F.conv(F.substring("draw", 1, 7), 16, 10).cast("long") / F.lit(float(16**7))
    d = d.withColumn("bin", F.floor(share * F.ceil(F.sqrt("rows"))).cast("int"))
    bins = d.groupBy("rank", "bin").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    starts = bins.select("rank", "bin", (F.sum("words").over(W.partitionBy("rank").orderBy("bin")) - F.col("words")).alias("bin_start"))
    # only rows of null and of not null id with the same draw could tie, so the id decides
    inside = W.partitionBy("rank", "bin").orderBy("draw", "id").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("upto", F.sum(F.col("size") * F.col("n")).over(inside)).join(starts, ["rank", "bin"])
    d = d.withColumn("again", F.explode(F.expr("sequence(0L, n - 1)")))
    d = d.withColumn("start", F.col("bin_start") + F.col("upto") - F.col("size") * (F.col("n") - F.col("again")))
    words = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = words - whole * F.col("source_size")
    part = F.least(F.greatest(rest - F.col("start"), F.lit(0)), F.col("size"))
    d = d.withColumns({"whole": whole, "part": part})
    d = d.withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))
    copies = F.when(F.col("size") > 0, F.col("whole")).otherwise(F.lit(0)) + F.when(F.col("part") > 0, 1).otherwise(0)
    at = lambda i: position((F.col("start") + i * F.col("source_size")).cast("double"), F.col("target"), F.col("slope"))
    positions = F.when(copies > 0, F.transform(F.sequence(F.lit(0).cast("long"), copies - 1), at)).otherwise(F.array().cast("array<double>"))
    d = d.withColumn("positions", positions)
    return d.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "whole", "part", F.try_element_at("positions", F.lit(1)).alias("position"), "positions", "start", "slope", "draw", "tie")


def training_order(mixed: DataFrame) -> DataFrame:
    """Range-sorted by position; documents of which nothing is taken come last, spread by their draw."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), "draw")


def apply(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs as the mix takes them: each document as often as it is repeated, the last, partial repeat with the first
    `part` words of its text up to the end of the last of them, in training order: each repeat at the position of its own
    first word in the source's repeated stream. Rows that repeat both id and text are placed together, by the first of
    them. All columns of docs are kept, in order."""
    first = F.min(F.struct("position", "draw", "whole", "part", "positions"))
    plan = mixed.where("taken > 0").groupBy(F.col(id_col).alias("plan_id"), F.col("tie").alias("plan_tie")).agg(first.alias("p"))
    d = packed(docs, id=docs[id_col], text=docs[text], tie=F.md5(F.coalesce(docs[text], F.lit(""))))
    d = d.join(plan, d["id"].eqNullSafe(F.col("plan_id")) & (F.col("tie") == F.col("plan_tie")))
    d = d.select("row", "text", "p", F.posexplode("p.positions").alias("copy", "position"))
    # words that follow each other, each with the white space before it
    runs = F.expr(r"slice(regexp_extract_all(text, '[\\x20\\x09-\\x0D]*+[^\\x20\\x09-\\x0D]++', 0), 1, cast(p.part as int))")
    cut = F.when(F.col("copy") >= F.col("p.whole"), F.array_join(runs, "")).otherwise(F.col("text"))
    d = d.withColumn("text", cut)
    out = [F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return d.orderBy("position", "p.draw", "copy").select(*out)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = training_order(mix(table(spark, sf_dir, "documents")))
    nano = F.array_join(F.transform("positions", lambda x: F.round(x * 1e9).cast("long").cast("string")), ",")
    return m.select("doc_id", "size", "source_size", "target", "taken", nano.alias("positions"))


#: Targets by water filling as its definition has it: the level is found by filling, source after source. Positions solve
#: the cumulative demand for each copy's first word by Newton's rule, from what the schedule says, not from its inverse.
OP2_SQL = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         sha256(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as draw from documents),
s0 as (select source, cast(sum(size) as bigint) as source_size from d group by source),
s1 as (select *, row_number() over (order by source nulls last) - 1 as rank from s0),
s2 as (select *, rank % 3 + 1 as weight, (rank % 3 - 1) / 2.0::double as slope, source_size * 3 as cap from s1),
s3 as (select *,
         coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0) as capped,
         sum(weight) over (order by cap / weight, rank rows between current row and unbounded following) as open,
         sum(source_size) over () as total from s2),
s4 as (select *, cast(total - capped as double) / cast(open as double) as level from s3),
s5 as (select *, (select x.level from s4 x where x.level * x.weight <= x.cap order by x.cap / x.weight, x.rank limit 1) as final from s4),
s6 as (select *, least(coalesce(final, 0) * weight, cast(cap as double)) as target from s5),
e as (select d.doc_id, d.size, s6.source_size, s6.target, s6.slope, cast(round(s6.target) as bigint) as words,
        cast(sum(d.size) over (partition by s6.rank order by d.draw, d.doc_id rows unbounded preceding) as bigint) - d.size as start
      from d join s6 on d.source is not distinct from s6.source),
c as (select *, list_filter([start, start + source_size, start + 2 * source_size], lambda w: size > 0 and w < words) as firsts from e),
g as (select *, cast(coalesce(list_sum(list_transform(firsts, lambda w: least(size, words - w))), 0) as bigint) as taken,
  list_transform(firsts, lambda w: list_reduce(list_concat([least(w / target, 1.0::double)], list_transform(range(9), lambda i: 0.0::double)),
    lambda t, i: t - (target * (t + slope * (t * t - t)) - w) / (target * (1 + slope * (2 * t - 1))))) as places from c)
select doc_id, size, source_size, target, taken,
  array_to_string(list_transform(places, lambda t: cast(round(t * 1e9) as bigint)), ',') as positions
from g
"""
