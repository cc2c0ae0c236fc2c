"""What the corpus operators share: tables, scratch space and native span building."""

from __future__ import annotations

from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura import session
from tessitura.llm import words
from tessitura.session import scratch_dir

__all__ = ["scratch_dir", "staged", "give_back", "table", "ship", "packed", "hot_keys", "spread_join", "let", "running", "spans_of", "NO_SPANS"]


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers started by this session import the library."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH")) if x)
    return spark


def give_back(spark: SparkSession) -> str:
    """What the driver's Python and the native side of its JVM have freed goes back to the system; the allocator keeps it
    otherwise, most of it what the compilers of hundreds of plans had. Gives the JVM's report, empty if it can't do this."""
    words.release()
    context = spark.sparkContext
    java = context._jvm.java.lang
    try:
        name = context._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        args = context._gateway.new_array(java.Object, 4)
        args[0], args[1] = name, "systemTrimNativeHeap"
        # the server's class isn't open to reflection, its interface is
        invoke = next(m for m in java.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        return invoke.invoke(java.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:  # another kind of JVM, or one before 17.0.9
        return ""


def staged(df: DataFrame, name: str, compression: str = "zstd", **options) -> DataFrame:
    """As the session's; an operator of many plans has its driver give back freed memory after each."""
    out = session.staged(df, name, compression, **options)
    give_back(df.sparkSession)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


NO_SPANS = "cast(array() as array<struct<a:int,b:int,v:string,c:string,e:string>>)"
#: Items that a running fold appends to one array; a longer input is folded in chunks of as many.
CHUNK = 256


#: A key that more than one row in so many has is hot: there are fewer than so many such keys.
HOT = 1_000


def hot_keys(facts: DataFrame, key: str, total: int) -> list:
    """The hot keys, less than HOT, of facts with the number n of rows for each key."""
    return [r[0] for r in facts.where(F.col("n") * HOT > total).select(key).collect()]


def spread_join(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined to facts, one row of fixed size for each key, with the number n of rows that have it. Facts of hot keys are
    broadcast, so their rows stay where they are; the rest is an ordinary join."""
    hot = hot_keys(facts, key, total)
    if not hot:
        return rows.join(facts, key)
    is_hot = F.col(key).isin(hot)
    return rows.where(is_hot).join(F.broadcast(facts.where(is_hot)), key).unionByName(rows.where(~is_hot).join(facts.where(~is_hot), key))


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """All columns of docs as one struct `row`, beside the named ones: no name of the caller's can clash."""
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)) if docs.columns else F.struct()
    return docs.select(row.alias("row"), *(c.alias(n) for n, c in columns.items()))


def let(name: str, value: str, body: str) -> str:
    """SQL of body in which `name` is value, computed once: names inside lambdas are not copies of their expression."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def running(items: str, value: str, combine: str, zero: str, emit: str) -> str:
    """SQL of the array of emit(x, p) over the items x, p being the running fold of value(x) over the items before.
    `combine` folds p and q; it must be associative, with `zero` as its neutral element.

    An array that grows by one is copied each time. So chunks are folded first, then their totals, and then each chunk
    on its own from its start: copies are bound by the chunk and the number of chunks.
    """
    step = lambda p, q: combine.replace("$p", p).replace("$q", q)
    chunk = f"slice(z, k * {CHUNK} + 1, {CHUNK})"
    total = f"aggregate({chunk}, {zero}, (p, x) -> {step('p', value)})"
    starts = f"""aggregate(transform(ks, k -> {total}), named_struct('p', {zero}, 's', array_remove(array({zero}), {zero})),
        (acc, t) -> named_struct('p', {step('acc.p', 't')}, 's', concat(acc.s, array(acc.p))), acc -> acc.s)"""
    body = f"""aggregate({chunk}, named_struct('p', p0, 's', filter(transform(slice(z, 1, 1), x -> {let('p', zero, emit)}), x -> false)),
        (acc, x) -> named_struct('p', {step('acc.p', value)}, 's', concat(acc.s, array({let('p', 'acc.p', emit)}))), acc -> acc.s)"""
    inner = f"flatten(zip_with(ks, {starts}, (k, p0) -> {body}))"
    return let("z", items, let("ks", f"sequence(0, cast(ceil(greatest(size(z), 1) / {CHUNK}) as int) - 1)", inner))


def spans_of(df: DataFrame, text: str, found: dict[str, tuple[str, Column]], context: int = 24) -> DataFrame:
    """For each name -> (pattern, guard) add a column `name`, an array of structs (a, b, v, c, e): start and end in
    code points (end exclusive), the matched text, up to `context` characters before it and the one after it. A guard is a cheaper
    condition that any text with a match meets; the pattern runs on those texts.

    The matches come from regexp_extract_all and the gaps between them from split with the same pattern;
    a running sum over both gives the positions, so no character is looked at outside the regex engine.
    `text` must not be null.
    """
    none = F.array().cast("array<string>")
    raw = {f"__m_{k}": F.when(guard, F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))).otherwise(none) for k, (p, guard) in found.items()}
    df = df.withColumns(raw)
    gaps: dict[str, Column] = {f"__g_{k}": F.when(F.size(f"__m_{k}") > 0, F.split(F.col(text), p, -1)) for k, (p, _) in found.items()}
    df = df.withColumns(gaps)
    emit = f"named_struct('a', p + length(x.g), 'b', p + length(x.g) + length(x.m), 'v', x.m, 'c', right(x.g, {context}), 'e', left(x.e, 1))"

    def spans(k: str) -> str:
        items = f"zip_with(__m_{k}, zip_with(slice(__g_{k}, 1, size(__m_{k})), slice(__g_{k}, 2, size(__m_{k})), (g, e) -> named_struct('g', g, 'e', e)), (m, y) -> named_struct('m', m, 'g', y.g, 'e', y.e))"
        return f"if(size(__m_{k}) = 0, {NO_SPANS}, {running(items, 'length(x.g) + length(x.m)', '$p + $q', '0', emit)})"

    return df.withColumns({k: F.expr(spans(k)) for k in found}).drop(*raw, *gaps)
