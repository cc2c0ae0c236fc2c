"""Secrets: base patterns, and a randomness test battery for other tokens.

A token of 16 or more encoding characters with letters and digits is a proposal. Its encoding is inferred (hex,
base32, base62, base64); three tests look at its symbols: chi-squared against a uniform alphabet, runs above and
below the middle of the alphabet, and lag-one serial correlation. Its p-value is three times the smallest of the
three, at most 1: large where nothing speaks against randomness.

False discoveries are controlled by length. Words of letters only, of 16 or more, go through the same tests; how many
of them reach a p-value tells how often text that isn't random does. Tests get stronger with length, so the words
of a length and of all shorter lengths serve as the decoys of that length. Per length class the threshold is the
smallest p-value at which the expected share of false finds is at most `fdr`. The counts cover every token; the
driver gets them by length class and p-value bin, at most 2 * 32 * 21 rows.

Defined results: null text counts as empty; an empty text has no spans, zero counts and the hash of the empty
string; each input row gives one row, also for repeated rows and null ids; an empty table gives an empty result. Where
the corpus has too few words of letters only and of 16 or more, the decoys can't bound the rate and no token is taken.
All of it is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm.common import packed, running, spans_of, staged, table

ASSIGN = r"""(?=[PpSsTtAa])(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
#: The same up to group 2, to measure that group.
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-](?<![A-Za-z0-9+/_-]{2})[A-Za-z0-9+/_-]{15,}+={0,2}"
KINDS = ("assign", "access", "hex", "random")
BINS = 20

_P = "2 * (1 - 1 / (1 + exp(-least(1.5976 * abs({z}) + 0.070565992 * pow(abs({z}), 3), 700))))"


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, base, tokens): the columns of docs as a struct, base spans (a, o, b, k) and tokens (a, b, target, l, p); target
    tells a proposal from a decoy word."""
    d = packed(docs, t=F.coalesce(docs[text], F.lit("")))
    some = F.lit(True)
    d = d.withColumns({"set": F.contains("t", F.lit("=")) | F.contains("t", F.lit(":")), "akia": F.contains("t", F.lit("AKIA"))})
    d = spans_of(d, "t", {"assign": (ASSIGN, F.col("set")), "access": (ACCESS, F.col("akia")), "hex": (HEX, some), "tok": (TOKEN, some)}, context=0)
    span = "transform({0}, x -> named_struct('a', x.a, 'o', {1}, 'b', x.b, 'k', '{0}'))"
    d = d.withColumn("assign", F.filter("assign", lambda x: F.length(F.regexp_replace(x["v"], ASSIGN_HEAD, "")) >= 6))
    d = d.withColumn("base", F.expr(f"concat({', '.join(span.format(k, i) for i, k in enumerate(KINDS[:3]))})"))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    d = d.withColumn("tok", F.expr("""filter(transform(tok, x -> named_struct('a', x.a, 'b', x.b,
        'target', x.v rlike '[0-9]' and x.v rlike '[A-Za-z]', 'decoy', x.v rlike '^[A-Za-z]+$', 'w', translate(x.v, '-_=', '+/'))),
        x -> x.target or x.decoy)"""))
    d = d.withColumn("tok", F.expr(f"""transform(tok, x -> named_struct('a', x.a, 'b', x.b, 'target', x.target,
        'w', if(x.w rlike '^[0-9A-F]+$', lower(x.w), x.w), 'n', length(x.w),
        'al', case when x.w rlike '^([0-9a-f]+|[0-9A-F]+)$' then '{digits}abcdef'
                   when x.target and x.w rlike '^[A-Z2-7]+$' then '{upper}234567'
                   when x.w rlike '^[A-Za-z0-9]+$' then '{upper}{lower}{digits}'
                   else '{upper}{lower}{digits}+/' end))"""))
    d = d.withColumn("tok", F.expr("""transform(tok, x -> named_struct('a', x.a, 'b', x.b, 'target', x.target, 'n', x.n,
        'k', length(x.al),
        'sq', aggregate(filter(split(x.al, ''), c -> c <> ''), 0D, (s, c) -> s + pow(x.n - length(replace(x.w, c, '')), 2)),
        'v', transform(filter(split(x.w, ''), c -> c <> ''), c -> cast(instr(x.al, c) - 1 as double))))"""))
    d = d.withColumn("tok", F.expr("""transform(tok, x -> named_struct('a', x.a, 'b', x.b, 'target', x.target, 'n', x.n, 'k', x.k,
        'chi', x.sq * x.k / x.n - x.n,
        'm', aggregate(x.v, 0D, (s, q) -> s + q) / x.n,
        'n1', aggregate(x.v, 0D, (s, q) -> s + if(2 * q >= x.k, 1, 0)),
        'runs', 1 + aggregate(zip_with(slice(x.v, 1, x.n - 1), slice(x.v, 2, x.n - 1), (p, q) -> if((2 * p >= x.k) <> (2 * q >= x.k), 1D, 0D)), 0D, (s, q) -> s + q),
        'lag', aggregate(zip_with(slice(x.v, 1, x.n - 1), slice(x.v, 2, x.n - 1), (p, q) -> p * q), 0D, (s, q) -> s + q),
        'sqv', aggregate(x.v, 0D, (s, q) -> s + q * q)))"""))
    d = d.withColumn("tok", F.expr("""transform(tok, x -> named_struct('a', x.a, 'b', x.b, 'target', x.target, 'n', x.n,
        'zc', (pow(x.chi / (x.k - 1), 1 / 3D) - (1 - 2 / (9D * (x.k - 1)))) / sqrt(2 / (9D * (x.k - 1))),
        'zr', if(x.n1 = 0 or x.n1 = x.n, 9D, (x.runs - 1 - 2 * x.n1 * (x.n - x.n1) / x.n) /
              sqrt(greatest(2 * x.n1 * (x.n - x.n1) * (2 * x.n1 * (x.n - x.n1) - x.n) / (pow(x.n, 2) * (x.n - 1)), 0.01D))),
        'zs', if(x.sqv - x.n * x.m * x.m <= 0, 9D, (x.lag - (x.n - 1) * x.m * x.m) / (x.sqv - x.n * x.m * x.m) * sqrt(x.n))))"""))
    low = "least(" + ", ".join(_P.format(z=f"x.{z}") for z in ("zc", "zr", "zs")) + ")"
    d = d.withColumn("tokens", F.expr(f"transform(tok, x -> named_struct('a', x.a, 'b', x.b, 'target', x.target, 'l', cast(least(log2(x.n), 31) as int), 'p', least(1D, 3 * {low})))"))
    return d.select("row", "base", "tokens")


def thresholds(cand: DataFrame, fdr: float = 0.05) -> dict[int, float]:
    """By length class (floor of the base-2 logarithm of the length) the p-value from which on tokens are taken."""
    x = cand.select(F.explode("tokens").alias("x"))
    counts = x.groupBy(F.col("x.l").alias("l"), F.col("x.target").alias("t"), F.floor(F.col("x.p") * BINS).cast("int").alias("bin")).count().collect()
    out: dict[int, float] = {}
    for l in sorted({r.l for r in counts}):
        targets = [(r.bin, r["count"]) for r in counts if r.t and r.l == l]
        decoys = [(r.bin, r["count"]) for r in counts if not r.t and r.l <= l]
        total = sum(n for _, n in targets)
        for b in range(1, BINS + 1):  # bin 0 holds what a test rejects at 5 percent
            found = sum(n for k, n in targets if k >= b)
            rate = (sum(n for k, n in decoys if k >= b) + 1) / (sum(n for _, n in decoys) + 1)
            if found and rate * total / found <= fdr:
                out[l] = b / BINS
                break
    return out


def selected(cand: DataFrame, limits: dict[int, float]) -> DataFrame:
    """cand with `spans` in place of base and tokens: base spans, and tokens at or above their length's limit that no base
    span overlaps."""
    case = " ".join(f"when {k} then {v!r}D" for k, v in sorted(limits.items()))
    limit = f"case x.l {case} else 2D end" if limits else "2D"
    found = f"filter(tokens, x -> x.target and x.p >= {limit})"
    # base spans by their start, tokens by their end and before base spans that start there: those with a smaller start
    # have come by then, and the furthest of their ends tells whether one reaches into the token
    items = f"""sort_array(concat(transform(base, x -> named_struct('at', x.a, 'own', true, 'a', x.a, 'o', x.o, 'b', x.b, 'k', x.k)),
        transform({found}, x -> named_struct('at', x.b, 'own', false, 'a', x.a, 'o', 3, 'b', x.b, 'k', 'random'))))"""
    kept = running(items, "if(x.own, x.b, 0)", "greatest($p, $q)", "0", "named_struct('x', x, 'keep', x.own or p <= x.a)")
    spans = f"sort_array(transform(filter({kept}, y -> y.keep), y -> named_struct('a', y.x.a, 'o', y.x.o, 'b', y.x.b, 'k', y.x.k)))"
    return cand.withColumn("spans", F.expr(spans)).drop("tokens", "base")


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text", fdr: float = 0.05) -> DataFrame:
    """One row per document with the counts of base spans and all spans."""
    own = docs.select(F.col(id_col), F.col(text).alias("text"))
    cand = staged(candidates(own, "text").select(F.col(f"row.`{id_col}`").alias("id"), "base", "tokens"), "secret-candidates")
    d = selected(cand, thresholds(cand, fdr))
    joined = "array_join(transform({0}, x -> concat(x.k, ':', x.a, ':', x.b)), ',')"
    return d.select(
        F.col("id").alias(id_col),
        *(F.expr(f"cast(size(filter(spans, x -> x.k = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(F.expr(joined.format("filter(spans, x -> x.o < 3)")), 256).alias("base_sha256"),
        F.expr(joined.format("spans")).alias("spans"),
        F.expr("cast(size(spans) as bigint)").alias("n_spans"),
    )


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
