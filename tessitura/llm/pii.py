"""Personal data: high-recall generators propose spans, boosted trees on format and context features
score them, thresholds calibrated on held-out candidates select redactions.

All of it is DataFrame and SQL functions. Statistics come from every candidate of the input: their counts
by feature pattern, a table of at most 5 * 2**16 rows, are what the driver fits the trees on.

Labels come from checks that no feature sees: the check sum of a card, account or number, the ranges of an address, the
numbering plan of a phone, the form of a domain. They are not the base rules: a base span that fails its check is still
returned, but as a negative for the trees, and account numbers have labels though no base kind has them. Proposals that
nothing can check (local phones, written e-mails) are scored in the form of the kind that they stand for. Each family of
kinds has the threshold that held-out candidates of that family give; a family without any has that of all together.

Defined results: null text counts as empty; an empty text has no spans, zero counts and the hash of the
empty string; rows are independent, so repeated rows, ties and null ids keep a row each; an empty table
gives an empty result; other input columns, whatever their names, are ignored by `find`, kept by `redact`. The work on a
text grows with its length and the number of its spans, not with their square.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import boost
from tessitura.llm.common import CHUNK, let, packed, running, spans_of, staged, table

LOCAL = "A-Za-z0-9._%+\u0001-"
#: Patterns over a copy of the text in which a dot between label characters (for emails) or a space or hyphen
#: between digits (for cards) is U+0001: then every repetition is of one character class, which Java's
#: engine matches in a loop and not by recursion, however long the run is.
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]+"
CARD = r"[0-9][0-9\x01]*[0-9]"
IP = r"[0-9](?<![0-9]{2})[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generators beyond the base kinds. Patterns test a character before they look behind it: that fails fast.
AT = r"[\[(]at[\])]"
WRITTEN_EMAIL = rf"[A-Za-z0-9._-](?<![A-Za-z0-9._-]{{2}})[A-Za-z0-9._-]{{1,63}}\x20?{AT}\x20?[A-Za-z0-9-]{{2,63}}\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z]{{2,12}}"
LOCAL_PHONE = r"[(0-9](?<![0-9+.-][(0-9])(?:(?<=\()[0-9])?[0-9]{2}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
NUMBER = r"[0-9](?<![0-9A-Za-z][0-9])(?:[0-9]{2}-[0-9]{2}-[0-9]{4}|[0-9]{8,18})(?![0-9A-Za-z])"
IBAN = r"[A-Z](?<![0-9A-Za-z][A-Z])[A-Z][0-9]{2}[A-Z0-9]{11,30}(?![0-9A-Za-z])"
DIGITS = r"[0-9](?:[\x20-]?[0-9]){8}"

BASE = ("email", "ip", "card", "phone")
ADDED = ("email_like", "ip_like", "card_like", "phone_like", "number_like")
ORDER = {k: i for i, k in enumerate(BASE + ADDED)}
FAMILY = {k: k.removesuffix("_like") for k in BASE + ADDED}
N_FEATURES = 15


def _luhn(d: str) -> str:
    step = f"cast(substring(if(i % 2 = 0, '0246813579', '0123456789'), cast(substring({d}, length({d}) - i + 1, 1) as int) + 1, 1) as int)"
    return f"aggregate(sequence(1, length({d})), 0, (s, i) -> s + {step}) % 10 = 0"


_VALID = {
    "email": "true",
    "ip": r"forall(split(x.v, '[.]'), q -> q rlike '^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$')",
    "card": f"length(x.d) between 14 and 19 and {_luhn('x.d')}",
    "phone": "length(x.d) between 10 and 15",
}
_LETTERS = "aggregate(filter(split(concat(substring(x.v, 5), substring(x.v, 1, 4)), ''), q -> q <> ''), 0, (s, q) -> if(q between '0' and '9', s * 10 + cast(q as int), s * 100 + ascii(q) - 55) % 97)"
#: Whether a candidate passes the check of its generator; null where there is none.
_LABEL = {
    "email": r"x.v rlike '[A-Za-z0-9]\\x01[A-Za-z]{2,24}$' and not x.v rlike '^[\\x01.-]|[\\x01.]@|@-|-\\x01|\\x01-'",
    "ip": f"{_VALID['ip']} and not x.v rlike '(^|[.])0[0-9]'",
    "card": _VALID["card"],
    "phone": r"length(x.d) between 10 and 15 and x.v rlike '^\\+[1-9]'",
    "number": f"if(x.v rlike '-', cast(null as boolean), {_luhn('x.d')})",
    "iban": f"{_LETTERS} = 1",
}
#: Forms that base kinds and added generators share, so that what has no label has the features of what has one: an
#: e-mail with its signs; a phone with a country code, without brackets and dots.
_PLAIN_EMAIL = r"regexp_replace(regexp_replace(x.v, '\\x20?[\\[(]at[\\])]\\x20?', '@'), '\\x20?(?:[.]|[\\[(]dot[\\])])\\x20?', '\u0001')"
_PHONE = "translate({}, '().', '   ')"
#: Format features from the span, context features from the 24 characters before it.
_FEATURES = (
    "length(x.d) >= 9",
    "length(x.d) >= 11",
    "length(x.d) >= 14",
    "length(x.d) >= 17",
    "x.c rlike '[A-Za-z0-9]$'",
    r"x.v rlike '[\\x01 -]'",
    "instr(x.v, '.') > 0",
    "startswith(x.v, '+')",
    "x.v rlike '[A-Za-z]'",
    "x.v rlike '@|[(\\\\[]at'",
    "length(x.v) > 18",
    "lower(x.c) rlike 'mail|write|contact'",
    "lower(x.c) rlike 'phone|tel|call|mobile|fax'",
    "lower(x.c) rlike 'card|visa|pay|credit|account'",
    "lower(x.c) rlike 'ip|host|server|address'",
)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, text, cand): the columns of docs as a struct, the text, and the proposed spans sorted by start: a, whether it is
    no base span (n), end b, kind k, feature mask f, label l (null: none), half h and whether a word goes on after it (w). Proposals of different kinds
    may overlap; what a base span covers whole is no proposal of its own."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = packed(docs, text=docs[text], t=F.when(F.contains(t, F.lit("\u0001")), F.translate(t, "\u0001", "\u0002")).otherwise(t))
    d = d.withColumns({"at": F.contains("t", F.lit("@")), "plus": F.contains("t", F.lit("+")), "num": F.col("t").rlike("[0-9]")})
    d = d.withColumn("long", F.col("num") & F.col("t").rlike(DIGITS))
    d = d.withColumns({
        "te": F.when(F.col("at"), F.regexp_replace("t", r"\.(?<=[A-Za-z0-9-]\.)(?=[A-Za-z0-9-])", "\u0001")),
        "tc": F.when(F.col("long"), F.regexp_replace("t", r"[\x20-](?<=[0-9][\x20-])(?=[0-9])", "\u0001")),
    })
    num = F.col("num")
    d = spans_of(d, "te", {"email": (EMAIL, F.col("at"))})
    d = spans_of(d, "tc", {"card": (CARD, F.col("long"))})
    d = spans_of(d, "t", {"ip": (IP, num), "phone": (PHONE, F.col("plus")), "wmail": (WRITTEN_EMAIL, F.col("t").rlike(AT)), "lphone": (LOCAL_PHONE, num), "number": (NUMBER, num), "iban": (IBAN, num)})

    def made(col: str, base: str | None, like: str, label: str, v: str = "x.v") -> str:
        digits = f"transform(transform({col}, x -> named_struct('a', x.a, 'b', x.b, 'v', {v}, 'c', x.c, 'e', x.e)), x -> named_struct('a', x.a, 'b', x.b, 'v', x.v, 'c', x.c, 'e', x.e, 'd', regexp_replace(x.v, '[^0-9]', '')))"
        valid = _VALID[base] if base else "false"
        mask = " | ".join(f"if({f}, {1 << i}, 0)" for i, f in enumerate(_FEATURES))
        return f"""transform({digits}, x -> named_struct('a', x.a, 'n', not ({valid}), 'b', x.b, 'k', if({valid}, '{base or like}', '{like}'), 'f', {mask}, 'l', {label}, 'h', pmod(xxhash64(x.v), 2L) = 0, 'w', x.e rlike '[A-Za-z0-9]'))"""

    none = "cast(null as boolean)"
    parts = [made(k, k, f"{k}_like", _LABEL[k], _PHONE.format("x.v") if k == "phone" else "x.v") for k in BASE]
    # fewer than 9 digits, or digits that go on as a word, pass no rule and are no proposal either
    parts[2] = f"filter({parts[2]}, x -> not x.n or ((x.f & 1) <> 0 and (x.f & 16) = 0 and not x.w))"
    parts += [made("wmail", None, "email_like", none, _PLAIN_EMAIL), made("lphone", None, "phone_like", none, _PHONE.format("concat('+1 ', x.v)"))]
    parts += [made(k, None, "number_like", _LABEL[k]) for k in ("number", "iban")]
    # base spans come first of those with one start, so the furthest end of base spans so far tells what is covered
    covered = running(f"sort_array(concat({', '.join(parts)}))", "if(x.n, 0, x.b)", "greatest($p, $q)", "0", "named_struct('x', x, 'keep', not x.n or p < x.b)")
    return d.select("row", "text", F.expr(f"transform(filter({covered}, y -> y.keep), y -> y.x)").alias("cand"))


def fit(cand: DataFrame, precision: float = 0.9, rounds: int = 16) -> tuple[list[boost.Tree], dict[str, float]]:
    """Trees, and the score threshold of each family. Half of the labelled candidates, by the hash of the matched text, fit
    the trees and the other half calibrates. The driver gets counts by family and pattern."""
    x = cand.select(F.explode(F.expr("filter(cand, x -> x.l is not null)")).alias("x"))
    family = F.regexp_replace("x.k", "_like$", "").alias("k")
    counts = x.groupBy(family, F.col("x.h").alias("h"), F.col("x.f").alias("f")).agg(F.count("*").alias("n"), F.sum(F.col("x.l").cast("long")).alias("p")).collect()
    rows = sorted((r.k, r.h, r.f, r.n, r.p) for r in counts)
    trees = boost.fit([r[2:] for r in rows if r[1]], N_FEATURES, rounds)
    held = [r for r in rows if not r[1]]
    own = {k: [r[2:] for r in held if r[0] == k] for k in FAMILY.values()}
    # what is less likely than not is never taken, however few candidates calibrate
    return trees, {k: max(0.0, boost.calibrate(trees, v or [r[2:] for r in held], precision)) for k, v in own.items()}


def selected(cand: DataFrame, trees: list[boost.Tree], thresholds: dict[str, float]) -> DataFrame:
    """cand with `spans` in place of the candidates: base spans, and the added ones with the score of their family, sorted by
    start, kind and end. Of equal proposals one stays."""
    order = "element_at(map(" + ", ".join(f"'{k}', {i}" for k, i in ORDER.items()) + "), x.k)"
    limit = " ".join(f"when '{k}' then {thresholds[FAMILY[k]]!r}D" for k in ADDED if thresholds[FAMILY[k]] < float("inf"))
    keep = f"not x.n or ({boost.score_sql(trees, 'x.f')}) >= case x.k {limit} end" if limit else "not x.n"
    spans = f"sort_array(transform(filter(cand, x -> {keep}), x -> named_struct('a', x.a, 'o', {order}, 'b', x.b, 'k', x.k)))"
    return cand.withColumn("spans", F.expr(let("z", spans, "filter(z, (x, i) -> i = 0 or x <> z[i - 1])"))).drop("cand")


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text", precision: float = 0.9) -> DataFrame:
    """One row per document with the counts of base spans and all spans as text."""
    own = docs.select(F.col(id_col), F.col(text).alias("text"))
    cand = staged(candidates(own, "text").select(F.col(f"row.`{id_col}`").alias("id"), "cand"), "pii-candidates")
    d = selected(cand, *fit(cand, precision))
    joined = "array_join(transform({0}, x -> concat(x.k, ':', x.a, ':', x.b)), ',')"
    return d.select(
        F.col("id").alias(id_col),
        *(F.expr(f"cast(size(filter(spans, x -> x.k = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE),
        F.sha2(F.expr(joined.format(f"filter(spans, x -> x.o < {len(BASE)})")), 256).alias("base_sha256"),
        F.expr(joined.format("spans")).alias("spans"),
        F.expr("cast(size(spans) as bigint)").alias("n_spans"),
    )


def _replaced() -> str:
    """SQL of `text` with its `spans` replaced. The text is cut at every CHUNK-th span first, since a substring is found by
    counting from the start of what it is taken from."""
    marked = running("spans", "x.b", "greatest($p, $q)", "0", "named_struct('a', x.a, 'p', p, 'k', x.k)")
    # a span that begins before the furthest end so far is part of the one before it
    piece = "concat(substring(t, x.p - p0 + 1, x.a - x.p), '[', upper(x.k), ']')"
    part = let("y", f"slice(m, k * {CHUNK} + 1, {CHUNK})", let("p0", "y[0].p", let("t", "substring(text, p0 + 1, element_at(y, -1).a - p0)", f"array_join(transform(y, x -> {piece}), '')")))
    body = f"concat(array_join(transform(sequence(0, cast(ceil(size(m) / {CHUNK}) as int) - 1), k -> {part}), ''), substring(text, array_max(transform(spans, x -> x.b)) + 1))"
    return f"if(text is null or size(spans) = 0, text, {let('m', f'filter({marked}, x -> x.a >= x.p)', body)})"


def redact(docs: DataFrame, text: str = "text", precision: float = 0.9) -> DataFrame:
    """docs with every selected span of `text` replaced by its kind in brackets; overlapping spans merge into the
    first one's. A null text stays null. All columns are kept, in order."""
    cand = staged(candidates(docs, text), "pii-documents")
    d = selected(cand, *fit(cand, precision)).withColumn("text", F.expr(_replaced()))
    return d.select(*(F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
