import zlib

import pytest
from pyspark.sql import functions as F

from tessitura.functions import bits, levels, media, text

RANGES = [  # header, size, state, start, length
    ("bytes=0-1023", 100000, "ok", 0, 1024), ("bytes=1024-", 100000, "ok", 1024, 98976), ("bytes=-4096", 100000, "ok", 95904, 4096),
    ("bytes=-200000", 100000, "ok", 0, 100000), ("bytes=0-0", 1, "ok", 0, 1), ("bytes=0-0", 100, "ok", 0, 1),
    ("bytes=5000-999999", 100000, "ok", 5000, 95000), ("bytes=99999-", 100000, "ok", 99999, 1), ("bytes=100000-", 100000, "unsatisfiable", None, None),
    ("bytes=200000-", 100000, "unsatisfiable", None, None), ("bytes=5-2", 100, "invalid", None, None), ("bytes=0-1,5-6", 100, "invalid", None, None),
    ("items=0-1", 100, "invalid", None, None), ("bytes=-0", 100, "invalid", None, None), ("bytes=abc", 100, "invalid", None, None),
    (None, 100, "invalid", None, None), ("bytes=18446744073709551616-", 100, "invalid", None, None),
]


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_byte_ranges(spark):
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(RANGES)], "i int, h string, size bigint, state string, start bigint, length bigint")
    for r in d.withColumn("r", media.byte_range(F.col("h"), F.col("size"))).collect():
        assert (r.r.state, r.r.start, r.r.length) == (r.state, r.start, r.length), r


def test_crc32_vectors(spark):
    got = one(spark, F.crc32(F.lit("")), F.crc32(F.lit("123456789")), F.crc32(F.lit("The quick brown fox jumps over the lazy dog")))
    assert tuple(got) == (0, 0xCBF43926, 0x414FA339)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 16383, 16384, 2**31, 2**40 + 5, 2**62])
def test_varint_round_trip(spark, n):
    v = bits.varint(F.lit(n).cast("long"))
    row = one(spark, v.alias("v"), bits.from_varint(v).alias("n"), bits.varint_size(F.lit(n).cast("long")).alias("s"))
    assert row.n == n and len(row.v) == row.s and all(b >= 128 for b in row.v[:-1]) and row.v[-1] < 128


def test_fold_is_ascii_only(spark):
    assert one(spark, text.fold(F.lit("ÉaB"))).__getitem__(0) == "Éab"
    assert one(spark, text.holds(F.lit("100% Ä_x"), "0% Ä_X"))[0] and not one(spark, text.holds(F.lit("äb"), "Ä"))[0]


def test_paths(spark):
    good = ["a", "audio/01.flac", "a b/ç", "..a/b.", "x" * 4096]
    bad = ["", "/a", "a//b", "a/", "./a", "a/.", "../a", "a/..", "a\\b", "c:a", "a\nb", "x" * 4097, None]
    d = spark.createDataFrame([(p,) for p in good + bad], "p string").select(text.path_ok(F.col("p"))).collect()
    assert [r[0] for r in d] == [True] * len(good) + [False] * len(bad)


def test_ids_and_paging(spark):
    assert tuple(one(spark, text.strict_id(F.lit("12")), text.strict_id(F.lit("1" * 19)), text.strict_id(F.lit("-1")))) == (12, None, None)
    page = lambda v: text.clamped(F.lit(v), 50, 1, 200)
    assert tuple(one(spark, page("x"), page("0"), page("4294967297"), page("7"), page(None))) == (50, 1, 200, 7, 50)


def test_playback_gain(spark):
    g = lambda m, tl, tp, al, ap: levels.playback_gain(F.lit(m), *(F.lit(x).cast("double") for x in (tl, tp, al, ap)))
    got = one(spark, g("off", -10, -1, -10, -1), g("track", -10, -3, -12, -1), g("album", -10, -3, -12, -1), g("track", None, None, None, None), g("track", -30, -4, None, None))
    assert list(got) == [0.0, -6.0, -4.0, 0.0, 3.0]


def test_enumerative_ranks_are_all_different(spark):
    d = spark.range(256).withColumn("b", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.call_function("shiftright", F.col("id"), i).bitwiseAND(F.lit(1))))
    rows = d.select(F.bit_count("id").alias("ones"), bits.enumerative_index(F.col("b"), 8).alias("r")).collect()
    for k in range(9):
        ranks = sorted(r.r for r in rows if r.ones == k)
        assert ranks == list(range(len(ranks)))


def test_identity_ignores_artist_order(spark):
    a = lambda *n: F.array(*(F.struct(F.lit(x).alias("name"), F.lit("main").alias("role")) for x in n))
    key = lambda artists, t="T": text.group_key(F.lit(None).cast("string"), F.lit(t), F.lit("1986"), F.lit("album"), artists)
    x, y, z, m = one(spark, key(a("p", "q")), key(a("q", "p")), key(a("p", "q"), "U"), text.group_key(F.lit("id"), F.lit("T"), F.lit(None).cast("string"), F.lit("album"), a("p")))
    assert x == y != z and m == "mb:id" and x.startswith("h:") and zlib.crc32(x.encode())


def test_manifest_pretty_formats_every_order(spark, tmp_path):
    import json

    from tessitura.plans.registry import QUERIES, load

    load()
    rows = [(k, n, 7 * k + n, 0.05) for k in [*range(45, 56), 4000, 4140] for n in (1, 2)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.id: r.pretty for r in QUERIES["manifest_pretty"](spark, str(tmp_path)).collect()}
    assert got.keys() == {k for k, *_ in rows if k % 23}
    assert all(json.dumps(json.loads(x), indent=2, ensure_ascii=False) == x for x in got.values())
    assert [t["title"] for t in json.loads(got[4000])["media"][0]["tracks"]] == ["T28001", "T28002"]


def test_merge_keeps_unknown_fields(spark):
    import json
    import random

    r = random.Random(3)

    def value(depth):
        kind = r.randrange(5 if depth else 3)
        return r.randrange(9) if kind == 0 else None if kind == 1 else "é\"x" if kind == 2 else [value(depth - 1) for _ in range(r.randrange(4))] if kind == 3 else {k: value(depth - 1) for k in r.sample("abcd", r.randrange(4))}

    def merged(a, b):
        if isinstance(a, dict) and isinstance(b, dict):
            out = dict(a)
            for k in b:
                out[k] = merged(a[k], b[k]) if k in a else b[k]
            return out
        return [merged(a[i], x) if i < len(a) else x for i, x in enumerate(b)] if isinstance(a, list) and isinstance(b, list) else b

    from tessitura.operators import documents

    pairs = [({k: value(3) for k in "abc"}, {k: value(3) for k in "bcd"}) for _ in range(60)]
    d = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(pairs)] + [(60, None, "{}"), (61, "{}", None)], "i int, a string, b string")
    got = {x.i: x.m for x in d.select("i", documents.merged(F.col("a"), F.col("b")).alias("m")).collect()}
    assert all(json.loads(got[i]) == merged(a, b) for i, (a, b) in enumerate(pairs)) and got[60] == got[61] == "{}"
