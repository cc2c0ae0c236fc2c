"""Signal queries over the driver's tables: embeddings are frames, events a channel for each user."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.operators import psychoacoustics as ear
from tessitura.operators import signal as ops
from tessitura.plans.catalog_tables import read
from tessitura.plans.registry import query


def _frames(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("track"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return e


@query("frame_quantised", "select vec_id as id, array_to_string([cast(least(greatest(round_even(cast(x as double) * 20, 0) + 7, 0), 14) as int) for x in embedding], ',') as q from embeddings")
def frame_quantised(spark, sf_dir):
    return _frames(spark, sf_dir).select("id", F.array_join(ops.quantised(F.col("x"), F.lit(20.0), 7), ",").alias("q"))


@query("frame_peaks", "select vec_id as id, " + ", ".join(f"round(list_max([abs(cast(x as double)) for x in embedding[{16 * i + 1}:{16 * i + 16}]]), 9) as p{i}" for i in range(4)) + " from embeddings")
def frame_peaks(spark, sf_dir):
    p = ops.block_peaks(F.col("x"), 4, 16)
    return _frames(spark, sf_dir).select("id", *(F.round(p[i], 9).alias(f"p{i}") for i in range(4)))


@query("frame_energy", "select vec_id as id, round(list_sum([cast(x as double) * x for x in embedding]), 6) as energy, len([x for x in embedding if x <> 0]) = 0 as silent from embeddings")
def frame_energy(spark, sf_dir):
    return _frames(spark, sf_dir).select("id", F.round(ops.energy(F.col("x")), 6).alias("energy"), ops.silent(F.col("x")).alias("silent"))


@query("mid_side", "select vec_id as id, round(list_sum([(cast(embedding[i] as double) + embedding[i + 32]) / 2 for i in range(1, 33)]), 6) as mid, round(list_sum([(cast(embedding[i] as double) - embedding[i + 32]) / 2 for i in range(1, 33)]), 6) as side from embeddings")
def mid_side(spark, sf_dir):
    m, s = ops.mid_side(F.slice("x", 1, 32), F.slice("x", 33, 32))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + v), 6)
    return _frames(spark, sf_dir).select("id", total(m).alias("mid"), total(s).alias("side"))


@query("mid_side_choice", """
with e as (select vec_id as id, unnest(range(1, 33)) as i, embedding from embeddings), v as (select id, i, cast(embedding[i] as double) as l, cast(embedding[i + 32] as double) as r from e),
b as (select id, i, log2(greatest(1.0::double, l * l * 100)) + log2(greatest(1.0::double, r * r * 100)) as a, log2(greatest(1.0::double, (l + r) / 2 * ((l + r) / 2) * 100)) + log2(greatest(1.0::double, (l - r) / 2 * ((l - r) / 2) * 100)) as b from v)
select id, string_agg(case when b < a then '1' else '0' end, '' order by i) as use from b group by id""")
def mid_side_choice(spark, sf_dir):
    sq = lambda c: F.transform(c, lambda v: v * v * 100)
    l, r = F.slice("x", 1, 32), F.slice("x", 33, 32)
    m, s = ops.mid_side(l, r)
    use = ops.use_mid_side(sq(l), sq(r), sq(m), sq(s))
    return _frames(spark, sf_dir).select("id", F.array_join(F.transform(use, lambda x: x.cast("int").cast("string")), "").alias("use"))


@query("noise_ratio", """with q as (select vec_id as id, [cast(x as double) for x in embedding] as x, [round_even(cast(x as double) * 16, 0) / 16 for x in embedding] as y from embeddings)
select id, round(list_sum([(x[i] - y[i]) * (x[i] - y[i]) for i in range(1, 65)]) / list_sum([v * v for v in x]), 6) as ratio from q""")
def noise_ratio(spark, sf_dir):
    d = _frames(spark, sf_dir).withColumn("y", ops.restored(ops.quantised(F.col("x"), F.lit(16.0), 64), F.lit(1 / 16), 64))
    return d.select("id", F.round(ops.noise_to_signal(F.col("x"), F.col("y")), 6).alias("ratio"))


@query("scale_factors", "select vec_id as id, round(pow(10.0, -0.1::double * (vec_id % 60 - 1) / 1.26::double), 9) as factor from embeddings")
def scale_factors(spark, sf_dir):
    return _frames(spark, sf_dir).select("id", F.round(ops.scale_factor(F.col("id") % 60), 9).alias("factor"))


@query("signal_to_mask", "select vec_id as id, " + ", ".join(f"round(list_sum([cast(x as double) * x for x in embedding[{16 * i + 1}:{16 * i + 16}]]) / 16 / (list_min([abs(cast(x as double)) for x in embedding[{16 * i + 1}:{16 * i + 16}]]) + 0.5::double), 6) as b{i}" for i in range(4)) + " from embeddings")
def signal_to_mask(spark, sf_dir):
    p, t = F.transform("x", lambda v: v * v), F.transform("x", lambda v: F.abs(v) + 0.5)
    b = ops.signal_to_mask(p, t)
    return _frames(spark, sf_dir).select("id", *(F.round(b[i], 6).alias(f"b{i}") for i in range(4)))


@query("bit_allocation", "select vec_id as id, array_to_string([case when abs(x) <= 0.05 then 0 else cast(least(17, ceil(log2(abs(cast(x as double)) / 0.05) / 2)) as int) end for x in embedding], ',') as bits from embeddings")
def bit_allocation(spark, sf_dir):
    s, m = F.transform("x", lambda v: F.abs(v)), F.transform("x", lambda v: F.lit(0.05))
    return _frames(spark, sf_dir).select("id", F.array_join(ops.allocate(s, m), ",").alias("bits"))


#: Lines of the windowed frames by the definition of the transform, and a list of numbers as whole multiples of 1/scale.
_LINES = """
with w as (select vec_id as id, label as track, [cast(embedding[n] as double) * (0.5 - 0.5 * cos(2 * pi() * (n - 1) / 64)) for n in range(1, 65)] as x, embedding from embeddings),
l as (select id, track, unnest(range(33)) as k, x from w),
c as (select id, track, k, list_sum([x[n + 1] * cos(2 * pi() * k * n / 64) for n in range(64)]) as re, list_sum([x[n + 1] * sin(2 * pi() * k * n / 64) for n in range(64)]) as im from l),
p as (select id, track, k, re * re + im * im as power from c)
"""


def _whole(c, scale):
    return F.array_join(F.transform(c, lambda v: F.round(v * scale).cast("long").cast("string")), ",")


@query("power_spectra", _LINES + """, q as (select vec_id as id, unnest(range(33)) as k, [cast(v as double) for v in embedding] as x from embeddings),
d as (select id, k, ln(sqrt(pow(list_sum([x[n + 1] * cos(2 * pi() * k * n / 64) for n in range(64)]), 2) + pow(list_sum([x[n + 1] * sin(2 * pi() * k * n / 64) for n in range(64)]), 2)) + 1e-12) as lg from q),
e as (select id, list(lg order by k) as lg from d group by id), f as (select id, unnest(range(64)) as n, lg from e),
g as (select id, n, (lg[1] + lg[33] * cos(pi() * n) + 2 * list_sum([lg[k + 1] * cos(2 * pi() * k * n / 64) for k in range(1, 32)])) / 64 as c from f)
select p.id, string_agg(cast(cast(round(power * 1e5) as bigint) as varchar), ',' order by k) as power, any_value(h.c) as cepstrum from p join (select id, string_agg(cast(cast(round(c * 1e5) as bigint) as varchar), ',' order by n) as c from g group by id) h on h.id = p.id group by p.id""")
def power_spectra(spark, sf_dir):
    return _frames(spark, sf_dir).select("id", _whole(ops.power_spectrum(F.col("x")), 1e5).alias("power"), _whole(ops.cepstrum(F.col("x")), 1e5).alias("cepstrum"))


_BARK = "(13 * atan(0.00076::double * {0}) + 3.5::double * atan(pow({0} / 7500, 2)))"


@query("masked_thresholds", _LINES + f""", b as (select i, i * 22050 / 32.0::double as hz, {_BARK.format("(i * 22050 / 32.0::double)")} as z from range(33) t(i)),
h as (select i, greatest(hz, 20) / 1000 as f, z from b), q as (select i, z, pow(10.0::double, (3.64::double * pow(f, -0.8::double) - 6.5::double * exp(-0.6::double * pow(f - 3.3::double, 2)) + 1e-3 * pow(f, 4)) / 10) * 1e-6 as quiet from h),
s as (select a.i as i, c.i as k, pow(10.0::double, (15.81::double + 7.5::double * (a.z - c.z + 0.474::double) - 17.5::double * sqrt(1 + pow(a.z - c.z + 0.474::double, 2))) / 10) as spread from q a, q c),
m as (select p.id, s.i, sum(p.power * s.spread) * pow(10.0::double, -1.4::double) as v from p join s on s.k = p.k group by p.id, s.i)
select m.id, string_agg(cast(cast(round(log10(greatest(m.v, q.quiet)) * 1e5) as bigint) as varchar), ',' order by m.i) as threshold from m join q on q.i = m.i group by m.id""")
def masked_thresholds(spark, sf_dir):
    t = ops.masking(ops.power_spectrum(F.col("x")), 44100)
    return _frames(spark, sf_dir).select("id", _whole(F.transform(t, lambda v: F.log10(v)), 1e5).alias("threshold"))


@query("prediction")
def prediction(spark, sf_dir):
    return _frames(spark, sf_dir).select("id", ops.predictors(F.col("x")).alias("coefficients"), ops.shaped(F.col("x"), [0.5, -0.25], 0.05).alias("shaped"))


@query("spectral_chaos", _LINES + """, g as (select *, 2 * lag(power, 1) over w - lag(power, 2) over w as guess from p window w as (partition by track, k order by id)),
u as (select track, id, k, abs(power - guess) / (abs(power) + abs(guess) + 1e-12) as chaos from g)
select track, id, string_agg(cast(cast(round(chaos * 1e5) as bigint) as varchar), ',' order by k) as chaos from u group by track, id""")
def spectral_chaos(spark, sf_dir):
    d = _frames(spark, sf_dir).withColumn("p", ops.power_spectrum(F.col("x")))
    u = ops.unpredictability(d, "track", "id", "p")
    return u.select("track", "id", _whole("chaos", 1e5).alias("chaos"))


@query("pre_echo", """
with t as (select label as track, vec_id as id, embedding, lag(embedding) over (partition by label order by vec_id) as b from embeddings)
select track, id, array_to_string([cast(round(case when b is null then abs(cast(embedding[i] as double)) else least(abs(cast(embedding[i] as double)), 2 * abs(cast(b[i] as double))) end * 1e6) as bigint) for i in range(1, 65)], ',') as limited from t""")
def pre_echo(spark, sf_dir):
    d = _frames(spark, sf_dir).withColumn("t", F.transform("x", lambda v: F.abs(v)))
    return ops.pre_echo_limited(d, "track", "id", "t").select("track", "id", _whole("limited", 1e6).alias("limited"))


_SHARES = "[" + ", ".join(f"{x}::double" for x in ops.ALIASES) + "]"


@query("band_energies", f"""
with p as (select vec_id as id, [cast(v as double) * v for v in embedding] as p, {_SHARES} as f from embeddings), b as (select id, p, f, unnest(range(4)) as k from p),
l as (select id, k, [p[16 * k + n + 1] + case when n < 7 and k > 0 then f[n + 1] * (p[16 * k - n] - p[16 * k + n + 1]) when n > 8 and k < 3 then f[16 - n] * (p[16 * k + 32 - n] - p[16 * k + n + 1]) else 0 end for n in range(16)] as e from b)
select id, string_agg(cast(cast(round(list_sum(e) * 1e6) as bigint) as varchar), ',' order by k) as energy from l group by id""")
def band_energies(spark, sf_dir):
    p = F.transform("x", lambda v: v * v)
    return _frames(spark, sf_dir).select("id", _whole(ops.band_energies(p, 16, 4), 1e6).alias("energy"))


@query("partition_energies", """
with p as (select vec_id as id, [cast(v as double) * v for v in embedding] as p, [abs(cast(v as double)) for v in embedding] as a, embedding as x from embeddings)
select id, array_to_string([cast(round(v * 1e6) as bigint) for v in [list_sum(p[1:2]), list_sum(p[3:6]), pow(list_sum(a[7:12]), 2) / 6, pow(list_sum(a[13:30]), 2) / 18, list_sum(p[31:64])]], ',') as plain,
  cast(round(list_sum([p[i] * i for i in range(31, 65)]) * 1e6) as bigint) as weighted from p""")
def partition_energies(spark, sf_dir):
    p, n = F.transform("x", lambda v: v * v), [0, 2, 6, 12, 30, 64]
    w = ops.partition_energies(p, n, (2, 4), F.transform("x", lambda v, i: (i + 1).cast("double")))
    return _frames(spark, sf_dir).select("id", _whole(ops.partition_energies(p, n, (2, 4)), 1e6).alias("plain"), F.round(w[4] * 1e6).cast("long").alias("weighted"))


@query("transient_noise", """with q as (select vec_id as id, [cast(x as double) for x in embedding[1:36]] as x, [round_even(cast(x as double) * 8, 0) / 8 for x in embedding[1:36]] as y from embeddings)
select id, round(list_max([list_sum([(x[12 * b + i] - y[12 * b + i]) * (x[12 * b + i] - y[12 * b + i]) for i in range(1, 13)]) / list_sum([x[12 * b + i] * x[12 * b + i] for i in range(1, 13)]) for b in range(3)]), 6) as ratio from q""")
def transient_noise(spark, sf_dir):
    d = _frames(spark, sf_dir).select("id", F.slice("x", 1, 36).alias("x")).withColumn("y", ops.restored(ops.quantised(F.col("x"), F.lit(8.0), 64), F.lit(1 / 8), 64))
    return d.select("id", F.round(ops.transient_noise(F.col("x"), F.col("y")), 6).alias("ratio"))


@query("encode_blocks", """
with x as (select vec_id as id, [case when vec_id % 3 = 0 and i > 20 then 0.0 else embedding[i] end for i in range(1, 65)] as x from embeddings), f as (select id, unnest(range(4)) as n, x from x)
select id, n as frame, cast(len(x[20 * n + 1:20 * n + 28]) as int) as samples, len([v for v in x[20 * n + 1:20 * n + 20] if v <> 0]) = 0 as silent from f""")
def encode_blocks(spark, sf_dir):
    x = F.transform("x", lambda v, i: F.when((F.col("id") % 3 == 0) & (i >= 20), 0.0).otherwise(v))
    f = _frames(spark, sf_dir).select("id", F.posexplode(ops.encode_blocks(x, 20, 8)).alias("frame", "f"))
    return f.select("id", F.col("frame").cast("long").alias("frame"), F.size("f.samples").alias("samples"), "f.silent")


@query("band_resolutions")
def band_resolutions(spark, sf_dir):
    """Resolutions and scale factor steps of three bands of 36 samples made of each vector."""
    x = F.transform(F.flatten(F.array(F.slice("x", 1, 36), F.slice("x", 29, 36), F.reverse(F.slice("x", 1, 36)))), lambda v: v * 30000)
    d = _frames(spark, sf_dir).select("id", x.alias("x"), F.array(*((F.col("id") % 40 * (b + 1)).cast("double") for b in range(3))).alias("smr"), F.array(*(F.lit(1.0 + b) for b in range(3))).alias("comp"), F.array(F.col("id") % 2 == 0, F.lit(False), F.lit(False)).alias("moving"))
    return ops.allocated(d, "x", "smr", "comp", "moving", 8.0).select("id", F.array_join("res", ",").alias("res"), F.array_join("steps", ",").alias("steps"))


@query("subband_frames")
def subband_frames(spark, sf_dir):
    return ops.subbands(_frames(spark, sf_dir), "track", "id", "x")


def _program(spark, sf_dir):
    f = _frames(spark, sf_dir).withColumn("l", F.flatten(F.array_repeat("x", 40)))
    return f.withColumn("r", F.reverse("l")).withColumn("album", F.col("track") % 3)


@query("track_loudness")
def track_loudness(spark, sf_dir):
    return ops.loudness(_program(spark, sf_dir), ["track"], ["id"], 8000)


@query("album_loudness")
def album_loudness(spark, sf_dir):
    return ops.loudness(_program(spark, sf_dir), ["album"], ["id"], 8000, ("track",))


@query("worst_spectrum", "select a.vec_id as id, round(list_sum([greatest(cast(a.embedding[i] as double), b.embedding[i]) for i in range(1, 65)]), 6) as total from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def worst_spectrum(spark, sf_dir):
    a = _frames(spark, sf_dir)
    b = a.select((F.col("id") - 1).alias("id"), F.col("x").alias("y"))
    return a.join(b, "id").select("id", F.round(F.aggregate(ops.worst(F.col("x"), F.col("y")), F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


_PARTS = "with p as (select vec_id as id, label as track, [list_sum([cast(v as double) * v for v in embedding[8 * i + 1:8 * i + 8]]) for i in range(8)] as e, [list_sum([cast(v as double) * v * (0.1 + 0.1 * i) for v in embedding[8 * i + 1:8 * i + 8]]) for i in range(8)] as w from embeddings)"
_BARKS = [0.5 * i for i in range(8)]


def _parts(spark, sf_dir):
    p = F.transform("x", lambda v: v * v)
    e = ops.partition_energies(p, list(range(0, 65, 8)), (8, 8))
    return _frames(spark, sf_dir).select("id", "track", e.alias("e"), F.transform(e, lambda v, i: v * (0.1 + 0.1 * i)).alias("w"))


@query("masking_spread", _PARTS + """, r as (select i, j, case when j - i between -5 and 7 then pow(10.0::double, (15.81::double + 7.5::double * (0.5 * (j - i) + 0.474::double) - 17.5::double * sqrt(1 + pow(0.5 * (j - i) + 0.474::double, 2))) / 10) else 0 end as m from range(8) a(i), range(8) b(j)),
x as (select id, unnest(range(8)) as i, e, w from p), s as (select id, j, sum(e[x.i + 1] * m) as e, sum(w[x.i + 1] * m) as w from x join r on r.i = x.i group by id, j),
o as (select id, j, e, w / e as q from s),
t as (select id, j, e / 8 * least(case when q <= 0.05737540597 then pow(10.0::double, -1.8::double) when q < 0.5871011603 then pow(10.0::double, -0.1::double * (6 - 12 * 0.229::double)) * pow(q, 12 * 0.099011159::double) else pow(10.0::double, -0.6::double) end, 0.2::double) as t from o)
select id, string_agg(cast(cast(round(t * 1e8) as bigint) as varchar), ',' order by j) as threshold from t group by id""")
def masking_spread(spark, sf_dir):
    import numpy as np

    m = ear.spreading(np.array(_BARKS))
    t = ear.tonality_offset(ear.spread(F.col("e"), m), ear.spread(F.col("w"), m), [8] * 8, [0.2] * 8, 18.0, 6.0)
    return _parts(spark, sf_dir).select("id", _whole(t, 1e8).alias("threshold"))


@query("line_thresholds", f"""
with t as (select vec_id as id, [cast(v as double) * v for v in embedding] as t, {_SHARES} as f from embeddings), l as (select id, t, f, unnest(range(64)) as i from t),
m as (select id, i, least(t[i + 1], case when i % 16 < 7 and i > 15 then t[i - 2 * (i % 16)] / f[i % 16 + 1] when i % 16 > 8 and i < 48 then t[i + 2 * (16 - i % 16)] / f[16 - i % 16] else t[i + 1] end) as v from l)
select id, string_agg(cast(cast(round(v * 1e8) as bigint) as varchar), ',' order by i) as threshold from m group by id""")
def line_thresholds(spark, sf_dir):
    t = F.transform("x", lambda v: v * v)
    return _frames(spark, sf_dir).select("id", _whole(ear.line_thresholds(t, 16, 4), 1e8).alias("threshold"))


@query("quiet_thresholds", _PARTS + """, l as (select id, e, unnest(range(64)) as k from p)
select id, string_agg(cast(cast(round(pow(sqrt(e[k // 8 + 1]) + sqrt((0.01 + k * 0.001::double) * 1.5 * 0.25), 2) * 1e8) as bigint) as varchar), ',' order by k) as threshold from l group by id""")
def quiet_thresholds(spark, sf_dir):
    t = ear.in_quiet(F.col("e"), [0.01 + k * 0.001 for k in range(64)], list(range(0, 65, 8)), F.lit(1.5))
    return _parts(spark, sf_dir).select("id", _whole(t, 1e8).alias("threshold"))


@query("raised_ratios", _PARTS + """, l as (select id, e, unnest(range(8)) as k from p)
select id, string_agg(cast(cast(round(greatest(e[k + 1], least(0.15::double, list_max(e[k + 1:8]))) * 1e8) as bigint) as varchar), ',' order by k) as ratios from l group by id""")
def raised_ratios(spark, sf_dir):
    return _parts(spark, sf_dir).select("id", _whole(ear.raised(F.col("e"), 0.15), 1e8).alias("ratios"))


@query("stereo_thresholds")
def stereo_thresholds(spark, sf_dir):
    """Thresholds of four stereo modes, of the first half of each vector as left and the second as right."""
    sums = lambda c: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.aggregate(F.slice(c, i * 8 + 1, 8), F.lit(0.0), lambda a, v: a + v * v))
    l, r = F.slice("x", 1, 32), F.slice("x", 33, 32)
    m, s = ops.mid_side(l, r)
    d = _frames(spark, sf_dir).select("id", *(sums(c).alias(k) for k, c in zip("lrms", (l, r, m, s))))
    e = {k: F.col(k) for k in "lrms"}
    t = lambda k: F.transform(k, lambda v: v * 0.1)
    modes = (3, 5, 10, 22)
    rows = F.array(*(F.struct(F.lit(m).alias("mode"), ear.mid_side_thresholds(e, t("l"), t("r"), m, [8] * 4).alias("t")) for m in modes))
    return d.select("id", F.explode(rows).alias("x")).select("id", "x.mode", *(F.array_join(F.transform(f"x.t.{k}", lambda v: F.round(F.least(v, F.lit(1e6)) * 1e6).cast("long").cast("string")), ",").alias(k) for k in "lrms"))


@query("adapted_thresholds")
def adapted_thresholds(spark, sf_dir):
    """Loudness, post-masking and short blocks of each track's frames in order."""
    d = _parts(spark, sf_dir)
    a = ear.adapted_quiet(d, "track", "id", "e", "w", [1e6] * 8, 20.0)
    m = ear.post_masked(d, "track", "id", "e", [0.05] * 8)
    pieces = F.array(*(F.slice("e", 2 * i + 1, 2) for i in range(4)))
    s = ear.short_blocks(d.withColumn("pieces", pieces), "track", "id", "pieces", [2, 2], 0.5, 1.5)
    return a.join(m, ["track", "id"]).join(s, ["track", "id"])


@query("unpredictable_lines", _LINES + """, q as (select track, id, k, power as e, sqrt(power) as a, atan2(im, re) as f from (select p.*, c.re, c.im from p join c on c.id = p.id and c.k = p.k)),
v as (select *, coalesce(lag(a, 1) over w, 0) as a1, coalesce(lag(a, 2) over w, 0) as a2, coalesce(lag(f, 1) over w, 0) as f1, coalesce(lag(f, 2) over w, 0) as f2 from q window w as (partition by track, k order by id)),
u as (select track, id, k, sqrt(greatest(e + (2 * a1 - a2) * ((2 * a1 - a2) - 2 * a * cos(f - 2 * f1 + f2)), 0)) / (a + abs(2 * a1 - a2)) as u from v)
select track, id, string_agg(cast(cast(round(u * 1e4) as bigint) as varchar), ',' order by k) as unpredictability from u group by track, id""")
def unpredictable_lines(spark, sf_dir):
    d = _frames(spark, sf_dir).withColumns({"p": ops.power_spectrum(F.col("x")), "f": ops.phases(F.col("x"))})
    return ear.unpredictable(d, "track", "id", "p", "f").select("track", "id", _whole("unpredictability", 1e4).alias("unpredictability"))
