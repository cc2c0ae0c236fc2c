"""Signal operators against slow versions that follow the definition step by step."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessitura.operators import codec, psychoacoustics, queues, signal
from tessitura.plans import signal_queries


def rows(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, x array<double>")


def test_predictors_solve_the_normal_equations(spark):
    x = np.random.default_rng(1).standard_normal((20, 64))
    got = rows(spark, x).select("id", signal.predictors(F.col("x")).alias("a")).collect()
    for r in got:
        v = x[r.id]
        c = np.array([v[: 64 - k] @ v[k:] for k in range(7)])
        want = np.linalg.solve(np.array([[c[abs(i - j)] for j in range(6)] for i in range(6)]), c[1:])
        assert np.allclose(r.a, want)


def test_shaped_quantisation_sample_by_sample(spark):
    x = np.random.default_rng(2).standard_normal((10, 50))
    for r in rows(spark, x).select("id", signal.shaped(F.col("x"), [0.5, -0.25], 0.3).alias("q")).collect():
        errors, want = [0.0, 0.0], []
        for v in x[r.id]:
            t = v - 0.5 * errors[0] + 0.25 * errors[1]
            want.append(np.rint(t / 0.3))
            errors = [want[-1] * 0.3 - t, errors[0]]
        assert np.allclose(r.q, want)


def test_bank_is_the_sum_of_its_definition(spark):
    x = np.random.default_rng(3).standard_normal(200)
    d = spark.createDataFrame([(1, i, x[i * 50 : i * 50 + 50].tolist()) for i in range(4)], "track int, n int, x array<double>").repartition(3)
    got = {r.step: r.bands for r in signal.subbands(d, "track", "n", "x").collect()}
    h = signal.cosine_bank()
    padded = np.concatenate([x, np.zeros(-len(x) % 32)])
    for step in range(len(padded) // 32):
        want = [sum(h[b, t] * padded[step * 32 + 31 - t] for t in range(512) if 0 <= step * 32 + 31 - t) for b in range(32)]
        assert np.allclose(got[step], want)
    assert len(got) == len(padded) // 32


def _loudness(x, rate):
    for b, a in signal.k_weights(rate):
        x = signal._direct(b, a, x, np.zeros((2, x.shape[1])))[0]
    blocks = []
    for at in range(0, len(x) - 4 * (rate // 10) + 1, rate // 10):
        blocks.append(sum((x[at + i] ** 2).sum() for i in range(4 * (rate // 10))) / (4 * (rate // 10)))
    loud = lambda p: -0.691 + 10 * np.log10(max(p, 1e-30))
    blocks = [p for p in blocks if loud(p) > -70]
    gate = loud(sum(blocks) / len(blocks)) - 10
    blocks = [p for p in blocks if loud(p) > gate]
    return loud(sum(blocks) / len(blocks))


@pytest.mark.parametrize("seed", [1, 2])
def test_loudness_block_by_block(spark, seed):
    r = np.random.default_rng(seed)
    x = r.standard_normal((9000, 2)) * np.repeat(r.uniform(0.001, 0.3, 18), 500)[:, None]
    d = spark.createDataFrame([("t", i, x[i * 900 : i * 900 + 900, 0].tolist(), x[i * 900 : i * 900 + 900, 1].tolist()) for i in range(10)], "t string, n int, l array<double>, r array<double>").repartition(4)
    got = signal.loudness(d, ["t"], ["n"], 8000).first()
    assert got.lufs == pytest.approx(_loudness(x, 8000), abs=1e-6)
    assert 20 * np.log10(np.abs(x).max()) <= got.peak_db < 20 * np.log10(np.abs(x).max()) + 3


def test_program_in_chunks_is_the_program_at_once(spark):
    r = np.random.default_rng(11)
    d, want = [], {}
    for album, tracks in (("a", (40_000, 10, 3_000, 0, 25_001)), ("b", (70_000,)), ("c", (500,)), (None, (9_000, 9_000))):
        x = [r.standard_normal((n, 2)) * np.repeat(r.uniform(0.001, 0.3, n // 500 + 1), 500)[:n, None] for n in tracks]
        want[album] = signal.integrated(np.concatenate(x), 8000), max(signal.true_peak(v) for v in x), x
        for t, v in enumerate(x):
            cuts = [0, *sorted(r.integers(0, len(v) + 1, 1 if len(v) == 70_000 else 30).tolist()), len(v)]
            d += [(album, t, n, v[i:j, 0].tolist(), v[i:j, 1].tolist()) for n, (i, j) in enumerate(zip(cuts, cuts[1:]))] + [(album, t, 99, None, None)]
    assert want["a"][0] == pytest.approx(_loudness(np.concatenate(want["a"][2]), 8000), abs=1e-9)
    d = spark.createDataFrame(d, "album string, t int, n int, l array<double>, r array<double>").repartition(5)
    got = {x.album: (x.lufs, x.peak_db) for x in signal.loudness(d, ["album"], ["n"], 8000, ("t",)).collect()}
    assert got.keys() == want.keys()
    for album, (lufs, peak, _) in want.items():
        assert got[album] == pytest.approx((lufs, peak), abs=1e-9)


def test_track_over_many_tasks_has_the_peak_between_them(spark):
    x = np.sin(np.pi / 2 * np.arange(200) + np.pi / 4)[:, None] * np.array([1.0, 0.5])  # peaks lie between samples
    x[97:103] *= 4
    d = spark.createDataFrame([(1, i, x[i : i + 1, 0].tolist(), x[i : i + 1, 1].tolist()) for i in range(200)], "t int, n int, l array<double>, r array<double>")
    got = signal.loudness(d, ["t"], ["n"], 8000).first()
    assert got.peak_db == pytest.approx(signal.true_peak(x), abs=1e-9) and got.lufs == -70


def test_what_is_no_number_ends_the_measurement(spark):
    x = np.random.default_rng(12).standard_normal((9000, 2)) * 0.1
    bad = x.copy()
    bad[6000, 1] = np.inf
    d = spark.createDataFrame([(k, i, v[i * 900 : i * 900 + 900, 0].tolist(), v[i * 900 : i * 900 + 900, 1].tolist()) for k, v in enumerate((x, bad)) for i in range(10)], "t int, n int, l array<double>, r array<double>")
    got = {r.t: r for r in signal.loudness(d, ["t"], ["n"], 8000).collect()}
    assert got[0].lufs == pytest.approx(signal.integrated(x, 8000)) and got[1].lufs == pytest.approx(signal.integrated(x[:5600], 8000)) and got[1].peak_db == -70


def test_no_task_is_given_the_samples_of_a_program(spark):
    d = signal_queries.album_loudness(spark, "/root/testdata/sf0.001")
    groups = [x for x in d._jdf.queryExecution().executedPlan().toString().splitlines() if "FlatMapGroupsInPandas" in x]
    assert groups and not any(c in x for x in groups for c in (" l#", " r#", " x#"))


def test_chunks_are_read_in_small_groups(spark):
    d = spark.range(1000).select("id", F.lit(0).alias("n"), F.array(F.lit(0.5)).alias("l"), F.array(F.lit(0.5)).alias("r"))
    for f in signal._chunks(d, ["id"], ["n"], 8000).inputFiles():
        p = pq.ParquetFile(f.removeprefix("file://"))
        assert max((p.metadata.row_group(i).num_rows for i in range(p.num_row_groups)), default=0) <= signal.GROUP_ROWS


def test_allocation_step_by_step(spark):
    r = np.random.default_rng(5)
    n, bands = 12, 6
    x = r.standard_normal((n, bands, 36)) * 10 ** r.uniform(1, 4, (n, bands, 1))
    smr, comp, moving = 10 ** r.uniform(-1, 3.5, (n, bands)), r.uniform(1, 3, (n, bands)), r.random((n, bands)) < 0.3
    d = spark.createDataFrame([(i, x[i].reshape(-1).tolist(), smr[i].tolist(), comp[i].tolist(), moving[i].tolist()) for i in range(n)], "id int, x array<double>, smr array<double>, comp array<double>, moving array<boolean>")
    for got in signal.allocated(d, "x", "smr", "comp", "moving", 30.0).collect():
        res, steps = [], []
        for b in range(bands):
            def noise(v, q):
                unit = 65536 / (2 * codec.top(q) + 1) if q else 65536
                out = []
                for part in np.split(v, 3) if moving[got.id, b] else [v]:
                    e, p = ((np.rint(part / unit) * unit - part) ** 2).sum() + 1e-30, (part**2).sum() + 1e-30
                    out.append(e / (comp[got.id, b] * p) if p > e else e / p)
                return max(out)

            v, s, q, k = x[got.id, b].copy(), smr[got.id, b], 0, 0
            a, c, e = (np.split(v, 3)[i] @ np.split(v, 3)[i] for i in range(3))
            level = not (a < 0.5 * c or c < 0.5 * e or a < 0.5 * e or c < 0.25 * a or e < 0.25 * c or e < 0.25 * a)
            if b and res[-1] < 3 and 1 <= s < b * 30 and level:
                q = -1
            else:
                ratio = s
                while ratio > 1 and q < 15:
                    q += 1
                    ratio = s * noise(v, q)
                while 0 < q <= 8 and 0 < ratio < 1 and not moving[got.id, b] and k < 63 and s * noise(v * signal.SCALE_STEP, q) <= 1:
                    v, k = v * signal.SCALE_STEP, k + 1
            res.append(q)
            steps.append(k)
        assert got.res == res and got.steps == steps


def test_windows_and_phases(spark):
    w = signal.cosine_window(64)
    assert len(w) == 64 and np.allclose(w, w[::-1]) and w.max() <= 1 and np.allclose(w[:32] + w[32:], 1)
    k = signal.kaiser_bessel(64)
    assert np.allclose(k[:32] ** 2 + k[32:] ** 2, 1)
    x = np.random.default_rng(6).standard_normal((3, 64))
    for r in rows(spark, x).select("id", signal.phases(F.col("x")).alias("p"), signal.power_spectrum(F.col("x")).alias("e"), signal.windowed_spectrum(F.col("x"), "cosine").alias("c")).collect():
        f = np.sqrt(r.e) * np.exp(1j * np.array(r.p))
        assert np.allclose(f, np.fft.rfft(x[r.id] * np.hanning(65)[:-1])) and np.allclose(r.c, np.abs(np.fft.rfft(x[r.id] * w)) ** 2)


def test_cache_and_buffer_against_a_loop(spark):
    r = np.random.default_rng(7)
    reads = [(k, i, int(s), int(n)) for k in range(3) for i, (s, n) in enumerate(zip(r.integers(0, 4_000_000, 150), r.integers(0, 300_000, 150)))]
    got = queues.cached_blocks(spark.createDataFrame(reads, "k int, o int, s bigint, n bigint").repartition(5), "k", "o", "s", "n").orderBy("k", "o", "block").collect()
    caches, want = {}, []
    for k, o, s, n in reads:
        for b in range(s // 65536, (s + n - 1) // 65536 + 1) if n else []:
            cache = caches.setdefault(k, [])
            want.append((k, o, b, b in cache))
            if b not in cache:
                caches[k] = (cache + [b])[-16:]
    assert [tuple(x) for x in got] == want and any(x[3] for x in want)
    moves = [(k, i, float(a)) for k in range(5) for i, a in enumerate(r.uniform(-3, 3, 200))]
    level, paused, want = {}, {}, []
    for k, i, a in moves:
        old = level.get(k, 0.0)
        level[k] = max(0.0, min(8.0, old + a))
        paused[k] = True if level[k] >= 6.4 else False if level[k] <= 1.6 else paused.get(k, False)
        want.append((k, i, level[k] - old, level[k], paused[k], max(0.0, old + a - 8, -old - a)))
    got = queues.ring_fill(spark.createDataFrame(moves, "k int, i int, amount double").repartition(3), "k", "i", 8, 0.8, 0.2).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_what_the_ear_remembers_frame_by_frame(spark):
    r = np.random.default_rng(11)
    e = 10 ** r.uniform(-2, 4, (2, 30, 6))
    d = spark.createDataFrame([(t, i, e[t, i].tolist(), (e[t, i] / 2).tolist(), e[t, i].reshape(3, 2).tolist()) for t in range(2) for i in range(30)], "t int, i int, l array<double>, r array<double>, parts array<array<double>>").repartition(4)
    quiet = [1.0, 2.0, 0.5, 10.0, 1.0, 3.0]
    got = {(x.t, x.i): x for x in psychoacoustics.adapted_quiet(d, "t", "i", "l", "r", [1e4] * 6, 20.0).collect()}
    masked = {(x.t, x.i): x.masked for x in psychoacoustics.post_masked(d, "t", "i", "l", quiet).collect()}
    short = {(x.t, x.i): x for x in psychoacoustics.short_blocks(d, "t", "i", "parts", [3, 4], 0.5, 20.0).collect()}
    for t in range(2):
        loud, a, b, tau, old, last, older = 0.0, [0.0] * 6, [0.0] * 6, [0.0] * 6, [0.0] * 6, [0.0] * 2, [0.0] * 2
        for i in range(30):
            loud = 0.98 * loud + 0.02 * 0.5 * sum((x + x / 2) * 1e4 for x in e[t, i])
            assert (got[t, i].loudness, got[t, i].adapted) == pytest.approx((loud, 1 + 20 * loud * 5.023772e-08))
            for n in range(6):
                f = e[t, i, n] / quiet[n]
                kept = old[n] ** tau[n] if old[n] > 1 else 1.0
                a[n] += 0.5 * (f - a[n])
                b[n] += 0.15 * (f - b[n])
                if kept < f:
                    tau[n] = 0.8 if a[n] <= b[n] else 0.2 + b[n] / a[n] * 0.6
                old[n] = max(f, kept)
                assert masked[t, i][n] == pytest.approx(old[n] * quiet[n])
            low, moved = list(last), [False] * 2
            for part in e[t, i].reshape(3, 2):
                for n in range(2):
                    if part[n] > last[n]:
                        moved[n] |= part[n] > last[n] * 20 or part[n] > older[n] * 40
                    else:
                        low[n] = min(low[n], part[n])
                    older[n], last[n] = last[n], part[n]
            assert short[t, i].threshold == pytest.approx([low[0] * 0.5 / 3, low[1] * 0.5 / 4]) and short[t, i].transient == moved


def test_prediction_of_lines(spark):
    n, steps = 16, 6
    r = np.random.default_rng(12)
    turn, size = r.uniform(0, 3, n), r.uniform(1, 2, n)
    noise_at = 3  # all lines turn and grow steadily but one
    rows_ = []
    for i in range(steps):
        p, a = turn * i, size + 0.1 * i
        p[noise_at], a[noise_at] = r.uniform(0, 6), r.uniform(1, 3)
        rows_.append((i, (a * a).tolist(), p.tolist(), [0, 0, 0, 100] + [0] * 12))
    d = spark.createDataFrame(rows_, "i int, e array<double>, p array<double>, v array<int>").withColumn("k", F.lit(1))
    out = {x.i: x.unpredictability for x in psychoacoustics.unpredictable(d, "k", "i", "e", "p").collect()}
    assert np.allclose(out[0], 1) and all(max(c for j, c in enumerate(out[i]) if j != noise_at) < 1e-6 for i in range(2, steps)) and max(out[i][noise_at] for i in range(2, steps)) > 0.1
    assert all(x.unpredictability[noise_at] <= 0.04 for x in psychoacoustics.unpredictable(d, "k", "i", "e", "p", "v").collect())


def _stereo(mode, e, l, r, w):
    out = {"l": [], "r": [], "m": [], "s": []}
    for n in range(len(w)):
        el, er, em, es = (e[k][n] for k in "lrms")
        v = {"l": l[n], "r": r[n]}
        v["m"] = v["s"] = max(em, es) / max(el, er) * min(l[n], r[n])
        if mode in (3, 4) and n:
            middle = min(em, es) / max(em, es) < min(el, er) / max(el, er)
            keep = ("m" if em > es else "s") if middle else ("l" if el > er else "r")
            drop = {"m": "s", "s": "m", "l": "r", "r": "l"}[keep]
            for k in ("l", "r", "m", "s") if mode == 3 else (drop,):
                if k != keep:
                    v[k] = 1e18
        if mode == 5:
            v["s"] *= 2
        if mode in (10, 11, 12, 13, 15, 22) and 4 * el > er and el < 4 * er and em != es:
            weak, strong = ("s", "m") if em > es else ("m", "s")
            db, kept = {10: (-1.5, 0.5), 11: (-2, 0.25), 12: (-2.5, 0.125), 13: (-3, 0.0625), 15: (-3, 0), 22: (-2.5, 0)}[mode]
            x = e[weak][n] * 10 ** (db / 10) / w[n]
            if v[weak] > x:
                v[weak] = kept * v[weak] + (1 - kept) * x if mode != 22 else max(x, e[strong][n] / w[n] * 0.025)
        for k in v:
            out[k].append(v[k])
    return out


@pytest.mark.parametrize("mode", [3, 4, 5, 6, 10, 11, 12, 13, 15, 22])
def test_stereo_thresholds_case_by_case(spark, mode):
    r = np.random.default_rng(mode)
    rows_ = [[(10 ** r.uniform(-1, 2, 4)).tolist() for _ in range(4)] for _ in range(25)]
    d = spark.createDataFrame([(i, *x) for i, x in enumerate(rows_)], "id int, l array<double>, r array<double>, m array<double>, s array<double>")
    t = lambda k: F.transform(k, lambda v: v * 0.3)
    for x in d.select("id", psychoacoustics.mid_side_thresholds({k: F.col(k) for k in "lrms"}, t("l"), t("r"), mode, [2, 3, 4, 5]).alias("t")).collect():
        e = dict(zip("lrms", rows_[x.id]))
        want = _stereo(mode, e, [v * 0.3 for v in e["l"]], [v * 0.3 for v in e["r"]], [2, 3, 4, 5])
        assert all(x.t[k] == pytest.approx(want[k]) for k in "lrms")


def test_voice_is_found_at_its_period(spark):
    n = np.arange(2048)
    voice = sum(np.sin(2 * np.pi * k * 40 / 2048 * n) / k for k in range(1, 20))
    hiss = np.random.default_rng(13).standard_normal(2048)
    power = lambda x: np.abs(np.fft.rfft(x * np.hanning(2048))) ** 2
    base = psychoacoustics.period(psychoacoustics.voice_cepstrum(power(voice + 0.01 * hiss)))
    times = base / (2048 / 40)  # the period or a multiple of it
    assert base > 0 and abs(times - round(times)) < 0.05 * round(times), base
    assert psychoacoustics.period(psychoacoustics.voice_cepstrum(power(hiss))) == 0
    lines = psychoacoustics.voice_lines(2048 / 40)
    assert lines[20] == 100 and lines[30] == 0 and len(lines) == 300 and not psychoacoustics.voice_lines(0.0).any()
    assert psychoacoustics.transient_bands is not None
    got = spark.createDataFrame([([True, False], [False, False])], "l array<boolean>, r array<boolean>").select(psychoacoustics.transient_bands(F.col("l"), F.col("r"), [(0, 9), (10, 20)], 8)).first()[0]
    assert got == [True, True, True, False, False, False, False, False]


def test_bank_of_a_given_prototype():
    n = np.arange(512)
    proto = np.sinc(1.12 * (n - 255.5) / 64) * np.kaiser(512, 7.0)
    bank = signal.bank_of(2 * proto / proto.sum())
    assert np.allclose(bank, signal.cosine_bank())
    x = np.random.default_rng(4).standard_normal(640)
    assert np.allclose(signal.synthesised(signal.analysed(x, bank=bank), bank=bank), signal.synthesised(signal.analysed(x)))
