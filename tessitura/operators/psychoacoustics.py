"""What an ear doesn't hear: thresholds by partition and spectral line, from energies, tonality and what came before.

Partitions are consecutive runs of spectral lines. What needs one frame only is an expression over arrays; what remembers
(loudness, post-masking, short blocks) is a fold over a track's frames in order. Energies, thresholds and ratios are linear.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.operators.sequences import folded
from tessitura.operators.signal import ALIASES, _by_frame

# Where tone and noise begin in unpredictability, the slope between them, how far masking spreads, the loudness's
# time constant and weight, integrators and time constants of post-masking, the voice's range, pulse and certainty.
NOISY, TONAL, BEND, SLOPE = 0.5871011603, 0.05737540597, 0.229, 0.099011159
BELOW, ABOVE = 5, 7
LOUDNESS_KEPT, LOUDNESS_STEP = 0.98, 5.023772e-08
SHORT_STEP, LONG_STEP, STEADY, LEAST_TAU, TAU_RANGE = 0.5, 0.15, 0.8, 0.2, 0.6
LEAST_PERIOD, MOST_PERIOD, VOICE_LINES, VOICED = 50, 900, 300, 0.04
PULSE = (-0.10670808991329, -0.06198987803623, 0.18006206051664, 0.49549552704050, 0.64201253447071, 0.49549552704050, 0.18006206051664, -0.06198987803623, -0.10670808991329)
#: By stereo mode: how much of the other channel's energy may mask, in dB, and what stays of the old threshold.
STEREO = {10: (-1.5, 0.5), 11: (-2.0, 0.25), 12: (-2.5, 0.125), 13: (-3.0, 0.0625), 15: (-3.0, 0.0)}
NEVER = 1e18


def _const(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def _each(n: int, f) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), f)


def unpredictable(frames: DataFrame, key: str, order: str, power: str, phase: str, voiced: str | None = None) -> DataFrame:
    """`unpredictability` of each line: how far it is from what the two frames before lead to, amplitude and phase, over the
    sum of both amplitudes; silence came before the first frame. Lines that are voiced (a certainty in percent, 0 if not) count
    as no more than tonal."""
    w = W.partitionBy(key).orderBy(order)
    quiet = F.transform(power, lambda v: F.lit(0.0))
    d = frames
    for name, c in (("__a", F.transform(power, lambda v: F.sqrt(v))), ("__p", F.col(phase))):
        d = d.withColumn(name, c)
        for i in (1, 2):
            d = d.withColumn(f"{name}{i}", F.coalesce(F.lag(name, i).over(w), quiet))
    z = F.arrays_zip(F.col(power).alias("e"), F.col("__a").alias("a"), F.col("__a1").alias("a1"), F.col("__a2").alias("a2"), F.col("__p").alias("p"), F.col("__p1").alias("p1"), F.col("__p2").alias("p2"))

    def line(x: Column) -> Column:
        guess = 2 * x["a1"] - x["a2"]
        off = F.cos(x["p"] - 2 * x["p1"] + x["p2"])
        total = x["a"] + F.abs(guess)
        return F.when(total > 0, F.sqrt(F.greatest(x["e"] + guess * (guess - 2 * x["a"] * off), F.lit(0.0))) / total).otherwise(0.0)

    out = F.transform(z, line)
    if voiced is not None:
        out = F.transform(out, lambda c, i: F.when(F.coalesce(F.get(F.col(voiced), i), F.lit(0)) != 0, F.least(c, F.lit(VOICED / 100) * F.get(F.col(voiced), i))).otherwise(c))
    return d.withColumn("unpredictability", out).drop(*(f"__{c}{i}" for c in "ap" for i in ("", 1, 2)))


def spreading(barks: np.ndarray) -> np.ndarray:
    """How much of each partition (row) reaches each other one, from their places on the bark scale; none beyond five below and
    seven above."""
    d = barks[None, :] - barks[:, None]
    m = 10 ** ((15.81 + 7.5 * (d + 0.474) - 17.5 * np.sqrt(1 + (d + 0.474) ** 2)) / 10)
    step = np.arange(len(barks))[None, :] - np.arange(len(barks))[:, None]
    return np.where((step >= -BELOW) & (step <= ABOVE), m, 0.0)


def spread(energies: Column, matrix: np.ndarray) -> Column:
    """What all partitions give to each."""
    n = len(matrix)
    columns = []
    for j in range(n):
        near = [(k, matrix[k, j]) for k in range(n) if matrix[k, j]]
        columns.append(reduce(lambda a, b: a + b, (F.get(energies, F.lit(k)) * float(m) for k, m in near)))
    return F.array(*columns)


def tonality_offset(energies: Column, weighted: Column, widths: list[int], floors: list[float], tmn: float, nmt: float) -> Column:
    """Thresholds of spread energies: masked by tones `tmn` dB, by noise `nmt` dB below them, between by how unpredictable they
    are (weighted over plain energy); no more than the partition's floor, and by line."""
    least, most = 10 ** (-0.1 * nmt), 10 ** (-0.1 * tmn)
    factor, power = 10 ** (-0.1 * (nmt - (tmn - nmt) * BEND)), (tmn - nmt) * SLOPE

    def one(i: int) -> Column:
        e = F.get(energies, F.lit(i))
        q = F.when(e > 0, F.get(weighted, F.lit(i)) / e).otherwise(0.0)
        offset = F.when(q <= TONAL, most).when(q < NOISY, factor * F.pow(q, F.lit(power))).otherwise(least)
        return e * F.least(offset, F.lit(float(floors[i]))) / widths[i]

    return F.array(*(one(i) for i in range(len(widths))))


def line_thresholds(lines: Column, width: int = 16, bands: int = 32) -> Column:
    """Lowered near a subband's edges, where the mirror line of the neighbour would show up."""
    inverse, n = _const(1 / a for a in ALIASES), len(ALIASES)

    def one(v: Column, i: Column) -> Column:
        at, band = i % width, F.floor(i / width)
        low = F.when((at < n) & (band > 0), F.get(lines, i - 1 - 2 * at) * F.get(inverse, at))
        high = F.when((at >= width - n) & (band < bands - 1), F.get(lines, i + 2 * (width - at) - 1) * F.get(inverse, width - 1 - at))
        return F.least(v, F.coalesce(low, high, v))

    return F.transform(lines, one)


def in_quiet(thresholds: Column, quiet: list[float], bounds: list[int], adapted: Column, share: float = 0.25) -> Column:
    """By line: the partition's threshold and the one in quiet, their amplitudes added."""
    parts = [i for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) for _ in range(b - a)]
    lines = F.array(*(F.lit(i) for i in parts))
    return F.zip_with(lines, _const(quiet), lambda i, q: F.pow(F.sqrt(F.get(thresholds, i)) + F.sqrt(q * adapted * share), F.lit(2.0)))


def raised(ratios: Column, cap: float) -> Column:
    """Signal-to-mask ratios no lower than those of higher bands, these counted up to a cap."""
    start = F.struct(F.lit(0.0).alias("z"), F.array().cast("array<double>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        z = F.least(F.greatest(a["z"], s), F.lit(float(cap)))
        return F.struct(z.alias("z"), F.concat(F.array(F.greatest(s, z)), a["out"]).alias("out"))

    return F.aggregate(F.reverse(ratios), start, step, lambda a: a["out"])


def mid_side_thresholds(e: dict[str, Column], l: Column, r: Column, mode: int, widths: list[int]) -> Column:
    """struct(l, r, m, s) of thresholds by partition. e: energies of l, r, m and s. Those of sum and difference follow from the
    least of left and right; where both channels are about as loud, the weaker of sum and difference may be masked more by the
    stronger (modes 10 to 15), twice as much (5), or not at all (6); modes 3 and 4 keep what is nearly in the middle."""

    def one(i: int) -> Column:
        at = lambda c: F.get(c, F.lit(i))
        el, er, em, es, tl, tr = at(e["l"]), at(e["r"]), at(e["m"]), at(e["s"]), at(l), at(r)
        both = F.greatest(em, es) / F.greatest(el, er) * F.least(tl, tr)
        out = {"l": tl, "r": tr, "m": both, "s": both}
        if mode in (3, 4) and i:
            ratio = lambda a, b: F.least(a, b) / F.greatest(a, b)
            middle = ratio(em, es) < ratio(el, er)
            off = {"s": middle & (em > es), "m": middle & ~(em > es), "r": ~middle & (el > er), "l": ~middle & ~(el > er)}
            if mode == 3:
                off = {k: middle | off[k] if k in "lr" else ~middle | off[k] for k in off}
            out = {k: F.when(off[k], NEVER).otherwise(v) for k, v in out.items()}
        elif mode == 5:
            out["s"] = both * 2
        elif mode in STEREO or mode == 22:
            db, kept = STEREO.get(mode, (-2.5, 0.0))
            near = (4 * el > er) & (el < 4 * er)
            for weak, strong, w, s in ((es, em, "s", "m"), (em, es, "m", "s")):
                other = weak * 10 ** (db / 10) / widths[i]
                new = kept * both + (1 - kept) * other if mode != 22 else F.greatest(other, strong / widths[i] * 0.025)
                out[w] = F.when(near & (strong > weak) & (both > other), new).otherwise(both)
        return F.struct(*(out[k].cast("double").alias(k) for k in "lrms"))

    rows = F.array(*(one(i) for i in range(len(widths))))
    channel = lambda k: F.transform(rows, lambda x: x[k])
    return F.struct(*(channel(k).alias(k) for k in "lrms"))


# ---- what remembers -----------------------------------------------------------

def adapted_quiet(frames: DataFrame, key: str, order: str, left: str, right: str, weights: list[float], amount: float) -> DataFrame:
    """(key, order, loudness, adapted): the factor by which the threshold in quiet rises with the loudness that was heard."""
    w = np.array(weights)

    def step(loud, a, b):
        loud = LOUDNESS_KEPT * loud + (1 - LOUDNESS_KEPT) * 0.5 * float((np.asarray(a) + np.asarray(b)) @ w)
        return loud, (loud, 1 + amount * loud * LOUDNESS_STEP)

    return folded(frames, key, order, [left, right], "loudness double, adapted double", lambda: 0.0, step)


def post_masked(frames: DataFrame, key: str, order: str, threshold: str, quiet: list[float]) -> DataFrame:
    """(key, order, masked): thresholds that fall off after a loud frame, the faster the shorter the sound was."""
    q = np.array(quiet)

    def step(state, now):
        a, b, tau, before = state
        f = np.asarray(now, float) / q
        old = np.where(before > 1, np.maximum(before, 1) ** tau, 1.0)
        a, b = a + SHORT_STEP * (f - a), b + LONG_STEP * (f - b)
        with np.errstate(divide="ignore", invalid="ignore"):
            new = np.where(a <= b, STEADY, LEAST_TAU + b / a * TAU_RANGE)
        tau = np.where(old < f, new, tau)
        out = np.maximum(f, old)
        return (a, b, tau, out), ((out * q).tolist(),)

    n = len(q)
    return folded(frames, key, order, [threshold], "masked array<double>", lambda: (np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)), step)


def short_blocks(frames: DataFrame, key: str, order: str, pieces: str, widths: list[int], factor: float, jump: float) -> DataFrame:
    """(key, order, threshold, transient) by short partition of frames whose `pieces` are energies of consecutive parts: a jump
    in energy against the part before, or twice that against the one before it, makes a frame transient; the threshold
    follows the quietest part."""
    w = np.array(widths, float)

    def step(state, parts):
        last, older = state
        low, moved = last.copy(), np.zeros(len(w), bool)
        for part in parts:
            e = np.asarray(part, float)
            up = e > last
            moved |= up & ((e > last * jump) | (e > older * jump * 2))
            low = np.where(up, low, np.minimum(low, e))
            last, older = e, last
        return (last, older), ((low * factor / w).tolist(), moved.tolist())

    return folded(frames, key, order, [pieces], "threshold array<double>, transient array<boolean>", lambda: (np.zeros(len(w)), np.zeros(len(w))), step)


def transient_bands(left: Column, right: Column, bounds: list[tuple[int, int]], bands: int = 32) -> Column:
    """Which subbands hold a partition, given by its first and last short line, that is transient in a channel."""
    hit = F.zip_with(left, right, lambda a, b: a | b)
    return F.array(*(reduce(lambda a, b: a | b, (F.get(hit, F.lit(i)) for i, (lo, hi) in enumerate(bounds) if lo >> 2 <= k <= hi >> 2), F.lit(False)) for k in range(bands)))


# ---- voice ----------------------------------------------------------------------

def period(cepstrum: np.ndarray, least: int = LEAST_PERIOD, most: int = MOST_PERIOD, certain: float = 0.4, strong: float = 0.015) -> float:
    """The period of a voice in a cepstrum (0: none): where it is most like the pulse that a cut-off spectrum of harmonics
    makes, to a fraction of a place."""
    pulse, c = np.array(PULSE), np.zeros(most + 3)
    for n in range(least - 2, most + 3):
        x = cepstrum[n - 4 : n + 5]
        if cepstrum[n] > 0:
            c[n] = (x @ pulse) ** 2 / (x @ x)
    power = c * cepstrum[: most + 3] ** 2
    best, at = 0.0, least
    for n in range(most, least - 1, -1):
        if power[n] > best and c[n] > certain and c[n] >= c[n + 1] and c[n] >= c[n - 1] and c[n + 1] >= c[n + 2] and c[n - 1] >= c[n - 2]:
            best, at = power[n], n
    near = cepstrum[at - 3 : at + 4]
    if power[at - 1 : at + 2].sum() <= strong:
        return 0.0
    return float((near @ np.arange(-3, 4) + near.sum() * at) / (near.sum() + 1e-30))


def voice_cepstrum(power: np.ndarray, size: int = 2048) -> np.ndarray:
    """Of the lower lines of a power spectrum, faded out over the upper half of them."""
    n = size // 4
    log = np.log(np.maximum(power[:n], 1e-30))
    log[n // 2 :] *= 0.5 + 0.5 * np.cos(np.pi * np.arange(n // 2) / (n // 2))
    return np.fft.rfft(np.concatenate([log, np.zeros(size - n)])).real / size * 2


def voice_lines(base: float, certainty: int = 100, size: int = 2048, lines: int = VOICE_LINES) -> np.ndarray:
    """The spectral lines of a period's harmonics, with the certainty in percent."""
    out = np.zeros(lines + 4, int)
    if base > 0:
        step = size / 2 / base
        for n in range(1, int(lines / step) + 1):
            out[int(n * step) : int(n * step) + 2] = certainty
    return out[:lines]


def voiced(power: Column) -> Column:
    """The voiced lines of power spectra of 2048 samples."""
    return _by_frame(power, lambda m: [voice_lines(period(voice_cepstrum(p))).tolist() for p in m], "array<int>")
