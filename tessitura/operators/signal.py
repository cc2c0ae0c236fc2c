"""Signal operators: loudness, true peak, energies, spectra, quantisation and filterbanks.

What is independent by frame runs as Arrow batches of whole frames (NumPy); what carries state runs per track in order. An
album's loudness is measured over its concatenated program in chunks: the filter is linear, so states add up from chunk to chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.operators.codec import noise, top
from tessitura.session import arrow_batches, staged

FLOOR = -70.0
BANDS, LINES = 32, 36


# ---- loudness ---------------------------------------------------------------

def k_weights(rate: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """The two filter stages of ITU-R BS.1770 at any rate: a high shelf and a high pass, from their analogue design."""
    out = []
    for f0, gain, q in ((1681.974450955533, 3.999843853973347, 0.7071752369554196), (38.13547087602444, None, 0.5003270373238773)):
        k = np.tan(np.pi * f0 / rate)
        a0 = 1 + k / q + k * k
        a = np.array([1, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0])
        if gain is None:
            b = np.array([1.0, -2.0, 1.0])
        else:
            vh = 10 ** (gain / 20)
            vb = vh**0.4996667741545416
            b = np.array([(vh + vb * k / q + k * k) / a0, 2 * (k * k - vh) / a0, (vh - vb * k / q + k * k) / a0])
        out.append((b, a))
    return out


def _direct(b: np.ndarray, a: np.ndarray, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    y, z = np.empty_like(x), z.copy()
    for i, v in enumerate(x):
        y[i] = b[0] * v + z[0]
        z = np.stack([b[1] * v - a[1] * y[i] + z[1], b[2] * v - a[2] * y[i]])
    return y, z


#: Samples that the filter works through at once.
BLOCK = 4096


@lru_cache
def _system(rate: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both stages as one linear system of four states: the spectrum of its impulse response, what its output is by the states
    at a block's start, how the states go on by one sample, and what each sample of a block adds to the states at its end."""
    stages, out, after = k_weights(rate), np.empty((BLOCK, 5)), np.empty((BLOCK, 4, 5))
    states = [np.eye(2, 5), np.eye(2, 5, 2)]  # of five programs: each state alone, and a sample alone
    for i in range(BLOCK):
        y = np.eye(5)[4:] * (i == 0)
        for k, (b, a) in enumerate(stages):
            y, states[k] = _direct(b, a, y, states[k])
        out[i], after[i] = y[0], np.concatenate(states)
    return np.fft.rfft(out[:, 4], 2 * BLOCK), out[:, :4], after[0, :, :4], after[::-1, :, 4].T


def _gone_on(x: np.ndarray, rate: int, state: np.ndarray) -> np.ndarray:
    """The filter's states (four by channel) after x."""
    _, _, one, into = _system(rate)
    for at in range(0, len(x), BLOCK):
        part = x[at : at + BLOCK]
        state = np.linalg.matrix_power(one, len(part)) @ state + into[:, BLOCK - len(part) :] @ part
    return state


def _weighted(x: np.ndarray, rate: int, state: np.ndarray) -> np.ndarray:
    """x filtered from these states on, block by block with the impulse response and the states': no loop by sample. From the
    first sample that is no number on there is no value."""
    spectrum, free, _, _ = _system(rate)
    y = np.empty_like(x)
    for at in range(0, len(x), BLOCK):
        part = x[at : at + BLOCK]
        out = np.fft.irfft(np.fft.rfft(np.nan_to_num(part), 2 * BLOCK, axis=0) * spectrum[:, None], 2 * BLOCK, axis=0)[: len(part)] + free[: len(part)] @ state
        if np.isnan(part).any():
            out[np.isnan(part).any(axis=1).argmax() :] = np.nan
        y[at : at + BLOCK], state = out, _gone_on(part, rate, state)
    return y


def _energies(y: np.ndarray, at: int, step: int) -> np.ndarray:
    """Energy of all channels by 100 ms of the program, of samples that begin `at` samples into it."""
    cuts = np.arange(at // step + 1, (at + len(y) - 1) // step + 1) * step - at
    return np.add.reduceat((y * y).sum(axis=1), np.concatenate([[0], cuts])) if len(y) else np.zeros(0)


def _gated(steps: np.ndarray, step: int) -> float:
    """Loudness from the energies of whole 100 ms: blocks of 400 ms every 100 ms, -70 absolute and -10 relative gate."""
    z = (steps[:-3] + steps[1:-2] + steps[2:-1] + steps[3:]) / (4 * step) if len(steps) > 3 else np.zeros(0)
    loud = lambda p: -0.691 + 10 * np.log10(np.maximum(p, 1e-30))
    z = z[loud(z) > FLOOR]
    if len(z):
        z = z[loud(z) > loud(z.mean()) - 10]
    return max(FLOOR, float(loud(z.mean()))) if len(z) else FLOOR


def integrated(x: np.ndarray, rate: int) -> float:
    """Gated loudness of samples by channel."""
    step = rate // 10
    return _gated(_energies(_weighted(x, rate, np.zeros((4, x.shape[1]))), 0, step)[: len(x) // step], step)


@lru_cache
def _oversampler(factor: int = 4, taps: int = 12) -> np.ndarray:
    """Windowed-sinc phases."""
    t = np.arange(-taps * factor, taps * factor + 1) / factor
    h = np.sinc(t) * np.hanning(len(t) + 2)[1:-1]
    return np.stack([np.pad(h[p::factor], (0, 2 * taps + 1 - len(h[p::factor]))) for p in range(factor)])


def _top(x: np.ndarray, before: np.ndarray, ends: bool) -> float:
    """Largest magnitude of the 4 times oversampled x, which goes on where `before` stopped and, unless it ends, goes on itself."""
    whole = np.concatenate([before, x])
    if not len(whole):
        return 0.0
    tops = [np.abs(np.convolve(c, phase)[len(before) : len(whole) + ends * TAIL]) for c in whole.T for phase in _oversampler()]
    return float(np.max([t.max() for t in [*tops, np.abs(x)] if t.size], initial=0.0))


def true_peak(x: np.ndarray) -> float:
    """Largest magnitude of the 4 times oversampled signal in dB, not below the floor."""
    return _decibels(_top(x, x[:0], True))


def _decibels(top: float) -> float:
    return max(FLOOR, 20 * np.log10(top)) if top > 0 else FLOOR


#: Samples of a track in one row between the passes, those before it that the oversampler still needs, rows that a worker gives
#: back at once, bytes that it gets at once, rows of a row group (a limit in bytes counts compressed ones, but a reader's batch is as large as
#: the group is without), and the runs whose starts are broadcast.
CHUNK, TAIL, ROWS, BATCH_BYTES, GROUP_ROWS, STARTS = 4 * BLOCK, 24, 16, 4 << 20, 64, 50_000


class _Run:
    """What one task reads of one track, cut into chunks, as if the program began with it."""

    def __init__(self, rate: int) -> None:
        self.rate, self.held, self.size, self.at, self.state, self.before = rate, [np.zeros((0, 2))], 0, 0, np.zeros((4, 2)), np.zeros((0, 2))

    def add(self, x: np.ndarray) -> Iterator[tuple]:
        self.held.append(x)
        self.size += len(x)
        if self.size > CHUNK:
            x = np.concatenate(self.held)
            while len(x) > CHUNK:
                yield *self.cut(x[:CHUNK]), None, None, None
                x = x[CHUNK:]
            self.held, self.size = [x], len(x)

    def cut(self, x: np.ndarray) -> tuple:
        out = self.at, self.state.tobytes(), self.before.tobytes(), x.tobytes()
        whole = np.concatenate([self.before, x])
        self.at, self.state, self.before = self.at + len(x), _gone_on(x, self.rate, self.state), whole[max(0, len(whole) - TAIL) :]
        return out

    def close(self) -> tuple:
        return *self.cut(np.concatenate(self.held)), self.at, self.state.tobytes(), self.before.tobytes()


def _samples(l, r) -> np.ndarray:
    """A frame's channels as columns; a null is a frame without samples, what is null or infinite in it is no number."""
    x = [np.zeros(0) if c.values is None else c.values.to_numpy(zero_copy_only=False) for c in (l, r)]
    if len(x[0]) != len(x[1]):
        raise ValueError(f"channels of {len(x[0])} and {len(x[1])} samples in one frame")
    x = np.stack(x, axis=1)
    return np.where(np.isfinite(x), x, np.nan)


def _chunks(frames: DataFrame, names: list[str], order: list[str], rate: int) -> DataFrame:
    """Frames in order as chunks of at most CHUNK samples, staged: the runs are numbered by `part` and `run`, a chunk begins at
    `at` of its run with `state` and `before`; a run's last one has its `size` and the `end` and `tail` that it leaves."""
    cols = [F.col(c).asc_nulls_last() for c in [*names, *order]]
    partitions = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = "part int, run bigint, at bigint, state binary, before binary, x binary, size bigint, end binary, tail binary"
    schema = T.StructType([*(T.StructField(c, frames.schema[c].dataType) for c in names), *T.StructType.fromDDL(own).fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, label, kinds, rows = TaskContext.get().partitionId(), -1, None, [], []

        def given() -> pa.RecordBatch:
            kept = [pa.array(c, k) for c, k in zip(zip(*rows), [*kinds, pa.int32(), *[pa.int64()] * 2, *[pa.binary()] * 3, pa.int64(), *[pa.binary()] * 2])]
            rows.clear()
            return pa.RecordBatch.from_arrays(kept, names=schema.names)

        for batch in batches:
            kinds = [batch.schema.field(c).type for c in names]
            for new, l, r in zip(zip(*(batch.column(c).to_pylist() for c in names)), batch.column("l"), batch.column("r")):
                if number < 0 or new != label:
                    if number >= 0:
                        rows.append((*label, part, number, *run.close()))
                    number, label, run = number + 1, new, _Run(rate)
                for row in run.add(_samples(l, r)):
                    rows.append((*label, part, number, *row))
                    if len(rows) >= ROWS:
                        yield given()
                if len(rows) >= ROWS:
                    yield given()
        if number >= 0:
            rows.append((*label, part, number, *run.close()))
            yield given()

    ordered = frames.select(*names, *order, "l", "r").repartitionByRange(partitions, *cols).sortWithinPartitions(*cols)
    with arrow_batches(frames.sparkSession, BATCH_BYTES):
        return staged(ordered.mapInArrow(work, schema), "programs", **{"parquet.block.row.count.limit": GROUP_ROWS, "parquet.enable.dictionary": "false"})


def _starts(runs: DataFrame, key: list[str], within: list[str], rate: int) -> DataFrame:
    """By run: where it begins in its program, the filter's states there, the track's last samples before, and whether it ends the track."""

    def scan(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["part", "run"], ignore_index=True)
        now, was = p[within].iloc[1:].reset_index(drop=True), p[within].iloc[:-1].reset_index(drop=True)
        same = ((now == was) | (now.isna() & was.isna())).all(axis=1).tolist()  # tracks that go on
        one, state, at, tail, out = _system(rate)[2], np.zeros((4, 2)), 0, np.zeros((0, 2)), []
        for goes_on, ends, part, run, size, end, left in zip([False, *same], [not s for s in [*same, False]], p["part"], p["run"], p["size"], p["end"], p["tail"]):
            tail = tail if goes_on else tail[:0]
            out.append((part, run, at, state.tobytes(), tail.tobytes(), ends))
            at, state = at + size, np.linalg.matrix_power(one, int(size)) @ state + np.frombuffer(end).reshape(4, 2)
            tail = np.concatenate([tail, np.frombuffer(left).reshape(-1, 2)])[-TAIL:]
        return pd.DataFrame(out, columns=["part", "run", "run_at", "run_state", "run_before", "run_ends"])

    return runs.groupBy(*key).applyInPandas(scan, "part int, run bigint, run_at bigint, run_state binary, run_before binary, run_ends boolean")


def loudness(frames: DataFrame, key: list[str], order: list[str], rate: int, within: tuple[str, ...] = ()) -> DataFrame:
    """(key..., lufs, peak_db) of frames (arrays l and r) in order: key a track, or an album for its whole program. `within` names
    an album's tracks, which come before `order`: the program runs on from one to the next, the peak is the greatest of theirs.

    Frames in order become chunks with the filter's states as if each run were a program; the runs' own starts follow from
    sizes and states alone, and each chunk is then metered by itself. No task holds a program, only its energies by 100 ms."""
    keys, parts, orders = ([f"{k}{i}" for i in range(len(c))] for k, c in (("k", key), ("w", within), ("o", order)))
    named = [F.col(f"`{c}`").alias(n) for c, n in zip([*key, *within, *order], [*keys, *parts, *orders])]
    samples = [F.col(c).cast("array<double>").alias(c) for c in ("l", "r")]
    chunks = _chunks(frames.select(*named, *samples), [*keys, *parts], orders, rate)
    runs = chunks.where("size is not null").select(*keys, *parts, "part", "run", "size", "end", "tail")
    starts = _starts(runs, keys, parts, rate)
    step = rate // 10
    fields = [T.StructField(k, chunks.schema[k].dataType) for k in [*keys, *parts]]

    def meter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _system(rate)[2]
        for batch in batches:
            at, size, energies, peaks = [], [], [], []
            for own, state, before, x, whole, begin, first, ahead, ends in zip(*(batch.column(c).to_pylist() for c in ("at", "state", "before", "x", "size", "run_at", "run_state", "run_before", "run_ends"))):
                x, state, first, before, ahead = (np.frombuffer(v).reshape(-1, 2) for v in (x, state, first, before, ahead))
                y = _weighted(x, rate, np.linalg.matrix_power(one, own) @ first + state)
                at.append(begin + own)
                size.append(len(x))
                energies.append(_energies(y, begin + own, step))
                peaks.append(_top(x, np.concatenate([ahead, before])[-TAIL:], ends and whole is not None))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in [*keys, *parts]), pa.array(at, pa.int64()), pa.array(size, pa.int64()), pa.array(energies, pa.list_(pa.float64())), pa.array(peaks, pa.float64())], names=[*keys, *parts, "at", "size", "energies", "peak"])

    def whole(names: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["at", "size"], kind="stable")
        steps = np.concatenate([np.zeros(0, int), *(a // step + np.arange(len(e)) for a, e in zip(p["at"], p["energies"]))])
        total = np.bincount(steps, np.concatenate([np.zeros(0), *p["energies"]]))
        tracks = [g for _, g in p.groupby(parts, dropna=False)] if parts else [p]
        return pd.DataFrame([[*names, _gated(total[: p["size"].sum() // step], step), max(_decibels(g["peak"].to_numpy().max()) for g in tracks)]], columns=[*keys, "lufs", "peak_db"])

    met = chunks.drop("end", "tail").join(F.broadcast(starts) if runs.count() <= STARTS else starts, ["part", "run"])
    with arrow_batches(frames.sparkSession, BATCH_BYTES):
        met = staged(met.mapInArrow(meter, T.StructType([*fields, *T.StructType.fromDDL("at bigint, size bigint, energies array<double>, peak double").fields])), "meters")
    out = met.groupBy(*keys).applyInPandas(whole, T.StructType([*fields[: len(keys)], *T.StructType.fromDDL("lufs double, peak_db double").fields]))
    return out.toDF(*key, "lufs", "peak_db")


def album_peak(tracks: DataFrame, album: str, peak: str = "peak_db") -> DataFrame:
    """Peaks merge by maximum; loudness doesn't."""
    return tracks.groupBy(album).agg(F.max(peak).alias(peak))


# ---- frames as arrays -------------------------------------------------------

def mid_side(l: Column, r: Column) -> tuple[Column, Column]:
    return F.zip_with(l, r, lambda a, b: (a + b) / 2), F.zip_with(l, r, lambda a, b: (a - b) / 2)


def left_right(m: Column, s: Column) -> tuple[Column, Column]:
    return F.zip_with(m, s, lambda a, b: a + b), F.zip_with(m, s, lambda a, b: a - b)


def silent(x: Column) -> Column:
    return F.forall(x, lambda v: v == 0)


def energy(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v)


def block_peaks(x: Column, blocks: int, size: int) -> Column:
    """Peak of each of so many consecutive blocks."""
    return F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.array_max(F.transform(F.slice(x, i * size + 1, size), lambda v: F.abs(v).cast("double"))))


def worst(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def quantised(x: Column, multiplier: Column, levels: int) -> Column:
    """Rounded to even, centred on `levels`, within 0..2 levels."""
    return F.transform(x, lambda v: F.least(F.greatest(F.rint(v.cast("double") * multiplier) + levels, F.lit(0.0)), F.lit(2.0 * levels)).cast("int"))


def restored(q: Column, step: Column, levels: int) -> Column:
    return F.transform(q, lambda v: (v - levels) * step)


def scale_factor(n: Column) -> Column:
    """Steps of 1/1.26 tenths of a decade."""
    return F.pow(F.lit(10.0), -0.1 * (n - 1) / 1.26)


def noise_to_signal(x: Column, y: Column) -> Column:
    """Energy of the difference over the energy of x; 0 for silence."""
    e = energy(x)
    return F.when(e > 0, energy(F.zip_with(x, y, lambda a, b: a - b)) / e).otherwise(0.0)


def transient_noise(x: Column, y: Column, parts: int = 3, size: int = 12) -> Column:
    """The worst ratio of consecutive parts."""
    part = lambda c, i: F.slice(c, i * size + 1, size)
    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: noise_to_signal(part(x, i), part(y, i))))


# How much of a line of a subband's edge shows up in the neighbour, from the edge inwards.
ALIASES = (0.5, 0.2776, 0.1176, 0.0361, 0.0075, 0.000948, 0.0000598)


def band_energies(lines: Column, width: int = 16, bands: int = 32) -> Column:
    """Energy by subband of spectral lines; near an inner edge a line counts in part as its mirror image does."""
    share = F.array(*map(F.lit, ALIASES))

    def line(k: Column, n: Column) -> Column:
        at = k * width + n
        own = F.get(lines, at)
        low = F.when((n < len(ALIASES)) & (k > 0), F.get(share, n) * (F.get(lines, k * width - 1 - n) - own))
        high = F.when((n >= width - len(ALIASES)) & (k < bands - 1), F.get(share, width - 1 - n) * (F.get(lines, at + 2 * (width - n) - 1) - own))
        return own + F.coalesce(low, high, F.lit(0.0))

    n = F.least(F.floor(F.size(lines) / width).cast("int"), F.lit(bands))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: line(k, i)), F.lit(0.0), lambda a, v: a + v))


def partition_energies(lines: Column, bounds: list[int], roots: tuple[int, int], weights: Column | None = None) -> Column:
    """Energy of consecutive partitions of lines, `bounds` their first lines and the end; weighted by line if so asked. Partitions
    number roots[0] up to roots[1] add amplitudes, not energies, and have the mean power of that sum."""
    x = lines if weights is None else F.zip_with(lines, weights, lambda a, b: a * b)
    out = []
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        part = F.slice(x, a + 1, b - a)
        if roots[0] <= i < roots[1]:
            amplitude = F.aggregate(part, F.lit(0.0), lambda s, v: s + F.sqrt(v))
            out.append(amplitude * amplitude / (b - a))
        else:
            out.append(F.aggregate(part, F.lit(0.0), lambda s, v: s + v))
    return F.array(*out)


def framed(x: Column, size: int, ahead: int = 0) -> Column:
    """An array of samples as frames of so many, each with the samples ahead of it that there are."""
    n = F.greatest(F.ceil(F.size(x) / size).cast("int"), F.lit(1))
    return F.filter(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(x, i * size + 1, size + ahead)), lambda f: F.size(f) > 0)


def encode_blocks(x: Column, size: int = 1152, ahead: int = 0) -> Column:
    """struct(samples, silent) by frame: what an encoder works through, silent frames to be skipped."""
    return F.transform(framed(x, size, ahead), lambda f: F.struct(f.alias("samples"), silent(F.slice(f, 1, size)).alias("silent")))


def signal_to_mask(lines: Column, threshold: Column, width: int = 16) -> Column:
    """By band: energy over 16 and the least threshold of its lines."""
    n = F.floor(F.size(lines) / width).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.aggregate(F.slice(lines, b * width + 1, width), F.lit(0.0), lambda a, v: a + v) / width / F.array_min(F.slice(threshold, b * width + 1, width)))


def use_mid_side(l: Column, r: Column, m: Column, s: Column) -> Column:
    """Whether coding the sum and difference needs less: products of energies of at least 1, by band."""
    bits = lambda a, b: F.zip_with(a, b, lambda x, y: F.log2(F.greatest(F.lit(1.0), x)) + F.log2(F.greatest(F.lit(1.0), y)))
    return F.zip_with(bits(l, r), bits(m, s), lambda a, b: b < a)


def pre_echo_limited(frames: DataFrame, key: str, order: str, threshold: str, factor: float = 2.0) -> DataFrame:
    """Thresholds no more than so many times the frame before."""
    from pyspark.sql import Window as W

    before = F.lag(threshold).over(W.partitionBy(key).orderBy(order))
    return frames.withColumn("limited", F.when(before.isNull(), F.col(threshold)).otherwise(F.zip_with(F.col(threshold), before, lambda a, b: F.least(a, b * factor))))


# ---- spectra and filterbanks --------------------------------------------------

def _by_frame(column: Column, work, kind: str = "array<double>") -> Column:
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = [None] * len(s)
            sizes = s.map(lambda v: -1 if v is None else len(v))
            for n in set(sizes) - {-1}:  # frames of one length are one matrix
                at = np.flatnonzero(sizes.to_numpy() == n)
                for i, row in zip(at, work(np.stack(s.iloc[at].to_numpy()).astype(float))):
                    out[i] = row
            yield pd.Series(out)

    return run(column)


def power_spectrum(x: Column) -> Column:
    """Of Hann-windowed frames."""
    return _by_frame(x, lambda m: np.abs(np.fft.rfft(m * np.hanning(m.shape[1] + 1)[:-1], axis=1)) ** 2)


def cepstrum(x: Column) -> Column:
    return _by_frame(x, lambda m: np.fft.irfft(np.log(np.abs(np.fft.rfft(m, axis=1)) + 1e-12), m.shape[1], axis=1))


def cosine_window(n: int) -> np.ndarray:
    """A raised cosine over the middle half of its length, of unit height."""
    half = np.cos((np.arange(n // 2) + 0.5) * np.pi / n) ** 2
    return np.concatenate([half[::-1], half])


def windowed_spectrum(x: Column, window: str = "kaiser") -> Column:
    """Power spectra under a Kaiser-Bessel derived or a cosine window."""
    make = {"kaiser": kaiser_bessel, "cosine": cosine_window}[window]
    return _by_frame(x, lambda m: np.abs(np.fft.rfft(m * make(m.shape[1]), axis=1)) ** 2)


def phases(x: Column) -> Column:
    """Of the lines of Hann-windowed frames; with the roots of the power spectrum the polar form."""
    return _by_frame(x, lambda m: np.angle(np.fft.rfft(m * np.hanning(m.shape[1] + 1)[:-1], axis=1)))


def kaiser_bessel(n: int, alpha: float = 4.0) -> np.ndarray:
    """A power-complementary window."""
    w = np.cumsum(np.kaiser(n // 2 + 1, np.pi * alpha))
    half = np.sqrt(w[:-1] / w[-1])
    return np.concatenate([half, half[::-1]])


def bark(hz: np.ndarray) -> np.ndarray:
    return 13 * np.arctan(0.00076 * hz) + 3.5 * np.arctan((hz / 7500) ** 2)


def hearing_threshold(hz: np.ndarray) -> np.ndarray:
    """Absolute threshold in dB."""
    k = np.maximum(hz, 20) / 1000
    return 3.64 * k**-0.8 - 6.5 * np.exp(-0.6 * (k - 3.3) ** 2) + 1e-3 * k**4


def masking(power: Column, rate: int) -> Column:
    """Masked thresholds of power spectra: spread over the bark scale, lowered by the masker's offset, not below hearing."""

    def work(m: np.ndarray) -> np.ndarray:
        hz = np.linspace(0, rate / 2, m.shape[1])
        d = bark(hz)[:, None] - bark(hz)[None, :]
        spread = 10 ** ((15.81 + 7.5 * (d + 0.474) - 17.5 * np.sqrt(1 + (d + 0.474) ** 2)) / 10)
        return np.maximum(m @ spread.T * 10**-1.4, 10 ** (hearing_threshold(hz) / 10) * 1e-6)

    return _by_frame(power, work)


@lru_cache
def cosine_bank(bands: int = BANDS, taps: int = 512) -> np.ndarray:
    """A cosine-modulated bank: rows are analysis filters of a windowed low pass."""
    n = np.arange(taps)
    # a cutoff at which neighbouring bands add up to one, to within 0.01 of the amplitude
    proto = np.sinc(1.12 * (n - (taps - 1) / 2) / (2 * bands)) * np.kaiser(taps, 7.0)
    proto /= proto.sum()
    k = np.arange(bands)[:, None]
    return 2 * proto * np.cos((2 * k + 1) * np.pi / (2 * bands) * (n - (taps - 1) / 2) + (-1.0) ** k * np.pi / 4)


def bank_of(prototype: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A cosine-modulated bank of a given low pass, such as a format prescribes."""
    n, k = np.arange(len(prototype)), np.arange(bands)[:, None]
    return prototype * np.cos((2 * k + 1) * np.pi / (2 * bands) * (n - (len(prototype) - 1) / 2) + (-1.0) ** k * np.pi / 4)


def analysed(x: np.ndarray, bands: int = BANDS, bank: np.ndarray | None = None) -> np.ndarray:
    """Subband samples (rows of bands) of one channel, every `bands` samples."""
    h = cosine_bank(bands) if bank is None else bank
    padded = np.concatenate([np.zeros(h.shape[1] - 1), x, np.zeros(-len(x) % bands)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, h.shape[1])[bands - 1 :: bands]
    return windows @ h[:, ::-1].T


def synthesised(s: np.ndarray, bands: int = BANDS, bank: np.ndarray | None = None) -> np.ndarray:
    """The inverse, delayed by a filter's length less one."""
    h = (cosine_bank(bands) if bank is None else bank)[:, ::-1]
    out = np.zeros((len(s) + 1) * bands + h.shape[1])
    for i, row in enumerate(s @ h):
        at = (i + 1) * bands - 1
        out[at : at + h.shape[1]] += row
    return out[: len(s) * bands] * bands


def subbands(frames: DataFrame, key: str, order: str, samples: str) -> DataFrame:
    """(key, step, bands): each track's samples through the bank, in order."""
    kind = frames.schema[key].dataType.simpleString()

    def run(names: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.concatenate([np.zeros(0), *pdf.sort_values(order, kind="stable")[samples]])
        s = analysed(x)
        return pd.DataFrame({key: [names[0]] * len(s), "step": np.arange(len(s)), "bands": list(s)})

    return frames.groupBy(key).applyInPandas(run, f"`{key}` {kind}, step bigint, bands array<double>")


def predictor(x: np.ndarray, order: int = 6) -> np.ndarray:
    """Linear prediction coefficients by the Durbin recursion on the autocorrelation."""
    r = np.array([x[: len(x) - k] @ x[k:] for k in range(order + 1)])
    a, err = np.zeros(order), r[0]
    for i in range(order):
        if err <= 0:
            break
        k = (r[i + 1] - a[:i] @ r[i:0:-1]) / err
        a[:i], a[i] = a[:i] - k * a[:i][::-1], k
        err *= 1 - k * k
    return a


def predictors(x: Column, order: int = 6) -> Column:
    return _by_frame(x, lambda m: np.stack([predictor(v, order) for v in m]))


def shaped(x: Column, feedback: list[float], step: float) -> Column:
    """Quantised with the errors of earlier samples fed back: a fold over each frame."""
    taps = np.array(feedback)

    def work(m: np.ndarray) -> np.ndarray:
        errors, out = np.zeros((len(m), len(taps))), np.empty_like(m)
        for i in range(m.shape[1]):  # frames side by side
            want = m[:, i] - errors @ taps
            out[:, i] = np.rint(want / step)
            errors = np.column_stack([out[:, i] * step - want, errors[:, :-1]])
        return out

    return _by_frame(x, work)


def unpredictability(frames: DataFrame, key: str, order: str, spectrum: str) -> DataFrame:
    """`chaos`: distance of each magnitude from its extrapolation by the two spectra before, over their sum."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy(order)
    guess = F.zip_with(F.lag(spectrum, 1).over(w), F.lag(spectrum, 2).over(w), lambda a, b: 2 * a - b)
    return frames.withColumn("chaos", F.zip_with(F.col(spectrum), guess, lambda a, g: F.abs(a - g) / (F.abs(a) + F.abs(g) + 1e-12)))


def random_words(n: int, seed: tuple[int, int] = (1, 1)) -> np.ndarray:
    """Words of the generator that fills noise bands: two shift registers combined."""
    return noise(seed, n)[0]


def allocate(signal: Column, mask: Column, most: int = 17) -> Column:
    """Resolution by band: each step halves the noise amplitude; raised until noise is at the mask or the limit is reached."""
    return F.zip_with(signal, mask, lambda s, m: F.when(s <= m, 0).otherwise(F.least(F.lit(most), F.ceil(F.log2(s / m) / 2))).cast("int"))


#: The factor of one scale factor step, and the last resolution whose samples have a Huffman code.
SCALE_STEP, LAST_CODED = 10 ** (0.1 / 1.26), 8


def measured_noise(x: np.ndarray, res: np.ndarray, comp: np.ndarray, transient: np.ndarray) -> np.ndarray:
    """Noise to signal of rows of 36 samples quantised at their resolution, of the worst third where the row is transient. While
    the signal is the louder, the row's own factor for audibility counts."""
    step = np.array([65536.0 / (2 * top(r) + 1) if r else 65536.0 for r in range(18)])[res][:, None]
    parts = x.reshape(len(x), 3, -1)
    error = ((np.rint(parts / step[:, :, None]) * step[:, :, None] - parts) ** 2).sum(axis=2) + 1e-30
    power = (parts**2).sum(axis=2) + 1e-30
    whole = transient[:, None]
    error, power = (np.where(whole, v, v.sum(axis=1, keepdims=True)) for v in (error, power))
    return np.where(power > error, error / (comp[:, None] * power), error / power).max(axis=1)


def allocated(frames: DataFrame, samples: str, ratios: str, comp: str, transients: str, noise_share: float = 0.0, most: int = 15) -> DataFrame:
    """`res` and `steps` of frames: samples are bands of 36 after their scale factors, ratios signal-to-mask by band.

    By band the resolution rises until measured noise is at the mask. Then, up to the last coded resolution, the scale factors
    are stepped down, which scales the samples up, as long as noise stays there; `steps` tells how often. A steady band of
    little resolution before it, whose ratio is below its number times `noise_share`, becomes noise (-1).
    Frames are independent; in a batch they go side by side, band after band."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = len(b)
            if not n:
                continue
            x = np.stack(b[samples].to_numpy()).astype(float).reshape(n, -1, 36)
            smr, factor, moving = (np.stack(b[c].to_numpy()).astype(t) for c, t in ((ratios, float), (comp, float), (transients, bool)))
            res, steps = np.zeros((n, x.shape[1]), int), np.zeros((n, x.shape[1]), int)
            for k in range(x.shape[1]):
                part, r, s, f, m = x[:, k].copy(), res[:, k], smr[:, k], factor[:, k], moving[:, k]
                if k:
                    r[(res[:, k - 1] < 3) & (s >= 1) & (s < k * noise_share) & steady((part.reshape(n, 3, -1) ** 2).sum(axis=2))] = -1
                ratio = s.copy()
                while (up := (r >= 0) & (ratio > 1) & (r < most)).any():
                    r[up] += 1
                    ratio[up] = s[up] * measured_noise(part[up], r[up], f[up], m[up])
                down = (r > 0) & (r <= LAST_CODED) & (ratio < 1) & (ratio > 0) & ~m
                # a scale factor has at most 63 steps below it
                for _ in range(63):
                    if not down.any():
                        break
                    tried = part[down] * SCALE_STEP
                    fits = s[down] * measured_noise(tried, r[down], f[down], m[down]) <= 1
                    at = np.flatnonzero(down)
                    part[at[fits]] = tried[fits]
                    steps[at[fits], k] += 1
                    down[at[~fits]] = False
            yield b.assign(res=list(res.astype(np.int32)), steps=list(steps.astype(np.int32)))

    return frames.mapInPandas(run, f"{fields}, res array<int>, steps array<int>")


def steady(power: np.ndarray) -> np.ndarray:
    """Whether the energies of three parts neither double nor fall to a quarter."""
    a, b, c = power.T
    return ~((a < 0.5 * b) | (b < 0.5 * c) | (a < 0.5 * c) | (b < 0.25 * a) | (c < 0.25 * b) | (c < 0.25 * a))
