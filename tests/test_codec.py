"""Bit codes and coded frames: round trips, known values, broken input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.functions import bits
from tessitura.operators import codec


def test_fields_and_codes_round_trip():
    r = random.Random(1)
    w, want = codec.Writer(), []
    for _ in range(3000):
        kind = r.randrange(4)
        if kind == 0:
            n = r.randrange(1, 32)
            want.append((kind, n, r.randrange(1 << n)))
            w.put(want[-1][2], n)
        elif kind == 1:
            want.append((kind, k := r.randrange(13), n := r.randrange(1 << 14)))
            w.golomb(n, k)
        elif kind == 2:
            want.append((kind, m := r.randrange(33), n := r.randrange(m + 1)))
            w.truncated(n, m)
        else:
            size = r.randrange(1, 33)
            want.append((kind, size, n := r.randrange(1 << size)))
            w.chosen(n, n.bit_count(), size)
    got = codec.Reader(w.data())
    for kind, a, n in want:
        assert n == (got.get(a) if kind == 0 else got.golomb(a) if kind == 1 else got.truncated(a) if kind == 2 else got.chosen(n.bit_count(), a))
    with pytest.raises(ValueError):
        got.get(8)


def test_known_codes():
    w = codec.Writer()
    w.put(0b10110011, 8)
    w.golomb(5, 1)  # 001 1
    w.truncated(3, 4)  # 5 numbers: 00 01 10 110 111
    assert w.data() == bytes([0b10110011, 0b00111100])
    assert [codec.top(r) for r in range(1, 10)] == [1, 2, 3, 4, 7, 15, 31, 63, 127]
    assert codec.noise((1, 1), 3)[0].tolist() == [0x80000000 ^ 2, 0x40000000 ^ 4, 0x20000000 ^ 8]


def test_huffman_lengths_are_optimal_and_canonical():
    assert codec.code_lengths([5, 9, 12, 13, 16, 45]) == [4, 4, 3, 3, 3, 1] and codec.code_lengths([1]) == [1]
    c = codec.Code((4, 4, 3, 3, 3, 1))
    assert c.codes == (14, 15, 4, 5, 6, 0)
    with pytest.raises(ValueError):
        codec.Code((1, 1, 1))
    g = codec.geometric(125, 62, 20.0)
    assert sum(2.0**-n for n in g.lengths) == 1 and g.most <= 16


def _frames(r, n, max_band):
    out, before = [], None
    for _ in range(n):
        f = codec.Frame.empty()
        for b in range(r.randrange(max_band + 2)):
            for c in (0, 1):
                f.res[c, b] = res = r.choice([-1, 0, 0, 1, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 11, 15])
                if res:
                    s = r.randrange(20, 60) if before is None else int(np.clip(before.scale[c, b, 2] + r.randrange(-10, 10), 0, 100))
                    f.scale[c, b] = [s, s + r.choice([0, 0, 3]), s + r.choice([0, -4])]
                if res > 0:
                    f.samples[c, b] = [r.randint(-codec.top(res), codec.top(res)) for _ in range(36)]
            f.mid_side[b] = f.res[:, b].any() and r.random() < 0.5
        out.append(f)
        before = f
    return out


@pytest.mark.parametrize("seed", range(6))
def test_frames_round_trip(seed):
    r = random.Random(seed)
    frames = _frames(r, 8, 20 + seed)
    data = codec.encode_block(frames, 20 + seed, True)
    got = codec.decode_block(data, 8, 20 + seed, True)
    seed_ = (1, 1)
    for a, b in zip(frames, got):
        assert (a.res == b.res).all() and (a.mid_side == b.mid_side).all()
        on = a.res != 0
        assert (a.scale[on] == b.scale[on]).all() and (a.samples[a.res >= 0] == b.samples[a.res >= 0]).all()
        x = codec.requantised(b)
        m = a.mid_side & (a.res.min(axis=0) > 0)
        assert np.isfinite(x).all() and np.allclose((x[0] + x[1])[m] / 2, a.samples[0][m] * (65536 / (2 * np.vectorize(codec.top, otypes=[int])(a.res[0][m]) + 1))[:, None] * np.repeat(10 ** (-0.1 * (a.scale[0][m] - 1) / 1.26), 12, axis=1) / 32768)
        assert (a.res == -1).sum() == 0 or np.abs(b.samples[a.res == -1]).max() <= 510
    assert seed_ and codec.encode_block(got, 20 + seed, True) == data
    for cut in range(0, len(data) - 4, 97):
        with pytest.raises(ValueError):
            codec.decode_block(data[:cut], 8, 20 + seed, True)


def test_old_frames_round_trip_and_transcode():
    r = random.Random(4)
    frames = _frames(r, 10, 18)
    for f in frames:
        f.res[(f.res == -1) | (f.res == 15)] = 1
        f.samples = np.clip(f.samples, -1, 1) * (f.res > 0)[:, :, None]
        f.scale = np.clip(f.scale, 0, 63)
        f.mid_side &= f.res.any(axis=0)
    data = codec.old_data(frames, 18, True)
    got = codec.old_frames(data, 10, 18, True)
    same = lambda a, b: (a.res == b.res).all() and (a.mid_side == b.mid_side).all() and (a.scale[a.res != 0] == b.scale[a.res != 0]).all() and (a.samples == b.samples).all()
    assert all(map(same, frames, got))
    blocks = codec.transcoded(data, 10, 18, True, 2)
    assert len(blocks) == 3 and all(map(same, frames, [f for b, n in zip(blocks, (4, 4, 2)) for f in codec.decode_block(b, n, 18, True)]))
    with pytest.raises(ValueError):
        codec.old_frames(data[:-20], 10, 18, True)


def test_blocks_as_tables(spark):
    r = random.Random(9)
    blocks = [_frames(r, 4, 12) for _ in range(5)]
    d = spark.createDataFrame([(i, [(f.res.reshape(-1).tolist(), f.mid_side.tolist(), f.scale.reshape(-1).tolist(), f.samples.reshape(-1).tolist()) for f in fs]) for i, fs in enumerate(blocks)], f"id int, frames array<struct<{codec.FRAMES.replace(' array', ':array').replace(', ', ',')}>>")
    e = codec.encoded(d, "frames", 12, True)
    rows = codec.decoded(e, "payload", "n", 12, True).collect()
    assert len(rows) == 20 and not [x for x in rows if x.error]
    assert all(x.res == blocks[x.id][x.frame].res.reshape(-1).tolist() for x in rows)
    broken = e.withColumn("payload", F.expr("substring(payload, 1, 9)"))
    assert {x.id for x in codec.decoded(broken, "payload", "n", 12, True).where("error is not null").collect()} == set(range(5))


def test_native_codes_agree_with_the_writer(spark):
    d = spark.range(200).select((F.col("id") % 21).alias("n"), F.lit(20).cast("long").alias("most"), F.col("id"))
    for x in d.select("n", bits.truncated_code(F.col("n"), F.col("most")).alias("c")).select("n", "c.*", bits.from_truncated(F.col("c.code"), F.col("c.bits"), F.lit(20).cast("long")).alias("back")).collect():
        w = codec.Writer()
        w.truncated(x.n, 20)
        assert (w.values[0], w.sizes[0], x.n) == (x.code, x.bits, x.back)
    b = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.call_function("shiftright", F.col("id"), i).bitwiseAND(F.lit(1)).cast("int"))
    x = spark.range(1024).select(b.alias("b")).select("b", bits.enumerative_set(bits.enumerative_index(F.col("b"), 10), F.aggregate("b", F.lit(0), lambda a, v: a + v), 10).alias("back"))
    assert x.where("b <> back").count() == 0
    data = bytes([0b10110011, 0b01011100, 0xFF])
    got = spark.createDataFrame([(bytearray(data),)], "d binary").select(*(bits.field(F.col("d"), a, n) for a, n in ((0, 3), (5, 6), (7, 1), (3, 21)))).first()
    whole = int.from_bytes(data)
    assert list(got) == [whole >> 24 - a - n & (1 << n) - 1 for a, n in ((0, 3), (5, 6), (7, 1), (3, 21))]
