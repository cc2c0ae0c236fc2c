"""Variable-length integers, Golomb and truncated-binary codes, enumerative codes and generators, as expressions."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column
from pyspark.sql import functions as F


def varint(n: Column) -> Column:
    """Seven bits a byte, most significant first; all but the last byte have the top bit set. An array of byte values."""
    count = F.greatest(F.ceil((F.length(F.bin(n)) / 7)).cast("int"), F.lit(1))
    return F.transform(F.sequence(count - 1, F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftright", n, i * 7).bitwiseAND(F.lit(127)) + F.when(i > 0, 128).otherwise(0))


def from_varint(data: Column) -> Column:
    """The number at the start of an array of byte values; null if none ends there."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(False).alias("done"))
    step = lambda a, b: F.when(a["done"], a).otherwise(F.struct((a["n"] * 128 + b.bitwiseAND(F.lit(127))).cast("long").alias("n"), (b < 128).alias("done")))
    return F.aggregate(data, start, step, lambda a: F.when(a["done"], a["n"]))


def varint_size(n: Column) -> Column:
    return F.greatest(F.ceil(F.length(F.bin(n)) / 7), F.lit(1)).cast("int")


def golomb(n: Column, k: int) -> Column:
    """struct(unary, rest, bits) of the Golomb-Rice code with parameter k."""
    q = F.shiftright(n, k)
    return F.struct(q.alias("unary"), n.bitwiseAND(F.lit((1 << k) - 1)).alias("rest"), (q + 1 + k).alias("bits"))


def truncated_bits(n: Column, most: Column) -> Column:
    """Bits of the truncated binary code of n in 0..most."""
    width = F.length(F.bin(most))
    spare = F.expr("1L") * F.pow(F.lit(2.0), width).cast("long") - most - 1
    return F.when(n < spare, width - 1).otherwise(width)


def truncated_code(n: Column, most: Column) -> Column:
    """struct(code, bits) of the truncated binary code of n in 0..most: the lower numbers take a bit less."""
    width = F.length(F.bin(most))
    spare = F.expr("1L") * F.pow(F.lit(2.0), width).cast("long") - most - 1
    return F.struct(F.when(n < spare, n).otherwise(n + spare).alias("code"), F.when(n < spare, width - 1).otherwise(width).alias("bits"))


def from_truncated(code: Column, bits: Column, most: Column) -> Column:
    """The number of such a code."""
    width = F.length(F.bin(most))
    return F.when(bits < width, code).otherwise(code - (F.pow(F.lit(2.0), width).cast("long") - most - 1))


def field(data: Column, at: int, width: int) -> Column:
    """`width` bits (up to 63) of a binary value from bit `at` on, the most significant first."""
    first, last = at // 8, (at + width - 1) // 8
    word = F.conv(F.hex(F.substring(data, first + 1, last - first + 1)), 16, 10).cast("long")
    return F.shiftright(word, (last + 1) * 8 - at - width).bitwiseAND(F.lit((1 << width) - 1))


def enumerative_set(rank: Column, ones: Column, size: int) -> Column:
    """The 0/1 array of that size and number of ones with that rank: from the top, a position is in the set if the rank
    reaches its binomial."""
    table = F.array(*(F.array(*(F.lit(comb(n, k)).cast("long") for k in range(size + 1))) for n in range(size)))
    start = F.struct(rank.cast("long").alias("rank"), ones.cast("int").alias("k"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, i: Column) -> Column:
        c = F.element_at(F.element_at(table, i + 1), a["k"] + 1)
        hit = (a["k"] > 0) & (a["rank"] >= c)
        return F.struct(F.when(hit, a["rank"] - c).otherwise(a["rank"]).alias("rank"), (a["k"] - hit.cast("int")).alias("k"), F.concat(F.array(hit.cast("int")), a["out"]).alias("out"))

    return F.aggregate(F.sequence(F.lit(size - 1), F.lit(0), F.lit(-1)), start, step, lambda a: a["out"])


def enumerative_index(bits: Column, size: int) -> Column:
    """The rank of a set of positions (a 0/1 array of that size) among all with as many ones: the sum over ones of the
    binomial of position and number of ones up to it. Binomials come from Pascal's rule."""
    table = F.array(*(F.array(*(F.lit(comb(n, k)).cast("long") for k in range(size + 1))) for n in range(size)))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("ones"), F.lit(0).cast("long").alias("sum"))
    step = lambda a, b: F.struct((a["at"] + 1).alias("at"), (a["ones"] + b.cast("int")).alias("ones"),
                                 F.when(b == 1, a["sum"] + F.element_at(F.element_at(table, a["at"] + 1), a["ones"] + 2)).otherwise(a["sum"]).alias("sum"))
    return F.aggregate(bits, start, step, lambda a: a["sum"])


def synchsafe(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Four bytes of seven bits."""
    return ((a.cast("long") * 128 + b) * 128 + c) * 128 + d


def parity(n: Column) -> Column:
    return F.bit_count(n) % 2


def sign_in_low_bit(n: Column) -> Column:
    """Signed numbers with their sign in the lowest bit."""
    return F.when(n < 0, -n * 2 + 1).otherwise(n * 2)


def from_sign_in_low_bit(n: Column) -> Column:
    half = F.shiftright(n, 1)
    return F.when(n % 2 == 1, -half).otherwise(half)
