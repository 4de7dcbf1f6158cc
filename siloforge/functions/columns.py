"""Column functions: vectors, guarded arithmetic, masks, fixed point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def divide(a: Column, b: Column) -> Column:
    """a / b, and 0 where b isn't positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 for a zero vector."""
    return divide(dot(a, b), norm(a) * norm(b))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def finite(x: Column) -> Column:
    """Null, NaN and infinities become 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """2TP / (2TP + FP + FN), 0 if there is nothing to find and nothing found."""
    return divide(2.0 * tp, 2 * tp + fp + fn)


def geometric_mean(a: Column, b: Column) -> Column:
    return F.sqrt(a * b)


def harmonic_mean(a: Column, b: Column) -> Column:
    return divide(2.0 * a * b, a + b)


def selected(x: Column, sel: Column) -> Column:
    """Mask projection: the chosen positions of a vector."""
    return F.transform(sel, lambda j: F.element_at(x, j + 1))


def packed_bit(packed: Column, j: Column) -> Column:
    """Bit j of big-endian packed bytes, given as an array of ints."""
    byte = F.element_at(packed, F.call_function("div", j, F.lit(8)).cast("int") + 1)
    return F.getbit(byte, (7 - j % 8).cast("int")).cast("int")


def fixed_point(x: Column, bits: int) -> Column:
    """Rounds half to even at so many fractional bits; raises if 58 bits don't hold it."""
    scaled = F.bround(x * float(1 << bits))
    return F.when(F.abs(scaled) < float(1 << 58), scaled.cast("long")).otherwise(F.raise_error(F.lit("fixed point overflow")).cast("long"))


def mask_string(sel: Column) -> Column:
    return F.array_join(F.transform(sel, lambda j: j.cast("string")), ",")


def mask_list(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ","), lambda s: s != ""), lambda s: s.cast("int"))


def pair_seed(base: int, i: Column, j: Column) -> Column:
    """One seed a pair of parties, the same from either side, modulo 2^64."""
    whole = F.lit(base).cast("decimal(38,0)") * 1000003 + F.least(i, j) * 1009 + F.greatest(i, j)
    return F.pmod(whole.cast("decimal(38,0)"), F.lit("18446744073709551616").cast("decimal(38,0)"))


def arithmetic_hash(x: Column, seed: int = 0) -> Column:
    """A portable hash of a whole number, below 2^32: any SQL engine can state it."""
    return ((x % 1000003) * 2654435761 + F.lit(seed * 40503 + 12345)) % 4294967296


def log_spaced(low: float, high: float, n: int) -> Column:
    import math

    step = (math.log(high) - math.log(low)) / max(n - 1, 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.exp(F.lit(math.log(low)) + i * F.lit(step)))
