"""Vectors as array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_column, let

EPS = 1e-12


def doubles(c: Column | str) -> Column:
    return as_column(c).cast("array<double>")


def total(c: Column | str) -> Column:
    return F.aggregate(doubles(c), F.lit(0.0), lambda a, x: a + x)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(c: Column | str) -> Column:
    return F.sqrt(F.aggregate(doubles(c), F.lit(0.0), lambda s, x: s + x * x))


def normalise(c: Column | str) -> Column:
    """Unit vector; norms below 1e-12 count as that."""
    return let(doubles(c), lambda v: let(F.greatest(norm(v), F.lit(EPS)), lambda n: F.transform(v, lambda x: x / n)))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(EPS))


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def scale(c: Column | str, by: Column | float) -> Column:
    return F.transform(doubles(c), lambda x: x * by)


def blend(share: Column, whole: Column | str, part: Column | str) -> Column:
    """share * whole + (1 - share) * part, made a unit vector."""
    return normalise(F.zip_with(doubles(whole), doubles(part), lambda w, p: share * w + (1 - share) * p))


def pad(c: Column | str, length: Column | int, filler: Column) -> Column:
    """Filled up behind to the length; longer arrays stay as they are."""
    c = as_column(c)
    return F.concat(c, F.array_repeat(filler, F.greatest(F.lit(0), F.lit(length) - F.size(c) if isinstance(length, int) else length - F.size(c))))


def pad_mask(c: Column | str, filler: Column) -> Column:
    """1 where an element is not the filler."""
    return F.transform(as_column(c), lambda x: (x != filler).cast("int"))


def concat_common(a: Column | str, b: Column | str) -> Column:
    """Rows of two feature sequences side by side, cut to the shorter."""
    a, b = as_column(a), as_column(b)
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.concat(x, y))


def minmax(c: Column | str) -> Column:
    """(x - min) / (max - min + 1e-6)."""
    return let(doubles(c), lambda v: let(F.struct(F.array_min(v).alias("lo"), F.array_max(v).alias("hi")), lambda r: F.transform(v, lambda x: (x - r["lo"]) / (r["hi"] - r["lo"] + 1e-6))))


def softmax(c: Column | str) -> Column:
    """exp(x - max) over its sum."""
    return let(doubles(c), lambda v: let(F.transform(v, lambda x: F.exp(x - F.array_max(v))), lambda e: F.transform(e, lambda x: x / total(e))))


def any_nonzero(c: Column | str) -> Column:
    """Some element is not 0."""
    return F.exists(as_column(c), lambda x: x != 0)


def nonzero_sum(c: Column | str) -> Column:
    """The elements' sum is not exactly 0 (P09); opposite elements cancel."""
    return total(c) != 0


def _groups(c: Column | str, size: int) -> Column:
    """Cut into groups of `size`, the last filled up with zeros."""
    v = doubles(c)
    n = F.ceil(F.size(v) / F.lit(float(size))).cast("int")
    return let(F.concat(v, F.array_repeat(F.lit(0.0), n * size - F.size(v))), lambda p: F.transform(F.sequence(F.lit(0), n - 1), lambda g: F.slice(p, g * size + 1, size)))


def quantise(c: Column | str, size: int = 256, bits: int = 8) -> Column:
    """Group-wise unsigned quantisation (V20): array<struct<mn, scale, q>>. A group of equal values, which has no scale, gets scale 0 and zeros."""
    top = 2**bits - 1

    def group(g: Column) -> Column:
        lo, hi = F.array_min(g), F.array_max(g)
        return let(
            F.struct(lo.alias("mn"), F.when(hi > lo, top / (hi - lo)).otherwise(0.0).alias("scale")),
            lambda s: F.struct(s["mn"].alias("mn"), s["scale"].alias("scale"), F.transform(g, lambda x: F.bround(F.least(F.lit(float(top)), F.greatest(F.lit(0.0), (x - s["mn"]) * s["scale"])), 0).cast("int")).alias("q")),
        )

    return F.transform(_groups(c, size), group)


def dequantise(c: Column | str, length: Column) -> Column:
    """The values of quantise(), the filling dropped."""
    flat = F.flatten(F.transform(as_column(c), lambda g: F.transform(g["q"], lambda x: F.when(g["scale"] > 0, x / g["scale"]).otherwise(0.0) + g["mn"])))
    return F.slice(flat, 1, length)


def quantise_symmetric(c: Column | str, size: int = 256, bits: int = 8) -> Column:
    """Group-wise signed quantisation (V20): array<struct<scale, q>>; all-zero groups get scale 0."""
    top = 2 ** (bits - 1) - 1

    def group(g: Column) -> Column:
        most = F.array_max(F.transform(g, F.abs))
        return let(F.when(most > 0, top / most).otherwise(0.0), lambda s: F.struct(s.alias("scale"), F.transform(g, lambda x: F.bround(F.least(F.lit(float(top)), F.greatest(F.lit(-float(top)), x * s)), 0).cast("int")).alias("q")))

    return F.transform(_groups(c, size), group)


def positional(index: Column, dims: int, base: float = 10000.0) -> Column:
    """Sinusoidal code of an index: sine and cosine of index / base ** (2k / dims), by turns."""
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: let(index / F.pow(F.lit(base), (2 * F.floor(k / 2)) / F.lit(float(dims))), lambda a: F.when(k % 2 == 0, F.sin(a)).otherwise(F.cos(a))))


def voxel_code(x: Column, y: Column, z: Column, dims: int, weight: float = 0.01) -> Column:
    """The codes of three axes one after the other, weighted."""
    return F.transform(F.concat(*[positional(c, dims) for c in (x, y, z)]), lambda v: v * weight)


def ema(values: Column | str, momentum: float, start: Column) -> Column:
    """m * old + (1 - m) * new along an ordered array."""
    return F.aggregate(doubles(values), start.cast("double"), lambda old, new: momentum * old + (1 - momentum) * new)


def late_interaction(queries: Column | str, v: Column | str) -> Column:
    """The largest inner product of a vector with any of an array of vectors."""
    return F.array_max(F.transform(as_column(queries), lambda q: dot(q, v)))


def weighted_attention(attention: Column | str, gradient: Column | str) -> Column:
    """Attention times the positive part of its gradient, array<array<double>> by heads, averaged over the heads."""
    heads = F.zip_with(as_column(attention), as_column(gradient), lambda a, g: F.zip_with(a, g, lambda x, y: x * F.greatest(y, F.lit(0.0))))

    def mean(h: Column) -> Column:
        zero = F.transform(F.get(h, 0), lambda _: F.lit(0.0))
        return scale(F.aggregate(h, zero, lambda acc, x: F.zip_with(acc, x, lambda p, q: p + q)), F.lit(1.0) / F.size(h))

    return let(heads, mean)
