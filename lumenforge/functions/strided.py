"""Videos and other arrays of several axes in one column: flat data with shape, strides and an offset.

Crops, flips and permutations of axes change shape, strides and offset only; nothing is unpacked until unpack() or element() asks. The
number of axes is known when the expression is built; sizes may differ from row to row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _struct(data: Column, shape: Column, strides: Column, offset: Column) -> Column:
    return F.struct(data.alias("data"), shape.cast("array<int>").alias("shape"), strides.cast("array<int>").alias("strides"), offset.cast("int").alias("offset"))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def view(data: Column | str, shape: Sequence[int | Column]) -> Column:
    """Row-major data with its shape."""
    n = [F.lit(x) if isinstance(x, int) else x for x in shape]
    strides = [reduce(lambda a, b: a * b, n[k + 1 :], F.lit(1)) for k in range(len(n))]
    return _struct(_col(data), F.array(*n), F.array(*strides), F.lit(0))


def permute(v: Column | str, axes: Sequence[int]) -> Column:
    """Axes in another order: (0, 3, 1, 2) puts the last of four behind the first (V31: CTHW and THWC)."""
    c = _col(v)
    pick = lambda a: F.array(*[F.get(a, k) for k in axes])
    return _struct(c["data"], pick(c["shape"]), pick(c["strides"]), c["offset"])


def crop(v: Column | str, starts: Sequence[int | Column], sizes: Sequence[int | Column]) -> Column:
    """The box from starts, at most `sizes` long, of each axis (V31: spatial and temporal crops)."""
    c = _col(v)
    start = [F.lit(x) if isinstance(x, int) else x for x in starts]
    size = [F.greatest(F.lit(0), F.least(F.lit(x) if isinstance(x, int) else x, F.get(c["shape"], k) - start[k])) for k, x in enumerate(sizes)]
    offset = reduce(lambda a, b: a + b, [start[k] * F.get(c["strides"], k) for k in range(len(start))], c["offset"])
    return _struct(c["data"], F.array(*size), c["strides"], offset)


def flip(v: Column | str, axis: int, ndim: int) -> Column:
    """The axis the other way round (V31: horizontal flip)."""
    c = _col(v)
    strides = F.array(*[-F.get(c["strides"], k) if k == axis else F.get(c["strides"], k) for k in range(ndim)])
    return _struct(c["data"], c["shape"], strides, c["offset"] + (F.get(c["shape"], axis) - 1) * F.get(c["strides"], axis))


def element(v: Column | str, *place: int | Column) -> Column:
    """One entry; null outside."""
    c = _col(v)
    at = [F.lit(x) if isinstance(x, int) else x for x in place]
    inside = reduce(lambda a, b: a & b, [(x >= 0) & (x < F.get(c["shape"], k)) for k, x in enumerate(at)])
    return F.when(inside, F.get(c["data"], reduce(lambda a, b: a + b, [x * F.get(c["strides"], k) for k, x in enumerate(at)], c["offset"])))


def size(v: Column | str, ndim: int) -> Column:
    return reduce(lambda a, b: a * b, [F.get(_col(v)["shape"], k) for k in range(ndim)])


def unpack(v: Column | str, ndim: int) -> Column:
    """The entries in the order of the view's axes, the last running fastest; empty if an axis is."""
    from .columns import let

    def flat(c: Column) -> Column:
        n = size(c, ndim)

        def at(p: Column) -> Column:
            place, rest = c["offset"], p
            for k in range(ndim - 1, -1, -1):
                place = place + F.pmod(rest, F.get(c["shape"], k)) * F.get(c["strides"], k)
                rest = F.floor(rest / F.get(c["shape"], k)).cast("int")
            return F.get(c["data"], place)

        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.slice(c["data"], 1, 0))

    return let(_col(v), flat)


def normalise(v: Column | str, axis: int, ndim: int, mean: Sequence[float], std: Sequence[float], scale: float = 255.0) -> Column:
    """Entries over `scale`, less the mean and over the deviation of their place on the axis, as row-major data of the view (V31: to_tensor and normalize)."""
    c = _col(v)
    m, s = F.array(*[F.lit(float(x)) for x in mean]), F.array(*[F.lit(float(x)) for x in std])
    after = reduce(lambda a, b: a * b, [F.get(c["shape"], k) for k in range(axis + 1, ndim)], F.lit(1))

    def one(x: Column, p: Column) -> Column:
        k = F.pmod(F.floor(p / after).cast("int"), F.get(c["shape"], axis))
        return (x / scale - F.get(m, k)) / F.get(s, k)

    return F.transform(unpack(c, ndim), one)
