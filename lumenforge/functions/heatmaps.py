"""Attention maps over images: normalised, resized, blurred, laid over; grids are row-major arrays of known height and width."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stretch(grid: Column | str) -> Column:
    """Values from 0 to 1: the least taken off, then over the largest; a flat grid is 0."""
    return let(F.struct(_col(grid).alias("g"), F.array_min(_col(grid)).alias("a"), F.array_max(_col(grid)).alias("b")), lambda s: F.transform(s["g"], lambda x: F.when(s["b"] > s["a"], (x - s["a"]) / (s["b"] - s["a"])).otherwise(F.lit(0.0))))


def resize(grid: Column | str, h: int, w: int, to_h: int, to_w: int) -> Column:
    """Bilinear resampling on the centres of cells, borders held."""

    def axis(n: int, to: int) -> list[tuple[int, int, float]]:
        out = []
        for k in range(to):
            x = min(max((k + 0.5) * n / to - 0.5, 0.0), n - 1.0)
            out.append((int(x), min(int(x) + 1, n - 1), x - int(x)))
        return out

    def table(rows: list) -> Column:
        return F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(t).alias("t")) for a, b, t in rows])

    def body(s: Column) -> Column:
        def cell(p: Column) -> Column:
            y, x = F.get(s["ys"], F.floor(p / to_w).cast("int")), F.get(s["xs"], F.pmod(p, F.lit(to_w)))
            at = lambda i, j: F.get(s["g"], i * w + j)
            top = at(y["a"], x["a"]) * (1 - x["t"]) + at(y["a"], x["b"]) * x["t"]
            low = at(y["b"], x["a"]) * (1 - x["t"]) + at(y["b"], x["b"]) * x["t"]
            return top * (1 - y["t"]) + low * y["t"]

        return F.transform(F.sequence(F.lit(0), F.lit(to_h * to_w - 1)), cell)

    return let(F.struct(_col(grid).alias("g"), table(axis(h, to_h)).alias("ys"), table(axis(w, to_w)).alias("xs")), body)


def kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    """Weights of a sampled Gaussian from the middle outwards, which add up to 1 with both sides."""
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) if sigma > 0 else float(k == 0) for k in range(radius + 1)]
    total = raw[0] + 2 * sum(raw[1:])
    return [x / total for x in raw]


def _mirror(k: int, n: int) -> int:
    """The place k of a line of n cells that is mirrored at its ends, ends included."""
    k %= 2 * n
    return k if k < n else 2 * n - 1 - k


def blur(grid: Column | str, h: int, w: int, sigma: float, truncate: float = 4.0) -> Column:
    """Gaussian blur, along columns and then along rows; beyond the border the grid is mirrored."""
    weights = kernel(sigma, truncate)
    radius = len(weights) - 1

    def line(n: int) -> Column:
        """For each place, where its neighbours are."""
        return F.array(*[F.array(*[F.lit(_mirror(k + d, n)) for d in range(-radius, radius + 1)]) for k in range(n)])

    ws = F.array(*[F.lit(weights[abs(d)]) for d in range(-radius, radius + 1)])

    def along(g: Column, near: Column, down: bool) -> Column:
        def cell(p: Column) -> Column:
            y, x = F.floor(p / w).cast("int"), F.pmod(p, F.lit(w))
            places = F.transform(F.get(near, y if down else x), lambda q: F.get(g, q * w + x) if down else F.get(g, y * w + q))
            return F.aggregate(F.zip_with(places, ws, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

        return F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), cell)

    first = lambda s: along(s["g"], s["near"], True)
    second = lambda s: along(s["g"], s["near"], False)
    down = let(F.struct(_col(grid).alias("g"), line(h).alias("near")), first)
    return let(F.struct(down.alias("g"), line(w).alias("near")), second)


def colours(value: Column) -> Column:
    """(r, g, b) of a value from 0 to 1, from blue over green to red, piecewise linear."""
    ramp = lambda at: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(1.5) - F.abs(value * 4 - at)))
    return F.struct(ramp(3).alias("r"), ramp(2).alias("g"), ramp(1).alias("b"))


def overlay(attention: Column | str, image: Column | str, power: float = 0.7) -> Column:
    """An array of (r, g, b): the image's, from 0 to 1, under the map's colours; the map's value to `power` is how much of these shows."""

    def one(a: Column, p: Column) -> Column:
        return let(F.struct(F.pow(a, F.lit(power)).alias("k"), colours(a).alias("c"), p.alias("p")), lambda s: F.struct(*[((1 - s["k"]) * s["p"][x] + s["k"] * s["c"][x]).alias(x) for x in "rgb"]))

    return F.zip_with(_col(attention), _col(image), one)


def attention_overlay(grid: Column | str, h: int, w: int, image: Column | str, to_h: int, to_w: int, power: float = 0.7) -> Column:
    """The whole chain (V28): stretched, resized to the image, blurred by a fiftieth of its longer side, stretched again and laid over."""
    big = resize(stretch(grid), h, w, to_h, to_w)
    return overlay(stretch(blur(big, to_h, to_w, 0.02 * max(to_h, to_w))), image, power)
