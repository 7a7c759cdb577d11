"""Image operations over DataFrames: a row holds an image as bytes, row by row, with its height, width and channels."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions import images as I


def image(row) -> np.ndarray:
    """The image of a row (height, width, channels, pixels)."""
    return np.frombuffer(row.pixels, dtype=np.uint8).reshape(row.height, row.width, row.channels)


def map_images(df: DataFrame, function: Callable[[np.ndarray, object], np.ndarray], key: str) -> DataFrame:
    """(key, height, width, channels, pixels) after function(image, key), in Arrow batches; null images go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [function(image(r), getattr(r, key)) for r in b.itertuples(index=False)]
            shapes = [x.shape for x in out]
            yield pd.DataFrame({key: b[key].to_numpy(), "height": [s[0] for s in shapes], "width": [s[1] for s in shapes], "channels": [s[2] for s in shapes], "pixels": [np.ascontiguousarray(x, dtype=np.uint8).tobytes() for x in out]})

    schema = T.StructType([df.schema[key], *[T.StructField(c, T.IntegerType()) for c in ("height", "width", "channels")], T.StructField("pixels", T.BinaryType())])
    return df.where("pixels is not null").select(key, "height", "width", "channels", "pixels").mapInPandas(run, schema)


def chance(seed: int, *what: object) -> float:
    """A number in (0, 1) that is fixed by the seed and what it is for, as sampling.uniform() has it."""
    digest = hashlib.md5(":".join([str(seed), *map(str, what)]).encode()).hexdigest()
    return (int(digest[:13], 16) + 0.5) / (1 << 52)


def random_operations(key: object, n: int, names: Sequence[str], seed: int = 0) -> list[tuple[str, int]]:
    """n names drawn for an image with a sign each; every one of them is then left out with probability one half."""
    drawn = [(names[int(chance(seed, key, k, "name") * len(names))], 1 if chance(seed, key, k, "sign") < 0.5 else -1) for k in range(n)]
    return [x for k, x in enumerate(drawn) if chance(seed, key, k, "take") < 0.5]


def augment(df: DataFrame, key: str, n: int = 2, level: int = 10, highest: int = 10, names: Sequence[str] = tuple(I.OPERATIONS), seed: int = 0) -> DataFrame:
    """Random operations on every image, the same again for the same seed and key."""

    def one(a: np.ndarray, k: object) -> np.ndarray:
        for name, sign in random_operations(k, n, names, seed):
            a = I.OPERATIONS[name](a, level / highest, sign)
        return a

    return map_images(df, one, key)


def prepare(df: DataFrame, key: str, crop: tuple[int, int], size: tuple[int, int], mirrored: bool = False) -> DataFrame:
    """Middle crop, nearest resize and, if asked for, the mirror image."""

    def one(a: np.ndarray, _: object) -> np.ndarray:
        a = I.resize_nearest(I.centre_crop(a, *crop), *size)
        return I.flip(a) if mirrored else a

    return map_images(df, one, key)


def normalised(df: DataFrame, key: str, mean: Sequence[float], std: Sequence[float]) -> DataFrame:
    """(key, values): pixels over 255, less the mean, over the deviation, channel by channel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key].to_numpy(), "values": [I.normalise(image(r), mean, std).ravel() for r in b.itertuples(index=False)]})

    return df.select(key, "height", "width", "channels", "pixels").mapInPandas(run, T.StructType([df.schema[key], T.StructField("values", T.ArrayType(T.DoubleType()))]))


def polygon_cells(df: DataFrame, key: str, polygon: str, height: int, width: int) -> DataFrame:
    """(key, y, x) of the cells whose centre a polygon array<double> of x, y by turns holds (V32): a mask in sparse form."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, p in zip(b[key], b[polygon], strict=True):
                y, x = np.nonzero(I.polygon_mask(np.asarray(p, dtype=np.float64), height, width))
                yield pd.DataFrame({key: np.full(len(x), k), "y": y.astype(np.int32), "x": x.astype(np.int32)})

    return df.select(key, polygon).mapInPandas(run, T.StructType([df.schema[key], T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType())]))


def padded(df: DataFrame, group: str, order: str) -> DataFrame:
    """(group, order, height, width, channels, pixels, mask): a batch's images filled up with 0 behind to its largest height and width; mask is 1 where there is filling (V33). A task holds one image."""
    from pyspark.sql import functions as F

    sizes = df.groupBy(group).agg(F.max("height").alias("_h"), F.max("width").alias("_w"))
    d = df.select(group, order, "height", "width", "channels", "pixels").join(sizes, group)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, masks = [], []
            for r in b.itertuples(index=False):
                a, h, w = image(r), r[-2], r[-1]
                full = np.zeros((h, w, a.shape[2]), dtype=np.uint8)
                mask = np.ones((h, w), dtype=np.uint8)
                full[: a.shape[0], : a.shape[1]], mask[: a.shape[0], : a.shape[1]] = a, 0
                out.append(full.tobytes())
                masks.append(mask.tobytes())
            yield pd.DataFrame({group: b[group], order: b[order], "height": b["_h"], "width": b["_w"], "channels": b["channels"], "pixels": out, "mask": masks})

    schema = T.StructType([df.schema[group], df.schema[order], *[T.StructField(c, T.IntegerType()) for c in ("height", "width", "channels")], T.StructField("pixels", T.BinaryType()), T.StructField("mask", T.BinaryType())])
    return d.mapInPandas(run, schema)
