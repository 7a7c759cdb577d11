"""Point clouds, voxels and top-down maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import vectors as V
from .sampling import sample_rows


def vector_mean(df: DataFrame, keys: Sequence[str], vector: str, name: str = "mean") -> DataFrame:
    """(keys, element-wise mean): a combined aggregate by key and place, then one array a key."""
    d = df.select(*keys, F.posexplode(V.doubles(vector)).alias("_p", "_x")).groupBy(*keys, "_p").agg(F.avg("_x").alias("_x"))
    return d.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_p", "_x"))).alias("_v")).select(*keys, F.transform("_v", lambda s: s["_x"]).alias(name))


def prompt_ensemble(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, centre): unit vectors, their mean, made a unit vector."""
    d = vector_mean(df.select(label, V.normalise(vector).alias("_u")), [label], "_u")
    return d.select(label, V.normalise("mean").alias("centre"))


def centre_and_radius(df: DataFrame, scene: str, x: str, y: str, z: str) -> DataFrame:
    """Points less their scene's centre, over its largest distance (A15). Two combined aggregates of scenes, joined back; nothing is sorted."""
    c = df.groupBy(scene).agg(*[F.avg(v).alias(f"_c{v}") for v in (x, y, z)])
    d = df.join(c, scene)
    for v in (x, y, z):
        d = d.withColumn(v, F.col(v) - F.col(f"_c{v}"))
    d = d.drop(*[f"_c{v}" for v in (x, y, z)])
    r = d.groupBy(scene).agg(F.max(F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y) + F.col(z) * F.col(z))).alias("_r"))
    d = d.join(r, scene)
    for v in (x, y, z):
        d = d.withColumn(v, F.when(F.col("_r") > 0, F.col(v) / F.col("_r")).otherwise(0.0))
    return d.withColumnRenamed("_r", "radius")


def voxelise(df: DataFrame, scene: str, x: str, y: str, z: str, features: str, half: int = 128) -> DataFrame:
    """(scene, vx, vy, vz, mean features, n)."""
    d = df.select(scene, *[G.voxel(F.col(c), half).alias(n) for c, n in ((x, "vx"), (y, "vy"), (z, "vz"))], features)
    keys = [scene, "vx", "vy", "vz"]
    return vector_mean(d, keys, features).join(d.groupBy(*keys).agg(F.count("*").alias("n")), keys)


def object_voxels(points: DataFrame, scene: str, key: str, x: str, y: str, z: str, features: str, limit: int = 50_000, half: int = 128, seed: int = 0) -> DataFrame:
    """From pixels to voxelised object features (M10): far and empty points go, the scene is normalised, points without features go, a sample is voxelised."""
    d = points.where(G.norm_between(F.col(x), F.col(y), F.col(z)))
    d = centre_and_radius(d, scene, x, y, z).drop("radius").where(V.nonzero_sum(features))
    return voxelise(sample_rows(d, [scene], key, limit, seed), scene, x, y, z, features, half)


def label_points(df: DataFrame, label: str, x: str, y: str, z: str, stop: Sequence[str] = ("floor", "ceiling", "misc", "wall", "objects", "void"), least: int = 50) -> DataFrame:
    """(label, x, y, z, n): mean point of each label that is no stop word and has enough points."""
    d = df.where(~F.col(label).isin(*stop) & ~F.isnan(x))
    return d.groupBy(label).agg(*[F.avg(c).alias(c) for c in (x, y, z)], F.count("*").alias("n")).where(F.col("n") >= least)


def occupied_map(df: DataFrame, x: str, y: str, z: str, size: int, bins: Sequence[float], resolution: float, free: int = 1, occupied: int = 2, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, cell_x, cell_y, value): cells with points below the first bin are free, with points in the next one occupied, which wins."""
    d = df.where(~F.isnan(y)).select(*keys, G.cell(F.col(x), resolution).alias("cell_x"), G.cell(F.col(y), resolution).alias("cell_y"), G.digitise(F.col(z), list(bins)).alias("_b"))
    d = d.where((F.col("cell_x") >= 0) & (F.col("cell_x") < size) & (F.col("cell_y") >= 0) & (F.col("cell_y") < size) & (F.col("_b") <= 1))
    return d.groupBy(*keys, "cell_x", "cell_y").agg(F.max(F.when(F.col("_b") == 1, occupied).otherwise(free)).alias("value")) if occupied > free else d.groupBy(*keys, "cell_x", "cell_y").agg(F.when(F.max("_b") == 1, occupied).otherwise(free).alias("value"))


def semantic_map(df: DataFrame, cell_x: str, cell_y: str, row: str, col: str, label: str) -> DataFrame:
    """(cell_x, cell_y, label): the last pixel in scan order wins."""
    return df.groupBy(cell_x, cell_y).agg(F.max_by(label, F.struct(row, col)).alias(label))


def overlay(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """A map with what a new one knows put over it; 0 is unknown."""
    o, n = old.select(*keys, F.col(value).alias("_o")), new.select(*keys, F.col(value).alias("_n"))
    return o.join(n, list(keys), "full_outer").withColumn(value, F.coalesce(F.when(F.col("_n") > 0, F.col("_n")), F.col("_o"), F.lit(0))).drop("_o", "_n")


def world_points(views: DataFrame, boxes: DataFrame, room: str, width: int, height: int, fov: float, limit: int, key: str, seed: int = 0) -> DataFrame:
    """From depth, pose and features to a room's points (M9).

    views: room, key, row, col, depth, r, g, b, feat, px, py, pz, heading; boxes: room, min_*, max_*. Pixels without
    features or colour go, points outside of the room's box go, at most limit points of a room stay.
    """
    d = views.where(V.any_nonzero("feat") & ~((F.col("r") == 0) & (F.col("g") == 0) & (F.col("b") == 0)))
    d = d.withColumn("_c", G.depth_to_camera(F.col("col"), F.col("row"), F.col("depth"), width, height, fov))
    d = d.withColumn("_w", G.robot_to_world(F.col("px"), F.col("py"), F.col("pz"), F.col("_c.x") * 10, F.col("_c.y") * 10, F.col("heading")))
    d = d.select(room, key, "feat", F.col("_w.x").alias("x"), (F.col("_w.y") + F.col("_c.z") * 10).alias("y"), F.col("_w.z").alias("z")).join(boxes, room)
    d = d.where(G.inside(F.col("x"), F.col("min_x"), F.col("max_x")) & G.inside(F.col("y"), F.col("min_y"), F.col("max_y")) & G.inside(F.col("z"), F.col("min_z"), F.col("max_z")))
    return sample_rows(d.select(room, key, "x", "y", "z", "feat"), [room], key, limit, seed)


def seen_map(points: DataFrame, x: str, y: str, z: str, heading: Column, px: Column, py: Column, camera_height: float, size: int, resolution: float, bins: Sequence[float], threshold: float) -> DataFrame:
    """Camera points to an occupancy map (M11): depth clamp, base frame, map frame, cells."""
    p = F.struct(F.col(x).alias("x"), G.clamp_depth(F.col(y), threshold).alias("y"), F.col(z).alias("z"))
    d = points.withColumn("_m", G.base_to_map(G.camera_to_base(p, camera_height), px, py, heading, resolution))
    return occupied_map(d.select(F.col("_m.x").alias("mx"), F.col("_m.y").alias("my"), F.col("_m.z").alias("mz")), "mx", "my", "mz", size, bins, resolution)




def semantic_points(points: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Points with their object's label by id; points of unknown objects go."""
    return points.join(labels.select(key, label), key)
