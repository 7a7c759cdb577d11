"""Cameras, poses and boxes as Column expressions; angles in radians."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let


def mask_box(cells, x: str, y: str, width: int, height: int) -> dict[str, Column]:
    """Aggregates of a mask's cells: smallest and largest place; an empty mask is the whole image (V06). cells: whether the row is a cell of the mask."""
    pick = lambda c: F.when(cells, F.col(c))
    return {
        "x0": F.coalesce(F.min(pick(x)), F.lit(0)),
        "y0": F.coalesce(F.min(pick(y)), F.lit(0)),
        "x1": F.coalesce(F.max(pick(x)), F.lit(width)),
        "y1": F.coalesce(F.max(pick(y)), F.lit(height)),
    }


def box_area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Both borders included."""
    return (x1 - x0 + 1) * (y1 - y0 + 1)


def large_enough(area: Column, width: int = 512, height: int = 512, least: float = 0.005) -> Column:
    """The box takes the least share of the image or more."""
    return area / F.lit(float(width * height)) >= least


def box_centre(lo: Column, hi: Column, digits: int = 3) -> Column:
    """Mean of two corners, rounded half to even."""
    return F.bround((lo + hi) / 2, digits)


def inside(x: Column, lo: Column, hi: Column) -> Column:
    """Strictly between."""
    return (lo < x) & (x < hi)


def norm_between(x: Column, y: Column, z: Column, most: float = 10000.0) -> Column:
    """0 < norm < most."""
    return let(F.sqrt(x * x + y * y + z * z), lambda n: (n > 0) & (n < most))


def clamp_depth(depth: Column, threshold: float, to_nan: bool = True) -> Column:
    """Depths beyond the threshold become NaN, or 0."""
    return F.when(depth > threshold, F.lit(float("nan")) if to_nan else F.lit(0.0)).otherwise(depth)


def camera(width: int, height: int, fov: float) -> dict[str, float]:
    """Centre and focal length of a view of fov degrees."""
    return {"xc": (width - 1) / 2, "zc": (height - 1) / 2, "f": (width / 2) / math.tan(math.radians(fov / 2))}


def depth_to_camera(col: Column, row: Column, depth: Column, width: int, height: int, fov: float) -> Column:
    """struct<x, y, z> in the camera's frame; rows count from the top, z from the bottom."""
    c = camera(width, height, fov)
    return F.struct(((col - c["xc"]) * depth / c["f"]).alias("x"), depth.alias("y"), (((height - 1 - row) - c["zc"]) * depth / c["f"]).alias("z"))


def camera_to_base(p: Column, camera_height: float) -> Column:
    """The same above the robot's base."""
    return F.struct(p["x"].alias("x"), p["y"].alias("y"), (p["z"] + camera_height).alias("z"))


def rotation_z(angle: Column) -> Column:
    """struct<c, s> of the turn about z; none where the angle is at most 0.001."""
    turn = F.abs(angle) > 0.001
    return F.struct(F.when(turn, F.cos(angle)).otherwise(1.0).alias("c"), F.when(turn, F.sin(angle)).otherwise(0.0).alias("s"))


def base_to_map(p: Column, x: Column, y: Column, heading: Column, resolution: float) -> Column:
    """The point on the map of a robot at (x, y) cells with the heading."""
    return let(rotation_z(heading - math.pi / 2), lambda r: F.struct((p["x"] * r["c"] - p["y"] * r["s"] + x * resolution).alias("x"), (p["x"] * r["s"] + p["y"] * r["c"] + y * resolution).alias("y"), p["z"].alias("z")))


def robot_to_world(x0: Column, y0: Column, z0: Column, u: Column, v: Column, heading: Column) -> Column:
    """struct<x, y, z>: v ahead, then u to the right."""
    ahead, side = heading + math.pi / 2, heading
    return F.struct((x0 + v * F.cos(ahead) + u * F.cos(side)).alias("x"), y0.alias("y"), (z0 - v * F.sin(ahead) - u * F.sin(side)).alias("z"))


def heading(qx: Column, qy: Column, qz: Column, qw: Column) -> Column:
    """The turn about y of a rotation, from 0 to 2 pi (V15); no turn gives 0."""
    n = F.sqrt(qx * qx + qy * qy + qz * qz)
    sign = F.when(qw < 0, -1.0).otherwise(1.0)
    turn = F.when(n == 0, 0.0).otherwise(2 * F.atan2(n, F.abs(qw)) * sign * qy / n)
    return let(turn, wrap)


def wrap(angle: Column) -> Column:
    """Once around at most: above 2 pi less a turn, below 0 one more."""
    return F.when(angle > 2 * math.pi, angle - 2 * math.pi).when(angle < 0, angle + 2 * math.pi).otherwise(angle)


def cell(value: Column, resolution: float) -> Column:
    """Map cell, halves to even (V16); null where the value is NaN."""
    return F.bround(F.when(~F.isnan(value), value) / resolution, 0).cast("int")


def digitise(value: Column, bins: list[float]) -> Column:
    """How many of the ascending bins are at most the value."""
    out = F.lit(0)
    for b in bins:
        out = out + (value >= b).cast("int")
    return out


def voxel(p: Column, half: int = 128) -> Column:
    """Voxel of a coordinate in [-1, 1], truncated towards 0."""
    return (p * half + half).cast("int")


def pinhole(u: Column, v: Column, depth: Column, fx: Column, fy: Column, cx: Column, cy: Column, inverse: list[list[float]]) -> Column:
    """struct<x, y, z> of a pixel in the world, inverse being that of the 4 x 4 extrinsic."""
    local = F.struct(((u - cx) * depth / fx).alias("x"), ((v - cy) * depth / fy).alias("y"), depth.alias("z"))
    row = lambda p, r: p["x"] * r[0] + p["y"] * r[1] + p["z"] * r[2] + r[3]
    return let(local, lambda p: F.struct(*[row(p, inverse[i]).alias(n) for i, n in enumerate("xyz")]))


def follow_actions(actions: Column, x: Column, y: Column, start: Column, step: float, degrees: float, resolution: float) -> Column:
    """struct<x, y, heading> after an ordered array of move_forward, turn_left and turn_right."""
    turn = math.radians(degrees)
    at = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), start.cast("double").alias("heading"))

    def move(s: Column, a: Column) -> Column:
        ahead = a == "move_forward"
        angle = s["heading"] + F.when(a == "turn_left", turn).when(a == "turn_right", -turn).otherwise(0.0)
        return F.struct(
            (s["x"] + F.when(ahead, step * F.cos(s["heading"]) / resolution).otherwise(0.0)).alias("x"),
            (s["y"] + F.when(ahead, step * F.sin(s["heading"]) / resolution).otherwise(0.0)).alias("y"),
            let(angle, wrap).alias("heading"),
        )

    return F.aggregate(actions, at, move)


def colour_id(r: Column, g: Column, b: Column) -> Column:
    """r + 256 g + 256² b."""
    return r + 256 * g + 65536 * b


def box_corners(bbox: Column) -> Column:
    """Two corners array<array<double>> out of a box written as six numbers or as two triples, given as JSON text; null if it is neither."""
    nested, flat = F.from_json(bbox, "array<array<double>>"), F.from_json(bbox, "array<double>")
    return F.when((F.size(nested) == 2) & (F.size(F.get(nested, 0)) == 3), nested).when(F.size(flat) == 6, F.array(F.slice(flat, 1, 3), F.slice(flat, 4, 3)))


def view_camera(document: Column, view: Column) -> Column:
    """struct<intrinsic, extrinsic> of a view in a camera document (JSON text) that has views at its root or under view_params."""
    kind = "struct<intrinsic: array<array<double>>, extrinsic: array<array<double>>>"
    under = F.get(F.array(F.from_json(document, f"view_params map<string, {kind}>")["view_params"]), 0)
    return F.coalesce(F.try_element_at(under, view), F.try_element_at(F.from_json(document, f"map<string, {kind}>"), view))
