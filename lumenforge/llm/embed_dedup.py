"""Near-duplicate embeddings: exact pairs at a cosine threshold by cover trees and dual traversal.

Equal vectors of a label are one class. A label's classes are dealt into cells around pivots, which stand for the
tree's top levels: the pivots are taken farthest first from a bounded sample, so that any number of the first ones
is a net. A vector may have partners in another cell only if it lies within the threshold's distance of the plane midway between the two
pivots; it is sent to the couples of cells for which that holds, and to no other. There a task builds the
trees of two blocks and traverses them. A task returns a row for each class that has links: how many,
and a link to its component within the task. Links never leave as pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, connected_components, materialise, release, sized, tidy
from .covertree import Tree, pairs_within

#: Vectors of a block: BLOCK, or a label's 64th part up to LARGEST; in no case more than BYTES of them, but 256 at least.
BLOCK, LARGEST, BYTES = 4096, 32768, 16 << 20
#: Pivots for labels of up to so many blocks; larger labels have as many as they have blocks, up to the sample.
PIVOTS = 256
SAMPLE = 8192
#: Rows of one class that meet in a join; larger classes are dealt over several keys.
HEAVY = 50_000


def prepare(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, dim, key, vec): vec is the unit vector in double precision, null (as key) where a vector can link with nothing."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, units, dims = [], [], []
            for v in b.column(2).to_pylist():
                key = unit = None
                n = 0
                if v and None not in v:
                    x = np.array(v, dtype=np.float64)
                    n = len(x)
                    if np.isfinite(x).all() and x.any():
                        x = x / np.abs(x).max()
                        unit = (x / np.sqrt(x @ x)).tobytes()
                        key = hashlib.blake2b(np.array(v, dtype=np.float64).tobytes(), digest_size=16).digest()
                dims.append(n)
                keys.append(key)
                units.append(unit)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(units, pa.binary())], names=["id", "label", "dim", "key", "vec"])

    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    return slim.mapInArrow(run, "id long, label string, dim int, key binary, vec binary")


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """The first k rows of a farthest-first walk; fewer if no row is left apart."""
    out, best = [0], np.full(len(x), np.inf)
    while True:
        best = np.minimum(best, 2.0 - 2.0 * (x @ x[out[-1]]))
        nxt = int(best.argmax())
        if len(out) >= min(k, len(x)) or best[nxt] <= 1e-12:
            return x[out]
        out.append(nxt)


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union of i[k] with j[k] in an array of parents, smallest wins."""
    while True:
        while (root[root] != root).any():
            root[:] = root[root]
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(root, np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart]))


def compare_blocks(left: pd.DataFrame, right: pd.DataFrame | None, threshold: float) -> pd.DataFrame:
    """(key, links, rep, other) of the blocks' classes that have links: links counts every vector of the linked classes, other is the smallest representative of the component."""
    both = left if right is None else pd.concat([left, right], ignore_index=True)
    x = np.frombuffer(b"".join(both.vec), dtype=np.float64).reshape(len(both), -1)
    weight, links, root = both.m.to_numpy(), np.zeros(len(both), dtype=np.int64), np.arange(len(both))
    order = np.argsort(both.rep.to_numpy(), kind="stable")
    place = np.empty(len(both), dtype=np.int64)
    place[order] = np.arange(len(both))
    shift = len(left)

    def found(i: np.ndarray, j: np.ndarray) -> None:
        j = j if right is None else j + shift
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        unite(root, place[i], place[j])

    def joined(i: np.ndarray, j: np.ndarray) -> None:
        if i is j:
            links[i] += weight[i].sum() - weight[i]
            j = i
        else:
            j = j if right is None else j + shift
            links[i] += weight[j].sum()
            links[j] += weight[i].sum()
        united = place[np.concatenate([i, j])]
        unite(root, united[1:], np.full(len(united) - 1, united[0]))

    pairs_within(Tree(x[:shift]), None if right is None else Tree(x[shift:]), threshold, found, joined)
    while (root[root] != root).any():
        root[:] = root[root]
    hit = np.flatnonzero(links)
    rep = both.rep.to_numpy()
    return pd.DataFrame({"key": both.key.to_numpy()[hit], "links": links[hit], "rep": rep[hit], "other": rep[order[root[place[hit]]]]})


def _block_size(n: np.ndarray | int, dim: np.ndarray | int, block: int, largest: int) -> np.ndarray:
    """Vectors of a block of a label of n classes."""
    return np.minimum(np.clip(np.asarray(n) // 64, block, max(block, largest)), np.maximum(256, BYTES // (8 * np.maximum(1, dim))))


def _pivots(reps: DataFrame, block: int = BLOCK, largest: int = LARGEST) -> dict[int, np.ndarray]:
    """Pivots by length of vectors, farthest first, from SAMPLE vectors or so: those whose hash lies below a share that leaves about so many."""
    most = {r["dim"]: r["n"] for r in reps.groupBy("dim").agg(F.max("n").alias("n")).collect()}  # a row a length
    share = min(1.0, SAMPLE / max(1, reps.count()))
    chosen = reps.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = sorted(chosen.select("rep", "vec").collect(), key=lambda r: (r["rep"], r["vec"]))
    out: dict[int, np.ndarray] = {}
    for d in {len(r["vec"]) for r in sample}:
        x = np.frombuffer(b"".join(r["vec"] for r in sample if len(r["vec"]) == d), dtype=np.float64).reshape(-1, d // 8)
        cells = -(-most[d // 8] // int(_block_size(most[d // 8], d // 8, block, largest)))
        out[d // 8] = farthest_first(x, max(PIVOTS, cells))
    return out


def _place(reps: DataFrame, pivots: dict[int, np.ndarray], block: int, largest: int, reach: float) -> DataFrame:
    """reps with their block's size, their cell and the other cells that may hold partners; `n` is how many classes their label has."""

    step = max(64, 2048 * 256 // max([256, *map(len, pivots.values())]))  # rows whose cosines with all pivots a task holds

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                dims, n = b.column(2).to_numpy(), b.column(6).to_numpy()
                size = _block_size(n, dims, block, largest)
                wanted = np.maximum(1, np.ceil(n / size).astype(int))
                cell, others = np.zeros(b.num_rows, dtype=np.int32), [[] for _ in range(b.num_rows)]
                vecs = b.column(5)
                for d in np.unique(dims).tolist():
                    if d not in pivots:
                        continue
                    rows = np.flatnonzero(dims == d)
                    x = np.frombuffer(b"".join(vecs[i].as_py() for i in rows.tolist()), dtype=np.float64).reshape(-1, d)
                    cos = x @ pivots[d].T
                    cos[np.arange(cos.shape[1])[None, :] >= wanted[rows][:, None]] = -9.0
                    home = cos.argmax(axis=1)
                    own = cos[np.arange(len(rows)), home]
                    apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (pivots[d][home] @ pivots[d].T)))
                    # the distance to the plane midway between two pivots p, q is (cos p - cos q) / |p - q|
                    near = (own[:, None] - cos <= (reach + 1e-7) * apart + 1e-12) & (cos > -9.0)
                    near[np.arange(len(rows)), home] = False
                    cell[rows] = home
                    for k, i in enumerate(rows.tolist()):
                        others[i] = np.flatnonzero(near[k]).tolist()
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(6)], pa.array(size, pa.int32()), pa.array(cell, pa.int32()), pa.array(others, pa.list_(pa.int32()))], names=["rep", "label", "dim", "key", "m", "vec", "size", "cell", "others"])

    return reps.mapInArrow(run, "rep long, label string, dim int, key binary, m long, vec binary, size int, cell int, others array<int>")


def _couples(placed: DataFrame) -> DataFrame:
    """A row for each vector and each couple of blocks that it is compared in: (label, dim, c1, c2, b1, b2, side, key, rep, m, vec)."""
    to = F.transform("others", lambda q: F.struct(F.least("cell", q).alias("c1"), F.greatest("cell", q).alias("c2"), (F.col("cell") > q).cast("int").alias("side")))
    own = F.array(F.struct(F.col("cell").alias("c1"), F.col("cell").alias("c2"), F.lit(0).alias("side")))
    couple = ["label", "dim", "c1", "c2"]
    dealt = placed.withColumn("to", F.explode(F.concat(own, to))).select("label", "dim", "to.*", "size", "key", "rep", "m", "vec")
    counts = dealt.groupBy(*couple, "size").agg(F.sum((F.col("side") == 0).cast("long")).alias("n1"), F.sum((F.col("side") == 1).cast("long")).alias("n2"))
    counts = counts.where("(c1 = c2 and n1 > 1) or (c1 < c2 and n1 > 0 and n2 > 0)")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / F.col("size")).cast("int"))
    counts = counts.select(*couple, blocks(F.col("n1")).alias("p1"), F.when(F.col("c1") == F.col("c2"), 0).otherwise(blocks(F.col("n2"))).alias("p2"))
    d = dealt.drop("size").join(sized(materialise(counts, "couples")), couple)
    part = F.pmod(F.xxhash64("rep", "key"), F.when(F.col("side") == 0, F.col("p1")).otherwise(F.col("p2"))).cast("int")
    d = d.withColumn("part", part)
    at = lambda x, y, side: F.struct(x.cast("int").alias("b1"), y.cast("int").alias("b2"), side.cast("int").alias("s"))
    steps = lambda n: F.sequence(F.lit(0), n - 1)
    # within a cell: block part meets the later ones on side 0 and the earlier ones on side 1
    inner = F.transform(steps(F.col("p1")), lambda k: at(F.least(k, "part"), F.greatest(k, "part"), k < F.col("part")))
    left = F.transform(steps(F.col("p2")), lambda k: at(F.col("part"), k, F.lit(0)))
    right = F.transform(steps(F.col("p1")), lambda k: at(k, F.col("part"), F.lit(1)))
    where = F.when(F.col("c1") == F.col("c2"), inner).when(F.col("side") == 0, left).otherwise(right)
    return d.withColumn("at", F.explode(where)).select(*couple, "at.b1", "at.b2", F.col("at.s").alias("side"), "key", "rep", "m", "vec")


def _join_classes(rows: DataFrame, named: DataFrame, group: list[str], wanted: list[Column]) -> DataFrame:
    """rows left joined with named by class; a class of more than HEAVY rows is dealt over as many keys as it takes."""
    heavy = named.where(F.col("m") > HEAVY).select(*group, F.ceil(F.col("m") / F.lit(float(HEAVY))).cast("int").alias("salts"))
    d = rows.join(sized(heavy), group, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"), F.lit(0)))
    spread = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("m") / F.lit(float(HEAVY)))).cast("int") - 1)))
    return d.join(sized(spread.select(*group, "salt", *wanted)), [*group, "salt"], "left")


def near_embeddings(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, block: int = BLOCK, largest: int = LARGEST) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Rows are compared where labels are equal and not null and vectors have the same length. Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing, nor do rows without an id: no links, their own component, kept. Rows
    that repeat a vector are linked with each other at once. n_links counts the other rows of the row's label that it is linked with, rows
    of its own id too; rows that share an id are one node of the components. Vectors may be of any length, of different lengths too. An empty
    table gives no rows; other columns, whatever their names, are not looked at. Labels may be of any type. Cosines within
    a rounding error of the threshold are decided by the products of the unit vectors.
    """
    bound_batches(df.sparkSession)
    rows = materialise(prepare(df, id_col, vector_col, label_col), "vectors")
    group = ["label", "dim", "key"]
    is_good = F.col("key").isNotNull() & F.col("label").isNotNull() & F.col("id").isNotNull()
    good = rows.where(is_good)
    classes = materialise(good.groupBy(*group).agg(F.min("id").alias("rep"), F.count("*").alias("m"), F.first("vec").alias("vec")), "classes")
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold)))
    reps = classes.join(sized(sizes), ["label", "dim"]).select("rep", *group, "m", "vec", "n")
    placed = materialise(_place(reps, _pivots(reps, block, largest), block, largest, reach), "cells")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        within = (pdf.c1.iloc[0], pdf.b1.iloc[0]) == (pdf.c2.iloc[0], pdf.b2.iloc[0])
        if not len(left) or (not len(right) and not within):
            out = pd.DataFrame({"key": [], "links": np.zeros(0, np.int64), "rep": np.zeros(0, np.int64), "other": np.zeros(0, np.int64)})
        else:
            out = compare_blocks(left.reset_index(drop=True), None if within else right.reset_index(drop=True), threshold)
        out.insert(0, "label", pdf.label.iloc[0])
        out.insert(1, "dim", pdf.dim.iloc[0])
        return out

    linked = _couples(placed).groupBy("label", "dim", "c1", "b1", "c2", "b2").applyInPandas(compare, "label string, dim int, key binary, links long, rep long, other long")
    linked = materialise(linked, "links")
    counts = linked.groupBy(*group).agg(F.sum("links").alias("links"))
    # ids that stand in several classes bring these together
    class_hash = F.xxhash64(*group)
    spread = good.groupBy("id").agg(F.min(class_hash).alias("a"), F.max(class_hash).alias("z")).where("a <> z").select("id")
    spread = good.join(sized(materialise(spread, "spread")), "id").select("id", *group).distinct().join(classes.select(*group, "rep"), group)
    low = spread.groupBy("id").agg(F.min("rep").alias("src"))
    shared = spread.join(low, "id").select("src", F.col("rep").alias("dst")).where("src <> dst").distinct()
    component = connected_components(linked.select(F.col("rep").alias("src"), F.col("other").alias("dst")).unionByName(shared))
    named = classes.select(*group, "rep", "m").join(counts, group, "left").join(component.withColumnRenamed("node", "rep"), "rep", "left")
    links = F.col("m") - 1 + F.coalesce("links", F.lit(0))
    # a class of one row without links or a component needs no join
    named = materialise(named.where("m > 1 or links > 0 or component is not null").select(*group, "m", links.alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "named")
    release(placed, linked, classes)
    live = _join_classes(good.select("id", *group), named, group, [F.col("n_links"), F.col("component_id")])
    comp = F.coalesce("component_id", "id")
    live = live.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), (F.col("id") == comp).alias("kept"))
    alone = rows.where(~is_good).select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return live.unionByName(alone)
