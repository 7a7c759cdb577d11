"""What the operators share: joins of checked size, connected components, small expression helpers; scratch tables come from the runtime."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import bound_batches, materialise, release, shared_dir

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Up to so many narrow rows a side of a join is broadcast (some 40 MB as a hash table); beyond, the join shuffles.
BROADCAST_ROWS = 500_000


def sized(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its count says that it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def byte_slices(texts: pa.Array, size: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many bytes of text together, to bound what a worker holds at a time whatever a batch's rows."""
    start = held = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        held += n or 0
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, which hands memory that it no longer uses back to the system when a task ends: workers live on for other stages' tasks."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def give_back() -> None:
    """Hand memory that this process no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def let(value: Column, body) -> Column:
    """body(v) with v bound to value, computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_hash(df: DataFrame, columns: list[str]) -> Column:
    """A hash of the columns; maps, which have no hash, by their text."""
    plain = lambda c: F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in df.schema[c].dataType.simpleString() else F.col(f"`{c}`")
    return F.xxhash64(*[plain(c) for c in columns])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of each linked node: (src long, dst long) -> (node, component).

    Alternating large-star and small-star rounds until nothing changes; every round is a map-side combined minimum and two
    equi-joins on narrow rows, and is written to the shared folder. Nodes without a link don't appear.
    Nothing about links or components comes to the driver but the count of links and a checksum.
    """
    e = (
        edges.where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    e = materialise(e, "cc")
    before = now = None
    while before is None or now != before:
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        release(e)
        e = new
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    out._scratch_path = e._scratch_path
    return out


__all__ = ["WORD", "ascii_lower", "bound_batches", "byte_slices", "connected_components", "fresh", "give_back", "let", "materialise", "release", "row_hash", "shared_dir", "sized", "tidy"]
