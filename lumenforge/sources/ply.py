"""Point clouds as PLY files: a writer whose files appear when the whole job commits, and a reader by ranges of points."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..runtime import make_folder
from .shared import open_path

#: Bytes of a scene's points that a task holds before they go to its own disk, which it reads back itself within the task.
SPOOL = 64 << 20
#: Property types of the format and how numpy names them (fixed values).
TYPES = {"char": "i1", "uchar": "u1", "short": "<i2", "ushort": "<u2", "int": "<i4", "uint": "<u4", "float": "<f4", "double": "<f8"}


def header(n: int, properties: list[tuple[str, str]]) -> bytes:
    lines = ["ply", "format binary_little_endian 1.0", f"element vertex {n}", *[f"property {kind} {name}" for name, kind in properties], "end_header"]
    return ("\n".join(lines) + "\n").encode()


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int, str]]  # scene, points, path that isn't the scene's yet


class PlyFiles(DataSource):
    """Format `ply`, to write: (scene, then numbers) as <scene>.ply each, a header that says how many points, and the points. Use save_ply()."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return PlyWriter(self.options["path"], [f.name for f in schema][1:], self.options.get("types", "").split(","))


class PlyWriter(DataSourceArrowWriter):
    """Tasks write under names of their own; commit renames, so a task that runs twice or a job that fails leaves no scene half there."""

    def __init__(self, path: str, names: list[str], types: list[str]) -> None:
        self.path = path
        self.properties = list(zip(names, [t for t in types if t] or ["float"] * len(names), strict=True))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        kind = np.dtype([(n, TYPES[t]) for n, t in self.properties])
        files: list[tuple[str, int, str]] = []
        scene = body = None
        n = 0

        def end() -> None:
            name = f"{self.path}/_part-{uuid.uuid4().hex}"
            fs, at = open_path(name)
            body.seek(0)
            with fs.open_output_stream(at, compression=None) as out:
                out.write(header(n, self.properties))
                while data := body.read(1 << 20):
                    out.write(data)
            body.close()
            files.append((scene, n, name))

        for b in batches:
            scenes = b.column(0).to_pylist()
            rows = np.zeros(len(scenes), dtype=kind)
            for i, (name, _) in enumerate(self.properties):
                rows[name] = b.column(i + 1).to_numpy(zero_copy_only=False)
            at = 0
            while at < len(scenes):
                stop = at
                while stop < len(scenes) and scenes[stop] == scenes[at]:
                    stop += 1
                if body is None or scenes[at] != scene:
                    if body is not None:
                        end()
                    scene, n, body = scenes[at], 0, tempfile.SpooledTemporaryFile(SPOOL)
                body.write(rows[at:stop].tobytes())
                n += stop - at
                at = stop
        if body is not None:
            end()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m for f in m.files]
        fs, at = open_path(self.path)
        if len({f[0] for f in files}) < len(files):
            self.abort(messages)
            raise ValueError("a scene came in several pieces: rows have to be dealt and sorted by scene")
        for scene, _, name in files:
            fs.move(open_path(name)[1], f"{at}/{scene}.ply")
        with fs.open_output_stream(f"{at}/_scenes.json", compression=None) as out:
            out.write(json.dumps({s: n for s, n, _ in files}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for _, _, name in m.files if m else ():
                fs, at = open_path(name)
                fs.delete_file(at)


def save_ply(df: DataFrame, path: str, scene: str, columns: dict[str, str]) -> None:
    """Each scene as path/<scene>.ply, columns (name: PLY type) in order, rows sorted by them (K09). Rows without a scene or with a null are left out.

    A scene is one file, so one task writes it, from its own disk where it is large.
    """
    spark = df.sparkSession
    spark.dataSource.register(PlyFiles)
    path = make_folder(spark, path)
    rows = df.select(F.col(scene).cast("string").alias("scene"), *[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    rows.repartition("scene").sortWithinPartitions("scene", *columns).write.format("ply").option("types", ",".join(columns.values())).mode("append").save(path)


def parse_header(data: bytes) -> tuple[int, np.dtype, int]:
    """(points, their type, where they begin) of a binary little-endian file whose first element is the vertex."""
    end = data.index(b"end_header\n") + len(b"end_header\n")
    lines = data[:end].decode().splitlines()
    if lines[0] != "ply" or "format binary_little_endian 1.0" not in lines:
        raise ValueError("not a binary little-endian PLY file")
    n = next(int(x.split()[2]) for x in lines if x.startswith("element vertex "))
    properties = [x.split() for x in lines if x.startswith("property ")]
    if any(len(p) != 3 for p in properties):
        raise ValueError("list properties are not points")
    return n, np.dtype([(p[2], TYPES[p[1]]) for p in properties]), end


def read_ply(spark: SparkSession, path: str, columns: list[str], points: int = 1 << 20) -> DataFrame:
    """(scene, row, columns as double) of path/*.ply; files are cut in ranges of `points` and read by range."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").load(path).select("path")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                fs, at = open_path(p)
                with fs.open_input_file(at) as f:
                    n, _, _ = parse_header(f.read_at(min(f.size(), 1 << 16), 0))
                starts = list(range(0, n, points))
                yield pa.record_batch([pa.array([p] * len(starts), pa.string()), pa.array(starts, pa.int64())], names=["path", "start"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fs, at = open_path(r["path"])
                with fs.open_input_file(at) as f:
                    n, kind, begin = parse_header(f.read_at(min(f.size(), 1 << 16), 0))
                    m = min(points, n - r["start"])
                    data = np.frombuffer(f.read_at(m * kind.itemsize, begin + r["start"] * kind.itemsize), dtype=kind)
                scene = r["path"].rsplit("/", 1)[-1].removesuffix(".ply")
                yield pa.record_batch([pa.array([scene] * m, pa.string()), pa.array(np.arange(r["start"], r["start"] + m)), *[pa.array(data[c].astype(np.float64)) for c in columns]], names=["scene", "row", *columns])

    ranges = files.mapInArrow(cut, "path string, start long").repartition(max(1, spark.sparkContext.defaultParallelism), "path", "start")
    return ranges.mapInArrow(read, "scene string, row long, " + ", ".join(f"{c} double" for c in columns))
