"""Scans of annotation files, result shards, images, arrays and archives as DataFrames."""

from __future__ import annotations

import ast
import gzip
import io
import tarfile
import zipfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T



def annotations(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str, required: Sequence[str] = (), lines: bool = False) -> DataFrame:
    """JSON arrays or documents of several files, or JSON lines, as our own sinks write them, each row with its file (S01, S04, S14). Rows without a required field go."""
    d = spark.read.schema(schema).option("multiLine", not lines).json(list(paths)).withColumn("_file", F.col("_metadata.file_path"))
    for c in required:
        d = d.where(F.col(c).isNotNull())
    return d


def quarantine(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed lines) of line-wise JSON; nothing is dropped in silence."""
    s = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    raw = spark.read.schema(T.StructType([T.StructField("value", T.StringType())])).text(list(paths))
    d = raw.select("value", F.from_json("value", s, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return d.where("r._corrupt is null").select("r.*").drop("_corrupt"), d.where("r._corrupt is not null").select("value")


def explode_field(df: DataFrame, field: str) -> DataFrame:
    """The rows nested in a document's field."""
    return df.select(F.explode(field).alias("_r")).select("_r.*")


def select_questions(df: DataFrame, images: Sequence = (), question_types: Sequence[str] = (), answer_types: Sequence[str] = ()) -> DataFrame:
    """Rows by lists of images and types; an empty list asks for nothing."""
    for c, values in (("image_id", images), ("question_type", question_types), ("answer_type", answer_types)):
        if values:
            df = df.where(F.col(c).isin(list(values)))
    return df


def result_shards(spark: SparkSession, path: str, schema: T.StructType | str, lines: bool = False) -> DataFrame:
    """Result files of all ranks, JSON arrays or lines, with rank and place, ranks by number, not by name."""
    d = spark.read.schema(schema).option("multiLine", not lines).json(path).withColumn("_file", F.col("_metadata.file_path"))
    d = d.withColumn("rank", F.regexp_extract("_file", r"rank(\d+)", 1).cast("int"))
    return d.withColumn("pos", F.monotonically_increasing_id()).drop("_file")


def listing(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime) of files (S05); contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(folder).select("path", "length", "modificationTime")


def image_folder(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, class_name, label): the folder's name is the class, classes are numbered by name."""
    d = listing(spark, folder, pattern).withColumn("class_name", F.element_at(F.split("path", "/"), -2))
    names = d.select("class_name").distinct().withColumn("label", (F.row_number().over(W.orderBy("class_name")) - 1).cast("int"))
    return d.join(names, "class_name").select("path", "class_name", "label")


def panoptic(df: DataFrame, image_folder: str, mask_folder: str, image_ext: str = ".jpg", mask_ext: str = ".png") -> DataFrame:
    """One row for an annotated image with paths (S15, S16): file_name's extension becomes the image's."""
    a = explode_field(df, "annotations")
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    return a.select("image_id", F.concat(F.lit(image_folder + "/"), stem, F.lit(image_ext)).alias("image"), F.concat(F.lit(mask_folder + "/"), stem, F.lit(mask_ext)).alias("mask"), "segments_info")


def segments(df: DataFrame, ignore: int = 255) -> DataFrame:
    """(image_id, id, category_id) of segments that are no crowd and not to be ignored."""
    d = df.select("image_id", F.explode("segments_info").alias("s")).select("image_id", "s.*")
    return d.where((F.col("iscrowd") == 0) & (F.col("category_id") != ignore)).select("image_id", "id", "category_id")


# --- binary formats, decoded in Arrow batches ---------------------------------------------------------------


def _read_npy(raw: bytes) -> np.ndarray:
    return np.load(io.BytesIO(raw), allow_pickle=False)


def arrays(spark: SparkSession, path: str, pattern: str = "*.npy") -> DataFrame:
    """(path, shape, values) of .npy files (S03, S09, S10); pickled contents are refused."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            a = [_read_npy(x) for x in b.content]
            yield pd.DataFrame({"path": b.path, "shape": [list(map(int, x.shape)) for x in a], "values": [x.astype(np.float64).ravel() for x in a]})

    return d.mapInPandas(decode, "path string, shape array<int>, values array<double>")


def points(df: DataFrame, width: int) -> DataFrame:
    """(path, row, values) of an n x width array each."""
    n = F.floor(F.size("values") / width).cast("int")
    return df.where(n > 0).select("path", "values", F.explode(F.sequence(F.lit(0), n - 1)).alias("row")).select("path", "row", F.slice("values", F.col("row") * width + 1, width).alias("values"))


def pixels(df: DataFrame) -> DataFrame:
    """(path, y, x, value) of two-dimensional arrays."""
    d = df.select("path", F.get("shape", 1).alias("_w"), F.posexplode("values").alias("_i", "value"))
    return d.select("path", F.floor(F.col("_i") / F.col("_w")).cast("int").alias("y"), F.pmod("_i", F.col("_w")).alias("x"), "value")


def tar_members(spark: SparkSession, path: str, pattern: str = "*.tar") -> DataFrame:
    """(path, member, key, ext, content) of archives (S07, S13); an archive that can't be read gives a row with an error instead."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, raw in zip(b.path, b.content, strict=True):
                rows = []
                try:
                    with tarfile.open(fileobj=io.BytesIO(raw)) as t:
                        for m in t:
                            if m.isfile():
                                rows.append((path, m.name, *_key(m.name), t.extractfile(m).read(), None))
                except (tarfile.TarError, EOFError, OSError) as e:
                    rows.append((path, None, None, None, None, str(e)))
                yield pd.DataFrame(rows, columns=["path", "member", "key", "ext", "content", "error"])

    return d.mapInPandas(unpack, "path string, member string, key string, ext string, content binary, error string")


def zip_members(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """The same columns for zip archives, and for single .gz files, whose one member is the file without its ending."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, raw in zip(b.path, b.content, strict=True):
                rows = []
                try:
                    if path.endswith(".gz"):
                        name = path.rsplit("/", 1)[-1].removesuffix(".gz")
                        rows.append((path, name, *_key(name), gzip.decompress(raw), None))
                    else:
                        with zipfile.ZipFile(io.BytesIO(raw)) as z:
                            rows += [(path, m.filename, *_key(m.filename), z.read(m), None) for m in z.infolist() if not m.is_dir()]
                except (zipfile.BadZipFile, EOFError, OSError, RuntimeError) as e:
                    rows = [(path, None, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["path", "member", "key", "ext", "content", "error"])

    return d.mapInPandas(unpack, "path string, member string, key string, ext string, content binary, error string")


def _key(member: str) -> tuple[str, str]:
    key, _, ext = member.rsplit("/", 1)[-1].partition(".")
    return key, ext


def frames(df: DataFrame, make: Callable, schema: T.StructType | str, attempts: int = 1) -> DataFrame:
    """Frames of videos: (.., content) through a decoder that the caller injects, made once a task (S11); indices come from sampling.frame_indices()."""
    from ..operators.scorers import score

    return score(df, make, schema, batch_rows=1, attempts=attempts)


_YAML_VALUES = {"true": True, "false": False, "null": None, "~": None, "": None}


def simple_yaml(text: str) -> dict:
    """Nested mappings of scalars and inline lists; what configuration files of this kind hold."""
    root: dict = {}
    stack = [(-1, root)]
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        depth = len(body) - len(body.lstrip())
        key, _, value = body.strip().partition(":")
        while stack[-1][0] >= depth:
            stack.pop()
        value = value.strip()
        if not value:
            stack[-1][1][key] = child = {}
            stack.append((depth, child))
            continue
        low = value.lower()
        if low in _YAML_VALUES:
            stack[-1][1][key] = _YAML_VALUES[low]
        else:
            try:
                stack[-1][1][key] = ast.literal_eval(value)
            except (ValueError, SyntaxError):
                stack[-1][1][key] = value
    return root


def yaml_settings(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, value) of YAML files, nested names with dots, values as text, null where there is none (S03); a file is small."""
    d = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")

    def flat(tree: dict, before: str = "") -> Iterator[tuple[str, str | None]]:
        for k, v in tree.items():
            if isinstance(v, dict) and v:
                yield from flat(v, f"{before}{k}.")
            else:
                yield before + str(k), None if v is None or v == {} else str(v)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *x) for p, text in zip(b.path, b.value, strict=True) for x in flat(simple_yaml(text))], columns=["path", "name", "value"])

    return d.mapInPandas(parse, "path string, name string, value string")


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """A table by the path's extension (S03): .txt, .json, .csv, .parquet, .orc, .npy, .yaml; .gz and .bz2 after them are read by Spark."""
    name = path.rstrip("/").removesuffix(".gz").removesuffix(".bz2")
    ext = name.rsplit(".", 1)[-1].lower()
    readers: dict[str, Callable[[], DataFrame]] = {
        "txt": lambda: spark.read.text(path),
        "json": lambda: spark.read.options(**{"multiLine": True, **options}).json(path),
        "jsonl": lambda: spark.read.options(**options).json(path),
        "csv": lambda: spark.read.options(**{"header": True, **options}).csv(path),
        "parquet": lambda: spark.read.options(**options).parquet(path),
        "orc": lambda: spark.read.options(**options).orc(path),
        "npy": lambda: arrays(spark, path),
        "yaml": lambda: yaml_settings(spark, path),
        "yml": lambda: yaml_settings(spark, path),
    }
    if ext not in readers:
        raise ValueError(f"no reader for .{ext}: pickles are refused, other formats have their own functions")
    return readers[ext]()
