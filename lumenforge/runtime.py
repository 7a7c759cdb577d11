"""Getting the package to the Python workers, and tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to the executors by Spark's own file server, once an application, unless their path already has it.

    Workers inherit PYTHONPATH and the working folder; where neither leads here, functions that run on them could not import the package.
    """
    root = Path(__file__).resolve().parent.parent
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    app = spark.sparkContext.applicationId
    if app in _SENT or any(p and Path(p).resolve() == root for p in known):
        return
    _SENT.add(app)
    path = Path(tempfile.mkdtemp(prefix="lumenforge-py-")) / "lumenforge.zip"  # staged on the driver, which serves it
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "lumenforge").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(path))


#: Bytes of an Arrow batch: a worker, and Spark beside it, hold a batch of texts several times over.
BATCH = 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Have Spark send batches of at most BATCH bytes, unless the session asks for fewer or for another number than Spark's own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, str(BATCH))


_LEFT: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, which only local mode may do, a new one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lumenforge-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted at exit."""
    path = f"{shared_dir(spark)}/lumenforge/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _LEFT[path] = spark
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: the lineage is cut, and a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the scratch tables behind frames that materialise() returned and nothing will read again."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path in _LEFT:
            delete(_LEFT.pop(path), path)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _file_system(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, old: str, new: str) -> None:
    """Rename a file or folder within the shared folder."""
    p, fs = _file_system(spark, old)
    q, _ = _file_system(spark, new)
    fs.mkdirs(q.getParent())
    if not fs.rename(p, q):
        raise OSError(f"{old} can't be moved to {new}")


def make_folder(spark: SparkSession, path: str) -> str:
    """Make a folder; its full address, with the scheme that a plain path means here."""
    p, fs = _file_system(spark, path)
    fs.mkdirs(p)
    return fs.makeQualified(p).toString()


def write_file(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, by the file system that the path names."""
    p, fs = _file_system(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(data))
    out.close()


def _clean() -> None:
    for path, spark in list(_LEFT.items()):
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass


atexit.register(_clean)
