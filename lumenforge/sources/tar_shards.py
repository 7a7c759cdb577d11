"""Tar shards as a stream: written by tasks, split by an index of member offsets, read by range, resampled with replacement, shuffled in a bounded buffer.

An archive is never one cell. A first job walks the headers of each archive and writes two tables beside each other: every member, and the
splits, ranges of bytes that begin at a header, as many as tasks can share and not as many as there are bytes. The data source makes a partition of each split; a task opens the archive,
reads its range and gives a row a member. A member whose header is damaged, or that the end of the file cuts, is a row with its name, if
that can be read, and an error; reading goes on at the next header that is whole (in damaged archives that may be one within a member).
"""

from __future__ import annotations

import hashlib
import tarfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..runtime import make_folder, scratch
from .shared import open_path

BLOCK = 512
SPLIT = 128 << 20
#: Splits below SPLIT bytes that an index has about, or four for each core where that is more: the driver lists, sends and keeps account of each.
SPLITS = 256
_WINDOW = 1 << 20
MEMBERS = "path string, offset long, end long, member string, data_at long, size long, error string"
SCHEMA = "pick long, path string, offset long, member string, key string, ext string, size long, content binary, error string"


# --- writing ------------------------------------------------------------------------------------------------


def write_shards(df: DataFrame, folder: str, shard: str, member: str, content: str, alter: Callable[[str, int, bytes], bytes] | None = None) -> DataFrame:
    """(shard, path, members): one archive folder/<shard>.tar for each shard, its members in name order; a null content is an empty member.

    A shard is written by one task under a name of its own and then renamed, so a task that is run again replaces the file by the same.
    alter(shard, number, headers and content) may change a member's bytes as they are written, for archives that are to be damaged.
    """
    spark = df.sparkSession
    folder = make_folder(spark, folder)
    rows = df.select(F.col(shard).cast("string").alias("shard"), F.col(member).alias("member"), F.coalesce(F.col(content).cast("binary"), F.lit(b"")).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = file = None
        n = size = 0

        def end() -> pa.RecordBatch:
            file.write(bytes(2 * BLOCK + -(size + 2 * BLOCK) % tarfile.RECORDSIZE))
            file.close()
            fs.move(f"{at}.part-{mark}", at)
            return pa.record_batch([[now], [f"{folder}/{now}.tar"], pa.array([n], pa.int64())], names=["shard", "path", "members"])

        for b in batches:
            for s, name, data in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if s != now:
                    if file:
                        yield end()
                    now, n, mark = s, 0, uuid.uuid4().hex
                    fs, at = open_path(f"{folder}/{s}.tar")
                    file = fs.open_output_stream(f"{at}.part-{mark}", compression=None, buffer_size=_WINDOW)
                    size = 0
                whole = _header(name, len(data)) + data + bytes(-len(data) % BLOCK)
                if alter:
                    whole = alter(s, n, whole)
                file.write(whole)
                size += len(whole)
                n += 1
        if file:
            yield end()

    return rows.repartition("shard").sortWithinPartitions("shard", "member").mapInArrow(run, "shard string, path string, members long")


_PLAIN = tarfile.TarInfo("").tobuf(tarfile.PAX_FORMAT)
_PLAIN_SUM = sum(_PLAIN[:148]) + 256 + sum(_PLAIN[156:]) - sum(_PLAIN[124:135])


def _header(name: str, size: int) -> bytes:
    """The headers of a member, as tarfile makes them; short plain names are set into a header that is made once."""
    if len(name) > 100 or not name.isascii() or "\0" in name or name.endswith("/") or size >= 8**11:
        info = tarfile.TarInfo(name)
        info.size = size
        return info.tobuf(tarfile.PAX_FORMAT)
    raw, digits = name.encode(), b"%011o" % size
    return b"%b%b%b%06o\0 %b" % (raw.ljust(100, b"\0"), _PLAIN[100:124], digits + _PLAIN[135:148], _PLAIN_SUM + sum(raw) + sum(digits), _PLAIN[156:])


# --- walking ------------------------------------------------------------------------------------------------


@dataclass
class Member:
    """A member, or what is left of one: where its headers begin and where it ends."""

    offset: int
    end: int
    name: str | None
    data_at: int
    size: int
    error: str | None = None


class _Window:
    """Reads of neighbouring headers from one buffer."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size, self.at, self.data = file, file.size(), 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not self.at <= at or at + n > self.at + len(self.data):
            if n > _WINDOW:
                return self.file.read_at(n, at)
            self.at, self.data = at, self.file.read_at(_WINDOW, at)
        return self.data[at - self.at : at - self.at + n]


def _padded(n: int) -> int:
    return -(-n // BLOCK) * BLOCK


def _pax(data: bytes) -> dict[str, str]:
    """Records `length key=value` of an extended header."""
    out, at = {}, 0
    while at < len(data) and data[at : at + 1].isdigit():
        n = int(data[at : data.index(b" ", at)])
        key, _, value = data[data.index(b" ", at) + 1 : at + n - 1].partition(b"=")
        out[key.decode()] = value.decode("utf-8", "replace")
        at += n
    return out


def _plain(head: bytes) -> tuple[str, int] | None:
    """(name, size) of a whole header of a regular file with a plain short name; None for any other, which tarfile reads."""
    name, size = head[:100].partition(b"\0")[0], head[124:135]
    if head[156:157] != b"0" or head[257:265] != b"ustar\x0000" or head[345] or head[135] or not name or not name.isascii() or not size.isdigit() or name.endswith(b"/"):
        return None
    said = head[148:154]
    if not said.isdigit() or head[154:156] != b"\0 " or any(c in said + size for c in b"89") or int(said, 8) != sum(head) - sum(head[148:156]) + 256:
        return None
    return name.decode(), int(size, 8)


def walk(file: pa.NativeFile, start: int = 0, end: int | None = None, window: _Window | None = None) -> Iterator[Member]:
    """Regular members whose headers begin in [start, end), and what is broken between them; through a window that the caller may read contents from."""
    w = window or _Window(file)
    end = w.size if end is None else end
    at, first, said = start, None, {}
    while at < end or first is not None:
        head = w.read(at, BLOCK)
        if len(head) < BLOCK:
            if head.strip(b"\0") or first is not None:
                yield Member(first if first is not None else at, w.size, None, at, 0, "cut short")
            return
        if not head.strip(b"\0"):
            at += BLOCK
            continue
        if first is None and (plain := _plain(head)):
            name, size = plain
            first, data_at = at, at + BLOCK
            if data_at + size > w.size:
                yield Member(first, w.size, name, data_at, size, "cut short")
                return
            at = data_at + _padded(size)
            yield Member(first, at, name, data_at, size)
            first = None
            continue
        first = at if first is None else first
        try:
            info = tarfile.TarInfo.frombuf(head, "utf-8", "replace")
        except tarfile.HeaderError as e:
            name = head[:100].split(b"\0")[0].decode("utf-8", "replace")
            bad = at
            while (at := at + BLOCK) < w.size and not _whole(w.read(at, BLOCK)):
                pass
            yield Member(first, at, name or None, bad, 0, f"bad header: {e}")
            first, said = None, {}
            continue
        data_at = at + BLOCK
        if info.type in (tarfile.XHDTYPE, tarfile.XGLTYPE, tarfile.GNUTYPE_LONGNAME, tarfile.GNUTYPE_LONGLINK):
            data = w.read(data_at, info.size)
            if info.type == tarfile.XHDTYPE:
                said |= _pax(data)
            elif info.type == tarfile.GNUTYPE_LONGNAME:
                said["path"] = data.rstrip(b"\0").decode("utf-8", "replace")
            if info.type == tarfile.XGLTYPE:
                first = None
            at = data_at + _padded(info.size)
            continue
        size = int(said.get("size", info.size)) if info.isreg() else 0
        name, at = said.get("path", info.name), data_at + _padded(size)
        if data_at + size > w.size:
            yield Member(first, w.size, name, data_at, size, "cut short")
            return
        if info.isreg():
            yield Member(first, at, name, data_at, size)
        first, said = None, {}


def _whole(head: bytes) -> bool:
    try:
        tarfile.TarInfo.frombuf(head, "utf-8", "replace")
    except tarfile.HeaderError:
        return False
    return True


# --- index --------------------------------------------------------------------------------------------------


def index_shards(spark: SparkSession, folder: str, pattern: str = "*.tar", split: int = SPLIT) -> str:
    """Walk the headers of all archives of a folder; the path of the index, whose tables are `members` and `splits`.

    Splits are ranges of about `split` bytes; where those are more than SPLITS, ranges are as wide as makes SPLITS, up to SPLIT bytes.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = open_path(path)
                with fs.open_input_file(at) as f:
                    held = []
                    for m in walk(f):
                        held.append((path, m.offset, m.end, m.name, m.data_at, m.size, m.error))
                        if len(held) == 10_000:
                            yield _rows(held)
                            held = []
                    if held:
                        yield _rows(held)

    index = scratch(spark, "tar-index")
    files.select("path").repartition(max(1, spark.sparkContext.defaultParallelism), "path").mapInArrow(run, MEMBERS).write.parquet(f"{index}/members")
    members = spark.read.schema(MEMBERS).parquet(f"{index}/members")
    total = files.agg(F.sum("length")).first()[0] or 0  # a row
    split = max(split, min(SPLIT, total // _ranges(spark)))
    ranges = members.groupBy("path", F.floor(F.col("offset") / split).alias("k")).agg(F.min("offset").alias("start"), F.max("end").alias("end"), F.count("*").alias("members"))
    ranges.select("path", "start", "end", "members").coalesce(1).write.parquet(f"{index}/splits")  # a row for each range
    return make_folder(spark, index)


def _ranges(spark: SparkSession) -> int:
    return max(SPLITS, 4 * spark.sparkContext.defaultParallelism)


_TYPES = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("end", pa.int64()), ("member", pa.string()), ("data_at", pa.int64()), ("size", pa.int64()), ("error", pa.string())])


def _rows(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _TYPES.types, strict=True)], schema=_TYPES)


# --- reading ------------------------------------------------------------------------------------------------


@dataclass
class Range(InputPartition):
    pick: int
    path: str
    start: int
    end: int


def pick_of(seed: int, i: int, n: int) -> int:
    """The archive, of n in path order, that pick i of a seeded resampling takes: the digest's first 52 bits modulo n."""
    return int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:13], 16) % n


def _joined(splits: list[tuple[int, int]], width: int) -> list[tuple[int, int]]:
    """Splits of an archive in order, neighbours that are at most `width` bytes together as one."""
    out = splits[:1]
    for start, end in splits[1:]:
        if end - out[-1][0] <= width:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


class TarShards(DataSource):
    """Format `tar_shards`: rows of SCHEMA out of indexed archives. Options: index; picks and seed to resample archives; bad = name, skip or fail; ranges, about as many as all picks are read in, one a pick at least."""

    @classmethod
    def name(cls) -> str:
        return "tar_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.index, self.picks, self.seed, self.bad = options["index"], options.get("picks"), int(options.get("seed", 0)), options.get("bad", "name")
        self.ranges = int(options.get("ranges", SPLITS))
        if self.bad not in ("name", "skip", "fail"):
            raise ValueError(f"bad must be name, skip or fail, not {self.bad}")

    def partitions(self) -> list[Range]:
        fs, at = open_path(f"{self.index}/splits")
        rows = pq.read_table(at, filesystem=fs).to_pylist()
        by: dict[str, list[tuple[int, int]]] = {}
        for r in sorted(rows, key=lambda r: (r["path"], r["start"])):
            by.setdefault(r["path"], []).append((r["start"], r["end"]))
        paths = list(by)
        chosen = list(enumerate(paths)) if self.picks is None else [(i, paths[pick_of(self.seed, i, len(paths))]) for i in range(int(self.picks)) if paths]
        width = min(SPLIT, sum(x[1] - x[0] for _, p in chosen for x in by[p]) // self.ranges)
        wide = {p: _joined(by[p], width) for _, p in chosen}
        return [Range(i, p, *x) for i, p in chosen for x in wide[p]] or [Range(-1, "", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """Arrow batches of at most 1,000 members, or some _WINDOW of contents."""
        held, size = [], 0
        for row in self._members(partition):
            held.append(row)
            size += row[6] if row[7] is not None else 0
            if len(held) == 1000 or size >= _WINDOW:
                yield _cells(held)
                held, size = [], 0
        yield _cells(held)

    def _members(self, partition: Range) -> Iterator[tuple]:
        if partition.pick < 0:
            return
        fs, at = open_path(partition.path)
        with fs.open_input_file(at) as f:
            window = _Window(f)
            for m in walk(f, partition.start, partition.end, window):
                if m.error:
                    if self.bad == "fail":
                        raise ValueError(f"{partition.path}, {m.name}: {m.error}")
                    if self.bad == "skip":
                        continue
                key, _, ext = (m.name or "").rsplit("/", 1)[-1].partition(".")
                content = None if m.error else window.read(m.data_at, m.size)
                yield partition.pick, partition.path, m.offset, m.name, key or None, ext or None, m.size, content, m.error


_CELLS = pa.schema([(c, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for c, t in (x.split() for x in SCHEMA.split(", "))])


def _cells(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True) if held else [()] * len(_CELLS), _CELLS.types, strict=True)], schema=_CELLS)


def read_shards(spark: SparkSession, index: str, picks: int | None = None, seed: int = 0, bad: str = "name") -> DataFrame:
    """The members of indexed archives (SCHEMA). With picks, that many archives drawn with replacement, each draw with its number."""
    spark.dataSource.register(TarShards)
    r = spark.read.format("tar_shards").option("index", index).option("seed", str(seed)).option("bad", bad).option("ranges", str(_ranges(spark)))
    return (r if picks is None else r.option("picks", str(picks))).load()


def samples(members: DataFrame) -> DataFrame:
    """(pick, path, key, parts): members of an archive that share a key as one sample, parts by extension; of repeated ones the first by place."""
    first = members.where("error is null").groupBy("pick", "path", "key", "ext").agg(F.min_by("content", "offset").alias("content"))
    return first.groupBy("pick", "path", "key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ext", "content")))).alias("parts"))


def decoded(sample: DataFrame, **parts: tuple[str, str]) -> DataFrame:
    """Samples that have every part, as columns: name = (extension, type); a part that can't be cast is null (to_tuple, skipping the rest)."""
    have = sample
    for ext, _ in parts.values():
        have = have.where(F.map_contains_key("parts", ext))

    def column(ext: str, kind: str) -> Column:
        raw = F.element_at("parts", F.lit(ext))
        return raw if kind == "binary" else raw.cast("string").try_cast(kind)

    return have.select("pick", "path", "key", *[column(*p).alias(n) for n, p in parts.items()])


def shuffle_buffer(df: DataFrame, size: int = 1000, seed: int = 0) -> DataFrame:
    """The rows of each partition in a seeded order: a buffer of `size` rows of which a random one goes when the next comes.

    A task holds the buffer and one Arrow batch; a row comes out at most `size` places early. Reruns over the same partitions agree.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            both = t if held is None else pa.concat_tables([held, t])
            n = len(both)
            room = list(range(min(size, n)))
            out = []
            for i, u in zip(range(size, n), rng.random(max(0, n - size)), strict=True):
                j = int(u * size)
                out.append(room[j])
                room[j] = i
            yield from both.take(pa.array(out, pa.int64())).combine_chunks().to_batches()
            held = both.take(pa.array(room, pa.int64())).combine_chunks()
        if held is not None:
            yield from held.take(rng.permutation(len(held))).combine_chunks().to_batches()

    return df.mapInArrow(run, df.schema)
