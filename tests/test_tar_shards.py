"""Tar shards: split reading against the tarfile module, damaged members, resampling, the shuffle buffer."""

from __future__ import annotations

import io
import tarfile
import tracemalloc

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from lumenforge.plans import catalog, flows
from lumenforge.runtime import make_folder, scratch, write_file
from lumenforge.sources import tar_shards as A


def archive(members, fmt=tarfile.PAX_FORMAT):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w", format=fmt) as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            if data is None:
                info.type = tarfile.DIRTYPE
            else:
                info.size = len(data)
            t.addfile(info, io.BytesIO(data or b""))
    return raw.getvalue()


MEMBERS = [("d", None), ("d/a.txt", b"alpha"), ("d/a.cls", b"1"), ("n" * 150 + "/long name é.txt", b"x" * 3000), ("empty.txt", b""), ("b.txt", bytes(range(256)) * 20), ("b.cls", b"2")]
FILES = [m for m in MEMBERS if m[1] is not None]


@pytest.mark.parametrize("fmt", [tarfile.PAX_FORMAT, tarfile.GNU_FORMAT])
@pytest.mark.parametrize("split", [1, 2000, 1 << 20])
def test_members_of_splits_are_those_of_the_archive(spark, fmt, split):
    base = scratch(spark, "tar")
    for k in range(3):
        write_file(spark, f"{base}/{k}.tar", archive(MEMBERS, fmt))
    index = A.index_shards(spark, base, split=split)
    d = A.read_shards(spark, index)
    assert d.rdd.getNumPartitions() == {1: 18, 2000: None, 1 << 20: 3}[split] or split == 2000
    got = sorted((r.path.rsplit("/", 1)[-1], r.member, bytes(r.content)) for r in d.collect())
    assert got == sorted((f"{k}.tar", n, c) for k in range(3) for n, c in FILES)


def test_damaged_members_are_named_and_the_rest_is_read(spark):
    base = scratch(spark, "tar")
    raw = archive(FILES, tarfile.USTAR_FORMAT) if all(len(n) < 100 for n, _ in FILES) else archive([m for m in FILES if len(m[0]) < 100], tarfile.USTAR_FORMAT)
    at = raw.index(b"empty.txt")
    write_file(spark, f"{base}/bad.tar", raw[: at + 148] + b"!" * 8 + raw[at + 156 :])
    write_file(spark, f"{base}/cut.tar", raw[: raw.index(b"b.txt") + 512 + 100])
    write_file(spark, f"{base}/none.tar", b"")
    index = A.index_shards(spark, base)
    got = {(r.path.rsplit("/", 1)[-1], r.member, r.error is None) for r in A.read_shards(spark, index).collect()}
    assert got == {("bad.tar", "d/a.txt", True), ("bad.tar", "d/a.cls", True), ("bad.tar", "empty.txt", False), ("bad.tar", "b.txt", True), ("bad.tar", "b.cls", True), ("cut.tar", "d/a.txt", True), ("cut.tar", "d/a.cls", True), ("cut.tar", "empty.txt", True), ("cut.tar", "b.txt", False)}
    assert A.read_shards(spark, index, bad="skip").count() == 7
    with pytest.raises(Exception, match="bad header|cut short"):
        A.read_shards(spark, index, bad="fail").collect()


def test_resampling_draws_with_replacement(spark):
    base = scratch(spark, "tar")
    for k in range(4):
        write_file(spark, f"{base}/{k}.tar", archive([(f"{k}.txt", b"%d" % k), (f"{k}.cls", b"9"), (f"{k}x.txt", b"no class")]))
    index = A.index_shards(spark, base)
    d = A.decoded(A.samples(A.read_shards(spark, index, picks=25, seed=3)), text=("txt", "string"), kind=("cls", "int"))
    got = sorted((r.pick, r.text, r.kind) for r in d.collect())
    assert got == [(i, str(A.pick_of(3, i, 4)), 9) for i in range(25)]
    assert len({g[1] for g in got}) == 4


def test_no_archives(spark):
    base = make_folder(spark, scratch(spark, "tar"))
    write_file(spark, f"{base}/x.tar", b"")
    assert A.read_shards(spark, A.index_shards(spark, base)).collect() == []
    assert A.read_shards(spark, A.index_shards(spark, base), picks=3).collect() == []


@pytest.mark.parametrize(("rows", "size"), [(5000, 100), (50, 1000), (0, 10), (300, 1)])
def test_shuffle_buffer_is_seeded_and_bounded(spark, rows, size):
    d = spark.range(rows).coalesce(1)
    a, b, c = ([r.id for r in A.shuffle_buffer(d, size, seed).collect()] for seed in (1, 1, 2))
    assert a == b and sorted(a) == list(range(rows))
    assert rows < 10 or size == 1 or a != c
    assert all(x - place <= size for place, x in enumerate(a))


def test_written_shards_are_read_back(spark):
    base = scratch(spark, "tar")
    rows = [(k % 3, f"{k:03}.txt", None if k == 5 else f"text {k}") for k in range(40)]
    said = A.write_shards(spark.createDataFrame(rows, "s int, m string, c string"), base, "s", "m", "c").collect()
    assert sorted((r.shard, r.members) for r in said) == [("0", 14), ("1", 13), ("2", 13)]
    got = sorted((r.member, bytes(r.content).decode()) for r in A.read_shards(spark, A.index_shards(spark, base)).collect())
    assert got == sorted((m, c or "") for _, m, c in rows)


def test_plain_headers_are_tarfiles_own():
    import tarfile

    for name, size in [("a.txt", 0), ("x/" + "y" * 98, 8**10), ("dir.d/000000001.cls", 511), ("é.txt", 7), ("z" * 120, 3), ("b", 8**11 + 1)]:
        info = tarfile.TarInfo(name)
        info.size = size
        head = A._header(name, size)
        assert head == info.tobuf(tarfile.PAX_FORMAT), name
        plain = name.isascii() and len(name) <= 100 and size < 8**11
        assert A._plain(head[:512]) == ((name, size) if plain else None)
        assert A._plain(head[:148] + b"x" * 8 + head[156:512]) is None and A._plain(b"Z" + head[1:512]) is None


def test_splits_are_no_more_than_tasks_can_share(spark):
    base = scratch(spark, "tar")
    names = [f"{k:05}.txt" for k in range(2000)]
    write_file(spark, f"{base}/a.tar", archive([(n, b"x") for n in names]))
    write_file(spark, f"{base}/b.tar", archive([("b.txt", b"y")]))
    ranges = A._Reader({"index": A.index_shards(spark, base, split=1)}).partitions()
    assert 200 <= len(ranges) < 300
    with fs.LocalFileSystem().open_input_file(f"{base}/a.tar".removeprefix("file://")) as f:
        assert [m.name for r in ranges if r.path.endswith("a.tar") for m in A.walk(f, r.start, r.end)] == names


def test_many_picks_of_an_archive_share_as_many_ranges(spark):
    base = scratch(spark, "tar")
    names = [f"{k:05}.txt" for k in range(2000)]
    write_file(spark, f"{base}/a.tar", archive([(n, b"x") for n in names]))
    ranges = A._Reader({"index": A.index_shards(spark, base, split=1), "picks": "50"}).partitions()
    assert 50 < len(ranges) <= 600  # 50 times all splits are 10,000 or more
    with fs.LocalFileSystem().open_input_file(f"{base}/a.tar".removeprefix("file://")) as f:
        for pick in (0, 49):
            assert [m.name for r in ranges if r.pick == pick for m in A.walk(f, r.start, r.end)] == names


def test_the_driver_reads_no_archive(spark, tmp_path):
    spark.range(64).select(F.col("id").alias("p_partkey"), F.repeat(F.lit("x"), 500_000).alias("p_name"), F.lit("b").alias("p_brand")).write.parquet(f"{tmp_path}/part.parquet")
    tracemalloc.start()
    folder, _ = flows._shards(catalog.Tables(spark, str(tmp_path)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 << 20, peak  # an archive is 4 MB
    got = {(r.path.rsplit("/", 1)[-1], r.member): r.error is None for r in A.read_shards(spark, A.index_shards(spark, folder)).select("path", "member", "error").collect()}
    assert len(got) == 128 and [k for k, whole in got.items() if not whole] == [("0.tar", "000000000.cls")]
