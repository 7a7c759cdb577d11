"""OpenEXR blocks, archives that can't be read, image sets, and texts that were read wrongly."""

from __future__ import annotations

import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenforge.functions import text as X
from lumenforge.plans import files
from lumenforge.sources import exr, image_sets
from lumenforge.sources import readers as R


def test_exr_blocks():
    a = (np.arange(37 * 9).reshape(37, 9) % 11 / 4).tolist()
    for packed in (False, True):
        assert exr.read_exr(files._exr(a, packed))["Z"].tolist() == a
    assert exr._runs(bytes([2, 65, 254, 66, 67, 0, 68])) == b"AAABCD"
    with pytest.raises(ValueError, match="no OpenEXR"):
        exr.read_exr(b"\0" * 64)
    raw = bytearray(files._exr([[1.0, 2.0]], False))
    raw[4:8] = struct.pack("<I", 2 | 0x200)
    with pytest.raises(ValueError, match="tiled"):
        exr.read_exr(bytes(raw))


def test_broken_archives_give_their_error(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as z:
        z.writestr("a/b.txt", "hi")
        z.writestr("c.tar.gz", "x")
    (tmp_path / "bad.zip").write_bytes(b"PK no")
    (tmp_path / "bad.gz").write_bytes(b"no")
    rows = R.zip_members(spark, str(tmp_path)).collect()
    assert sorted((r["member"], r["key"], r["ext"], bytes(r["content"])) for r in rows if r["error"] is None) == [("a/b.txt", "b", "txt", b"hi"), ("c.tar.gz", "c", "tar.gz", b"x")]
    assert sum(r["error"] is not None for r in rows) == 1
    assert R.zip_members(spark, str(tmp_path), "*.gz").first()["error"]


def test_image_sets_have_names():
    assert image_sets.image_set("ade20k_full_sem_seg_val").ignore == 65535
    assert "annotations_mine" in image_sets.image_set("coco_2017_test_stuff_10k_sem_seg", "mine").labels
    with pytest.raises(KeyError):
        image_sets.image_set("none")


def test_wrongly_read_text(spark):
    rows = [("cafÃ© &amp;lt;b&gt; &#x41;&frac12;", "café <b> a½"), ("Ã alone", "ã alone"), ("naïve café", "naïve café"), ("", ""), (None, None), (" A  B ", "a b")]
    d = spark.createDataFrame(rows, "t string, want string").select(X.clean_any_text("t").alias("got"), F.col("want"))
    assert all(r["got"] == r["want"] for r in d.collect())
