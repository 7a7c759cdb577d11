"""Depth maps in OpenEXR files: scan lines of half, float or whole numbers, uncompressed, run-length coded or deflated."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MAGIC = 20000630
_KINDS = {0: np.dtype("<u4"), 1: np.dtype("<f2"), 2: np.dtype("<f4")}
#: Compression by its number in the file: lines of a block.
_LINES = {0: 1, 1: 1, 2: 1, 3: 16}


def _attributes(raw: bytes) -> tuple[dict[str, bytes], int]:
    """(the header's attributes, where it ends)."""
    magic, version = struct.unpack_from("<II", raw)
    if magic != MAGIC:
        raise ValueError("no OpenEXR file")
    if version & 0x1A00:
        raise ValueError("tiled, deep and multi-part files are not read")
    out, at = {}, 8
    while raw[at]:
        name, kind_at = raw[at : raw.index(b"\0", at)].decode(), raw.index(b"\0", at) + 1
        size_at = raw.index(b"\0", kind_at) + 1
        (size,) = struct.unpack_from("<i", raw, size_at)
        out[name] = raw[size_at + 4 : size_at + 4 + size]
        at = size_at + 4 + size
    return out, at + 1


def _runs(data: bytes) -> bytes:
    """Run-length coding undone: a count below zero says how many bytes follow as they are, another how often the next one comes, less one."""
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i] - 256 if data[i] > 127 else data[i]
        if n < 0:
            out += data[i + 1 : i + 1 - n]
            i += 1 - n
        else:
            out += data[i + 1 : i + 2] * (n + 1)
            i += 2
    return bytes(out)


def _unfiltered(data: bytes) -> bytes:
    """Differences summed up, then the two halves put together byte by byte."""
    d = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    d[1:] -= 128
    d = (np.cumsum(d) & 255).astype(np.uint8)
    out, half = np.empty_like(d), (len(d) + 1) // 2
    out[0::2], out[1::2] = d[:half], d[half:]
    return out.tobytes()


def read_exr(raw: bytes) -> dict[str, np.ndarray]:
    """Channels by name, height x width each."""
    head, at = _attributes(raw)
    x0, y0, x1, y1 = struct.unpack("<4i", head["dataWindow"])
    width, height, packing = x1 - x0 + 1, y1 - y0 + 1, head["compression"][0]
    if packing not in _LINES:
        raise ValueError(f"compression {packing} is not read")
    channels, c = [], head["channels"]
    i = 0
    while c[i]:
        end = c.index(b"\0", i)
        kind, _, sx, sy = struct.unpack_from("<iiii", c, end + 1)
        if (sx, sy) != (1, 1):
            raise ValueError("subsampled channels are not read")
        channels.append((c[i:end].decode(), _KINDS[kind]))
        i = end + 17
    out = {name: np.zeros((height, width), dtype=kind) for name, kind in channels}
    line = sum(kind.itemsize for _, kind in channels) * width
    n = -(-height // _LINES[packing])
    for offset in struct.unpack_from(f"<{n}Q", raw, at):
        y, size = struct.unpack_from("<ii", raw, offset)
        lines = min(_LINES[packing], y1 - y + 1)
        data = raw[offset + 8 : offset + 8 + size]
        if packing and size < line * lines:  # a block that packing would not make smaller is left as it is
            data = _unfiltered(_runs(data) if packing == 1 else zlib.decompress(data))
        p = 0
        for k in range(y - y0, y - y0 + lines):
            for name, kind in channels:
                out[name][k] = np.frombuffer(data, dtype=kind, count=width, offset=p)
                p += kind.itemsize * width
    return out


def depth_maps(spark: SparkSession, path: str, channel: str | None = None, pattern: str = "*.exr") -> DataFrame:
    """(path, shape, values) of one channel, the first by name if none is asked for, in the form that readers.pixels() takes."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [read_exr(x) for x in b.content]
            maps = [m[channel] if channel else m[min(m)] for m in found]
            yield pd.DataFrame({"path": b.path, "shape": [list(m.shape) for m in maps], "values": [m.astype(np.float64).ravel() for m in maps]})

    return d.mapInPandas(decode, "path string, shape array<int>, values array<double>")
