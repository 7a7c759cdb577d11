"""WARC archives in seekable Zstandard bundles: independent frames of records, a footer with a seek table, records found by id.

A task writes its records into frames of about FRAME bytes and its frames into bundles of about BUNDLE bytes, files in the shared
folder, and returns where each record stands: bundle, frame, place in the frame. A bundle ends with the seek table of the
Zstandard seekable format, so any reader of it can jump to a frame, and any reader of plain Zstandard reads the whole. A task writes under a
name of its own and tells only at its end, so what a lost task has written is never read. Reading deals frames, not bundles, over tasks.

Of records with equal payloads of LEAST bytes and more, the one with the largest page_id is a response and the others are revisits of it, which
hold no payload. Defined results: a null html is an empty payload; a null url has no target line; rows without an id are records too, in a
group with ids they revisit; if several rows share the largest id (or none has one), each is a response with its payload. Record ids are page ids; of rows that share one, a
search finds all. Very long payloads make frames of their own. An empty table makes no bundle. Further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import bound_batches, make_folder, materialise, scratch
from .common import byte_slices, sized, tidy

LEAST = 1000
FRAME, BUNDLE = 1 << 20, 128 << 20
#: The seekable format: a skippable frame that ends in the number of frames, a descriptor and a magic number (fixed values).
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"

INDEX = "page_id long, record_type string, bundle string, frame int, frame_at long, frame_size long, at long, size long"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, length: int, refers_to: int | None) -> bytes:
    """One WARC 1.1 record. payload None: a revisit of refers_to, whose full payload has that digest and length."""
    kind = "response" if payload is not None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Payload-Length: {length}",
    ]
    if url is not None:
        plain = url.isprintable()
        head.append(f"WARC-Target-URI: {url if plain else urllib.parse.quote(url)}")
        head += ["X-Target-Quoted: 1"] * (not plain)
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that begins at `at`, as a dict of RECORDS, and where the next one begins. ValueError if it isn't whole or its digest is wrong."""
    end = data.find(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n") if end >= 0 else [""]
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    head = dict(x.split(": ", 1) for x in lines[1:])
    n = int(head["Content-Length"])
    block = data[end + 4 : end + 4 + n]
    if len(block) < n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} is cut short")
    named = lambda x: int(x[len("<urn:page:") : -1]) if len(x) > len("<urn:page:>") else None
    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    out = {"page_id": named(head["WARC-Record-ID"]), "url": None, "record_type": head["WARC-Type"], "payload_bytes": int(head["X-Payload-Length"]), "payload_digest": digest, "refers_to": None, "payload": None}
    if "WARC-Target-URI" in head:
        out["url"] = urllib.parse.unquote(head["WARC-Target-URI"]) if "X-Target-Quoted" in head else head["WARC-Target-URI"]
    if out["record_type"] == "revisit":
        out["refers_to"] = named(head["WARC-Refers-To"])
    else:
        out["payload"] = payload = block[block.index(b"\r\n\r\n") + 4 :]
        out["payload_bytes"], out["payload_digest"] = len(payload), hashlib.sha1(payload).hexdigest()
        if out["payload_digest"] != digest:
            raise ValueError(f"the payload at {at} doesn't have the digest that its record states")
    return out, end + 8 + n


class BundleWriter:
    """Frames, one after another, into files of a folder; a file is closed with its seek table once it has BUNDLE bytes."""

    def __init__(self, folder: str, frame: int, bundle: int, level: int = 3) -> None:
        self.fs, self.folder = _open(folder)
        self.uri, self.frame, self.bundle = folder, frame, bundle
        self.compressor = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.file, self.pending, self.held = None, [], 0

    def add(self, page_id: int | None, kind: str, data: bytes) -> Iterator[tuple]:
        self.pending.append((page_id, kind, data))
        self.held += len(data)
        if self.held >= self.frame:
            yield from self._flush()

    def _flush(self) -> Iterator[tuple]:
        if not self.pending:
            return
        if self.file is None:
            self.name = f"{uuid.uuid4().hex}.warc.zst"
            self.file, self.table, self.at = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None), [], 0
        packed = self.compressor.compress(b"".join(x for _, _, x in self.pending))
        self.file.write(packed)
        at = 0
        for page_id, kind, data in self.pending:
            yield page_id, kind, f"{self.uri}/{self.name}", len(self.table), self.at, len(packed), at, len(data)
            at += len(data)
        self.table.append((len(packed), at))
        self.at += len(packed)
        self.pending, self.held = [], 0
        if self.at >= self.bundle:
            self._end()

    def _end(self) -> None:
        if self.file is not None:
            self.file.write(seek_table(self.table))
            self.file.close()
            self.file = None

    def close(self) -> Iterator[tuple]:
        yield from self._flush()
        self._end()


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer: compressed and plain size of each frame, without checksums."""
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file: pa.NativeFile, size: int) -> list[tuple[int, int, int]]:
    """(at, compressed size, plain size) of each frame, from the end of an open bundle."""
    if size < 17:
        raise ValueError("too short for a seek table")
    n, descriptor, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    entry = 12 if descriptor & 0x80 else 8
    if magic != SEEKABLE or descriptor & 0x7C or size < 17 + n * entry:
        raise ValueError("no seek table")
    body = file.read_at(n * entry, size - 9 - n * entry)
    out, at = [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", body, i * entry)
        out.append((at, packed, plain))
        at += packed
    return out


def with_roles(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, refers_to): refers_to is null for responses.

    Digests meet, not texts: counts by digest are added up before they move, and only digests that several rows share come back.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    p = p.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha1(F.encode("html", "utf-8"))})
    large = p.where(F.col("payload_bytes") >= least)
    shared = large.groupBy("payload_digest").agg(F.max("page_id").alias("leader"), F.count("*").alias("k")).where("k > 1").select("payload_digest", "leader", F.lit(least).cast("long").alias("least"))
    shared = sized(materialise(shared, "warc-shared"))
    joined = p.join(shared, (p["payload_digest"] == shared["payload_digest"]) & (p["payload_bytes"] >= shared["least"]), "left")
    refers: Column = F.when(shared["leader"].isNotNull() & ~p["page_id"].eqNullSafe(shared["leader"]), shared["leader"])
    return joined.select(*[p[c] for c in p.columns], refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, frame: int = FRAME, bundle: int = BUNDLE) -> DataFrame:
    """Write pages as bundles into folder, which executors share; the index: where each record stands (INDEX), as a table in the shared folder."""
    spark = pages.sparkSession
    bound_batches(spark)
    folder = make_folder(spark, folder)
    rows = with_roles(pages, least)
    rows = rows.withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter(folder, frame, bundle)
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("frame_at", pa.int64()), ("frame_size", pa.int64()), ("at", pa.int64()), ("size", pa.int64())])
        packed = lambda found: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)
        for b in batches:
            html = b.column(2)
            for start, end in byte_slices(html):
                found = []
                for page_id, url, text, length, digest, refers_to in zip(*[c.slice(start, end - start).to_pylist() for c in b.columns], strict=True):
                    payload = None if text is None else text.encode("utf-8", "surrogatepass")
                    found += writer.add(page_id, "revisit" if payload is None else "response", record(page_id, url, payload, digest, length, refers_to))
                if found:
                    yield packed(found)
        found = list(writer.close())
        if found:
            yield packed(found)

    return materialise(rows.mapInArrow(run, INDEX), "warc-index")


def _frames(bundles: DataFrame) -> DataFrame:
    """(bundle, frame, frame_at, frame_size) of whole bundles, from their seek tables alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = _open(path)
                with fs.open_input_file(at) as f:
                    t = read_seek_table(f, f.size())
                yield pa.record_batch([pa.array([path] * len(t)), pa.array(range(len(t)), pa.int32()), pa.array([x[0] for x in t], pa.int64()), pa.array([x[1] for x in t], pa.int64())], names=["bundle", "frame", "frame_at", "frame_size"])

    return bundles.select("bundle").mapInArrow(run, "bundle string, frame int, frame_at long, frame_size long")


_RECORD_TYPES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _parsed(frames: DataFrame, payloads: bool, wanted: bool) -> DataFrame:
    """The records of frames; with `wanted`, those at the places in the array `places` only."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor()
        path = file = None
        for b in batches:
            for row in b.to_pylist():
                if row["bundle"] != path:
                    if file is not None:
                        file.close()
                    fs, at = _open(path := row["bundle"])
                    file = fs.open_input_file(at)
                data = plain.decompress(file.read_at(row["frame_size"], row["frame_at"]))
                found, at = [], 0
                for at in row["places"] if wanted else ():
                    found.append(parse(data, at)[0])
                while not wanted and at < len(data):
                    one, at = parse(data, at)
                    found.append(one if payloads else one | {"payload": None})
                yield pa.RecordBatch.from_pylist(found, schema=_RECORD_TYPES)
        if file is not None:
            file.close()

    columns = ["bundle", "frame_at", "frame_size", *["places"] * wanted]
    return frames.select(*columns).mapInArrow(run, RECORDS)


def _dealt(frames: DataFrame) -> DataFrame:
    """Frames over as many tasks as their bytes want; their rows are small, and would else be gathered into one."""
    total = frames.agg(F.sum("frame_size")).first()[0] or 0
    n = max(int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // (32 << 20) + 1)
    return frames.repartition(n, "bundle", "frame_at").sortWithinPartitions("bundle", "frame_at")


def read_archives(bundles: DataFrame, payloads: bool = True) -> DataFrame:
    """All records (RECORDS) of the bundles named in column bundle; digests and lengths of responses are those of what was read."""
    frames = _frames(bundles.select("bundle").distinct())
    return _parsed(_dealt(frames), payloads, False)


def fetch(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The records whose page_id is in ids, by the index: only their frames are read, each once, whatever number of them it holds."""
    want = ids.select("page_id").where("page_id is not null").distinct()
    places = index.join(want, "page_id", "left_semi").groupBy("bundle", "frame_at", "frame_size").agg(F.collect_list("at").alias("places"))
    return _parsed(_dealt(places), True, True)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as they come back from archives written for the purpose."""
    index = write_archives(pages, scratch(pages.sparkSession, "warc"))
    back = read_archives(index.select("bundle").distinct(), payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
