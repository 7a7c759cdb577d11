"""Byte-level BPE encoding and decoding with a transducer lexicon of the corpus's frequent words and exact merges for the rest."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices as _blocks
from .common import bound_batches, give_back, materialise, release, shared_dir, tidy
from .lexicon import Lexicon, compile_lexicon

#: White space as the vocabulary's pattern sees it (the Unicode property).
WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The pattern of the public byte-level vocabulary.
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
#: Pieces that can be cut into the pattern's words one by one: no word goes over their borders.
COARSE = re.compile(rf" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]")
LONGEST_WORD = 256
_LONG_PIECE = re.compile(f"[^ ]{{{LONGEST_WORD + 1}}}")
NONE = np.iinfo(np.int32).max
_OTHER_ASCII = "\t\r\x0b\x0c"
_OTHER = _OTHER_ASCII + "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def plain_spacing(text: str) -> bool:
    """Whether white space is nothing but single blanks and line ends between other characters; then the text may be cut at its blanks."""
    if "  " in text or "\n " in text or " \n" in text or "\n\n" in text or text[:1].isspace() or text[-1:].isspace():
        return False
    return not any(c in text for c in (_OTHER_ASCII if text.isascii() else _OTHER))


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in the vocabulary file: bytes that print stand for themselves, the rest come after 255 in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes and merge ranks out of the text of a public tokenizer file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        letters = byte_alphabet()
        model = spec["model"]
        self.tokens: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t.encode() for t, i in self.special.items()}
        self._bytes = [self.tokens.get(i, b"") for i in range(max(self.tokens) + 1)]
        self.single = [0] * 256
        for t, i in model["vocab"].items():
            if len(t) == 1:
                self.single[letters[t]] = i
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[model["vocab"][a], model["vocab"][b]] = (rank, model["vocab"][a + b])
        pairs = sorted((a << 32 | b, r, i) for (a, b), (r, i) in self.ranks.items())
        self._keys = np.array([k for k, _, _ in pairs], dtype=np.int64)
        self._rank = np.array([r for _, r, _ in pairs], dtype=np.int32)
        self._made = np.zeros(max((r for _, r, _ in pairs), default=0) + 1, dtype=np.int32)
        self._made[self._rank] = [i for _, _, i in pairs]
        self._single = np.array(self.single, dtype=np.int32)

    def merge(self, word: bytes) -> list[int]:
        """Exact encoding of one word: always the pair of least rank, of equal ones the leftmost."""
        ids = [self.single[b] for b in word]
        if len(ids) > 48:
            return self._merge_long(ids)
        ranks, none = self.ranks, (1 << 30, -1)
        pairs = [ranks.get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best is none or best[1] < 0:
                break
            i = pairs.index(best)
            ids[i : i + 2] = [best[1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get((ids[i - 1], ids[i]), none)
            if i < len(pairs):
                pairs[i] = ranks.get((ids[i], ids[i + 1]), none)
        return ids

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs, NONE where a pair has none or is beyond the end (-1)."""
        key = a.astype(np.int64) << 32 | np.maximum(b, 0)
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((self._keys[at] == key) & (b >= 0) & (a >= 0), self._rank[at], NONE)

    def merge_batch(self, words: list[bytes]) -> list[bytes]:
        """merge() of many words, as little-endian 32-bit integers: each round makes the next merge of every word that has one."""
        out: list[bytes] = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            longest = max(8, len(words[order[at]]))
            if longest > 32:
                for i in order[at:]:
                    out[i] = array("I", self.merge(words[i])).tobytes()
                break
            longest, end = -(-longest // 8) * 8, at
            while end < len(order) and end - at < 20_000 and len(words[order[end]]) <= longest:
                end += 1
            part = np.array(order[at:end])
            at = end
            raw = np.frombuffer(b"".join(words[i].ljust(longest, b"\0") for i in part), dtype=np.uint8).reshape(len(part), longest)
            lengths = np.array([len(words[i]) for i in part])
            place = np.arange(longest)
            ids = np.where(place < lengths[:, None], self._single[raw], -1)
            ranks = np.full((len(part), longest), NONE, dtype=np.int32)
            ranks[:, :-1] = self._ranks(ids[:, :-1], ids[:, 1:])
            while len(part):
                i = ranks.argmin(axis=1)
                rows = np.arange(len(part))
                least = ranks[rows, i]
                done = least == NONE
                if done.any():
                    for k in np.flatnonzero(done).tolist():
                        out[part[k]] = ids[k, : lengths[k]].astype("<u4").tobytes()
                    go = ~done
                    part, ids, ranks, lengths, i, least = part[go], ids[go], ranks[go], lengths[go], i[go], least[go]
                    rows = rows[: len(part)]
                    if not len(part):
                        break
                ids[rows, i] = self._made[least]
                shift = np.minimum(place + (place > i[:, None]), longest - 1)
                ids, ranks = np.take_along_axis(ids, shift, 1), np.take_along_axis(ranks, np.minimum(place + (place >= i[:, None]), longest - 1), 1)
                lengths = lengths - 1
                ids[rows, lengths] = -1
                after = np.where(i + 1 < longest, ids[rows, np.minimum(i + 1, longest - 1)], -1)
                ranks[rows, i] = self._ranks(ids[rows, i], after)
                ranks[:, -1] = NONE
                left = i > 0
                ranks[rows[left], i[left] - 1] = self._ranks(ids[rows[left], i[left] - 1], ids[rows[left], i[left]])
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same over linked arrays and a heap, n log n for a word of any length. An entry holds rank and place; it counts if the pair there still has that rank."""
        n, ranks = len(ids), self.ranks
        ids = array("i", ids)
        left, right = array("i", range(-1, n - 1)), array("i", [*range(1, n), -1])
        heap = [r[0] << 32 | i for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            i = entry & 0xFFFFFFFF
            j = right[i]
            if ids[i] < 0 or j < 0:
                continue
            made = ranks.get((ids[i], ids[j]))
            if made is None or made[0] != entry >> 32:
                continue
            ids[i], ids[j] = made[1], -1
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if r := ranks.get((made[1], ids[k])):
                    heapq.heappush(heap, r[0] << 32 | i)
            h = left[i]
            if h >= 0 and (r := ranks.get((ids[h], made[1]))):
                heapq.heappush(heap, r[0] << 32 | h)
        return [i for i in ids if i >= 0]


class Encoder:
    """Encoding of texts in one process: pieces are looked up in a cache of bounded bytes, then word by word in the lexicon, then merged."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None, cache: int = 40 << 20):
        self.v, self.lexicon, self.size, self.held = vocabulary, lexicon, cache, 0
        self.spaced: dict[str, bytes] = {}  # pieces with a space before them, kept without it
        self.plain: dict[str, bytes] = {}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None

    def _resolve(self, pieces: list[str], before: str) -> dict[str, bytes]:
        """Ids of pieces as little-endian 32-bit integers, `before` being put before each. Letters alone are one word; all else is cut by the pattern."""
        alone = [p for p in pieces if p.isalpha()]
        cut = [(p, PATTERN.findall(before + p)) for p in pieces if not p.isalpha()]
        distinct = {before + p for p in alone}
        for _, ws in cut:
            distinct.update(ws)
        words = list(distinct)
        raw = [w.encode() for w in words]
        if self.lexicon:
            numbers, output = self.lexicon.numbers(raw).tolist(), self.lexicon.output
            ids = {w: output(k) for w, k in zip(words, numbers, strict=True) if k >= 0}
            unseen = [i for i, k in enumerate(numbers) if k < 0]
        else:
            ids, unseen = {}, range(len(words))
        ids.update(zip((words[i] for i in unseen), self.v.merge_batch([raw[i] for i in unseen]), strict=True))
        out = {p: ids[before + p] for p in alone}
        out.update((p, b"".join([ids[w] for w in ws])) for p, ws in cut)
        return out

    def _fill(self, known: dict[str, bytes], pieces: set[str], before: str) -> list[str]:
        """Put pieces into the cache; those that are too long to stay there for other texts."""
        new = self._resolve([p for p in pieces if p not in known], before)
        known.update(new)
        # a string, its bytes and their places in the table take some 200 bytes besides
        self.held += len("".join(new)) + len(b"".join(new.values())) + 200 * len(new)
        return [p for p in new if len(p) > LONGEST_WORD]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        if self.held > self.size:
            self.spaced.clear()
            self.plain.clear()
            self.held = 0
        spaced: set[str] = set()
        plain: set[str] = set()
        work = []
        for text in texts:
            parts = []
            for part in self.split.split(text) if self.split and any(s in text for s in self.v.special) else [text]:
                if part in self.v.special:
                    parts.append((None, array("I", [self.v.special[part]]).tobytes()))
                elif part and plain_spacing(part):
                    pieces = part.split(" ")
                    plain.add(pieces[0])
                    parts.append((pieces[0], pieces[1:]))
                    spaced.update(parts[-1][1])
                elif part:
                    pieces = COARSE.findall(part)
                    plain.update(pieces)
                    parts.append(("", pieces))
            work.append(parts)
        long = [(known, p) for known, pieces, before in ((self.spaced, spaced, " "), (self.plain, plain, "")) for p in self._fill(known, pieces, before)]
        out, get, get_plain = [], self.spaced.__getitem__, self.plain.__getitem__
        for parts in work:
            done = []
            for head, rest in parts:
                if head is None:
                    done.append(rest)
                elif head:
                    done.append(get_plain(head))
                    done.extend(map(get, rest))
                else:
                    done.extend(map(get_plain, rest))
            out.append(b"".join(done))
        for known, p in long:
            self.held -= len(p) + len(known.pop(p)) + 200
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.v._bytes.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", errors="replace")


def _short_pieces(text: str) -> list[str]:
    """What stands between blanks, without pieces longer than any word of a lexicon."""
    pieces = text.split(" ")
    return [p for p in pieces if len(p) <= LONGEST_WORD] if _LONG_PIECE.search(text) else pieces


def piece_counts(df: DataFrame, text_col: str = "text", held: int = 48 << 20) -> DataFrame:
    """(piece, n) over all texts: what stands between blanks, counted within each task's batches, then summed by piece. A task holds about `held` bytes of counts."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([p.encode() for p in counts], pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["piece", "n"])
            counts.clear()
            return out

        size = 0  # of the texts since the last look at the counts
        for b in batches:
            for text in (t for part in range(0, b.num_rows, 256) for t in b.column(0).slice(part, 256).to_pylist()):
                counts.update(_short_pieces(text))
                size += len(text)
                if size > 1 << 20:
                    size = 0
                    if len(counts) > 200_000 or (len(counts) > 20_000 and 160 * len(counts) + sum(map(len, counts)) > held):
                        yield rows()
        if counts:
            yield rows()

    slim = df.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    return slim.mapInArrow(run, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def build_lexicon(df: DataFrame, vocabulary: Vocabulary, text_col: str = "text", pieces: int = 196_608, words: int = 98_304) -> bytes:
    """The compiled lexicon of the pattern's most frequent words within the corpus's most frequent pieces.

    A histogram of counts (a row for each sixteenth of a power of two) says from where on at most `pieces` pieces are left;
    no more come to the driver, whatever the corpus's size. What the lexicon holds only decides how fast
    a word is encoded, not how.
    """
    counted = materialise(piece_counts(df, text_col).where(F.length("piece") <= LONGEST_WORD).withColumn("size", F.floor(16 * F.log2("n")).cast("int")), "pieces")
    least, left = 1 << 30, pieces
    for r in sorted(counted.groupBy("size").agg(F.count("*").alias("k")).collect(), reverse=True):
        if r["k"] > left:
            break
        least, left = r["size"], left - r["k"]
    top = counted.where(F.col("size") >= least).select("piece", "n").toArrow()
    release(counted)
    counts: Counter = Counter()
    for b in top.to_batches(max_chunksize=10_000):
        for piece, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for w in PATTERN.findall(" " + piece.decode()):
                counts[w.encode()] += n
    del top
    chosen = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:words] if len(w) <= LONGEST_WORD]
    del counts
    data = compile_lexicon(zip(chosen, vocabulary.merge_batch(chosen), strict=True))
    give_back()
    return data


def _publish(df: DataFrame, data: bytes) -> str:
    """Put the lexicon into the shared folder and hand it to every executor; the name under which they find it."""
    spark = df.sparkSession
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:20]}.bin"
    path = f"{shared_dir(spark)}/lumenforge/{spark.sparkContext.applicationId}/{name}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        out = fs.create(p)
        out.write(bytearray(data))
        out.close()
    spark.sparkContext.addFile(path)
    return name


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(content: str, name: str) -> Encoder:
    """This worker's encoder, kept from task to task."""
    key = (hashlib.sha256(content.encode()).hexdigest(), name)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Vocabulary(content), Lexicon(SparkFiles.get(name)))
    return _ENCODERS[key]


def encode_documents(df: DataFrame, vocabulary_file: str, id_col: str = "doc_id", text_col: str = "text", words: int = 98_304, with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every row; ids as little-endian 32-bit integers.

    A null text counts as empty: no tokens. Ids of rows may be null or repeated, each row has its own result; other columns,
    whatever their names, are not looked at; an empty table gives no rows. Texts and words of any length are encoded whole, and
    pieces too long for a lexicon are neither counted nor kept; of pairs of equal rank the leftmost is merged first. Two passes over the texts: one counts words (shuffled once, by
    word), one encodes, decodes again from the ids, and shuffles nothing. The vocabulary file is read on
    the driver and travels as a broadcast; the lexicon is memory-mapped by every worker.
    """
    bound_batches(df.sparkSession)
    with open(vocabulary_file, encoding="utf-8") as f:
        content = f.read()
    name = _publish(df, build_lexicon(df, Vocabulary(content), text_col, words=words))
    sent = df.sparkSession.sparkContext.broadcast(content)
    kind = df.schema[id_col].dataType
    slim = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    fields = [T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    schema = T.StructType(fields)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value, name)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            for start, end in _blocks(b.column(1)):
                ids = encoder.encode_batch(b.column(1).slice(start, end - start).to_pylist())
                columns = [b.column(0).slice(start, end - start), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array([sha(encoder.decode(x).encode()) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.binary())] if with_ids else []), names=schema.names)

    return slim.mapInArrow(run, schema)
