"""A byte-pair tokenizer with word ends: lower-cased text, white space dropped, merges within words."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fix_length

END = "</w>"
PATTERN = regex.compile(r"<\|startoftext\|>|<\|endoftext\|>|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def byte_letters() -> list[str]:
    """A printable letter for each of the 256 bytes: bytes that print stand for themselves, the others come after 255 in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordTokens:
    """Encoding and decoding with the vocabulary and merges of a public tokenizer file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        self.ids: dict[str, int] = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.words = {i: t for t, i in self.ids.items()}
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"])
        self.ranks = {p: r for r, p in enumerate(pairs)}
        self.special = {t["content"] for t in spec["added_tokens"]}
        self.letters = byte_letters()
        self.bytes = {c: b for b, c in enumerate(self.letters)}
        self.word = lru_cache(maxsize=50_000)(self._word)

    def _word(self, word: str) -> tuple[int, ...]:
        if word in self.special:
            return (self.ids[word],)
        parts = [self.letters[b] for b in word.encode()]
        parts[-1] += END
        while len(parts) > 1:
            rank, i = min((self.ranks.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 30:
                break
            pair, out, k = (parts[i], parts[i + 1]), [], 0
            while k < len(parts):
                if tuple(parts[k : k + 2]) == pair:
                    out.append(pair[0] + pair[1])
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return tuple(self.ids[p] for p in parts)

    def encode(self, text: str) -> list[int]:
        """Ids of a text that is already clean; it is lower-cased here."""
        return [i for w in PATTERN.findall(text.lower()) for i in self.word(w)]

    def decode(self, ids: list[int]) -> str:
        """The words of ids with a blank after each."""
        return bytearray(self.bytes[c] for c in "".join(self.words[i] for i in ids).replace(END, self.letters[32]) if c in self.bytes).decode("utf-8", errors="replace")


def encode(df: DataFrame, key: str, text: Column | str, vocabulary_file: str) -> DataFrame:
    """(key, ids) of every row; a null text has no ids. The file is read on the driver and travels with the function."""
    with open(vocabulary_file, encoding="utf-8") as f:
        content = f.read()
    sent = df.sparkSession.sparkContext.broadcast(content)
    slim = df.select(F.col(key).alias("k"), F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens(sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tokens.encode(x) for x in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=[key, "ids"])

    return slim.mapInArrow(run, T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def fixed(df: DataFrame, key: str, text: Column | str, vocabulary_file: str, length: int = 77, start: int = 49406, end: int = 49407) -> DataFrame:
    """(key, ids): start, ids, end, cut or filled up with 0 to the length."""
    return encode(df, key, text, vocabulary_file).select(key, fix_length("ids", length, start, end).alias("ids"))
