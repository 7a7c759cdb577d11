"""A minimal acyclic transducer: words to the token ids that they are encoded as.

States with the same right language are one state, so suffixes are shared. Every state knows how many
words can still be completed from it; the sum of those that are passed by on a word's path is its number,
and its ids lie at that number. The whole is a handful of integer arrays in one file that is memory-mapped.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np

MAGIC = b"LFLX0001"


def compile_lexicon(entries: Iterable[tuple[bytes, bytes]]) -> bytes:
    """The file's bytes for entries (word, ids as little-endian 32-bit integers), words distinct and not empty (incremental minimisation of sorted words)."""
    entries = sorted(entries)
    states: list[tuple[list[tuple[int, int]], bool]] = []
    register: dict[tuple, int] = {}
    path: list[list] = [[[], False]]  # the open path of the last word: (edges, final)
    last = b""

    def freeze(node) -> int:
        key = (tuple(node[0]), node[1])
        at = register.get(key)
        if at is None:
            at = register[key] = len(states)
            states.append((node[0], node[1]))
        return at

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            node = path.pop()
            path[-1][0].append((last[len(path) - 1], freeze(node)))

    for word, _ in entries:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        close(common)
        for _ in word[common:]:
            path.append([[], False])
        path[-1][1] = True
        last = word
    close(0)
    root = freeze(path[0])
    counts = np.zeros(len(states), dtype=np.int64)
    keys, targets, skipped = [], [], []
    for i, (edges, final) in enumerate(states):  # children come before parents
        n = int(final)
        for byte, to in edges:  # in the words' order
            keys.append(i * 256 + byte)
            targets.append(to)
            skipped.append(n)
            n += counts[to]
        counts[i] = n
    ids = b"".join(x for _, x in entries)
    ids += b"\0" * (-len(ids) % 8)
    ends = np.cumsum([len(x) for _, x in entries]) if entries else []
    final = [int(f) for _, f in states]
    arrays = [np.array(keys, np.int64), np.array(targets, np.int64), np.array(skipped, np.int64), np.array(final, np.int64), np.concatenate([[0], ends]).astype(np.int64), np.frombuffer(ids, np.int64)]
    head = MAGIC + struct.pack("<q", root) + struct.pack("<6q", *map(len, arrays))
    return head + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """Lookups in a compiled lexicon: a memory-mapped file, or the bytes themselves."""

    def __init__(self, source: str | bytes):
        raw = np.frombuffer(source, dtype=np.uint8) if isinstance(source, bytes) else np.memmap(source, dtype=np.uint8, mode="r")
        if raw[:8].tobytes() != MAGIC:
            raise ValueError("not a lexicon")
        self.root, *sizes = struct.unpack("<7q", raw[8:64].tobytes())
        at, arrays = 64, []
        for n in sizes:
            arrays.append(raw[at : at + 8 * n].view(np.int64))
            at += 8 * n
        self.keys, self.targets, self.skipped, self.final, ends, ids = arrays
        self.ends, self.ids = ends.tolist(), memoryview(ids.view(np.uint8))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 where it is not in the lexicon: all words advance byte by byte together."""
        n = len(words)
        out = np.full(n, -1, dtype=np.int64)
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        if not n or not len(self.keys):
            return out
        longest = min(int(lengths.max()), 256)  # no compiled word is longer
        starts = np.cumsum(lengths) - lengths
        text = np.frombuffer(b"".join(words), dtype=np.uint8)
        live = np.flatnonzero((lengths > 0) & (lengths <= longest))
        state, number = np.full(len(live), self.root, dtype=np.int64), np.zeros(len(live), dtype=np.int64)
        for k in range(longest):
            if not len(live):
                break
            key = state * 256 + text[starts[live] + k]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[i] == key
            live, i = live[ok], i[ok]
            state, number = self.targets[i], number[ok] + self.skipped[i]
            done = lengths[live] == k + 1
            hit = done & (self.final[state] == 1)
            out[live[hit]] = number[hit]
            live, state, number = live[~done], state[~done], number[~done]
        return out

    def output(self, number: int) -> bytes:
        return self.ids[self.ends[number] : self.ends[number + 1]].tobytes()
