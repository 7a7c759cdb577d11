"""Word shingle sets and their MinHash signatures, computed over whole Arrow batches in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = np.ones(1 << 12, dtype=np.uint64)
with np.errstate(over="ignore"):
    for _i in range(1, len(_POWERS)):
        _POWERS[_i] = _POWERS[_i - 1] * _R
    _STEP = _POWERS[-1] * _R


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(at: np.ndarray) -> np.ndarray:
    """_R ** at, wrapping."""
    low = _POWERS[at & 4095]
    high = at >> 12
    if not high.any():
        return low
    with np.errstate(over="ignore"):
        out = low.copy()
        for k in np.unique(high[high > 0]):
            f = np.uint64(pow(int(_STEP), int(k), 1 << 64))
            out[high == k] *= f
        return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words in order, number of words of each text); A-Z count as a-z, words end at ASCII white space."""
    if pa.types.is_large_string(texts.type):
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    else:
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    n = int(offsets[-1] - offsets[0])
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = solid[begins]  # a word ends with its text
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    at = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))[-n:] if starts[0] == 0 else np.concatenate([np.zeros(starts[0], np.int64), np.arange(starts[0], n) - np.repeat(starts, np.diff(np.append(starts, n)))])
    with np.errstate(over="ignore"):
        terms = (_LOWER[data].astype(np.uint64) + np.uint64(1)) * _powers(at)
        terms[~solid] = 0
        hashes = mix(np.add.reduceat(terms, starts))
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return hashes, counts


def shingle_sets(texts: pa.Array, k: int = 2) -> list[np.ndarray]:
    """Each text's set of k-word shingles as sorted distinct 64-bit hashes; with fewer words the whole sequence is the one shingle; without words the set is empty."""
    words, counts = word_hashes(texts)
    out, at = [], 0
    with np.errstate(over="ignore"):
        for n in counts.tolist():
            w = words[at : at + n]
            at += n
            if n == 0:
                out.append(np.zeros(0, np.uint64))
                continue
            m = min(k, n)
            h = np.full(n - m + 1, np.uint64(m), dtype=np.uint64)
            for j in range(m):
                h = mix(h * np.uint64(0x9DDFEA08EB382D69) + w[j : n - m + 1 + j])
            out.append(np.unique(h))
    return out


class MinHash:
    """Signatures of `size` permutations of 32-bit hashes; permutation i takes h to h * a[i] + b[i], wrapping."""

    def __init__(self, size: int, seed: int = 11):
        r = np.random.default_rng(seed)
        self.a = (r.integers(0, 1 << 31, size, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.b = r.integers(0, 1 << 32, size, dtype=np.uint32)
        self.size = size

    def signatures(self, sets: list[np.ndarray], block: int = 1 << 14) -> np.ndarray:
        """[set, permutation]; rows of empty sets are all ones."""
        out = np.full((len(sets), self.size), 0xFFFFFFFF, dtype=np.uint32)
        full = [i for i, s in enumerate(sets) if len(s)]
        i = 0
        while i < len(full):
            j, n = i, 0
            while j < len(full) and (j == i or n + len(sets[full[j]]) <= block):
                n += len(sets[full[j]])
                j += 1
            part = full[i:j]
            h64 = np.concatenate([sets[p] for p in part])
            h = (h64 ^ (h64 >> np.uint64(32))).astype(np.uint32)
            starts = np.concatenate([[0], np.cumsum([len(sets[p]) for p in part])[:-1]])
            sig = np.empty((len(part), self.size), dtype=np.uint32)
            v = np.empty_like(h)
            for k in range(self.size):
                np.multiply(h, self.a[k], out=v)
                v += self.b[k]
                sig[:, k] = np.minimum.reduceat(v, starts)
            out[part] = sig
            i = j
        return out
