"""A linear-chain conditional random field over token features, in numpy: training by gradient ascent, decoding by Viterbi in batches."""

from __future__ import annotations

import numpy as np


class LinearChainCRF:
    """Emission weights (feature, label) and transition weights (label, label); sequences are arrays [token, feature slot] of feature ids."""

    def __init__(self, n_features: int, n_labels: int):
        self.emit = np.zeros((n_features, n_labels))
        self.move = np.zeros((n_labels, n_labels))
        self.start = np.zeros(n_labels)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.emit[x].sum(axis=-2)

    def _forward_backward(self, e: np.ndarray, lengths: np.ndarray):
        """Log sums up to and after each token, and over all labellings, of a padded batch e [sequence, token, label]."""
        n, t, k = e.shape
        a, b = np.empty((n, t, k)), np.zeros((n, t, k))
        a[:, 0] = self.start + e[:, 0]
        for i in range(1, t):
            a[:, i] = e[:, i] + _lse(a[:, i - 1, :, None] + self.move, 1)
        for i in range(t - 2, -1, -1):
            inside = (i + 1 < lengths)[:, None]
            b[:, i] = np.where(inside, _lse(self.move + (e[:, i + 1] + b[:, i + 1])[:, None, :], 2), 0.0)
        z = _lse(a[np.arange(n), lengths - 1], 1)
        return a, b, z

    def fit(self, sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 60, rate: float = 0.5, decay: float = 0.02) -> LinearChainCRF:
        """Batch gradient ascent on the regularised log likelihood, steps scaled per weight by past gradients (Adagrad). Sequences of like length are padded together."""
        params = [self.emit, self.move, self.start]
        past = [np.full_like(p, 1e-6) for p in params]
        order = sorted(sequences, key=lambda s: len(s[1]))
        groups, at = [], 0
        while at < len(order):
            longest = max(8, 2 * len(order[at][1]))
            end = at
            while end < len(order) and len(order[end][1]) <= longest:
                end += 1
            groups.append(self._padded(order[at:end]))
            at = end
        for _ in range(rounds):
            grads = [-decay * p for p in params]
            for x, lengths, inside, gold, moves in groups:
                follows = inside[:, 1:]
                e = np.zeros_like(gold)
                e[inside] = self.scores(x)
                a, b, z = self._forward_backward(e, lengths)
                diff = gold - np.exp(a + b - z[:, None, None])
                flat, d = x.ravel(), np.repeat(diff[inside], x.shape[1], axis=0)
                for k in range(d.shape[1]):
                    grads[0][:, k] += np.bincount(flat, d[:, k], minlength=len(grads[0]))
                grads[2] += diff[:, 0].sum(0)
                pair = (a[:, :-1, :, None] + self.move + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None])[follows]
                grads[1] += moves - np.exp(pair).sum(0)
            for p, g, s in zip(params, grads, past, strict=True):
                s += g * g
                p += rate * g / np.sqrt(s)
        return self

    def _padded(self, sequences: list[tuple[np.ndarray, np.ndarray]]):
        """(features of all tokens, lengths, which cells are tokens, labels as ones, counts of label pairs)."""
        lengths = np.array([len(y) for _, y in sequences])
        inside = np.arange(lengths.max()) < lengths[:, None]
        gold = np.zeros((*inside.shape, len(self.start)))
        gold[inside] = np.eye(len(self.start))[np.concatenate([y for _, y in sequences])]
        return np.concatenate([x for x, _ in sequences]), lengths, inside, gold, np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])

    def decode(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Viterbi over a padded batch: e [sequence, token, label] -> labels [sequence, token]; padding gets label 0."""
        n, t, k = e.shape
        back = np.zeros((n, t, k), dtype=np.int8)
        v = self.start + e[:, 0]
        for i in range(1, t):
            s = v[:, :, None] + self.move[None]
            back[:, i] = s.argmax(1)
            new = s.max(1) + e[:, i]
            v = np.where((i < lengths)[:, None], new, v)
        out = np.zeros((n, t), dtype=np.int8)
        last = v.argmax(1)
        rows = np.arange(n)
        for i in range(t - 1, -1, -1):
            inside = i < lengths
            out[inside, i] = last[inside]
            last = np.where(inside, back[rows, i, last], last) if i else last
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)
