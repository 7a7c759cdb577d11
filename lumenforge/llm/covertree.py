"""A cover tree over unit vectors and the dual traversal that finds all pairs within a distance."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: A node of so few vectors is compared one by one instead of being split further.
LEAF = 32
_CHUNK = 512


class Tree:
    """Nested levels whose radii halve: at the level of radius r every vector lies within r of its node's centre, centres of
    one node's children lie more than r apart, and a node's centre is the centre of its first child.

    A node has as many children as that takes. Members are row numbers, permuted so that every node's are contiguous;
    `radius` is the largest distance of a member to the centre, which prunes at least as much as the level's own.
    """

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.arange(len(x))
        self.begin, self.end, self.centre, self.radius = [0], [len(x)], [0], [0.0]
        self.kids: list[tuple[int, int]] = [(0, 0)]
        self.level = [2.0]
        if not len(x):
            return
        self.radius[0] = float(_distance(self.x[:1], x).max())
        at = 0
        while at < len(self.begin):
            self._split(at)
            at += 1
        self.centres = x[np.array(self.centre)]
        self.radii = np.array(self.radius)

    def _split(self, node: int) -> None:
        lo, hi, r = self.begin[node], self.end[node], self.level[node]
        if hi - lo <= LEAF or self.radius[node] <= 1e-7:
            return
        while r >= self.radius[node]:  # levels at which the node would have one child
            r /= 2
        rows = self.order[lo:hi]
        rows = np.concatenate([[self.centre[node]], rows[rows != self.centre[node]]])
        x = self.x[rows]
        centres = _net(x, r)
        owner, far = _nearest(x, centres)
        sizes = np.bincount(owner, minlength=len(centres))
        by = np.argsort(owner, kind="stable")
        self.order[lo:hi] = rows[by]
        radius = np.zeros(len(centres))
        np.maximum.at(radius, owner, far)
        self.kids[node] = (len(self.begin), len(self.begin) + len(centres))
        ends = lo + np.cumsum(sizes)
        self.begin += (ends - sizes).tolist()
        self.end += ends.tolist()
        self.centre += rows[centres].tolist()
        self.radius += radius.tolist()
        self.level += [r] * len(centres)
        self.kids += [(0, 0)] * len(centres)

    def members(self, node: int) -> np.ndarray:
        return self.order[self.begin[node] : self.end[node]]


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _net(x: np.ndarray, r: float) -> np.ndarray:
    """Rows of x, the first among them, that lie more than r apart and within r of all others."""
    least = 1.0 - r * r / 2.0  # cosine at distance r
    out: list[int] = []
    for s in range(0, len(x), _CHUNK):
        part = x[s : s + _CHUNK]
        free = np.ones(len(part), dtype=bool)
        for c in range(0, len(out), 4 * _CHUNK):
            free &= (part @ x[out[c : c + 4 * _CHUNK]].T).max(axis=1) < least
        left = np.flatnonzero(free)
        if len(left):
            near = part[left] @ part[left].T >= least
            open_ = np.ones(len(left), dtype=bool)
            for i in range(len(left)):
                if open_[i]:
                    out.append(s + int(left[i]))
                    open_ &= ~near[i]
    return np.array(out)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which centre each row is nearest to, how far); a centre is its own."""
    owner, best = np.zeros(len(x), dtype=np.int64), np.full(len(x), -2.0)
    for c in range(0, len(centres), 4 * _CHUNK):
        y = x[centres[c : c + 4 * _CHUNK]]
        for s in range(0, len(x), 4 * _CHUNK):
            cos = x[s : s + 4 * _CHUNK] @ y.T
            k = cos.argmax(axis=1)
            top = cos[np.arange(len(k)), k]
            better = np.flatnonzero(top > best[s : s + len(k)])
            owner[s + better], best[s + better] = k[better] + c, top[better]
    owner[centres], best[centres] = np.arange(len(centres)), 1.0
    return owner, np.sqrt(np.maximum(0.0, 2.0 - 2.0 * best))


def pairs_within(a: Tree, b: Tree | None, threshold: float, found: Callable, joined: Callable | None = None, seen: dict | None = None) -> int:
    """Call found(i, j) with arrays of row numbers of pairs of a and b (b None: within a, each pair once) at cosine >= threshold, all of them between them.

    Two nodes are left alone if their centres lie farther apart than both radii and the threshold's distance together. With
    `joined`, nodes that lie so near that all their members must be linked go to joined(i, j) as the
    members of either node (the same array twice: all pairs within it) and are not compared. Returns how many pairs of vectors were
    pruned; `seen` gets how many were pruned, joined and compared one by one.
    """
    reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold)))
    other, seen = a if b is None else b, {} if seen is None else seen
    seen |= {"pruned": 0, "joined": 0, "compared": 0}
    if not len(a.x) or not len(other.x):
        return 0
    stack: list[tuple[int, int, float]] = [(0, 0, 0.0 if b is None else float(_distance(a.centres[:1], other.centres[:1])[0, 0]))]
    while stack:
        p, q, gap = stack.pop()
        same = b is None and p == q
        if joined and gap + a.radius[p] + other.radius[q] <= reach - 1e-6 and (not same or 2 * a.radius[p] <= reach - 1e-6):
            i, j = a.members(p), other.members(q)
            seen["joined"] += len(i) * (len(i) - 1) // 2 if same else len(i) * len(j)
            joined(i, i if same else j)
            continue
        kids, kids2 = a.kids[p], other.kids[q]
        if kids[0] == kids[1] and kids2[0] == kids2[1]:
            _compare(a, p, other, q, same, threshold, found, seen)
            continue
        # the larger node is opened; a node with itself opens both sides
        left = (p, p + 1) if not same and (kids[0] == kids[1] or (kids2[0] != kids2[1] and other.radius[q] > a.radius[p])) else kids
        right = kids2 if same or left == (p, p + 1) else (q, q + 1)
        _open(a, left, other, right, same, reach, stack, seen, threshold, found)
    return seen["pruned"]


def _compare(a: Tree, p: int, b: Tree, q: int, same: bool, threshold: float, found: Callable, seen: dict) -> None:
    i, j = a.members(p), b.members(q)
    seen["compared"] += len(i) * (len(i) - 1) // 2 if same else len(i) * len(j)
    for s in range(0, len(i), 4 * _CHUNK):  # a leaf of equal vectors may be large
        near = a.x[i[s : s + 4 * _CHUNK]] @ b.x[j].T >= threshold
        if same:
            near &= (np.arange(s, s + len(near))[:, None]) < np.arange(len(j))[None, :]
        x, y = np.nonzero(near)
        if len(x):
            found(i[s + x], j[y])


def _open(a: Tree, left: tuple[int, int], b: Tree, right: tuple[int, int], same: bool, reach: float, stack: list, seen: dict, threshold: float, found: Callable) -> None:
    """Put the pairs of two ranges of nodes that bounds leave onto the stack; pairs of single vectors are decided at once."""
    size_b = np.array(b.end[right[0] : right[1]]) - np.array(b.begin[right[0] : right[1]])
    for s in range(left[0], left[1], 4 * _CHUNK):
        e = min(left[1], s + 4 * _CHUNK)
        size_a = np.array(a.end[s:e]) - np.array(a.begin[s:e])
        ra = a.radii[s:e]
        for t in range(right[0] if not same else s, right[1], 4 * _CHUNK):
            f = min(right[1], t + 4 * _CHUNK)
            cos, rb = a.centres[s:e] @ b.centres[t:f].T, b.radii[t:f]
            # as cosines: the distance 2 - 2 cos is at most the square of all bounds together; 1e-7 over, for a cosine's rounding near 1
            if ra.any() or rb.any():
                near = cos >= 1.0 - np.square(reach + 1e-7 + ra[:, None] + rb[None, :]) / 2.0
            else:
                near = cos >= 1.0 - (reach + 1e-7) ** 2 / 2.0
            sb = size_b[t - right[0] : f - right[0]]
            whole = int(size_a.sum()) * int(sb.sum())
            if same and s == t:  # each pair once
                near = np.triu(near)
                whole = (whole - int((size_a * size_a).sum())) // 2
            i, j = np.nonzero(near)
            own = same & (i + s == j + t)
            single = (size_a[i] == 1) & (sb[j] == 1) & ~own
            left_over = int((size_a[i] * sb[j])[~own].sum())
            # of two single vectors the centres' cosine is theirs: compared, not pruned
            n1, m1 = int((size_a == 1).sum()), int((sb == 1).sum())
            looked = n1 * (n1 - 1) // 2 if same and s == t else n1 * m1
            seen["pruned"] += whole - left_over - (looked - int(single.sum()))
            seen["compared"] += looked
            hit = single & (cos[i, j] >= threshold)
            if hit.any():
                found(np.array(a.centre)[s + i[hit]], np.array(b.centre)[t + j[hit]])
            go = ~single & ~(own & (size_a[i] == 1))
            gaps = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos[i[go], j[go]]))
            gaps[own[go]] = 0.0
            stack += zip((s + i[go]).tolist(), (t + j[go]).tolist(), gaps.tolist(), strict=True)
