"""Minimax contiguous sharding of ordered atomic groups.

Groups (equal texts) are ordered by a 64-bit hash. The smallest capacity C at which the ordered groups
can be cut into n contiguous shards of at most C bytes is found by binary search, each step checked
greedily over prefix sums. The prefix sums live on the driver only as a histogram over hash prefixes,
refined 12 bits at a time just where a cut could fall: at most 4,096 rows for each range that is
looked into, however many documents there are. With C known, the cuts go where the rest divides most
evenly while every shard stays within C.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

BITS = 12
_MIN = -(1 << 63)


class _Histogram:
    """Contiguous hash ranges with bytes and group counts; refined where asked."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.seg: list[tuple[int, int, int, int, int]] = self._read(None)  # low hash, level, bytes, groups, largest group
        self._sum()

    def _read(self, where) -> list:
        out = []
        for level in sorted({lv for _, lv in where} if where else {0}):
            g, down = self.groups, max(0, 64 - BITS * (level + 1))
            if where:
                up = 64 - BITS * level
                g = g.where(F.shiftright("h", up).isin([lo >> up for lo, lv in where if lv == level]))
            rows = g.groupBy(F.shiftright("h", down).alias("k")).agg(F.sum("bytes"), F.count("*"), F.max("bytes")).collect()
            out += [(r[0] << down, level + 1, r[1], r[2], r[3]) for r in rows]
        return sorted(out)

    def _sum(self) -> None:
        self.at = [0]
        for s in self.seg:
            self.at.append(self.at[-1] + s[2])

    def refine(self, which: set[int]) -> None:
        lows = [(self.seg[i][0], self.seg[i][1]) for i in which]
        new = self._read(lows)
        self.seg = sorted([s for i, s in enumerate(self.seg) if i not in which] + new)
        self._sum()

    def floor(self, x: int, need: set[int]) -> int:
        """The last group border at or before byte x."""
        i = bisect_right(self.at, x) - 1
        if i < len(self.seg) and self.at[i] < x and self.seg[i][3] > 1:
            need.add(i)
        return self.at[i]

    def ceil(self, x: int, need: set[int]) -> int:
        i = bisect_left(self.at, x)
        if i > 0 and self.at[i] > x and self.seg[i - 1][3] > 1:
            need.add(i - 1)
        return self.at[i]

    def key(self, border: int) -> int | None:
        i = bisect_left(self.at, border)
        return self.seg[i][0] if i < len(self.seg) else None


def _forward(h: _Histogram, start: int, cap: int, need: set[int]) -> int:
    """Where a shard that begins at start ends at the latest: within cap, or after one group that is larger."""
    total = h.at[-1]
    end = h.floor(min(total, start + cap), need)
    return end if end > start or start >= total else h.ceil(start + 1, need)


def _backward(h: _Histogram, end: int, cap: int, need: set[int]) -> int:
    begin = h.ceil(max(0, end - cap), need)
    return begin if begin < end or end <= 0 else h.floor(end - 1, need)


def _fits(h: _Histogram, cap: int, n: int, need: set[int]) -> bool:
    start, total = 0, h.at[-1]
    for _ in range(n):
        if start >= total:
            return True
        start = _forward(h, start, cap, need)
    return start >= total


def _cuts(h: _Histogram, n: int, need: set[int]) -> tuple[int, list[int]]:
    """(capacity, borders between shards). A group above the capacity that the rest needs has a shard of its own, so it doesn't loosen the others."""
    total = h.at[-1]
    lo, hi = 1, max(total, 1)
    while lo < hi:
        mid = (lo + hi) // 2
        if _fits(h, mid, n, need):
            hi = mid
        else:
            lo = mid + 1
    back = [total]  # where each shard has to begin at the earliest for the rest to fit
    for _ in range(n - 1):
        back.append(_backward(h, back[-1], hi, need))
    back.reverse()  # back[j]: begin of shard j + 1 at the earliest, from 0
    cuts, start = [], 0
    for j in range(1, n):
        want = min(total, start + -(-(total - start) // (n - j + 1)))
        below, above = h.floor(want, need), h.ceil(want, need)
        cut = above if above - want < want - below or below <= start else below
        start = min(max(cut, back[j - 1], start), _forward(h, start, hi, need))
        cuts.append(start)
    return max(hi, max((s[4] for s in h.seg), default=0)), cuts


def minimax_cuts(groups: DataFrame, n_shards: int) -> tuple[int, list[int | None]]:
    """(capacity, hash where each shard but the first begins; None: nothing is left for it) of groups (h, bytes), one row a hash."""
    h = _Histogram(groups)
    while True:
        need: set[int] = set()
        cap, cuts = _cuts(h, n_shards, need)
        need = {i for i in need if h.seg[i][3] > 1}
        if not need:
            return cap, [h.key(c) for c in cuts]
        h.refine(need)


def shard_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 8, cells: int = 64) -> DataFrame:
    """Assign every row to one of n_shards shards of near equal bytes, equal texts together.

    Returns (id, size, text_crc32, law, shard, slot, grown_shard). A null text counts as empty (size 1,
    checksum 0) and goes with the empty texts. Rows with a null or repeated id each get a slot of their
    own. An empty table gives no rows. Other columns of df, whatever their names, are not looked at.
    A group larger than an even share makes the smallest capacity its own size; it gets a shard to itself, and the
    capacity of the others is the smallest that holds the rest. slot runs from 0 in each shard; it orders
    rows by (hash range, cell, hash, id), a cell being one of `cells` parts by the id's hash, or, without an id, by the
    part of the table that the row came from, so that no group of copies, however large, is numbered by one task. Texts of any length
    count whole; rows that are the same in every respect get their slots in any order.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = materialise(
        df.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
        ).withColumn("cell", F.when(F.col("id").isNull(), F.pmod(F.spark_partition_id(), F.lit(cells))).otherwise(F.pmod(F.xxhash64("id"), F.lit(cells))).cast("int")),
        "shard-rows",
    )
    groups = materialise(rows.groupBy("h").agg(F.sum("size").alias("bytes")), "shard-groups")
    _, begins = minimax_cuts(groups, n_shards)
    shard = F.lit(0)
    for b in begins:
        if b is not None:
            shard = shard + (F.col("h") >= F.lit(b)).cast("int")
    keyed = rows.withColumn("shard", shard).withColumn("part", F.shiftright("h", 54))
    from pyspark.sql import Window as W

    key = ["shard", "part", "cell"]
    counts = keyed.groupBy(*key).agg(F.count("*").alias("n"))
    before = counts.withColumn("base", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("part", "cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inner = keyed.withColumn("r", F.row_number().over(W.partitionBy(*key).orderBy("h", "id", "text_crc32")) - 1)
    return inner.join(before, key).select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("base") + F.col("r")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
