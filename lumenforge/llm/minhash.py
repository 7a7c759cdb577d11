"""MinHash near-duplicates with sequential Bayesian verification.

Texts with equal shingle sets are one class from the start. Signatures of the classes' representatives are cut
into bands; members of a bucket are candidates. A candidate pair's signatures are compared some hashes at
a time, and the pair is dropped as soon as the posterior probability that its similarity reaches the threshold
falls below the chosen miss probability. Survivors are verified on their full sets.

A bucket never becomes all its pairs. First every member meets the bucket's centre; links found that way join
components, and only members of different components are compared further: pair by pair in buckets of at
most SMALL members; in larger ones signatures are dealt in blocks, smaller components against all, then the
sets of those that agree with some other of their task, and only links that join components leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, connected_components, fresh, materialise, release, row_hash, tidy
from .shingles import MinHash, mix, shingle_sets

BANDS, ROWS = 40, 6
#: Hashes that the sequential test compares, and how many at a time.
COMPARED, STEP = 96, 16
MISS = 1e-6
SMALL = 32
BLOCK = 256
#: Up to so many rows of ids a side is broadcast (some 40 MB as a hash table); beyond, the join shuffles.
BROADCAST_ROWS = 500_000


def least_matches(size: int, threshold: float, step: int = STEP, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes compared, least matches to go on): with a uniform prior, P(similarity >= t | m of n match) = P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in [*range(step, size, step), size]:
        tail = m = 0.0
        k = 0
        for k in range(n + 2):
            tail += math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k)
            if tail >= miss:
                break
        m = k
        out.append((n, int(m)))
    return out


def survivors(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of two signature arrays outlast the sequential test."""
    live = np.arange(len(a))
    done, matches = 0, np.zeros(len(a), dtype=np.int32)
    for n, least in least_matches(a.shape[1], threshold):
        if not len(live):
            break
        matches = matches + (a[live, done:n] == b[live, done:n]).sum(axis=1)
        ok = matches >= least
        live, matches, done = live[ok], matches[ok], n
    return live


def _slices(texts: pa.Array, size: int = 1_000_000) -> Iterator[tuple[int, pa.Array]]:
    """Parts of about so many bytes, to bound what is held at a time."""
    lengths = np.asarray(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    part = np.cumsum(lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for i, j in zip(cuts, cuts[1:], strict=False):
        if j > i:
            yield i, texts.slice(i, j - i)


def sketch(df: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, n, k1, k2, sig, bands): size of the shingle set, a 128-bit key of it, 16 bits each of the compared hashes, and the bands' keys."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHash(BANDS * ROWS)
        for b in batches:
            for start, texts in _slices(b.column(1)):
                sets = shingle_sets(texts, k)
                sig = hasher.signatures(sets)
                k1, k2, n = [], [], []
                with np.errstate(over="ignore"):
                    for s in sets:
                        n.append(len(s))
                        k1.append(int(np.bitwise_xor.reduce(mix(s)).view(np.int64)) if len(s) else 0)
                        k2.append(int(np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))).view(np.int64)) if len(s) else 0)
                    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sets), BANDS))
                    for j in range(ROWS):
                        keys = mix(keys * np.uint64(0x9DDFEA08EB382D69) + sig[:, j::ROWS].astype(np.uint64))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(_packed(sig), pa.binary()), bands], names=["id", "n", "k1", "k2", "sig", "bands"])

    slim = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    return slim.mapInArrow(run, "id long, n long, k1 long, k2 long, sig binary, bands array<long>")


def _packed(sig: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in sig[:, :COMPARED].astype("<u2")]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, COMPARED)


def _sized(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is known to be small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _pass_signatures(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that outlast the sequential test of their signatures."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                live = survivors(_matrix(b.column(2)), _matrix(b.column(3)), threshold)
                yield b.select([0, 1]).take(pa.array(live, pa.int64()))

    joined = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * common >= percent * union of two sorted sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")  # two runs: one merge
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _member_sets(df: DataFrame, id_col: str, text_col: str, members: DataFrame, k: int) -> DataFrame:
    """(id, key, set): the full shingle sets of the members' texts, one row for each set of an id, as sorted 64-bit hashes.

    The texts are read once for this. A short list of members is broadcast, so that texts stay where they are; beyond, they meet it once by id.
    Afterwards only sets of texts that share a bucket with another are moved.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in _slices(b.column(1)):
                sets = shingle_sets(texts, k)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "set"])

    slim = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    return materialise(slim.join(_sized(members), "id", "left_semi").mapInArrow(run, "id long, set binary"), "sets")


def _verify(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are linked: each a's set goes before the sets that it is compared with, in parts of some BLOCK of them, and a task reads them in that order."""
    counts = materialise(pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(float(BLOCK))).alias("parts")), "parts")
    dealt = pairs.join(_sized(counts), "a").withColumn("blk", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    needs = dealt.select(F.col("b").alias("id"), F.col("a").alias("grp"), "blk", F.lit(1).alias("role"))
    needs = materialise(needs.unionByName(dealt.select(F.col("a").alias("id"), F.col("a").alias("grp"), "blk", F.lit(0).alias("role")).distinct()), "needs")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, heads = None, []
        for batch in batches:
            ids, groups, parts, roles = (batch.column(i).to_pylist() for i in range(4))
            a, b = [], []
            for i, key in enumerate(zip(groups, parts, strict=True)):
                if key != at:
                    at, heads = key, []
                s = np.frombuffer(batch.column(4)[i].as_buffer(), dtype=np.uint64)
                if roles[i] == 0:
                    heads.append(s.copy())
                elif any(_linked(h, s, percent) for h in heads):
                    a.append(groups[i])
                    b.append(ids[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    held = sets.join(_sized(needs), "id").select("id", "grp", "blk", "role", "set").repartition("grp", "blk").sortWithinPartitions("grp", "blk", "role")
    links = materialise(held.mapInArrow(run, "a long, b long").distinct(), "links")
    release(needs, counts)
    return links


def _signatures_of(sets: DataFrame) -> DataFrame:
    """(id, sig) of sets: 16 bits each of the compared hashes."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHash(COMPARED)
        for b in batches:
            found = [np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_packed(hasher.signatures(found)), pa.binary())], names=["id", "sig"])

    return sets.mapInArrow(run, "id long, sig binary")


def _block_links(df: DataFrame, id_col: str, text_col: str, rest: DataFrame, k: int, percent: int, sets: DataFrame | None = None, sigs: DataFrame | None = None) -> DataFrame:
    """Links between different components among the members (bh, id, c) of large buckets, verified on full sets, as many as components need to join.

    In each bucket the members outside of its largest component are dealt into blocks, and so are the others; a
    task holds one block of the former and one of any, at most some hundreds of members. First signatures are dealt, and only members that
    outlast the sequential test with some other of their task get their sets sent there.
    """
    sets = _member_sets(df, id_col, text_col, rest.select("id").distinct(), k) if sets is None else sets
    sigs = _signatures_of(sets) if sigs is None else sigs
    counts = rest.groupBy("bh", "c").agg(F.count("*").alias("k"))
    most = materialise(counts.groupBy("bh").agg(F.max_by("c", F.struct("k", "c")).alias("top"), F.max("k").alias("kt"), F.sum("k").alias("m")), "most")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(float(BLOCK))).cast("int"))
    r = rest.join(_sized(most), "bh").withColumn("minor", F.col("c") != F.col("top")).withColumn("nt", blocks(F.col("kt"))).withColumn("no", blocks(F.col("m") - F.col("kt")))
    r = r.withColumn("blk", F.pmod(F.xxhash64("id"), F.when(F.col("minor"), F.col("no")).otherwise(F.col("nt"))).cast("int"))
    one = lambda x, y, side: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(side).alias("side"))
    # y: a block of the former in [0, no), of the largest component from no on
    as_left = F.transform(F.sequence(F.lit(0), F.col("no") + F.col("nt") - 1), lambda y: one(F.col("blk"), y, 0))
    as_right = F.transform(F.sequence(F.lit(0), F.col("no") - 1), lambda x: one(x, F.when(F.col("minor"), F.col("blk")).otherwise(F.col("blk") + F.col("no")), 1))
    dealt = r.select("id", "bh", "c", F.explode(F.when(F.col("minor"), F.concat(as_left, as_right)).otherwise(as_right)).alias("at")).select("id", "bh", "c", "at.*").where("x <= y")
    dealt = materialise(dealt, "blocks")
    threshold = percent / 100

    def partners(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        """(row of the left, rows of the right that outlast the test with it, nearest first)."""
        lsig, rsig = (np.frombuffer(b"".join(side.sig), dtype="<u2").reshape(-1, COMPARED) for side in (left, right))
        lid, lc, rid, rc = left.id.to_numpy(), left.c.to_numpy(), right.id.to_numpy(), right.c.to_numpy()
        for i in range(len(left)):
            other = np.flatnonzero((rc != lc[i]) & (rid != lid[i]))
            live = other[survivors(np.broadcast_to(lsig[i], (len(other), COMPARED)), rsig[other], threshold)]
            if len(live):
                yield i, live[np.argsort(-(rsig[live] == lsig[i]).sum(axis=1), kind="stable")]

    def outlast(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf.side == 0].reset_index(drop=True), pdf[pdf.side == 1].reset_index(drop=True)
        keep_l, keep_r = np.zeros(len(left), dtype=bool), np.zeros(len(right), dtype=bool)
        if len(left) and len(right):
            for i, live in partners(left, right):
                keep_l[i] = True
                keep_r[live] = True
        return pd.concat([left[keep_l], right[keep_r]], ignore_index=True)[["id", "bh", "c", "x", "y", "side", "sig"]]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf.side == 0].reset_index(drop=True), pdf[pdf.side == 1].reset_index(drop=True)
        a, b = [], []
        if len(left) and len(right):
            ls, rs = ([np.frombuffer(x, dtype=np.uint64) for x in side.set] for side in (left, right))
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while root.get(x, x) != x:
                    x = root[x]
                return x

            for i, live in partners(left, right):
                for j in live.tolist():
                    p, q = find(int(left.c[i])), find(int(right.c[j]))
                    if p != q and _linked(ls[i], rs[j], percent):
                        root[max(p, q)] = min(p, q)
                        a.append(min(left.id[i], right.id[j]))
                        b.append(max(left.id[i], right.id[j]))
        return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

    live = dealt.join(sigs, "id").groupBy("bh", "x", "y").applyInPandas(outlast, "id long, bh long, c long, x int, y int, side int, sig binary")
    live = materialise(live, "outlasting")
    links = live.join(sets, "id").groupBy("bh", "x", "y").applyInPandas(compare, "a long, b long").distinct()
    links = materialise(links, "links")
    release(dealt, live)
    return links


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: components of texts linked at 100 * common >= percent * union of their k-word shingles.

    A-Z count as a-z; a text of fewer than k words has its whole sequence as its one shingle; texts without words, null
    ones too, have no shingle and link with nothing. component_id is the smallest id reachable, kept says that
    it is the row's own. Rows that share an id are one node, linked by any of their texts; rows without an
    id link with nothing, get no component and are kept. An empty table gives no rows; other columns, whatever their names, are not
    looked at. Texts of any length count whole. The probability that banding misses a pair at 0.8 is 5e-6, and less above.
    """
    bound_batches(df.sparkSession)
    t = percent / 100
    sk = materialise(sketch(df, id_col, text_col, k), "sketch")
    keyed = sk.where("n > 0 and id is not null")
    classes = keyed.groupBy("k1", "k2").agg(F.min("id").alias("rep"))
    member = materialise(keyed.select("id", "k1", "k2").distinct().join(classes, ["k1", "k2"]).select("id", "k1", "k2", "rep"), "classes")
    reps = keyed.join(_sized(member.where("id = rep").select("id", "k1", "k2")), ["id", "k1", "k2"], "left_semi")
    rows = reps.select("id", F.explode("bands").alias("bh")).distinct()
    counts = rows.groupBy("bh").agg(F.count("*").alias("m")).where("m > 1")
    buckets = materialise(rows.join(counts, "bh"), "buckets")
    sigs = materialise(reps.join(buckets.select("id").distinct(), "id", "left_semi").select("id", "sig").distinct(), "signatures")
    # the member that shares most buckets with most others is a group's centre, more likely than not linked to all of it
    score = buckets.groupBy("id").agg(F.sum("m").alias("s"))
    buckets = materialise(buckets.join(score, "id"), "scored")
    central = F.struct("s", -F.col("id"))
    leaders = materialise(buckets.groupBy("bh").agg(F.max_by("id", central).alias("leader")), "leaders")
    sets = _member_sets(df, id_col, text_col, buckets.select("id").distinct(), k)
    star = buckets.join(_sized(leaders), "bh").where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()

    # rows that share an id bring their classes together
    shared = member.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("id", "a")
    links = member.join(shared, "id").select("a", F.col("rep").alias("b")).where("a <> b").distinct()

    def grow(links: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(all links so far, components) after verifying candidate pairs."""
        live = materialise(_pass_signatures(pairs, sigs, t), "pairs")
        links = links.unionByName(_verify(sets, live, percent))
        release(live)
        return links, connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))

    def unresolved(component: DataFrame) -> DataFrame:
        """(bh, id, m, s, c): members of buckets that still hold different components; a bucket of two has had its pair compared."""
        placed = buckets.where("m > 2").join(component.withColumnRenamed("node", "id"), "id", "left").select("bh", "id", "m", "s", F.coalesce("component", "id").alias("c"))
        split = placed.groupBy("bh").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("bh")
        return materialise(placed.join(split, "bh", "left_semi"), "rest")

    links, component = grow(links, star)
    rest = unresolved(component)
    small = rest.where(F.col("m") <= SMALL)
    few = small.alias("p").join(small.alias("q"), (F.col("p.bh") == F.col("q.bh")) & (F.col("p.id") < F.col("q.id")) & (F.col("p.c") != F.col("q.c")))
    more = materialise(few.select(F.col("p.id").alias("a"), F.col("q.id").alias("b")).distinct(), "few")
    large = rest.where(F.col("m") > SMALL)
    if not large.isEmpty():
        links = links.unionByName(_block_links(df, id_col, text_col, large.select("bh", "id", "c"), k, percent, sets, sigs))
    old = component
    links, component = grow(links, more)
    release(old, more, buckets, rest, sigs, sets, leaders)
    placed = member.join(component.withColumnRenamed("node", "rep"), "rep", "left").select("id", "k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    out = sk.select("id", "n", "k1", "k2").join(placed, ["id", "k1", "k2"], "left")
    comp = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of near_duplicates(), with all its columns, whatever their names, and all rows without words.

    The smallest id stays. Rows that share an id, or have none, are nodes of their own, told apart by their content: of a component's rows of
    the smallest id the one with the least hash stays, rows with an id before those without, and of rows that are the same in every column one. An empty
    table stays empty. Texts of any length count whole. Texts are not shuffled but for rows that stand for several of the same.
    """
    mark, ident = fresh(df, "_gone"), F.col(f"`{id_col}`").cast("long")
    ids = df.select(ident.alias("id"))
    again = materialise(ids.groupBy("id").agg(F.count("*").alias("n")).where("id is null or n > 1").select("id"), "repeated")
    if again.isEmpty():
        found = near_duplicates(df, id_col, text_col, k, percent)
        gone = materialise(found.where(~F.col("kept")).select(F.col(id_col).alias(mark)).distinct(), "gone")
        return df.join(_sized(gone), ident == F.col(mark), "left_anti")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), ident.alias("i"), row_hash(df, df.columns).alias("h"), F.col(f"`{text_col}`").alias("text"))
    several = _sized(again.where("id is not null").select("id", F.lit(1).alias("several")))
    rows = rows.join(several, rows["i"] == several["id"], "left").drop("id")
    # a node of its own for every content of an id that several rows have; below zero, as ids seldom are
    rows = rows.withColumn("node", F.when(F.col("i").isNull() | F.col("several").isNotNull(), -1 - F.shiftrightunsigned("h", 1)).otherwise(F.col("i")))
    found = near_duplicates(rows.select("node", "text"), "node", "text", k, percent)
    found = found.where("n_shingles > 0").groupBy("node").agg(F.max("component_id").alias("component_id"), F.count("*").alias("m"))
    named = rows.select("node", "i", "h").distinct().join(found, "node")
    best = named.groupBy("component_id").agg(F.min(F.struct(F.col("i").isNull().alias("none"), "i", "h", "node")).alias("best"))
    verdict = named.join(best, "component_id").select("node", (F.col("node") == F.col("best.node")).alias("stays"), "m")
    verdict = _sized(materialise(verdict.where("not stays or m > 1"), "verdict"))
    left = rows.join(verdict, "node", "left").where("stays is null or stays")
    one = left.where("stays is null").select("row")
    same = left.where("stays").groupBy("node").agg(F.first("row").alias("row")).select("row")
    return one.unionByName(same).select("row.*")
