"""Embedding whitening: the leading components of the vectors' covariance by block Lanczos, without ever forming the covariance.

Entries become integers, so sums and deviations are exact. The fit goes over each distinct vector once. A pass multiplies the centred
vectors by a block of directions where they lie and adds up X'(Xv); a task returns one small matrix. The driver holds the Krylov basis,
whose size the number of dimensions bounds, orthogonalises each new block against all of it, twice, replaces directions that
break down by seeded new ones, and restarts from the best Ritz vectors when the basis is full. It ends when the residuals of the
wanted pairs, measured by a pass of their own, are at the level of rounding.

Defined results: vectors that are null, or hold null, NaN or infinite entries, are dropped, as are those without entries. Equal vectors count once in
the fit and all get rows; rows without an id keep a null id. Vectors of different lengths have different dimensions: each length is
fitted on its own. A component whose eigenvalue is zero to rounding (equal vectors, fewer vectors than components) has no direction
to whiten and is left out. An empty table gives no rows. Further columns are not read. A deviation beyond 64 bits ends the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import bound_batches, materialise, release

SCALE, OFFSET = 64, 1_000_000
#: Residuals over the largest eigenvalue at which a pair has converged.
TOLERANCE = 2e-13
SEED = 20240131


def to_integers(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, dim, x): floor(64 c) + 1,000,000 for each entry, of vectors whose entries are all finite."""
    v = F.col(f"`{vector_col}`")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    d = df.where(v.isNotNull() & (F.size(v) > 0) & fine)
    return d.select(F.col(f"`{id_col}`").alias("vec_id"), F.size(v).alias("dim"), F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + OFFSET).alias("x"))


@dataclass
class Fit:
    """n distinct vectors, their sums by dimension, eigenvalues falling, unit vectors as columns, and the trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def _centred(column: pa.Array, dim: int, n: int, sums: np.ndarray) -> np.ndarray:
    """Rows x - S/n, rounded once: n x - S is exact."""
    x = column.flatten().to_numpy().reshape(-1, dim)
    return (n * x - sums) / n


def _summed(fit: DataFrame, dim: int, n: int, sums: np.ndarray, product: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all vectors of product(block of centred rows); a task returns one matrix, which Spark adds up entry by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = product(_centred(b.column(0), dim, n, sums))
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["m"])

    parts = fit.select("x").mapInArrow(run, "m array<double>").select(F.posexplode("m").alias("i", "v"))
    out = np.zeros(shape[0] * shape[1])
    for i, v in parts.groupBy("i").agg(F.sum("v")).collect():  # dimensions times directions
        out[i] = v
    return out.reshape(shape)


def _sums(fit: DataFrame, dim: int) -> tuple[list[int], int]:
    """The exact sum of each dimension, and the largest absolute entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy().reshape(-1, dim)
                yield pa.record_batch([pa.array([x.sum(axis=0)]), pa.array([int(np.abs(x).max())])], names=["s", "most"])

    parts = fit.select("x").mapInArrow(run, "s array<long>, most long").select(F.posexplode("s").alias("i", "v"), "most")
    rows = parts.groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.max("most").alias("most")).orderBy("i").collect()  # a row a dimension
    return [int(r.s) for r in rows], max((r.most for r in rows), default=0)


def block_lanczos(multiply: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, block: int | None = None, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenpairs of a symmetric operator on `dim` dimensions, known only by its products with blocks of columns.

    The basis holds at most `most` directions; when it is full, it is cut to the best Ritz vectors and goes on from their residuals.
    """
    rng = np.random.default_rng(SEED)
    wanted = min(wanted, dim)
    block = min(dim, block or max(8, wanted))
    most = min(dim, most or max(4 * wanted + 2 * block, 8 * block))
    basis, image = np.zeros((dim, 0)), np.zeros((dim, 0))
    new = rng.standard_normal((dim, block))
    best_residual, stale = np.inf, 0
    while True:
        new = _orthonormal(new, basis, min(new.shape[1], dim - basis.shape[1]), rng)
        made = multiply(new)
        basis, image = np.hstack([basis, new]), np.hstack([image, made])
        small = basis.T @ image
        values, turned = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)
        keep = order[: min(wanted, len(order))]
        ritz = basis @ turned[:, keep]
        residual = image @ turned[:, keep] - ritz * values[keep]
        size = max(abs(values[order[0]]), np.finfo(float).tiny)
        left = np.linalg.norm(residual, axis=0).max(initial=0)
        done = len(keep) == wanted and (left <= TOLERANCE * size or stale >= 3)
        if done or basis.shape[1] == dim:
            exact = multiply(ritz)  # one more pass: the pairs from products with themselves, not with the basis
            small = ritz.T @ exact
            values, turned = np.linalg.eigh((small + small.T) / 2)
            order = np.argsort(-values)
            ritz = ritz @ turned[:, order]
            return values[order], ritz / np.linalg.norm(ritz, axis=0)
        if basis.shape[1] + block > most and basis.shape[1] > wanted:
            stale = 0 if left < best_residual / 2 else stale + 1  # restarts that gain nothing more: rounding
            best_residual = min(best_residual, left)
            best = order[: min(len(order) - 1, wanted + block)]
            basis, image = basis @ turned[:, best], image @ turned[:, best]
            worst = np.argsort(-np.linalg.norm(residual, axis=0))[:block]
            new = residual[:, worst]
        else:
            new = made


def _orthonormal(new: np.ndarray, basis: np.ndarray, count: int, rng: np.random.Generator) -> np.ndarray:
    """`count` unit columns orthogonal to basis and each other; a column that breaks down is replaced by a random one."""
    done = np.zeros((len(new), 0))
    for j in range(count):
        column = new[:, j]
        while True:
            length = np.linalg.norm(column)
            for _ in range(2):
                column = column - basis @ (basis.T @ column)
                column = column - done @ (done.T @ column)
            left = np.linalg.norm(column)
            if left > 1e-10 * length and left > 0:
                break
            column = rng.standard_normal(len(new))
        column = column / left
        column = column - basis @ (basis.T @ column) - done @ (done.T @ column)
        done = np.hstack([done, (column / np.linalg.norm(column))[:, None]])
    return done


def fit_whitening(vectors: DataFrame, dim: int, components: int = 16) -> tuple[Fit, DataFrame]:
    """The fit over the distinct vectors of one length, and those vectors as a table in the shared folder."""
    fit = materialise(vectors.where(F.col("dim") == dim).select("x").distinct(), "whiten-fit")
    n = fit.count()
    sums, largest = _sums(fit, dim)
    if n * largest >= 1 << 62 or any(abs(x) >= 1 << 62 for x in sums):
        raise OverflowError("a deviation is beyond 64 bits")
    s = np.array(sums, dtype=np.int64)
    by = lambda q: _summed(fit, dim, n, s, lambda c: c.T @ (c @ q), (dim, q.shape[1])) / n
    values, columns = block_lanczos(by, dim, components)
    trace = float(_summed(fit, dim, n, s, lambda c: np.array([[np.square(c).sum()]]), (1, 1))[0, 0]) / n
    real = values > max(trace, 0.0) * dim * np.finfo(float).eps * 8
    return Fit(n, sums, values[real], columns[:, real], trace), fit


def identity_error(fit: DataFrame, f: Fit) -> float:
    """The largest absolute entry of the whitened fit vectors' covariance minus the identity, by a pass over them."""
    k, dim, n, s = len(f.values), len(f.sums), f.n, np.array(f.sums, dtype=np.int64)
    scaled = f.vectors / np.sqrt(f.values)

    def moments(c: np.ndarray) -> np.ndarray:
        w = c @ scaled
        return np.vstack([w.T @ w, w.sum(axis=0, keepdims=True)])

    m = _summed(fit, dim, n, s, moments, (k + 1, k)) / n
    return float(np.abs(m[:k] - np.outer(m[k], m[k]) - np.eye(k)).max())


def whiten(df: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue): a row for each vector and component."""
    spark = df.sparkSession
    bound_batches(spark)
    vectors = to_integers(df, id_col, vector_col)
    out = None
    for (dim,) in sorted(vectors.select("dim").distinct().collect()):
        f, fit = fit_whitening(vectors, dim, components)
        if not len(f.values):
            release(fit)
            continue
        error = identity_error(fit, f)
        release(fit)
        rows = _project(vectors.where(F.col("dim") == dim), f, error)
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double")


def _project(vectors: DataFrame, f: Fit, error: float) -> DataFrame:
    n, dim, s, k = f.n, len(f.sums), np.array(f.sums, dtype=np.int64), len(f.values)
    scaled, values, explained = f.vectors / np.sqrt(f.values), f.values, f.values / f.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, dim)
            off = n * x - s
            if len(x) and (np.square(off.astype(np.float64)).sum(axis=1) > 2.0**62).any():
                raise OverflowError("a deviation is beyond 64 bits")
            w = (off / n) @ scaled
            m = len(x)
            yield pa.record_batch(
                [
                    b.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)),
                    pa.array(np.repeat(np.square(off).sum(axis=1), k)),
                    pa.array(w.ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                    pa.array(np.tile(values, m)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue"],
            )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double")
