"""Operator 12: whitening of vectors by their leading principal components, found with LOBPCG.

The covariance V is never formed: each iteration is one pass over the vectors that multiplies V with an orthonormal basis of
the iterate X, its residual R and the previous direction P (rows are centred, exactly, before they are multiplied). Rayleigh-Ritz in
that basis gives the next iterate: with Q the basis and W = VQ, the eigenvectors U of Q'W give X = QU, VX = WU and R = VX - XE.
The direction is what the step added to the old iterate. The block has twice as many columns as components are asked for, so
convergence doesn't hang on the gap behind the last one. Iterations end when every asked component's residual, as computed from a
fresh product, is below `tolerance` times the first eigenvalue, or, near rounding, doesn't fall any more; then vectors are projected and divided.

What a pass returns is dimensions x block numbers, summed in two steps, however many vectors there are.

Defined cases: rows with a null vector, or with null or non-finite components, are left out; likewise empty vectors, those of
another length than most have, and those with components too great for 64-bit squares. vec_id may be null or repeat (ties): each row
counts and has its own result. Components without variance (numerically: at most dimensions x 2^-52 of the first eigenvalue)
can't be whitened and have no rows, so equal vectors, a single one and an empty table give an empty result. Of equal
eigenvalues any orthonormal vectors of their space are right; the start is fixed, so reruns agree but for the order of sums. `deviation`
is null where it exceeds 64 bits. Extra columns, whatever their names, are not read; texts are none here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectors
from .vectors import blocks

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
TOLERANCE, MOST_ITERATIONS = 1e-14, 500
_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n, from the exact integer n*x - S."""
    return (n * x - sums) / n


def fit_sums(packs: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """Number of vectors, and their sums by dimension, exact."""

    def add(total: np.ndarray, x: np.ndarray) -> None:
        total[0] += len(x)
        total[1:] += x.sum(axis=0)

    total = vectors.summed(packs, d, (1 + d,), np.int64, add)
    return int(total[0]), total[1:]


def covariance_product(packs: DataFrame, n: int, sums: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, float]:
    """V times basis, and V's trace."""
    d, m = basis.shape

    def add(total: np.ndarray, x: np.ndarray) -> None:
        y = centred(x, n, sums)
        total[:, :m] += y.T @ (y @ basis)
        total[:, m] += (y * y).sum(axis=0)

    total = vectors.summed(packs, d, (d, m + 1), np.float64, add) / n
    return total[:, :m], float(total[:, m].sum())


def orthonormal(columns: np.ndarray, against: np.ndarray | None = None) -> np.ndarray:
    """An orthonormal basis of columns (those that depend on others, or on `against`, go), orthogonal to `against`."""
    for _ in range(2):
        if against is not None:
            columns = columns - against @ (against.T @ columns)
        norm = np.linalg.norm(columns, axis=0)
        columns = columns[:, norm > 1e-300] / norm[norm > 1e-300]
        if not columns.shape[1]:
            return columns
        u, s, _ = np.linalg.svd(columns, full_matrices=False)
        columns = u[:, s > 1e-10 * s[0]]
    return columns


def lobpcg(product, d: int, k: int, tolerance: float = TOLERANCE, most: int = MOST_ITERATIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The k leading eigenvalues, eigenvectors and residual norms of the matrix that product(block) multiplies with (and whose trace it returns)."""
    block = min(d, 2 * k)
    x = orthonormal(np.random.default_rng(0).standard_normal((d, block)))
    rest, best, stale = np.zeros((d, 0)), np.inf, 0
    for _ in range(most):
        q = np.hstack([x, orthonormal(rest, x)]) if rest.shape[1] else x
        w, trace = product(q)
        h = q.T @ w
        values, u = np.linalg.eigh((h + h.T) / 2)
        values, u = values[::-1][:block], u[:, ::-1][:, :block]
        new, residual = q @ u, w @ u - (q @ u) * values
        direction = q[:, x.shape[1] :] @ u[x.shape[1] :]
        norms = np.linalg.norm(residual, axis=0)[:k]
        x, worst = new, float(norms.max())
        found = values[:k], x[:, :k], norms, trace
        if values[0] <= 0 or worst <= tolerance * values[0] or q.shape[1] >= d:
            break
        stale = 0 if worst < 0.5 * best else stale + 1
        best = min(best, worst)
        if stale >= 3 and best <= 1e-11 * values[0]:
            break
        rest = np.hstack([residual, direction])
    else:
        raise RuntimeError(f"no certified components after {most} iterations: residual {worst:.3g} of {values[0]:.3g}")
    return found


def _whitened(n: int, sums: np.ndarray, matrix: np.ndarray):
    def run(x: np.ndarray) -> np.ndarray:
        return centred(x, n, sums) @ matrix

    return run


def identity_error(packs: DataFrame, n: int, d: int, white) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity; two passes, centred before multiplying."""

    def means(total: np.ndarray, x: np.ndarray) -> None:
        total += white(x).sum(axis=0)

    k = white(np.zeros((1, d), np.int64)).shape[1]
    mean = vectors.summed(packs, d, (k,), np.float64, means) / n

    def squares(total: np.ndarray, x: np.ndarray) -> None:
        z = white(x) - mean
        total += z.T @ z

    return float(np.abs(vectors.summed(packs, d, (k, k), np.float64, squares) / n - np.eye(k)).max())


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sums of (n*x - S)^2, in 64 bits where they fit, else in Python's integers."""
    y = n * x - sums
    if float(np.abs(y).max(initial=0)) ** 2 * x.shape[1] < 2.0**62:
        return (y * y).sum(axis=1).tolist()
    exact = (y.astype(object) ** 2).sum(axis=1)
    return [int(v) if v < 2**63 else None for v in exact]


def whiten(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """rows: vec_id, vector. One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    good, d = vectors.usable(rows, scale)
    empty = rows.sparkSession.createDataFrame([], _SCHEMA)
    if not d:
        return empty
    packs = vectors.packed(good, d, scale, shift, {"vec_id": "long"}, "vectors")
    n, sums = fit_sums(packs, d)
    values, axes, _, trace = lobpcg(lambda q: covariance_product(packs, n, sums, q), d, min(components, d))
    live = values > max(values[0], 0) * d * 2.0**-52
    values, axes = values[live], axes[:, live]
    if not len(values):
        return empty
    white = _whitened(n, sums, axes / np.sqrt(values))
    error, share = identity_error(packs, n, d, white), values / trace

    def run(batches):
        k = len(values)
        for x, row in blocks(batches, d):
            z, ids, dev = white(x), row["vec_id"].values, pa.array(_deviation(x, n, sums), pa.int64())
            at = np.repeat(np.arange(len(x)), k)
            which = np.tile(np.arange(k), len(x))
            columns = [ids.take(pa.array(at)), pa.array(which + 1, pa.int32()), pa.array(np.full(len(at), n)), dev.take(pa.array(at)), pa.array(z.ravel()), pa.array(share[which]), pa.array(np.full(len(at), error))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return packs.mapInArrow(run, _SCHEMA)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(vectors.embeddings(spark, sf_dir))
