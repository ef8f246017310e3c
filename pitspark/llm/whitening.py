"""Whitening of embeddings: exact distributed covariance, leading eigenvectors by tridiagonalisation, broadcast projection.

Entries become whole numbers, so sums and centred products are exact integers and do not depend on how rows are dealt out.
Only the d x d covariance reaches the driver. It is brought to tridiagonal form by Householder reflections; its leading
eigenvalues are bracketed by counting sign changes in Sturm sequences, their vectors found by inverse iteration in which
vectors of close eigenvalues are made orthogonal to each other. The few components then go to all tasks.
"""
from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
LARGEST = float(2**52)  # of a scaled entry: whole numbers beyond it are not exact in double precision
EXACT = float(2**53)
LIMB = 60
EPS = np.finfo(float).eps


# eigenvectors of one small matrix

def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and the orthogonal Q with Q' M Q tridiagonal, by Householder reflections."""
    a = np.array(matrix, float)
    n = len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1:, k]
        size = np.linalg.norm(x)
        if size == 0 or not np.any(x[1:]):
            continue
        image = -np.copysign(size, x[0])
        v = x.copy()
        v[0] -= image
        v /= np.linalg.norm(v)
        below = a[k + 1:, k + 1:]
        p = below @ v
        w = p - (v @ p) * v
        below -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1:, k] = a[k, k + 1:] = 0
        a[k + 1, k] = a[k, k + 1] = image
        q[:, k + 1:] -= 2 * np.outer(q[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def count_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eigenvalues of the tridiagonal matrix under each of ``at``: the negative terms of the Sturm sequence there."""
    tiny = np.finfo(float).tiny / EPS
    held = lambda term: np.where(np.abs(term) < tiny, -tiny, term)  # a term of 0 counts as negative
    term = held(diagonal[0] - at)
    count = (term < 0).astype(int)
    for d, e in zip(diagonal[1:], off):
        term = held(d - at - e * e / term)
        count += term < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` largest eigenvalues, falling, each by bisection until its bracket is as small as doubles allow."""
    n = len(diagonal)
    radius = np.concatenate([[0], np.abs(off)]) + np.concatenate([np.abs(off), [0]])
    low, high = (diagonal - radius).min(), (diagonal + radius).max()
    edge = EPS * max(abs(low), abs(high)) * n
    wanted = n - 1 - np.arange(min(most, n))  # places in rising order
    lows, highs = np.full(len(wanted), low - edge), np.full(len(wanted), high + edge)
    for _ in range(2000):
        middle = (lows + highs) / 2
        open_ = (middle > lows) & (middle < highs) & (highs - lows > 2 * EPS * np.maximum(np.abs(lows), np.abs(highs)))
        if not open_.any():
            break
        under = count_below(diagonal, off, middle) > wanted
        highs, lows = np.where(open_ & under, middle, highs), np.where(open_ & ~under, middle, lows)
    return (lows + highs) / 2


def solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """x of (T - shift) x = right by elimination with row exchanges; a pivot of 0 counts as ``least``."""
    n = len(diagonal)
    d, up, far, low, x = diagonal - shift, np.append(off, 0.0), np.zeros(n), off.copy(), right.copy()
    for i in range(n - 1):
        if abs(low[i]) > abs(d[i]):
            d[i], low_i = low[i], d[i]
            up[i], d[i + 1] = d[i + 1], up[i]
            far[i], up[i + 1] = up[i + 1], 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
        else:
            low_i = low[i]
        if d[i] == 0:
            d[i] = least
        f = low_i / d[i]
        d[i + 1] -= f * up[i]
        up[i + 1] -= f * far[i]
        x[i + 1] -= f * x[i]
    if d[-1] == 0:
        d[-1] = least
    for i in range(n - 1, -1, -1):
        x[i] -= (up[i] * x[i + 1] if i + 1 < n else 0.0) + (far[i] * x[i + 2] if i + 2 < n else 0.0)
        x[i] /= d[i]
        if abs(x[i]) > 1e150:
            x /= abs(x[i])
    return x


def leading_components(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns; each vector's largest entry is positive.

    Vectors whose eigenvalues lie within a thousandth of the largest one of each other form a cluster and are kept
    orthogonal to each other while they are iterated; Rayleigh quotients give the final eigenvalues."""
    matrix = np.asarray(matrix, float)
    n = len(matrix)
    size = np.abs(matrix).max(initial=0.0)
    if n == 0 or size == 0:
        return np.zeros(min(most, n)), np.eye(n)[:, :min(most, n)]
    scaled = matrix / size
    diagonal, off, q = tridiagonal(scaled)
    values = leading_eigenvalues(diagonal, off, most)
    norm = max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0))
    rng = np.random.default_rng(n)
    vectors = np.empty((n, len(values)))
    first = 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            first = k
        # equal eigenvalues get shifts a few roundings apart, so that their systems differ
        shift = value - (k - first) * 4 * EPS * norm
        x = rng.standard_normal(n)
        for _ in range(6):
            for _ in range(2):
                x -= vectors[:, first:k] @ (vectors[:, first:k].T @ x)
            x /= np.linalg.norm(x)
            x = solve_shifted(diagonal, off, shift, x, EPS * norm)
            x /= np.linalg.norm(x)
        for _ in range(2):
            x -= vectors[:, first:k] @ (vectors[:, first:k].T @ x)
            x /= np.linalg.norm(x)
        vectors[:, k] = x
    found = q @ vectors
    found /= np.linalg.norm(found, axis=0)
    found *= np.sign(found[np.abs(found).argmax(0), np.arange(found.shape[1])])
    values = np.einsum("ik,ij,jk->k", found, scaled, found) * size
    order = np.argsort(-values, kind="stable")
    return values[order], found[:, order]


# the distributed part

def usable(vector: str, length: int | None = None) -> Column:
    """Vectors that hold finite entries only, and ``length`` of them."""
    scaled = lambda x: F.abs(x.cast("double") * SCALE)
    fine = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(scaled(x) < LARGEST, F.lit(False)))
    return fine if length is None else fine & (F.size(vector) == length)


def whole_numbers(column: pa.ListArray, length: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, length)
    return np.floor(values * SCALE).astype(np.int64) + SHIFT


def sums(fit: DataFrame, vector: str, length: int) -> tuple[int, np.ndarray]:
    """Number of vectors and the exact sums per dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(length, object)
        for batch in batches:
            if batch.num_rows:
                x = whole_numbers(batch.column(0), length)
                n += len(x)
                total += x.sum(0).astype(object) if len(x) * (LARGEST + SHIFT) < 2**63 else x.astype(object).sum(0)
        if n:
            from decimal import Decimal

            yield pa.RecordBatch.from_arrays([pa.array(range(length), pa.int32()), pa.array([n] * length, pa.int64()),
                                              pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], names=["dim", "n", "total"])

    parts = fit.select(vector).mapInArrow(run, "dim int, n long, total decimal(38,0)")
    rows = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("dim").collect()
    return (rows[0]["n"], np.array([int(r["total"]) for r in rows], object)) if rows else (0, np.zeros(length, object))


def products(z: np.ndarray) -> np.ndarray:
    """z' z in whole numbers without rounding."""
    most = float(np.abs(z).max(initial=0))
    if most * most * len(z) < EXACT:
        f = z.astype(float)
        return (f.T @ f).astype(np.int64)
    return z.astype(object).T.dot(z.astype(object))


def covariance(fit: DataFrame, vector: str, length: int, n: int, total: np.ndarray) -> np.ndarray:
    """Covariance with divisor ``n``, rounded once at the end.

    Entries are centred on the mean's nearest whole number before they are multiplied; what that leaves of the mean, half
    at most, is taken off in whole numbers."""
    centre = np.array([(2 * int(t) + n) // (2 * n) for t in total], np.int64)
    upper = np.triu_indices(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        total_products = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = products(whole_numbers(batch.column(0).slice(at, 4096), length) - centre).astype(object)
                total_products = part if total_products is None else total_products + part
        if total_products is not None:
            found = [int(v) for v in total_products[upper]]
            limb = lambda values: pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), limb([v >> LIMB for v in found]),
                                              limb([v & ((1 << LIMB) - 1) for v in found])], names=["i", "j", "high", "low"])

    parts = fit.select(vector).mapInArrow(run, "i int, j int, high decimal(38,0), low decimal(38,0)")
    rows = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    left = [int(t) - n * int(c) for t, c in zip(total, centre)]
    out = np.zeros((length, length))
    for r in rows:
        i, j = r["i"], r["j"]
        out[i, j] = out[j, i] = float(Fraction(n * ((int(r["high"]) << LIMB) + int(r["low"])) - left[i] * left[j], n * n))
    return out


def scatter_of(count: int, mean: np.ndarray, scatter: np.ndarray, other: tuple) -> tuple:
    """Two sets' numbers, means and centred products as those of their union."""
    n, m, s = other
    both = count + n
    if not both:
        return count, mean, scatter
    gap = m - mean
    return both, mean + gap * (n / both), scatter + s + np.outer(gap, gap) * (count * n / both)


def whitened_covariance(fit: DataFrame, vector: str, length: int, mean: np.ndarray, transform: np.ndarray) -> np.ndarray:
    """Covariance of the projected vectors, centred within each block and joined by blocks, first within tasks, then within
    at most 256 groups of tasks."""
    k = transform.shape[1]
    schema = "part int, n long, mean array<double>, scatter array<double>"

    def joined(items) -> tuple:
        out = (0, np.zeros(k), np.zeros((k, k)))
        for item in items:
            out = scatter_of(*out, item)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks():
            for batch in batches:
                if batch.num_rows:
                    w = (whole_numbers(batch.column(0), length) - mean) @ transform
                    m = w.mean(0)
                    yield len(w), m, (w - m).T @ (w - m)
        n, m, s = joined(blocks())
        if n:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "n": n, "mean": m.tolist(), "scatter": s.ravel().tolist()}],
                                             pa.schema([("part", pa.int32()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("scatter", pa.list_(pa.float64()))]))

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        n, m, s = joined((a, np.array(b), np.array(c).reshape(k, k)) for a, b, c in zip(group["n"], group["mean"], group["scatter"]))
        return pd.DataFrame({"part": [int(group["part"].iloc[0])], "n": [n], "mean": [m.tolist()], "scatter": [s.ravel().tolist()]})

    rows = fit.select(vector).mapInArrow(run, schema).groupBy(F.col("part") % 256).applyInPandas(merge, schema).orderBy("part").collect()
    n, _, s = joined((r["n"], np.array(r["mean"]), np.array(r["scatter"]).reshape(k, k)) for r in rows)
    return s / max(n, 1)


def deviations(x: np.ndarray, n: int, total: np.ndarray) -> list[int | None]:
    """Sum over the dimensions of (n x - total) squared, exactly; null beyond a 64-bit integer."""
    most = n * max(1, int(np.abs(x).max(initial=0))) + max(abs(int(t)) for t in total)
    if most * most * x.shape[1] < 2**63:
        return ((n * x - total.astype(np.int64)) ** 2).sum(1).tolist()
    centre = np.array([int(t) // n for t in total], np.int64)
    z, left = x - centre, np.array([int(t) - n * int(c) for t, c in zip(total, centre)], object)
    most = n * (int(np.abs(z).max(initial=0)) + 1)
    if most * most * x.shape[1] < 2**63:
        return ((n * z - left.astype(np.int64)) ** 2).sum(1).tolist()
    exact = ((n * z.astype(object) - left) ** 2).sum(1)
    return [int(v) if v < 2**63 else None for v in exact]


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", most: int = 8) -> DataFrame:
    """Whitened leading components of all vectors.

    Rows whose vector is null, is empty, or holds a null, non-finite or (beyond 2**52 once scaled) not exactly
    representable entry are left out, as are vectors shorter than the longest of the others: their last entries are
    missing. Repeated rows count as often as they occur. Components without variance (not above 1e-12 of the largest)
    are not returned, so one vector, or equal ones, give no rows; so does an empty table. Columns other than ``key`` and
    ``vector`` are ignored.

    Result per vector and component: ``key, component`` (from 1), ``n``, ``deviation`` (squared distance from the mean,
    times n squared, exact; null beyond a 64-bit integer), ``whitened, explained, identity_error``.
    """
    spark = rows.sparkSession
    key_type = rows.schema[key].dataType.simpleString()
    out = f"`{key}` {key_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    slim = rows.select(F.col(key), F.col(vector))
    length = slim.where(usable(vector)).agg(F.max(F.size(vector))).first()[0]
    if length is None:
        return spark.createDataFrame([], out)
    fit = slim.where(usable(vector, length))
    n, total = sums(fit, vector, length)
    v = covariance(fit, vector, length, n, total)
    values, vectors = leading_components(v, most)
    held = values > 1e-12 * max(values.max(initial=0.0), 0.0)
    values, vectors = values[held], vectors[:, held]
    if not len(values):
        return spark.createDataFrame([], out)
    mean = np.array([float(Fraction(int(t), n)) for t in total])
    transform = vectors / np.sqrt(values)
    explained = values / np.trace(v)
    error = float(np.abs(whitened_covariance(fit, vector, length, mean, transform) - np.eye(len(values))).max())
    shared = spark.sparkContext.broadcast((mean, transform))  # d x 8 numbers

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, transform = shared.value
        k = transform.shape[1]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = whole_numbers(part.column(1), length)
                m = len(x)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)), pa.array(deviations(x, n, total), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(((x - mean) @ transform).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return fit.mapInArrow(project, out)
