"""Embedding whitening by spectral divide and conquer with QDWH polar decompositions.

Vectors are brought to integers, ``floor(256 * c)``. The fit list holds each
distinct integer vector once, so copies weigh nothing. Its covariance is summed
by tasks from vectors centred with the exact mean. On the driver the covariance,
of the square of the dimension, is split: the unitary polar factor of ``C - shift``
(QDWH iterations: QR based, then Cholesky based) is its matrix sign, which gives
the projector onto the subspace of the eigenvalues above the shift;
orthonormal bases of it and of its complement halve the problem, until
every block is one component. Means and components are sent to the tasks, which
whiten their rows.

Defined cases: null or empty vectors and those with null or non-finite entries
are dropped; of several lengths the commonest counts (the longer of equals),
vectors of others are dropped; integers saturate at 2**31; a deviation that
no long can hold is null; components without variance (a rank-deficient table)
have no rows; equal eigenvalues give any orthonormal basis of their
space; a null vec_id is kept; repeated rows are rows of their own; an empty
table gives no rows. Only vec_id and the vector are read, so other columns may
have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged

#: Integer steps to a unit, components, vectors of a block that is multiplied at once.
SCALE, COMPONENTS, BLOCK = 256, 4, 4096
EPS = np.finfo(np.float64).eps


# --- the spectral decomposition -----------------------------------------------------------

def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric, non-singular matrix, by QDWH."""
    n = len(a)
    x = a / np.linalg.norm(a)
    r = np.linalg.qr(x, mode="r")
    small = np.abs(np.diag(r)).min()
    # 1 / |R^-1| bounds the least singular value from below
    low = 1 / np.linalg.norm(np.linalg.solve(r, np.eye(n))) if small > 0 else 0.0
    low = max(low, EPS / n)
    for _ in range(60):
        d = (4 * (1 / low**2 - 1) / low**2) ** (1 / 3) if low < 1 else 0.0
        root = np.sqrt(1 + d)
        p = root + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low**2) / (low**2 * root)))
        q = (p - 1) ** 2 / 4
        c = p + q - 1
        before = x
        if c > 100:
            both, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(n)]))
            x = q / c * x + (p - q / c) / np.sqrt(c) * both[:n] @ both[n:].T
        else:
            w = np.linalg.cholesky(np.eye(n) + c * x.T @ x)
            x = q / c * x + (p - q / c) * np.linalg.solve(w.T, np.linalg.solve(w, x.T)).T
        x = (x + x.T) / 2
        low = min(1.0, low * (p + q * low**2) / (1 + c * low**2))
        if np.linalg.norm(x - before) <= EPS ** (1 / 3) and 1 - low < 10 * EPS:
            break
    return x


def _bases(projector: np.ndarray, rank: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of a projector's range and of its complement."""
    start = np.random.default_rng(seed).standard_normal((len(projector), rank))
    for _ in range(2):
        start, _ = np.linalg.qr(projector @ start)
    whole, _ = np.linalg.qr(start, mode="complete")
    rest = whole[:, rank:]
    rest, _ = np.linalg.qr(rest - start @ (start.T @ rest))
    return start, rest


def _shifts(a: np.ndarray):
    """Numbers between the least and greatest eigenvalue, best first."""
    diagonal = np.sort(np.diag(a))
    n = len(a)
    spread = np.linalg.norm(a - np.trace(a) / n * np.eye(n)) / n
    middle = (diagonal[(n - 1) // 2] + diagonal[n // 2]) / 2
    for base in (middle, np.trace(a) / n):
        for off in (0.0, 0.0137, -0.0171):
            yield base + off * spread


def split(a: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of two complementary invariant subspaces; None if ``a`` is a multiple of one."""
    n = len(a)
    best = None
    for k, shift in enumerate(_shifts(a)):
        moved = a - shift * np.eye(n)
        if np.linalg.norm(moved) <= least:
            continue
        sign = polar(moved)
        rank = int(round((np.trace(sign) + n) / 2))
        if not 0 < rank < n:
            continue
        high, low = _bases((sign + np.eye(n)) / 2, rank, k)
        left_over = np.linalg.norm(low.T @ a @ high)
        if best is None or left_over < best[0]:
            best = (left_over, high, low)
        if left_over <= 10 * n * EPS * np.linalg.norm(a):
            break
    return best and best[1:]


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a symmetric matrix."""
    n = len(a)
    a = (a + a.T) / 2
    least = EPS * np.linalg.norm(a)
    done, open_ = [], [(a, np.eye(n))]
    while open_:
        block, basis = open_.pop()
        off = block - np.diag(np.diag(block))
        parts = None if len(block) == 1 or np.linalg.norm(off) <= least else split(block, least)
        if parts is None:
            done.append(basis)
            continue
        for part in parts:
            inner = part.T @ block @ part
            open_.append(((inner + inner.T) / 2, basis @ part))
    vectors = np.concatenate(done, axis=1) if done else np.zeros((n, 0))
    vectors /= np.linalg.norm(vectors, axis=0)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# --- Spark: integers, sums, covariances ----------------------------------------------------

def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, dim, x): usable vectors as little-endian 32-bit integers."""

    def run(batches):
        for batch in batches:
            col = batch.column(1)
            values = col.flatten()
            held = np.asarray(values.is_valid())
            flat = np.asarray(values.fill_null(0.0), dtype=np.float64)
            bad = np.append(0, np.cumsum(~(held & np.isfinite(flat))))
            ends = np.append(0, np.cumsum(np.asarray(col.value_lengths().fill_null(0), dtype=np.int64)))
            x = np.clip(np.floor(SCALE * np.where(np.isfinite(flat), flat, 0.0)), -(2**31), 2**31 - 1).astype("<i4")
            rows = np.flatnonzero((np.diff(ends) > 0) & (bad[ends[1:]] == bad[ends[:-1]]))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows)), pa.array(np.diff(ends)[rows], pa.int32()), pa.array([x[ends[r] : ends[r + 1]].tobytes() for r in rows], pa.binary()),
            ], ["vec_id", "dim", "x"])

    rows = small_batches(vectors).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, "vec_id long, dim int, x binary")


def _blocks(batches, column: int):
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.column(column).slice(a, BLOCK).to_pylist()
            yield a, np.frombuffer(b"".join(part), dtype="<i4").reshape(len(part), -1)


def _sums(fit: DataFrame, terms, shape: tuple, kind: str) -> np.ndarray:
    """The sum over all blocks of vectors of ``terms(block)``, an array of ``shape``.

    A task adds up its blocks; tasks' sums are added by a grouping on the place.
    """
    size = int(np.prod(shape))

    def run(batches):
        total = np.zeros(size, dtype=np.int64 if kind == "long" else np.float64)
        some = False
        for _, x in _blocks(batches, 0):
            total += terms(x).ravel()
            some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], ["place", "part"])

    parts = fit.select("x").mapInArrow(run, f"place int, part {kind}")
    whole = F.sum(F.col("part").cast("decimal(38,0)") if kind == "long" else F.col("part"))
    out = np.zeros(size, dtype=object if kind == "long" else np.float64)
    for place, total in parts.groupBy("place").agg(whole).collect():
        out[place] = int(total) if kind == "long" else total
    return out.reshape(shape)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of (n * x - S) ** 2 per vector; None beyond a long."""
    most = n * int(np.abs(x.astype(np.int64)).max(initial=0)) + max(map(abs, sums))
    if most * most * len(sums) < 2**63:
        gap = n * x.astype(np.int64) - np.array(sums, dtype=np.int64)
        return np.einsum("ij,ij->i", gap, gap).tolist()
    gap = n * x.astype(object) - np.array(sums, dtype=object)
    return [v if v < 2**63 else None for v in (gap * gap).sum(axis=1)]


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened,
    explained, identity_error."""
    result = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = staged(integers(vectors, id_col, vector_col), "whiten-rows")
    dims = rows.groupBy("dim").count().orderBy(F.col("count").desc(), F.col("dim").desc()).first()
    if dims is None:
        return rows.sparkSession.createDataFrame([], result)
    d = dims["dim"]
    rows = rows.filter(F.col("dim") == d)
    fit = staged(rows.select("x").distinct(), "whiten-fit")
    n = fit.count()
    sums = _sums(fit, lambda x: x.sum(axis=0, dtype=np.int64), (d,), "long").tolist()
    mean = np.array([s / n for s in sums])

    def products(x):
        y = x - mean
        return y.T @ y

    cov = _sums(fit, products, (d, d), "double") / n
    values, basis = spectrum(cov)
    trace = float(np.trace(cov))
    k = int((values[:components] > d * EPS * max(trace, 0.0)).sum())
    weights = basis[:, :k] / np.sqrt(values[:k])
    explained = values[:k] / trace if k else values[:0]
    middle = _sums(fit, lambda x: ((x - mean) @ weights).sum(axis=0), (k,), "double") / n

    def white(x):
        z = (x - mean) @ weights - middle
        return z.T @ z

    error = float(np.abs(_sums(fit, white, (k, k), "double") / n - np.eye(k)).max(initial=0.0))

    def run(batches):
        for batch in batches:
            for a, x in _blocks([batch], 1):
                m = len(x)
                take = pa.array(np.repeat(np.arange(a, a + m), k))
                each = lambda v, kind: pa.array(np.tile(v, m), kind)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(take), each(np.arange(1, k + 1), pa.int32()), pa.array(np.full(m * k, n), pa.int64()),
                    pa.array([v for v in _deviations(x, n, sums) for _ in range(k)], pa.int64()), pa.array(((x - mean) @ weights).ravel()),
                    each(explained, pa.float64()), pa.array(np.full(m * k, error)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, result)
