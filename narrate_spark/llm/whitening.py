"""Whitening of embeddings by a Cholesky factor and one-sided Jacobi rotations.

The scatter of the centred vectors is summed on Spark, and only matrices of the
size dimension x dimension reach the driver, whatever the number of vectors.  The
covariance is factored by a Cholesky decomposition with diagonal pivoting,
``P' V P = L L'``.  One-sided Jacobi rotates pairs of columns of ``L`` itself until
all are orthogonal, ``L J = U diag(s)``: squared column norms are the eigenvalues
of ``V`` and normalised columns its eigenvectors.  ``V`` itself is never
diagonalised, so small eigenvalues keep their relative precision.

Entries are read as whole numbers ``floor(scale * c) + shift``.  Vectors are
centred by the nearest whole numbers to their means before they are multiplied,
and what the means are off is taken out of the sum, so scatters are sums of whole
numbers: as long as these stay below 2**53, they are exact and the same in any order
of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrate_spark.llm import common

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
# Scaled entries beyond this count as this: whole numbers that doubles hold exactly.
LARGEST = 1 << 53
# Rows that are multiplied at a time.
ROWS = 4096
_EPS = float(np.finfo(np.float64).eps)
_LONG = (1 << 63) - 1

_WHITE = pa.schema(
    [("vec_id", pa.int64()), ("component", pa.int32()), ("deviation", pa.int64()), ("whitened", pa.float64())]
)


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with ``L L' = a``, its rows in the order of ``a`` and its columns in the order of pivots.

    It has as many columns as ``a`` has rank to double precision.
    """
    n = len(a)
    a = a.astype(np.float64, copy=True)
    low = np.zeros((n, n))
    left = np.ones(n, bool)
    least = n * _EPS * float(np.max(np.diag(a), initial=0.0))
    for k in range(n):
        diagonal = np.where(left, np.diag(a), -np.inf)
        p = int(np.argmax(diagonal))
        if diagonal[p] <= least:
            return low[:, :k]
        column = np.where(left, a[:, p], 0.0) / np.sqrt(diagonal[p])
        low[:, k] = column
        left[p] = False
        a -= np.outer(column, column)
    return low


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of 0 to n - 1 in rounds of disjoint pairs."""
    m = n + n % 2
    ring = np.arange(1, m)
    for _ in range(m - 1):
        order = np.r_[0, ring]
        i, j = order[: m // 2], order[: m // 2 - 1 : -1]
        real = (i < n) & (j < n)
        yield np.minimum(i, j)[real], np.maximum(i, j)[real]
        ring = np.roll(ring, 1)


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``factor factor'``, falling, and their unit eigenvectors as columns.

    Columns are rotated in pairs until all are orthogonal to double precision.
    """
    # the largest entry becomes 1, so squares neither overflow nor vanish
    size = float(np.max(np.abs(factor), initial=0.0)) or 1.0
    u = factor / size
    n = u.shape[1]
    for _ in range(sweeps):
        turned = False
        for i, j in _rounds(n):
            x, y = u[:, i], u[:, j]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            turn = np.abs(gamma) > _EPS * np.sqrt(alpha * beta)
            if not turn.any():
                continue
            turned = True
            gamma_ = np.where(turn, gamma, 1.0)
            zeta = (beta - alpha) / (2 * gamma_)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            t = np.where(turn, t, 0.0)
            c = 1 / np.hypot(1.0, t)
            s = c * t
            u[:, i], u[:, j] = c * x - s * y, s * x + c * y
        if not turned:
            break
    norms = np.sqrt((u * u).sum(0))
    order = np.argsort(-norms, kind="stable")
    return (norms[order] * size) ** 2, u[:, order] / norms[order]


@dataclass(frozen=True)
class Whitening:
    """Fitted centre, components and eigenvalues; all arrays are of the size of a vector at most, or d x d."""

    n: int
    sums: list[int]
    centre: np.ndarray
    off: np.ndarray
    trace: float
    eigenvalues: np.ndarray
    components: np.ndarray


def _vectors(b: pa.RecordBatch, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows that are used, and their scaled entries as whole doubles."""
    column = b.column("vector")
    starts = column.offsets.to_numpy()
    values = column.values.slice(starts[0], starts[-1] - starts[0])
    starts = starts - starts[0]
    flat = values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null entry is not a number
    sizes = np.diff(starts)
    bad = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(~np.isfinite(flat), out=bad[1:])
    used = np.flatnonzero((bad[starts[1:]] == bad[starts[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False))
    wide = int(sizes[used].max(initial=0)) if width is None else width
    out = np.zeros((len(used), wide))
    if len(used):
        where = np.arange(wide) < sizes[used][:, None]
        at = starts[:-1][used][:, None] + np.arange(wide)
        out[where] = flat[at[where]]
    with np.errstate(over="ignore"):
        return used, np.clip(np.floor(SCALE * out), -LARGEST, LARGEST)


def _blocks(batches: Iterator[pa.RecordBatch], width: int | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            b = whole.slice(at, ROWS)
            used, z = _vectors(b, width)
            yield b, used, z


def _total(rows: DataFrame, size: int) -> np.ndarray:
    """Sum of the row arrays (i, values) of all tasks, as one matrix of ``size`` columns."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, v in zip(b.column("i").to_pylist(), b.column("v"), strict=True):
                sums[i] = sums.get(i, 0.0) + v.values.to_numpy()
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))],
                ["i", "v"],
            )

    # each matrix row is summed in one task, from one row per task of the scan
    total = rows.repartition("i").mapInArrow(add, "i int, v array<double>").collect()
    out = np.zeros((max((r["i"] for r in total), default=-1) + 1, size))
    for r in total:
        out[r["i"]] = r["v"]
    return out


def _send(matrix: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(range(len(matrix)), pa.int32()), pa.array(matrix.tolist(), pa.list_(pa.float64()))], ["i", "v"]
    )


def fit(vectors: DataFrame) -> Whitening:
    """Fit to all rows of ``vectors`` (vector: an array of numbers) but null vectors and those with entries that are no finite numbers.

    A vector shorter than the longest one counts as having zeros behind.  Without
    a row, or where all vectors are the same, there is no component.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, used, z in _blocks(batches, None):
            n += len(used)
            if z.shape[1] > len(high):
                high, low = (np.pad(h, (0, z.shape[1] - len(h))) for h in (high, low))
            x = z.astype(np.int64)
            high[: z.shape[1]] += (x >> 32).sum(0)
            low[: z.shape[1]] += (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, len(high)), pa.int32()), pa.array([n, *high.tolist()]), pa.array([0, *low.tolist()])],
            ["i", "high", "low"],
        )

    parts = vectors.select("vector").mapInArrow(sums, "i int, high bigint, low bigint")
    wide = "decimal(38,0)"
    rows = parts.groupBy("i").agg(F.sum(F.col("high").cast(wide)).alias("h"), F.sum(F.col("low").cast(wide)).alias("l"))
    total = {r["i"]: (int(r["h"]) << 32) + int(r["l"]) if r["i"] >= 0 else int(r["h"]) for r in rows.collect()}
    n, width = total.pop(-1, 0), len(total)
    scaled = [total[i] for i in range(width)]
    # the nearest whole number to each mean, and what it is off
    centre = [(2 * s + n) // (2 * n) for s in scaled] if n else [0] * width
    off = np.array([(s - n * c) / n for s, c in zip(scaled, centre, strict=True)]) if n else np.zeros(width)
    middle = np.array(centre, np.float64)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((width, width))
        for _, used, z in _blocks(batches, width):
            z = z[: len(used)] - middle
            out += z.T @ z
        yield _send(out)

    x_sums = [s + n * SHIFT for s in scaled]
    if not n or not width:
        return Whitening(n, x_sums, middle, off, 0.0, np.zeros(0), np.zeros((width, 0)))
    covariance = _total(vectors.select("vector").mapInArrow(scatter, "i int, v array<double>"), width) / n - np.outer(off, off)
    values, columns = one_sided_jacobi(pivoted_cholesky(covariance))
    # a sign that does not depend on the rotations: the largest entry is positive
    if columns.shape[1]:
        columns = columns * np.sign(columns[np.argmax(np.abs(columns), axis=0), np.arange(columns.shape[1])])
    return Whitening(n, x_sums, middle, off, float(np.trace(covariance)), values, columns)


def _project(w: Whitening, z: np.ndarray, components: int) -> np.ndarray:
    return ((z - w.centre) - w.off) @ (w.components[:, :components] / np.sqrt(w.eigenvalues[:components]))


def identity_error(vectors: DataFrame, w: Whitening, components: int = COMPONENTS) -> float | None:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity."""
    size = min(components, len(w.eigenvalues))
    if not size:
        return None
    width = len(w.centre)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((size + 1, size))
        for _, _, z in _blocks(batches, width):
            p = _project(w, z, size)
            out[:size] += p.T @ p
            out[size] += p.sum(0)
        yield _send(out)

    total = _total(vectors.select("vector").mapInArrow(moments, "i int, v array<double>"), size) / w.n
    return float(np.abs(total[:size] - np.outer(total[size], total[size]) - np.eye(size)).max())


def transform(vectors: DataFrame, w: Whitening, components: int = COMPONENTS) -> DataFrame:
    """One row per used row of ``vectors`` (vec_id, vector) and component: vec_id, component, deviation, whitened.

    ``deviation`` is exact, and null where it passes the range of a long.
    Components whose eigenvalue is 0 to double precision have no row.
    """
    size = min(components, len(w.eigenvalues))
    width = len(w.centre)
    centre = [int(c) for c in w.centre]
    rest = [s - w.n * (c + SHIFT) for s, c in zip(w.sums, centre, strict=True)]

    def deviations(z: np.ndarray) -> list[int | None] | np.ndarray:
        y = z - w.centre
        bound = w.n * (int(np.abs(y).max(initial=0.0)) + 1) + max(map(abs, rest), default=0)
        if width * bound * bound <= _LONG:
            d = w.n * y.astype(np.int64) - np.array(rest, np.int64)
            return (d * d).sum(1)
        exact = (
            sum((w.n * (int(v) - c) - r) ** 2 for v, c, r in zip(row, centre, rest, strict=True)) for row in z.tolist()
        )
        return [d if d <= _LONG else None for d in exact]

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, used, z in _blocks(batches, width):
            ids = b.column("vec_id").take(pa.array(used))
            rows = pa.array(np.repeat(np.arange(len(used)), size))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(rows),
                    pa.array(np.tile(np.arange(1, size + 1), len(used)), pa.int32()),
                    pa.array(deviations(z), pa.int64()).take(rows),
                    pa.array(_project(w, z, size).ravel(), pa.float64()),
                ],
                schema=_WHITE,
            )

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "vector")
    return rows.mapInArrow(whiten, "vec_id bigint, component int, deviation bigint, whitened double")


def whiten_embeddings(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitened components of all rows of ``vectors`` (vec_id, vector), with the figures of the fit.

    Returns vec_id, component (from 1, by falling eigenvalue), n, deviation,
    whitened, explained and identity_error.  Rows whose vector is null or holds
    null or non-finite entries are left out; a vector shorter than the longest one
    counts as having zeros behind, and an entry whose scaled value passes 2**53 as
    that.  Repeated rows and rows without vec_id count like others.  An empty table,
    or one in which all vectors are the same, gives no row; only components whose
    eigenvalue is above 0 to double precision do.  Other columns are not read.

    ``vectors`` is read four times (sums, scatter, check, result), each time in
    place; nothing of the size of the rows is shuffled, kept or sent to the driver.
    """
    w = fit(vectors)
    size = min(components, len(w.eigenvalues))
    error = identity_error(vectors, w, components)
    shares = F.array(*(F.lit(float(v / w.trace)) for v in w.eigenvalues[:size])).cast("array<double>")
    return transform(vectors, w, components).select(
        "vec_id",
        "component",
        F.lit(w.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("component") - 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """All ``embeddings``, whitened to their first eight components."""
    return whiten_embeddings(common.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")))
