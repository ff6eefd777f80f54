"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its factor.

Entries become integers ``floor(scale * c) + shift``. One pass adds up counts and sums per dimension. A second
subtracts the nearest integer to each mean before multiplying, so that products stay small, and adds up the
scatter; whole numbers below 2^53 are exact in doubles and partial sums are decimals, so the result does not
depend on how the rows are dealt to tasks. What the rounding of the means left over is taken off in rational
arithmetic, which leaves a covariance with one rounding per entry. Only these sums, of a size given by the
dimension alone, reach the driver.

There the covariance is factored with diagonal pivoting into P'LL'P, which also gives its rank, and the columns
of L are rotated in pairs until they are orthogonal. Their squared norms are the eigenvalues, the normalised
columns, put back in order, the components; no product of L with itself is formed, so small eigenvalues keep
their digits.

Defined results: rows whose vector is null, empty or holds null or non-finite entries are dropped, and so are
vectors of another length than the most frequent one (the longer among equals). Repeated rows count each for
itself; labels, null ids and columns with clashing names do not matter. An empty table gives an empty table.
Components beyond the rank of the covariance have no scale and are left out. A deviation that no long holds is
null. Entries of 2^40 and more after scaling are refused, as their products could not be added exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, SHIFT = 64, 1_000_000
# Rows of one block of products.
BLOCK = 4_096
EXACT = 2.0**53
LARGEST = 2.0**40
MOST_SWEEPS = 60


@dataclass(frozen=True)
class Whitening:
    """Fitted sums and components. ``components`` has one unit row per component, by falling eigenvalue."""

    n: int
    sums: list[int] = field(default_factory=list)
    eigenvalues: np.ndarray | None = None
    components: np.ndarray | None = None
    trace: float = 0.0

    @property
    def centre(self) -> list[int]:
        """The nearest integer to each mean."""
        return [math.floor(Fraction(s, self.n) + Fraction(1, 2)) for s in self.sums]


def fitting(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v) of the rows that can be used: doubles of one length, all finite."""
    v = F.col("v")
    given = vectors.select(vectors[id].alias("id"), vectors[vector].cast("array<double>").alias("v"))
    finite = ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    usable = given.filter(v.isNotNull() & (F.size(v) > 0) & finite)
    lengths = usable.groupBy(F.size(v).alias("d")).agg(F.count("*").alias("n"))
    usual = lengths.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return usable.filter(F.size(v) == F.lit(usual[0]["d"] if usual else 0))


def _matrix(column: pa.Array, scale: int, shift: int) -> np.ndarray:
    """Integer entries, one row per vector, exact in doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(scale * flat.reshape(len(column), -1)) + shift


def _blocks(batches: Iterator[pa.RecordBatch], scale: int, shift: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            yield part.column(0), _matrix(part.column(1), scale, shift)


def _added(rows: DataFrame, of_block, kind: str, scale: int, shift: int) -> dict[int, object]:
    """Totals of the arrays ``of_block`` makes of each block, by position; ``kind`` is the type of the totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for _, x in _blocks(batches, scale, shift):
            own = of_block(x)
            total = own if total is None else total + own
        if total is not None:
            values = total.ravel().tolist()
            texts = [str(v) if isinstance(v, int) else repr(v) for v in values]
            yield pa.record_batch([pa.array(range(len(values)), pa.int32()), pa.array(texts)], names=["at", "value"])

    partial = rows.mapInArrow(run, "at int, value string")
    totals = partial.groupBy("at").agg(F.sum(F.col("value").cast(kind)).alias("total")).collect()
    return {row["at"]: row["total"] for row in totals}


def _whole(x: np.ndarray) -> np.ndarray:
    """Whole numbers as Python integers, which add without bounds."""
    return np.vectorize(int, otypes=[object])(x)


def fit(rows: DataFrame, scale: int = SCALE, shift: int = SHIFT, most: int = 32) -> Whitening:
    """Sums and the leading components of rows (id, v) from ``fitting``."""

    def sums_of(x: np.ndarray) -> np.ndarray:
        if np.abs(x).max() > LARGEST:
            raise ValueError("an entry is too large to be added exactly")
        return _whole(np.append(x.sum(axis=0), len(x)))

    first = _added(rows, sums_of, "decimal(38,0)", scale, shift)
    if not first:
        return Whitening(0)
    sums = [int(first[i]) for i in range(len(first) - 1)]
    fitted = Whitening(int(first[len(first) - 1]), sums)
    centre = np.array(fitted.centre, dtype=np.float64)

    def scatter_of(x: np.ndarray) -> np.ndarray:
        y = x - centre
        if np.abs(y).max() ** 2 * len(y) < EXACT:
            return _whole(y.T @ y)
        whole = _whole(y)  # products of such entries need integers of any size
        return whole.T @ whole

    second = _added(rows, scatter_of, "decimal(38,0)", scale, shift)
    d, n = len(sums), fitted.n
    scatter = [[int(second[i * d + j]) for j in range(d)] for i in range(d)]
    left = [s - n * c for s, c in zip(sums, fitted.centre)]
    covariance = np.array([[float(Fraction(n * scatter[i][j] - left[i] * left[j], n * n)) for j in range(d)] for i in range(d)])
    eigenvalues, components = eigen(covariance)
    kept = slice(0, min(most, len(eigenvalues)))
    return Whitening(n, sums, eigenvalues[kept], components[kept], float(np.trace(covariance)))


def pivoted_cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with matrix[order][:, order] = L L'; L has as many columns as the matrix has rank."""
    d = len(matrix)
    left, order = matrix.astype(np.float64).copy(), np.arange(d)
    factor = np.zeros((d, d))
    limit = d * np.finfo(np.float64).eps * max(np.diag(left).max(initial=0.0), 0.0)
    for k in range(d):
        rest = np.diag(left)[k:]
        pivot = k + int(np.argmax(rest))
        if left[pivot, pivot] <= limit:
            return factor[:, :k], order
        for table in (left, factor):
            table[[k, pivot]] = table[[pivot, k]]
        left[:, [k, pivot]] = left[:, [pivot, k]]
        order[[k, pivot]] = order[[pivot, k]]
        factor[k, k] = math.sqrt(left[k, k])
        factor[k + 1 :, k] = left[k + 1 :, k] / factor[k, k]
        left[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """The factor with its columns rotated in pairs until they are orthogonal, by falling norm."""
    columns = np.array(factor.T, dtype=np.float64)  # one row per column, for contiguous rotations
    r = len(columns)
    eps = np.finfo(np.float64).eps
    for _ in range(MOST_SWEEPS):
        rotated = False
        for p in range(r - 1):
            for q in range(p + 1, r):
                a, b, c = columns[p] @ columns[p], columns[q] @ columns[q], columns[p] @ columns[q]
                if abs(c) <= eps * math.sqrt(a * b):
                    continue
                rotated = True
                zeta = (b - a) / (2 * c)
                t = math.copysign(1.0, zeta) / (abs(zeta) + math.hypot(1.0, zeta))
                cos = 1 / math.hypot(1.0, t)
                sin = cos * t
                columns[p], columns[q] = cos * columns[p] - sin * columns[q], sin * columns[p] + cos * columns[q]
        if not rotated:
            break
    norms = np.linalg.norm(columns, axis=1)
    return columns[np.argsort(-norms, kind="stable")].T


def eigen(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and unit eigenvectors as rows, up to the rank."""
    factor, order = pivoted_cholesky(covariance)
    rotated = one_sided_jacobi(factor)
    norms = np.linalg.norm(rotated, axis=0)
    components = np.zeros_like(rotated.T)
    components[:, order] = (rotated / norms).T
    # One fixed sign, so that repeated runs agree: the largest entry is positive.
    largest = np.abs(components).argmax(axis=1)
    components *= np.sign(components[np.arange(len(components)), largest])[:, None]
    return norms**2, components


def project(x: np.ndarray, fitted: Whitening) -> np.ndarray:
    """Whitened coordinates of integer rows. Rows are centred on whole numbers first, which is exact."""
    centre = fitted.centre
    rest = np.array([float(Fraction(s, fitted.n) - c) for s, c in zip(fitted.sums, centre)])
    centred = (x - np.array(centre, dtype=np.float64)) - rest
    return centred @ fitted.components.T / np.sqrt(fitted.eigenvalues)


def identity_error(rows: DataFrame, fitted: Whitening, scale: int = SCALE, shift: int = SHIFT) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over all rows."""
    k = len(fitted.eigenvalues)
    if not k:
        return 0.0

    def moments(x: np.ndarray) -> np.ndarray:
        w = project(x, fitted)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    totals = _added(rows, moments, "double", scale, shift)
    made = np.array([totals[i] for i in range(k * (k + 1))]).reshape(k + 1, k) / fitted.n
    return float(np.abs(made[:k] - np.outer(made[k], made[k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT, most: int = 32) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each row and component."""
    rows = fitting(vectors, id, vector)
    fitted = fit(rows, scale, shift, most)
    n, centre = fitted.n, fitted.centre if fitted.n else []
    k = 0 if fitted.n == 0 else len(fitted.eigenvalues)
    error = identity_error(rows, fitted, scale, shift) if k else 0.0
    left = [s - n * c for s, c in zip(fitted.sums, centre)]
    kind = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, scale, shift):
            if not k:
                continue
            rows_in = np.repeat(np.arange(len(x)), k)
            found = deviations(x, n, centre, left)
            yield pa.record_batch(
                [ids.take(pa.array(rows_in)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array([found[i] for i in rows_in], pa.int64()), pa.array(project(x, fitted).ravel())],
                names=["id", "component", "deviation", "whitened"],
            )

    schema = T.StructType([T.StructField("id", kind), T.StructField("component", T.IntegerType()),
                           T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType())])
    shares = [float(e) / fitted.trace for e in fitted.eigenvalues] if k else [0.0]
    share = F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("component"))
    return rows.mapInArrow(run, schema).select(
        F.col("id").alias(id), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        share.alias("explained"), F.lit(error).alias("identity_error"),
    )


def deviations(x: np.ndarray, n: int, centre: list[int], left: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 per row, exactly; null where no long holds it."""
    y = x - np.array(centre, dtype=np.float64)
    bound = float(np.abs(y).max(initial=0.0)) * n + max(map(abs, left), default=0)
    if bound**2 * max(len(left), 1) < 2.0**62:
        scaled = y.astype(np.int64) * n - np.array(left, dtype=np.int64)
        return (scaled**2).sum(axis=1).tolist()
    totals = [sum((n * int(a) - b) ** 2 for a, b in zip(row, left)) for row in y.tolist()]
    return [t if t < 2**63 else None for t in totals]
