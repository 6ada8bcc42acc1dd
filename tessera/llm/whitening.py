"""Whitening of embeddings: centred, projected on principal components, scaled to unit variance.

Components become whole numbers first, floor(scale * c) + offset.  Each task
keeps one running covariance, to which it adds a vector by a rank-one update
(Welford's), so its memory is that of a d x d matrix; the tasks' states are
merged in a tree by the formula for two parts, and a symmetric QR iteration
solves for the eigenvectors.  Sums are exact, means and products are kept
relative to the first vector of a task, so that a large offset costs no digits.

Vectors that are null, or hold null or non-finite entries, take no part.  If
lengths differ, those of the most frequent length count (of equally frequent
ones the longest) and others take no part.  Repeated rows and ids count each
time, null ids are kept, other columns are not looked at.  Components along
which the vectors don't vary can't be whitened and are left out; so is
everything of an empty table, of one vector, or of equal ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.topk_search import usable

MOST_TASKS, FAN = 512, 8  # tasks that hold a state, states merged at a time
LARGEST = 1 << 52  # of a whole component: beyond, doubles have no room for it
STATE = "part int, n long, origin array<long>, sums array<decimal(38,0)>, mean array<double>, products array<double>"


@dataclass
class Running:
    """Count, exact sums, mean and centred products of vectors, the latter two relative to origin."""

    n: int
    origin: np.ndarray
    sums: list[int]
    mean: np.ndarray
    products: np.ndarray

    @classmethod
    def at(cls, origin: np.ndarray) -> Running:
        d = len(origin)
        return cls(0, origin, [0] * d, np.zeros(d), np.zeros((d, d)))

    def add(self, rows: np.ndarray) -> None:
        """One rank-one update for each row."""
        if rows.dtype == np.int64:
            self.sums = [s + (int(h) << 26) + int(l) for s, h, l in zip(self.sums, (rows >> 26).sum(axis=0), (rows & (1 << 26) - 1).sum(axis=0), strict=True)]
        for y in (rows - self.origin).astype(np.float64):
            self.n += 1
            before = y - self.mean
            self.mean += before / self.n
            self.products += np.multiply.outer(before, y - self.mean)

    def merge(self, other: Running) -> None:
        """Add another part, by the formula for the products of two parts."""
        n = self.n + other.n
        apart = other.mean - self.mean + (other.origin - self.origin).astype(np.float64)
        self.mean = self.mean + apart * (other.n / n)
        self.products = self.products + other.products + np.multiply.outer(apart, apart) * (self.n * (other.n / n))
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        self.n = n

    def covariance(self) -> np.ndarray:
        return (self.products + self.products.T) / (2 * self.n)

    def row(self, part: int) -> pa.RecordBatch:
        values = [[part], [self.n], [self.origin.tolist()], [[Decimal(s) for s in self.sums]], [self.mean.tolist()], [self.products.ravel().tolist()]]
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.decimal128(38, 0)), pa.list_(pa.float64()), pa.list_(pa.float64())]
        names = ["part", "n", "origin", "sums", "mean", "products"]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

    @classmethod
    def of_row(cls, row: dict) -> Running:
        d = len(row["origin"])
        return cls(row["n"], np.array(row["origin"], np.int64), [int(s) for s in row["sums"]], np.array(row["mean"]), np.array(row["products"]).reshape(d, d))


def _merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    states = [Running.of_row(table.slice(i, 1).to_pylist()[0]) for i in np.argsort(table.column("part").to_numpy())]
    for other in states[1:]:
        states[0].merge(other)
    return pa.Table.from_batches([states[0].row(key[0].as_py())])


def _total(rows: DataFrame, matrix_of, vector: str) -> Running | None:
    """One state of all rows, whose vectors matrix_of turns into a matrix of whole numbers or doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, part = None, 0
        for batch in batches:
            if not len(batch):
                continue
            found = matrix_of(batch.column(batch.schema.names.index(vector)))
            if state is None:
                part = batch.column(batch.schema.names.index("part"))[0].as_py()
                state = Running.at(found[0] if found.dtype == np.int64 else np.zeros(found.shape[1], np.int64))
            state.add(found)
        if state is not None:
            yield state.row(part)

    states = rows.select(vector).coalesce(MOST_TASKS).withColumn("part", F.spark_partition_id()).mapInArrow(run, STATE)
    for _ in range(math.ceil(math.log(MOST_TASKS, FAN))):
        states = states.withColumn("group", F.expr(f"cast(part div {FAN} as int)")).groupBy("group").applyInArrow(_merged, STATE)
    found = states.first()  # one row of d x d numbers
    return Running.of_row(found.asDict()) if found else None


def tridiagonal(a: np.ndarray) -> tuple[list[float], list[float], np.ndarray]:
    """Diagonal, subdiagonal and the rows q of the basis with q a q^T tridiagonal, by reflections."""
    a, q = a.copy(), np.eye(len(a))
    least = np.finfo(np.float64).eps ** 2 * np.abs(a).max(initial=0)  # what underflows when squared is nothing
    for k in range(len(a) - 2):
        u = a[k + 1 :, k].copy()
        if np.abs(u[1:]).max() <= least:
            continue
        to = -math.copysign(float(np.linalg.norm(u)), u[0])
        u[0] -= to
        u /= np.linalg.norm(u)
        p = a[k + 1 :, k + 1 :] @ u
        w = 2 * (p - (u @ p) * u)
        a[k + 1 :, k + 1 :] -= np.multiply.outer(u, w) + np.multiply.outer(w, u)
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = to
        q[k + 1 :] -= 2 * np.multiply.outer(u, u @ q[k + 1 :])
    return np.diag(a).tolist(), np.diag(a, -1).tolist(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows, of a symmetric matrix.

    Implicitly shifted QR steps on the tridiagonal form chase the bulge down
    the unreduced block at the end until its last entry vanishes.
    """
    diagonal, below, q = tridiagonal(np.asarray(a, np.float64))
    eps = np.finfo(np.float64).eps
    least = eps * eps * max([abs(x) for x in diagonal + below], default=0.0)

    def gone(k: int) -> bool:
        return abs(below[k]) <= max(eps * (abs(diagonal[k]) + abs(diagonal[k + 1])), least)

    end, steps = len(diagonal) - 1, 0
    while end > 0:
        if gone(end - 1):
            below[end - 1] = 0.0
            end -= 1
            continue
        steps += 1
        if steps > 60 * len(diagonal):
            raise ArithmeticError("the matrix holds no finite numbers, or the iteration doesn't converge")
        start = end - 1
        while start > 0 and not gone(start - 1):
            start -= 1
        half, b = (diagonal[end - 1] - diagonal[end]) / 2, below[end - 1]
        shift = diagonal[end] - b * b / (half + math.copysign(math.hypot(half, b), half))
        x, z = diagonal[start] - shift, below[start]
        for k in range(start, end):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > start:
                below[k - 1] = r
            d0, d1, e = diagonal[k], diagonal[k + 1], below[k]
            diagonal[k], diagonal[k + 1] = c * c * d0 + 2 * c * s * e + s * s * d1, s * s * d0 - 2 * c * s * e + c * c * d1
            below[k] = c * s * (d1 - d0) + (c * c - s * s) * e
            if k + 1 < end:
                x, z = below[k], s * below[k + 1]
                below[k + 1] *= c
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-np.array(diagonal), kind="stable")
    return np.array(diagonal)[order], q[order]


@dataclass
class Whitening:
    """n vectors with exact sums, and their leading components (rows), eigenvalues and shares of the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    scale: float
    offset: int

    def whole(self, column: pa.Array) -> np.ndarray:
        return whole(column, self.scale, self.offset)

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly: as long integers where they fit with room for squares, else as Python's."""
        middle = [s // self.n for s in self.sums]
        rest = [s - m * self.n for s, m in zip(self.sums, middle, strict=True)]
        near = x - np.array(middle, np.int64)
        largest = int(np.abs(near).max(initial=0)) * self.n + self.n
        if largest * largest * max(1, x.shape[1]) < 1 << 63:
            return near * self.n - np.array(rest, np.int64)
        return near.astype(object) * self.n - np.array(rest, object)

    def whiten(self, apart: np.ndarray) -> np.ndarray:
        return (apart / self.n).astype(np.float64) @ self.components.T / np.sqrt(self.eigenvalues)


def whole(column: pa.Array, scale: float, offset: int) -> np.ndarray:
    """Rows of equal length as whole numbers; one that is too large for exact arithmetic is an error."""
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if np.abs(flat).max(initial=0) >= LARGEST:
        raise OverflowError(f"a component times {scale} is 2**52 or more")
    return flat.astype(np.int64).reshape(len(column), -1) + offset


def fitted(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """The rows that take part: usable vectors of the most frequent length."""
    rows = vectors.where(usable(vector_col))
    size = F.size(vector_col)
    most = rows.groupBy(size.alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(size == (most["d"] if most else 0)).where(size > 0)


def fit(rows: DataFrame, k: int = 32, vector_col: str = "embedding", scale: float = 64.0, offset: int = 1_000_000) -> Whitening | None:
    """The whitening of rows as fitted() gives them; None if nothing varies."""
    state = _total(rows, lambda c: whole(c, scale, offset), vector_col)
    if state is None:
        return None
    covariance = state.covariance()
    values, components = symmetric_qr(covariance)
    trace = float(np.trace(covariance))
    varied = int((values > len(values) * np.finfo(np.float64).eps * max(values[0], 0.0)).sum()) if trace > 0 else 0
    if not varied:
        return None
    kept = min(k, varied)
    return Whitening(state.n, state.sums, components[:kept], values[:kept], values[:kept] / trace, scale, offset)


def identity_error(rows: DataFrame, model: Whitening, vector_col: str = "embedding") -> float:
    """The largest entry by which the covariance of all whitened rows differs from the identity."""
    found = _total(rows, lambda c: model.whiten(model.apart(model.whole(c))), vector_col)
    return float(np.abs(found.covariance() - np.eye(len(model.components))).max())


def whiten(vectors: DataFrame, k: int = 32, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, offset: int = 1_000_000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component.

    deviation is the exact sum of (n * x - sums)^2, a decimal of 38 digits.
    """
    rows = fitted(vectors, vector_col)
    model = fit(rows, k, vector_col, scale, offset)
    kind = vectors.schema[id_col].dataType.simpleString()
    found = f"{id_col} {kind}, deviation decimal(38,0), whitened array<double>"
    if model is None:
        made, error = vectors.sparkSession.createDataFrame([], found), 0.0
    else:
        error = identity_error(rows, model, vector_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                apart = model.apart(model.whole(batch.column(1)))
                squares = (apart * apart).sum(axis=1)
                exact = pa.array(squares).cast(pa.decimal128(38, 0)) if squares.dtype == np.int64 else pa.array([Decimal(s) for s in squares], pa.decimal128(38, 0))
                white = model.whiten(apart)
                lists = pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * white.shape[1], white.ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0), exact, lists], names=[id_col, "deviation", "whitened"])

        made = rows.select(id_col, vector_col).mapInArrow(run, found)
    explained = F.array(*(F.lit(float(x)) for x in model.explained)) if model else F.array().cast("array<double>")
    long = made.select(id_col, F.posexplode("whitened").alias("at", "whitened"), "deviation")
    return long.select(
        id_col,
        (F.col("at") + 1).alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
