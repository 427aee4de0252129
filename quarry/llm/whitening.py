"""Whitening of embeddings: covariance by Chan's merge, eigenvectors on the driver, a second pass that checks the identity.

Each partition keeps (count, sum, centred scatter) of its rows, slice by slice, and
``treeReduce`` merges the pairs: the scatters add up, plus the outer product of the
difference of the two means times n_a * n_b / n. Sums are whole numbers and stay exact, so
means carry no error of their own. The driver holds matrices of the vector's dimension
only. After ``eigh`` the same merge over the projected rows gives their covariance, which
must be the identity.

Entries become whole numbers, floor(scale * c). A constant added to all of them would change
nothing: every column here is made of differences from the mean. Null vectors and vectors with
a null or non-finite entry (also 1e150 and beyond, whose squares are none) are dropped; so are vectors of another length than the table's most
common one (of equally common ones the longest), which includes empty vectors. Null ids,
repeated ids and rows: each row is fitted and returned. Components without variance (a
constant dimension, a single row, dimensions that depend on others) are returned with a null
``whitened`` and count in no check; ``identity_error`` is 0 where no component is left.
``explained`` is null where no dimension varies. A deviation that no long holds is null. An
empty table gives no rows. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Part of the largest eigenvalue, for each dimension, under which an eigenvalue is rounding error.
NOISE = np.finfo(np.float64).eps
#: Numbers up to here are exact as doubles, and sums of many rows of them as longs.
EXACT = 2.0**40
#: Entries from here on count as infinite.
FINITE = 1e150

Stats = tuple[int, np.ndarray, np.ndarray]


def merge(a: Stats, b: Stats) -> Stats:
    """Count, sum and scatter of two sets of rows from theirs."""
    (n, s, m), (k, t, q) = a, b
    if not n or not k:
        return a if n else b
    apart = (t * n - s * k).astype(np.float64) / (float(n) * k)  # whole numbers up to the division
    return n + k, s + t, m + q + np.outer(apart, apart) * (float(n) * k / (n + k))


def gathered(x: np.ndarray) -> Stats:
    """Count, sum and centred scatter of rows; sums of whole numbers are Python's, which don't overflow."""
    total = x.sum(axis=0)
    away = (x - total / len(x)).astype(np.float64)
    return len(x), total.astype(object), away.T @ away


def whole(c: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * c) as whole numbers: longs, or Python's where those might not do."""
    y = np.floor(c * scale)
    if not y.size or np.abs(y).max() < EXACT:
        return y.astype(np.int64)
    return np.array([[int(np.floor(v * scale)) for v in row] for row in c.tolist()], dtype=object)


def vectors(col: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that count, as doubles, and their indices."""
    at = np.flatnonzero(np.array(col.is_valid()) & (np.array(col.value_lengths().fill_null(-1)) == size))
    values = col.take(pa.array(at)).flatten()
    c = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(at), size)
    fine = (np.abs(c) < FINITE).all(axis=1)
    return c[fine], at[fine]


@dataclass
class Whitener:
    """The fitted transformation; ``axes`` has a unit eigenvector in each column, ``roots`` are square roots of eigenvalues (0: no variance)."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    roots: np.ndarray
    explained: np.ndarray | None
    scale: int

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; columns without variance are 0."""
        base = np.array([int(s) // self.n for s in self.sums], dtype=object)
        if x.dtype != object and np.abs(base).max() < EXACT:
            base = base.astype(np.int64)
        rest = np.array([(int(s) % self.n) / self.n for s in self.sums])  # x - S/n without a large mean in it
        out = ((x - base).astype(np.float64) - rest) @ self.axes
        return np.divide(out, self.roots, out=np.zeros_like(out), where=self.roots > 0)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S) ** 2, exact; None beyond a long."""
        most = int(np.abs(x).max(initial=0)) * self.n + max((abs(int(s)) for s in self.sums), default=0)
        if most < 2**62:
            d = x.astype(np.int64) * self.n - self.sums.astype(np.int64)
            if int(np.abs(d).max(initial=0)) ** 2 * x.shape[1] < 2**63:
                return (d * d).sum(axis=1).tolist()
        exact = ((x.astype(object) * self.n - self.sums) ** 2).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in exact]


def _reduce(df: DataFrame, size: int, rows_of) -> Stats:
    """Chan's merge over all partitions of a column of vectors; ``rows_of`` turns doubles into the rows to gather."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = (0, np.zeros(1), np.zeros((1, 1)))
        for b in slices(batches, rows=4096):
            c, _ = vectors(b.column(0), size)
            if len(c):
                have = merge(have, gathered(rows_of(c)))
        if have[0]:
            yield pa.RecordBatch.from_pydict({"n": [have[0]], "sums": [[str(v) for v in have[1]]], "scatter": [have[2].tobytes()]})

    def load(row) -> Stats:
        sums = np.array([int(v) if v.lstrip("-").isdigit() else float(v) for v in row.sums], dtype=object)
        return row.n, sums, np.frombuffer(bytes(row.scatter)).reshape(len(sums), len(sums))

    return df.mapInArrow(partial, "n long, sums array<string>, scatter binary").rdd.map(load).treeReduce(merge)


def fit(df: DataFrame, vector_col: str = "embedding", components: int = 32, scale: int = 64) -> tuple[Whitener, float] | None:
    """The transformation of all rows that count, and the second pass's identity error; None without such rows."""
    v = df.select(df[vector_col].cast("array<double>").alias("v"))
    sizes = v.where(F.col("v").isNotNull()).groupBy(F.size("v").alias("size")).count()
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < FINITE), F.lit(False)))
    usual = v.where(F.col("v").isNotNull() & finite).groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if usual is None or not usual.size:
        return None
    size = usual["size"]
    whole_rows = lambda c: whole(c, scale)
    n, sums, scatter = _reduce(v, size, whole_rows)
    values, axes = np.linalg.eigh(scatter / n)
    values, axes = values[::-1], axes[:, ::-1]
    most = min(components, size)
    real = values[:most] > NOISE * size * values[0]
    trace = float(np.trace(scatter)) / n
    roots = np.where(real, np.sqrt(np.maximum(values[:most], 0)), 0.0)
    w = Whitener(n, sums, axes[:, :most].copy(), roots, np.maximum(values[:most], 0) / trace if trace > 0 else None, scale)
    _, _, again = _reduce(v, size, lambda c: w.project(whole_rows(c)))
    off = np.abs(again / n - np.eye(most))[np.ix_(real, real)]
    return w, float(off.max(initial=0.0))


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32, scale: int = 64) -> DataFrame:
    """A row for each row that counts and each of its components."""
    schema = f"{id_col} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = df.sparkSession
    fitted = fit(df, vector_col, components, scale)
    if fitted is None:
        return spark.createDataFrame([], schema)
    w, error = fitted
    size, most = w.axes.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows=2000):
            c, at = vectors(b.column(1), size)
            if not len(c):
                continue
            x = whole(c, w.scale)
            z, k = w.project(x), len(c)
            each = np.repeat(np.arange(k), most)
            ids = b.column(0).take(pa.array(at)).take(pa.array(each))
            deviations = pa.array(w.deviations(x), pa.int64()).take(pa.array(each))
            flat = pa.array(z.ravel(), mask=np.tile(w.roots == 0, k))
            explained = pa.nulls(k * most, pa.float64()) if w.explained is None else pa.array(np.tile(w.explained, k))
            cols = [ids, pa.array(np.tile(np.arange(1, most + 1, dtype=np.int32), k)), pa.array(np.full(k * most, w.n)), deviations, flat, explained, pa.array(np.full(k * most, error))]
            yield pa.RecordBatch.from_arrays(cols, [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return df.select(df[id_col].cast("long"), df[vector_col].cast("array<double>")).mapInArrow(run, schema)
