"""Correlations and regressions on the Gram matrix: one Arrow pass over the rows, whatever the number of columns.

Each task adds up, for every two columns and the rows that have both, their number, means and centred products; batches and tasks
are joined by the usual update for two groups with different means, so nothing cancels. A task holds six matrices of the
columns' square; tables with more than BLOCK columns are taken in blocks of so many, a pass each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of one pass that are held against all, and those that one row of partial results holds.
BLOCK, ROWS = 1024, 32
PIECE = 4096


class Moments:
    """For columns i of a block (rows) and all columns j: rows with both, means of i and of j over these, and the centred squares and
    products."""

    def __init__(self, parts: np.ndarray):
        self.parts = parts

    @classmethod
    def of(cls, x: np.ndarray, own: slice) -> Moments:
        """Of a batch (rows x columns), NaN where a value is missing."""
        valid = ~np.isnan(x)
        some = valid.sum(axis=0)
        shift = np.where(some > 0, np.where(valid, x, 0).sum(axis=0) / np.maximum(some, 1), 0)
        x, v = np.where(valid, x - shift, 0), valid.astype(float)
        a, va = x[:, own], v[:, own]
        n = va.T @ v
        m = np.maximum(n, 1)
        si, sj = a.T @ v, va.T @ x
        parts = [n, np.where(n > 0, si / m + shift[own, None], 0), np.where(n > 0, sj / m + shift[None], 0), (a**2).T @ v - si**2 / m, va.T @ x**2 - sj**2 / m, a.T @ x - si * sj / m]
        return cls(np.stack(parts))

    def __add__(self, other: Moments) -> Moments:
        (n, mi, mj, vi, vj, c), (n2, mi2, mj2, vi2, vj2, c2) = self.parts, other.parts
        total = np.maximum(n + n2, 1)
        di, dj, w = mi2 - mi, mj2 - mj, n * n2 / total
        return Moments(np.stack([n + n2, (n * mi + n2 * mi2) / total, (n * mj + n2 * mj2) / total, vi + vi2 + di**2 * w, vj + vj2 + dj**2 * w, c + c2 + di * dj * w]))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A batch of arrays of one size as rows; null elements are NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), width)


FIELDS = ["n", "mean_i", "mean_j", "square_i", "square_j", "product"]


def pair_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, and arrays over all columns j: n, mean_i, mean_j, square_i, square_j, product), a row a column. NaN counts as missing."""
    d = len(columns)
    rows = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("x")) if d else df.select(F.array().cast("array<double>").alias("x")).where("false")

    def passed(first: int) -> DataFrame:
        own = slice(first, min(d, first + BLOCK))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: Moments | None = None
            for b in batches:
                for at in range(0, b.num_rows, PIECE):
                    m = Moments.of(matrix(b.column("x").slice(at, PIECE), d), own)
                    total = m if total is None else total + m
            if total is not None:
                cuts = range(0, own.stop - own.start, ROWS)
                yield pa.RecordBatch.from_arrays([pa.array([first + i for i in cuts], pa.int32()), pa.array([np.ascontiguousarray(total.parts[:, i : i + ROWS]).tobytes() for i in cuts], pa.binary())], names=["first", "part"])

        return rows.mapInArrow(add, "first int, part binary")

    def join(group: pa.Table) -> pa.Table:
        total = None
        for b in group.column("part"):
            m = Moments(np.frombuffer(b.as_py()).reshape(6, -1, d))
            total = m if total is None else total + m
        first, n = group.column("first")[0].as_py(), total.parts.shape[1]
        return pa.table({"i": pa.array(range(first, first + n), pa.int32()), **{f: pa.array(list(p), pa.list_(pa.float64())) for f, p in zip(FIELDS, total.parts, strict=True)}})

    parts = passed(0)
    for first in range(BLOCK, d, BLOCK):
        parts = parts.unionByName(passed(first))
    # As many groups as columns by ROWS, a row a task in each.
    return parts.groupBy("first").applyInArrow(join, "i int, " + ", ".join(f"{f} array<double>" for f in FIELDS))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, r): each column's correlations with all columns, over the rows that have both; null where one of them is constant there."""
    r = lambda k: F.get("product", k) / F.sqrt(F.get("square_i", k) * F.get("square_j", k))
    fits = lambda k: (F.get("square_i", k) > 0) & (F.get("square_j", k) > 0)
    return pair_moments(df, columns).select("i", F.transform(F.sequence(F.lit(0), F.lit(len(columns) - 1)), lambda k: F.when(fits(k), r(k))).alias("r"))


def correlated_features(df: DataFrame, columns: list[str], threshold: float = 0.9) -> DataFrame:
    """Columns with an absolute correlation above the threshold to an earlier one, and the largest of these."""
    most = F.array_max(F.transform(F.slice("r", F.lit(1), F.col("i")), lambda x: F.abs(x)))
    names = F.array(*[F.lit(c) for c in columns])
    return correlations(df, columns).select(F.get(names, F.col("i")).alias("feature"), most.alias("max_r")).where(F.col("max_r") > threshold)


def correlated(threshold: float = 0.9):
    """An eliminator that drops what correlated_features names."""
    return lambda df, columns, target: [r.feature for r in correlated_features(df, columns, threshold).collect()]


def gram(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and centred products of the columns, with 0 for what is missing. The driver holds the columns' square."""
    rows = pair_moments(df.select(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in columns]), columns).collect()
    d = len(columns)
    if not rows:
        return 0, np.zeros(d), np.zeros((d, d))
    mean, product = np.empty(d), np.empty((d, d))
    for r in rows:
        mean[r.i], product[r.i] = r.mean_i[r.i], r["product"]
    return int(rows[0].n[0]), mean, product


def lasso(product: np.ndarray, n: int, alpha: float, sweeps: int = 100_000, tol: float = 1e-12) -> np.ndarray:
    """Coefficients that minimise |y - Xb|^2 / (2 n) + alpha |b| on the raw scale, with a free intercept, by coordinate descent on the
    centred products of X (all columns but the last) and y (the last): a sweep looks at no row. Columns that are constant
    have 0."""
    g, rho = product[:-1, :-1] / max(n, 1), product[:-1, -1] / max(n, 1)
    b, scale = np.zeros(len(rho)), np.sqrt(np.maximum(np.diag(g), 0))
    fit = np.zeros(len(rho))
    for _ in range(sweeps):
        most = 0.0
        for j in np.flatnonzero(scale > 0):
            r = rho[j] - fit[j] + g[j, j] * b[j]
            new = np.sign(r) * max(abs(r) - alpha, 0.0) / g[j, j]
            if new != b[j]:
                fit += g[:, j] * (new - b[j])
                most = max(most, abs(new - b[j]) * scale[j])
                b[j] = new
        if most <= tol * np.sqrt(max(product[-1, -1] / max(n, 1), tol)):
            break
    return b


def lasso_select(df: DataFrame, columns: list[str], target: str, alpha: float = 0.5) -> list[str]:
    """Columns whose L1 coefficient is zero, on the raw scale; missing features are 0, rows without a target are left out."""
    n, _, product = gram(df.where(F.col(target).isNotNull()), [*columns, target])
    return [c for c, b in zip(columns, lasso(product, n, alpha), strict=True) if b == 0]
