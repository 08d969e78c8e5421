"""Many linear fits from one scan: all models, column prefixes, targets and folds of a sweep side by side.

A fit has columns, a target, a loss and a fold that it must not see. One pass over the table gives every fit its weights, means and
deviations; each further pass gives every fit that has not converged its loss, gradient and second derivatives, and the driver takes a
Newton step for each. The squared loss ends after one step, others after a few, so the passes don't grow with folds, prefixes or
models. Each task sends one row a fit. A last pass predicts.

Objectives are the mean weighted loss plus reg / 2 times the squared coefficients of standardised columns (sample deviations for
classifiers; for the squared loss, population deviations, and reg is divided by the target's deviation); the intercept is free.
Constant columns have coefficient 0. Missing features are 0; rows without a target, or with one that is no number, train no fit.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .moments import PIECE, matrix

#: Columns of a fit at most: a task holds their square for each fit. ROUNDS: passes after which a fit is given up, with a warning.
MOST_COLUMNS, ROUNDS, TOLERANCE = 512, 100, 1e-10


@dataclass
class Fit:
    """One model of a sweep and where its Newton steps have come to. balanced: classes have equal weight in sum."""

    key: tuple
    columns: list[str]
    target: str
    loss: str
    out: object = None
    reg: float = 0.01
    balanced: bool = True
    at: np.ndarray | None = None
    step: np.ndarray | None = None
    value: float = np.inf
    class_weight: dict[float, float] = field(default_factory=dict)
    total: float = 0.0
    penalty: np.ndarray | None = None
    fixed: np.ndarray | None = None
    done: bool = False


def losses(kind: str, z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss of scores z for targets y, and its first and second derivatives by z. Classes are 0 and 1."""
    if kind == "squared":
        return (z - y) ** 2 / 2, z - y, np.ones_like(z)
    s = 2 * y - 1
    if kind == "logistic":
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return np.logaddexp(0, -s * z), p - y, p * (1 - p)
    if kind == "squared_hinge":
        open_ = np.maximum(0, 1 - s * z)
        return open_**2, -2 * s * open_, 2.0 * (open_ > 0)
    raise ValueError(f"no loss {kind}")


def packed(df: DataFrame, columns: list[str], targets: list[str], fold: str | None) -> DataFrame:
    """(x, y, fold): features without gaps, targets with null where missing."""
    number = lambda c: F.col(c).cast("double")
    x = F.array(*[F.coalesce(F.nanvl(number(c), F.lit(0.0)), F.lit(0.0)) for c in columns]).cast("array<double>")
    return df.select(x.alias("x"), F.array(*[number(c) for c in targets]).alias("y"), (F.col(fold).cast("string") if fold else F.lit(None).cast("string")).alias("fold"))


def one_pass(rows: DataFrame, fits: list[Fit], work) -> list[np.ndarray]:
    """For each fit, the sum over all its training rows of work(fit, x, y), a vector."""
    columns, targets = names_of(fits)
    place = [(np.array([columns.index(c) for c in f.columns], int), targets.index(f.target), None if f.out is None else str(f.out)) for f in fits]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list = [None] * len(fits)
        for b in batches:
            for a in range(0, b.num_rows, PIECE):
                piece = b.slice(a, PIECE)
                x, y = matrix(piece.column("x"), len(columns)), matrix(piece.column("y"), len(targets))
                folds = np.array(piece.column("fold").to_pylist(), object)
                for k, (own, t, out) in enumerate(place):
                    use = ~np.isnan(y[:, t])
                    if out is not None:
                        use &= folds != out
                    s = work(fits[k], x[np.ix_(use, own)], y[use, t])
                    sums[k] = s if sums[k] is None else sums[k] + s
        done = [k for k, s in enumerate(sums) if s is not None]
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int32()), pa.array([sums[k].tobytes() for k in done], pa.binary())], names=["k", "part"])

    def join(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py()) for b in group.column("part"))
        return pa.table({"k": group.column("k").slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})

    got = rows.mapInArrow(add, "k int, part binary").groupBy("k").applyInArrow(join, "k int, part binary").collect()
    out = [work(f, np.zeros((0, len(f.columns))), np.zeros(0)) for f in fits]
    for r in got:
        out[r.k] = np.frombuffer(r.part)
    return out


def names_of(fits: list[Fit]) -> tuple[list[str], list[str]]:
    return [*dict.fromkeys(c for f in fits for c in f.columns)], [*dict.fromkeys(f.target for f in fits)]


def statistics(f: Fit, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By class (all rows are one for the squared loss): rows, sums and squares of the columns; then sum and square of y."""
    of = [y == y] if f.loss == "squared" else [y == 0, y == 1]
    return np.concatenate([np.concatenate([[c.sum()], x[c].sum(axis=0), (x[c] ** 2).sum(axis=0)]) for c in of] + [[y.sum(), (y**2).sum()]])


def derivatives(f: Fit, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weighted loss, gradient and second derivatives at the fit's next place, the intercept last."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.ones(len(y))
    for c, v in f.class_weight.items():
        w[y == c] = v
    loss, d1, d2 = losses(f.loss, x @ (f.at + f.step), y)
    return np.concatenate([[(w * loss).sum()], x.T @ (w * d1), ((x * (w * d2)[:, None]).T @ x).ravel()])


def prepared(f: Fit, s: np.ndarray) -> None:
    """Class weights and penalties from a fit's statistics."""
    d = len(f.columns)
    classes = s[:-2].reshape(-1, 1 + 2 * d)
    n = classes[:, 0]
    weight = np.ones(len(n))
    if f.loss != "squared" and f.balanced:
        weight = n.sum() / (np.maximum(n, 1) * max((n > 0).sum(), 1))
        f.class_weight = dict(enumerate(weight.tolist()))
    f.total = float((weight * n).sum())
    reg, spread = f.reg, np.zeros(d)
    if f.total > 0:
        mean, square = (weight[:, None] * classes[:, 1 : d + 1]).sum(axis=0) / f.total, (weight[:, None] * classes[:, d + 1 :]).sum(axis=0) / f.total
        spread = np.maximum(square - mean**2, 0)
        spread[spread <= 1e-14 * square] = 0
        if f.loss == "squared":
            sd = np.sqrt(max(s[-1] / f.total - (s[-2] / f.total) ** 2, 0))
            reg = reg / sd if sd > 0 else reg
        else:
            free = f.total - (weight**2 * n).sum() / f.total
            spread *= f.total / free if free > 0 else 1
    f.penalty = np.append(reg * spread, 0.0)
    f.at, f.step, f.done = np.zeros(d + 1), np.zeros(d + 1), f.total == 0
    f.fixed = np.append(spread == 0, False)


def stepped(f: Fit, s: np.ndarray) -> None:
    """The next Newton step, or half of the last one if that made the objective larger."""
    d = len(f.at)
    to = f.at + f.step
    value = s[0] / f.total + (f.penalty * to**2).sum() / 2
    if value > f.value + 1e-15 * abs(f.value) and np.abs(f.step).max() > 0:
        f.step = f.step / 2
        f.done = bool(np.abs(f.step).max() <= TOLERANCE * (1 + np.abs(f.at).max()))
        return
    gain, f.at, f.value = f.value - value, to, value
    g = s[1 : d + 1] / f.total + f.penalty * to
    h = s[d + 1 :].reshape(d, d) / f.total + np.diag(f.penalty)
    free = ~f.fixed
    scale = np.sqrt(np.maximum(np.diag(h)[free], 1e-300))
    step = np.zeros(d)
    step[free] = -np.linalg.lstsq(h[np.ix_(free, free)] / np.outer(scale, scale), g[free] / scale, rcond=1e-13)[0] / scale
    small = np.abs(step).max(initial=0) <= TOLERANCE * (1 + np.abs(f.at).max()) or abs(gain) <= TOLERANCE * TOLERANCE * abs(value)
    f.done, f.step = bool(small), np.zeros(d) if small else step


def fit_all(df: DataFrame, fits: list[Fit], fold: str | None = None) -> list[Fit]:
    """All fits, fitted; df is read once a round and should be stored."""
    if not fits:
        return []
    if max(len(f.columns) for f in fits) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns in a fit")
    columns, targets = names_of(fits)
    rows = packed(df, columns, targets, fold)
    for f, s in zip(fits, one_pass(rows, fits, statistics), strict=True):
        prepared(f, s)
    for _ in range(ROUNDS):
        now = [f for f in fits if not f.done]
        if not now:
            break
        for f, s in zip(now, one_pass(rows, now, derivatives), strict=True):
            stepped(f, s)
            # A quadratic is at its end after its first step.
            if f.loss == "squared" and np.abs(f.step).max() > 0 and not f.done:
                f.at, f.step, f.done = f.at + f.step, np.zeros_like(f.step), True
    else:
        warnings.warn(f"{sum(not f.done for f in fits)} fits did not converge in {ROUNDS} rounds", stacklevel=2)
    return fits


def predict_all(df: DataFrame, fits: list[Fit], keep: list[str], fold: str | None = None) -> DataFrame:
    """(keep, fit, z): the score of each row by each fit that left its fold out (by every fit without a fold), in one pass. `fit` is the
    place in fits."""
    columns, _ = names_of(fits)
    row = F.struct(*[F.col(c) for c in keep]).alias("row")
    x = F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns]).cast("array<double>")
    rows = df.select(row, x.alias("x"), (F.col(fold).cast("string") if fold else F.lit(None).cast("string")).alias("fold"))
    place = [(np.array([columns.index(c) for c in f.columns], int), None if f.out is None else str(f.out), f.at) for f in fits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, PIECE):
                piece = b.slice(a, PIECE)
                x, folds = matrix(piece.column("x"), len(columns)), np.array(piece.column("fold").to_pylist(), object)
                for k, (own, out, at) in enumerate(place):
                    use = np.flatnonzero(folds == out) if out is not None else np.arange(len(x))
                    z = x[np.ix_(use, own)] @ at[:-1] + at[-1]
                    yield pa.RecordBatch.from_arrays([piece.column("row").take(pa.array(use)), pa.array(np.full(len(use), k), pa.int32()), pa.array(z, pa.float64())], names=["row", "fit", "z"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], *T.DataType.fromDDL("fit int, z double").fields])).select("row.*", "fit", "z")
