"""Gradient-boosted trees of a whole sweep: the fits of all folds, column prefixes and targets grow side by side.

A fit has columns, a target, a loss and a fold that it must not see. Trees are those of MLlib's GBTClassifier and GBTRegressor with
their defaults (depth 5, 32 bins, the first tree on the target and each further one, by 0.1, on the slopes of the loss), which fit one
model a call and run a few jobs a level of each tree. Here one pass makes a level of the current tree of every fit: tasks add up
weights, slopes and their squares by node and bin, and the driver chooses the splits. So the passes are trees x levels, whatever the number of
fits; a table with little work is one task, which makes all of them.

Bins come from the counts of all values of all rows; columns with more than MOST_VALUES different values are counted between
quantiles. A missing feature is larger than any number; rows without a target, or with one that is no number, train no fit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .moments import PIECE, matrix

#: Trees of a model, those that the usual libraries take.
TREES = 100
DEPTH, BINS, RATE = 5, 32, 0.1
#: Values of a column that are told apart when its bins are made; quantiles between which the rows of one with more are counted.
MOST_VALUES, QUANTILES = 10_000, 2048
#: Rows of a block; rows x fits up to which one task makes all rounds, and those that a task takes at least in larger tables.
BLOCK, ALONE, WORK = 32_768, 500_000, 100_000
#: No row goes right of this bin: the mark of a leaf, whose rows stay on the left down to the last level.
LEAF = 255


@dataclass
class Fit:
    """One model of a sweep. bins: its columns' places among the binned columns; weight: by class (one for the squared loss)."""

    key: tuple
    columns: list[str]
    target: str
    loss: str
    out: object = None
    weight: np.ndarray | None = None
    bins: np.ndarray | None = None
    trees: list[Tree] = field(default_factory=list)


class Tree:
    """By level and node, the column (a place in the fit's columns) and the last bin that goes left; and the value of each place below
    the last level. While it grows, the impurities of the nodes of the next level."""

    def __init__(self) -> None:
        self.column = [np.zeros(1 << k, np.uint16) for k in range(DEPTH)]
        self.last = [np.full(1 << k, LEAF, np.uint8) for k in range(DEPTH)]
        self.value = np.zeros(1 << DEPTH)
        self.impurity: np.ndarray | None = None

    def places(self, x: list[np.ndarray], depth: int) -> np.ndarray:
        """The node of each row after so many levels; x are the bins of the fit's columns."""
        at = np.zeros(len(x[0]) if x else 0, np.intp)
        for column, last in zip(self.column[:depth], self.last[:depth], strict=True):
            right = np.zeros(len(at), bool)
            for j in np.unique(column[last != LEAF]):
                right |= x[j] > np.where(column == j, last, np.uint8(LEAF)).take(at)
            at = 2 * at + right
        return at

    def split(self, level: int, sums: np.ndarray) -> bool:
        """Splits for the nodes of a level by their sums (weight, slopes and their squares; column, node, bin), and the values of both
        sides; whether the next level has nodes to split. Many splits of a small node part it alike and differ by rounding alone, so the
        steps are those of MLlib, whose choice among them is taken."""
        left = sums.cumsum(axis=-1)
        rest, filled = left[..., -1:] - left, sums[0] > 0
        open_ = filled.cumsum(axis=-1) % np.maximum(filled.sum(axis=-1, keepdims=True), 1) > 0
        if self.impurity is None:
            first = int(open_.any(axis=(1, 2)).argmax())
            root = left[:, first, 0, 0] + rest[:, first, 0, 0]
            self.impurity, self.value[0] = variance(root)[None], root[1] / root[0] if root[0] > 0 else 0.0
        sides = variance(left), variance(rest)
        whole = left[0] + rest[0]
        part = left[0] / np.where(open_, whole, 1), rest[0] / np.where(open_, whole, 1)
        gain = np.where(open_, self.impurity[:, None] - part[0] * sides[0] - part[1] * sides[1], 0).transpose(1, 0, 2).reshape(filled.shape[1], -1)
        best = gain.argmax(axis=1)
        ways = (gain.max(axis=1) > 0) & (np.abs(self.impurity) >= np.finfo(float).eps)
        at = np.flatnonzero(ways)
        column, last = best[at] // BINS, best[at] % BINS
        self.column[level][at], self.last[level][at] = column, last
        self.impurity = np.zeros(2 << level)
        for side, s in enumerate((left, rest)):
            child = 2 * at + side
            self.value[child << (DEPTH - level - 1)] = s[1, column, at, last] / s[0, column, at, last]
            self.impurity[child] = sides[side][column, at, last]
        return level < DEPTH - 1 and bool((np.abs(self.impurity) >= np.finfo(float).eps).any())


def variance(s: np.ndarray) -> np.ndarray:
    """The variance of what has this weight, sum and sum of squares."""
    n = np.where(s[0] > 0, s[0], 1)
    return (s[2] - s[1] * s[1] / n) / n


def numbers(columns: list[str]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns]).cast("array<double>")


def slopes(loss: str, y: np.ndarray, at: np.ndarray, first: bool) -> np.ndarray:
    """What the next tree is fitted to: the target itself at first, then the negative gradient at the present scores."""
    y = 2 * y - 1 if loss == "logistic" else y
    if first:
        return y
    return 4 * y / (1 + np.exp(np.clip(2 * y * at, -700, 700))) if loss == "logistic" else 2 * (y - at)


#: Rows of one fold: its number, features or bins (a row a column), targets, and the scores of the fits that see them.
Block = tuple[int, np.ndarray, np.ndarray, dict[int, np.ndarray]]


def blocks_of(df: DataFrame, columns: list[str], targets: list[str], fold: str | None, folds: list, tasks: int) -> RDD:
    """The rows in blocks of one fold each, so that a fit leaves whole blocks out."""
    place = {None if f is None else str(f): i for i, f in enumerate(folds)}
    rows = df.select(numbers(columns).alias("x"), numbers(targets).alias("y"), (F.col(fold).cast("string") if fold else F.lit(None).cast("string")).alias("fold"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}

        def flush(f: int) -> pa.RecordBatch:
            xy = np.ascontiguousarray(np.concatenate(held.pop(f)).T)
            return pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([xy.tobytes()], pa.binary())], names=["fold", "xy"])

        for b in batches:
            xy = np.concatenate([matrix(b.column("x"), len(columns)), matrix(b.column("y"), len(targets))], axis=1)
            at = np.array([place[v] for v in b.column("fold").to_pylist()], int)
            for f in np.unique(at).tolist():
                held.setdefault(f, []).append(xy[at == f])
                if sum(map(len, held[f])) >= BLOCK:
                    yield flush(f)
        for f in list(held):
            yield flush(f)

    def block(r: T.Row) -> Block:
        xy = np.frombuffer(r.xy).reshape(len(columns) + len(targets), -1)
        return r.fold, xy[: len(columns)], xy[len(columns) :], {}

    return rows.repartition(tasks).mapInArrow(pack, "fold int, xy binary").rdd.map(block)


def values_of(df: DataFrame, columns: list[str]) -> list[tuple[np.ndarray, bool]]:
    """For each column its different values, or quantiles if those are too many; and whether they are all."""
    x = lambda k: F.nanvl(F.col(columns[k]).cast("double"), F.lit(None).cast("double"))
    # Columns that have far too many values by an estimate are not counted exactly.
    guess = df.select(*[F.approx_count_distinct(x(k), 0.02).alias(str(k)) for k in range(len(columns))]).first()
    likely = [k for k in range(len(columns)) if guess[k] <= 1.2 * MOST_VALUES]
    each = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("i"), x(k).alias("v")) for k in likely]).cast("array<struct<i:int,v:double>>")).alias("e")).select("e.*").where("v is not null").distinct()
    many = {r[0]: r[1] for r in each.groupBy("i").count().collect()}
    few = [k for k in likely if many.get(k, 0) <= MOST_VALUES]
    got = each.where(F.col("i").isin(few)).toArrow()
    i, v = got["i"].to_numpy(), got["v"].to_numpy()
    out = {k: (np.sort(v[i == k]), True) for k in few}
    rest = [k for k in range(len(columns)) if k not in out]
    if rest:
        row = df.select(*[F.percentile_approx(x(k), [float(q) for q in np.linspace(0, 1, QUANTILES + 1)], MOST_VALUES).alias(str(k)) for k in rest]).first()
        out |= {k: (np.unique(row[str(k)]), False) for k in rest}
    return [out[k] for k in range(len(columns))]


def cuts_of(values: np.ndarray, whole: bool, n: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Upper ends of bins but the last one, from the weights of the values that have rows (n); the last place counts what is missing.
    Few values are a bin each; else a bin ends after the value at which its share of the weight is nearest."""
    some = n > 0
    v, w = np.append(values, np.nan)[some], weight[some]
    if len(v) < 2:
        return np.zeros(0)
    ends = np.where(np.isnan(v[1:]), v[:-1], v[:-1] / 2 + v[1:] / 2) if whole else v[:-1]
    bins = int(min(BINS, n.sum()))
    if len(ends) < bins:
        return ends
    total = w.cumsum()
    middle, stride, at, out = total[:-1] + total[1:], total[-1] / bins, 0, []
    goal = stride
    while (at := max(at, int(np.searchsorted(middle, 2 * goal, "right")))) < len(ends) and len(out) < bins - 1:
        out.append(ends[at])
        at, goal = at + 1, goal + stride
    return np.array(out)


def binned(rows: RDD, fits: list[Fit], columns: list[str], targets: list[str], folds: list, values: list[tuple[np.ndarray, bool]]) -> list[tuple[int, np.ndarray]]:
    """The binned columns, a column's place and its cuts each; fits get theirs and their class weights from counts of all rows by value,
    fold and class. Fits whose rows have the same cuts share them."""
    kinds = {targets.index(f.target): f.loss for f in fits}
    pairs = sorted({(columns.index(c), targets.index(f.target)) for f in fits for c in f.columns})

    def count(blocks: Iterable[Block]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
        out = {(i, t): np.zeros((len(values[i][0]) + 1, len(folds), 2)) for i, t in pairs}
        for fold, x, y, _ in blocks:
            slots: dict[int, np.ndarray] = {}
            for i, t in pairs:
                v = values[i][0]
                if i not in slots:
                    slots[i] = np.where(np.isnan(x[i]), len(v), np.minimum(np.searchsorted(v, x[i]), max(len(v) - 1, 0)))
                use = ~np.isnan(y[t])
                c = (y[t][use] == 1) if kinds[t] == "logistic" else 0
                out[i, t][:, fold] += np.bincount(slots[i][use] * 2 + c, minlength=2 * len(v) + 2).reshape(-1, 2)
        return iter(out.items())

    got = dict(rows.mapPartitions(count).reduceByKey(np.add).collect())
    kept: dict[tuple[int, bytes], int] = {}
    for f in fits:
        t, bins = targets.index(f.target), []
        for c in f.columns:
            i = columns.index(c)
            n = got[i, t][:, [k for k, v in enumerate(folds) if f.out is None or v != f.out]].sum(axis=1)
            if f.weight is None:
                by = n.sum(axis=0)
                f.weight = by.sum() / (np.maximum(by, 1) * max((by > 0).sum(), 1)) if f.loss == "logistic" else np.ones(1)
            cuts = cuts_of(*values[i], n.sum(axis=1), n @ f.weight if f.loss == "logistic" else n.sum(axis=1))
            bins.append(kept.setdefault((i, cuts.tobytes()), len(kept)))
        f.bins = np.array(bins, int)
    return [(i, np.frombuffer(c)) for i, c in kept]


def bins_of(x: np.ndarray, cuts: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Numbers of the bins, a row a binned column; NaN is in the last one."""
    return np.stack([np.searchsorted(c, x[i]).astype(np.uint8) for i, c in cuts]) if cuts else np.zeros((0, x.shape[1]), np.uint8)


def level_sums(blocks: Iterable[Block], fits: list[Fit], growing: dict[int, Tree], targets: list[str], level: int, first: bool) -> dict[int, np.ndarray]:
    """For each growing fit, weights, slopes and their squares by column, node of the level and bin, over some blocks."""
    out: dict[int, np.ndarray] = {}
    for _, x, y, scores in blocks:
        for k, tree in growing.items():
            if k not in scores:
                continue
            f = fits[k]
            t, own = y[targets.index(f.target)], [x[j] for j in f.bins]
            r, at = slopes(f.loss, t, scores[k], first), tree.places(own, level) * BINS
            w = np.where(t == 1, f.weight[-1], f.weight[0])
            use = ~np.isnan(t)
            if not use.all():
                r, w, at, own = r[use], w[use], at[use], [v[use] for v in own]
            size = BINS << level
            if k not in out:
                out[k] = np.zeros((3, len(own), size))
            s = w * r
            rows = w, s, s * r
            for j, v in enumerate(own):
                place = at + v
                for i, part in enumerate(rows):
                    out[k][i, j] += np.bincount(place, part, size)
    return out


def advanced(block: Block, fits: list[Fit], grown: dict[int, Tree], rate: float) -> Block:
    """The block with scores that count one more tree of each fit."""
    fold, x, y, scores = block
    return fold, x, y, {k: s + rate * grown[k].value[grown[k].places([x[j] for j in fits[k].bins], DEPTH)] for k, s in scores.items()}


def grow(fits: list[Fit], trees: int, add: Callable[[dict[int, Tree], int, bool], dict[int, np.ndarray]], advance: Callable[[dict[int, Tree], float], None]) -> list[list[Tree]]:
    """The trees of all fits; add(growing, level, first) is one pass, advance(grown, rate) moves the scores before the next tree."""
    out: list[list[Tree]] = [[] for _ in fits]
    for m in range(trees):
        grown = {k: Tree() for k in range(len(fits))}
        growing = grown
        for level in range(DEPTH):
            if not growing:
                break
            sums = add(growing, level, m == 0)
            growing = {k: t for k, t in growing.items() if k in sums and t.split(level, sums[k].reshape(3, -1, 1 << level, BINS))}
        for k, t in grown.items():
            out[k].append(t)
        if m < trees - 1:
            advance(grown, RATE if m else 1.0)
    return out


def grown_alone(blocks: RDD, fits: list[Fit], targets: list[str], trees: int) -> list[list[Tree]]:
    """All rounds in one job of one task."""

    def run(rows: Iterator[Block]) -> Iterator[list[list[Tree]]]:
        held = list(rows)

        def advance(grown: dict[int, Tree], rate: float) -> None:
            held[:] = [advanced(b, fits, grown, rate) for b in held]

        return iter([grow(fits, trees, lambda growing, level, first: level_sums(held, fits, growing, targets, level, first), advance)])

    return blocks.mapPartitions(run).first()


def grown_together(blocks: RDD, fits: list[Fit], targets: list[str], trees: int) -> list[list[Tree]]:
    """A job a level. Scores are kept with the blocks, one generation and, while the next is made of it, two."""
    sc = blocks.context
    shared = sc.broadcast(fits)
    now, last = blocks.persist(StorageLevel.MEMORY_AND_DISK), None

    def add(growing: dict[int, Tree], level: int, first: bool) -> dict[int, np.ndarray]:
        nonlocal last
        part = lambda rows: [(k, v.tobytes()) for k, v in level_sums(rows, shared.value, growing, targets, level, first).items()]
        out: dict[int, np.ndarray] = {}
        for k, b in now.mapPartitions(part).collect():
            v = np.frombuffer(b)
            out[k] = out[k] + v if k in out else v
        if last is not None:
            last.unpersist()
            last = None
        return out

    def advance(grown: dict[int, Tree], rate: float) -> None:
        nonlocal now, last
        trees_ = sc.broadcast(grown)
        now, last = now.map(lambda b: advanced(b, shared.value, trees_.value, rate)).persist(StorageLevel.MEMORY_AND_DISK), now

    try:
        return grow(fits, trees, add, advance)
    finally:
        now.unpersist()
        if last is not None:
            last.unpersist()


def fit_all(df: DataFrame, fits: list[Fit], fold: str | None = None, trees: int = TREES) -> list[tuple[int, np.ndarray]]:
    """Fits all models and returns the binned columns (see binned), which predict_all takes. df is read a few times and should be stored."""
    if not fits:
        return []
    columns, targets = names_of(fits)
    folds = sorted(r[0] for r in df.select(fold).distinct().collect()) if fold else [None]
    work = df.count() * len(fits)
    tasks = 1 if work <= ALONE else max(2, min(df.sparkSession.sparkContext.defaultParallelism, -(-work // WORK)))
    rows = blocks_of(df, columns, targets, fold, folds, tasks).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cuts = binned(rows, fits, columns, targets, folds, values_of(df, columns))

        def begin(b: Block) -> Block:
            at, x, y, _ = b
            return at, bins_of(x, cuts), y, {k: np.zeros(x.shape[1]) for k, f in enumerate(fits) if f.out is None or folds[at] != f.out}

        made = (grown_alone if tasks == 1 else grown_together)(rows.map(begin), fits, targets, trees)
    finally:
        rows.unpersist()
    for f, t in zip(fits, made, strict=True):
        f.trees = t
    return cuts


def names_of(fits: list[Fit]) -> tuple[list[str], list[str]]:
    return [*dict.fromkeys(c for f in fits for c in f.columns)], [*dict.fromkeys(f.target for f in fits)]


def predict_all(df: DataFrame, fits: list[Fit], cuts: list[tuple[int, np.ndarray]], keep: list[str], fold: str | None = None) -> DataFrame:
    """(keep, fit, z): the score of each row by each fit that left its fold out (by every fit without a fold), in one pass. `fit` is the
    place in fits."""
    columns, _ = names_of(fits)
    row = F.struct(*[F.col(c) for c in keep]).alias("row")
    rows = df.select(row, numbers(columns).alias("x"), (F.col(fold).cast("string") if fold else F.lit(None).cast("string")).alias("fold"))
    outs = [None if f.out is None else str(f.out) for f in fits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, PIECE):
                piece = b.slice(a, PIECE)
                x, folds = bins_of(matrix(piece.column("x"), len(columns)).T, cuts), np.array(piece.column("fold").to_pylist(), object)
                for k, f in enumerate(fits):
                    use = np.flatnonzero(folds == outs[k]) if outs[k] is not None else np.arange(len(folds))
                    own, z = [x[j][use] for j in f.bins], np.zeros(len(use))
                    for m, t in enumerate(f.trees):
                        z += (RATE if m else 1.0) * t.value[t.places(own, DEPTH)]
                    yield pa.RecordBatch.from_arrays([piece.column("row").take(pa.array(use)), pa.array(np.full(len(use), k), pa.int32()), pa.array(z, pa.float64())], names=["row", "fit", "z"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], *T.DataType.fromDDL("fit int, z double").fields])).select("row.*", "fit", "z")
