"""Iterative clustering of trajectories, feature selection and model training.

Centres are small (clusters x timepoints) and travel to the workers; labels never leave them. Each round is one aggregation.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import draw
from ..sources.io import stored
from . import boosted, linear

MAX_CLUSTERS = 42
#: Fits that the driver has under way at once; each one is a Spark job of its own.
AT_ONCE = 8
#: Rounds after which a fit that has not converged is given up, with a warning.
ROUNDS = 1000


def each(tasks: list[Callable[[], object]]) -> list:
    """The results of independent fits, several under way at once, in the order of the tasks."""
    with ThreadPool(max(1, min(AT_ONCE, len(tasks)))) as pool:
        return pool.map(inheritable_thread_target(SparkSession.active())(lambda f: f()), tasks)


def dtw_costs(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared dynamic-time-warping distances of many series to one centre: one step of the recurrence for all of them at once. Two
    rows of the table are held."""
    x = np.ascontiguousarray(x.T)
    last = np.full((len(centre) + 1, x.shape[1]), np.inf)
    last[0] = 0
    for v in x:
        row = np.full_like(last, np.inf)
        for j, c in enumerate(centre):
            row[j + 1] = (v - c) ** 2 + np.minimum(np.minimum(last[j], last[j + 1]), row[j])
        last = row
    return last[-1]


def warped(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The cost of each cell of the warping table, for all series (rows of x) at once: (series' points + 1, centre's points + 1, series)."""
    cost = np.full((x.shape[1] + 1, len(centre) + 1, len(x)), np.inf)
    cost[0, 0] = 0
    for i, v in enumerate(np.ascontiguousarray(x.T)):
        for j, c in enumerate(centre):
            cost[i + 1, j + 1] = (v - c) ** 2 + np.minimum(np.minimum(cost[i, j], cost[i, j + 1]), cost[i + 1, j])
    return cost


def warp_sums(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point of the centre, the sum of the points that warping paths of all series put on it, and their number. The paths go
    back together, a step a time, diagonally where costs are equal."""
    cost, m = warped(x, centre), len(centre)
    at = np.arange(len(x))
    i, j = np.full(len(x), x.shape[1]), np.full(len(x), m)
    sums, count = np.zeros(m), np.zeros(m)
    while len(at):
        sums += np.bincount(j - 1, x[at, i - 1], m)
        count += np.bincount(j - 1, minlength=m)
        way = np.stack([cost[i - 1, j - 1, at], cost[i - 1, j, at], cost[i, j - 1, at]]).argmin(axis=0)
        i, j = i - (way != 2), j - (way != 1)
        on = (i > 0) & (j > 0)
        at, i, j = at[on], i[on], j[on]
    return sums, count


def correlations_at_shifts(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Cross-correlations of many series with one centre of the same length at all shifts, by one product."""
    m = len(centre)
    shifts = np.zeros((m, 2 * m - 1))
    for k in range(2 * m - 1):
        p = np.arange(max(0, k - m + 1), min(m, k + 1))
        shifts[p, k] = centre[p - k + m - 1]
    return x @ shifts


def shape_distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Shape-based distances of z-normalised series to a centre: 1 less the largest normalised cross-correlation."""
    norm = np.linalg.norm(x, axis=1) * np.linalg.norm(centre)
    return 1 - correlations_at_shifts(x, centre).max(axis=1) / np.where(norm > 0, norm, 1)


def shape_moved(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Series moved to the shift with the largest cross-correlation, with zeros where nothing comes from."""
    m = x.shape[1]
    k = correlations_at_shifts(x, centre).argmax(axis=1) - (m - 1)
    place = np.arange(m) + k[:, None]
    return np.where((place >= 0) & (place < m), np.take_along_axis(x, np.clip(place, 0, m - 1), axis=1), 0.0)


def znorm(x: np.ndarray) -> np.ndarray:
    """Series (the last axis) with mean 0 and deviation 1; constant ones are 0."""
    s = x.std(axis=-1, keepdims=True)
    return np.where(s > 0, (x - x.mean(axis=-1, keepdims=True)) / np.where(s > 0, s, 1), 0.0)


def rows_of(v: list, m: int) -> np.ndarray:
    return np.array(v, float).reshape(len(v), m)


def nearest(x: np.ndarray, centres: np.ndarray, metric: str) -> np.ndarray:
    """The number of each series' nearest centre; ties go to the first."""
    if metric == "euclidean":
        return ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    if metric == "dtw":
        return np.stack([dtw_costs(x, c) for c in centres], axis=1).argmin(axis=1)
    z = znorm(x)
    return np.stack([shape_distances(z, c) for c in centres], axis=1).argmin(axis=1)


def assigned(df: DataFrame, vector: str, centres: np.ndarray, metric: str, out: str = "cluster") -> DataFrame:
    """df with the nearest centre; ties go to the first. A null vector, or any without centres, has a null cluster."""
    if not len(centres):
        return df.withColumn(out, F.lit(None).cast("int"))
    shared = df.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("int")
    def label_of(v: pd.Series) -> pd.Series:
        c = shared.value
        known = v.notna().to_numpy()
        label = pd.Series(pd.NA, index=v.index, dtype="Int32")
        label[known] = nearest(rows_of(v[known].tolist(), c.shape[1]), c, metric)
        return label

    return df.withColumn(out, label_of(F.col(vector)))


#: Vectors of a block, the products of vectors and centres that a task takes at least, and those of a table so small that starting a
#: job takes longer than a round: all its rounds are one job of one task.
BLOCK, WORK, ALONE = 4096, 500_000, 1_500_000
#: What holding a vector against a centre costs, as a multiple of a Euclidean distance.
COST = {"euclidean": 1, "dtw": 10, "shape": 4}


def packed(df: DataFrame, vector: str, centres: int, cluster: str | None = None) -> RDD:
    """Vectors in blocks (x, label, m): BLOCK of them as one array in bytes, with their clusters; an RDD, since a round of a fit over a
    small table is shorter than the planning of a query. Rounds go over these, in one
    task a core at most and in fewer where little is to be done (`centres` counts Euclidean ones); each task sends one sum a fit. Up to
    ALONE products a round go to one task, which makes all rounds."""
    work = df.count() * centres
    tasks = 1 if work <= ALONE else max(2, min(df.sparkSession.sparkContext.defaultParallelism, -(-work // WORK)))
    label = F.col(cluster) if cluster else F.lit(0)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                b = batch.slice(a, BLOCK)
                x = b.column("v").flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([b.column("c").to_numpy().astype(np.int32).tobytes()], pa.binary()), pa.array([x.size // b.num_rows], pa.int32())], names=["x", "label", "m"])

    rows = df.select(F.col(vector).cast("array<double>").alias("v"), label.cast("int").alias("c"))
    return rows.repartition(tasks).mapInArrow(pack, "x binary, label binary, m int").rdd.map(lambda r: (bytes(r.x), bytes(r.label), r.m))


#: By number, the sums of what a function gives of each block's vectors and labels; and what adds them up over all blocks.
Sums = dict[int, np.ndarray]
Add = Callable[[Callable[[np.ndarray, np.ndarray], Sums]], Sums]


def totals(rows: Iterable[tuple[bytes, bytes, int]], sums_of: Callable[[np.ndarray, np.ndarray], Sums]) -> Sums:
    """The sums over some blocks."""
    total: Sums = {}
    for x, label, m in rows:
        for k, v in sums_of(np.frombuffer(x).reshape(-1, m), np.frombuffer(label, np.int32)).items():
            total[k] = total[k] + v if k in total else v
    return {k: v.astype(float) for k, v in total.items()}


def in_rounds(blocks: RDD, fit: Callable[[Add], object]) -> object:
    """fit(add), where each call of add is one pass over all blocks: a job, or where all blocks are in one task, a loop of that task,
    and then the whole fit is one job."""
    if blocks.getNumPartitions() > 1:
        return fit(lambda sums_of: added(blocks, sums_of))

    def run(rows: Iterator[tuple[bytes, bytes, int]]) -> Iterator[object]:
        held = list(rows)
        return iter([fit(lambda sums_of: totals(held, sums_of))])

    return blocks.mapPartitions(run).first()


def added(blocks: RDD, sums_of: Callable[[np.ndarray, np.ndarray], Sums]) -> Sums:
    """The sums over all blocks of what sums_of(vectors, labels) gives by number: one job, in which a task sends its totals."""

    def add(rows: Iterator[tuple[bytes, bytes, int]]) -> Iterator[tuple[int, bytes]]:
        return iter([(k, v.tobytes()) for k, v in totals(rows, sums_of).items()])

    out: dict[int, np.ndarray] = {}
    for k, s in blocks.mapPartitions(add).collect():
        v = np.frombuffer(s)
        out[k] = out[k] + v if k in out else v
    return out


def centre_sums(x: np.ndarray, centres: np.ndarray, metric: str) -> np.ndarray:
    """What new centres are made of, a row a centre: sums and counts of its vectors, of the points that warping paths put on it, or of
    the moved shapes' scatter."""
    k, m = centres.shape
    sums, of = np.zeros((k, m * m + m + 1 if metric == "shape" else 2 * m)), nearest(x, centres, metric)
    for c in np.unique(of):
        own = x[of == c]
        if metric == "euclidean":
            sums[c] = np.concatenate([own.sum(axis=0), np.full(m, len(own))])
        elif metric == "dtw":
            sums[c] = np.concatenate(warp_sums(own, centres[c]))
        else:
            y = shape_moved(znorm(own), centres[c])
            sums[c] = np.concatenate([(y.T @ y).ravel(), y.sum(axis=0), [len(y)]])
    return sums


def moved(total: np.ndarray, centres: np.ndarray, metric: str) -> np.ndarray:
    """New centres: means, means along warping paths, or the first eigenvector of the moved shapes' scatter."""
    k, m = centres.shape
    if metric != "shape":
        return np.where(total[:, m:] > 0, total[:, :m] / np.maximum(total[:, m:], 1e-300), centres)
    new, q = centres.copy(), np.eye(m) - 1 / m
    for c in range(k):
        if total[c, -1]:
            vec = np.linalg.eigh(q @ total[c, : m * m].reshape(m, m) @ q)[1][:, -1]
            new[c] = znorm(vec if vec @ total[c, m * m : -1] >= 0 else -vec)
    return new


def counted_sums(x: np.ndarray, times: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The Euclidean centre_sums of vectors that each count a number of times. Distances come from a product of matrices, about a point
    among the centres, so that little is lost to rounding."""
    k, about = len(centres), centres.mean(axis=0)
    c = centres - about
    of = ((x - about) @ c.T - (c**2).sum(axis=1) / 2).argmax(axis=1)
    count = np.bincount(of, times, k)
    return np.stack([*[np.bincount(of, v, k) for v in x.T * times], *[count] * x.shape[1]], axis=1)


def fit_all(blocks: RDD, starts: dict[int, np.ndarray], metric: str, rounds: int, within: bool = False, step: float | None = None, counted: bool = False) -> dict[int, np.ndarray]:
    """The centres of many fits, each over all vectors, or with `within` over those of the cluster that is its number. A round is one
    pass for all fits that still move. A fit ends when its centres stay or come back to earlier ones, or, with `step`, when none moves
    by more than that. With `counted`, which is for Euclidean fits, a vector's label is how often it counts."""

    def fit(add: Add) -> tuple[dict[int, np.ndarray], set[int]]:
        past, open_ = {k: [c] for k, c in starts.items()}, set(starts)
        for _ in range(rounds):
            if not open_:
                break
            now = {k: past[k][-1] for k in open_}

            def sums_of(x: np.ndarray, label: np.ndarray, now: dict[int, np.ndarray] = now) -> Sums:
                if counted:
                    times = label.astype(float)
                    return {k: counted_sums(x, times, c).ravel() for k, c in now.items()}
                parts = {k: x[label == k] if within else x for k in now}
                return {k: centre_sums(v, now[k], metric).ravel() for k, v in parts.items() if len(v)}

            total = add(sums_of)
            for k, c in now.items():
                new = moved(total[k].reshape(len(c), -1), c, metric) if k in total else c
                if step is None:
                    done = any(np.allclose(new, p, atol=1e-6) for p in past[k])
                else:
                    done = bool((((new - c) ** 2).sum(axis=1) <= step**2).all())
                past[k].append(new)
                if done:
                    open_.discard(k)
        return {k: p[-1] for k, p in past.items()}, open_

    out, open_ = in_rounds(blocks, fit)
    if open_:
        warnings.warn(f"{len(open_)} fits, of {sorted({len(starts[k]) for k in open_})} clusters, did not converge in {rounds} rounds", stacklevel=2)
    return out


#: How far a centre may move in the last round of a Euclidean fit that MLlib's KMeans starts: its own tolerance.
STEP = 1e-4


def euclidean_start(df: DataFrame, vector: str, k: int, seed: int) -> np.ndarray:
    """The start of MLlib's KMeans and one round of it."""
    rows = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return np.array(KMeans(k=k, seed=seed, maxIter=1).fit(rows).clusterCenters())


def first_centres(df: DataFrame, vector: str, k: int, seed: int) -> np.ndarray:
    """k different vectors by MD5 of (seed, vector)."""
    rows = df.select(F.col(vector).alias("v")).distinct().orderBy(draw(seed, F.col("v").cast("string")), F.col("v").cast("string")).limit(k).collect()
    return np.array([r.v for r in rows], float)


def first_pairs(df: DataFrame, vector: str, cluster: str, seed: int) -> dict[int, np.ndarray]:
    """first_centres of two, for each cluster that has two different vectors; two aggregations for all of them."""
    text = F.col(vector).cast("string")
    rows = df.where(F.col(cluster).isNotNull()).select(F.col(cluster).alias("c"), F.struct(draw(seed, text).alias("d"), text.alias("s"), F.col(vector).alias("v")).alias("r"))
    first = {x.c: x.r for x in rows.groupBy("c").agg(F.min("r").alias("r")).collect()}
    if not first:
        return {}
    seen = F.create_map(*[F.lit(y) for c, r in first.items() for y in (c, r.s)])
    second = {x.c: x.r for x in rows.where(F.col("r.s") != seen[F.col("c")]).groupBy("c").agg(F.min("r").alias("r")).collect()}
    return {c: np.array([first[c].v, r.v], float) for c, r in second.items()}


def uniform(x: np.ndarray, seed: int) -> np.ndarray:
    """A number between 0 and 1 for each row of x, without both, by its bits and the seed: equal rows have equal ones."""
    h = np.full(len(x), seed, np.uint64)
    for v in np.ascontiguousarray((x + 0.0).T).view(np.uint64):
        h = (h ^ v) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
    return ((h >> np.uint64(12)).astype(float) + 0.5) / 2.0**52


def spread_pairs(blocks: RDD, seed: int) -> dict[int, np.ndarray]:
    """The start of k-means++ with two centres, for each cluster that has two different vectors: one of its different vectors, and
    another with a chance in proportion to its squared distance from the first. Two passes for all clusters."""

    def least(score: Callable[[np.ndarray, int], np.ndarray]) -> dict[int, np.ndarray]:
        """The vector of each cluster with the least score."""

        def run(rows: Iterator[tuple[bytes, bytes, int]]) -> Iterator[tuple[int, tuple[float, tuple]]]:
            best: dict[int, tuple[float, tuple]] = {}
            for b, l, m in rows:
                x, label = np.frombuffer(b).reshape(-1, m), np.frombuffer(l, np.int32)
                for c in np.unique(label).tolist():
                    own = x[label == c]
                    s = score(own, c)
                    here = s.min(), min(map(tuple, own[s == s.min()].tolist()))
                    best[c] = min(best.get(c, here), here)
            return iter(best.items())

        out: dict[int, tuple[float, tuple]] = {}
        for c, r in blocks.mapPartitions(run).collect():
            out[c] = min(out.get(c, r), r)
        return {c: np.array(v) for c, (s, v) in out.items() if np.isfinite(s)}

    first = least(lambda x, c: uniform(x, seed))

    def race(x: np.ndarray, c: int) -> np.ndarray:
        # The least of exponential times whose rates are the squared distances.
        far = ((x - first[c]) ** 2).sum(axis=1)
        return np.where(far > 0, -np.log(uniform(x, seed + 1)) / np.where(far > 0, far, 1), np.inf)

    return {c: np.array([first[c], v]) for c, v in least(race).items()}


#: Passes of spread_starts, and how many vectors each draws for a centre of the largest fit, as MLlib's k-means|| does.
DRAWS, DRAWN = 5, 2
#: Rounds over what was drawn, of MLlib as well.
DRAWN_ROUNDS = 30


def spread_starts(blocks: RDD, ks: list[int], seed: int) -> dict[int, np.ndarray]:
    """The starts of k-means|| for each k, from the same passes over vectors whose label is how often they count: each pass draws
    vectors with chances in proportion to their count and squared distance from those drawn before; a last one counts how many vectors
    are nearest to each drawn one, and each k takes its start from these alone, by k-means++ and some rounds. Fewer different vectors than k
    are all taken. A draw depends on a vector and the seed only, not on the task that holds it."""
    drawn = np.empty((0, 0))
    for i in range(DRAWS + 1):
        many = DRAWN * max(ks) if i else 1

        def least(rows: Iterator[tuple[bytes, bytes, int]], i: int = i, many: int = many, drawn: np.ndarray = drawn) -> Iterator[list[tuple[float, tuple]]]:
            best: list[tuple[float, tuple]] = []
            for b, n, m in rows:
                x = np.frombuffer(b).reshape(-1, m)
                rate = np.frombuffer(n, np.int32) * (apart(x, drawn)[0] if i else 1.0)
                # The least of exponential times with these rates.
                time = np.where(rate > 0, -np.log(uniform(x, seed + i)) / np.where(rate > 0, rate, 1), np.inf)
                first = np.argsort(time, kind="stable")[:many]
                best = sorted([*best, *zip(time[first].tolist(), map(tuple, x[first].tolist()), strict=True)])[:many]
            return iter([[r for r in best if np.isfinite(r[0])]])

        found = sorted({r for part in blocks.mapPartitions(least).collect() for r in part})[:many]
        if not found:
            break
        drawn = np.concatenate([drawn, [v for _, v in found]]) if i else np.array([v for _, v in found])

    counts = added(blocks, lambda x, times: {0: np.bincount(apart(x, drawn)[1], times, len(drawn))})[0]
    return {k: drawn_start(drawn, counts, k, seed) for k in ks}


def apart(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The squared distance of each vector from its nearest centre, without rounding where they are equal, and that centre's number."""
    far, of = np.full(len(x), np.inf), np.zeros(len(x), int)
    for c, v in enumerate(centres):
        d = ((x - v) ** 2).sum(axis=1)
        of[d < far] = c
        np.minimum(far, d, out=far)
    return far, of


def drawn_start(x: np.ndarray, times: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centres of a few different vectors that count a number of times: k-means++ and at most DRAWN_ROUNDS rounds."""
    rng = np.random.default_rng([seed, k])
    centres = x[[rng.choice(len(x), p=times / times.sum())]]
    while len(centres) < min(k, len(x)):
        rate = times * apart(x, centres)[0]
        if not rate.any():
            break
        centres = np.concatenate([centres, x[[rng.choice(len(x), p=rate / rate.sum())]]])
    for _ in range(DRAWN_ROUNDS):
        last, centres = centres, moved(counted_sums(x, times, centres), centres, "euclidean")
        if np.allclose(last, centres, rtol=0, atol=STEP):
            break
    return centres


def fit_clusters(df: DataFrame, vector: str, k: int, metric: str = "euclidean", seed: int = 42, init: np.ndarray | None = None, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of k clusters, fitted until they stay or come back to earlier ones. Without init, Euclidean starts come from
    MLlib's KMeans, until no centre moves by more than its tolerance, and others from a drawn sample. Null vectors don't count; no
    vectors have no centres."""
    df = df.where(F.col(vector).isNotNull())
    if df.isEmpty():
        return np.empty((0, 0))
    step = STEP if init is None and metric == "euclidean" else None
    if init is None:
        init = euclidean_start(df, vector, k, seed) if metric == "euclidean" else first_centres(df, vector, k, seed)
        init = znorm(init) if metric == "shape" else init
    blocks = packed(df, vector, k * COST[metric]).cache()
    try:
        return fit_all(blocks, {0: init}, metric, rounds, step=step)[0]
    finally:
        blocks.unpersist()


def spherical_bic(count: np.ndarray, errors: float, d: int) -> float:
    """Log-likelihood of spherical Gaussians with one variance, less half the free parameters by log n, from the clusters' counts
    and the sum of squares about their means."""
    count = count[count > 0]
    n, k = count.sum(), len(count)
    if not errors > 0:
        return -np.inf
    var = errors / (n - k + 1e-10)
    like = -n * d / 2 * np.log(2 * np.pi * var) - errors / (2 * var) + (count * np.log(count)).sum() - n * np.log(n)
    return float(like - ((k - 1) + k * d + 1) / 2 * np.log(n))


def split_search(df: DataFrame, vector: str, metric: str = "euclidean", k_max: int = MAX_CLUSTERS, tol: float = 256, seed: int = 42, rounds: int = ROUNDS) -> DataFrame:
    """Clusters whose number grows: each cluster splits in two where that raises the BIC by more than tol; all are fitted
    anew, until none splits or k_max is passed. Adds cluster, null for a null vector; an empty table stays empty."""
    kept = df.select("*").cache()
    data = kept.where(F.col(vector).isNotNull())
    try:
        return assigned(stored(kept), vector, split_centres(data, vector, metric, k_max, tol, seed, rounds), metric)
    finally:
        kept.unpersist()


def first_halves(data: DataFrame, vector: str, seed: int, rounds: int) -> np.ndarray:
    """Two Euclidean clusters of all vectors; one of vectors that are all equal, and none without vectors."""
    blocks = packed(data, vector, 2).cache()
    try:
        start = spread_pairs(blocks, seed)
        if not start:
            one = data.select(vector).first()
            return np.empty((0, 0)) if one is None else np.array([one[0]], float)
        return fit_all(blocks, start, "euclidean", rounds, step=STEP)[0]
    finally:
        blocks.unpersist()


def split_centres(data: DataFrame, vector: str, metric: str, k_max: int, tol: float, seed: int, rounds: int) -> np.ndarray:
    """The centres that split_search ends with. The halves of all clusters are fitted side by side, a pass a round."""
    centres = first_halves(data, vector, seed, rounds) if metric == "euclidean" else fit_clusters(data, vector, 2, metric, seed, rounds=rounds)
    k = 3
    while k <= k_max:
        labelled = assigned(data, vector, centres, metric).cache()
        blocks = packed(labelled, vector, len(centres) * COST[metric], "cluster").cache()
        try:
            starts = spread_pairs(blocks, seed) if metric == "euclidean" else first_pairs(labelled, vector, "cluster", seed)
            starts = {c: znorm(v) if metric == "shape" else v for c, v in starts.items()}
            halves = fit_all(blocks, starts, metric, rounds, within=True, step=STEP if metric == "euclidean" else None)
            gain = split_gains(blocks, halves, metric)
            new = [x for c, own in enumerate(centres) for x in (halves[c] if c in gain and gain[c] > tol else [own])]
            if len(new) == len(centres):
                break
            k, centres = len(new), fit_all(blocks, {0: np.array(new)}, metric, rounds)[0]
        finally:
            blocks.unpersist()
            labelled.unpersist()
    return centres


def split_gains(blocks: RDD, halves: dict[int, np.ndarray], metric: str) -> dict[int, float]:
    """By how much the BIC of each cluster rises when its halves replace it: one pass for means, one for squares about them."""
    if not halves:
        return {}

    def means_of(x: np.ndarray, label: np.ndarray) -> dict[int, np.ndarray]:
        out = {}
        for c, two in halves.items():
            if (own := x[label == c]).size:
                of = nearest(own, two, metric)
                out[c] = np.concatenate([np.concatenate([[(of == h).sum()], own[of == h].sum(axis=0)]) for h in range(len(two))])
        return out

    sums = {c: v.reshape(len(halves[c]), -1) for c, v in added(blocks, means_of).items()}
    mean = {c: v[:, 1:] / np.maximum(v[:, :1], 1) for c, v in sums.items()}

    def squares_of(x: np.ndarray, label: np.ndarray) -> dict[int, np.ndarray]:
        out = {}
        for c, m in mean.items():
            if (own := x[label == c]).size:
                out[c] = np.array([((own - m[nearest(own, halves[c], metric)]) ** 2).sum()])
        return out

    within, gain = added(blocks, squares_of), {}
    for c, v in sums.items():
        count, d, errors = v[:, 0], v.shape[1] - 1, float(within[c][0])
        between = float((count[:, None] * (mean[c] - v[:, 1:].sum(axis=0) / count.sum()) ** 2).sum())
        # A cluster whose halves are both without spread has no likelihood to compare.
        two, one = spherical_bic(count, errors, d), spherical_bic(count.sum(keepdims=True), errors + between, d)
        gain[c] = two - one if np.isfinite(two) else -np.inf
    return gain


def xmeans(df: DataFrame, vector: str, metric: str = "euclidean", k_max: int = MAX_CLUSTERS, seed: int = 42) -> DataFrame:
    return split_search(df, vector, metric, k_max, seed=seed)


def xshapes(df: DataFrame, vector: str, k_max: int = MAX_CLUSTERS, seed: int = 42) -> DataFrame:
    return split_search(df, vector, "shape", k_max, seed=seed)


def log_density(v: Column, mean: np.ndarray, var: np.ndarray, weight: float) -> Column:
    const = float(np.log(max(weight, 1e-300)) - 0.5 * np.log(2 * np.pi * var).sum())
    terms = [(F.get(v, F.lit(i)) - F.lit(float(m))) * (F.get(v, F.lit(i)) - F.lit(float(m))) / F.lit(float(2 * s)) for i, (m, s) in enumerate(zip(mean, var, strict=True))]
    return F.lit(const) - sum(terms[1:], terms[0])


def mixtures(df: DataFrame, vector: str, ks: Iterable[int], seed: int = 42, rounds: int = ROUNDS, tol: float = 1e-4) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, float]]]:
    """Mixtures of Gaussians with diagonal covariance by expectation-maximisation, started from Euclidean fits, for each k: means,
    variances, weights, and log-likelihood, AIC and BIC. One round is one pass for all k that have not converged; each
    task sends k * (2 d + 1) + 1 sums a mixture. Null vectors don't count; without any there are no mixtures."""
    # Equal vectors are one row that counts as often as they occur: a fit is the same over them.
    data = df.where(F.col(vector).isNotNull()).groupBy(F.col(vector).cast("array<double>").alias("v")).agg(F.count(F.lit(1)).alias("n")).cache()
    try:
        return {} if data.isEmpty() else mixtures_of(data, list(ks), seed, rounds, tol)
    finally:
        data.unpersist()


def mixtures_of(data: DataFrame, ks: list[int], seed: int, rounds: int, tol: float) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, float]]]:
    """mixtures() of a table (v, n) that has vectors, each of them once."""
    blocks = packed(data, "v", sum(ks), "n").cache()
    try:
        fits = fit_all(blocks, spread_starts(blocks, ks, seed), "euclidean", ROUNDS, step=STEP, counted=True)
        return maximised(blocks, fits, rounds, tol)
    finally:
        blocks.unpersist()


def maximised(blocks: RDD, fits: dict[int, np.ndarray], rounds: int, tol: float) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, float]]]:
    """Expectation-maximisation of all mixtures from their centres, over blocks of vectors whose label is how often they count."""
    d = next(iter(fits.values())).shape[1]

    def fit(add: Add) -> tuple[dict, dict, set, int, np.ndarray]:
        s = add(lambda x, times: {0: np.concatenate([[times.sum(dtype=float)], times @ x])})[0]
        n, middle = int(s[0]), s[1:] / s[0]
        wide = np.maximum(add(lambda x, times: {0: times @ (x - middle) ** 2})[0] / n, 1e-6)
        # Vectors are taken from their mean, so that squares may be expanded into products of matrices.
        now = {k: (c - middle, np.tile(wide, (len(c), 1)), np.full(len(c), 1 / len(c))) for k, c in fits.items()}
        like, open_ = dict.fromkeys(now, -np.inf), set(now)

        for _ in range(rounds):
            factors = {}
            for k in sorted(open_):
                m, s, w = now[k]
                factors[k] = np.concatenate([m / s, -0.5 / s], axis=1), np.log(np.maximum(w, 1e-300)) - 0.5 * np.log(2 * np.pi * s).sum(axis=1) - (m**2 / (2 * s)).sum(axis=1)

            def sums_of(x: np.ndarray, times: np.ndarray, factors=factors) -> Sums:
                x = x - middle
                both = np.concatenate([np.ones((len(x), 1)), x, x**2], axis=1)
                powers, out = np.ascontiguousarray(both[:, 1:].T), {}
                for k, (by, const) in factors.items():
                    # A row a centre: steps over the centres of a mixture go along whole rows.
                    r = by @ powers + const[:, None]
                    top = r.max(axis=0)
                    r -= top
                    total = np.exp(r, out=r).sum(axis=0)
                    r *= times / total
                    sums = r @ both
                    out[k] = np.concatenate([[times @ (top + np.log(total))], sums[:, 0], sums[:, 1:].ravel()])
                return out

            for k, v in add(sums_of).items():
                c = now[k][2].size
                s0, s12 = np.maximum(v[1 : c + 1], 1e-10), v[c + 1 :].reshape(c, 2 * d)
                mean = s12[:, :d] / s0[:, None]
                now[k] = mean, np.maximum(s12[:, d:] / s0[:, None] - mean**2, 1e-6), s0 / n
                if abs(v[0] - like[k]) < tol * max(1.0, abs(v[0])):
                    open_.discard(k)
                like[k] = float(v[0])
            if not open_:
                break
        return now, like, open_, n, middle

    now, like, open_, n, middle = in_rounds(blocks, fit)
    if open_:
        warnings.warn(f"mixtures of {sorted(open_)} did not converge in {rounds} rounds", stacklevel=2)
    now = {k: (m + middle, s, w) for k, (m, s, w) in now.items()}
    free = {k: w.size - 1 + 2 * m.size for k, (m, _, w) in now.items()}
    return {k: (*now[k], {"log_likelihood": like[k], "aic": -2 * like[k] + 2 * free[k], "bic": -2 * like[k] + free[k] * float(np.log(n))}) for k in now}


def mixture_clusters(df: DataFrame, vector: str, k: int, seed: int = 42, rounds: int = ROUNDS, tol: float = 1e-4) -> tuple[DataFrame, dict[str, float]]:
    """df with the likeliest cluster of a mixture of k, null for a null vector, and the mixture's log-likelihood, AIC and BIC, NaN without
    vectors."""
    kept = df.select("*").cache()
    try:
        df, fits = stored(kept), mixtures(kept, vector, [k], seed, rounds, tol)
    finally:
        kept.unpersist()
    if not fits:
        return df.withColumn("cluster", F.lit(None).cast("int")), dict.fromkeys(("log_likelihood", "aic", "bic"), float("nan"))
    mean, var, weight, score = fits[k]
    v = F.col(vector).cast("array<double>")
    logs = F.array(*[log_density(v, mean[c], var[c], weight[c]) for c in range(len(weight))])
    return df.withColumn("cluster", (F.array_position(logs, F.array_max(logs)) - 1).cast("int")), score


def best_k(results: list[tuple[int, float, float]]) -> int:
    """Of (k, aic, bic) in order of k, the last that lowers both against the best so far."""
    best, low = None, (np.inf, np.inf)
    for k, aic, bic in sorted(results):
        if aic < low[0] and bic < low[1]:
            best, low = k, (aic, bic)
    return best


def vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(df)


def model_select(df: DataFrame, columns: list[str], target: str, seed: int = 42) -> list[str]:
    """Columns less important than the mean to a fitted tree model."""
    fit = GBTRegressor(labelCol=target, maxIter=boosted.TREES, seed=seed).fit(vectors(df, columns))
    weight = fit.featureImportances.toArray()
    return [c for c, w in zip(columns, weight, strict=True) if w < weight.mean()]


def eliminate(df: DataFrame, columns: list[str], target: str, eliminators: list[Callable[[DataFrame, list[str], str], list[str]]]) -> list[str]:
    """What a sequence of eliminators drops; each sees what the ones before it left."""
    gone: list[str] = []
    for e in eliminators:
        gone += e(df, [c for c in columns if c not in gone], target)
    return gone


#: Linear models by name, with their losses: all fits of a sweep share their passes.
LINEAR = {"logistic": "logistic", "svc": "squared_hinge"}
#: Boosted models by name, with their losses: their trees grow side by side and share their passes as well.
BOOSTED = {"boosted": "logistic"}


#: Rows that one task of a fit takes at least; small tables are fitted by few tasks, whose start would take most of the time.
ROWS_A_TASK = 100_000


def fit_predict(train: DataFrame, test: DataFrame, columns: list[str], target: str, model) -> DataFrame:
    """test with prediction and confidence of class 1, fitted on train with balanced class weights."""
    # Classes are few: their counts make the weights and the number of tasks.
    counts = {r[0]: r[1] for r in train.groupBy(target).count().collect() if r[0] is not None}
    total = sum(counts.values())
    weight = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, total / (len(counts) * n))])[F.col(target)]
    rows = vectors(train.where(F.col(target).isNotNull()), columns).select("features", F.col(target).cast("double").alias("label"), weight.alias("weight"))
    out = model().fit(rows.coalesce(-(-total // ROWS_A_TASK))).transform(vectors(test, columns))
    score = F.get(vector_to_array("probability"), F.lit(1)) if "probability" in out.columns else 1 / (1 + F.exp(-F.get(vector_to_array("rawPrediction"), F.lit(1))))
    return out.select(*test.columns, F.col("prediction").cast("int").alias("prediction"), score.alias("confidence"))


def predictions(tasks: list[tuple[DataFrame, DataFrame, Callable[[DataFrame, DataFrame], DataFrame]]]) -> DataFrame:
    """The rows of all tasks (train, test, fit and predict), fitted several at once. The tables are stored ones: a fit runs dozens of
    short jobs, whose plans should be short as well."""
    return reduce(DataFrame.unionByName, each([lambda t=t: t[2](t[0], t[1]) for t in tasks]))


def named(out: DataFrame, target: str, model: str, config: str, more: list[Column], confidence: str | None) -> DataFrame:
    return out.select(F.lit(model).alias("model"), F.lit(config).alias("config"), *more, "id", "prediction", F.col(target).alias("target"), *([confidence] if confidence else []))


def shared_classifiers(data: DataFrame, test: DataFrame, configs: dict[str, list[str]], target: str, fold: str | None, lines: dict[str, str], boosted_ones: dict[str, str]) -> list[DataFrame]:
    """Predictions of test by every linear and every boosted model and configuration, fitted on the rows of data outside a test row's own
    fold. A target that is no class of 0 and 1 (the larger of two values is 1) is refused."""
    kind = data.schema[target].dataType
    classes = sorted(r[0] for r in data.where(F.col(target).isNotNull()).select(target).distinct().limit(3).collect())
    if len(classes) > 2:
        raise ValueError(f"{target} has more than two classes")
    low, high = (classes[0], classes[-1]) if len(classes) == 2 else (0, 1)
    folds = sorted(r[0] for r in data.select(fold).distinct().collect()) if fold else [None]
    rows = data.withColumn("_y", F.when(F.col(target) == high, 1.0).when(F.col(target) == low, 0.0))
    keep = [*([fold] if fold else []), "id", target]

    def out(scores: DataFrame, fits: list, slope: int) -> DataFrame:
        name = lambda i: F.get(F.array(*[F.lit(f.key[i]) for f in fits]), F.col("fit"))
        more = [F.col(fold).alias("fold")] if fold else []
        label = F.when(F.col("z") > 0, F.lit(high).cast(kind)).otherwise(F.lit(low).cast(kind)).cast("int")
        return scores.select(name(0).alias("model"), name(1).alias("config"), *more, "id", label.alias("prediction"), F.col(target).alias("target"), (1 / (1 + F.exp(-slope * F.col("z")))).alias("confidence"))

    every = lambda make, models: [make((m, c), columns, "_y", loss, f) for m, loss in models.items() for c, columns in configs.items() for f in folds]
    parts = []
    if lines:
        fits = linear.fit_all(rows, every(linear.Fit, lines), fold)
        parts.append(out(linear.predict_all(test, fits, keep, fold), fits, 1))
    if boosted_ones:
        fits = every(boosted.Fit, boosted_ones)
        # The scores of the boosting loss are half of the log odds.
        parts.append(out(boosted.predict_all(test, fits, boosted.fit_all(rows, fits, fold), keep, fold), fits, 2))
    return parts


def joined(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def train_classifiers(df: DataFrame, configs: dict[str, list[str]], target: str, fold: str = "fold", models: dict | None = None, lines: dict[str, str] | None = None, boosts: dict[str, str] | None = None) -> DataFrame:
    """Out-of-fold predictions of each model and configuration (a name and its columns): (model, config, fold, id, ...). Linear and
    boosted models (`lines`, `boosts`: names and losses) are fitted together, whatever the number of folds and configurations; others
    (`models`, makers of MLlib classifiers) are a fit each."""
    data, lines, boosts, models = stored(df), LINEAR if lines is None else lines, BOOSTED if boosts is None else boosts, models or {}
    folds = sorted(r[0] for r in data.select(fold).distinct().collect())
    tasks = [
        (data.where(F.col(fold) != f), data.where(F.col(fold) == f), lambda a, b, m=m, name=name, config=config, columns=columns: named(fit_predict(a, b, columns, target, m), target, name, config, [F.col(fold).alias("fold")], "confidence"))
        for name, m in models.items() for config, columns in configs.items() for f in folds
    ]
    return joined(shared_classifiers(data, data, configs, target, fold, lines, boosts) + ([predictions(tasks)] if tasks else []))


def train_holdout_sweep(train: DataFrame, test: DataFrame, configs: dict[str, list[str]], target: str, models: dict | None = None, lines: dict[str, str] | None = None, boosts: dict[str, str] | None = None) -> DataFrame:
    """The same on a given pair of tables instead of folds."""
    train, test, lines, boosts, models = stored(train), stored(test), LINEAR if lines is None else lines, BOOSTED if boosts is None else boosts, models or {}
    tasks = [(train, test, lambda a, b, m=m, name=name, config=config, columns=columns: named(fit_predict(a, b, columns, target, m), target, name, config, [], "confidence")) for name, m in models.items() for config, columns in configs.items()]
    return joined(shared_classifiers(train, test, configs, target, None, lines, boosts) + ([predictions(tasks)] if tasks else []))


def train_regressors(train: DataFrame, test: DataFrame, configs: dict[str, tuple[list[str], str]]) -> DataFrame:
    """Predictions of linear and boosted models for each configuration of input columns and a target column: the linear ones from two
    passes over train, the boosted ones from a pass a level of a tree."""
    train, test = stored(train), stored(test)
    targets = [*dict.fromkeys(t for _, t in configs.values())]
    keep = ["id", *targets]

    def out(scores: DataFrame, fits: list, model: str) -> DataFrame:
        own = F.coalesce(*[F.when(F.col("fit") == i, F.col(f.target).cast("double")) for i, f in enumerate(fits)])
        return scores.select(F.lit(model).alias("model"), F.get(F.array(*[F.lit(c) for c in configs]), F.col("fit")).alias("config"), "id", F.col("z").alias("prediction"), own.alias("target"))

    every = lambda make: [make((c,), columns, target, "squared") for c, (columns, target) in configs.items()]
    lines, boosts = linear.fit_all(train, every(linear.Fit)), every(boosted.Fit)
    return joined([out(linear.predict_all(test, lines, keep), lines, "linear"), out(boosted.predict_all(test, boosts, boosted.fit_all(train, boosts), keep), boosts, "boosted")])
