"""Exact k-means on integer vectors with ns-bounds.

Each vector remembers, for each centroid, its distance at the round in which that distance was last worked out. The history
of all centroids is kept, so such a bound is loosened by the norm of the centroid's total displacement since that round, which
is never more than the sum of its drifts. A vector whose loosened upper bound stays below every loosened lower bound keeps its
centroid unseen; the others have the distance to their own centroid renewed, and then to each centroid that may be as near.
Distances are whole numbers, so comparisons of renewed ones are exact; bounds have a margin for the rounding of square roots.

State (the vector, its centroid, the remembered distances and their rounds) is written to the shared folder each round and the
last round's goes. Sums for the new centroids travel in the same rows: the first row of a batch for each centroid
holds the batch's sums, so one small column is read back. The driver holds the centroids' history, k x rounds vectors.

Vectors are kept if they have exactly `size` components, none null or not finite; the others are left out. Components become
floor(scale * x). A component beyond 2**27 would overflow 64-bit distances and is refused. Ties go to the smaller centroid; with
fewer vectors than k there are fewer centroids, and no vectors give no rows. Equal start hashes (repeated or null ids: a null
one is the text "") are ordered by their vectors. Repeated rows count each; extra columns are kept, those with the
names of added ones are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PIECE, removed, stored, table, with_fields, without

SIZE, K, ROUNDS, SCALE = 64, 8, 10, 1024
LIMIT = 1 << 27
#: Relative and absolute room for the rounding of square roots of whole numbers below 2**63.
ROOM, LEAST = 1e-12, 1e-6
ADDED = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def integers(df: DataFrame, vector: str, size: int, scale: int) -> DataFrame:
    """(row, x) of the vectors that are kept; row is a struct of the other columns."""
    v = df[f"`{vector}`"]
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    row = F.struct(*[df[f"`{c}`"] for c in without(df, ADDED).columns if c != vector]).alias("row")
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    # A cast of a larger number would stop the job without saying why.
    small = F.forall(v, lambda x: F.abs(x.cast("double") * scale) <= LIMIT)
    checked = F.when(small, scaled).otherwise(F.raise_error(F.lit(f"a component beyond {LIMIT} / {scale} has no 64-bit distances")))
    kept = df.where((F.size(v) == size) & finite)
    return kept.select(row, checked.cast("array<long>").alias("x"))


def starts(vectors: DataFrame, key: str, k: int) -> np.ndarray:
    """The k vectors with the smallest hashes, in their order: a top-k, so no task holds more than k of its rows."""
    text = F.concat(F.lit("3:"), F.coalesce(F.col("row")[key].cast("string"), F.lit("")))
    first = vectors.select(F.sha2(text, 256).alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r.x for r in first], np.int64)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def assign(x: np.ndarray, own: np.ndarray | None, known: np.ndarray | None, seen: np.ndarray | None, history: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own, known, seen) after the newest round of history (rounds x k x size): the nearest centroid of each row of x, and for each
    centroid the last distance and its round. Without a state, all distances are worked out."""
    last, (n, k) = len(history) - 1, (len(x), history.shape[1])
    if own is None:
        exact = np.stack([distances(x, c) for c in history[last]], axis=1) if n else np.zeros((0, k), np.int64)
        return exact.argmin(axis=1), np.sqrt(exact.astype(np.float64)), np.full((n, k), last)
    own, known, seen, rows = own.copy(), known.copy(), seen.copy(), np.arange(n)
    moved = np.sqrt(((history[last] - history).astype(np.float64) ** 2).sum(axis=2))
    slack = moved[seen, np.arange(k)]
    room = ROOM * (known + slack) + LEAST
    low = known - slack - room
    high = (known + slack + room)[rows, own]
    low[rows, own] = np.inf
    open_ = np.flatnonzero(low.min(axis=1) <= high) if k > 1 else rows[:0]
    if len(open_):
        exact = np.full((len(open_), k), np.iinfo(np.int64).max)
        mine = own[open_]
        exact[np.arange(len(open_)), mine] = distances(x[open_], history[last][mine])
        near = exact[np.arange(len(open_)), mine].astype(np.float64) ** 0.5
        near += ROOM * near + LEAST
        for j in range(k):
            at = np.flatnonzero((low[open_, j] <= near) & (mine != j))
            exact[at, j] = distances(x[open_[at]], history[last][j])
        fresh = exact != np.iinfo(np.int64).max
        known[open_] = np.where(fresh, np.sqrt(exact.astype(np.float64)), known[open_])
        seen[open_] = np.where(fresh, last, seen[open_])
        own[open_] = exact.argmin(axis=1)
    return own, known, seen


def matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), width)


def lists(a: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(a.ravel(), kind))


STATE = "x array<bigint>, own int, known array<double>, seen array<int>, n bigint, sums array<bigint>"


def advanced(state: DataFrame, history: np.ndarray) -> DataFrame:
    """The state after one more round; rows come without one at first. n and sums are those of a batch's rows with one centroid, in the
    first of these rows."""
    k, size = history.shape[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PIECE):
                b = whole.slice(at, PIECE)
                x = matrix(b.column("x"), size, np.int64)
                old = (None,) * 3 if "own" not in b.schema.names else (b.column("own").to_numpy(), matrix(b.column("known"), k, np.float64), matrix(b.column("seen"), k, np.int64))
                own, known, seen = assign(x, *old, history)
                n, sums = [None] * len(x), [None] * len(x)
                for j, first in zip(*np.unique(own, return_index=True), strict=True):
                    n[first], sums[first] = int((own == j).sum()), x[own == j].sum(axis=0)
                made = [b.column("x"), pa.array(own, pa.int32()), lists(known, pa.float64()), lists(seen, pa.int32()), pa.array(n, pa.int64()), pa.array(sums, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column("row"), *made], names=["row", "x", "own", "known", "seen", "n", "sums"])

    return state.mapInArrow(run, with_fields(state.select("row").schema, STATE))


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the exact means; a centroid without vectors stays."""
    parts = state.where("n is not null").select("own", "n", F.posexplode("sums").alias("i", "s"))
    wide = parts.groupBy("own", "i").agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).alias("s"))
    out = centroids.copy()
    for r in wide.collect():
        out[r.own, r.i] = int(r.s) // int(r.n)
    return out


def clustered(df: DataFrame, vector: str, key: str, *, size: int = SIZE, k: int = K, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """The kept rows of df, without the vector, with cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 (of the
    centroid's components as decimal integers, joined by commas)."""
    vectors = integers(df, vector, size, scale)
    first = starts(vectors, key, k)
    if not len(first):
        schema = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return vectors.select("row.*", *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in schema.split(", ")]).where("false")
    history = first[None]
    state = stored(advanced(vectors, history))
    for _ in range(rounds):
        history = np.concatenate([history, moved(state, history[-1])[None]])
        before, state = state, stored(advanced(state.select("row", "x", "own", "known", "seen"), history))
        removed(before)
    final = history[-1]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("own").to_numpy()
            d = distances(matrix(b.column("x"), size, np.int64), final[own])
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("own"), pa.array(d, pa.int64())], names=["row", "cluster", "distance"])

    out = state.select("row", "x", "own").mapInArrow(measure, with_fields(state.select("row").schema, "cluster int, distance bigint"))
    total = {r.cluster: int(r.s) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in final]
    facts = out.sparkSession.createDataFrame([(j, s, sum(total.values()), digest[j]) for j, s in total.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # At most k rows.
    return out.join(F.broadcast(facts), "cluster").select("row.*", *ADDED)


def op13_ns_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after ten rounds."""
    return clustered(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", "vec_id")


QUERIES = {"op13_ns_bounds": op13_ns_bounds}


def rounds_sql(rounds: int = ROUNDS) -> str:
    """The rounds one after the other, each distance worked out."""
    distance = "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    nearest = "a{r} AS MATERIALIZED (SELECT vec_id, x, j, d FROM (SELECT v.vec_id, v.rowid_ AS w, x, j, {distance} AS d, row_number() OVER (PARTITION BY v.rowid_ ORDER BY {distance}, j) AS place FROM v, c{r}) WHERE place = 1)"
    mean = """m{r} AS (SELECT j, list(floor_ ORDER BY i) AS c FROM (SELECT j, i, CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END AS floor_
FROM (SELECT j, i, sum(y)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT j, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY j, i)) GROUP BY j),
c{next} AS MATERIALIZED (SELECT c{r}.j, coalesce(m{r}.c::BIGINT[], c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON c{r}.j = m{r}.j)"""
    steps = []
    for r in range(rounds + 1):
        steps.append(nearest.format(r=r, distance=distance))
        if r < rounds:
            steps.append(mean.format(r=r, next=r + 1))
    return f"""WITH e AS (SELECT vec_id, row_number() OVER () AS rowid_, embedding FROM embeddings
WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = {SIZE}),
v AS MATERIALIZED (SELECT vec_id, rowid_, list_transform(embedding, lambda y: floor({SCALE} * y::DOUBLE)::BIGINT) AS x FROM e),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS j, x AS c FROM (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM v ORDER BY h, x LIMIT {K})),
{", ".join(steps)},
k AS (SELECT j, sum(d)::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY j)
SELECT vec_id, a{rounds}.j::INTEGER AS cluster, d AS distance, cluster_inertia, (SELECT sum(d)::BIGINT FROM a{rounds}) AS inertia,
sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN k ON a{rounds}.j = k.j JOIN c{rounds} ON a{rounds}.j = c{rounds}.j"""


ORACLES = {"op13_ns_bounds": rounds_sql()}
