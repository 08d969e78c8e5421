"""Clusters against plain rounds in exact integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from lachesis.llm import centroids, registry


def brute(rows, size=64, k=8, rounds=10, scale=1024):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [list(v) for _, v in first]
    if not c:
        return []
    x = np.array([v for _, v in kept], np.int64)

    def assigned():
        d = np.stack([((x - np.array(y, np.int64)) ** 2).sum(axis=1) for y in c], axis=1)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        own, _ = assigned()
        for j in range(len(c)):
            if (own == j).any():
                c[j] = [int(s) // int((own == j).sum()) for s in x[own == j].sum(axis=0)]
    own, d = assigned()
    digest = [hashlib.sha256(",".join(map(str, y)).encode()).hexdigest() for y in c]
    return sorted(((i, int(o), int(e), int(d[own == o].sum()), int(d.sum()), digest[o]) for (i, _), o, e in zip(kept, own, d, strict=True)), key=str)


def got(df, *more):
    return sorted((tuple(r) for r in df.select("vec_id", *centroids.ADDED, *more).collect()), key=str)


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    df = registry.queries()["op13_ns_bounds"](spark, "/root/testdata/sf0.01")
    assert df.columns == ["vec_id", *centroids.ADDED] and got(df) == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_awkward_vectors(spark, seed):
    """Copies, ties, other lengths, nulls, NaN and infinities, negative components, clashing names."""
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) + (rng.random() if i % 2 else 0) for _ in range(3)]) for i in range(60)]
    rows += [(i, [0.25, 0.25, 0.25]) for i in range(100, 130)] + [rows[3], rows[3], (None, [1.0, 2.0, 3.0]), (None, [0.0, 2.0, 3.0])]
    bad = [(7, None), (8, []), (9, [1.0, 2.0]), (10, [1.0, None, 2.0]), (11, [math.nan, 1.0, 1.0]), (12, [math.inf, 1.0, 1.0]), (13, [-math.inf, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "own", 5) for i, v in rows + bad], "vec_id long, embedding array<double>, `a.b` string, cluster int")
    out = centroids.clustered(df, "embedding", "vec_id", size=3, k=5, rounds=4)
    assert out.columns == ["vec_id", "a.b", *centroids.ADDED]
    assert got(out) == brute(rows + bad, 3, 5, 4) and {r["a.b"] for r in out.collect()} == {"own"}


def test_few_and_no_vectors(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert got(centroids.clustered(one, "embedding", "vec_id", size=2)) == brute([(1, [1.0, 2.0])], 2)
    none = centroids.clustered(one.where("false"), "embedding", "vec_id", size=2)
    assert none.count() == 0 and none.columns == ["vec_id", *centroids.ADDED]
    with pytest.raises(Exception, match="64-bit"):
        centroids.clustered(spark.createDataFrame([(1, [1e30, 2.0])], "vec_id long, embedding array<double>"), "embedding", "vec_id", size=2)


def test_bounds_spare_distances():
    """After the first round few distances are worked out, and each assignment is that of a full scan."""
    rng = np.random.default_rng(1)
    x = (rng.integers(0, 8, (2000, 1)) * 400 + rng.integers(-120, 120, (2000, 16))).astype(np.int64)
    history, state, made = x[:8][None].copy(), (None,) * 3, []
    old = centroids.distances
    centroids.distances = lambda a, c: made.append(len(a)) or old(a, c)
    try:
        for r in range(10):
            made.clear()
            state = centroids.assign(x, *state, history)
            spent = sum(made)
            full = np.stack([((x - c) ** 2).sum(axis=1) for c in history[-1]], axis=1)
            assert (state[0] == full.argmin(axis=1)).all()
            assert r < 5 or spent < len(x)
            c = history[-1].copy()
            for j in range(8):
                if (state[0] == j).any():
                    c[j] = x[state[0] == j].sum(axis=0) // (state[0] == j).sum()
            history = np.concatenate([history, c[None]])
    finally:
        centroids.distances = old


def test_displacement_is_not_summed():
    """A centroid that comes back to where it was leaves a bound as tight as it was."""
    a, b = np.array([[0, 0], [100, 0]], np.int64), np.array([[40, 0], [60, 0]], np.int64)
    x = np.array([[0, 1], [100, 1]], np.int64)
    state = centroids.assign(x, None, None, None, a[None])
    state = (state[0], state[1], state[2])
    made = []
    old = centroids.distances
    centroids.distances = lambda p, c: made.append(len(p)) or old(p, c)
    try:
        centroids.assign(x, *state, np.stack([a, b, a]))
    finally:
        centroids.distances = old
    assert sum(made) == 0
