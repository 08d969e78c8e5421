"""Resampling tests of AUC against plain numpy, and how their work is dealt out."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lachesis.operators import replicates as R


def draw(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def auc(t, s):
    p, q = s[t == 1], s[t == 0]
    return ((p[:, None] > q).sum() + (p[:, None] == q).sum() / 2) / (len(p) * len(q)) if len(p) and len(q) else None


def rows(seed, n=60, ties=7):
    rng = random.Random(seed)
    out = [(g, f"{g or 'z'}{i:03d}", rng.choice([0, 1]), rng.choice([0.5, rng.randrange(ties) / ties])) for g in ("a", "b", None) for i in range(n)]
    return [*out, ("c", "c0", 1, 0.2), ("c", "c1", 1, 0.3), ("d", "d0", None, 0.1), ("d", "d1", 1, None), ("d", "d2", 0, 0.4), ("d", "d3", 1, 0.9)]


@pytest.mark.parametrize("n", [1, 2, 8, 9, 40])
def test_bootstrap_replicates(spark, n, monkeypatch):
    """All replicates of all groups, over spans and blocks smaller than a group."""
    monkeypatch.setattr(R, "SPAN", 16)
    data = rows(n)
    df = spark.createDataFrame(data, "g string, id string, target int, confidence double").repartition(3)
    got = {r.g: r.auc for r in R.bootstrap_auc(df, ["g"], ["id"], n, seed=4).collect()}
    for g in {x[0] for x in data}:
        own = sorted((x for x in data if x[0] == g), key=lambda x: x[1])
        t = np.array([-1 if x[2] is None else x[2] for x in own])
        s = np.array([-np.inf if x[3] is None else x[3] for x in own])
        for rep in range(n):
            at = np.array([draw(4, rep, j) % len(own) for j in range(len(own))])
            want = auc(t[at], s[at])
            assert got[g][rep] == (None if want is None else pytest.approx(want, abs=1e-12))


@pytest.mark.parametrize("n", [1, 7, 30])
def test_permuted_replicates(spark, n):
    rng = random.Random(n)
    data = [(g, i, i % 3, rng.choice([0, 1, 1, None]), rng.choice([0.1, 0.5, rng.random()]), rng.choice([0.5, None, rng.random()])) for g in ("a", None) for i in range(50)]
    df = spark.createDataFrame(data, "pair string, id long, fold int, target int, confidence_a double, confidence_b double")
    got = {(r.pair, r.side): r.auc for r in R.permuted_auc(df, ["pair"], ["id", "fold"], n, seed=2).collect()}
    test = {r.pair: r for r in R.permutation_test_auc(df, ["pair"], ["id", "fold"], n, seed=2).collect()}
    for g in ("a", None):
        own = [x for x in data if x[0] == g and x[3] is not None]
        t = np.array([x[3] for x in own])
        a, b = (np.array([-np.inf if x[k] is None else x[k] for x in own]) for k in (4, 5))
        d = []
        for rep in range(-1, n):
            swap = np.array([rep >= 0 and draw(2, rep, x[1], x[2]) % 2 == 1 for x in own])
            x, y = auc(t, np.where(swap, b, a)), auc(t, np.where(swap, a, b))
            assert (got[g, "a"][rep + 1], got[g, "b"][rep + 1]) == (pytest.approx(x, abs=1e-12), pytest.approx(y, abs=1e-12))
            d.append(x - y)
        assert test[g].difference == pytest.approx(d[0]) and test[g].p_value == pytest.approx(np.mean(np.abs(d[1:]) >= abs(d[0]) - 1e-12))


def test_draws_are_dealt_over_tasks(spark):
    """No task makes more than twice its share of the draws, from a table of one row."""
    sizes = spark.createDataFrame([("a", 3000)], "g string, n long").coalesce(1)
    made = R.draws_of(sizes, ["g"], 200, 0).withColumn("task", F.spark_partition_id())
    n = [r.n for r in made.groupBy("task").agg(F.sum(F.octet_length("rep") / 4).alias("n")).collect()]
    cells = {}
    for r in made.collect():
        for rep, at, times in zip(np.frombuffer(r.rep, np.uint32), np.frombuffer(r.at, np.uint16), np.frombuffer(r.times, np.uint32), strict=True):
            cells[rep, r.span * R.SPAN + at] = cells.get((rep, r.span * R.SPAN + at), 0) + times
    assert sum(cells.values()) == 600_000 and len(n) == R.tasks(sizes) and max(n) <= 2 * sum(n) / len(n)
    assert all(sum(t for (r, _), t in cells.items() if r == rep) == 3000 for rep in (0, 15, 16, 199))


def test_a_hot_score_is_few_rows(spark, monkeypatch):
    """Equal scores are added up before they are dealt by score."""
    seen = []
    old = R.replicate_auc
    monkeypatch.setattr(R, "replicate_auc", lambda e, by, n: seen.append(e.groupBy("score").count().collect()) or old(e, by, n))
    df = spark.range(20_000).select(F.lit(1).alias("g"), "id", (F.col("id") % 2).alias("target"), F.when(F.col("id") % 3 > 0, 0.5).otherwise(F.col("id") / 20_000).alias("confidence"))
    R.bootstrap_auc(df, ["g"], ["id"], 10).collect()
    assert max(r["count"] for r in seen[0]) <= 2 * (20_000 // R.SPAN + 1)


def test_no_predictions(spark):
    df = spark.createDataFrame([], "g string, id long, target int, confidence double, confidence_a double, confidence_b double")
    assert R.bootstrap_auc_ci(df, ["g"], ["id"], 5).count() == 0 and R.permutation_test_auc(df, ["g"], ["id"], 5).count() == 0


def test_which_pairs(spark):
    data = [(c, i, i % 2, 0, j / 10) for j, c in enumerate(("t0", "t10", "t2")) for i in range(3)]
    df = spark.createDataFrame(data, "config string, id long, target long, prediction int, confidence double")
    names = lambda **kw: sorted(r.pair for r in R.all_pairs(df, [], "config", ["id"], **kw).select("pair").distinct().collect())
    assert names() == ["t0 / t10", "t0 / t2", "t10 / t2"]
    order = ["t0", "t2", "t10"]
    assert names(which="adjacent", order=order) == ["t0 / t2", "t2 / t10"] and names(which="first", order=order) == ["t0 / t10", "t0 / t2"]
    assert names(which="adjacent", order=["t2", "t0"]) == ["t2 / t0"]
    with pytest.raises(ValueError, match="adjacent"):
        names(which="some")
