"""Boosted trees of a sweep against single fits of MLlib, and their number of jobs."""

import uuid

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from lachesis.operators import boosted as B
from lachesis.operators import cluster as L


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.gamma(1.0, 30, (300, 3)), 1) * (rng.random((300, 3)) > 0.2)
    y = (x[:, 0] + rng.normal(0, 20, 300) > x[:, 1]).astype(int)
    table = [(f"r{i}", *map(float, x[i]), int(y[i]), float(2 * x[i, 0] - x[i, 2] + rng.normal()), i % 3) for i in range(300)]
    return spark.createDataFrame(table, "id string, a double, b double, c double, y int, v double, fold int").cache()


CONFIGS = {"a": ["a"], "a-b": ["a", "b"], "a-c": ["a", "b", "c"]}


def jobs(spark, run):
    """The number of jobs that a call makes."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "count")
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("alone", [B.ALONE, 0])
def test_classifiers_are_those_of_mllib(spark, rows, monkeypatch, alone):
    """In one task and with a job a level: the same predictions as a fit of MLlib each, with balanced weights. Sums of several tasks
    differ by rounding, which settles between splits that part a small node alike (in MLlib as well)."""
    monkeypatch.setattr(B, "ALONE", alone)
    fits = [B.Fit((c, f), columns, "y", "logistic", f) for c, columns in CONFIGS.items() for f in (0, 1, 2)]
    data = rows.withColumn("y", F.col("y").cast("double"))
    got = B.predict_all(data, fits, B.fit_all(data, fits, "fold", 6), ["id"], "fold").toPandas()
    assert len(got) == 3 * 300
    same = []
    for k, f in enumerate(fits):
        out = rows.where(F.col("fold") == f.out)
        want = L.fit_predict(rows.where(F.col("fold") != f.out), out, f.columns, "y", lambda: GBTClassifier(maxIter=6, seed=42, weightCol="weight")).toPandas().set_index("id")
        mine = got[got.fit == k].set_index("id").z.reindex(want.index)
        same += [*(np.abs(1 / (1 + np.exp(-2 * mine)) - want.confidence) < 1e-9)]
        assert ((mine > 0) == (want.prediction == 1)).mean() > 0.95
    assert np.mean(same) == 1 if alone else np.mean(same) > 0.9


@pytest.mark.parametrize("alone", [B.ALONE, 0])
def test_regressors_are_those_of_mllib(spark, rows, monkeypatch, alone):
    monkeypatch.setattr(B, "ALONE", alone)
    fits, same = [B.Fit((c, t), columns, t, "squared") for t in ("v", "c") for c, columns in CONFIGS.items()], []
    got = B.predict_all(rows, fits, B.fit_all(rows, fits, None, 6), ["id"]).toPandas()
    for k, f in enumerate(fits):
        want = GBTRegressor(labelCol=f.target, maxIter=6, seed=42).fit(L.vectors(rows, f.columns).coalesce(1)).transform(L.vectors(rows, f.columns)).toPandas().set_index("id").prediction
        same += [*np.isclose(got[got.fit == k].set_index("id").z.reindex(want.index), want, atol=1e-7)]
    assert np.mean(same) == 1 if alone else np.mean(same) > 0.9


def test_jobs_do_not_grow_with_fits(spark, rows, monkeypatch):
    """Whole sweeps of 100 trees make a handful of jobs on a small table, and a job a level on a large one, whatever the number of fits."""
    assert jobs(spark, lambda: L.train_classifiers(rows, CONFIGS, "y", lines={}).count()) < 40
    assert jobs(spark, lambda: L.train_regressors(rows, rows, {c: (columns, "v") for c, columns in CONFIGS.items()}).count()) < 40
    monkeypatch.setattr(B, "ALONE", 0)
    few, many = ([B.Fit((i,), ["a", "b"], "v", "squared") for i in range(n)] for n in (1, 8))
    assert abs(jobs(spark, lambda: B.fit_all(rows, few, None, 3)) - jobs(spark, lambda: B.fit_all(rows, many, None, 3))) <= 2


def test_what_is_missing(spark):
    """A missing feature is on the far side of every number; rows without a target train nothing; a fit of no rows scores 0."""
    table = [(f"r{i}", None if i % 4 == 0 else float(i % 7), 1.0 if i % 4 == 0 else 0.0) for i in range(80)] + [("n", 3.0, None), ("m", float("nan"), float("nan"))]
    df = spark.createDataFrame(table, "id string, a double, y double")
    fits = [B.Fit((loss,), ["a"], "y", loss) for loss in ("logistic",)]
    z = B.predict_all(df, fits, B.fit_all(df, fits, None, 4), ["id"]).toPandas().set_index("id").z
    assert (z[["r0", "r4", "m"]] > 1).all() and (z[["r1", "r2", "n"]] < -1).all()
    none = [B.Fit(("none",), ["a"], "y", "squared")]
    out = B.predict_all(df, none, B.fit_all(df.where("y is null or isnan(y)"), none, None, 2), ["id"]).toPandas()
    assert len(out) == 82 and (out.z == 0).all()


def test_bins_are_those_of_the_plain_scan():
    """Bins end where a scan over the values, one after the other, ends them."""
    rng = np.random.default_rng(5)
    for size in (1, 2, 20, 33, 400, 3000):
        v = np.unique(np.round(rng.normal(0, 50, size), 2))
        n = np.append(rng.integers(1, 4, len(v)), 0).astype(float)
        n[0] *= 1 + 300 * (size == 400)
        ends, bins = (v[:-1] + v[1:]) / 2, int(min(B.BINS, n.sum()))
        if len(ends) < bins:
            want = list(ends)
        else:
            want, total, goal = [], n[0], n.sum() / bins
            for i in range(1, len(v)):
                last, total = total, total + n[i]
                if abs(last - goal) < abs(total - goal):
                    want.append(ends[i - 1])
                    goal += n.sum() / bins
        assert np.allclose(B.cuts_of(v, True, n, n), want)


def test_many_values_are_counted_between_quantiles(spark, monkeypatch):
    """Above MOST_VALUES, bins are still of nearly equal size, from all rows, and predictions stay close."""
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, 3000)
    df = spark.createDataFrame([(f"r{i}", float(v), float(v > 0.3)) for i, v in enumerate(x)], "id string, a double, y double")
    fit = lambda: [B.Fit((0,), ["a"], "y", "squared")]
    whole = B.fit_all(df, fit(), None, 1)[0][1]
    monkeypatch.setattr(B, "MOST_VALUES", 500)
    part = B.fit_all(df, fit(), None, 1)[0][1]
    assert len(whole) == len(part) == B.BINS - 1
    sizes = np.bincount(np.searchsorted(part, x))
    assert abs(sizes - 3000 / B.BINS).max() < 15
