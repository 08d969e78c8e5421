"""Gram matrices, coordinate descent and many fits from one scan, against plain numpy and single fits of MLlib."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from lachesis.operators import linear, moments


def table(spark, x, names):
    return spark.createDataFrame([tuple(None if v is None or np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"`{n}` double" for n in names))


@pytest.mark.parametrize("block,rows", [(1024, 32), (3, 2)])
def test_correlations_over_gaps(spark, block, rows, monkeypatch):
    """Pairs over the rows that have both, columns far from 0, constant columns, blocks smaller than the table."""
    monkeypatch.setattr(moments, "BLOCK", block)
    monkeypatch.setattr(moments, "ROWS", rows)
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (300, 7)) + np.array([0, 1e6, -5, 3, 0, 0, 0])
    x[:, 2] = 2 * x[:, 0] + 0.1 * x[:, 2]
    x[:, 4] = 7.0
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 6] = np.nan
    names = [f"f{i}" for i in range(7)]
    got = {r.i: r.r for r in moments.correlations(table(spark, x, names).repartition(5), names).collect()}
    for i in range(7):
        for j in range(7):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i], x[both, j]
            want = None if both.sum() < 2 or a.std() == 0 or b.std() == 0 else np.corrcoef(a, b)[0, 1]
            assert got[i][j] == (None if want is None else pytest.approx(want, abs=1e-9)), (i, j)
    assert {r.feature for r in moments.correlated_features(table(spark, x, names), names, 0.9).collect()} == {"f2"}
    assert moments.correlated_features(table(spark, x, names).where("false"), names).count() == 0


def test_600_columns_in_one_pass(spark):
    names = [f"f{i}" for i in range(600)]
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (50, 600))
    x[:, 599] = -x[:, 17]
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").select(*[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(names)])
    got = {r.feature: r.max_r for r in moments.correlated_features(df, names, 0.99).collect()}
    assert got == {"f599": pytest.approx(1.0)}


def plain_lasso(x, y, alpha, rounds=20_000):
    """Proximal gradient steps on the rows themselves."""
    x, y = x - x.mean(axis=0), y - y.mean()
    n, b = len(x), np.zeros(x.shape[1])
    step = 1 / (np.linalg.norm(x, 2) ** 2 / n)
    for _ in range(rounds):
        b = b - step * x.T @ (x @ b - y) / n
        b = np.sign(b) * np.maximum(np.abs(b) - step * alpha, 0)
    return b


@pytest.mark.parametrize("alpha", [0.05, 0.5, 2.0, 100.0])
def test_lasso(spark, alpha):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (200, 6)) * [1, 2, 3, 1, 1, 0] + [0, 0, 50, 0, 0, 4]
    x[:, 4] = x[:, 0] + 0.3 * x[:, 4]
    y = 2 * x[:, 0] - x[:, 1] + 0.4 * x[:, 2] + rng.normal(0, 0.5, 200)
    names = [*"abcdef", "y"]
    df = table(spark, np.column_stack([x, y]), names).repartition(3)
    n, mean, product = moments.gram(df, names)
    want = plain_lasso(x, y, alpha)
    assert n == 200 and np.allclose(moments.lasso(product, n, alpha), want, atol=1e-6)
    gone = moments.lasso_select(df, names[:-1], "y", alpha)
    assert gone == [c for c, b in zip(names, want, strict=False) if abs(b) < 1e-9] and "f" in gone


def test_lasso_fills_gaps(spark):
    df = spark.createDataFrame([(1.0, None, 2.0), (2.0, 1.0, 4.0), (None, float("nan"), 0.0), (3.0, 5.0, None)], "a double, b double, y double")
    x, y = np.array([[1, 0], [2, 1], [0, 0]], float), np.array([2.0, 4, 0])
    n, _, product = moments.gram(df.where("y is not null"), ["a", "b", "y"])
    assert np.allclose(moments.lasso(product, n, 0.1), plain_lasso(x, y, 0.1), atol=1e-6)


def sweep(spark, n=240):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (n, 4)) * [1, 10, 0.1, 1] + [0, 100, 0, 2]
    y = (x[:, 0] + 0.05 * (x[:, 1] - 100) + rng.normal(0, 1, n) > 0.7).astype(int)
    rows = [(f"r{i}", *map(float, v), int(t), i % 5, float(v[0] * 3 - v[1] + rng.normal())) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id string, a double, b double, c double, d double, y int, fold int, volume double")


CONFIGS = {"a": ["a"], "ab": ["a", "b"], "abcd": ["a", "b", "c", "d"]}


def test_logistic_fits_are_those_of_single_fits(spark):
    df = sweep(spark).cache()
    fits = linear.fit_all(df, [linear.Fit((c, f), columns, "y", "logistic", f) for c, columns in CONFIGS.items() for f in (0, 3)], "fold")
    for fit in fits:
        train = df.where(F.col("fold") != fit.out)
        n = {r.y: r["count"] for r in train.groupBy("y").count().collect()}
        weight = F.when(F.col("y") == 1, sum(n.values()) / (2 * n[1])).otherwise(sum(n.values()) / (2 * n[0]))
        rows = VectorAssembler(inputCols=fit.columns, outputCol="features").transform(train.withColumn("w", weight))
        one = LogisticRegression(labelCol="y", weightCol="w", regParam=0.01, maxIter=1000, tol=1e-14).fit(rows)
        assert np.allclose(fit.at, [*one.coefficients, one.intercept], rtol=1e-4, atol=1e-5)


def test_linear_fits_are_those_of_single_fits(spark):
    df = sweep(spark).cache()
    fits = linear.fit_all(df, [linear.Fit((c,), columns, "volume", "squared") for c, columns in CONFIGS.items()])
    for fit in fits:
        rows = VectorAssembler(inputCols=fit.columns, outputCol="features").transform(df)
        one = LinearRegression(labelCol="volume", regParam=0.01).fit(rows)
        assert np.allclose(fit.at, [*one.coefficients, one.intercept], rtol=1e-6, atol=1e-8)


def test_margin_fits_are_at_their_least(spark):
    """No step in any direction makes the squared hinge loss smaller."""
    df = sweep(spark)
    p = df.toPandas()
    fits = linear.fit_all(df, [linear.Fit((c, 1), columns, "y", "squared_hinge", 1) for c, columns in CONFIGS.items()], "fold")
    for fit in fits:
        train = p[p.fold != 1]
        x, s = np.column_stack([train[fit.columns], np.ones(len(train))]), 2 * train.y.to_numpy() - 1
        w = np.where(s > 0, len(s) / (2 * (s > 0).sum()), len(s) / (2 * (s < 0).sum()))
        loss = lambda b: (w * np.maximum(0, 1 - s * (x @ b)) ** 2).sum() / w.sum() + (fit.penalty * b**2).sum() / 2  # noqa: B023, E731
        for j in range(len(fit.at)):
            for h in (1e-4, -1e-4):
                assert loss(fit.at) <= loss(fit.at + h * (np.arange(len(fit.at)) == j)) + 1e-14


def test_passes_do_not_grow_with_fits(spark, monkeypatch):
    passes = []
    old = linear.one_pass
    monkeypatch.setattr(linear, "one_pass", lambda rows, fits, work: passes.append(len(fits)) or old(rows, fits, work))
    df = sweep(spark).cache()

    def count(configs, folds):
        passes.clear()
        linear.fit_all(df, [linear.Fit((c, f), columns, "y", loss, f) for c, columns in configs.items() for f in folds for loss in ("logistic", "squared_hinge")], "fold")
        return len(passes)

    few, many = count({"a": ["a"]}, [0]), count(CONFIGS, range(5))
    assert many <= few + 10 and many < 30
    passes.clear()
    linear.fit_all(df, [linear.Fit((c, t), columns, t, "squared") for c, columns in CONFIGS.items() for t in ("volume", "d")])
    assert len(passes) == 2


def test_fits_of_awkward_tables(spark):
    """One class, no rows, missing features and targets, separable classes."""
    df = spark.createDataFrame([("p", 1.0, None, 1, 0), ("q", None, 2.0, 1, 1), ("r", 4.0, 3.0, None, 0), ("s", float("nan"), 1.0, 0, 1)], "id string, a double, b double, y int, fold int")
    fits = linear.fit_all(df, [linear.Fit((i,), ["a", "b"], "y", loss, i) for i in (0, 1) for loss in ("logistic", "squared_hinge")], "fold")
    assert all(np.isfinite(f.at).all() for f in fits)
    got = linear.predict_all(df, fits, ["id"], "fold").collect()
    assert len(got) == 2 * 4 and all(np.isfinite(r.z) for r in got)
    none = linear.fit_all(df.where("false"), [linear.Fit((), ["a"], "y", "squared")])
    assert list(none[0].at) == [0, 0]
