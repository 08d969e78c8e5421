"""Every query with SQL gives the same rows as DuckDB; the others run and keep their invariants."""

import hashlib
import os
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from lachesis import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def text(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return ""
    return f"{v + 0.0:.6g}" if isinstance(v, float) else str(v)


def rows(df):
    return Counter(tuple(map(text, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_same_as_sql(spark, con, name):
    ours, theirs = registry.queries()[name](spark, SF).toPandas(), con.sql(registry.oracles()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


LIGHT = ["resample_bspline", "track_lesions", "wilcoxon_folds", "lasso_select"]


@pytest.mark.parametrize("name", LIGHT)
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_lasso_and_selection_over_stacked_timepoints(spark):
    """The query's choice against proximal steps on the stacked rows, and the columns that the chain leaves."""
    from lachesis.plans import evaluate_queries as Q
    from test_moments import plain_lasso

    rows = Q.stacked(spark, SF)[1].toPandas()
    x = rows[Q.STACKED].astype(float).fillna(0).to_numpy()
    scale = x.std(axis=0)
    assert len(rows) > 5 * rows["id"].nunique() * 0.5 and (scale > 0).all()
    got = {r.feature: r.dropped for r in registry.queries()["lasso_select"](spark, SF).collect()}
    want = plain_lasso(x, rows["target"].to_numpy(float), 0.5, 300_000)
    # Slow steps may leave a trace of what is 0; what is clearly not 0 must be kept.
    assert all(not got[c] for c, b, s in zip(Q.STACKED, want, scale, strict=True) if abs(b * s) > 0.05)
    assert all(got[c] for c, b, s in zip(Q.STACKED, want, scale, strict=True) if b == 0)
    left = {r["column"]: r.kept for r in registry.queries()["feature_selection"](spark, SF).collect()}
    assert len(left) == 7 * 13 and not left["t3_twice"] and any(left.values()) and all(left[f"t{t}_rano"] for t in range(7))


def test_rejected_samples(spark):
    """A long CR run drops a series, a short one is filled and saves it from rejection for its dip; a spike drops one."""
    from lachesis.operators import series as S

    own = {1: [10, 0, 0, 10, 9, 9], 2: [10, 0, 10, 9, 9, 9], 3: [10, 10, 200, 10, 10, 10], 4: [10, 9, 8, 8, 8, 8], 5: [10, 0, 10, 300, 10, 10], 6: [10, 9, 9, 9, 0, 0]}
    rows = [(p, 1, t, 60 * t, float(v), "CR" if v == 0 else "SD") for p, vs in own.items() for t, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "patient_id int, lesion_id int, t int, timedelta_days int, volume double, rano string")
    got = S.reject_samples(df, 5, 2, 1).toPandas().sort_values(["patient_id", "t"])
    kept = {p: g.volume.tolist() for p, g in got.groupby("patient_id")}
    assert kept == {2: [10, 10, 10, 9, 9, 9], 4: own[4], 5: [10, 10, 10, 300, 10, 10], 6: own[6]}
    assert set(S.reject_samples(df, None, 2, 1).toPandas().patient_id) == {2, 3, 4, 5, 6} and "_spike" not in got


def test_tracked_series_are_whole(spark):
    """A series has one row for each of its patient's studies from its start on."""
    df = registry.queries()["track_lesions"](spark, SF).toPandas()
    studies = df.groupby("patient_id")["study"].unique()
    for (p, _), g in df.groupby(["patient_id", "lesion_id"]):
        assert sorted(g["study"]) == sorted(s for s in studies[p] if s >= g["study"].min())
        assert not g.sort_values("t").iloc[0]["is_empty"]


def test_spline_meets_points(spark):
    """Resampled series have all grid points and start at the first volume."""
    from lachesis.plans import adapters as A

    got = registry.queries()["resample_bspline"](spark, SF).toPandas()
    assert (got.groupby(["patient_id", "lesion_id"]).size() == A.STEPS + 1).all()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def draw(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def auc(target, score):
    p, q = score[target == 1], score[target != 1]
    return ((p[:, None] > q).sum() + (p[:, None] == q).sum() / 2) / (len(p) * len(q)) if len(p) and len(q) else None


def test_resampling_takes_1000_replicates(spark):
    """Interval and p-value of the whole job, by brute force over 1000 replicates."""
    from lachesis.plans import adapters as A

    p = A.predictions(spark, SF).toPandas().sort_values("id")
    side = {m: (g["id"].to_numpy(), g["target"].to_numpy(), g["confidence"].to_numpy()) for m, g in p.groupby("model")}
    got = registry.queries()["bootstrap_auc_ci"](spark, SF).toPandas().set_index("model")
    places = [np.array([draw(0, rep, j) % len(side["a"][0]) for j in range(len(side["a"][0]))]) for rep in range(1000)]
    for m, (_, t, s) in side.items():
        all_ = [x for i in places if (x := auc(t[i], s[i])) is not None]
        want = [*np.quantile(all_, [0.025, 0.975]), np.mean(all_)]
        assert got.loc[m, ["low", "high", "mean"]].tolist() == pytest.approx(want, abs=2e-6)
    (ids, t, a), (_, _, b) = side["a"], side["b"]
    seen, n = auc(t, a) - auc(t, b), 0
    for rep in range(1000):
        swap = np.array([draw(0, rep, i) % 2 == 1 for i in ids])
        n += abs(auc(t, np.where(swap, b, a)) - auc(t, np.where(swap, a, b))) >= abs(seen) - 1e-12
    row = registry.queries()["permutation_test_auc"](spark, SF).first()
    assert row.difference == pytest.approx(seen, abs=1e-6) and row.p_value == n / 1000


@pytest.mark.parametrize("name", ["xmeans", "xmeans_dtw", "xshapes", "mixture_clusters"])
def test_clusters_of_every_series(spark, name, monkeypatch):
    """Each series comes back with its cluster, from searches and fits with the operators' own limits."""
    from lachesis.operators import cluster as L
    from lachesis.plans import evaluate_queries as Q

    limits = []
    search, fit = L.split_search, L.mixtures

    def split_search(df, vector, metric="euclidean", k_max=L.MAX_CLUSTERS, tol=256, seed=42, rounds=L.ROUNDS):
        limits.append((k_max, rounds))
        return search(df, vector, metric, k_max, tol, seed, rounds)

    def mixtures(df, vector, ks, seed=42, rounds=L.ROUNDS, tol=1e-4):
        limits.append((L.MAX_CLUSTERS, rounds))
        return fit(df, vector, ks, seed, rounds, tol)

    monkeypatch.setattr(L, "split_search", split_search)
    monkeypatch.setattr(L, "mixtures", mixtures)
    got = registry.queries()[name](spark, SF).toPandas()
    series = Q.relative_vectors(spark, SF).select(*Q.K).toPandas()
    assert Counter(map(tuple, got[Q.K].values)) == Counter(map(tuple, series.values)) and got["cluster"].notna().all()
    assert limits == [(42, 1000)]


def test_best_k_over_the_full_range(spark):
    got = registry.queries()["best_k"](spark, SF).toPandas()
    assert got["k"].tolist() == list(range(2, 42)) and got["best"].sum() == 1


PREFIXES = ["t0", "t0-t1", "t0-t2", "t0-t3", "t0-t4", "t0-t5"]


def test_training_covers_models_prefixes_and_folds(spark, monkeypatch):
    """What the queries hand to the operators: all prefixes, the default models, 5 folds, both targets of each prefix."""
    from lachesis.operators import cluster as L
    from lachesis.plans import evaluate_queries as Q

    seen = {}

    class Stop(Exception):
        pass

    def held(name):
        def f(*args, models=None):
            seen[name] = args, models
            raise Stop

        return f

    for name in ("train_classifiers", "train_holdout_sweep", "train_regressors"):
        monkeypatch.setattr(L, name, held(name))
        with pytest.raises(Stop):
            registry.queries()[name](spark, SF)
    inputs = {c: [f"t{t}_volume" for t in range(n + 1)] for n, c in enumerate(PREFIXES)}
    (df, configs, target), models = seen["train_classifiers"]
    assert (configs, target, models) == (inputs, "target", None)
    assert sorted(r[0] for r in df.select("fold").distinct().collect()) == [0, 1, 2, 3, 4]
    (_, _, configs, target), models = seen["train_holdout_sweep"]
    assert (configs, target, models) == (inputs, "target", None)
    want = {f"nxt_{c}": (v, f"t{len(v)}_volume") for c, v in inputs.items()} | {f"1yr_{c}": (v, "t6_volume") for c, v in inputs.items()}
    assert seen["train_regressors"][0][2] == want


def test_training_predicts_every_row(spark):
    """Three models, two configurations, two folds: each row is predicted by the fits that did not see it, and a clear rule is learned."""
    from lachesis.operators import cluster as L

    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, 80)
    df = spark.createDataFrame([(f"r{i}", float(v), float(rng.normal()), int(v > 0), i % 2) for i, v in enumerate(x)], "id string, a double, b double, y int, fold int")
    p = L.train_classifiers(df, {"a": ["a"], "a,b": ["a", "b"]}, "y").toPandas()
    assert len(p) == 3 * 2 * 80 and not p.duplicated(["model", "config", "id"]).any()
    assert all((g.prediction == g.target).mean() > 0.9 for _, g in p.groupby(["model", "config"]))
    assert p.confidence.between(0, 1).all() and ((p.confidence > 0.5) == (p.prediction == 1)).mean() > 0.95
    held = L.train_holdout_sweep(df.where("fold = 0"), df.where("fold = 1"), {"a": ["a"]}, "y").toPandas()
    # The hold-out sweep on the same rows is the same fit as that of the fold.
    both = held.merge(p[p.config == "a"], on=["model", "id"])
    assert len(both) == 3 * 40 and (both.prediction_x == both.prediction_y).all() and np.allclose(both.confidence_x, both.confidence_y)


def test_regressors_find_a_line(spark):
    from lachesis.operators import cluster as L

    rows = [(f"r{i}", float(i), float(2 * i + 1), float(-i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, a double, up double, down double")
    p = L.train_regressors(df, df, {"up": (["a"], "up"), "down": (["a"], "down")}).toPandas()
    assert len(p) == 2 * 2 * 40
    linear = p[p.model == "linear"]
    assert np.allclose(linear.prediction, linear.target, atol=0.2)


def test_selection_of_features(spark):
    from lachesis.operators import cluster as L
    from lachesis.operators import moments as N

    rng = np.random.default_rng(4)
    rows = [(float(a), float(b), float(c), float(5 * a)) for a, b, c in rng.normal(0, 1, (120, 3))]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double")
    assert N.lasso_select(df, ["a", "b", "c"], "y") == ["b", "c"]
    assert L.model_select(df, ["a", "b", "c"], "y") == ["b", "c"]
    seen = []

    def last(df, columns, target):
        seen.append(columns)
        return columns[-1:]

    assert L.eliminate(df, ["a", "b", "c"], "y", [last, last]) == ["c", "b"] and seen == [["a", "b", "c"], ["a", "b"]]


@pytest.mark.parametrize("metric", ["euclidean", "shape"])
def test_search_splits_clusters(spark, metric):
    """Four well separated groups come out as four clusters, though the search starts with two."""
    from lachesis.operators import cluster as L

    rng = np.random.default_rng(5)
    shapes = np.array([[0, 1, 0, -1, 0, 1], [0, -1, 0, 1, 0, -1], [-2, -1, 0, 0, 1, 2], [2, 1, 0, 0, -1, -2]], float) * (40 if metric == "euclidean" else 1)
    rows = [(i, (shapes[i % 4] + rng.normal(0, 0.01, 6)).tolist()) for i in range(160)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    got = {r.id: r.cluster for r in L.split_search(df, "v", metric, tol=20).collect()}
    assert len({(i % 4, got[i]) for i in got}) == 4 and len(set(got.values())) == 4
    assert len(set(r.cluster for r in L.split_search(df, "v", metric, k_max=2, tol=20).collect())) == 2


def plain_dtw(x, centre):
    """Squared distance and path of two series, cell by cell."""
    n, m = len(x), len(centre)
    cost = np.full((n + 1, m + 1), np.inf)
    cost[0, 0] = 0
    for i in range(n):
        for j in range(m):
            cost[i + 1, j + 1] = (x[i] - centre[j]) ** 2 + min(cost[i, j], cost[i, j + 1], cost[i + 1, j])
    path, i, j = [], n, m
    while i and j:
        path.append((i - 1, j - 1))
        i, j = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda p: cost[p])
    return cost[n, m], path


def plain_shift(x, centre):
    """Shape-based distance of two series, and x moved to its best place."""
    c = np.correlate(x, centre, "full")
    k = int(c.argmax()) - (len(centre) - 1)
    moved = [x[i + k] if 0 <= i + k < len(x) else 0.0 for i in range(len(x))]
    return 1 - c.max() / (np.linalg.norm(x) * np.linalg.norm(centre) or 1.0), moved


@pytest.mark.parametrize("m", [1, 2, 7])
def test_series_distances_of_many(spark, m):
    """All series at once, against one at a time."""
    from lachesis.operators import cluster as L

    rng = np.random.default_rng(6)
    x, c = np.concatenate([rng.normal(0, 1, (30, m)), np.zeros((2, m)), rng.integers(0, 3, (20, m))]), rng.normal(0, 1, m)
    assert np.allclose(L.dtw_costs(x, c), [plain_dtw(a, c)[0] for a in x])
    sums, count = np.zeros(m), np.zeros(m)
    for a in x:
        for i, j in plain_dtw(a, c)[1]:
            sums[j] += a[i]
            count[j] += 1
    assert np.allclose(L.warp_sums(x, c), (sums, count))
    z = L.znorm(x)
    assert np.allclose(L.shape_distances(z, c), [plain_shift(a, c)[0] for a in z]) and np.allclose(L.shape_moved(z, c), [plain_shift(a, c)[1] for a in z])


def test_search_splits_by_warping(spark):
    """Groups that differ by more than warping evens out: the search by DTW ends with all four, from two."""
    from lachesis.operators import cluster as L

    rng = np.random.default_rng(7)
    shapes = np.array([[0, 0, 9, 0, 0, 0, 0, 0], [0, 0, 0, 40, 40, 0, 0, 0], [0, 90, 90, 90, 90, 0, 0, 0], [-60, -60, 0, 0, 0, -60, -60, -60]], float)
    rows = []
    for i in range(120):
        late = int(rng.integers(0, 2))
        rows.append((i, (np.concatenate([shapes[i % 4][:1]] * late + [shapes[i % 4]])[:8] + rng.normal(0, 0.05, 8)).tolist()))
    df = spark.createDataFrame([*rows, (500, None)], "id int, v array<double>")
    got = {r.id: r.cluster for r in L.split_search(df, "v", "dtw", tol=20).collect()}
    assert got.pop(500) is None and len({(i % 4, got[i]) for i in got}) == 4 and len(set(got.values())) == 4


@pytest.mark.parametrize("metric", ["euclidean", "dtw", "shape"])
def test_clusters_of_empty_tables(spark, metric):
    """No rows, and rows without a vector."""
    from lachesis.operators import cluster as L

    nulls = spark.createDataFrame([(1, None), (2, None)], "id int, v array<double>")
    assert L.split_search(nulls.where("false"), "v", metric).count() == 0
    assert [r.cluster for r in L.split_search(nulls, "v", metric).collect()] == [None, None]


def test_mixture_of_empty_tables(spark):
    from lachesis.operators import cluster as L

    df = spark.createDataFrame([(1, None), (2, [0.0, 1.0]), (3, [5.0, 9.0]), (4, [5.0, 9.5])], "id int, v array<double>")
    got = {r.id: r.cluster for r in L.mixture_clusters(df, "v", 2)[0].collect()}
    assert got[1] is None and got[3] == got[4] != got[2]
    none, score = L.mixture_clusters(df.where("v is null"), "v", 2)
    assert [r.cluster for r in none.collect()] == [None] and np.isnan(score["bic"])
    assert L.mixture_clusters(df.where("false"), "v", 2)[0].count() == 0 and L.mixtures(df.where("false"), "v", [2, 3]) == {}


def test_searches_share_their_passes(spark, monkeypatch):
    """Halves of all clusters, and mixtures of all k, are fitted side by side: the passes are those of the longest fits, whatever the
    number of fits."""
    import numpy as np
    from lachesis.operators import cluster as L

    passes, added = [], L.added
    monkeypatch.setattr(L, "added", lambda *a: passes.append(1) or added(*a))
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(0, 0.1, 2) + [10 * (i % 8), 7 * (i % 8 % 3)]).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, v array<double>").cache()
    got = {r.id: r.cluster for r in L.split_search(df, "v", tol=20).collect()}
    assert len({(i % 8, c) for i, c in got.items()}) == len(set(got.values())) == 8
    assert len(passes) < 80
    passes.clear()
    fits = L.mixtures(df, "v", range(2, 10))
    assert sorted(fits) == [*range(2, 10)] and len(passes) < 150


def test_split_gain_is_that_of_the_scores(spark):
    """The gain from sums equals the difference of the BIC rows of cluster_bic_aic."""
    import numpy as np
    from lachesis.operators import cluster as L
    from lachesis.operators import evaluate as E
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i % 2, (rng.normal(0, 1, 3) + 5 * (i % 3)).tolist()) for i in range(90)], "c int, v array<double>")
    two = np.array([[0.0, 0, 0], [8.0, 8, 8]])
    gain = L.split_gains(L.packed(df, "v", 2, "c"), {0: two, 1: two}, "euclidean")
    for c in (0, 1):
        part = df.where(F.col("c") == c)
        bic = lambda d, k: E.cluster_bic_aic(d, "v", k).first()["bic_likelihood"]
        assert abs(gain[c] - (bic(L.assigned(part, "v", two, "euclidean", "h"), "h") - bic(part, "c"))) < 1e-6


def test_series_keys_are_held_against_every_study(spark, tmp_path):
    """A patient with folders of studies but no series, and one with a series but no orders."""
    import duckdb
    from lachesis import registry
    from pyspark.sql import functions as F

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    blank = e.limit(1).withColumns({"user_id": F.lit(900001).cast("bigint"), "value": F.lit(0.0)})
    extra = e.limit(1).withColumns({"user_id": F.lit(900002).cast("bigint"), "value": F.lit(9.0)})
    e.unionByName(blank).unionByName(extra).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/orders.parquet").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    rows = [tuple(r) for r in registry.queries()["validate_series_keys"](spark, str(tmp_path)).collect()]
    assert ("manifest", 900001, True, False) in rows and ("orders", 900002, False, True) in rows
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(con.sql(registry.oracles()["validate_series_keys"]).fetchall()) == sorted(rows)


@pytest.mark.parametrize("name", ["xmeans", "xmeans_dtw", "mixture_clusters"])
def test_rounds_of_a_small_table_are_one_job(spark, name, monkeypatch):
    """A fit over few vectors makes all rounds in one task; over many, a job a round. Both end at the same centres."""
    import numpy as np
    from lachesis.operators import cluster as L

    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(0, 1, 4) + 3 * (i % 3) * np.arange(4)).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, v array<double>").cache()
    find = {
        "xmeans": lambda: L.split_centres(df, "v", "euclidean", 42, 20, 42, 1000), "xmeans_dtw": lambda: L.split_centres(df, "v", "dtw", 42, 20, 42, 1000),
        "mixture_clusters": lambda: np.concatenate([x.ravel() for x in L.mixtures(df, "v", [3])[3][:3]]),
    }[name]
    passes, added = [], L.added
    monkeypatch.setattr(L, "added", lambda *a: passes.append(1) or added(*a))
    one = find()
    few = len(passes)
    monkeypatch.setattr(L, "ALONE", 0)
    many = find()
    assert 2 * few < len(passes) - few and one.shape == many.shape and np.allclose(one, many)


def test_halves_start_in_two_passes(spark, monkeypatch):
    """xmeans starts the halves of all clusters together, by k-means++ and without a fit of MLlib; the groups come out, and what has no
    two different vectors does not split."""
    import numpy as np
    from lachesis.operators import cluster as L
    from pyspark.sql import functions as F

    monkeypatch.setattr(L, "euclidean_start", None)
    rng = np.random.default_rng(7)
    rows = [(i, [10.0 * (i % 4) + x, 40.0 * (i % 2) + y]) for i, (x, y) in enumerate(rng.normal(0, 0.1, (400, 2)).tolist())]
    df = spark.createDataFrame([*rows, (400, None)], "id int, v array<double>")
    got = {r.id: r.cluster for r in L.split_search(df, "v", tol=20).collect()}
    assert got.pop(400) is None and len({(i % 4, c) for i, c in got.items()}) == len(set(got.values())) == 4
    same = df.where("id < 9").withColumn("v", F.array(F.lit(1.0), F.lit(2.0)))
    assert [r.cluster for r in L.split_search(same, "v").collect()] == [0] * 9
    assert L.split_centres(df.where("id = 400 and v is not null"), "v", "euclidean", 42, 20, 42, 1000).shape == (0, 0)
    # Far vectors are likelier: of 1 and 100 with 0 as the first, the second is nearly always 100.
    far = [L.spread_pairs(L.packed(spark.createDataFrame([([0.0, 0.0],), ([1.0, 0.0],), ([100.0, 0.0],)], "v array<double>"), "v", 2), s)[0] for s in range(4)]
    assert all(100.0 in p[:, 0] for p in far)


def test_mixtures_start_together_over_different_vectors(spark, monkeypatch):
    """best_k's mixtures of all k start from the same few passes and without a fit of MLlib each; equal vectors are one that counts more
    often, in whatever tasks they are, and fewer different vectors than k are all centres."""
    import numpy as np
    from lachesis.operators import cluster as L
    from pyspark.sql import functions as F

    monkeypatch.setattr(L, "euclidean_start", None)
    held, pack = [], L.packed
    monkeypatch.setattr(L, "packed", lambda df, *a: held.append(df.count()) or pack(df, *a))
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(0, 0.3, 3) + 4.0 * np.array([i % 5, i % 2, i % 3])).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    thrice = df.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3)))).repartition(5)
    one, more = L.mixtures(df, "v", [2, 7, 30]), L.mixtures(thrice, "v", [2, 7, 30])
    assert held == [600, 600] and [len(one[k][2]) for k in one] == [2, 7, 30]
    for k in one:
        assert all(np.allclose(a, b) for a, b in zip(one[k][:3], more[k][:3], strict=True))
        assert np.isclose(3 * one[k][3]["log_likelihood"], more[k][3]["log_likelihood"])
        # Reported scores are those of a pass before the last step, which no longer gains.
        x, (m, s, w, score) = np.array([v for _, v in rows]), one[k]
        logs = np.log(w) - 0.5 * (np.log(2 * np.pi * s) + (x[:, None] - m) ** 2 / s).sum(axis=2)
        like = np.log(np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)) + logs.max(axis=1)
        assert abs(like.sum() - score["log_likelihood"]) < 2e-3 * abs(like.sum())
    few = L.spread_starts(pack(thrice.where("id < 4").groupBy("v").agg(F.count("v").alias("c")), "v", 9, "c"), [2, 9], 1)
    assert len(few[2]) == 2 and np.allclose(sorted(few[9].tolist()), sorted(v for _, v in rows[:4]))


def test_counted_sums_are_those_of_each_vector():
    """Vectors that count several times, far from zero, give the centre sums of their copies."""
    import numpy as np
    from lachesis.operators import cluster as L

    rng = np.random.default_rng(6)
    x, times, centres = rng.normal(1e6, 1, (500, 4)), rng.integers(1, 9, 500), rng.normal(1e6, 1, (12, 4))
    assert np.allclose(L.counted_sums(x, times, centres), L.centre_sums(np.repeat(x, times, axis=0), centres, "euclidean"), rtol=1e-12)
