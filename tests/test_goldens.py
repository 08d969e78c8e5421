"""Hand-computed results of every rule, with its edge cases."""

from datetime import datetime, timedelta
from math import erfc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lachesis.functions import columns as C
from lachesis.operators import cluster as L
from lachesis.operators import evaluate as E
from lachesis.operators import matching as M
from lachesis.operators import ranks, replicates
from lachesis.operators import resample as R
from lachesis.operators import series as S
from lachesis.operators import tables as T

DAY0 = datetime(2020, 1, 1)


def series(spark, points, lesion=1):
    rows = [(1, lesion, DAY0 + timedelta(days=d), i, float(v)) for i, (d, v) in enumerate(points)]
    df = spark.createDataFrame(rows, "patient_id int, lesion_id int, ts timestamp_ntz, n int, volume double")
    return S.index_timepoints(df, "n")


def values(df, column, by="t"):
    return [r[column] for r in df.orderBy(by).collect()]


@pytest.mark.parametrize(
    "mode, volumes, expected",
    [
        ("3d", [100, 50, 30, 60, 0, 20, 80], [None, "SD", "PR", "PD", "CR", "PR", "PD"]),
        ("1d", [100, 80], [None, "SD"]),
        ("3d", [0, 5, 0], [None, None, "CR"]),
    ],
)
def test_response_class(spark, mode, volumes, expected):
    df = S.response_class(series(spark, [(i, v) for i, v in enumerate(volumes)]), mode)
    assert values(df, "rano") == expected


def test_days_round_down(spark):
    df = spark.createDataFrame([(DAY0, DAY0 + timedelta(hours=12))], "a timestamp_ntz, b timestamp_ntz")
    r = df.select(C.days_between("a", "b").alias("back"), C.days_between("b", "a").alias("forth")).first()
    assert (r.back, r.forth) == (-1, 0)


def test_time_grid(spark):
    g = R.time_grid(series(spark, [(0, 1), (360, 1)]), 360, 6).orderBy("i").collect()
    assert [(r.target_ts - DAY0).days for r in g] == [0, 60, 120, 180, 240, 300, 360]


def test_span_rule(spark):
    assert R.long_enough(series(spark, [(0, 1), (329, 1)]), 360, 6).count() == 0
    assert R.long_enough(series(spark, [(0, 1), (330, 1)]), 360, 6).count() == 2


def at(spark, day):
    return spark.createDataFrame([(1, 1, 0, DAY0 + timedelta(days=day))], "patient_id int, lesion_id int, i int, target_ts timestamp_ntz")


@pytest.mark.parametrize("days, expected", [([50, 70], 50), ([59.5, 60.4], 60.4)])
def test_asof_nearest(spark, days, expected):
    df = R.asof_nearest(series(spark, [(d, d) for d in days]), at(spark, 60), ["volume"])
    assert df.first().volume == expected


def test_asof_nearest_nonzero(spark):
    assert R.asof_nearest(series(spark, [(50, 4), (60, 0)]), at(spark, 60), ["volume"], nonzero=True).first().volume == 4
    assert R.asof_nearest(series(spark, [(50, 0)]), at(spark, 60), ["volume"], nonzero=True).first().volume is None


@pytest.mark.parametrize("points, day, expected", [([(0, 10), (50, 20), (70, 40)], 60, 30), ([(0, 10), (50, 20), (70, 40)], 90, 60), ([(0, 10), (10, 5)], 30, 0)])
def test_linear(spark, points, day, expected):
    b = R.asof_bilateral(series(spark, points), at(spark, day)).select(C.interpolate_linear(F.col("d1"), F.col("v1"), F.col("d2"), F.col("v2")).alias("v"))
    assert b.first().v == pytest.approx(expected)


def test_spline():
    x, y = np.array([0.0, 10, 20, 30]), np.array([0.0, 1, 8, 27])
    assert R.not_a_knot(x, y, np.array([15.0]))[0] == pytest.approx(3.375)


def test_spline_needs_four_days(spark):
    assert R.resample_bspline(series(spark, [(0, 1), (180, 2), (360, 3)])).count() == 0
    out = R.resample_bspline(series(spark, [(0, 1), (100, 2), (200, 1), (360, 3)]))
    assert out.count() == 7 and out.where("volume < 0").count() == 0


def test_swings(spark):
    t = S.tag_swings(series(spark, [(0, 5), (60, 0), (120, 9), (180, 0), (240, 0)]))
    assert values(t, "is_swing") == [False, True, False, False, False]
    assert values(S.repair_swings(t), "volume") == [5, 7, 9, 0, 0]


def test_double_swings(spark):
    assert S.discard_swings(S.tag_swings(series(spark, [(0, 5), (60, 0), (120, 0), (180, 5)]))).count() == 0
    kept = S.discard_swings(S.tag_swings(series(spark, [(0, 5), (400, 0), (430, 0), (500, 5)])))
    assert values(S.repair_swings(kept), "volume") == pytest.approx([5, 0.348837, 1.744186, 5], abs=1e-6)


@pytest.mark.parametrize("days, kept", [([0, 100, 230], False), ([0, 110, 220, 330, 370, 600], True), ([0, 110, 220, 330, 500], False), ([0], True)])
def test_gaps(spark, days, kept):
    assert (S.discard_gaps(series(spark, [(d, 1) for d in days])).count() > 0) == kept


def test_spikes(spark):
    assert S.reject_spikes(series(spark, [(0, 10), (1, 100), (2, 10)]), 3).count() == 0
    assert S.reject_spikes(series(spark, [(0, 10), (1, 100), (2, 90)]), 3).count() == 3


BOTH = [
    ([(0, 3, 5), (0, 2, 5), (0, 2, 1)], 1), ([(5, 9, 3), (5, 2, 3)], 1), ([(5, 9, 3), (5, 4, 3)], 0), ([(0, 7, 10)], None), ([(0, 1, 5), (2, 9, 1)], 1),
]


@pytest.mark.parametrize("rows, expected", BOTH)
def test_best_match(spark, rows, expected):
    df = spark.createDataFrame([("c", i, o, float(d), float(m)) for i, (o, d, m) in enumerate(rows)], "cand string, idx int, overlap long, distance double, diameter double")
    got = M.best_match(df, ["cand"], "idx").collect()
    assert (got[0].idx if got else None) == expected == M.choose([tuple(map(float, r)) for r in rows])


def test_tracking(spark):
    obs = [("S1", 0, True, "a", 10), ("S1", 0, True, "b", 40), ("S2", 30, False, "a2", 11), ("S2", 30, False, "c", 70), ("S3", 60, True, "b2", 41), ("S3", 60, True, "d", 90)]
    v = 4 / 3 * np.pi * 2.5**3
    rows = [(1, s, DAY0 + timedelta(days=d), t, o, v, float(x), 10.0, 10.0) for s, d, t, o, x in obs]
    df = spark.createDataFrame(rows, "patient_id int, study string, ts timestamp_ntz, treated boolean, obs string, volume double, cx double, cy double, cz double")
    none = spark.createDataFrame([], "patient_id int, study_a string, obs_a string, study_b string, obs_b string, overlap long")
    got = M.track_lesions(df, none).orderBy("lesion_id", "t").collect()
    assert [(r.lesion_id, r.t, r.obs) for r in got] == [(0, 0, "a"), (0, 1, "a2"), (0, 2, None), (1, 0, "b"), (1, 1, None), (1, 2, "b2"), (2, 0, "d")]


def slow_tracking(rows, overlaps):
    """One patient's series by plain scans over every member: lists of (study, obs or None)."""
    series = []
    for study, ts, treated in sorted({(r[0], r[1], r[2]) for r in rows}, key=lambda x: x[1]):
        own, opened, done = sorted(r for r in rows if r[0] == study), [], {}
        for r in own:
            _, _, _, obs, volume, x, y, z = r
            choices, seen = [], set()
            for i, m in enumerate(series):
                there = [p for p in m if p[1] is not None]
                gaps = [abs((p[2] - ts).total_seconds() // 86400) for p in there]
                ref = there[gaps.index(min(gaps))]
                near = sum((a - b) ** 2 for a, b in zip(ref[4:], (x, y, z), strict=True)) ** 0.5
                shared = overlaps.get((ref[0], ref[1], study, obs), 0)
                gate = min(6.0, 2 * (ref[3] / (4 / 3 * np.pi)) ** (1 / 3))
                if volume > 0 and (near <= gate or (shared > 0 and shared not in seen)):
                    choices.append((-shared, near, i))
                if volume > 0:
                    seen.add(shared)
            point = (study, obs, ts, volume, x, y, z)
            if choices:
                i = min(choices)[2]
                if i in done:
                    series[i].pop()
                series[i].append(point)
                done[i] = True
            elif volume > 0:
                opened.append([point])
        for i, m in enumerate(series):
            if i not in done:
                m.append((study, None, ts, 0.0))
        if treated:
            series += opened
    return [[(p[0], p[1]) for p in m] for m in series]


@pytest.mark.parametrize("seed", range(3))
def test_tracking_against_plain_scan(spark, seed):
    """Overlaps, studies within one day, second matches of a study, empty observations."""
    rng = np.random.default_rng(seed)
    rows, overlaps = {}, {}
    for patient in range(8):
        days = np.cumsum(rng.choice([0.25, 0.5, 30], 6))
        rows[patient] = [(f"S{i}", DAY0 + timedelta(days=float(d)), bool(t), f"o{j}", float(rng.choice([0, 20, 60, 200], p=[0.1, 0.3, 0.3, 0.3])), *map(float, rng.integers(0, 12, 3))) for i, (d, t) in enumerate(zip(days, rng.integers(0, 2, 6), strict=True)) for j in range(rng.integers(1, 5))]
        names = [(r[0], r[3]) for r in rows[patient]]
        overlaps[patient] = {(*a, *b): int(rng.integers(1, 4)) for a in names for b in names if a[0] < b[0] and rng.random() < 0.15}
    obs = spark.createDataFrame([(p, *r) for p, x in rows.items() for r in x], "patient_id int, study string, ts timestamp_ntz, treated boolean, obs string, volume double, cx double, cy double, cz double")
    shared = spark.createDataFrame([(p, *k, n) for p, x in overlaps.items() for k, n in x.items()], "patient_id int, study_a string, obs_a string, study_b string, obs_b string, overlap long")
    got = {}
    for r in M.track_lesions(obs, shared).orderBy("patient_id", "lesion_id", "t").collect():
        got.setdefault(r.patient_id, {}).setdefault(r.lesion_id, []).append((r.study, r.obs))
    assert {p: list(x.values()) for p, x in got.items()} == {p: want for p, x in rows.items() if (want := slow_tracking(x, overlaps[p]))}


@pytest.mark.parametrize("name", ["c{}", "a rather long name {:03}", ""])
def test_numbers_by_strings(spark, name):
    rows = [(g, name.format(i), i) for i in range(90) for g in (["x", "y"] if i % 3 else [None])]
    got = ranks.numbered(spark.createDataFrame(rows, "g string, k string, v int").repartition(5), ["g"], ["k", "v"]).collect()
    for g in ("x", "y", None):
        own = sorted((r.k, r.v) for r in got if r.g == g)
        assert [(r.k, r.v) for r in sorted((r for r in got if r.g == g), key=lambda r: r.i)] == own
        assert {r.i for r in got if r.g == g} == set(range(len(own))) and {r.n for r in got if r.g == g} == {len(own)}


def test_sobel(spark):
    df = S.derivative_sobel(series(spark, [(i, v) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7])]), "absolute")
    assert values(df, "derivative") == [-2, -2, -2, -2, -2, 6]


def test_edges(spark):
    e = E.temporal_edges_full(series(spark, [(0, 1), (60, 1), (120, 1)]), "past").orderBy("src", "dst").collect()
    assert [(r.src, r.dst, round(r.weight, 6), round(r.attr, 6)) for r in e] == [(1, 0, 0.164271, -0.164271), (2, 0, 0.328542, -0.328542), (2, 1, 0.164271, -0.164271)]
    one = E.temporal_edges_full(series(spark, [(0, 1)])).collect()
    assert [(r.src, r.dst, r.weight, r.attr) for r in one] == [(0, 0, 0, 0)]


def test_recurrence(spark):
    df = series(spark, [(i, 1) for i in range(7)])
    names = F.array(*[F.lit(x) for x in ("", "CR", "CR", "PD", "PD", "SD", "SD")])
    n = E.recurrence_probabilities(df.withColumn("rano", F.get(names, F.col("t")))).collect()
    assert {(r.held_class, r.k, r["class"]): r.n for r in n} == {("CR", 1, "CR"): 1, ("CR", 2, "CR"): 1, ("CR", 3, "PD"): 1, ("PD", 1, "PD"): 1, ("PD", 2, "SD"): 1, ("SD", 1, "SD"): 1}


@pytest.mark.parametrize("day, expected", [(150, (25.0, "PR")), (300, (None, None)), (100, (40.0, "SD"))])
def test_target(spark, day, expected):
    r = R.target_at_time(S.response_class(series(spark, [(0, 100), (100, 40), (200, 10)])), day).first()
    assert (r.target_volume, r.target_rano) == expected


def test_sample_size(spark):
    assert spark.range(1).select(E.cochran_sample_size(F.lit(1000)).alias("n")).first().n == 64


def predictions(spark, y, p=None, s=None):
    rows = [("m", i, a, (p or y)[i], float((s or y)[i])) for i, a in enumerate(y)]
    return spark.createDataFrame(rows, "model string, id int, target int, prediction int, confidence double")


def test_auc(spark):
    df = predictions(spark, [1, 0, 1, 0], s=[0.9, 0.9, 0.4, 0.1])
    assert E.roc_auc(df, ["model"], F.col("target") == 1).first().auc == pytest.approx(0.625)
    flip = df.withColumn("confidence", 1 - F.col("confidence"))
    assert E.roc_auc(flip, ["model"], F.col("target") == 1).first().auc == pytest.approx(0.375)
    assert E.roc_auc(predictions(spark, [1, 1]), ["model"], F.col("target") == 1).first().auc is None


def test_classification(spark):
    r = E.classification_metrics(predictions(spark, [0, 0, 1, 1], [0, 1, 1, 1]), ["model"]).first()
    assert (r.accuracy, r.balanced_accuracy, round(r.f1, 6), round(r.precision, 6), r.recall) == (0.75, 0.75, 0.733333, 0.833333, 0.75)


def test_weights(spark):
    w = {r.label: r.sample_weight for r in E.class_weights(predictions(spark, [0, 0, 0, 1]), "target").collect()}
    assert w == {0: pytest.approx(4 / 3), 1: 4}


def test_scaling(spark):
    df = spark.createDataFrame([(0.0, 2.0)], "t0_volume double, t1_volume double")
    out, _ = T.normalize_volume(df, df, "std", ["t0_volume", "t1_volume"])
    assert tuple(out.select("t0_volume", "t1_volume").first()) == (-1, 1)
    x = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    z = T.apply_standardization(x, T.standardize_columns(x, ["x"]), ["x"])
    assert sorted(r.x for r in z.collect()) == [-1, 0, 1]


@pytest.mark.parametrize("chain", ["log", "3root->max", "frac->std", "log->std->max"])
def test_decoding(spark, chain):
    df = spark.createDataFrame([(1, 2.0, 5.0), (2, 3.0, 0.0)], "id int, t0_volume double, t1_volume double")
    out, _ = T.normalize_volume(df, df, chain, ["t0_volume", "t1_volume"])
    back = out.orderBy("id").select(T.denormalize_volume(F.col("t1_volume"), F.col("decoder")).alias("v")).collect()
    assert [r.v for r in back] == pytest.approx([5, 0], abs=1e-9)


def test_wilcoxon(spark):
    df = spark.createDataFrame([("p", float(i), 0.0) for i in range(1, 6)], "pair string, a double, b double")
    r = E.wilcoxon_folds(df, ["pair"], "a", "b").first()
    assert (r.statistic, r.p_value) == (0, 0.0625)


def test_wilcoxon_with_ties(spark):
    """The normal approximation with the variance corrected for ties, worked out by hand; and all pairs of models."""
    d = [1, 1, 2, 2, 3, -1, 4, 5, 5, 6]
    df = spark.createDataFrame([("p", float(v), 0.0) for v in d], "pair string, a double, b double")
    r = E.wilcoxon_folds(df, ["pair"], "a", "b").first()
    # Ranks 2 (three ones), 4.5, 4.5, 6, 7, 8.5, 8.5, 10; down = 2; sum(t^3 - t) = 24 + 6 + 6.
    z = (2 - 27.5) / np.sqrt(10 * 11 * 21 / 24 - 36 / 48)
    assert r.statistic == 2 and r.p_value == pytest.approx(erfc(abs(z) / np.sqrt(2)))
    auc = spark.createDataFrame([(m, f, 0.1 * m + f) for m in (1, 2, 3) for f in range(3)], "model int, fold int, auc double").withColumn("config", F.lit("c"))
    pairs = E.metric_pairs(auc, ["config"], "model", "fold", "auc").collect()
    assert sorted((r.pair, r.fold) for r in pairs) == sorted((p, f) for p in ("1 / 2", "1 / 3", "2 / 3") for f in range(3)) and all(r.a < r.b for r in pairs)


def test_running_totals_and_quantiles(spark):
    """Many values, ties, nulls, and a group that holds most rows, against plain sorting."""
    rng = np.random.default_rng(1)
    rows = [(None if g == 2 else g, None if rng.random() < 0.05 else float(v), int(rng.integers(0, 5))) for g, n in ((0, 900), (1, 3), (2, 40)) for v in rng.integers(0, 300, n)]
    df = spark.createDataFrame(rows, "g int, v double, n int")
    counts = df.groupBy("g", "v").agg(F.sum("n").alias("n"))
    got = {(r.g, r.v): (r.before_n, r.all_n) for r in ranks.running_totals(counts, ["g"], "v", ["n"]).collect()}
    for g, v in got:
        own = [(x, n) for h, x, n in rows if h == g]
        assert got[g, v] == (sum(n for x, n in own if v is not None and (x is None or x < v)), sum(n for _, n in own))
    shares = [0, 0.1, 0.25, 0.5, 0.9, 1]
    for r in ranks.quantiles(df, ["g"], "v", shares).collect():
        assert r.q == pytest.approx(np.quantile([v for g, v, _ in rows if g == r.g and v is not None], shares).tolist())
    whole = ranks.quantiles(df, [], "v", [0.5]).first()
    assert whole.q == pytest.approx([np.quantile([v for _, v, _ in rows if v is not None], 0.5)])
    assert ranks.quantiles(df.where("false"), ["g"], "v", shares).count() == 0


def test_scaling_without_training_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "t0_volume double, t1_volume double")
    train, test = T.normalize_volume(df.where("false"), df, "log->std->max", ["t0_volume", "t1_volume"])
    assert train.count() == 0 and tuple(test.select("t0_volume", "t1_volume").first()) == (None, None)


def test_asof_against_all_pairs(spark):
    """Dense series with several points a day and points at the very dates, against every pair."""
    rng = np.random.default_rng(2)
    rows = [(1, k, DAY0 + timedelta(hours=int(h)), i, float(v)) for k in range(6) for i, (h, v) in enumerate(zip(np.sort(rng.choice([0, 6, 12, 24, 30, 31, 48, 60, 61, 72, 96, 97, 240], 9)), rng.integers(0, 4, 9), strict=True))]
    s = spark.createDataFrame(rows, "patient_id int, lesion_id int, ts timestamp_ntz, t int, volume double")
    grid = R.time_grid(s, 8, 6).cache()
    days = lambda a, b: (a - b) // timedelta(days=1)
    for nonzero in (False, True):
        got = {(r.lesion_id, r.i): (r.t, r.volume) for r in R.asof_nearest(s, grid, ["t", "volume"], nonzero).collect()}
        for g in grid.collect():
            own = [r for r in rows if r[1] == g.lesion_id and (r[4] or not nonzero)]
            best = min(own, key=lambda r: (abs(days(r[2], g.target_ts)), r[2], r[3]), default=None)
            assert got[g.lesion_id, g.i] == ((best[3], best[4]) if best else (None, None))
    for r in R.asof_bilateral(s, grid).collect():
        own = sorted((x[2], x[3], x[4]) for x in rows if x[1] == r.lesion_id)
        before, after = [x for x in own if x[0] < r.target_ts], [x for x in own if x[0] >= r.target_ts]
        a, b = (before[-1] if before else None, after[0]) if after else (own[-2], own[-1])
        assert (r.d1, r.v1, r.d2, r.v2) == ((days(a[0], r.target_ts), a[2]) if a else (None, None)) + (days(b[0], r.target_ts), b[2])


def test_nearest_region_without_overlap(spark):
    atlas = spark.createDataFrame([(x, 0, 0, 1 if x < 5 else 2) for x in range(10)], "x int, y int, z int, label int")
    voxels = spark.createDataFrame([("a", 1, 4, 0), ("b", 9, 2, 0), ("c", 4, 4, 0), ("c", 5, 4, 0), ("d", 3, 0, 0)], "obs string, x int, y int, z int")
    assert {r.obs: (r.region, r.overlaps) for r in M.locate_region(voxels, atlas, ["obs"]).collect()} == {"a": (1, False), "b": (2, False), "c": (1, False), "d": (1, True)}


def test_bootstrap_of_the_other_class(spark):
    """flip takes the other class and 1 - confidence, which leaves every AUC as it is."""
    df = predictions(spark, [1, 0, 1, 0, 1, 1, 0], s=[0.9, 0.9, 0.4, 0.1, 0.7, 0.2, 0.3])
    a, b = (replicates.bootstrap_auc_ci(df, ["model"], ["id"], 50, flip=f).first() for f in (False, True))
    assert (a.low, a.high, a.mean) == (pytest.approx(b.low), pytest.approx(b.high), pytest.approx(b.mean))


def test_vectors_of_an_extractor(spark):
    import pandas as pd

    @F.pandas_udf("array<double>")
    def lengths(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [float(len(x)), float(x.count("a"))])

    out = T.apply_vector_extractor(spark.createDataFrame([("banana",), ("",)], "name string"), lengths, "name")
    assert {r.name: list(r.vector) for r in out.collect()} == {"banana": [6, 3], "": [0, 0]}


def test_cluster_scores(spark):
    df = spark.createDataFrame([(0, [0.0]), (0, [2.0]), (1, [10.0]), (1, [12.0])], "cluster int, v array<double>")
    assert E.davies_bouldin(df, "v", "cluster").first()[0] == pytest.approx(0.2)
    r = E.cluster_bic_aic(df, "v", "cluster").first()
    assert (r.aic, round(r.bic, 6)) == (4, 2.772589)
    assert (round(r.bic_likelihood, 3), round(r.aic_likelihood, 3)) == (-11.607, -16.835)


def test_kfold(spark):
    df = spark.range(15).select("id", (F.col("id") >= 10).cast("int").alias("y"))
    n = E.stratified_kfold(df, "y", ["id"], 5).groupBy("fold", "y").count().collect()
    assert sorted((r.fold, r.y, r["count"]) for r in n) == [(f, y, 2 - y) for f in range(5) for y in (0, 1)]
    s = E.stratified_split(df, "y", ["id"], 0.2).where("is_test").groupBy("y").count().collect()
    assert {r.y: r["count"] for r in s} == {0: 2, 1: 1}


def test_encodings(spark):
    df = spark.createDataFrame([(x,) for x in ("CR", "PR", "SD", "PD", None)], "c string")
    assert [r[0] for r in df.select(C.encode_response(F.col("c"), "binary")).collect()] == [0, 0, 1, 1, None]
    raw = spark.createDataFrame([(x,) for x in ("['Poumon']", "['nan']", "[nan]", "[]", "x")], "c string")
    assert [r.c for r in T.clean_clinical(raw, {"c": {"Poumon": "Lung"}}).collect()] == ["Lung", None, None, None, None]


def test_quartiles(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 6)], "v double")
    assert [r.subset for r in T.quantile_subsets(df, "v").orderBy("v").collect()] == [1, 1, 2, 3, 4]


def test_session_names(spark):
    df = spark.createDataFrame([("ses-20200131235959",), ("t3 - 20200131235959",), ("other",)], "s string")
    got = [r[0] for r in df.select(C.parse_session_ts(F.col("s"))).collect()]
    assert got == [datetime(2020, 1, 31, 23, 59, 59)] * 2 + [None]


def test_best_k():
    assert L.best_k([(2, 10, 10), (3, 9, 9), (4, 8, 9.5), (5, 8.5, 8)]) == 5
    assert L.best_k([(2, 10, 10), (3, 11, 9)]) == 2


def test_distances():
    x = np.array([0.0, 1, 2, 1, 0])
    assert L.dtw_costs(x[None], x)[0] == 0
    assert L.dtw_costs(np.array([[0.0, 0, 1, 2]]), np.array([0.0, 1, 2, 2]))[0] == 0
    z = L.znorm(x)
    assert L.shape_distances(z[None], z)[0] == pytest.approx(0)


@pytest.mark.parametrize("metric", ["euclidean", "dtw", "shape"])
def test_clusters_part(spark, metric):
    rows = [(i, [0.0, 1.0, 0.0, -1.0, 0.1 * (i % 3)] if i % 2 else [5.0, 6.0, 9.0, 14.0, 20.0 + i % 3]) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    got = {r.id: r.cluster for r in L.assigned(df, "v", L.fit_clusters(df, "v", 2, metric, rounds=5), metric).collect()}
    assert len({got[i] for i in range(0, 30, 2)}) == 1 and len({got[i] for i in range(1, 30, 2)}) == 1 and got[0] != got[1]


def test_mixture(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(0, 1, 3) + (10 if i % 3 else 0)).tolist()) for i in range(90)]
    out, score = L.mixture_clusters(spark.createDataFrame(rows, "id int, v array<double>"), "v", 2, rounds=10)
    got = {r.id: r.cluster for r in out.collect()}
    assert len({got[i] for i in got if i % 3 == 0}) == 1 and len(set(got.values())) == 2
    assert score["aic"] < score["bic"]


def test_coinciding_centroids(spark):
    """Clusters with one centroid are not held against each other."""
    df = spark.createDataFrame([(0, [0.0]), (0, [2.0]), (1, [0.0]), (1, [2.0]), (2, [10.0]), (2, [12.0])], "cluster int, v array<double>")
    assert E.davies_bouldin(df, "v", "cluster").first()[0] == pytest.approx(0.2)
    assert E.davies_bouldin(df.where("cluster < 2"), "v", "cluster").first()[0] is None


def test_empty_series(spark):
    df = series(spark, [(0, 1)]).where("false")
    for f in (S.response_class, S.tag_swings, S.discard_gaps, S.relative_volume, S.derivative_sobel, E.temporal_edges_full, E.temporal_edges_sparse):
        assert f(df).count() == 0


def dense_spline(x, y, at):
    """The not-a-knot spline by a dense system of all second derivatives."""
    n, h = len(x), np.diff(x)
    m, r = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        m[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    m[0, :3] = 1 / h[0], -(1 / h[0] + 1 / h[1]), 1 / h[1]
    m[-1, -3:] = 1 / h[-2], -(1 / h[-2] + 1 / h[-1]), 1 / h[-1]
    s = np.linalg.solve(m, r)
    out = []
    for v in at:
        k = min(max(int(np.searchsorted(x, v, "right")) - 1, 0), n - 2)
        t, u = v - x[k], x[k + 1] - v
        out.append((s[k] * u**3 + s[k + 1] * t**3) / (6 * h[k]) + (y[k] / h[k] - s[k] * h[k] / 6) * u + (y[k + 1] / h[k] - s[k + 1] * h[k] / 6) * t)
    return np.array(out)


@pytest.mark.parametrize("n", [4, 5, 9, 1000])
def test_many_splines_at_once(n):
    rng = np.random.default_rng(n)
    x, y = np.cumsum(rng.integers(1, 9, (7, n)), axis=1).astype(float), rng.normal(0, 3, (7, n))
    at = np.linspace(-1, x.max() + 1, 23)
    assert np.allclose(R.not_a_knot(x, y, at), [dense_spline(a, b, at) for a, b in zip(x, y, strict=True)], rtol=1e-6, atol=1e-6 * (1 + np.abs(R.not_a_knot(x, y, at)).max()))


def test_spline_of_a_cubic(spark):
    """A cubic comes back from series of different lengths, with several points a day as their mean; three days are too few."""
    f = lambda d: (d / 100) ** 3 - 2 * (d / 100) ** 2 + d / 100 + 5
    own = {1: [0, 50, 200, 360], 2: [0, 10, 20, 33, 80, 200, 300, 360], 3: [0, 100, 360], 4: [0, 0, 120, 240, 360]}
    rows = [(p, 1, datetime(2020, 1, 1) + timedelta(days=d), t, d, f(d) + (1 if (p, t) == (4, 0) else -1 if (p, t) == (4, 1) else 0)) for p, days in own.items() for t, d in enumerate(days)]
    df = spark.createDataFrame(rows, "patient_id int, lesion_id int, ts timestamp_ntz, t int, timedelta_days int, volume double")
    got = {(r.patient_id, r.i): r.volume for r in R.resample_bspline(df).collect()}
    assert set(got) == {(p, i) for p in (1, 2, 4) for i in range(7)} and all(v == pytest.approx(f(60 * i)) for (p, i), v in got.items())


def test_wide_table_of_many_columns(spark):
    """38 timepoints x 214 features: picked by place, with gaps, rows of one timepoint, and series without any of them."""
    names = [f"f{j}" for j in range(214)]
    rows = [(s, t, float(s * 1000 + t)) for s in range(5) for t in range(0, 38, 1 + s)] + [(0, 3, 9999.0), (9, 50, 1.0)]
    df = spark.createDataFrame(rows, "lesion_id int, t int, v double").select("lesion_id", "t", *[(F.col("v") + j).alias(n) for j, n in enumerate(names)])
    out = T.wide_features(df, ["lesion_id"], "t", list(range(38)), names)
    assert out.columns == ["lesion_id", *[f"t{t}_{n}" for t in range(38) for n in names]]
    got = {r.lesion_id: r for r in out.select("lesion_id", "t0_f0", "t3_f213", "t6_f7", "t37_f0").collect()}
    assert tuple(got[0])[1:] == (0, 9999 + 213, 6 + 7, 37) and tuple(got[1])[1:] == (1000, None, 1006 + 7, None) and tuple(got[9])[1:] == (None,) * 4
    assert len(out.collect()) == 6


def test_removed_clusters(spark):
    df = spark.createDataFrame([(c, i) for c, n in (("a", 70), ("b", 30), ("c", 1)) for i in range(n)], "cluster string, id int")
    assert {r.cluster: r.n for r in E.removed_clusters(df, "cluster", 31).collect()} == {"b": 30, "c": 1} and E.filter_small_clusters(df, "cluster", 31).count() == 70
    # The Cochran size of 101 rows is 41.
    assert {(r.cluster, r.n, r.least) for r in E.removed_clusters(df, "cluster").collect()} == {("b", 30, 41), ("c", 1, 41)}
    assert E.filter_small_clusters(df.where("false"), "cluster").count() == 0


def test_match_report(spark):
    """Ambiguous labels, lesions and labels without a partner, an empty truth, and a patient without lesions."""
    matches = spark.createDataFrame([("p", "m1", 1), ("p", "m0", 1), ("p", "m2", 3), ("q", "m0", 1)], "patient_id string, lesion string, label int")
    tracked = spark.createDataFrame([("p", "m0", False), ("p", "m1", True), ("p", "m2", None), ("p", "m3", False), ("q", "m0", False), ("r", "m0", True), ("r", "m1", False)], "patient_id string, lesion string, is_empty boolean")
    labels = spark.createDataFrame([("p", 1), ("p", 2), ("p", 3), ("q", 1), ("s", 4)], "patient_id string, label int")
    report = M.match_report(matches, tracked, labels).cache()
    assert {tuple(r)[:4] + (tuple(r.matched_mets.items()), tuple(r.unmatched_parsed_mets), tuple(r.unmatched_gt_mets), tuple((k, tuple(v)) for k, v in r.ambiguous_parsed_matches.items()), tuple(r.t0_zero_mets)) for r in report.collect()} == {
        ("p", 3, 4, 3, ((1, "m0"), (3, "m2")), ("m3",), (2,), ((1, ("m0", "m1")),), ()),
        ("q", 1, 1, 1, ((1, "m0"),), (), (), (), ()),
        ("r", 0, 2, 1, (), (), (), (), ("m0", "m1")),
        ("s", 1, 0, 0, (), (), (4,), (), ()),
    }
    r = M.match_totals(report).first()
    assert (r.patients, r.labels, r.parsed, r.matched, r.unmatched_gt, r.unmatched_parsed, r.t0_zero, r.ambiguous, r.surplus, r.equal, r.missed) == (4, 5, 5, 3, 2, 1, 2, 1, 1, 2, 1)
    assert M.match_totals(report.where("false")).first().patients == 0


def test_key_mismatches(spark):
    from lachesis.operators import summaries as U

    a, b = (spark.createDataFrame([(i,) for i in own], "patient_id int") for own in ([1, 2, 2], [2, 3]))
    assert {tuple(r) for r in U.key_mismatches(a, b).collect()} == {(1, False, True), (3, True, False)}
