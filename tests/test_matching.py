"""Runs, distance transforms and regions against plain numpy."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from lachesis.operators import matching as M

VOXEL = "patient_id string, study int, obs string, x int, y int, z int"


def lesions(seed, patients=3, studies=6):
    rng = random.Random(seed)
    out = []
    for p in range(patients):
        for s in range(studies):
            for o in range(rng.randrange(4)):
                x, y, z = (rng.randrange(6) for _ in range(3))
                out += [(f"p{p}", 3 * s, f"o{o}", x + i, y + j, z + k) for i in range(rng.randrange(1, 6)) for j in range(2) for k in range(2) if rng.random() < 0.8]
    return out


@pytest.mark.parametrize("gap,back", [(None, None), (3, None), (0, None), (7, None), (None, 1), (None, 3), (6, 1)])
def test_overlap_by_runs(spark, gap, back):
    rows = lesions(7)
    place = {p: {s: i for i, s in enumerate(sorted({r[1] for r in rows if r[0] == p}))} for p in {r[0] for r in rows}}
    want = Counter()
    for p, s, o, *v in set(rows):
        for q, t, u, *w in set(rows):
            if p == q and s < t and v == w and (gap is None or t - s <= gap) and (back is None or place[p][t] - place[p][s] <= back):
                want[p, s, o, t, u] += 1
    got = M.lesion_overlap(spark.createDataFrame(rows + rows[:5], VOXEL), gap, back)
    assert {tuple(r[:5]): r.overlap for r in got.collect()} == dict(want) and got.schema["overlap"].dataType.simpleString() == "bigint"


def test_runs_hold_every_voxel_once(spark):
    rows = lesions(8)
    runs = M.lesion_runs(spark.createDataFrame(rows + rows, VOXEL)).collect()
    assert Counter((r.patient_id, r.study, r.obs, x, r.y, r.z) for r in runs for x in range(r.x0, r.x1 + 1)) == Counter(set(rows))
    assert len(runs) < len(set(rows))


@pytest.mark.parametrize("shape", [(7, 5, 6), (1, 1, 12), (20, 1, 3)])
def test_distance_transform(spark, shape):
    rng = np.random.default_rng(sum(shape))
    low = (-2, 5, 100)
    every = [(x, y, z) for x in range(shape[0]) for y in range(shape[1]) for z in range(shape[2])]
    at = {label: rng.choice(len(every), 3, replace=False) for label in (4, 9)}
    atlas = spark.createDataFrame([(*(int(c + o) for c, o in zip(every[i], low, strict=True)), label) for label, own in at.items() for i in own], "x int, y int, z int, label int")
    lines = M.distance_transform(atlas, [(o, o + n - 1) for o, n in zip(low, shape, strict=True)]).collect()
    got = {(r.label, x, r.y - low[1], r.z - low[2]): d for r in lines for x, d in enumerate(r.d)}
    want = {(label, *p): min(max(abs(a - b) for a, b in zip(p, every[i], strict=True)) for i in own) for label, own in at.items() for p in every}
    assert got == want
    with pytest.raises(ValueError, match="voxels"):
        M.distance_transform(atlas, [(0, 10**6)] * 3)


def brute_region(voxels, atlas):
    hits = Counter(atlas[v] for v in voxels if v in atlas)
    if hits:
        return min(hits, key=lambda k: (-hits[k], k)), True
    mean = {}
    for label in set(atlas.values()):
        own = [p for p, k in atlas.items() if k == label]
        mean[label] = np.mean([min(max(abs(a - b) for a, b in zip(v, p, strict=True)) for p in own) for v in voxels])
    return min(mean, key=lambda k: (mean[k], k)), False


def test_regions(spark):
    """Lesions inside, outside and beyond the atlas."""
    rng = random.Random(3)
    atlas = {(x, y, z): rng.choice([1, 2, 5]) for x in range(6) for y in range(4) for z in range(3) if rng.random() < 0.3}
    found = {o: [tuple(rng.randrange(-4, 12) for _ in range(3)) for _ in range(rng.randrange(1, 5))] for o in range(60)}
    voxels = spark.createDataFrame([(o, *v) for o, own in found.items() for v in own], "obs int, x int, y int, z int")
    regions = spark.createDataFrame([(*p, k) for p, k in atlas.items()] + [(0, 9, 9, 0)], "x int, y int, z int, label int")
    got = {r.obs: (r.region, r.overlaps) for r in M.locate_region(voxels, regions, ["obs"]).collect()}
    assert got == {o: brute_region(v, atlas) for o, v in found.items()} and any(not x[1] for x in got.values())
    only = {p: k for p, k in atlas.items() if k in (2, 5)}
    assert {r.obs: (r.region, r.overlaps) for r in M.locate_region(voxels, regions, ["obs"], [2, 5]).collect()} == {o: brute_region(v, only) for o, v in found.items()}


def test_no_regions_or_lesions(spark):
    voxels = spark.createDataFrame([(1, 0, 0, 0)], "obs int, x int, y int, z int")
    atlas = spark.createDataFrame([(0, 0, 0, 0)], "x int, y int, z int, label int")
    assert M.locate_region(voxels, atlas, ["obs"]).count() == 0
    assert M.locate_region(voxels.where("false"), atlas.selectExpr("x", "y", "z", "7 as label"), ["obs"]).count() == 0


def test_voxels_of_a_task_stay_bounded(spark, monkeypatch):
    """Tasks grow with the voxels, and one shuffle by line serves distinct voxels, runs and pairs: none holds more as tables grow."""
    from lachesis.plans import adapters

    monkeypatch.setattr(M, "VOXELS_A_TASK", 100)
    v = adapters.voxels(spark, "/root/testdata/sf0.001")
    assert v.rdd.getNumPartitions() >= v.count() / 100
    plan = M.lesion_overlap(v)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") and plan.count("Exchange hashpartitioning(patient_id") == plan.count("REPARTITION_BY_NUM") + 1


def test_tasks_of_pairs_grow_with_the_rows(spark, capsys, monkeypatch):
    """Overlaps, pairs, candidates and patients are dealt over tasks that grow with the voxels, whatever Spark's setting; results stay."""
    from lachesis import registry

    sf, names = "/root/testdata/sf0.001", ["lesion_overlap", "correspondence_metrics", "best_match", "track_lesions"]
    rows = lambda: {q: sorted(map(str, registry.queries()[q](spark, sf).collect())) for q in names}
    few = rows()
    monkeypatch.setattr(M, "VOXELS_A_TASK", 250)
    voxels = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    for q in names:
        registry.queries()[q](spark, sf).explain()
        plan = capsys.readouterr().out
        numbers = [int(n) for n in re.findall(r"hashpartitioning\([^()]*, (\d+)\), REPARTITION_BY_NUM", plan)]
        joins = re.findall(r"hashpartitioning\(([^()]*), \d+\), ENSURE_REQUIREMENTS", plan)
        assert set(numbers) == {-(-voxels // 250)}
        # Spark's own exchanges are left where observations are made of voxels alone.
        assert all(re.fullmatch(r"patient_id#\d+L?, study#\d+, obs#\d+", j) for j in joins), joins
    assert rows() == few
