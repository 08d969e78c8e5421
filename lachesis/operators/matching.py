"""Measuring observations, pairing them between studies, and linking them into series."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import centroid_distance, sphere_diameter
from ..sources.io import stored

STUDY = ["patient_id", "study"]
MAX_DISTANCE = 6.0


def observations(voxels: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Volume and mean voxel index of each (patient, study, obs): one aggregation, combined before the shuffle."""
    size = F.lit(float(np.prod(spacing)))
    return voxels.groupBy(*STUDY, "obs").agg((F.count(F.lit(1)) * size).alias("volume"), *[F.avg(c).alias(f"c{c}") for c in "xyz"])


#: Voxels that a task takes on the average: its sorts and tables need memory for these, however many there are in all.
VOXELS_A_TASK = 250_000


def by_line(voxels: DataFrame, rows: int) -> DataFrame:
    """Voxels dealt by their line (patient, y, z) over tasks whose number grows with the rows. Distinct voxels, runs and the pairs of
    runs all meet on their line, so this one shuffle serves them."""
    return voxels.repartition(tasks_of(rows), "patient_id", "y", "z")


def tasks_of(rows: int) -> int:
    """Tasks for a number of voxels, or for what is made of them."""
    return max(1, -(-rows // VOXELS_A_TASK))


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """df dealt by keys over so many tasks, or left to Spark's setting, which doesn't grow with the rows."""
    return df.repartition(tasks, *keys) if tasks else df


def lesion_runs(voxels: DataFrame) -> DataFrame:
    """Voxels as runs of neighbouring x: (patient_id, study, obs, y, z, x0, x1). A voxel given twice counts once."""
    line = ["patient_id", "study", "obs", "y", "z"]
    run = F.col("x") - F.dense_rank().over(Window.partitionBy(*line).orderBy("x"))
    return voxels.select(*line, "x", run.alias("_run")).groupBy(*line, "_run").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_run")


#: What a pair of observations is known by.
PAIR = ["patient_id", "study_a", "obs_a", "study_b", "obs_b"]


def lesion_overlap(voxels: DataFrame, max_gap: int | None = None, max_back: int | None = None, tasks: int | None = None) -> DataFrame:
    """Shared voxels of two observations of a patient in an earlier study a and a later study b. Runs of voxels meet on their line
    (patient, y, z), so a patient is dealt over its lines, and each two runs count their common length.

    max_gap bounds the difference of two studies' numbers, max_back how many studies of the patient lie from b back to a; studies
    are then dealt by blocks of that many, and a run meets those of its own block and the one before only. Pairs are added up by
    `tasks` tasks."""
    runs = lesion_runs(voxels)
    place, bound = F.col("study"), max_gap
    if max_back is not None:
        studies = voxels.select("patient_id", "study").distinct()
        studies = studies.withColumn("_place", F.row_number().over(Window.partitionBy("patient_id").orderBy("study")).cast("long"))
        runs, place, bound = runs.join(studies, ["patient_id", "study"]), F.col("_place"), max_back
    else:
        runs = runs.withColumn("_place", place.cast("long") if bound is not None else F.lit(0).cast("long"))
    block = F.floor(F.col("_place") / (bound + 1)) if bound is not None else None
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("study", "obs", "x0", "x1", "_place")]
    line = ["patient_id", "y", "z"]
    a = runs.select(*line, *side("a"), *([F.explode(F.array(block, block + 1)).alias("_block")] if bound is not None else []))
    b = runs.select(*line, *side("b"), *([block.alias("_block")] if bound is not None else []))
    fits = (F.col("study_a") < F.col("study_b")) & (F.col("x0_a") <= F.col("x1_b")) & (F.col("x0_b") <= F.col("x1_a"))
    if max_gap is not None:
        fits &= F.col("study_b") - F.col("study_a") <= max_gap
    if max_back is not None:
        fits &= F.col("_place_b") - F.col("_place_a") <= max_back
    common = F.least("x1_a", "x1_b") - F.greatest("x0_a", "x0_b") + 1
    # Without a bound the keys are the line alone, so rows that are dealt by it stay where they are.
    pairs = a.join(b, [*line, *(["_block"] if bound is not None else [])]).where(fits)
    return dealt(pairs.select(*PAIR, common.alias("_common")), tasks, *PAIR).groupBy(*PAIR).agg(F.sum("_common").cast("long").alias("overlap"))


def correspondence_metrics(obs: DataFrame, overlap: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), max_gap: int | None = None, tasks: int | None = None) -> DataFrame:
    """For each pair of observations of a patient, reference a in an earlier study and candidate b in a later one: overlap,
    centroid distance, and diameter of the sphere of a's volume. A pair with an empty side has (0, infinity, 0). The joins are dealt over
    `tasks` tasks; an overlap with the same number of them stays where it is."""
    obs = dealt(obs, tasks, "patient_id")
    side = lambda s: obs.select("patient_id", *[F.col(c).alias(f"{c}_{s}") for c in ("study", "obs", "volume", "cx", "cy", "cz")])
    pairs = side("a").join(side("b"), "patient_id").where(F.col("study_a") < F.col("study_b"))
    if max_gap is not None:
        pairs = pairs.where(F.col("study_b") - F.col("study_a") <= max_gap)
    pairs = dealt(pairs, tasks, *PAIR).join(overlap, PAIR, "left")
    empty = (F.col("volume_a") == 0) | (F.col("volume_b") == 0)
    dist = centroid_distance([F.col(f"c{c}_a") * k for c, k in zip("xyz", spacing, strict=True)], [F.col(f"c{c}_b") * k for c, k in zip("xyz", spacing, strict=True)])
    return pairs.select(
        "patient_id", "study_a", "obs_a", "study_b", "obs_b", F.when(empty, F.lit(0)).otherwise(F.coalesce("overlap", F.lit(0))).cast("long").alias("overlap"),
        F.when(empty, F.lit(float("inf"))).otherwise(dist).alias("distance"), F.when(empty, F.lit(0.0)).otherwise(sphere_diameter(F.col("volume_a"))).alias("diameter"),
    )


def best_match(metrics: DataFrame, candidate: list[str], index: str, method: str = "both", tasks: int | None = None) -> DataFrame:
    """One reference for each candidate, by overlap, by gated centroid distance, or both: the largest overlap, ties to the
    smaller gated distance, then to the first index. A candidate without a fit has no row. Candidates are dealt over `tasks` tasks."""
    metrics = dealt(metrics, tasks, *candidate)
    gate = F.col("distance") <= F.least(F.col("diameter"), F.lit(MAX_DISTANCE))
    if method == "overlap":
        rows, order = metrics.where(F.col("overlap") > 0), [F.desc("overlap"), F.asc(index)]
    elif method == "centroid":
        rows, order = metrics.where(gate), [F.asc("distance"), F.asc(index)]
    else:
        first = F.col(index) == F.min(index).over(Window.partitionBy(*candidate, "overlap"))
        rows = metrics.withColumn("_first", first).where(gate | ((F.col("overlap") > 0) & F.col("_first"))).drop("_first")
        order = [F.desc("overlap"), F.asc("distance"), F.asc(index)]
    w = Window.partitionBy(*candidate).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def same_space(pairs: DataFrame, a: list[str], b: list[str]) -> DataFrame:
    """Adds same_space: whether the spacing columns a and b agree."""
    same = F.lit(True)
    for x, y in zip(a, b, strict=True):
        same = same & F.col(x).eqNullSafe(F.col(y))
    return pairs.withColumn("same_space", same)


def choose(rows: list[tuple[float, float, float]]) -> int | None:
    """The index that best_match('both') names among (overlap, distance, diameter)."""
    best, key = None, None
    seen: set[float] = set()
    for i, (overlap, distance, diameter) in enumerate(rows):
        opens = overlap > 0 and overlap not in seen
        seen.add(overlap)
        if (opens or distance <= min(diameter, MAX_DISTANCE)) and (key is None or (-overlap, distance) < key):
            best, key = i, (-overlap, distance)
    return best


#: Microseconds of a day, and the time of a study without one: after all others.
DAY, LAST = 86_400_000_000, 1 << 62


def reference(members: list[dict], at: int) -> dict:
    """Of non-empty members in time order, none of them later than `at`, the one closest in floored days; the first of equals."""
    i, days = len(members) - 1, abs((members[-1]["at"] - at) // DAY)
    while i and abs((members[i - 1]["at"] - at) // DAY) == days:
        i -= 1
    return members[i]


def track_lesions(obs: DataFrame, overlap: DataFrame, tasks: int | None = None) -> DataFrame:
    """Links observations (patient_id, study, ts, treated, obs, volume, cx, cy, cz) into series, in the order of studies.

    Each observation is held against every open series by that series' non-empty member closest in time (the earlier one of
    equals). Series that a study does not extend get an empty point; an observation without a match opens a series in
    treated studies only. A second match of a study replaces the first. The fold needs a patient's observations together:
    rows, never voxels; overlaps come from the join. Patients are dealt over `tasks` tasks."""
    pairs = dealt(overlap, tasks, "patient_id", "study_b", "obs_b").groupBy("patient_id", "study_b", "obs_b").agg(F.collect_list(F.struct("study_a", "obs_a", "overlap")).alias("overlaps")).select("patient_id", F.col("study_b").alias("study"), F.col("obs_b").alias("obs"), "overlaps")
    rows = dealt(dealt(obs, tasks, "patient_id", "study", "obs").join(pairs, ["patient_id", "study", "obs"], "left"), tasks, "patient_id")
    patient = rows.schema["patient_id"].dataType.simpleString()
    study, number = (rows.schema[c].dataType.simpleString() for c in ("study", "obs"))
    low = lambda x: (x is None, x)

    def fold(table: pa.Table) -> pa.Table:
        times = table.column("ts").cast(pa.timestamp("us")).cast(pa.int64()).to_pylist()
        points = [{**r, "at": LAST if at is None else at, "diameter": 2 * ((r["volume"] or 0.0) / (4 / 3 * math.pi)) ** (1 / 3)} for r, at in zip(table.to_pylist(), times, strict=True)]
        studies: dict[object, list[dict]] = {}
        for p in sorted(points, key=lambda p: (p["at"], low(p["study"]), low(p["obs"]))):
            studies.setdefault(p["study"], []).append(p)
        series: list[list[dict]] = []
        there: list[list[dict]] = []  # each series' non-empty members, in time order
        for s, own in studies.items():
            at, opened, extended = own[0]["at"], [], set()
            refs = [reference(m, at) for m in there]
            for r in own:
                r["at"], best = at, None
                shared = {(o["study_a"], o["obs_a"]): o["overlap"] for o in r["overlaps"] or []}
                if r["volume"]:
                    gaps = [math.dist((ref["cx"], ref["cy"], ref["cz"]), (r["cx"], r["cy"], r["cz"])) for ref in refs]
                    best = choose([(shared.get((ref["study"], ref["obs"]), 0), gap, ref["diameter"]) for ref, gap in zip(refs, gaps, strict=True)])
                if best is not None:
                    for members in (series[best], there[best]):
                        if best in extended:
                            members.pop()
                        members.append(r)
                    extended.add(best)
                    refs[best] = reference(there[best], at)
                elif r["volume"]:
                    opened.append([r])
            for i, m in enumerate(series):
                if i not in extended:
                    m.append({"study": s, "at": at, "obs": None, "volume": 0.0})
            if own[0]["treated"]:
                series += opened
                there += [list(m) for m in opened]
        out = [(i, t, p) for i, m in enumerate(series) for t, p in enumerate(m)]
        kind = table.schema.field
        stamps = pa.array([None if p["at"] == LAST else p["at"] for _, _, p in out], pa.int64()).cast(pa.timestamp("us"))
        column = lambda c: pa.array([p[c] for _, _, p in out], kind(c).type)
        whose = pa.array([points[0]["patient_id"]] * len(out), kind("patient_id").type)
        numbers = (pa.array([x[j] for x in out], pa.int32()) for j in (0, 1))
        empty = pa.array([p["obs"] is None for _, _, p in out], pa.bool_())
        return pa.Table.from_arrays([whose, *numbers, column("study"), stamps, column("obs"), pa.array([p["volume"] for _, _, p in out], pa.float64()), empty], names=["patient_id", "lesion_id", "t", "study", "ts", "obs", "volume", "is_empty"])

    return rows.groupBy("patient_id").applyInArrow(fold, f"patient_id {patient}, lesion_id int, t int, study {study}, ts timestamp_ntz, obs {number}, volume double, is_empty boolean")


def match_report(matches: DataFrame, tracked: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a patient of tracked (patient_id, lesion, is_empty: at its first study) or labels (patient_id, label), from the best
    matches (patient_id, lesion, label) of tracked lesions:

    labels_in_gt (labels of the truth), parsed_mets and t0_nonzero_parsed_mets (tracked lesions, and those with a mask at first),
    matched_mets (label: its first lesion), unmatched_parsed_mets, unmatched_gt_mets, ambiguous_parsed_matches (label: its lesions, where it
    has more than one), and t0_zero_mets: the lesions of a patient with an empty truth, which count as neither matched nor unmatched."""
    known = tracked.select("patient_id", "lesion", F.coalesce("is_empty", F.lit(False)).alias("is_empty")).distinct()
    truth = labels.select("patient_id", "label").distinct()
    found = matches.select("patient_id", "lesion", "label").distinct().join(truth, ["patient_id", "label"], "left_semi")
    own = found.groupBy("patient_id", "label").agg(F.sort_array(F.collect_list("lesion")).alias("lesions"))
    by_label = truth.join(own, ["patient_id", "label"], "left").groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("labels_in_gt"),
        F.sort_array(F.collect_list(F.when(F.col("lesions").isNotNull(), F.struct("label", F.get("lesions", F.lit(0)).alias("lesion"))))).alias("_matched"),
        F.sort_array(F.collect_list(F.when(F.size("lesions") > 1, F.struct("label", "lesions")))).alias("_ambiguous"),
        F.sort_array(F.collect_list(F.when(F.col("lesions").isNull(), F.col("label")))).alias("unmatched_gt_mets"),
    )
    has = found.select("patient_id", "lesion", F.lit(True).alias("_has")).distinct()
    by_lesion = known.join(has, ["patient_id", "lesion"], "left").groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("parsed_mets"), F.count(F.when(~F.col("is_empty"), 1)).alias("t0_nonzero_parsed_mets"), F.sort_array(F.collect_list(F.when(F.col("_has").isNull(), F.col("lesion")))).alias("_lost")
    )
    both = by_lesion.join(by_label, "patient_id", "full")
    empty = F.col("labels_in_gt").isNull()
    none = lambda df, c: F.array().cast(df.schema[c].dataType)
    lost = F.coalesce("_lost", none(by_lesion, "_lost"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    maps = [F.map_from_entries(F.coalesce(c, none(by_label, c))).alias(n) for c, n in (("_matched", "matched_mets"), ("_ambiguous", "ambiguous_parsed_matches"))]
    unlabelled = F.coalesce("unmatched_gt_mets", none(by_label, "unmatched_gt_mets")).alias("unmatched_gt_mets")
    nothing = none(by_lesion, "_lost")
    return both.select("patient_id", zero("labels_in_gt"), zero("parsed_mets"), zero("t0_nonzero_parsed_mets"), maps[0], F.when(empty, nothing).otherwise(lost).alias("unmatched_parsed_mets"), unlabelled, maps[1], F.when(empty, lost).otherwise(nothing).alias("t0_zero_mets"))


def match_totals(report: DataFrame) -> DataFrame:
    """One row: patients, labels and lesions of a match report, matched pairs, those without a partner on either side, lesions without a
    truth, labels with several lesions, and how the numbers of labels and of lesions with a mask differ."""
    n = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("long")
    gap = F.col("labels_in_gt") - F.col("t0_nonzero_parsed_mets")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sizes = {"matched": "matched_mets", "unmatched_gt": "unmatched_gt_mets", "unmatched_parsed": "unmatched_parsed_mets", "t0_zero": "t0_zero_mets", "ambiguous": "ambiguous_parsed_matches"}
    return report.agg(
        F.count(F.lit(1)).alias("patients"), total("labels_in_gt").alias("labels"), total("t0_nonzero_parsed_mets").alias("parsed"), *[n(c).alias(k) for k, c in sizes.items()],
        total(F.when(gap < 0, -gap)).alias("surplus"), F.count(F.when(gap == 0, 1)).alias("equal"), total(F.when(gap > 0, gap)).alias("missed"),
    )


#: Voxels of the grid of a distance transform: a task holds a few arrays of this size, of two bytes a voxel.
MOST_GRID = 1 << 27


def along(d: np.ndarray, axis: int) -> np.ndarray:
    """One pass of the chessboard distance: at each place the least, over all places of its line, of the larger of d there and the steps
    to it. The minimum over a window that grows by a step on both sides meets the number of steps."""
    d = np.moveaxis(d, axis, 0)
    out, low, r = d.copy(), d.copy(), 0
    while r < out.max(initial=0):
        r += 1
        wide = low.copy()
        np.minimum(wide[1:], low[:-1], out=wide[1:])
        np.minimum(wide[:-1], low[1:], out=wide[:-1])
        low = wide
        np.minimum(out, np.maximum(low, r), out=out)
        if r >= len(d):
            break
    return np.moveaxis(out, 0, axis)


def distance_transform(atlas: DataFrame, box: list[tuple[int, int]]) -> DataFrame:
    """(label, y, z, d): for each label of atlas (x, y, z, label) and each line of the box (lowest and highest x, y and z), the
    chessboard distances to the label from the lowest x on. A task makes one label's grid by a pass each over x, y and z."""
    low, shape = [b[0] for b in box], [b[1] - b[0] + 1 for b in box]
    if np.prod([float(n) for n in shape]) > MOST_GRID:
        raise ValueError(f"the places lie in a grid of {shape}, more than {MOST_GRID} voxels")
    label = atlas.schema["label"].dataType.simpleString()
    far = max(shape)

    def transform(group: pa.Table) -> pa.Table:
        d = np.full(shape, far, np.int16 if far < 1 << 15 else np.int32)
        d[tuple(group.column(c).to_numpy().astype(np.int64) - o for c, o in zip("xyz", low, strict=True))] = 0
        for axis in range(3):
            d = along(d, axis)
        lines = d.transpose(1, 2, 0).reshape(-1, shape[0])
        y, z = np.divmod(np.arange(len(lines)), shape[2])
        ends = pa.array(np.arange(len(lines) + 1, dtype=np.int32) * shape[0])
        values = pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(lines).ravel().astype(np.int32)))
        of = pa.array([group.column("label")[0].as_py()] * len(lines), group.schema.field("label").type)
        return pa.table({"label": of, "y": pa.array(y + low[1], pa.int32()), "z": pa.array(z + low[2], pa.int32()), "d": values})

    return atlas.select("label", "x", "y", "z").groupBy("label").applyInArrow(transform, f"label {label}, y int, z int, d array<int>")


def locate_region(voxels: DataFrame, atlas: DataFrame, key: list[str], targets: list[int] | None = None) -> DataFrame:
    """The target region with most of a lesion's voxels (ties to the smaller label); a lesion without any takes the region
    with the smallest mean distance, where the distance of a voxel is its Chebyshev distance to the region.

    Distances come from one transform of the atlas, made once a label over the grid of the atlas and of the lesions without
    overlap, and are looked up by line; lesions are never held against region voxels."""
    aim = atlas.where(F.col("label").isin(targets)) if targets else atlas.where(F.col("label") > 0)
    w = Window.partitionBy(*key).orderBy(F.desc("n"), "label")
    hit = voxels.join(aim, ["x", "y", "z"]).groupBy(*key, "label").agg(F.count(F.lit(1)).alias("n")).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    hit = hit.select(*key, F.col("label").alias("region"), F.lit(True).alias("overlaps"))
    rest = stored(voxels.select(*key, "x", "y", "z").join(hit, key, "left_anti"))
    ends = aim.select("x", "y", "z").unionByName(rest.select("x", "y", "z")).agg(*[f(c) for c in "xyz" for f in (F.min, F.max)]).first()
    if ends[0] is None or rest.isEmpty():
        return hit
    box = [(ends[i], ends[i + 1]) for i in (0, 2, 4)]
    lines = distance_transform(aim, box).join(rest.select("y", "z").distinct(), ["y", "z"], "left_semi")
    far = rest.join(lines, ["y", "z"]).withColumn("_d", F.get("d", F.col("x") - box[0][0]))
    near = far.groupBy(*key, "label").agg(F.avg("_d").alias("d"))
    w = Window.partitionBy(*key).orderBy("d", "label")
    near = near.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*key, F.col("label").alias("region"), F.lit(False).alias("overlaps"))
    return hit.unionByName(near)


#: Labels that are split by hemisphere.
SPLIT_LABELS = [3, 800, 850, 900]


def split_hemispheres(atlas: DataFrame, hemispheres: DataFrame) -> DataFrame:
    """Atlas voxels whose split labels keep their number on odd hemisphere codes and take the next one else."""
    both = atlas.join(hemispheres, ["x", "y", "z"], "left")
    moved = F.col("label").isin(SPLIT_LABELS) & (F.coalesce(F.col("hemisphere"), F.lit(0)) % 2 == 0)
    return both.withColumn("label", F.when(moved, F.col("label") + 1).otherwise(F.col("label")))


def split_names(names: DataFrame) -> DataFrame:
    """(label, name) with the right and left names of the split labels."""
    some = F.col("label").isin(SPLIT_LABELS)
    right = names.where(some).select("label", F.concat(F.lit("R. "), "name").alias("name"))
    left = names.where(some).select((F.col("label") + 1).alias("label"), F.concat(F.lit("L. "), "name").alias("name"))
    return names.where(~some).select("label", "name").unionByName(right).unionByName(left)
