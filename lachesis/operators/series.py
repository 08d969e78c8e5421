"""Operators on series: rows of (patient_id, lesion_id, ts, volume, ...) in the order of ts, then of a tie-break.

All windows share one partitioning, so a chain of these operators costs one exchange on (patient_id, lesion_id). Series
are narrow and short; a window keeps one series at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import days_between, interpolate_linear, response

KEYS = ["patient_id", "lesion_id"]


def ordered(keys: list[str] = KEYS, by: str = "t"):
    return Window.partitionBy(*keys).orderBy(by)


def whole(keys: list[str] = KEYS):
    return Window.partitionBy(*keys)


def so_far(keys: list[str] = KEYS, by: str = "t"):
    return ordered(keys, by).rowsBetween(Window.unboundedPreceding, 0)


def index_timepoints(df: DataFrame, tie: str | None = None, keys: list[str] = KEYS) -> DataFrame:
    """Adds t = 0, 1, ... and the days since the first timepoint."""
    w = Window.partitionBy(*keys).orderBy("ts", *([tie] if tie else []))
    df = df.withColumn("t", (F.row_number().over(w) - 1).cast("int"))
    return df.withColumn("timedelta_days", days_between(F.col("ts"), F.first("ts").over(w)))


def response_class(df: DataFrame, mode: str = "3d", volume: str = "volume", out: str = "rano", keys: list[str] = KEYS, by: str = "t") -> DataFrame:
    """Adds the response class; null at the first timepoint."""
    first = F.first(volume).over(ordered(keys, by))
    nadir = F.min(volume).over(so_far(keys, by))
    return df.withColumn(out, F.when(F.row_number().over(ordered(keys, by)) > 1, response(F.col(volume), first, nadir, mode)))


def drop_short_series(df: DataFrame, min_days: int = 360, keys: list[str] = KEYS) -> DataFrame:
    """Series that span at least min_days. A window flag keeps the partitioning that later windows use."""
    span = days_between(F.max("ts").over(whole(keys)), F.min("ts").over(whole(keys)))
    return df.withColumn("_span", span).where(F.col("_span") >= min_days).drop("_span")


def discard_gaps(df: DataFrame, max_gap: int = 120, max_period: int = 360, keys: list[str] = KEYS) -> DataFrame:
    """Series without a step of more than max_gap days, among the steps that start within max_period days of t0."""
    before = F.lag("ts").over(ordered(keys))
    elapsed = days_between(before, F.first("ts").over(ordered(keys)))
    wide = before.isNotNull() & ((F.col("t") == 1) | (elapsed <= max_period)) & (days_between(F.col("ts"), before) > max_gap)
    df = df.withColumn("_wide", F.coalesce(wide, F.lit(False)))
    return df.withColumn("_any", F.bool_or("_wide").over(whole(keys))).where(~F.col("_any")).drop("_wide", "_any")


def volumes_until(df: DataFrame, cutoff: int, keys: list[str] = KEYS) -> DataFrame:
    """Ordered volumes of the points before the cutoff day; the first is always there."""
    rows = df.where((F.col("t") == 0) | (F.col("timedelta_days") < cutoff))
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "volume"))), lambda x: x["volume"]).alias("volumes"))


def validate_series(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Rows that lie before their predecessor in the order of t."""
    return df.withColumn("previous_ts", F.lag("ts").over(ordered(keys))).where(F.col("previous_ts") > F.col("ts"))


def runs(df: DataFrame, state: Column, keys: list[str] = KEYS, out: str = "run", by: str = "t") -> DataFrame:
    """Numbers the runs of equal states from 1."""
    w = ordered(keys, by)
    df = df.withColumn("_state", state)
    change = F.when(F.lag("_state").over(w).eqNullSafe(F.col("_state")) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_change", change).withColumn(out, F.sum("_change").over(so_far(keys, by)).cast("int")).drop("_change", "_state")


def tag_swings(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Adds is_swing: true for zeros that are followed by a later non-zero run. Series that start at zero and change
    are not allowed; `starts_empty` marks them."""
    df = runs(df, F.col("volume") == 0, keys, "_run")
    last = F.max("_run").over(whole(keys))
    starts = (F.first("volume").over(ordered(keys)) == 0) & (last > 1)
    return df.withColumns({"is_swing": (F.col("volume") == 0) & (F.col("_run") < last), "starts_empty": starts}).drop("_run")


def discard_swings(df: DataFrame, cutoff: int = 420, keys: list[str] = KEYS) -> DataFrame:
    """Of tagged series, those without two neighbouring swing points before the cutoff day."""
    double = F.col("is_swing") & F.coalesce(F.lag("is_swing").over(ordered(keys)), F.lit(False)) & (F.col("timedelta_days") < cutoff)
    df = df.withColumn("_double", double)
    return df.withColumn("_any", F.bool_or("_double").over(whole(keys))).where(~F.col("_any")).drop("_double", "_any")


def repair_swings(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Replaces each swing volume of tagged series by the line between its neighbours. A run of swings is filled from
    left to right, each point from the one just filled and the unfilled next one. Inside a run the next is zero, so a
    point keeps the share d2 / (d2 - d1) of the one before, and the product of the shares along the run gives it from the
    run's left neighbour; the run's end adds its part of the right neighbour. Where both neighbours lie on the
    point's own day the share is 1."""
    w = ordered(keys)
    df = runs(df, F.col("is_swing"), keys, "_run")
    d1, d2 = days_between(F.lag("ts").over(w), F.col("ts")), days_between(F.lead("ts").over(w), F.col("ts"))
    df = df.withColumns({"_share": F.coalesce(d2 / F.nullif(d2 - d1, F.lit(0)), F.lit(1.0)), "_left": F.lag("volume").over(w), "_next": F.lead("volume").over(w)})
    run = Window.partitionBy(*keys, "_run").orderBy("t")
    kept = F.first("_left").over(run) * F.product("_share").over(run.rowsBetween(Window.unboundedPreceding, 0))
    filled = F.greatest(F.lit(0.0), kept + F.col("_next") * (1 - F.col("_share")))
    return df.withColumn("volume", F.when(F.col("is_swing") & (F.col("t") > 0), filled).otherwise(F.col("volume"))).drop("_run", "_share", "_left", "_next")


def repair_swing_features(df: DataFrame, features: list[str], keys: list[str] = KEYS) -> DataFrame:
    """Replaces feature values at swing points by the line between their neighbours; a neighbour after that is no number
    counts as 0. First and last points stay."""
    w = ordered(keys)
    d1, d2 = days_between(F.lag("ts").over(w), F.col("ts")), days_between(F.lead("ts").over(w), F.col("ts"))
    new = {}
    for c in features:
        line = interpolate_linear(d1, F.lag(c).over(w).try_cast("double"), d2, F.coalesce(F.lead(c).over(w).try_cast("double"), F.lit(0.0)))
        new[c] = F.when(F.col("is_swing") & d1.isNotNull() & d2.isNotNull(), line).otherwise(F.col(c).try_cast("double"))
    return df.withColumns(new)


def tag_spikes(df: DataFrame, factor: float, keys: list[str] = KEYS, out: str = "is_spike") -> DataFrame:
    """Adds whether a point rises by more than the factor and falls back by it, or the mirror image."""
    w = ordered(keys)
    low = lambda c: F.greatest(c, F.lit(1e-6))
    prev, cur, post = low(F.lag("volume").over(w)), low(F.col("volume")), low(F.lead("volume").over(w))
    inner = F.lag("volume").over(w).isNotNull() & F.lead("volume").over(w).isNotNull()
    up = (cur / prev > factor) & (post / cur < 1 / factor)
    down = (cur / prev < 1 / factor) & (post / cur > factor)
    return df.withColumn(out, inner & (up | down))


def reject_spikes(df: DataFrame, factor: float, keys: list[str] = KEYS) -> DataFrame:
    """Series without a spike."""
    df = tag_spikes(df, factor, keys, "_spike")
    return df.withColumn("_any", F.bool_or("_spike").over(whole(keys))).where(~F.col("_any")).drop("_spike", "_any")


def tag_cr_runs(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """For classed series: from t1 on, the length of each run of CR and of other classes, and whether it is the last run."""
    later = df.where(F.col("t") > 0)
    later = runs(later, F.coalesce(F.col("rano") == "CR", F.lit(False)), keys, "_run")
    length = F.count(F.lit(1)).over(Window.partitionBy(*keys, "_run"))
    inner = (F.col("rano") == "CR") & (F.col("_run") < F.max("_run").over(whole(keys)))
    return later.withColumns({"cr_run": F.when(inner, length).cast("int")}).drop("_run")


def reject_cr_runs(df: DataFrame, drop_length: int, keep_length: int, keys: list[str] = KEYS) -> DataFrame:
    """Drops series with an inner CR run of drop_length or more; adds `interpolate` for runs of keep_length or less."""
    runs_ = tag_cr_runs(df, keys).select(*keys, "t", "cr_run")
    df = df.join(runs_, [*keys, "t"], "left")
    df = df.withColumn("_most", F.coalesce(F.max("cr_run").over(whole(keys)), F.lit(0))).where(F.col("_most") < drop_length)
    return df.withColumn("interpolate", F.coalesce(F.col("cr_run") <= keep_length, F.lit(False))).drop("_most", "cr_run")


def interpolate_cr_runs(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Fills points marked by reject_cr_runs from the line between the nearest unmarked points, and classes them anew
    from the volumes up to there."""
    w = ordered(keys)
    known = F.when(~F.col("interpolate"), F.struct("timedelta_days", "volume"))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    line = before["volume"] + (after["volume"] - before["volume"]) * (F.col("timedelta_days") - before["timedelta_days"]) / (after["timedelta_days"] - before["timedelta_days"])
    df = df.withColumn("volume", F.when(F.col("interpolate") & before.isNotNull() & after.isNotNull(), line).otherwise(F.col("volume")))
    first, nadir = F.first("volume").over(w), F.min("volume").over(so_far(keys))
    return df.withColumn("rano", F.when(F.col("interpolate"), response(F.col("volume"), first, nadir)).otherwise(F.col("rano")))


def reject_samples(df: DataFrame, factor: float | None, drop_length: int, keep_length: int, keys: list[str] = KEYS) -> DataFrame:
    """Rejection and repair of classed series in one step, in this order: series with an inner CR run of drop_length or more go; those
    with one of keep_length or less are marked; of the others, those with a spike in the volumes as they were go (none without a factor);
    the runs of the marked ones are filled by interpolate_cr_runs. A marked series is never dropped for a spike. Adds interpolate."""
    df = df if factor is None else tag_spikes(df, factor, keys, "_spike")
    df = reject_cr_runs(df, drop_length, keep_length, keys)
    if factor is not None:
        lost = F.bool_or("_spike").over(whole(keys)) & ~F.bool_or("interpolate").over(whole(keys))
        df = df.withColumn("_lost", lost).where(~F.col("_lost")).drop("_lost", "_spike")
    return interpolate_cr_runs(df, keys)


def relative_volume(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Adds volume divided by the first one; null where that is 0."""
    first = F.first("volume").over(ordered(keys))
    return df.withColumn("relative_volume", F.col("volume") / F.nullif(first, F.lit(0.0)))


def derivative_sobel(df: DataFrame, values: str = "relative", padding: str = "constant", keys: list[str] = KEYS) -> DataFrame:
    """Rows from t1 on with the value before less the value after; `values` relative takes the first value as 1 and the
    volumes as given, absolute divides by the first; beyond the end lies 0 (constant) or the last value (edge)."""
    w = ordered(keys)
    first = F.first("volume").over(w)
    v = F.when(F.col("t") == 0, F.lit(1.0)).otherwise(F.col("volume")) if values == "relative" else F.col("volume") / F.nullif(first, F.lit(0.0))
    df = df.withColumn("_v", v)
    end = F.lit(0.0) if padding == "constant" else F.col("_v")
    after = F.when(F.row_number().over(w) == F.count(F.lit(1)).over(whole(keys)), end).otherwise(F.lead("_v").over(w))
    return df.withColumn("derivative", F.lag("_v").over(w) - after).where(F.col("t") > 0).drop("_v")


def lesion_load(df: DataFrame, patient: str = "patient_id") -> DataFrame:
    """Adds the number and the summed volume of a patient's lesions of a study, attached to each point of it."""
    w = Window.partitionBy(patient, "ts")
    there = F.col("volume") > 0
    return df.withColumns({"global_lesion_load": F.coalesce(F.sum(F.when(there, F.col("volume"))).over(w), F.lit(0.0)), "global_lesion_count": F.count(F.when(there, 1)).over(w)})


def sort_studies(df: DataFrame, patient: str = "patient_id") -> DataFrame:
    """Adds the place of each study in its patient's order of time."""
    return df.withColumn("study", F.row_number().over(Window.partitionBy(patient).orderBy("ts")).cast("int"))
