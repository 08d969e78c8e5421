"""As-of joins of series with a grid of dates, and resampling onto it.

A series and its grid are sorted together and never joined, so as-of lookups are linear in both. Grid points are built from
each series' first timestamp by exact microsecond arithmetic, so fractional steps are exact to the microsecond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import DAY_US, days_between, interpolate_linear, response
from .series import KEYS


def time_grid(df: DataFrame, timeframe: float = 360, timepoints: int = 6, keys: list[str] = KEYS) -> DataFrame:
    """For each series, its first timestamp plus i * timeframe / timepoints days, i = 0..timepoints."""
    start = df.groupBy(*keys).agg(F.min("ts").alias("ts0"))
    step = F.lit(timeframe * DAY_US / timepoints)
    grid = start.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(timepoints))))
    return grid.withColumn("target_ts", F.timestamp_add("MICROSECOND", F.round(F.col("i") * step).cast("long"), F.col("ts0"))).drop("ts0")


def long_enough(df: DataFrame, timeframe: float, timepoints: int, keys: list[str] = KEYS) -> DataFrame:
    """Series whose span reaches all but half a step of the timeframe."""
    w = Window.partitionBy(*keys)
    df = df.withColumn("_span", days_between(F.max("ts").over(w), F.min("ts").over(w)))
    return df.where(F.col("_span") >= timeframe - 0.5 * timeframe / timepoints).drop("_span")


def neighbours(points: DataFrame, at: str, series: DataFrame, keep: list[str], tie: str, keys: list[str]) -> DataFrame:
    """points with `before`, a struct of ts, tie and the columns `keep` of the series' last row before the instant `at`, and
    `after`, that of its first row at or after it. Points and rows are sorted together, once each way, so the work is in proportion
    to both."""
    instant = points.schema[at].dataType
    row = F.struct("ts", F.col(tie).alias("tie"), *[c for c in keep if c not in ("ts", "tie")])
    p = points.select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_row"), F.struct(*points.columns).alias("_p"))
    s = series.select(*keys, F.col("ts").cast(instant).alias("_at"), F.lit(1).alias("_row"), F.col(tie).alias("_tie"), row.alias("_s"))
    both = p.unionByName(s, allowMissingColumns=True)
    w = Window.partitionBy(*keys)
    seen = lambda *order: F.last("_s", ignorenulls=True).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    # At one instant, points come before rows on the way up (rows before it only) and after them on the way down.
    both = both.withColumns({"before": seen("_at", "_row", "_tie"), "after": seen(F.desc("_at"), F.desc("_row"), F.desc("_tie"))})
    return both.where("_row = 0").select("_p.*", "before", "after")


def asof_nearest(series: DataFrame, grid: DataFrame, keep: list[str], nonzero: bool = False, tie: str = "t", keys: list[str] = KEYS) -> DataFrame:
    """For each grid row, the columns `keep` of the observation with the smallest |days| to it; ties go to the earlier
    one. With nonzero, zero volumes are passed over; a grid row without a match keeps nulls.

    Days are whole: of the observations before a date, the earliest one of the day of the last one counts, which a second look
    finds, at the start of that day."""
    rows = series.where(F.col("volume") != 0) if nonzero else series
    points = grid.select(*keys, "i", "target_ts")
    first = neighbours(points, "target_ts", rows, keep, tie, keys)
    back = days_between(F.col("before.ts"), F.col("target_ts"))
    first = first.withColumns({"_day": F.timestamp_add("MICROSECOND", back.cast("long") * DAY_US, F.col("target_ts")), "_after": F.col("after")}).drop("before", "after")
    both = neighbours(first, "_day", rows, keep, tie, keys)
    before, after = F.when(F.col("_day").isNotNull(), F.col("after")), F.col("_after")
    away = lambda x: F.abs(days_between(x["ts"], F.col("target_ts")))
    best = F.when(before.isNull() | (away(after) < away(before)), after).otherwise(before)
    return both.withColumn("_best", best).select(*keys, "i", "target_ts", *[F.col("_best.tie" if c == "tie" else f"_best.{c}").alias(c) for c in keep])


def asof_bilateral(series: DataFrame, grid: DataFrame, tie: str = "t", keys: list[str] = KEYS) -> DataFrame:
    """For each grid row of a series, days and volumes (d1, v1, d2, v2) of the last observation before it and of the first at or
    after it; where none is after it, of the last two observations."""
    w = Window.partitionBy(*keys).orderBy("ts", tie)
    rows = series.select(*keys, "ts", tie, "volume", F.lag(F.struct("ts", "volume")).over(w).alias("earlier"))
    both = neighbours(grid.select(*keys, "i", "target_ts"), "target_ts", rows, ["volume", "earlier"], tie, keys)
    both = both.where("before is not null or after is not null")
    two = F.col("after").isNull() & F.col("before.earlier").isNotNull()
    d = lambda ts: days_between(ts, F.col("target_ts"))
    pick = lambda a, b: F.when(two, b).otherwise(a)
    return both.select(
        *keys, "i", "target_ts",
        pick(d(F.col("before.ts")), d(F.col("before.earlier.ts"))).alias("d1"), pick(F.col("before.volume"), F.col("before.earlier.volume")).alias("v1"),
        pick(d(F.col("after.ts")), d(F.col("before.ts"))).alias("d2"), pick(F.col("after.volume"), F.col("before.volume")).alias("v2"),
    )


def resample_nearest(series: DataFrame, timeframe: float = 360, timepoints: int = 6, keep: list[str] | None = None, tie: str = "t", keys: list[str] = KEYS) -> DataFrame:
    """Long-enough series on the grid: the first point as it is, each other one from the nearest observation."""
    rows = long_enough(series, timeframe, timepoints, keys)
    return asof_nearest(rows, time_grid(rows, timeframe, timepoints, keys), keep or ["volume"], tie=tie, keys=keys)


def resample_linear(series: DataFrame, timeframe: float = 360, timepoints: int = 6, tie: str = "t", keys: list[str] = KEYS) -> DataFrame:
    """Long-enough series on the grid, on the line between the neighbours; the first point keeps the first volume."""
    rows = long_enough(series, timeframe, timepoints, keys)
    both = asof_bilateral(rows, time_grid(rows, timeframe, timepoints, keys), tie, keys)
    line = interpolate_linear(F.col("d1"), F.col("v1"), F.col("d2"), F.col("v2"))
    return both.select(*keys, "i", "target_ts", F.when((F.col("d2") == 0) | (F.col("i") == 0), F.col("v2")).otherwise(line).alias("volume"))


def not_a_knot(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic interpolating splines through many series of the same number of points, at least four (rows of x and y, or one series alone), at
    the places `at`; the third derivative does not jump at the second and the last but one point.

    The end conditions give the first and the last second derivative from their neighbours, which leaves three bands: one
    elimination from left to right and back, for all series at once."""
    if x.ndim == 1:
        return not_a_knot(x[None], y[None], at)[0]
    h = np.diff(x, axis=1)
    d = np.diff(y, axis=1) / h
    low, mid, high, r = h[:, :-1].copy(), 2 * (h[:, :-1] + h[:, 1:]), h[:, 1:].copy(), 6 * np.diff(d, axis=1)
    a, b, y0, y1 = h[:, 0], h[:, 1], h[:, -1], h[:, -2]
    mid[:, 0] += a * (a + b) / b
    high[:, 0] -= a * a / b
    mid[:, -1] += y0 * (y0 + y1) / y1
    low[:, -1] -= y0 * y0 / y1
    n = mid.shape[1]
    for i in range(1, n):
        w = low[:, i] / mid[:, i - 1]
        mid[:, i] -= w * high[:, i - 1]
        r[:, i] -= w * r[:, i - 1]
    s = np.empty_like(x)
    s[:, n] = r[:, n - 1] / mid[:, n - 1]
    for i in range(n - 1, 0, -1):
        s[:, i] = (r[:, i - 1] - high[:, i - 1] * s[:, i + 1]) / mid[:, i - 1]
    s[:, 0] = ((a + b) * s[:, 1] - a * s[:, 2]) / b
    s[:, -1] = ((y0 + y1) * s[:, -2] - y0 * s[:, -3]) / y1
    k = np.clip(np.stack([np.searchsorted(row, at, "right") for row in x]) - 1, 0, x.shape[1] - 2)
    of = lambda v: np.take_along_axis(v, k, axis=1)
    after = lambda v: np.take_along_axis(v, k + 1, axis=1)
    t, u, w = at - of(x), after(x) - at, of(h)
    return (of(s) * u**3 + after(s) * t**3) / (6 * w) + (of(y) / w - of(s) * w / 6) * u + (after(y) / w - after(s) * w / 6) * t


def resample_bspline(series: DataFrame, timeframe: float = 360, timepoints: int = 6, keys: list[str] = KEYS) -> DataFrame:
    """Long-enough series of four different days or more on the grid, by the interpolating cubic spline, not below 0.
    Several points of one day count as their mean. Points meet in arrays by Spark; a batch of series is solved at once, in a time that grows
    with its points."""
    rows = long_enough(series, timeframe, timepoints, keys).select(*keys, F.col("timedelta_days").cast("double").alias("day"), "volume")
    days = rows.groupBy(*keys, "day").agg(F.avg("volume").alias("volume"))
    # A series' points are one row from here on.
    points = days.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("day", "volume"))).alias("p")).where(F.size("p") >= 4)
    points = points.select(*keys, F.transform("p", lambda p: p["day"]).alias("x"), F.transform("p", lambda p: p["volume"]).alias("y"))
    at = np.arange(timepoints + 1) * timeframe / timepoints
    schema = T.StructType([*(points.schema[k] for k in keys), T.StructField("v", T.ArrayType(T.DoubleType()))])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pc.list_value_length(b.column("x")).to_numpy()
            for size in np.unique(n):
                own = pa.array(np.flatnonzero(n == size))
                x, y = (b.column(c).take(own).flatten().to_numpy().reshape(-1, size) for c in ("x", "y"))
                v = np.maximum(not_a_knot(x, y, at), 0.0)
                ends = pa.array(np.arange(len(v) + 1, dtype=np.int32) * len(at))
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(own) for k in keys), pa.ListArray.from_arrays(ends, pa.array(v.ravel()))], names=schema.names)

    return points.mapInArrow(solve, schema).select(*keys, F.posexplode("v").alias("i", "volume"))


def target_at_time(series: DataFrame, target_days: float, keys: list[str] = KEYS) -> DataFrame:
    """Volume and class at a day: an exact match's own, else on the line between the nearest days below and above, not
    below 0, classed with all points before the upper one. Null both where no point lies at or after the day."""
    d = F.col("timedelta_days") - F.lit(target_days)
    value = F.struct("timedelta_days", "volume", "t")
    agg = series.groupBy(*keys).agg(
        F.min_by(F.struct("volume", "rano"), F.when(d == 0, F.col("t"))).alias("exact"), F.max_by(value, F.when(d < 0, F.struct(F.col("timedelta_days"), -F.col("t")))).alias("low"),
        F.min_by(value, F.when(d > 0, F.struct("timedelta_days", "t"))).alias("high"), F.min_by("volume", "t").alias("baseline"),
    )
    both = series.join(agg, keys)
    nadir = F.min(F.when(F.col("t") < F.col("high.t"), F.col("volume"))).alias("nadir")
    out = both.groupBy(*keys, "exact", "low", "high", "baseline").agg(nadir)
    line = interpolate_linear(F.col("low.timedelta_days") - F.lit(target_days), F.col("low.volume"), F.col("high.timedelta_days") - F.lit(target_days), F.col("high.volume"))
    found = F.col("exact").isNotNull()
    volume = F.when(found, F.col("exact.volume")).otherwise(line)
    rano = F.when(found, F.col("exact.rano")).otherwise(response(line, F.col("baseline"), F.least("nadir", line)))
    return out.select(*keys, volume.alias("target_volume"), rano.alias("target_rano"), F.lit(float(target_days)).alias("target_days"))
