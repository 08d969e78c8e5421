"""Running totals and exact quantiles in two levels: ranges of the order first, then inside the ranges.

No group is ever sorted by one task, whatever its share of the rows. Rows are counted by value before, so repeats have shrunk.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import stored

#: Ranges of a group. Their bounds are approximate quantiles, so they hold about equally many rows; results are exact.
RANGES = 64


def attach(df: DataFrame, side: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """df with the columns of `side` for the same values of `by`, nulls included."""
    other = side.withColumnsRenamed({c: f"_of_{c}" for c in by})
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by], F.lit(True))
    return df.join(other, on, how).drop(*[f"_of_{c}" for c in by])


def range_bounds(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by, _bounds): the approximate quantiles of `order` that part a group into RANGES ranges."""
    inner = [F.lit(i / RANGES) for i in range(1, RANGES)]
    bounds = df.groupBy(*by).agg(F.percentile_approx(order, F.array(*inner), F.lit(1000)).alias("_bounds"))
    return bounds if by else F.broadcast(bounds)  # without groups, bounds are one row


def range_of(order: str | Column) -> Column:
    """The range that a value falls into by _bounds; 0 for nulls and where a group has no bounds."""
    value = F.col(order) if isinstance(order, str) else order
    rank = F.coalesce(F.size(F.filter("_bounds", lambda b: b < value)), F.lit(0))
    return F.when(F.col("_bounds").isNull(), 0).otherwise(rank)


def running_totals(n: DataFrame, by: list[str], order: str, totals: list[str]) -> DataFrame:
    """n with before_{c}, the sum of c over the group's rows with a smaller `order` (null is the smallest), and all_{c}, the sum
    over the group, for each c of totals. A group has one row for each value of `order`. The tables joined to n have RANGES rows a
    group at most; adaptive execution broadcasts them if they are small."""
    rows = attach(n, range_bounds(n, by, order), by, "left").select(*n.columns, range_of(order).alias("_range"))
    part = rows.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_{c}") for c in totals])
    w = Window.partitionBy(*by)
    ahead = w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(*by, "_range", *[F.coalesce(F.sum(f"_{c}").over(ahead), F.lit(0)).alias(f"_ahead_{c}") for c in totals], *[F.sum(f"_{c}").over(w).alias(f"all_{c}") for c in totals])
    inside = Window.partitionBy(*by, "_range").orderBy(F.col(order).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_in_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in totals})
    return attach(rows, part, [*by, "_range"]).select(*n.columns, *[(F.col(f"_in_{c}") + F.col(f"_ahead_{c}")).alias(f"before_{c}") for c in totals], *[F.col(f"all_{c}") for c in totals])


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by, q): the exact quantiles of the value at the shares, on the line between the two nearest rows; nulls don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_totals(counts, by, "_v", ["_n"])
    place = lambda q: F.lit(float(q)) * (F.col("all__n") - 1)
    here = lambda p: (F.col("before__n") <= p) & (p < F.col("before__n") + F.col("_n"))
    # The two rows around each place come out of one aggregation that keeps one value each.
    ends = [f(F.when(here(g(place(q))), F.col("_v"))).alias(f"_{k}{i}") for i, q in enumerate(shares) for k, f, g in (("lo", F.max, F.floor), ("hi", F.max, F.ceil))]
    found = ranked.groupBy(*by).agg(*ends, F.max("all__n").alias("all__n"))
    share = lambda q: place(q) - F.floor(place(q))
    line = [F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * share(q) for i, q in enumerate(shares)]
    return found.select(*by, F.array(*line).alias("q"))


def numbered(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds i = 0.. inside each group and its size n. Two levels: places among the rows with one value of the first order column, and
    the rows of its smaller values; or, for a string, places in one of Spark's sampled ranges of (by, order), and the rows of the
    ranges before. The ranged rows are stored, which fixes their ranges."""
    if df.schema[order[0]].dataType.typeName() == "string":
        rows = stored(df.repartitionByRange(*by, *order).withColumn("_k", F.spark_partition_id().cast("long")))
    else:
        rows = df.withColumn("_k", F.col(order[0]))
    counts = rows.groupBy(*by, "_k").agg(F.count(F.lit(1)).alias("_n"))
    ahead = running_totals(counts, by, "_k", ["_n"]).select(*by, "_k", F.col("before__n").alias("_before"), F.col("all__n").alias("n"))
    inside = F.row_number().over(Window.partitionBy(*by, "_k").orderBy(*order)) - 1
    return attach(rows, ahead, [*by, "_k"]).withColumn("i", inside + F.col("_before")).drop("_before", "_k")
