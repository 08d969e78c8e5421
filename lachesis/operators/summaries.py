"""Summaries of patients, lesions and features. All are aggregations that combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import days_between
from .ranks import attach, quantiles


def patient_metadata(series: DataFrame, patient: str = "patient_id", ts: str = "ts", lesion: str = "lesion_id") -> DataFrame:
    """Per patient: first and last study, whole days between them, distinct studies and lesions, and days a study."""
    g = series.groupBy(patient).agg(F.min(ts).alias("first_study"), F.max(ts).alias("last_study"), F.countDistinct(ts).alias("studies"), F.countDistinct(lesion).alias("lesions"))
    days = days_between("last_study", "first_study")
    return g.withColumns({"observation_days": days, "average_interval": days / F.col("studies")})


def first_known_attributes(df: DataFrame, key: str, order: list[str], attributes: list[str]) -> DataFrame:
    """Per key, the first value that is known of each attribute, in the order of the columns."""
    o = F.struct(*order)
    return df.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), o)).alias(c) for c in attributes])


def onset_offset(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Per key, the value of its first row (onset) and of its last one (offset_)."""
    o = F.struct(*order)
    return df.groupBy(key).agg(F.min_by(value, o).alias("onset"), F.max_by(value, o).alias("offset_"))


def lesions_per_patient_hist(df: DataFrame, counted: Column, highest: Column, patient: str = "patient_id") -> DataFrame:
    """(lesions, patients): patients by how many of their rows meet `counted`, for every number from 0 to the most rows of a
    patient that meet `highest`."""
    n = df.groupBy(patient).agg(F.count(F.when(counted, 1)).alias("n"), F.count(F.when(highest, 1)).alias("top"))
    every = n.agg(F.max("top").alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"))).alias("lesions"))
    some = n.groupBy(F.col("n").alias("lesions")).agg(F.count(F.lit(1)).alias("p"))
    return every.join(some, "lesions", "left").select("lesions", F.coalesce("p", F.lit(0)).cast("long").alias("patients"))


def count_disparity(df: DataFrame, key: str, first: Column, second: Column) -> DataFrame:
    """One row: over the keys, the sum of negative differences of rows that meet `first` and `second`, keys without a difference,
    and the sum of positive differences."""
    n = df.where(first | second).groupBy(key).agg((F.count(F.when(first, 1)) - F.count(F.when(second, 1))).alias("gap"))
    gap = F.col("gap")
    return n.agg(F.sum(F.when(gap < 0, gap).otherwise(0)).alias("negative"), F.count(F.when(gap == 0, 1)).alias("equal"), F.sum(F.when(gap > 0, gap).otherwise(0)).alias("positive"))


def demographics(df: DataFrame, by: list[str], value: str, patient: str) -> DataFrame:
    """Per group: distinct patients, and mean, exact median and sample deviation of the value."""
    g = df.groupBy(*by).agg(F.countDistinct(patient).alias("patients"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return attach(g, quantiles(df, by, value, [0.5]), by, "left").select(*by, "patients", "mean", F.get("q", F.lit(0)).alias("median"), "std")


def describe_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row a column: how many values, mean, sample deviation, least, exact quartiles, largest."""
    long = df.select(*columns).unpivot([], columns, "feature", "v")
    g = long.groupBy("feature").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("low"), F.max("v").alias("high"))
    return attach(g, quantiles(long, ["feature"], "v", [0.25, 0.5, 0.75]), ["feature"], "left").select("feature", "n", "mean", "std", "low", *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("q25", "q50", "q75"))], "high")


def distinct_patients(df: DataFrame, patient: str = "patient_id") -> DataFrame:
    return df.select(patient).distinct()


def lookup_mapping(df: DataFrame, mapping: DataFrame, on: str, key: str, values: list[str]) -> DataFrame:
    """df with the values that the mapping (one row a key) has for its column `on`; rows that the mapping lacks go."""
    side = mapping.select(F.col(key).alias("_key"), *values)
    return df.join(side, df[on] == side["_key"]).drop("_key")


def key_mismatches(series: DataFrame, studies: DataFrame, key: str = "patient_id") -> DataFrame:
    """Keys that only one of the two tables has: (key, missing_series, missing_studies)."""
    a, b = series.select(key).distinct().withColumn("_a", F.lit(True)), studies.select(key).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, key, "full_outer")
    return both.where("_a is null or _b is null").select(key, F.col("_a").isNull().alias("missing_series"), F.col("_b").isNull().alias("missing_studies"))


def cluster_members(df: DataFrame, cluster: str, keys: list[str], value: str) -> DataFrame:
    """A row a member: its cluster, the mean and population deviation of the cluster's values, and the member's id."""
    stats = df.groupBy(cluster).agg(F.avg(value).alias("init_mean"), F.stddev_pop(value).alias("init_std"))
    return df.select(cluster, F.concat_ws(":", *[F.col(k).cast("string") for k in keys]).alias("member")).join(stats, cluster)
