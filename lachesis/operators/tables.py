"""Joining, encoding, scaling and reshaping of feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import to_numeric
from .ranks import quantiles

#: Distinct values beyond which a column is no category.
MAX_CATEGORIES = 10_000


def pending_patients(source: DataFrame, done: DataFrame, key: str = "patient_id") -> DataFrame:
    return source.join(done.select(key).distinct(), key, "left_anti")


def discard_lesions(df: DataFrame, ids: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """df without the listed ids; strict refuses ids that df does not have."""
    if strict and not ids.join(df, key, "left_anti").isEmpty():
        raise ValueError("unknown ids to discard")
    return df.join(ids.select(key).distinct(), key, "left_anti")


def keep_matched(df: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(matched.select(*keys).distinct(), keys, "left_semi")


def tag_matched(df: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    """Adds rt_matched."""
    some = matched.select(*keys).distinct().withColumn("rt_matched", F.lit(True))
    return df.join(some, keys, "left").withColumn("rt_matched", F.coalesce("rt_matched", F.lit(False)))


def select_features(columns: list[str], families: list[str], timepoints: list[int], targets: list[str] = [], patient: list[str] = [], days: bool = False) -> list[str]:
    """Names of t{i}_{family}... columns of the timepoints, days if wanted, targets, ignored* and patient columns, in order."""
    heads = tuple(f"t{t}_{f}" for t in timepoints for f in [*families, *(["timedelta_days"] if days else [])])
    return [c for c in columns if c.startswith(heads) or c in targets or c in patient or c.startswith("ignored")]


def drop_feature_suffixes(columns: list[str], suffixes: list[str], keep_days: bool = True) -> list[str]:
    return [c for c in columns if not c.endswith(tuple(suffixes)) or (keep_days and c.endswith("timedelta_days"))]


def fill_missing(df: DataFrame, value: float, columns: list[str]) -> DataFrame:
    """Nulls and not-a-numbers of the columns as the value."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(float(value))) for c in columns})


def encode_onehot(df: DataFrame, column: str) -> DataFrame:
    """A 0/1 column for each value, all 0 for null; the column itself goes. Values come by one small aggregation."""
    values = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(MAX_CATEGORIES + 1).collect()]
    if len(values) > MAX_CATEGORIES:
        raise ValueError(f"{column} has more than {MAX_CATEGORIES} values")
    new = {f"{column}_{v}": F.when(F.col(column) == v, 1).otherwise(0) for v in sorted(values, key=str)}
    return df.withColumns(new).drop(column)


def encode_ordinal(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Numbers from 1 for the values in their order; empty ones, "0" and null have none. Ranks are made over the
    distinct values and joined back."""
    good = F.col(column).isNotNull() & ~F.col(column).cast("string").isin("", "0")
    values = df.where(good).select(column).distinct()
    if values.limit(MAX_CATEGORIES + 1).count() > MAX_CATEGORIES:
        raise ValueError(f"{column} has more than {MAX_CATEGORIES} values")
    codes = values.select(column, F.dense_rank().over(Window.orderBy(column)).cast("int").alias("_code"))
    return df.join(codes, column, "left").withColumn(out or column, F.col("_code")).drop("_code")


def clean_clinical(df: DataFrame, terms: dict[str, dict[str, str]], age: str | None = None) -> DataFrame:
    """Strips ['...'] wrappers, makes [nan], [] and ['nan'] null, translates the named columns (unknown terms: null), and
    takes the Y off an age."""
    new: dict[str, Column] = {}
    for c, kind in df.dtypes:
        if kind == "string":
            bare = F.regexp_replace(F.trim(F.col(c)), r"^\[\s*'?|'?\s*\]$", "")
            new[c] = F.when(bare.isin("", "nan"), None).otherwise(bare)
            if c in terms:
                new[c] = F.create_map(*[F.lit(x) for kv in terms[c].items() for x in kv])[new[c]]
            if c == age:
                new[c] = F.regexp_replace(new[c], "Y$", "").try_cast("double")
    return df.withColumns(new)


def quantile_subsets(df: DataFrame, column: str) -> DataFrame:
    """Adds subset 1 to 4 by the exact quartiles of the column, each quartile with its upper end."""
    q = quantiles(df, [], column, [0.25, 0.5, 0.75]).withColumnRenamed("q", "_q")
    rank = F.when(F.col(column) <= F.get("_q", F.lit(0)), 1).when(F.col(column) <= F.get("_q", F.lit(1)), 2).when(F.col(column) <= F.get("_q", F.lit(2)), 3).when(F.col(column).isNotNull(), 4)
    return df.join(F.broadcast(q), F.lit(True), "left").withColumn("subset", rank).drop("_q")


def size_histogram(df: DataFrame, size: str, clip: int) -> DataFrame:
    """Objects of each size from 0 to below the clip, zeros included."""
    n = df.where(F.col(size) < clip).groupBy(F.col(size).cast("long").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(clip).withColumnRenamed("id", "size")
    return every.join(n, "size", "left").select("size", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def enrich_clinical(df: DataFrame, clinical: DataFrame, key: str = "patient_id", order: str | None = None) -> DataFrame:
    """df with patient attributes, the first row of each patient; ids are compared without a dash after PAT."""
    plain = lambda c: F.regexp_replace(c.cast("string"), "^PAT-", "PAT")
    w = Window.partitionBy("_k").orderBy(order or key)
    one = clinical.withColumn("_k", plain(F.col(key))).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", key)
    return df.withColumn("_k", plain(F.col(key))).join(one, "_k", "left").drop("_k")


def overlay_columns(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """a with b's columns in place of its own of that name; ids that b lacks have nulls there."""
    names = [c for c in b.columns if c != key]
    kept = a.select(*[c for c in a.columns if c not in names])
    return kept.join(b, key, "left")


def merge_legacy_tables(volumes: DataFrame, responses: DataFrame, key: str, days: list[int]) -> DataFrame:
    """Columns named by day become t{i}_volume and t{i}_rano, aligned on the key, with constant t{i}_timedelta_days."""
    v = volumes.select(key, *[F.col(str(d)).alias(f"t{i}_volume") for i, d in enumerate(days)])
    r = responses.select(key, *[F.col(str(d)).alias(f"t{i}_rano") for i, d in enumerate(days) if str(d) in responses.columns])
    return v.join(r, key, "full_outer").withColumns({f"t{i}_timedelta_days": F.lit(d) for i, d in enumerate(days)})


def wide_features(df: DataFrame, keys: list[str], t: str, timepoints: list[int], features: list[str]) -> DataFrame:
    """One row a series with t{i}_{feature} columns. A series' rows become one array with a place for each timepoint, from which the
    columns are picked; so the aggregates are as many as features, not as columns. Rows of one timepoint give the largest value of each
    feature."""
    # Other timepoints have no place, but a series that has no other row stays.
    place = F.when(F.col(t).isin(timepoints), F.col(t)).alias("_t")
    rows = df.repartition(*keys).groupBy(*keys, place).agg(*[F.max(f).alias(f"_{i}") for i, f in enumerate(features)])
    slots = rows.groupBy(*keys).agg(F.collect_list(F.struct("_t", *[f"_{i}" for i in range(len(features))])).alias("_rows"))
    slot = lambda i: F.get(F.filter("_rows", lambda r: r["_t"] == i), F.lit(0))
    wide = slots.select(*keys, *[slot(i).alias(f"_at{n}") for n, i in enumerate(timepoints)])
    return wide.select(*keys, *[F.col(f"_at{n}")[f"_{j}"].alias(f"t{i}_{f}") for n, i in enumerate(timepoints) for j, f in enumerate(features)])


def wide_to_long(df: DataFrame, key: str, columns: list[str], value: str = "value") -> DataFrame:
    """(key, time, value) from t{i}_... columns."""
    long = df.unpivot(key, columns, "name", value)
    return long.select(F.col(key).alias("subject"), F.regexp_extract("name", r"^t(\d+)_", 1).cast("int").alias("time"), value)


def stack_timepoints(df: DataFrame, key: str, timepoints: list[int], features: list[str], target: str = "rano", shift: bool = False) -> DataFrame:
    """Feature slices of all timepoints but the last under common names, with the class of the same timepoint, or of the
    next one if shifted. One generator, no union of scans."""
    rows = [F.struct(F.lit(i).alias("t"), *[F.col(f"t{i}_{f}").alias(f) for f in features], F.col(f"t{j}_{target}").alias(target)) for i, j in zip(timepoints[:-1], timepoints[1:] if shift else timepoints[:-1], strict=True)]
    return df.select(key, F.explode(F.array(*rows)).alias("_r")).select(key, "_r.*")


def trajectory_array(df: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(t, value))), lambda x: x[value]).alias("trajectory"))


def flatten_vectors(df: DataFrame, vector: str, size: int, name: str) -> DataFrame:
    """Elements of a vector column as {name}_{j} columns."""
    return df.withColumns({f"{name}_{j}": F.get(vector, F.lit(j)) for j in range(size)}).drop(vector)


def standardize_columns(train: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mean, std) of training columns: sample deviation, at least 1e-6. One aggregation over all of them."""
    stats = train.agg(*[x for c in columns for x in (F.avg(to_numeric(F.col(c))).alias(f"m_{c}"), F.stddev_samp(to_numeric(F.col(c))).alias(f"s_{c}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("mean"), F.greatest(F.col(f"s_{c}"), F.lit(1e-6)).alias("std")) for c in columns])
    return stats.select(F.explode(rows).alias("r")).select("r.*")


def apply_standardization(df: DataFrame, stats: DataFrame, columns: list[str], fill: float | None = None) -> DataFrame:
    """df with the columns less their mean, by their deviation; nulls filled after. Statistics have a row a column."""
    row = stats.groupBy().pivot("column", columns).agg(F.first("mean").alias("mean"), F.first("std").alias("std"))
    named = row.select(*[F.col(f"{c}_{k}").alias(f"_{c}_{k}") for c in columns for k in ("mean", "std")])
    z = {c: (to_numeric(F.col(c)) - F.col(f"_{c}_mean")) / F.col(f"_{c}_std") for c in columns}
    if fill is not None:
        z = {c: F.coalesce(v, F.lit(float(fill))) for c, v in z.items()}
    return df.crossJoin(F.broadcast(named)).withColumns(z).drop(*named.columns)


def normalize_volume(train: DataFrame, test: DataFrame, chain: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables with their volumes through the chain (std, max, log, frac, 3root, joined by ->), fitted on train; `decoder`
    holds each row's steps as (op, a, b), for denormalize_volume. Fitted values are one-row tables; without training values
they are null, and so is what they scale."""
    step_type = "struct<op:string,a:double,b:double>"
    out = [df.withColumn("decoder", F.array().cast(f"array<{step_type}>")) for df in (train, test)]
    for op in chain.split("->"):
        if op in ("std", "max"):
            pooled = out[0].select(F.explode(F.array(*columns)).alias("v"))
            fitted = pooled.agg(*([F.stddev_pop("v").alias("_scale"), F.avg("v").alias("_shift")] if op == "std" else [F.max("v").alias("_scale"), F.lit(0.0).alias("_shift")]))
            out = [df.crossJoin(F.broadcast(fitted)) for df in out]  # one row
            scale, shift = [F.col("_scale")] * 2, F.col("_shift")
        elif op == "frac":
            scale, shift = [F.col(columns[0])] * 2, F.lit(0.0)
        elif op in ("log", "3root"):
            scale, shift = [F.lit(1.0)] * 2, F.lit(0.0)
        else:
            raise ValueError(f"unknown step {op}")
        for i in (0, 1):
            coded = out[i].withColumn("decoder", F.array_append("decoder", F.struct(F.lit(op).alias("op"), scale[i].alias("a"), shift.alias("b")).cast(step_type)))
            f = {"log": F.log1p, "3root": lambda c: F.signum(c) * F.cbrt(F.abs(c))}.get(op)
            first = F.get("decoder", F.size("decoder") - 1)
            out[i] = coded.withColumns({c: f(F.col(c)) if f else (F.col(c) - first["b"]) / F.nullif(first["a"], F.lit(0.0)) for c in columns}).drop("_scale", "_shift")
    return out[0], out[1]


def denormalize_volume(value: Column, decoder: Column) -> Column:
    """The volume that normalize_volume made the value from: its steps undone from the last to the first."""

    def undo(v: Column, s: Column) -> Column:
        return F.when(s["op"] == "log", F.expm1(v)).when(s["op"] == "3root", v * v * v).otherwise(v * s["a"] + s["b"])

    return F.aggregate(F.reverse(decoder), value.cast("double"), undo)


def node_features(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    """A vector of the columns, in which what is no number is 0."""
    return df.withColumn(out, F.array(*[F.coalesce(F.nanvl(to_numeric(F.col(c)), F.lit(0.0)), F.lit(0.0)) for c in columns]))


def masked_target_node(df: DataFrame, target_t: int, volume_index: int = 0, out: str = "features") -> DataFrame:
    """Node features in which the target timepoint's own are -1."""
    return df.withColumn(out, F.when(F.col("t") == target_t, F.transform(out, lambda x: F.lit(-1.0))).otherwise(F.col(out)))


def apply_vector_extractor(df: DataFrame, extractor, column: str, out: str = "vector") -> DataFrame:
    """A vector column from a user's pandas UDF that returns array<double>."""
    return df.withColumn(out, extractor(F.col(column)))
