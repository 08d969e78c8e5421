"""Transitions, clusters' tables, graphs, splits, metrics and tests."""

from __future__ import annotations

from math import erfc, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import draw
from .ranks import attach, quantiles, running_totals
from .series import KEYS, ordered

CLASSES = ["CR", "PR", "SD", "PD"]


# ---- transitions and profiles

def response_transitions(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Counts of (t, class at t, class at t + 1); the first step comes from no class. Few keys, combined before the shuffle."""
    df = df.withColumns({"to_class": F.lead("rano").over(ordered(keys)), "last": F.lead("t").over(ordered(keys)).isNull()})
    return df.where(~F.col("last") & F.col("to_class").isNotNull()).groupBy("t", F.coalesce("rano", F.lit("N/A")).alias("from_class"), "to_class").agg(F.count(F.lit(1)).alias("n"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    n = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("_all"))
    return n.crossJoin(F.broadcast(total)).select("label", "n", (F.col("n") / F.col("_all")).alias("fraction"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """sample_weight n / n_c, and loss_weight 1 / (n_c + 1e-6) as a share of all classes' sum."""
    n = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("_all"), F.sum(1 / (F.col("n") + 1e-6)).alias("_inverse"))
    return n.crossJoin(F.broadcast(total)).select("label", (F.col("_all") / F.col("n")).alias("sample_weight"), (1 / (F.col("n") + 1e-6) / F.col("_inverse")).alias("loss_weight"))


def majority_label(df: DataFrame, key: str, label: str) -> DataFrame:
    """Each subject's most frequent label; ties go to the smallest. The maximum of (count, -rank) needs no window."""
    n = df.groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias(label))


def cluster_sizes(df: DataFrame, cluster: str, least: int | None = None) -> DataFrame:
    """(cluster, n, least, kept): each cluster's members and whether they are enough; without `least`, the Cochran size of the table's own
    number of rows is needed."""
    n = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    if least is not None:
        return n.withColumn("least", F.lit(least).cast("long")).withColumn("kept", F.col("n") >= F.col("least"))
    # One row.
    need = n.agg(cochran_sample_size(F.sum("n")).alias("least"))
    return n.crossJoin(F.broadcast(need)).withColumn("kept", F.col("n") >= F.col("least"))


def filter_small_clusters(df: DataFrame, cluster: str, least: int | None = None) -> DataFrame:
    """Rows of clusters with at least `least` members, or with the Cochran size of the table's own number of rows. Which clusters went
    is told by removed_clusters."""
    return df.join(cluster_sizes(df, cluster, least).where("kept").select(cluster), cluster, "left_semi")


def removed_clusters(df: DataFrame, cluster: str, least: int | None = None) -> DataFrame:
    """(cluster, n, least) of the clusters that filter_small_clusters takes out."""
    return cluster_sizes(df, cluster, least).where("not kept").select(cluster, "n", "least")


def cochran_sample_size(n: Column, z: float = 1.65, e: float = 0.1, p: float = 0.5) -> Column:
    """Sample size for a population of n; halves are rounded to even."""
    top = n * (z * z * p * (1 - p))
    return F.bround(top / (e * e * (n - 1) + z * z * p * (1 - p))).cast("long")


def cluster_profiles(df: DataFrame, cluster: str = "cluster", keys: list[str] = KEYS) -> DataFrame:
    """Per cluster and timepoint: members, mean, population variance and deviation; the first point is 1 with no spread."""
    first = F.col("t") == 0
    g = df.groupBy(cluster, "t").agg(F.count(F.lit(1)).alias("members"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance"), F.stddev_pop("value").alias("std"))
    return g.select(cluster, "t", "members", F.when(first, 1.0).otherwise(F.col("mean")).alias("mean"), *[F.when(first, 0.0).otherwise(F.col(c)).alias(c) for c in ("variance", "std")])


def cluster_outcomes(df: DataFrame, cluster: str, value: str, label: str) -> DataFrame:
    """Per cluster, numbered by its mean final value: that mean in per cent and the count of each class there."""
    g = df.groupBy(cluster).agg(F.avg(value).alias("_m"), *[F.count(F.when(F.col(label) == c, 1)).alias(f"n_{c}") for c in CLASSES])
    return g.select(cluster, F.row_number().over(Window.orderBy("_m", cluster)).cast("int").alias("rank"), (F.col("_m") * 100).alias("mean_percent"), *[f"n_{c}" for c in CLASSES])


def persistence_probabilities(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """For each class c and t: among series that are in c from t1 to t - 1, how many have each class at t, and the share
    of those; at t1 only c itself counts."""
    later = df.where((F.col("t") > 0) & F.col("rano").isNotNull())
    before = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    later = later.withColumns({"_lo": F.min("rano").over(before), "_hi": F.max("rano").over(before)})
    held = later.where(F.col("_lo").isNull() | (F.col("_lo") == F.col("_hi"))).withColumn("held_class", F.coalesce("_lo", "rano"))
    n = held.groupBy("held_class", "t", F.col("rano").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy("held_class", "t")  # classes times timepoints, after the aggregation
    return n.withColumn("probability", F.col("n") / F.sum("n").over(total))


def recurrence_probabilities(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Runs from any start: after k equal classes the next class, as (held_class, k, class, n, probability). A changed
    value closes its run, and the value after it opens the next."""
    rows = df.where((F.col("t") > 0) & F.col("rano").isNotNull())
    seq = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "rano"))), lambda x: x["rano"]).alias("s"))
    empty = F.struct(F.lit(None).cast("string").alias("ref"), F.lit(0).alias("k"), F.array().cast("array<struct<held_class:string,k:int,class:string>>").alias("out"))

    def step(a, v):
        opens, same = a["k"] == 0, a["ref"] == v
        ref = F.when(opens, v).otherwise(a["ref"])
        event = F.struct(ref.alias("held_class"), (a["k"] + 1).alias("k"), v.alias("class"))
        return F.struct(F.when(opens | same, ref).otherwise(v).alias("ref"), F.when(opens | same, a["k"] + 1).otherwise(0).alias("k"), F.array_append(a["out"], event).alias("out"))

    n = seq.select(F.explode(F.aggregate("s", empty, step)["out"]).alias("e")).groupBy("e.held_class", "e.k", "e.class").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy("held_class", "k")))


# ---- temporal graphs

YEAR = 365.25


def with_placeholder(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges, and (0, 0, 0, 0) for a series that has none."""
    none = nodes.select(*keys).distinct().join(edges, keys, "left_anti")
    return edges.unionByName(none.select(*keys, F.lit(0).alias("src"), F.lit(0).alias("dst"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("attr")))


def temporal_edges_full(nodes: DataFrame, direction: str | None = None, keys: list[str] = KEYS) -> DataFrame:
    """All ordered pairs of a series' timepoints: years between them, signed as attr; future and past keep one sign. A
    self-join on the series, whose points are few."""
    side = lambda s: nodes.select(*keys, F.col("t").alias(s), F.col("timedelta_days").alias(f"_{s}"))
    d = F.col("_dst") - F.col("_src")
    pairs = side("src").join(side("dst"), keys).where(F.col("src") != F.col("dst"))
    if direction:
        pairs = pairs.where(d > 0 if direction == "future" else d < 0)
    return with_placeholder(nodes, pairs.select(*keys, "src", "dst", (F.abs(d) / YEAR).alias("weight"), (d / YEAR).alias("attr")), keys)


def temporal_edges_sparse(nodes: DataFrame, direction: str | None = None, keys: list[str] = KEYS) -> DataFrame:
    """Edges to direct neighbours in time; attr is positive both ways."""
    w = ordered(keys)
    steps = nodes.select(*keys, "t", F.lead("t").over(w).alias("_next"), (F.lead("timedelta_days").over(w) - F.col("timedelta_days")).alias("_d")).where("_next is not null")
    on, back = F.struct(F.col("t").alias("src"), F.col("_next").alias("dst")), F.struct(F.col("_next").alias("src"), F.col("t").alias("dst"))
    ways = {"future": [on], "past": [back], None: [on, back]}[direction]
    edges = steps.select(*keys, F.explode(F.array(*ways)).alias("e"), "_d").select(*keys, "e.src", "e.dst", (F.abs("_d") / YEAR).alias("weight"), (F.col("_d") / YEAR).alias("attr"))
    return with_placeholder(nodes, edges, keys)


def graph_timepoints(df: DataFrame, cutoff: int | None = None, prefix: int | None = None, seed: int | None = None, keys: list[str] = KEYS) -> DataFrame:
    """Nodes of a graph: t below the prefix, or 0 < days <= cutoff with t0; a seed cuts each series to a drawn length."""
    rows = df.where((F.col("t") == 0) | ((F.col("timedelta_days") > 0) & (F.col("timedelta_days") <= cutoff))) if cutoff is not None else df
    if prefix is not None:
        length = F.lit(prefix) if seed is None else draw(seed, *[F.col(k) for k in keys]) % prefix + 1
        rows = rows.where(F.col("t") < length)
    return rows


# ---- splits

def class_rank(df: DataFrame, label: str, key: list[str], seed: int, buckets: int = 256) -> DataFrame:
    """Adds _rank, the place of a row among its class in drawn order, and _size, its class's rows. Two levels: places
    inside (class, range of the draw) and the rows of earlier ranges, so no class is ever sorted by one task."""
    rows = df.withColumn("_d", draw(seed, *[F.col(k) for k in key])).withColumn("_b", F.floor(F.col("_d") / F.lit(float(2**32 / buckets))).cast("int"))
    n = rows.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    # At most classes * buckets rows; adaptive execution broadcasts them if they are small.
    ahead = n.withColumns({"_before": F.coalesce(F.sum("_n").over(Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_size": F.sum("_n").over(Window.partitionBy(label))})
    inside = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_d", *key))
    both = rows.withColumn("_i", inside).join(ahead.drop("_n"), [label, "_b"])
    return both.withColumn("_rank", F.col("_i") + F.col("_before")).drop("_i", "_before", "_b", "_d")


def stratified_split(df: DataFrame, label: str, key: list[str], test_size: float, seed: int = 42) -> DataFrame:
    """Adds is_test, true for exactly round(size * n_c) rows of each class; rows of a null class go."""
    ranked = class_rank(df, label, key, seed)
    return ranked.withColumn("is_test", F.col("_rank") <= F.round(F.col("_size") * F.lit(test_size))).drop("_rank", "_size")


def stratified_kfold(df: DataFrame, label: str, key: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold 0..k-1, in which every class is spread evenly."""
    return class_rank(df, label, key, seed).withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_size")


def fold_standardize(df: DataFrame, columns: list[str], fold: str = "fold") -> DataFrame:
    """(fold, column, mean, std) of the rows outside each fold: sums over all folds less the fold's own, from one scan. A
    deviation of 0 is null. Sums are taken of values less the column's overall mean, which keeps their digits."""
    long = df.select(fold, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("r")).select(fold, "r.*")
    part = long.groupBy(fold, "column").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    # From here on folds times columns rows; parts merge by their means and variances.
    w = Window.partitionBy("column")
    n, total = F.sum("n").over(w) - F.col("n"), F.sum(F.col("n") * F.col("m")).over(w) - F.col("n") * F.col("m")
    square = F.sum(F.col("n") * (F.col("s") + F.col("m") * F.col("m"))).over(w) - F.col("n") * (F.col("s") + F.col("m") * F.col("m"))
    mean = total / n
    return part.select(fold, "column", mean.alias("mean"), F.nullif(F.sqrt(F.greatest(F.lit(0.0), (square - n * mean * mean) / (n - 1))), F.lit(0.0)).alias("std"))


def prefix_sweep(df: DataFrame, last: int, keys: list[str] = KEYS) -> DataFrame:
    """Rows of each input configuration t0..ti, for the targets "1yr" (the last timepoint) and "nxt" (the next one):
    (config, target, inputs). A series row is copied once a configuration that holds it."""
    ends = F.sequence(F.col("t"), F.lit(last - 1))
    rows = df.where(F.col("t") < last).withColumn("_end", F.explode(ends)).withColumn("n_inputs", F.col("_end") + 1).drop("_end")
    rows = rows.withColumn("kind", F.explode(F.array(F.lit("1yr"), F.lit("nxt"))))
    target = F.when(F.col("kind") == "1yr", F.lit(last)).otherwise(F.col("n_inputs"))
    names = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n_inputs") - 1), lambda i: F.concat(F.lit("t"), i.cast("string"))), ",")
    return rows.withColumns({"target_t": target, "config": F.concat(F.col("kind"), F.lit("_["), names, F.lit("]->t"), target.cast("string"))})


# ---- predictions and metrics

def threshold_predictions(df: DataFrame, score: str | None = None, scores: str | None = None) -> DataFrame:
    """prediction and confidence: sigmoid of a raw score against one half, or the largest of several scores."""
    if score:
        p = 1 / (1 + F.exp(-F.col(score)))
        return df.withColumns({"confidence": p, "prediction": (p >= 0.5).cast("int")})
    return df.withColumns({"confidence": F.array_max(scores), "prediction": (F.array_position(F.col(scores), F.array_max(scores)) - 1).cast("int")})


def align_predictions(a: DataFrame, b: DataFrame, keys: list[str], names: DataFrame | None = None) -> DataFrame:
    """Pairs of predictions of two models by key; `names` (config, other) maps b's configurations, others stay."""
    right = b.select(*keys, F.col("prediction").alias("prediction_b"), F.col("confidence").alias("confidence_b"))
    if names is not None:
        right = right.join(F.broadcast(names.select(F.col("other").alias("config"), F.col("config").alias("_c"))), "config", "left").withColumn("config", F.coalesce("_c", "config")).drop("_c")
    return a.select(*keys, "target", F.col("prediction").alias("prediction_a"), F.col("confidence").alias("confidence_a")).join(right, keys)


def confusion_matrix(df: DataFrame, by: list[str], classes: list) -> DataFrame:
    """Counts of predictions for each target, and their shares of the target's rows."""
    g = df.groupBy(*by, "target").agg(*[F.count(F.when(F.col("prediction") == c, 1)).alias(f"p_{c}") for c in classes], F.count(F.lit(1)).alias("support"))
    return g.select(*by, "target", *[f"p_{c}" for c in classes], *[(F.col(f"p_{c}") / F.col("support")).alias(f"share_{c}") for c in classes])


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0)))


def classification_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy, balanced accuracy, and support-weighted F1, precision and recall, from the counts of (target, prediction)."""
    n = df.groupBy(*by, "target", "prediction").agg(F.count(F.lit(1)).alias("n"))
    each = n.select(*by, F.explode(F.array(F.struct(F.col("target").alias("c"), F.lit(1).alias("is_t")), F.struct(F.col("prediction").alias("c"), F.lit(0).alias("is_t")))).alias("e"), "n", (F.col("target") == F.col("prediction")).alias("ok"))
    per = each.groupBy(*by, "e.c").agg(
        F.sum(F.when(F.col("e.is_t") == 1, F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("e.is_t") == 0, F.col("n")).otherwise(0)).alias("named"),
        F.sum(F.when((F.col("e.is_t") == 1) & F.col("ok"), F.col("n")).otherwise(0)).alias("hit"),
    )
    p, r = ratio(F.col("hit"), F.col("named")), ratio(F.col("hit"), F.col("support"))
    per = per.withColumns({"p": p, "r": r}).withColumn("f", ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    there = F.col("support") > 0
    return per.groupBy(*by).agg((F.sum("hit") / F.sum("support")).alias("accuracy"), F.avg(F.when(there, F.col("r"))).alias("balanced_accuracy"), weighted("f").alias("f1"), weighted("p").alias("precision"), weighted("r").alias("recall"))


def classification_report(df: DataFrame, by: list[str], positive: int = 1) -> DataFrame:
    """classification_metrics with the AUC of the confidence for the positive class in the same table."""
    return attach(classification_metrics(df, by), roc_auc(df, by, F.col("target") == positive), by)


def regression_metrics(df: DataFrame, by: list[str], target: str = "target", prediction: str = "prediction", decoded: tuple[str, str] | None = None) -> DataFrame:
    """R2, median and mean absolute error, RMSE, explained variance, and R2 of zeros against the predictions. With `decoded`, the
    names of the decoded target and prediction, the errors are theirs, R2 and explained variance of the encoded values come
    beside them (r2_encoded, explained_variance_encoded), and r2_decoded_zeros holds zeros against decoded predictions."""
    score = lambda a, b: F.when(b > 0, 1 - a / F.nullif(b, F.lit(0.0))).when(a == 0, 1.0).otherwise(0.0)

    def sums(y: Column, p: Column, tag: str) -> list[Column]:
        e = y - p
        return [F.sum(e * e).alias(f"sse{tag}"), (F.var_pop(y) * F.count(y)).alias(f"sst{tag}"), F.var_pop(e).alias(f"ve{tag}"), F.var_pop(y).alias(f"vy{tag}"), F.sum(p * p).alias(f"pp{tag}")]

    y, p = (F.col(c) for c in decoded or (target, prediction))
    df = df.withColumn("_e", F.abs(y - p))
    s = df.groupBy(*by).agg(*sums(y, p, ""), F.avg("_e").alias("mean_ae"), F.avg(F.col("_e") * F.col("_e")).alias("mse"), *(sums(F.col(target), F.col(prediction), "_encoded") if decoded else []))
    s = attach(s, quantiles(df, by, "_e", [0.5]), by, "left").withColumn("median_ae", F.get("q", F.lit(0)))
    zeros = lambda tag: F.when(F.col(f"pp{tag}") == 0, 1.0).otherwise(0.0)
    out = {"r2": score(F.col("sse"), F.col("sst")), "median_ae": F.col("median_ae"), "mean_ae": F.col("mean_ae"), "rmse": F.sqrt("mse"), "explained_variance": score(F.col("ve"), F.col("vy")), "r2_zeros": zeros("_encoded" if decoded else "")}
    if decoded:
        out |= {"r2_encoded": score(F.col("sse_encoded"), F.col("sst_encoded")), "explained_variance_encoded": score(F.col("ve_encoded"), F.col("vy_encoded")), "r2_decoded_zeros": zeros("")}
    return s.select(*by, *[c.alias(k) for k, c in out.items()])


def fold_summary(df: DataFrame, by: list[str], metric: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"))


def fold_table(df: DataFrame, by: list[str], metrics: list[str], folds: list[int], fold: str = "fold") -> DataFrame:
    """A row a group, as model and configuration: each metric's mean and population deviation over the folds, and its value in each fold."""
    each = lambda m: [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"), *[F.max(F.when(F.col(fold) == f, F.col(m))).alias(f"{m}_fold_{f}") for f in folds]]
    return df.groupBy(*by).agg(*[x for m in metrics for x in each(m)])


def metric_pairs(df: DataFrame, by: list[str], side: str, fold: str, metric: str) -> DataFrame:
    """Every two values of `side` by fold: (by, pair, fold, a, b), for wilcoxon_folds."""
    one = lambda x: df.select(*by, fold, F.col(side).alias(f"_{x}"), F.col(metric).alias(x))
    both = one("a").join(one("b"), [*by, fold]).where(F.col("_a") < F.col("_b"))
    return both.select(*by, F.concat_ws(" / ", F.col("_a").cast("string"), F.col("_b").cast("string")).alias("pair"), fold, "a", "b")


def roc_curve(df: DataFrame, by: list[str], positive: Column, score: str = "confidence") -> DataFrame:
    """False and true positive rate at each distinct score, from counts by score and two-level running totals."""
    n = df.groupBy(*by, score).agg(F.count(F.when(positive, 1)).alias("p"), F.count(F.when(~positive, 1)).alias("q"))
    n = running_totals(n, by, score, ["p", "q"])
    rate = lambda c: ratio(F.col(f"all_{c}") - F.col(f"before_{c}"), F.col(f"all_{c}"))
    return n.select(*by, F.col(score).alias("threshold"), rate("q").alias("fpr"), rate("p").alias("tpr"))


def roc_auc(df: DataFrame, by: list[str], positive: Column, score: str = "confidence") -> DataFrame:
    """Rank AUC with half for ties; null where a class is missing. Scores are ranked in two levels."""
    n = df.groupBy(*by, score).agg(F.count(F.when(positive, 1)).alias("p"), F.count(F.when(~positive, 1)).alias("q"))
    n = running_totals(n, by, score, ["q"]).withColumn("_w", F.col("p") * (F.col("before_q") + F.col("q") / 2))
    return n.groupBy(*by).agg((F.sum("_w") / F.nullif(F.sum("p") * F.sum("q"), F.lit(0))).alias("auc"))


def signed_rank_p(n: int, statistic: float) -> float:
    """Two-sided exact p of the signed-rank statistic for n untied differences, by the count of subsets of 1..n."""
    ways = [1]
    for r in range(1, n + 1):
        ways = [(ways[i] if i < len(ways) else 0) + (ways[i - r] if i >= r else 0) for i in range(len(ways) + r)]
    return min(1.0, 2 * sum(ways[: int(statistic) + 1]) / 2**n)


def wilcoxon_folds(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Signed-rank statistic and p of the differences a - b over folds (at most 50 of them), zeros left out. Groups are folds of
    one pair of configurations; p is exact without ties and by the normal approximation, corrected for them, with ties."""
    w = Window.partitionBy(*by).orderBy("_m")
    d = df.withColumn("_d", F.round(F.col(a) - F.col(b), 12)).where("_d <> 0").withColumn("_m", F.abs("_d"))
    d = d.withColumn("_t", F.count(F.lit(1)).over(Window.partitionBy(*by, "_m"))).withColumn("_r", F.rank().over(w) + (F.col("_t") - 1) / 2)
    s = d.groupBy(*by).agg(F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("_d") < 0, F.col("_r")).otherwise(0.0)).alias("down"), F.count(F.lit(1)).alias("n"), F.sum(F.col("_t") * F.col("_t") - 1).alias("ties"))

    def one(n: int, stat: float, ties: int) -> float:
        # ties: the sum of t^3 - t over groups of t equal differences.
        if ties == 0 and n <= 50:
            return signed_rank_p(n, stat)
        z = (stat - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
        return erfc(abs(z) / sqrt(2))

    @F.pandas_udf("double")
    def p_value(n: pd.Series, stat: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([one(*x) for x in zip(n, stat, ties, strict=True)], dtype="float64")

    stat = F.least("up", "down")
    return s.select(*by, stat.alias("statistic"), "n", p_value("n", stat, "ties").alias("p_value"))


def cluster_errors(df: DataFrame, vector: str, cluster: str) -> DataFrame:
    """(cluster, n, sse, size of a vector): squared distances to the centroid, as sums of squares less n times the square
    of the mean, by element."""
    each = df.select(F.col(cluster).alias("cluster"), F.posexplode(vector).alias("j", "v"))
    part = each.groupBy("cluster", "j").agg(F.count(F.lit(1)).alias("n"), (F.var_pop(F.col("v").cast("double")) * F.count(F.lit(1))).alias("sse"))
    return part.groupBy("cluster").agg(F.max("n").alias("n"), F.sum("sse").alias("sse"), F.count(F.lit(1)).alias("d"))


def cluster_bic_aic(df: DataFrame, vector: str, cluster: str) -> DataFrame:
    """One row: AIC and BIC from the sum of squares, and from the likelihood with one shared variance (larger is better)."""
    s = cluster_errors(df, vector, cluster)
    total = s.agg(F.sum("n").alias("n"), F.sum("sse").alias("rss"), F.max("d").alias("d"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("nlogn"))
    n, k, d = F.col("n"), F.col("k"), F.col("d")
    p, var = k * d, F.col("rss") / (n - k + 1e-10)
    like = -n * d / 2 * F.log(2 * 3.141592653589793 * var) - F.col("rss") / (2 * var) + F.col("nlogn") - n * F.log(n.cast("double"))
    free = (k - 1) + k * d + 1
    fit = n * F.log(F.col("rss") / n)
    return total.select((fit + 2 * p).alias("aic"), (fit + p * F.log(n.cast("double"))).alias("bic"), (like - free * 2).alias("aic_likelihood"), (like - free / 2 * F.log(n.cast("double"))).alias("bic_likelihood"))


def davies_bouldin(df: DataFrame, vector: str, cluster: str) -> DataFrame:
    """One row: the mean over clusters of the worst (spread + spread) / distance. Centroids are as many as clusters. Clusters whose
    centroids coincide are not held against each other; one that is left with none doesn't count."""
    each = df.select(F.col(cluster).alias("c"), F.posexplode(vector).alias("j", "v"))
    mean = each.groupBy("c", "j").agg(F.avg(F.col("v").cast("double")).alias("m"))
    centre = mean.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "m"))), lambda x: x["m"]).alias("centre"))
    far = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    spread = df.select(F.col(cluster).alias("c"), F.col(vector).cast("array<double>").alias("v")).join(centre, "c").groupBy("c").agg(F.avg(far(F.col("v"), F.col("centre"))).alias("s"))
    both = centre.join(spread, "c")
    a, b = both.select(F.col("c").alias("ca"), F.col("centre").alias("ma"), F.col("s").alias("sa")), both.select(F.col("c").alias("cb"), F.col("centre").alias("mb"), F.col("s").alias("sb"))
    worst = a.crossJoin(b).where("ca <> cb").groupBy("ca").agg(F.max(F.try_divide(F.col("sa") + F.col("sb"), far(F.col("ma"), F.col("mb")))).alias("w"))
    return worst.agg(F.avg("w").alias("davies_bouldin"))


def qc_sample(df: DataFrame, key: list[str], n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of an MD5 of (seed, key)."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])), *key).limit(n)
