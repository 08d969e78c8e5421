"""Queries on transitions, splits, metrics, tests, clusters and models, with the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster as L
from ..operators import evaluate as E
from ..operators import moments as N
from ..operators import replicates as R
from ..operators import summaries as U
from ..operators import tables as T
from . import adapters as A
from .adapters import DRAW, STEPS, W, ctes

QUERIES, ORACLES = {}, {}
K = ["patient_id", "lesion_id"]
REPLICATES = 1000


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


@query("response_transitions", ctes("grid").rstrip() + f",\nn AS (SELECT t, coalesce(rano, 'N/A') AS from_class, lead(rano) OVER ({W} ORDER BY t) AS to_class FROM grid)\nSELECT t, from_class, to_class, count(*) AS n FROM n WHERE to_class IS NOT NULL GROUP BY ALL")
def _(spark, d):
    """Series on the regular grid, classed, and the flow of classes from each timepoint to the next."""
    return E.response_transitions(A.grid(spark, d))


@query("class_distribution", ctes("grid") + "SELECT rano AS label, count(*) AS n, round(count(*) / (SELECT count(*) FROM grid WHERE t > 0)::DOUBLE, 6) AS fraction FROM grid WHERE t > 0 GROUP BY rano")
def _(spark, d):
    return E.class_distribution(A.grid(spark, d).where("t > 0"), "rano").select("label", "n", *r6("fraction"))


@query("class_weights", "WITH n AS (SELECT quality AS label, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 1) SELECT label, round((SELECT sum(n) FROM n)::DOUBLE / n, 6) AS sample_weight, round(1 / (n + 1e-6) / (SELECT sum(1 / (n + 1e-6)) FROM n), 6) AS loss_weight FROM n")
def _(spark, d):
    return E.class_weights(A.read(spark, d, "labels").where("quality is not null"), "quality").select("label", *r6("sample_weight", "loss_weight"))


@query("majority_label", "SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE r = 1")
def _(spark, d):
    return E.majority_label(A.read(spark, d, "events"), "user_id", "event_type")


@query("filter_small_clusters", "SELECT vec_id AS subject, label AS cluster FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY 1 HAVING count(*) >= 45)")
def _(spark, d):
    return E.filter_small_clusters(A.trajectories(spark, d), "cluster", 45).select("subject", "cluster")


NEEDED = "WITH c AS (SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY 1), s AS (SELECT sum(n) AS n FROM c), k AS (SELECT round_even(n * (1.65 * 1.65 * 0.25)::DOUBLE / ((0.1 * 0.1)::DOUBLE * (n - 1) + (1.65 * 1.65 * 0.25)::DOUBLE), 0)::BIGINT AS least FROM s)\n"


@query("filter_clusters_by_sample_size", NEEDED + "SELECT vec_id AS subject, label AS cluster FROM embeddings JOIN c ON label = cluster, k WHERE n >= least")
def _(spark, d):
    return E.filter_small_clusters(A.trajectories(spark, d), "cluster").select("subject", "cluster")


@query("removed_clusters", NEEDED + "SELECT cluster, n, least FROM c, k WHERE n < least")
def _(spark, d):
    return E.removed_clusters(A.trajectories(spark, d), "cluster")


@query("cochran_sample_size", "SELECT user_id, round_even(n * (1.65 * 1.65 * 0.25)::DOUBLE / ((0.1 * 0.1)::DOUBLE * (n - 1) + (1.65 * 1.65 * 0.25)::DOUBLE), 0)::BIGINT AS size FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def _(spark, d):
    return A.read(spark, d, "events").groupBy("user_id").agg(E.cochran_sample_size(F.count(F.lit(1))).alias("size"))


CLUSTERED = ctes("grid").rstrip() + f",\nc AS (SELECT *, (patient_id % 4)::INTEGER AS cluster, volume / first_value(volume) OVER ({W} ORDER BY t) AS value FROM grid)\n"


def clustered(spark, d):
    from ..operators.series import relative_volume

    return relative_volume(A.grid(spark, d)).withColumns({"cluster": (F.col("patient_id") % 4).cast("int"), "value": F.col("relative_volume")})


@query("cluster_profiles", CLUSTERED + "SELECT cluster, t, count(*) AS members, CASE WHEN t = 0 THEN 1.0 ELSE round(avg(value), 6) END AS mean, CASE WHEN t = 0 THEN 0.0 ELSE round(var_pop(value), 6) END AS variance, CASE WHEN t = 0 THEN 0.0 ELSE round(stddev_pop(value), 6) END AS std FROM c GROUP BY cluster, t")
def _(spark, d):
    return E.cluster_profiles(clustered(spark, d)).select("cluster", "t", "members", *r6("mean", "variance", "std"))


@query("cluster_members", CLUSTERED + "SELECT cluster, round(avg(volume) OVER (PARTITION BY cluster), 6) AS init_mean, round(stddev_pop(volume) OVER (PARTITION BY cluster), 6) AS init_std, member FROM (SELECT *, patient_id || ':' || lesion_id AS member FROM c WHERE t = 0)")
def _(spark, d):
    return U.cluster_members(clustered(spark, d).where("t = 0"), "cluster", K, "volume").select("cluster", *r6("init_mean", "init_std"), "member")


@query("cluster_outcomes", CLUSTERED + "SELECT cluster, row_number() OVER (ORDER BY avg(value), cluster)::INTEGER AS rank, round(avg(value) * 100, 6) AS mean_percent, " + ", ".join(f"count(*) FILTER (rano = '{x}') AS n_{x}" for x in E.CLASSES) + f" FROM c WHERE t = {STEPS} GROUP BY cluster")
def _(spark, d):
    return E.cluster_outcomes(clustered(spark, d).where(F.col("t") == STEPS), "cluster", "value", "rano").select("cluster", "rank", *r6("mean_percent"), *[f"n_{x}" for x in E.CLASSES])


@query("persistence_probabilities", ctes("grid").rstrip() + f""",
h AS (SELECT *, min(rano) OVER b AS lo, max(rano) OVER b AS hi FROM grid WHERE t > 0 AND rano IS NOT NULL WINDOW b AS ({W} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n AS (SELECT coalesce(lo, rano) AS held_class, t, rano AS class, count(*) AS n FROM h WHERE lo IS NULL OR lo = hi GROUP BY ALL)
SELECT held_class, t, class, n, round(n / sum(n) OVER (PARTITION BY held_class, t), 6) AS probability FROM n""")
def _(spark, d):
    return E.persistence_probabilities(A.grid(spark, d)).select("held_class", "t", "class", "n", *r6("probability"))


@query("recurrence_probabilities", ctes("grid").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + """,
s AS (SELECT patient_id, lesion_id, rano, row_number() OVER (PARTITION BY patient_id, lesion_id ORDER BY t) AS i FROM grid WHERE t > 0 AND rano IS NOT NULL),
f AS (SELECT patient_id, lesion_id, i, rano AS held_class, 1 AS k, rano AS class, 1 AS after FROM s WHERE i = 1
UNION ALL SELECT s.patient_id, s.lesion_id, s.i, CASE WHEN after = 0 THEN s.rano ELSE held_class END, CASE WHEN after = 0 THEN 1 ELSE k + 1 END, s.rano, CASE WHEN after = 0 OR s.rano = held_class THEN 1 ELSE 0 END FROM f JOIN s ON s.patient_id = f.patient_id AND s.lesion_id = f.lesion_id AND s.i = f.i + 1),
n AS (SELECT held_class, k, class, count(*) AS n FROM f GROUP BY ALL)
SELECT held_class, k, class, n, round(n / sum(n) OVER (PARTITION BY held_class, k), 6) AS probability FROM n""")
def _(spark, d):
    return E.recurrence_probabilities(A.grid(spark, d)).select("held_class", "k", "class", "n", *r6("probability"))


# ---- splits

@query("stratified_split", f"SELECT doc_id, row_number() OVER (PARTITION BY toxic ORDER BY {DRAW('42', 'doc_id')}, doc_id) <= round(0.2 * count(*) OVER (PARTITION BY toxic)) AS is_test FROM labels WHERE toxic IS NOT NULL")
def _(spark, d):
    return E.stratified_split(A.read(spark, d, "labels").where("toxic is not null"), "toxic", ["doc_id"], 0.2).select("doc_id", "is_test")


@query("stratified_kfold", ctes("scored") + "SELECT id, target, fold FROM scored")
def _(spark, d):
    return A.predictions(spark, d).where("model = 'a'").select("id", "target", "fold")


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("fold_standardize", " UNION ALL ".join(f"SELECT f::INTEGER AS fold, '{c}' AS \"column\", round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS std FROM lineitem, generate_series(0, 4) g(f) WHERE l_orderkey % 5 <> f GROUP BY f" for c in NUMBERS))
def _(spark, d):
    v = A.read(spark, d, "lineitem").withColumn("fold", (F.col("l_orderkey") % 5).cast("int"))
    return E.fold_standardize(v, NUMBERS).select("fold", "column", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


@query("prefix_sweep", ctes("grid").rstrip() + f""",
c AS (SELECT k, n, CASE WHEN k = '1yr' THEN {STEPS} ELSE n END AS target_t, k || '_[' || (SELECT string_agg('t' || j, ',' ORDER BY j) FROM generate_series(0, n - 1) s(j)) || ']->t' || CASE WHEN k = '1yr' THEN {STEPS} ELSE n END AS config FROM (VALUES ('1yr'), ('nxt')) a(k), generate_series(1, {STEPS}) b(n))
SELECT config, target_t::INTEGER AS target_t, count(*) AS rows_, round(sum(volume), 4) AS total FROM grid JOIN c ON t < n GROUP BY ALL""")
def _(spark, d):
    return E.prefix_sweep(A.grid(spark, d), STEPS).groupBy("config", "target_t").agg(F.count(F.lit(1)).alias("rows_"), F.round(F.sum("volume"), 4).alias("total"))


# ---- predictions

@query("threshold_predictions", "SELECT vec_id, round(1 / (1 + exp(-embedding[1]::DOUBLE)), 6) AS confidence, (1 / (1 + exp(-embedding[1]::DOUBLE)) >= 0.5)::INTEGER AS prediction, list_position(embedding, list_max(embedding)) - 1 AS class FROM embeddings")
def _(spark, d):
    e = A.read(spark, d, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("s"), F.col("embedding").alias("v"))
    one = E.threshold_predictions(e, score="s").withColumnsRenamed({"confidence": "c1", "prediction": "p1"})
    return E.threshold_predictions(one, scores="v").select("vec_id", F.round("c1", 6).alias("confidence"), F.col("p1").alias("prediction"), F.col("prediction").alias("class"))


def sides(spark, d):
    p = A.predictions(spark, d)
    return p.where("model = 'a'"), p.where("model = 'b'")


@query("align_predictions", ctes("predictions") + "SELECT a.config, a.fold, a.id, a.target, a.prediction AS prediction_a, b.prediction AS prediction_b FROM predictions a JOIN predictions b ON a.id = b.id AND a.fold = b.fold WHERE a.model = 'a' AND b.model = 'b'")
def _(spark, d):
    a, b = sides(spark, d)
    b = b.withColumn("config", F.when(F.col("id") % 2 == 0, "first").otherwise(F.col("config")))
    names = spark.createDataFrame([("t0", "first")], "config string, other string")
    return E.align_predictions(a, b, ["config", "fold", "id"], names).select("config", "fold", "id", "target", "prediction_a", "prediction_b")


@query("classification_metrics", ctes("predictions").rstrip() + """,
c AS (SELECT DISTINCT model, fold, target AS c FROM predictions UNION SELECT DISTINCT model, fold, prediction FROM predictions),
s AS (SELECT c.model, c.fold, c, count(*) FILTER (target = c) AS support, count(*) FILTER (prediction = c) AS named, count(*) FILTER (target = c AND prediction = c) AS hit FROM c JOIN predictions p ON p.model = c.model AND p.fold = c.fold GROUP BY ALL),
r AS (SELECT *, CASE WHEN named = 0 THEN 0 ELSE hit / named END AS p, CASE WHEN support = 0 THEN 0 ELSE hit / support END AS r FROM s),
f AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM r)
SELECT model, fold, round(sum(hit) / sum(support), 6) AS accuracy, round(avg(r) FILTER (support > 0), 6) AS balanced_accuracy, round(sum(f * support) / sum(support), 6) AS f1, round(sum(p * support) / sum(support), 6) AS precision, round(sum(r * support) / sum(support), 6) AS recall FROM f GROUP BY ALL""")
def _(spark, d):
    return E.classification_metrics(A.predictions(spark, d), ["model", "fold"]).select("model", "fold", *r6("accuracy", "balanced_accuracy", "f1", "precision", "recall"))


@query("confusion_matrix", ctes("predictions") + "SELECT model, target, count(*) FILTER (prediction = 0) AS p_0, count(*) FILTER (prediction = 1) AS p_1, round(count(*) FILTER (prediction = 0) / count(*), 6) AS share_0, round(count(*) FILTER (prediction = 1) / count(*), 6) AS share_1 FROM predictions GROUP BY ALL")
def _(spark, d):
    return E.confusion_matrix(A.predictions(spark, d), ["model"], [0, 1]).select("model", "target", "p_0", "p_1", *r6("share_0", "share_1"))


def _regression(y: str, p: str, tag: str) -> str:
    return f"""CASE WHEN var_pop({y}) > 0 THEN 1 - sum(({y} - {p}) ** 2) / (var_pop({y}) * count({y})) WHEN sum(({y} - {p}) ** 2) = 0 THEN 1 ELSE 0 END AS r2{tag}, CASE WHEN var_pop({y}) > 0 THEN 1 - var_pop({y} - {p}) / var_pop({y}) WHEN var_pop({y} - {p}) = 0 THEN 1 ELSE 0 END AS ev{tag}, CASE WHEN sum({p} * {p}) = 0 THEN 1.0 ELSE 0.0 END AS zeros{tag}, quantile_cont(abs({y} - {p}), 0.5) AS median{tag}, avg(abs({y} - {p})) AS mean{tag}, sqrt(avg(({y} - {p}) ** 2)) AS rmse{tag}"""


REGRESSION = f"""WITH v AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity * 2900 AS p, ln(1 + l_extendedprice) AS ye, ln(1 + l_quantity * 2900) AS pe FROM lineitem),
s AS (SELECT l_returnflag, {_regression("y", "p", "")}, {_regression("ye", "pe", "_e")} FROM v GROUP BY 1)
"""
ERRORS = "l_returnflag, round(r2{t}, 6) AS r2, round(median{t}, 6) AS median_ae, round(mean{t}, 6) AS mean_ae, round(rmse{t}, 6) AS rmse, round(ev{t}, 6) AS explained_variance"


def regression_rows(spark, d):
    """Prices against a line in the quantity, and the same as logarithms."""
    v = A.read(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2900).alias("p"))
    return v.withColumns({"target": F.log1p("y"), "prediction": F.log1p("p")})


@query("regression_metrics", REGRESSION + "SELECT " + ERRORS.format(t="") + ", zeros AS r2_zeros FROM s")
def _(spark, d):
    return E.regression_metrics(regression_rows(spark, d), ["l_returnflag"], "y", "p").select("l_returnflag", *r6("r2", "median_ae", "mean_ae", "rmse", "explained_variance"), "r2_zeros")


@query("regression_metrics_decoded", REGRESSION + "SELECT " + ERRORS.format(t="") + ", zeros_e AS r2_zeros, round(r2_e, 6) AS r2_encoded, round(ev_e, 6) AS explained_variance_encoded, zeros AS r2_decoded_zeros FROM s")
def _(spark, d):
    """Errors of decoded values, beside the scores of the encoded ones."""
    m = E.regression_metrics(regression_rows(spark, d), ["l_returnflag"], decoded=("y", "p"))
    return m.select("l_returnflag", *r6("r2", "median_ae", "mean_ae", "rmse", "explained_variance"), "r2_zeros", *r6("r2_encoded", "explained_variance_encoded"), "r2_decoded_zeros")


AUC = "SELECT {by}, sum(p * (below + q / 2.0)) / nullif(sum(p) * sum(q), 0) AS auc FROM (SELECT *, coalesce(sum(q) OVER (PARTITION BY {by} ORDER BY {score} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {n}) GROUP BY {by}"


@query("roc_auc", ctes("predictions") + "SELECT model, fold, round((sum(r) FILTER (target = 1) - count(*) FILTER (target = 1) * (count(*) FILTER (target = 1) + 1) / 2.0) / (count(*) FILTER (target = 0) * count(*) FILTER (target = 1)), 6) AS auc FROM (SELECT *, rank() OVER (PARTITION BY model, fold ORDER BY confidence) + (count(*) OVER (PARTITION BY model, fold, confidence) - 1) / 2.0 AS r FROM predictions) GROUP BY model, fold")
def _(spark, d):
    return E.roc_auc(A.predictions(spark, d), ["model", "fold"], F.col("target") == 1).select("model", "fold", *r6("auc"))


@query("roc_curve", ctes("predictions").rstrip() + ",\nn AS (SELECT model, confidence, count(*) FILTER (target = 1) AS p, count(*) FILTER (target <> 1) AS q FROM predictions GROUP BY ALL)\nSELECT model, round(confidence, 6) AS threshold, round(sum(q) OVER w / sum(q) OVER (PARTITION BY model), 6) AS fpr, round(sum(p) OVER w / sum(p) OVER (PARTITION BY model), 6) AS tpr FROM n WINDOW w AS (PARTITION BY model ORDER BY confidence DESC ROWS UNBOUNDED PRECEDING)")
def _(spark, d):
    return E.roc_curve(A.predictions(spark, d), ["model"], F.col("target") == 1).select("model", *r6("threshold", "fpr", "tpr"))


@query("roc_curve_multiclass", "WITH s AS (SELECT label AS target, c::INTEGER AS class, round(embedding[c + 1]::DOUBLE, 2) + 0.0 AS score FROM embeddings, generate_series(0, 63) g(c)), n AS (SELECT class, score, count(*) FILTER (target = class) AS p, count(*) FILTER (target <> class) AS q FROM s GROUP BY ALL)\nSELECT class, score AS threshold, round(CASE WHEN sum(q) OVER (PARTITION BY class) = 0 THEN 0 ELSE sum(q) OVER w / sum(q) OVER (PARTITION BY class) END, 6) AS fpr, round(CASE WHEN sum(p) OVER (PARTITION BY class) = 0 THEN 0 ELSE sum(p) OVER w / sum(p) OVER (PARTITION BY class) END, 6) AS tpr FROM n WINDOW w AS (PARTITION BY class ORDER BY score DESC ROWS UNBOUNDED PRECEDING)")
def _(spark, d):
    """One class against the rest, for each element as its score."""
    e = A.read(spark, d, "embeddings").select(F.col("label").alias("target"), F.posexplode("embedding").alias("class", "s"))
    e = e.select("target", "class", (F.round(F.col("s").cast("double"), 2) + 0.0).alias("score"))
    return E.roc_curve(e, ["class"], F.col("target") == F.col("class"), "score").select("class", "threshold", *r6("fpr", "tpr"))


@query("fold_summary", ctes("predictions").rstrip() + ",\na AS (SELECT model, fold, avg((prediction = target)::INTEGER) AS m FROM predictions GROUP BY ALL)\nSELECT model, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std FROM a GROUP BY model")
def _(spark, d):
    a = A.predictions(spark, d).groupBy("model", "fold").agg(F.avg((F.col("prediction") == F.col("target")).cast("int")).alias("m"))
    return E.fold_summary(a, ["model"], "m").select("model", *r6("mean", "std"))


CLASSED = ctes("predictions").rstrip() + """,
c AS (SELECT DISTINCT model, fold, target AS c FROM predictions UNION SELECT DISTINCT model, fold, prediction FROM predictions),
s AS (SELECT c.model, c.fold, c, count(*) FILTER (target = c) AS support, count(*) FILTER (prediction = c) AS named, count(*) FILTER (target = c AND prediction = c) AS hit FROM c JOIN predictions p ON p.model = c.model AND p.fold = c.fold GROUP BY ALL),
m AS (SELECT model, fold, sum(hit) / sum(support) AS accuracy FROM s GROUP BY ALL),
u AS (SELECT model, fold, (sum(r) FILTER (target = 1) - count(*) FILTER (target = 1) * (count(*) FILTER (target = 1) + 1) / 2.0) / (count(*) FILTER (target = 0) * count(*) FILTER (target = 1)) AS auc FROM (SELECT *, rank() OVER (PARTITION BY model, fold ORDER BY confidence) + (count(*) OVER (PARTITION BY model, fold, confidence) - 1) / 2.0 AS r FROM predictions) GROUP BY ALL)
"""


@query("fold_table", CLASSED + "SELECT model, 't0' AS config, round(avg(accuracy), 6) AS accuracy_mean, round(stddev_pop(accuracy), 6) AS accuracy_std, round(avg(auc), 6) AS auc_mean, round(stddev_pop(auc), 6) AS auc_std, " + ", ".join(f"round(max(CASE WHEN fold = {f} THEN {m} END), 6) AS {m}_fold_{f}" for m in ("accuracy", "auc") for f in range(5)) + " FROM m JOIN u USING (model, fold) GROUP BY model")
def _(spark, d):
    """Accuracy and AUC of each model and configuration, over the folds and in each."""
    t = E.fold_table(E.classification_report(A.predictions(spark, d), ["model", "config", "fold"]), ["model", "config"], ["accuracy", "auc"], list(range(5)))
    return t.select("model", "config", *r6(*[c for c in t.columns if c not in ("model", "config")]))


@query("bootstrap_auc_ci", ctes("predictions").rstrip() + f""",
p AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY model) AS c FROM predictions),
d AS (SELECT model, rep, {DRAW('0', 'rep', 'j')} % c AS i FROM (SELECT DISTINCT model, c FROM p), generate_series(0, {REPLICATES - 1}) r(rep), LATERAL (SELECT unnest(generate_series(0, c - 1)) AS j)),
n AS (SELECT d.model, rep, confidence, count(*) FILTER (target = 1) AS p, count(*) FILTER (target <> 1) AS q FROM d JOIN p ON d.model = p.model AND d.i = p.i GROUP BY ALL),
a AS ({AUC.format(by='model, rep', score='confidence', n='n')})
SELECT model, round(quantile_cont(auc, 0.025), 6) AS low, round(quantile_cont(auc, 0.975), 6) AS high, round(avg(auc), 6) AS mean FROM a WHERE auc IS NOT NULL GROUP BY model""")
def _(spark, d):
    return R.bootstrap_auc_ci(A.predictions(spark, d), ["model"], ["id"], REPLICATES).select("model", *r6("low", "high", "mean"))


@query("permutation_test_auc", ctes("predictions").rstrip() + f""",
x AS (SELECT a.id, a.target, a.confidence AS ca, b.confidence AS cb FROM predictions a JOIN predictions b ON a.id = b.id AND a.fold = b.fold WHERE a.model = 'a' AND b.model = 'b'),
s AS (SELECT rep, target, ca, cb, rep >= 0 AND {DRAW('0', 'rep', 'id')} % 2 = 1 AS swap FROM x, generate_series(-1, {REPLICATES - 1}) r(rep)),
e AS (SELECT rep, 'a' AS side, target, CASE WHEN swap THEN cb ELSE ca END AS score FROM s UNION ALL SELECT rep, 'b', target, CASE WHEN swap THEN ca ELSE cb END FROM s),
n AS (SELECT rep, side, score, count(*) FILTER (target = 1) AS p, count(*) FILTER (target <> 1) AS q FROM e GROUP BY ALL),
a AS ({AUC.format(by='rep, side', score='score', n='n')}),
f AS (SELECT rep, max(auc) FILTER (side = 'a') - max(auc) FILTER (side = 'b') AS d FROM a GROUP BY rep)
SELECT 't0' AS config, 'a / b' AS pair, round(o.d, 6) AS difference, round(avg((abs(f.d) >= abs(o.d) - 1e-12)::INTEGER), 6) AS p_value FROM f, (SELECT d FROM f WHERE rep = -1) o WHERE f.rep >= 0 GROUP BY o.d""")
def _(spark, d):
    pairs = R.all_pairs(A.predictions(spark, d), ["config"], "model", ["fold", "id"])
    return R.permutation_test_auc(pairs, ["config", "pair"], ["id"], REPLICATES).select("config", "pair", *r6("difference", "p_value"))


def compared(which: str, pairs: list[tuple[str, str]]) -> None:
    """The permutation test of some pairs of configurations: each with the next, or the first with each other one."""
    names = ", ".join(f"('{a}', '{b}')" for a, b in pairs)
    sql = ctes("configured").rstrip() + f""",
w(ca, cb) AS (VALUES {names}),
x AS (SELECT a.config || ' / ' || b.config AS pair, a.id, a.target, a.confidence AS ca, b.confidence AS cb FROM w JOIN configured a ON a.config = w.ca JOIN configured b ON b.config = w.cb AND a.id = b.id AND a.fold = b.fold),
s AS (SELECT pair, rep, target, ca, cb, rep >= 0 AND {DRAW('0', 'rep', 'id')} % 2 = 1 AS swap FROM x, generate_series(-1, {REPLICATES - 1}) r(rep)),
e AS (SELECT pair, rep, 'a' AS side, target, CASE WHEN swap THEN cb ELSE ca END AS score FROM s UNION ALL SELECT pair, rep, 'b', target, CASE WHEN swap THEN ca ELSE cb END FROM s),
n AS (SELECT pair, rep, side, score, count(*) FILTER (target = 1) AS p, count(*) FILTER (target <> 1) AS q FROM e GROUP BY ALL),
a AS ({AUC.format(by='pair, rep, side', score='score', n='n')}),
f AS (SELECT pair, rep, max(auc) FILTER (side = 'a') - max(auc) FILTER (side = 'b') AS d FROM a GROUP BY pair, rep)
SELECT f.pair, round(o.d, 6) AS difference, round(avg((abs(f.d) >= abs(o.d) - 1e-12)::INTEGER), 6) AS p_value FROM f JOIN f o ON o.pair = f.pair AND o.rep = -1 WHERE f.rep >= 0 GROUP BY f.pair, o.d"""

    @query(f"permutation_test_{which}", sql)
    def _(spark, d):
        rows = R.all_pairs(A.configured(spark, d), [], "config", ["fold", "id"], which, A.CONFIGURED)
        return R.permutation_test_auc(rows, ["pair"], ["id"], REPLICATES).select("pair", *r6("difference", "p_value"))


_C = A.CONFIGURED
compared("adjacent", [*zip(_C, _C[1:], strict=False)])
compared("first", [(_C[0], c) for c in _C[1:]])


#: p: the share of the 2^n signs whose rank sum is no larger, twice; with ties the normal approximation, erf by its series.
@query("wilcoxon_folds", ctes("predictions").rstrip() + f""",
n AS (SELECT model, config, fold, confidence, count(*) FILTER (target = 1) AS p, count(*) FILTER (target <> 1) AS q FROM predictions GROUP BY ALL),
u AS ({AUC.format(by='model, config, fold', score='confidence', n='n')}),
d AS (SELECT a.config, a.model || ' / ' || b.model AS pair, round(a.auc - b.auc, 12) AS d FROM u a JOIN u b ON a.config = b.config AND a.fold = b.fold AND a.model < b.model WHERE round(a.auc - b.auc, 12) <> 0),
r AS (SELECT *, rank() OVER (PARTITION BY config, pair ORDER BY abs(d)) AS low, count(*) OVER (PARTITION BY config, pair, abs(d)) AS t FROM d),
s AS (SELECT config, pair, least(coalesce(sum(low + (t - 1) / 2) FILTER (d > 0), 0), coalesce(sum(low + (t - 1) / 2) FILTER (d < 0), 0)) AS statistic, count(*) AS n, sum(t * t - 1) AS ties FROM r GROUP BY ALL),
z AS (SELECT *, abs(statistic - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) / sqrt(2) AS x FROM s)
SELECT config, pair, round(statistic, 6) AS statistic, n, round(CASE WHEN ties = 0 THEN least(1, 2 * len(list_filter(range(0, (2 ** n)::BIGINT), lambda m: list_sum([0] || list_transform(range(1, n + 1), lambda i: CASE WHEN (m >> (i - 1)::BIGINT) & 1 = 1 THEN i ELSE 0 END)) <= statistic)) / 2 ** n)
ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda k: (-1) ** k * x ** (2 * k + 1) / (gamma(k + 1) * (2 * k + 1)))) END, 6) AS p_value FROM z""")
def _(spark, d):
    """Fold AUCs of every two models of a configuration, against each other."""
    auc = E.roc_auc(A.predictions(spark, d), ["model", "config", "fold"], F.col("target") == 1)
    return E.wilcoxon_folds(E.metric_pairs(auc, ["config"], "model", "fold", "auc"), ["config", "pair"], "a", "b").select("config", "pair", "n", *r6("statistic", "p_value"))


@query("correlated_features", "WITH v AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_tax * 3 + 1 AS l_tax2 FROM lineitem), r AS (" + " UNION ALL ".join(f"SELECT '{b}' AS feature, abs(corr({a}, {b})) AS r FROM v" for i, b in enumerate([*NUMBERS, "l_tax2"]) for a in NUMBERS[:i]) + ") SELECT feature, round(max(r), 6) AS max_r FROM r WHERE r > 0.8 GROUP BY feature")
def _(spark, d):
    v = A.read(spark, d, "lineitem").select(*NUMBERS, (F.col("l_tax") * 3 + 1).alias("l_tax2"))
    return N.correlated_features(v, [*NUMBERS, "l_tax2"], 0.8).select("feature", *r6("max_r"))


BIC = ctes("elements").rstrip() + """,
m AS (SELECT cluster, j, avg(x) AS m FROM elements GROUP BY ALL),
s AS (SELECT (SELECT count(*) FROM trajectories)::DOUBLE AS n, sum((x - m) ** 2) AS rss, count(DISTINCT cluster) AS k, count(DISTINCT j) AS d FROM elements JOIN m USING (cluster, j)),
l AS (SELECT sum(c * ln(c / (SELECT n FROM s))) AS w FROM (SELECT count(*)::DOUBLE AS c FROM trajectories GROUP BY cluster)),
v AS (SELECT *, rss / (n - k + 1e-10) AS var, k - 1 + k * d + 1 AS free FROM s, l)
SELECT round(n * ln(rss / n) + 2 * k * d, 4) AS aic, round(n * ln(rss / n) + k * d * ln(n), 4) AS bic, round(-n * d / 2 * ln(2 * pi() * var) - rss / (2 * var) + w - 2 * free, 4) AS aic_likelihood, round(-n * d / 2 * ln(2 * pi() * var) - rss / (2 * var) + w - free / 2.0 * ln(n), 4) AS bic_likelihood FROM v"""


@query("cluster_bic_aic", BIC)
def _(spark, d):
    b = E.cluster_bic_aic(A.trajectories(spark, d), "v", "cluster")
    return b.select(*[F.round(c, 4).alias(c) for c in b.columns])


@query("davies_bouldin", ctes("elements").rstrip() + """,
m AS (SELECT cluster, j, avg(x) AS m FROM elements GROUP BY ALL),
d AS (SELECT subject, cluster, sqrt(sum((x - m) ** 2)) AS d FROM elements JOIN m USING (cluster, j) GROUP BY ALL),
s AS (SELECT cluster, avg(d) AS s FROM d GROUP BY 1),
p AS (SELECT a.cluster AS ca, b.cluster AS cb, sqrt(sum((a.m - b.m) ** 2)) AS far FROM m a JOIN m b ON a.j = b.j AND a.cluster <> b.cluster GROUP BY ALL),
w AS (SELECT ca, max((x.s + y.s) / far) AS w FROM p JOIN s x ON x.cluster = ca JOIN s y ON y.cluster = cb GROUP BY ca)
SELECT round(avg(w), 6) AS davies_bouldin FROM w""")
def _(spark, d):
    return E.davies_bouldin(A.trajectories(spark, d), "v", "cluster").select(*r6("davies_bouldin"))


@query("qc_sample", "SELECT c_custkey FROM customer ORDER BY md5('5:' || c_custkey), c_custkey LIMIT 50")
def _(spark, d):
    return E.qc_sample(A.read(spark, d, "customer"), ["c_custkey"], 50, 5).select("c_custkey")


# ---- clusters and models

def relative_vectors(spark, d):
    t = T.trajectory_array(clustered(spark, d), K, "t", "value").withColumn("v", F.transform("trajectory", lambda x: F.log1p(F.coalesce(x, F.lit(0.0)))))
    return t.drop("trajectory")


@query("xmeans")
def _(spark, d):
    return L.xmeans(relative_vectors(spark, d), "v").select(*K, "cluster")


@query("xmeans_dtw")
def _(spark, d):
    return L.split_search(relative_vectors(spark, d), "v", "dtw").select(*K, "cluster")


@query("xshapes")
def _(spark, d):
    return L.xshapes(relative_vectors(spark, d), "v").select(*K, "cluster")


@query("mixture_clusters")
def _(spark, d):
    out, score = L.mixture_clusters(relative_vectors(spark, d), "v", 4)
    return out.select(*K, "cluster", *[F.lit(round(v, 3)).alias(k) for k, v in score.items()])


@query("best_k")
def _(spark, d):
    """Mixtures of 2 to 41 clusters, and the number that lowers AIC and BIC."""
    fits = L.mixtures(relative_vectors(spark, d), "v", range(2, L.MAX_CLUSTERS))
    tried = [(k, s["aic"], s["bic"]) for k, (*_, s) in fits.items()]
    return spark.createDataFrame([(k, round(a, 3), round(b, 3), k == L.best_k(tried)) for k, a, b in tried], "k int, aic double, bic double, best boolean")


def learnable(spark, d):
    """Wide grid volumes with the last class as target (1 for PD or SD), and folds."""
    w = T.wide_features(A.grid(spark, d), K, "t", list(range(STEPS + 1)), ["volume", "rano"]).withColumn("id", F.concat_ws(":", F.col("patient_id").cast("string"), "lesion_id"))
    w = w.withColumn("target", F.col(f"t{STEPS}_rano").isin("SD", "PD").cast("int"))
    return E.stratified_kfold(w, "target", ["id"], 5)


#: Every prefix t0, t0-t1, ... t0-t5.
CONFIGS = {f"t0-t{n}" if n else "t0": [f"t{t}_volume" for t in range(n + 1)] for n in range(STEPS)}


@query("train_classifiers")
def _(spark, d):
    p = L.train_classifiers(learnable(spark, d), CONFIGS, "target")
    return p.select("model", "config", "fold", "id", "prediction", "target", *r6("confidence"))


@query("train_holdout_sweep")
def _(spark, d):
    w = learnable(spark, d)
    p = L.train_holdout_sweep(w.where("fold <> 0"), w.where("fold = 0"), CONFIGS, "target")
    return p.select("model", "config", "id", "prediction", "target", *r6("confidence"))


@query("train_regressors")
def _(spark, d):
    """Each prefix against the next timepoint and the last one."""
    w = learnable(spark, d)
    configs = {f"{kind}_{c}": (columns, f"t{len(columns) if kind == 'nxt' else STEPS}_volume") for kind in ("nxt", "1yr") for c, columns in CONFIGS.items()}
    return L.train_regressors(w.where("fold <> 0"), w.where("fold = 0"), configs).select("model", "config", "id", *r6("prediction"), "target")


#: Features of a timepoint: what a series has there, and what can be told from its earlier points.
STACKED = ["volume", "timedelta_days", "relative", "logarithm", "diameter", "nadir", "peak", "mean", "change", "slope", "share", "twice"]


def stacked(spark, d):
    """The wide table of all features, and its timepoints but the last under common names, with the encoded class of the same one."""
    from pyspark.sql import Window

    from ..functions import columns as C

    w = Window.partitionBy(*K).orderBy("t")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    v, day = F.col("volume"), F.col("timedelta_days")
    change, days = v - F.coalesce(F.lag("volume").over(w), v), day - F.lag("timedelta_days").over(w)
    more = {
        "relative": F.try_divide(v, F.first("volume").over(w)), "logarithm": F.log1p(v), "diameter": C.sphere_diameter(v), "nadir": F.min("volume").over(so_far), "peak": F.max("volume").over(so_far),
        "mean": F.avg("volume").over(so_far), "change": change, "slope": change / days, "share": F.try_divide(v, F.sum("volume").over(Window.partitionBy("patient_id", "t"))), "twice": 2 * v + 1,
    }
    g = A.grid(spark, d).withColumns(more)
    wide = T.wide_features(g, K, "t", list(range(STEPS + 1)), [*STACKED, "rano"]).withColumn("id", C.compose_id(F.col("patient_id"), F.col("lesion_id")))
    rows = T.stack_timepoints(wide, "id", list(range(STEPS + 1)), STACKED, "rano")
    return wide, rows.withColumn("target", C.encode_response(F.col("rano"))).where("target is not null")


@query("lasso_select")
def _(spark, d):
    """What an L1 fit of the class leaves out, over all timepoints and features."""
    gone = N.lasso_select(stacked(spark, d)[1], STACKED, "target")
    return spark.createDataFrame([(c, c in gone) for c in STACKED], "feature string, dropped boolean")


@query("feature_selection")
def _(spark, d):
    """Timepoints stacked, features eliminated one method after the other, and the wide columns that are left."""
    from ..sources.io import stored

    wide, rows = stacked(spark, d)
    gone = L.eliminate(stored(rows), STACKED, "target", [N.correlated(0.9), N.lasso_select, L.model_select])
    kept = T.drop_feature_suffixes([c for c in wide.columns if c not in (*K, "id")], [f"_{f}" for f in gone], keep_days=False)
    return spark.createDataFrame([(c, c in kept) for c in wide.columns if c not in (*K, "id")], "column string, kept boolean")


@query("model_select")
def _(spark, d):
    w = learnable(spark, d)
    gone = L.eliminate(w, CONFIGS["t0-t5"], "t6_volume", [L.model_select])
    return w.sparkSession.createDataFrame([(c, c in gone) for c in CONFIGS["t0-t5"]], "feature string, dropped boolean")
