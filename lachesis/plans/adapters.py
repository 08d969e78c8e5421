"""The driver's tables as series, voxels, predictions, trajectories and manifests; and the same as SQL for the oracles.

`SQL` maps a name to the body of a common table expression; `ctes("a", "b")` joins those named with all they build on.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.series import index_timepoints, response_class
from ..operators.evaluate import stratified_kfold
from ..operators.matching import by_line, tasks_of
from ..operators.resample import resample_nearest

#: Scaled parameters for the events' 30 days.
TIMEFRAME, STEPS, MIN_SPAN, MAX_GAP, MAX_PERIOD, CUTOFF, TARGET = 24, 6, 22, 8, 24, 28, 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as series: (user, type), values below 5 as zeros, from the first non-zero on, with t and days."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("patient_id"), F.col("event_type").alias("lesion_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", F.when(F.col("value") < 5, 0.0).otherwise(F.col("value")).alias("volume"))
    w = Window.partitionBy("patient_id", "lesion_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = e.withColumn("_on", F.max(F.when(F.col("volume") != 0, 1).otherwise(0)).over(w)).where("_on = 1").drop("_on")
    return index_timepoints(rows, "event_id")


def classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return response_class(series(spark, sf_dir))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series on the regular grid, with t as the grid's number, days of the grid and classes."""
    g = resample_nearest(series(spark, sf_dir), TIMEFRAME, STEPS)
    g = g.select("patient_id", "lesion_id", F.col("i").alias("t"), "volume", (F.col("i") * (TIMEFRAME // STEPS)).alias("timedelta_days"))
    return response_class(g)


def order_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as series over years, one a customer."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("patient_id"), F.col("o_custkey").alias("lesion_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), "o_orderkey", F.col("o_totalprice").alias("volume"))
    return index_timepoints(o, "o_orderkey")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "lineitem")
    rows = v.select(
        F.col("l_suppkey").alias("patient_id"), F.year("l_shipdate").alias("study"), F.col("l_returnflag").alias("obs"), F.col("l_quantity").cast("int").alias("x"),
        F.round(F.col("l_discount") * 100).cast("int").alias("y"), F.round(F.col("l_tax") * 100).cast("int").alias("z"),
    )
    # The count comes from the files' footers.
    return by_line(rows, v.count()).distinct()


def voxel_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for joins of what is made of the voxels."""
    return tasks_of(read(spark, sf_dir, "lineitem").count())


def atlas(spark: SparkSession) -> DataFrame:
    """A grid with a label for each x-decade, and none where y is over 7: as many rows whatever the tables' size."""
    r = spark.range(50).select((F.col("id") + 1).cast("int").alias("x"))
    r = r.crossJoin(spark.range(11).select(F.col("id").cast("int").alias("y"))).crossJoin(spark.range(9).select(F.col("id").cast("int").alias("z")))
    label = F.get(F.array(*[F.lit(v) for v in (100, 101, 200, 201, 300)]), F.floor((F.col("x") - 1) / 10).cast("int"))
    return r.withColumn("label", F.when(F.col("y") > 7, 0).otherwise(label))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' confidences for the labelled documents: (model, config, fold, id, target, confidence, prediction)."""
    d, l = read(spark, sf_dir, "documents").select("doc_id", "n_chars"), read(spark, sf_dir, "labels").where("toxic is not null")
    rows = l.join(d, "doc_id").select(F.col("doc_id").alias("id"), F.col("toxic").alias("target"), (F.col("n_chars") % 97 / 97.0).alias("a"), ((F.col("doc_id") * 37) % 101 / 101.0).alias("b"))
    rows = stratified_kfold(rows, "target", ["id"], 5, 42)
    m = F.array(F.struct(F.lit("a").alias("model"), F.col("a").alias("confidence")), F.struct(F.lit("b").alias("model"), F.col("b").alias("confidence")))
    rows = rows.withColumn("m", F.explode(m)).select("m.model", F.lit("t0").alias("config"), "fold", "id", "target", "m.confidence")
    return rows.withColumn("prediction", (F.col("confidence") >= 0.5).cast("int"))


#: Configurations of three inputs, in order.
CONFIGURED = ["t0", "t0-t1", "t0-t2"]


def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model's confidences for the labelled documents under each configuration: (config, fold, id, target, confidence, prediction)."""
    p = predictions(spark, sf_dir).groupBy("fold", "id", "target").agg(*[F.max(F.when(F.col("model") == m, F.col("confidence"))).alias(m) for m in "ab"])
    values = [F.col("a"), F.col("b"), (F.col("a") + F.col("b")) / 2]
    rows = p.withColumn("c", F.explode(F.array(*[F.struct(F.lit(c).alias("config"), v.alias("confidence")) for c, v in zip(CONFIGURED, values, strict=True)])))
    return rows.select("c.config", "fold", "id", "target", "c.confidence", (F.col("c.confidence") >= 0.5).cast("int").alias("prediction"))


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("subject"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("cluster"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_type", F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyyMMddHHmmss").alias("s"))
    head = F.concat(F.lit("sub-"), F.col("user_id").cast("string"), F.lit("/ses-"), F.col("s"))
    folders = F.when(F.col("event_type") == "purchase", F.array(F.lit("/anat"), F.lit("/rt"))).otherwise(F.array(F.lit("/anat")))
    return e.select(head.alias("head"), F.explode(folders).alias("folder")).select(F.concat("head", "folder").alias("path"))


DAYS = lambda a, b: f"floor((epoch_us({a}) - epoch_us({b})) / 86400000000.0)::INTEGER"
RESPONSE = lambda v, base, nadir: f"CASE WHEN {v} = 0 THEN 'CR' WHEN {base} = 0 THEN NULL WHEN {v} / {base} <= 0.343 THEN 'PR' WHEN {v} / greatest({nadir}, 1e-6) < 1.728 THEN 'SD' ELSE 'PD' END"
W = "PARTITION BY patient_id, lesion_id"
DRAW = lambda *parts: "('0x' || substr(md5(" + " || ':' || ".join(f"({p})::VARCHAR" for p in parts) + "), 1, 8))::BIGINT"

SQL: dict[str, str] = {
    "raw": "SELECT user_id AS patient_id, event_type AS lesion_id, ts, event_id, CASE WHEN value < 5 THEN 0.0::DOUBLE ELSE value END AS volume FROM events",
    "started": f"SELECT *, max(CASE WHEN volume <> 0 THEN 1 ELSE 0 END) OVER ({W} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS on_ FROM raw",
    "series": f"SELECT patient_id, lesion_id, ts, event_id, volume, (row_number() OVER w - 1)::INTEGER AS t, {DAYS('ts', 'first_value(ts) OVER w')} AS timedelta_days FROM started WHERE on_ = 1 WINDOW w AS ({W} ORDER BY ts, event_id)",
    "based": f"SELECT *, first_value(volume) OVER ({W} ORDER BY t) AS base, min(volume) OVER ({W} ORDER BY t ROWS UNBOUNDED PRECEDING) AS nadir FROM series",
    "classed": f"SELECT * EXCLUDE (base, nadir), CASE WHEN t > 0 THEN {RESPONSE('volume', 'base', 'nadir')} END AS rano FROM based",
    "long_enough": f"SELECT * EXCLUDE (span) FROM (SELECT *, {DAYS(f'max(ts) OVER ({W})', f'min(ts) OVER ({W})')} AS span FROM series) WHERE span >= {TIMEFRAME} - 0.5 * {TIMEFRAME} / {STEPS}",
    "time_grid": f"SELECT patient_id, lesion_id, i::INTEGER AS i, min(ts) + to_microseconds((i * {TIMEFRAME * 86400000000 // STEPS})::BIGINT) AS target_ts FROM long_enough, generate_series(0, {STEPS}) g(i) GROUP BY patient_id, lesion_id, i",
    "nearest": f"SELECT patient_id, lesion_id, i, target_ts, volume FROM (SELECT g.*, volume, row_number() OVER (PARTITION BY g.patient_id, g.lesion_id, i ORDER BY abs({DAYS('ts', 'target_ts')}), ts, t) AS r FROM time_grid g JOIN long_enough s USING (patient_id, lesion_id)) WHERE r = 1",
    "gridded": f"SELECT patient_id, lesion_id, i AS t, volume, i * {TIMEFRAME // STEPS} AS timedelta_days FROM nearest",
    "gbased": f"SELECT *, first_value(volume) OVER ({W} ORDER BY t) AS base, min(volume) OVER ({W} ORDER BY t ROWS UNBOUNDED PRECEDING) AS nadir FROM gridded",
    "grid": f"SELECT * EXCLUDE (base, nadir), CASE WHEN t > 0 THEN {RESPONSE('volume', 'base', 'nadir')} END AS rano FROM gbased",
    "order_series": f"SELECT *, (row_number() OVER w - 1)::INTEGER AS t, {DAYS('ts', 'first_value(ts) OVER w')} AS timedelta_days FROM (SELECT o_custkey AS patient_id, o_custkey AS lesion_id, o_orderdate AS ts, o_orderkey, o_totalprice AS volume FROM orders) WINDOW w AS ({W} ORDER BY ts, o_orderkey)",
    "voxels": "SELECT DISTINCT l_suppkey AS patient_id, year(l_shipdate)::INTEGER AS study, l_returnflag AS obs, l_quantity::INTEGER AS x, round(l_discount * 100)::INTEGER AS y, round(l_tax * 100)::INTEGER AS z FROM lineitem",
    "observations": "SELECT patient_id, study, obs, count(*)::DOUBLE AS volume, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM voxels GROUP BY ALL",
    "shared_voxels": "SELECT a.patient_id, a.study AS study_a, a.obs AS obs_a, b.study AS study_b, b.obs AS obs_b, count(*) AS overlap FROM voxels a JOIN voxels b USING (patient_id, x, y, z) WHERE a.study < b.study GROUP BY ALL",
    "metrics": "SELECT a.patient_id, a.study AS study_a, a.obs AS obs_a, b.study AS study_b, b.obs AS obs_b, coalesce(overlap, 0)::BIGINT AS overlap, sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 + (a.cz - b.cz) ** 2) AS distance, 2 * pow(a.volume / (4.0 / 3.0 * pi()), 1.0 / 3.0) AS diameter FROM observations a JOIN observations b ON a.patient_id = b.patient_id AND a.study < b.study LEFT JOIN shared_voxels o ON o.patient_id = a.patient_id AND o.study_a = a.study AND o.obs_a = a.obs AND o.study_b = b.study AND o.obs_b = b.obs",
    "atlas": "SELECT x::INTEGER AS x, y::INTEGER AS y, z::INTEGER AS z, CASE WHEN y > 7 THEN 0 ELSE [100, 101, 200, 201, 300][((x - 1) // 10 + 1)::INTEGER] END::INTEGER AS label FROM generate_series(1, 50) a(x), generate_series(0, 10) b(y), generate_series(0, 8) c(z)",
    "scored": f"SELECT doc_id AS id, toxic AS target, (n_chars % 97) / 97.0::DOUBLE AS a, ((doc_id * 37) % 101) / 101.0::DOUBLE AS b, ((row_number() OVER (PARTITION BY toxic ORDER BY {DRAW('42', 'doc_id')}, doc_id) - 1) % 5)::INTEGER AS fold FROM labels JOIN documents USING (doc_id) WHERE toxic IS NOT NULL",
    "predictions": "SELECT *, CASE WHEN confidence >= 0.5 THEN 1 ELSE 0 END AS prediction FROM (SELECT 'a' AS model, 't0' AS config, fold, id, target, a AS confidence FROM scored UNION ALL SELECT 'b', 't0', fold, id, target, b FROM scored)",
    "configured": "SELECT 't0' AS config, fold, id, target, a AS confidence FROM scored UNION ALL SELECT 't0-t1', fold, id, target, b FROM scored UNION ALL SELECT 't0-t2', fold, id, target, (a + b) / 2 FROM scored",
    "trajectories": "SELECT vec_id AS subject, embedding::DOUBLE[] AS v, label AS cluster FROM embeddings",
    "elements": "SELECT subject, cluster, unnest(v) AS x, unnest(generate_series(1, len(v))) AS j FROM trajectories",
    "manifest": "SELECT 'sub-' || user_id || '/ses-' || strftime(ts, '%Y%m%d%H%M%S') || '/anat' AS path FROM events UNION ALL SELECT 'sub-' || user_id || '/ses-' || strftime(ts, '%Y%m%d%H%M%S') || '/rt' FROM events WHERE event_type = 'purchase'",
    "swings_": f"SELECT *, (volume = 0) AS z, CASE WHEN t > 0 AND lag(volume = 0) OVER ({W} ORDER BY t) = (volume = 0) THEN 0 ELSE 1 END AS change FROM series",
    "swings_runs": f"SELECT *, sum(change) OVER ({W} ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM swings_",
    "swings": f"SELECT patient_id, lesion_id, ts, event_id, volume, t, timedelta_days, z AND run < max(run) OVER ({W}) AS is_swing FROM swings_runs",
}


def ctes(*names: str) -> str:
    """WITH clause that defines the names and what they build on, in the order of SQL."""
    need, todo = set(), list(names)
    while todo:
        n = todo.pop()
        if n not in need:
            need.add(n)
            todo += [m for m in SQL if re.search(rf"\b(?:FROM|JOIN|,)\s+{m}\b", SQL[n]) and m != n]
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in SQL if n in need) + "\n"
