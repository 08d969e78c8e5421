"""Queries on tables: matching, joins, encodings, scaling and reshaping, with the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import matching as M
from ..operators import summaries as U
from ..operators import tables as T
from ..sources import io
from . import adapters as A
from .adapters import DRAW, STEPS, ctes

QUERIES, ORACLES = {}, {}
K = ["patient_id", "lesion_id"]
PAIR = ["patient_id", "study_a", "obs_a", "study_b", "obs_b"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def users(spark, d, where: str):
    return A.read(spark, d, "events").where(where).select(F.col("user_id").alias("patient_id")).distinct()


@query("pending_patients", "SELECT DISTINCT user_id AS patient_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 60)")
def _(spark, d):
    return T.pending_patients(users(spark, d, "true"), users(spark, d, "event_type = 'purchase' and value > 60"))


@query("lesion_id", "SELECT DISTINCT user_id || ':' || event_type AS id, user_id::VARCHAR AS patient FROM events")
def _(spark, d):
    e = A.read(spark, d, "events").select(C.compose_id(F.col("user_id"), F.col("event_type")).alias("id")).distinct()
    return e.select("id", C.patient_of(F.col("id")).alias("patient"))


@query("discard_lesions", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(spark, d):
    ids = A.read(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return T.discard_lesions(A.read(spark, d, "customer"), ids, "c_custkey").select("c_custkey", "c_acctbal")


@query("keep_matched", "SELECT event_id FROM events WHERE (user_id, event_type) IN (SELECT user_id, event_type FROM events WHERE value > 80)")
def _(spark, d):
    e = A.read(spark, d, "events")
    return T.keep_matched(e, e.where("value > 80"), ["user_id", "event_type"]).select("event_id")


@query("tag_matched", "SELECT event_id, (user_id, event_type) IN (SELECT user_id, event_type FROM events WHERE value > 80) AS rt_matched FROM events")
def _(spark, d):
    e = A.read(spark, d, "events")
    return T.tag_matched(e, e.where("value > 80"), ["user_id", "event_type"]).select("event_id", "rt_matched")


@query("same_space", "SELECT a.l_orderkey, a.l_linenumber AS a, b.l_linenumber AS b, a.l_discount IS NOT DISTINCT FROM b.l_discount AND a.l_tax IS NOT DISTINCT FROM b.l_tax AS same_space FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber")
def _(spark, d):
    v = A.read(spark, d, "lineitem")
    side = lambda s: v.select("l_orderkey", F.col("l_linenumber").alias(s), F.col("l_discount").alias(f"d_{s}"), F.col("l_tax").alias(f"t_{s}"))
    return M.same_space(side("a").join(side("b"), "l_orderkey").where("a < b"), ["d_a", "t_a"], ["d_b", "t_b"]).select("l_orderkey", "a", "b", "same_space")


# ---- matching

@query("lesion_volume", ctes("observations") + "SELECT patient_id, study, obs, round(volume * 2.0 * 0.5 * 1.5, 6) AS volume FROM observations")
def _(spark, d):
    return M.observations(A.voxels(spark, d), (2.0, 0.5, 1.5)).select(*M.STUDY, "obs", *r6("volume"))


@query("lesion_centroid", ctes("observations") + "SELECT patient_id, study, obs, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz FROM observations")
def _(spark, d):
    return M.observations(A.voxels(spark, d)).select(*M.STUDY, "obs", *r6("cx", "cy", "cz"))


@query("lesion_overlap", ctes("shared_voxels") + "SELECT * FROM shared_voxels")
def _(spark, d):
    return M.lesion_overlap(A.voxels(spark, d), tasks=A.voxel_tasks(spark, d))


def metrics(spark, d):
    v, n = A.voxels(spark, d), A.voxel_tasks(spark, d)
    return M.correspondence_metrics(M.observations(v), M.lesion_overlap(v, tasks=n), tasks=n)


@query("correspondence_metrics", ctes("metrics") + "SELECT patient_id, study_a, obs_a, study_b, obs_b, overlap, round(distance, 6) AS distance, round(diameter, 6) AS diameter FROM metrics")
def _(spark, d):
    return metrics(spark, d).select(*PAIR, "overlap", *r6("distance", "diameter"))


@query("sphere_diameter", "SELECT l_orderkey, l_linenumber, round(2 * pow(l_quantity / (4.0 / 3.0 * pi()), 1.0 / 3.0), 6) AS diameter, round(sqrt((l_quantity - l_tax) ** 2 + l_discount ** 2), 6) AS distance FROM lineitem")
def _(spark, d):
    c, zero = F.col, F.lit(0.0)
    gap = C.centroid_distance([c("l_quantity"), c("l_discount")], [c("l_tax"), zero])
    return A.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(C.sphere_diameter(c("l_quantity")), 6).alias("diameter"), F.round(gap, 6).alias("distance"))


RANKED = ctes("metrics").rstrip() + ",\nm AS (SELECT *, study_a * 100 + ascii(obs_a) AS idx, distance <= least(diameter, 6) AS gate FROM metrics)"


@query("best_match", RANKED + """,
f AS (SELECT * FROM (SELECT *, idx = min(idx) OVER (PARTITION BY patient_id, study_b, obs_b, overlap) AS first_ FROM m) WHERE gate OR (overlap > 0 AND first_))
SELECT patient_id, study_b, obs_b, study_a, obs_a FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, study_b, obs_b ORDER BY overlap DESC, distance, idx) AS r FROM f) WHERE r = 1""")
def _(spark, d):
    m = metrics(spark, d).withColumn("idx", F.col("study_a") * 100 + F.ascii("obs_a"))
    return M.best_match(m, ["patient_id", "study_b", "obs_b"], "idx", tasks=A.voxel_tasks(spark, d)).select("patient_id", "study_b", "obs_b", "study_a", "obs_a")


@query("best_match_overlap", RANKED + "\nSELECT patient_id, study_b, obs_b, study_a, obs_a FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, study_b, obs_b ORDER BY overlap DESC, idx) AS r FROM m WHERE overlap > 0) WHERE r = 1")
def _(spark, d):
    m = metrics(spark, d).withColumn("idx", F.col("study_a") * 100 + F.ascii("obs_a"))
    return M.best_match(m, ["patient_id", "study_b", "obs_b"], "idx", "overlap", tasks=A.voxel_tasks(spark, d)).select("patient_id", "study_b", "obs_b", "study_a", "obs_a")


@query("best_match_centroid", RANKED + "\nSELECT patient_id, study_b, obs_b, study_a, obs_a FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, study_b, obs_b ORDER BY distance, idx) AS r FROM m WHERE gate) WHERE r = 1")
def _(spark, d):
    m = metrics(spark, d).withColumn("idx", F.col("study_a") * 100 + F.ascii("obs_a"))
    return M.best_match(m, ["patient_id", "study_b", "obs_b"], "idx", "centroid", tasks=A.voxel_tasks(spark, d)).select("patient_id", "study_b", "obs_b", "study_a", "obs_a")


@query("track_lesions")
def _(spark, d):
    v = A.voxels(spark, d)
    obs = M.observations(v).withColumns({"ts": F.make_timestamp_ntz("study", F.lit(7), F.lit(1), F.lit(0), F.lit(0), F.lit(0)), "treated": F.col("study") % 2 == 1})
    n = A.voxel_tasks(spark, d)
    return M.track_lesions(obs, M.lesion_overlap(v, tasks=n), n)


#: Users whose number 7 divides have no truth; a lesion's label is that of its largest event, and values of 30 or less match nothing.
REPORT = """
WITH e AS (SELECT user_id AS patient_id, event_type AS lesion, event_id, value FROM events),
t AS (SELECT patient_id, lesion, max(value) < 60 AS is_empty FROM e GROUP BY ALL), g AS (SELECT DISTINCT patient_id, k AS label FROM e, generate_series(1, 4) s(k) WHERE patient_id % 7 <> 0),
m AS (SELECT patient_id, lesion, (arg_max(event_id, (value, event_id)) % 4 + 1)::INTEGER AS label FROM e WHERE value > 30 AND patient_id % 7 <> 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY patient_id, label ORDER BY lesion) AS n, count(*) OVER (PARTITION BY patient_id, label) AS c FROM m),
a AS (SELECT patient_id, string_agg(format('"{}":"{}"', label, lesion), ',' ORDER BY label) AS matched FROM r WHERE n = 1 GROUP BY 1),
b AS (SELECT patient_id, string_agg(format('"{}":[{}]', label, names), ',' ORDER BY label) AS several FROM (SELECT patient_id, label, string_agg('"' || lesion || '"', ',' ORDER BY lesion) AS names FROM r WHERE c > 1 GROUP BY ALL) GROUP BY 1),
l AS (SELECT patient_id, string_agg('"' || lesion || '"', ',' ORDER BY lesion) AS lost FROM t WHERE (patient_id, lesion) NOT IN (SELECT patient_id, lesion FROM m) GROUP BY 1),
f AS (SELECT patient_id, string_agg(label::VARCHAR, ',' ORDER BY label) AS free FROM g WHERE (patient_id, label) NOT IN (SELECT patient_id, label FROM m) GROUP BY 1),
p AS (SELECT patient_id, count(*) AS parsed_mets, count(*) FILTER (NOT is_empty) AS t0_nonzero_parsed_mets FROM t GROUP BY 1),
report AS (SELECT p.patient_id, CASE WHEN p.patient_id % 7 = 0 THEN 0 ELSE 4 END::BIGINT AS labels_in_gt, parsed_mets, t0_nonzero_parsed_mets, '{' || coalesce(matched, '') || '}' AS matched_mets,
'[' || CASE WHEN p.patient_id % 7 = 0 THEN '' ELSE coalesce(lost, '') END || ']' AS unmatched_parsed_mets, '[' || coalesce(free, '') || ']' AS unmatched_gt_mets, '{' || coalesce(several, '') || '}' AS ambiguous_parsed_matches,
'[' || CASE WHEN p.patient_id % 7 = 0 THEN coalesce(lost, '') ELSE '' END || ']' AS t0_zero_mets FROM p LEFT JOIN a USING (patient_id) LEFT JOIN b USING (patient_id) LEFT JOIN l USING (patient_id) LEFT JOIN f USING (patient_id))
"""


def report(spark, d):
    e = A.read(spark, d, "events").select(F.col("user_id").alias("patient_id"), F.col("event_type").alias("lesion"), "event_id", "value")
    some = e.where("patient_id % 7 <> 0")
    matches = some.where("value > 30").groupBy("patient_id", "lesion").agg((F.max_by("event_id", F.struct("value", "event_id")) % 4 + 1).cast("int").alias("label"))
    tracked = e.groupBy("patient_id", "lesion").agg((F.max("value") < 60).alias("is_empty"))
    truth = some.select("patient_id").distinct().withColumn("label", F.explode(F.array(*[F.lit(i) for i in range(1, 5)])))
    return M.match_report(matches, tracked, truth)


@query("match_report", REPORT + "SELECT * FROM report")
def _(spark, d):
    r = report(spark, d)
    return r.select(*[F.to_json(c).alias(c) if t.startswith(("map", "array")) else F.col(c) for c, t in r.dtypes])


COUNT = lambda c: f"coalesce(sum(len(regexp_extract_all({c}, '{chr(34)}[^{chr(34)}]*{chr(34)}'))), 0)::BIGINT"


@query("match_report_totals", REPORT + """SELECT count(*) AS patients, sum(labels_in_gt)::BIGINT AS labels, sum(t0_nonzero_parsed_mets)::BIGINT AS parsed, (SELECT count(*) FROM r WHERE n = 1) AS matched,
(SELECT count(*) FROM g WHERE (patient_id, label) NOT IN (SELECT patient_id, label FROM m)) AS unmatched_gt, """ + COUNT("unmatched_parsed_mets") + " AS unmatched_parsed, " + COUNT("t0_zero_mets") + """ AS t0_zero, (SELECT count(*) FROM r WHERE n = 2) AS ambiguous,
coalesce(sum(t0_nonzero_parsed_mets - labels_in_gt) FILTER (t0_nonzero_parsed_mets > labels_in_gt), 0)::BIGINT AS surplus, count(*) FILTER (t0_nonzero_parsed_mets = labels_in_gt) AS equal, coalesce(sum(labels_in_gt - t0_nonzero_parsed_mets) FILTER (t0_nonzero_parsed_mets < labels_in_gt), 0)::BIGINT AS missed FROM report""")
def _(spark, d):
    return M.match_totals(report(spark, d))


@query("locate_region", ctes("voxels", "atlas").rstrip() + """,
lesions AS (SELECT * FROM voxels),
aim AS (SELECT * FROM atlas WHERE label > 0),
n AS (SELECT patient_id, study, obs, label, count(*) AS n FROM lesions JOIN aim USING (x, y, z) GROUP BY ALL),
hit AS (SELECT patient_id, study, obs, label AS region, true AS overlaps FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, study, obs ORDER BY n DESC, label) AS r FROM n) WHERE r = 1),
rest AS (SELECT DISTINCT patient_id, study, obs, x, y, z FROM lesions WHERE (patient_id, study, obs) NOT IN (SELECT patient_id, study, obs FROM hit)),
places AS (SELECT DISTINCT x, y, z FROM rest),
far AS (SELECT p.x, p.y, p.z, label, min(greatest(abs(p.x - a.x), abs(p.y - a.y), abs(p.z - a.z))) AS d FROM places p, aim a GROUP BY ALL),
mean AS (SELECT patient_id, study, obs, label, avg(d) AS d FROM rest JOIN far USING (x, y, z) GROUP BY ALL),
near AS (SELECT patient_id, study, obs, label AS region, false AS overlaps FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, study, obs ORDER BY d, label) AS r FROM mean) WHERE r = 1)
SELECT * FROM hit UNION ALL SELECT * FROM near""")
def _(spark, d):
    return M.locate_region(A.voxels(spark, d), A.atlas(spark), ["patient_id", "study", "obs"])


@query("split_hemispheres", ctes("voxels").rstrip() + """,
a AS (SELECT patient_id, study, obs, x, y, z, [3, 10, 800, 850, 900][x % 5 + 1] AS label, CASE WHEN y = 0 THEN NULL ELSE z % 4 END AS hemisphere FROM voxels)
SELECT patient_id, label + CASE WHEN label IN (3, 800, 850, 900) AND coalesce(hemisphere, 0) % 2 = 0 THEN 1 ELSE 0 END AS label, count(*) AS n FROM a GROUP BY ALL""")
def _(spark, d):
    v = A.voxels(spark, d)
    a = v.withColumn("label", F.get(F.array(*[F.lit(x) for x in (3, 10, 800, 850, 900)]), F.col("x") % 5))
    h = v.where("y <> 0").select("x", "y", "z", (F.col("z") % 4).alias("hemisphere")).distinct()
    return M.split_hemispheres(a, h).groupBy("patient_id", "label").agg(F.count(F.lit(1)).alias("n"))


@query("split_hemisphere_names", "WITH n AS (SELECT DISTINCT CASE WHEN l_suppkey % 2 = 0 THEN 800 ELSE l_suppkey END AS label FROM lineitem) SELECT label, 'region ' || label AS name FROM n WHERE label NOT IN (3, 800, 850, 900) UNION ALL SELECT label, 'R. region ' || label FROM n WHERE label IN (3, 800, 850, 900) UNION ALL SELECT label + 1, 'L. region ' || label FROM n WHERE label IN (3, 800, 850, 900)")
def _(spark, d):
    n = A.read(spark, d, "lineitem").select(F.when(F.col("l_suppkey") % 2 == 0, 800).otherwise(F.col("l_suppkey")).alias("label")).distinct()
    return M.split_names(n.withColumn("name", F.concat(F.lit("region "), F.col("label").cast("string"))))


# ---- joins

@query("enrich_clinical", "SELECT e.event_id, c.c_mktsegment AS sex, n.n_name AS location, c.c_acctbal AS weight FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey")
def _(spark, d):
    c = A.read(spark, d, "customer").join(A.read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select(F.concat(F.lit("PAT"), F.col("c_custkey").cast("string")).alias("patient_id"), F.col("c_mktsegment").alias("sex"), F.col("n_name").alias("location"), F.col("c_acctbal").alias("weight"))
    e = A.read(spark, d, "events").select("event_id", F.concat(F.lit("PAT-"), F.col("user_id").cast("string")).alias("patient_id"))
    return T.enrich_clinical(e, c).select("event_id", "sex", "location", "weight")


@query("overlay_columns", "SELECT o_orderkey, o_totalprice, q AS o_orderstatus FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linestatus) AS q FROM lineitem WHERE l_quantity > 40 GROUP BY 1) ON l_orderkey = o_orderkey")
def _(spark, d):
    b = A.read(spark, d, "lineitem").where("l_quantity > 40").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("o_orderstatus"))
    return T.overlay_columns(A.read(spark, d, "orders"), b, "o_orderkey").select("o_orderkey", "o_totalprice", "o_orderstatus")


LEGACY_DAYS = [60 * t for t in range(STEPS + 1)]


def legacy(spark, d, value: str):
    g = A.grid(spark, d).withColumn("id", F.concat_ws(":", F.col("patient_id").cast("string"), "lesion_id"))
    return g.groupBy("id").agg(*[F.max(F.when(F.col("t") == t, F.col(value))).alias(str(day)) for t, day in enumerate(LEGACY_DAYS)])


@query("merge_legacy_tables", ctes("grid") + "SELECT patient_id || ':' || lesion_id AS id, " + ", ".join(f"max(CASE WHEN t = {t} THEN {v} END) AS t{t}_{v}" for v in ("volume", "rano") for t in range(STEPS + 1)) + ", " + ", ".join(f"{day} AS t{t}_timedelta_days" for t, day in enumerate(LEGACY_DAYS)) + " FROM grid GROUP BY patient_id, lesion_id")
def _(spark, d):
    return T.merge_legacy_tables(legacy(spark, d, "volume"), legacy(spark, d, "rano"), "id", LEGACY_DAYS)


@query("lookup_mapping", "SELECT s_suppkey, n_name AS dataset, r_name AS uid FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    n = A.read(spark, d, "nation").join(A.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("dataset"), F.col("r_name").alias("uid"))
    return U.lookup_mapping(A.read(spark, d, "supplier"), n, "s_nationkey", "n_nationkey", ["dataset", "uid"]).select("s_suppkey", "dataset", "uid")


# ---- projections and encodings

WIDE = ["volume", "rano", "timedelta_days"]


def wide(spark, d):
    g = A.grid(spark, d)
    w = T.wide_features(g, K, "t", list(range(STEPS + 1)), WIDE)
    return w.withColumn("id", C.compose_id(F.col("patient_id"), F.col("lesion_id"))).drop(*K)


WIDE_SQL = ctes("grid").rstrip() + ",\nwide AS (SELECT patient_id || ':' || lesion_id AS id, " + ", ".join(f"max(CASE WHEN t = {t} THEN {f} END) AS t{t}_{f}" for t in range(STEPS + 1) for f in WIDE) + " FROM grid GROUP BY patient_id, lesion_id)\n"


@query("wide_features", WIDE_SQL + "SELECT * FROM wide")
def _(spark, d):
    return wide(spark, d)


@query("select_features", WIDE_SQL + "SELECT id, t0_volume, t1_volume, t0_timedelta_days, t1_timedelta_days, t6_rano FROM wide")
def _(spark, d):
    w = wide(spark, d)
    return w.select(T.select_features(w.columns, ["volume"], [0, 1], ["t6_rano"], ["id"], days=True))


@query("drop_feature_suffixes", WIDE_SQL + "SELECT id, " + ", ".join(f"t{t}_{f}" for t in range(STEPS + 1) for f in ("rano", "timedelta_days")) + " FROM wide")
def _(spark, d):
    w = wide(spark, d)
    return w.select(T.drop_feature_suffixes(w.columns, ["_volume", "_days"]))


@query("to_numeric", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN props ELSE value::VARCHAR END AS DOUBLE) AS number FROM events")
def _(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(F.col("value").cast("string"))
    return A.read(spark, d, "events").select("event_id", C.to_numeric(text).alias("number"))


@query("fill_missing", WIDE_SQL + "SELECT id, t0_volume AS init_volume, coalesce(TRY_CAST(t1_rano AS DOUBLE), -1.0) AS t1_rano, coalesce(t1_volume, -1.0) AS t1_volume FROM wide")
def _(spark, d):
    w = wide(spark, d).withColumns({"init_volume": F.col("t0_volume"), "t1_rano": C.to_numeric(F.col("t1_rano"))})
    return T.fill_missing(w, -1.0, ["t1_rano", "t1_volume"]).select("id", "init_volume", "t1_rano", "t1_volume")


@query("encode_response", ctes("grid") + "SELECT patient_id, lesion_id, t, CASE rano WHEN 'CR' THEN 0 WHEN 'PR' THEN 1 WHEN 'SD' THEN 2 WHEN 'PD' THEN 3 END AS multiclass, CASE rano WHEN 'CR' THEN 0 WHEN 'PR' THEN 0 WHEN 'SD' THEN 1 WHEN 'PD' THEN 1 END AS binary_, CASE rano WHEN 'CR' THEN 0 WHEN 'PR' THEN 1 WHEN 'SD' THEN 1 WHEN 'PD' THEN 1 END AS one_v3, CASE rano WHEN 'CR' THEN 0 WHEN 'PR' THEN 0 WHEN 'SD' THEN 0 WHEN 'PD' THEN 1 END AS sota FROM grid")
def _(spark, d):
    return A.grid(spark, d).select(*K, "t", *[C.encode_response(F.col("rano"), s).alias(n) for s, n in (("multiclass", "multiclass"), ("binary", "binary_"), ("1v3", "one_v3"), ("sota", "sota"))])


@query("encode_onehot", "SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{s}')::INTEGER AS c_mktsegment_{s}" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer")
def _(spark, d):
    return T.encode_onehot(A.read(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query("encode_ordinal", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority)::INTEGER AS code FROM orders")
def _(spark, d):
    return T.encode_ordinal(A.read(spark, d, "orders"), "o_orderpriority", "code").select("o_orderkey", "code")


TERMS = {"Poumon": "Lung", "Sein": "Breast", "Rein": "Kidney"}


@query("clean_clinical", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Lung' WHEN 3 THEN 'Breast' WHEN 5 THEN 'Kidney' END AS location, event_type AS kind, CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id % 90)::DOUBLE END AS age FROM events")
def _(spark, d):
    e = A.read(spark, d, "events")
    raw = F.get(F.array(*[F.lit(x) for x in ("['Poumon']", "['nan']", "[nan]", "Sein", "['other']", "['Rein']")]), (F.col("event_id") % 6).cast("int"))
    age = F.when(F.col("event_id") % 7 == 0, "[]").otherwise(F.concat((F.col("event_id") % 90).cast("string"), F.lit("Y")))
    rows = e.select("event_id", raw.alias("location"), F.concat(F.lit("['"), "event_type", F.lit("']")).alias("kind"), age.alias("age"))
    return T.clean_clinical(rows, {"location": TERMS}, "age")


@query("quantile_subsets", ctes("series") + "SELECT patient_id, lesion_id, CASE WHEN volume <= q[1] THEN 1 WHEN volume <= q[2] THEN 2 WHEN volume <= q[3] THEN 3 ELSE 4 END AS subset FROM series, (SELECT quantile_cont(volume, [0.25, 0.5, 0.75]) AS q FROM series WHERE t = 0) WHERE t = 0")
def _(spark, d):
    return T.quantile_subsets(A.series(spark, d).where("t = 0"), "volume").select(*K, "subset")


@query("size_histogram", ctes("observations") + "SELECT s AS size, count(volume) AS n FROM generate_series(0, 39) g(s) LEFT JOIN observations ON volume = s GROUP BY s")
def _(spark, d):
    return T.size_histogram(M.observations(A.voxels(spark, d)), "volume", 40)


# ---- aggregations

@query("patient_metadata", ctes("order_series") + f"SELECT patient_id, min(ts) AS first_study, max(ts) AS last_study, {A.DAYS('max(ts)', 'min(ts)')} AS observation_days, count(DISTINCT ts) AS studies, round({A.DAYS('max(ts)', 'min(ts)')}::DOUBLE / count(DISTINCT ts), 6) AS average_interval, count(DISTINCT lesion_id) AS lesions FROM order_series GROUP BY patient_id")
def _(spark, d):
    m = U.patient_metadata(A.order_series(spark, d))
    return m.withColumn("average_interval", F.round("average_interval", 6))


@query("first_known_attributes", "WITH e AS (SELECT user_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS sex, CASE WHEN event_id % 4 = 0 THEN value END AS weight, ts, event_id FROM events) SELECT user_id AS patient_id, arg_min(sex, (ts, event_id)) FILTER (sex IS NOT NULL) AS sex, arg_min(weight, (ts, event_id)) FILTER (weight IS NOT NULL) AS weight, round((40 + arg_min(event_id % 50, (ts, event_id)) + 41 + arg_max(event_id % 50, (ts, event_id))) / 2.0, 6) AS age FROM e GROUP BY user_id")
def _(spark, d):
    e = A.read(spark, d, "events").withColumns({"sex": F.when(F.col("event_id") % 3 == 0, F.col("event_type")), "weight": F.when(F.col("event_id") % 4 == 0, F.col("value"))})
    e = e.select(F.col("user_id").alias("patient_id"), "sex", "weight", (F.col("event_id") % 50).alias("age"), "ts", "event_id")
    order = ["ts", "event_id"]
    ages = U.onset_offset(e, "patient_id", "age", order).select("patient_id", F.round((40 + F.col("onset") + 41 + F.col("offset_")) / 2, 6).alias("age"))
    return U.first_known_attributes(e, "patient_id", order, ["sex", "weight"]).join(ages, "patient_id")


@query("lesions_per_patient_hist", ctes("series") + "SELECT k AS lesions, count(n) AS patients FROM generate_series(0, (SELECT max(n) FROM (SELECT count(*) AS n FROM series WHERE t = 0 AND volume > 0 GROUP BY patient_id))) g(k) LEFT JOIN (SELECT count(*) FILTER (t = 0 AND volume > 10) AS n FROM series GROUP BY patient_id) ON n = k GROUP BY k")
def _(spark, d):
    first = F.col("t") == 0
    return U.lesions_per_patient_hist(A.series(spark, d), first & (F.col("volume") > 10), first & (F.col("volume") > 0))


@query("count_disparity", "WITH s AS (SELECT user_id, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS a, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS b FROM events GROUP BY user_id) SELECT sum(CASE WHEN a < b THEN a - b ELSE 0 END)::BIGINT AS negative, count(*) FILTER (a = b) AS equal, sum(CASE WHEN a > b THEN a - b ELSE 0 END)::BIGINT AS positive FROM s")
def _(spark, d):
    e = A.read(spark, d, "events")
    return U.count_disparity(e, "user_id", F.expr("ts < '2024-01-16'"), F.expr("ts >= '2024-01-16'"))


@query("demographics", "SELECT c_mktsegment AS sex, count(DISTINCT c_custkey) AS patients, round(avg(c_acctbal), 6) AS mean, round(quantile_cont(c_acctbal, 0.5), 6) AS median, round(stddev_samp(c_acctbal), 6) AS std FROM customer GROUP BY 1")
def _(spark, d):
    g = U.demographics(A.read(spark, d, "customer").withColumnRenamed("c_mktsegment", "sex"), ["sex"], "c_acctbal", "c_custkey")
    return g.select("sex", "patients", *r6("mean", "median", "std"))


@query("demographics_counts", "SELECT c_mktsegment AS sex, n_name AS value, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def _(spark, d):
    return A.read(spark, d, "customer").join(A.read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("c_mktsegment").alias("sex"), F.col("n_name").alias("value")).agg(F.count(F.lit(1)).alias("n"))


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("describe_features", " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS low, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS high FROM lineitem" for c in NUMBERS))
def _(spark, d):
    return U.describe_features(A.read(spark, d, "lineitem"), NUMBERS).select("feature", "n", *r6("mean", "std"), "low", *r6("q25", "q50", "q75"), "high")


@query("distinct_patients", "SELECT DISTINCT user_id AS patient_id FROM events")
def _(spark, d):
    return U.distinct_patients(A.series(spark, d))


# ---- reshaping

#: A part for each event type, with a column of its own.
PARTS = ["click", "error", "purchase", "signup", "view"]


@query("combine_patients", "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS n_{k}" for k in PARTS) + " FROM events GROUP BY user_id, event_type")
def _(spark, d):
    """Ragged parts, one of each event type: a part has no column of another; what it lacks counts as 0."""
    e = A.read(spark, d, "events")
    part = lambda k: e.where(F.col("event_type") == k).groupBy("user_id").agg(F.count(F.lit(1)).alias(f"n_{k}"))
    return io.combine([part(k) for k in PARTS]).select("user_id", *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in PARTS])


@query("combine_folds", ctes("predictions") + "SELECT model, config, fold, id FROM predictions")
def _(spark, d):
    p = A.predictions(spark, d)
    return io.combine([p.where(F.col("fold") == k) for k in range(5)]).select("model", "config", "fold", "id")


@query("concat_train_test", f"SELECT c_custkey, {DRAW('1', 'c_custkey')} % 5 = 0 AS is_test FROM customer")
def _(spark, d):
    c = A.read(spark, d, "customer").withColumn("is_test", C.draw(1, F.col("c_custkey")) % 5 == 0).select("c_custkey", "is_test")
    return io.combine([c.where("not is_test"), c.where("is_test")])


@query("wide_to_long", WIDE_SQL + "SELECT id AS subject, time, value FROM (" + " UNION ALL ".join(f"SELECT id, {t} AS time, t{t}_volume AS value FROM wide" for t in range(STEPS + 1)) + ")")
def _(spark, d):
    w = wide(spark, d)
    return T.wide_to_long(w, "id", [f"t{t}_volume" for t in range(STEPS + 1)])


def _stack(shift: int) -> str:
    return WIDE_SQL + " UNION ALL ".join(f"SELECT id, {t} AS t, t{t}_volume AS volume, t{t}_timedelta_days AS timedelta_days, t{t + shift}_rano AS rano FROM wide" for t in range(STEPS))


@query("stack_timepoints", _stack(0))
def _(spark, d):
    return T.stack_timepoints(wide(spark, d), "id", list(range(STEPS + 1)), ["volume", "timedelta_days"])


@query("stack_timepoints_next", _stack(1))
def _(spark, d):
    return T.stack_timepoints(wide(spark, d), "id", list(range(STEPS + 1)), ["volume", "timedelta_days"], shift=True)


@query("trajectory_array", ctes("grid") + "SELECT patient_id, lesion_id, string_agg(round(volume, 2)::DECIMAL(18, 2)::VARCHAR, ',' ORDER BY t) AS trajectory FROM grid GROUP BY ALL")
def _(spark, d):
    a = T.trajectory_array(A.grid(spark, d), K, "t", "volume")
    return a.select(*K, F.array_join(F.transform("trajectory", lambda x: x.cast("decimal(18,2)").cast("string")), ",").alias("trajectory"))


@query("flatten_vectors", "SELECT vec_id, " + ", ".join(f"round(embedding[{j + 1}]::DOUBLE, 6) AS t0_deep_{j}" for j in range(64)) + " FROM embeddings")
def _(spark, d):
    e = A.read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return T.flatten_vectors(e, "e", 64, "t0_deep").select("vec_id", *r6(*[f"t0_deep_{j}" for j in range(64)]))


# ---- scaling

@query("standardize_columns", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round((l.{c} - m.{c}) / greatest(s.{c}, 1e-6), 6) AS {c}" for c in NUMBERS) + " FROM lineitem l, (SELECT " + ", ".join(f"avg({c}) AS {c}" for c in NUMBERS) + " FROM lineitem WHERE l_orderkey % 5 <> 0) m, (SELECT " + ", ".join(f"stddev_samp({c}) AS {c}" for c in NUMBERS) + " FROM lineitem WHERE l_orderkey % 5 <> 0) s")
def _(spark, d):
    v = A.read(spark, d, "lineitem")
    stats = T.standardize_columns(v.where("l_orderkey % 5 <> 0"), NUMBERS)
    return T.apply_standardization(v, stats, NUMBERS, 0.0).select("l_orderkey", "l_linenumber", *r6(*NUMBERS))


VOLUMES = [f"t{t}_volume" for t in range(STEPS + 1)]


def normalized(spark, d, chain: str):
    w = wide(spark, d).select("id", *VOLUMES).withColumn("test", C.draw(3, F.col("id")) % 5 == 0)
    return T.normalize_volume(w.where("not test"), w.where("test"), chain, VOLUMES)


@query("normalize_volume", WIDE_SQL.rstrip() + f""",
v AS (SELECT id, {DRAW('3', 'id')} % 5 = 0 AS test, unnest([{", ".join(f"ln(1 + {c})" for c in VOLUMES)}]) AS v, unnest(generate_series(0, {STEPS})) AS t FROM wide),
s AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM v WHERE NOT test)
SELECT id, test, {", ".join(f"round(max(CASE WHEN t = {t} THEN (v - m) / s END), 6) AS t{t}_volume" for t in range(STEPS + 1))} FROM v, s GROUP BY ALL""")
def _(spark, d):
    return io.combine([*normalized(spark, d, "log->std")]).select("id", "test", *r6(*VOLUMES))


@query("denormalize_volume", WIDE_SQL + f"SELECT id, {DRAW('3', 'id')} % 5 = 0 AS test, " + ", ".join(f"round({c}, 4) AS {c}" for c in VOLUMES) + " FROM wide")
def _(spark, d):
    """What a chain of four steps made, made back."""
    both = io.combine([*normalized(spark, d, "frac->3root->log->max")])
    return both.select("id", "test", *[F.round(T.denormalize_volume(F.col(c), F.col("decoder")), 4).alias(c) for c in VOLUMES])


@query("node_features", ctes("grid") + "SELECT patient_id, lesion_id, t, CASE WHEN t = 6 THEN -1.0 ELSE round(volume, 6) END AS f0, CASE WHEN t = 6 THEN -1.0 ELSE 0.0 END AS f1, CASE WHEN t = 6 THEN -1.0 ELSE patient_id::DOUBLE END AS f2 FROM grid")
def _(spark, d):
    n = T.masked_target_node(T.node_features(A.grid(spark, d), ["volume", "lesion_id", "patient_id"]), 6)
    return n.select(*K, "t", *[F.round(F.get("features", F.lit(i)), 6).alias(f"f{i}") for i in range(3)])
