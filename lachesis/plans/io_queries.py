"""Sources and sinks: what was written comes back, checked against the tables it was made from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..sources import io
from . import adapters as A
from .adapters import ctes
from .table_queries import NUMBERS, REPORT, WIDE_SQL, report, wide

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


@query("write_features", WIDE_SQL + "SELECT id, t0_volume, t3_rano, t6_timedelta_days FROM wide")
def _(spark, d):
    path = io.scratch(spark)
    io.write_features(wide(spark, d), path, "parquet")
    return io.read_features(spark, path, kind="parquet").select("id", "t0_volume", "t3_rano", "t6_timedelta_days")


@query("read_features", WIDE_SQL + "SELECT id, round(t0_volume, 2) AS t0_volume, t1_rano FROM wide")
def _(spark, d):
    path = io.scratch(spark)
    io.write_features(wide(spark, d).select(F.col("id").alias("Lesion ID"), F.round("t0_volume", 2).alias("t0_volume"), "t1_rano"), path)
    return io.read_features(spark, path, "`Lesion ID` string, t0_volume double, t1_rano string").withColumnRenamed("Lesion ID", "id")


@query("save_series", ctes("series") + "SELECT patient_id, lesion_id, t, timedelta_days, round(volume, 6) AS volume FROM series")
def _(spark, d):
    path = io.scratch(spark)
    # Points of one instant keep their order by event: series have none in these tables.
    io.save_series(A.series(spark, d).withColumn("is_interpolated", F.lit(False)), path)
    return io.load_series(spark, path).select("patient_id", "lesion_id", "t", "timedelta_days", F.round("volume", 6).alias("volume"))


#: Models are the configurations of the written tree, so both of them come back.
PREDICTED = ctes("predictions") + "SELECT id::VARCHAR AS id, prediction::VARCHAR AS prediction, {target} AS target, round(confidence, 6) AS confidence, model AS config, fold FROM predictions"


def predicted(spark, d):
    p = A.predictions(spark, d)
    return p.select(F.col("model").alias("config"), "fold", F.col("id").cast("string"), F.col("prediction").cast("string"), F.col("target").cast("string"), F.round("confidence", 6).alias("confidence"))


def _folds(layout: str):
    def run(spark, d):
        root = io.scratch(spark)
        p = io.stored(predicted(spark, d))
        for r in p.select("config", "fold").distinct().collect():
            part = p.where((F.col("fold") == r.fold) & (F.col("config") == r.config)).select("id", "prediction", "target", "confidence")
            part.write.option("header", True).csv(f"{root}/{r.config}/Fold {r.fold}/assignments.csv" if layout == "config/fold" else f"{root}/Fold {r.fold}/{r.config}/assignments.csv")
        return io.read_fold_predictions(spark, root, layout, {"0": "clean", "1": "toxic"})

    return run


for _layout, _name in (("config/fold", "read_fold_predictions"), ("fold/config", "read_fold_predictions_by_fold")):
    query(_name, PREDICTED.format(target="CASE target WHEN 0 THEN 'clean' ELSE 'toxic' END"))(_folds(_layout))


@query("write_predictions", PREDICTED.format(target="target::VARCHAR"))
def _(spark, d):
    """Every prediction that was written."""
    path = io.scratch(spark)
    io.write_predictions(predicted(spark, d), path)
    return spark.read.option("header", True).schema("id string, prediction string, target string, confidence double, config string, fold int").csv(path)


@query("write_standardization", " UNION ALL ".join(f"SELECT f::INTEGER AS fold, '{c}' AS \"column\", round(avg({c}), 4) AS mean, round(greatest(stddev_samp({c}), 1e-6), 4) AS std FROM lineitem, generate_series(0, 4) g(f) WHERE l_orderkey % 5 <> f GROUP BY f" for c in NUMBERS))
def _(spark, d):
    path = io.scratch(spark)
    io.write_standardization(E.fold_standardize(A.read(spark, d, "lineitem").withColumn("fold", (F.col("l_orderkey") % 5).cast("int")), NUMBERS), path)
    return spark.read.option("header", True).csv(path).select(F.col("fold").cast("int").alias("fold"), "column", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("mean", "std")])


@query("write_match_report", REPORT + "SELECT * FROM report")
def _(spark, d):
    """The written report, read back: every column of every patient."""
    path = io.scratch(spark)
    io.write_match_report(report(spark, d), path)
    back = io.read_match_report(spark, path)
    return back.select(*[F.to_json(c).alias(c) if t.startswith(("map", "array")) else F.col(c) for c, t in back.dtypes])


@query("cached_prepare", ctes("grid") + "SELECT t, count(*) AS n FROM grid GROUP BY t")
def _(spark, d):
    path = io.scratch(spark)
    prepare = lambda: io.cached_prepare(spark, path, lambda: A.grid(spark, d))
    prepare()
    return prepare().groupBy("t").agg(F.count(F.lit(1)).alias("n"))
