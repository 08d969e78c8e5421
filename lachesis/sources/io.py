"""Reading and writing of feature tables, studies, series, predictions and reports. All paths go through Spark's readers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import parse_session_ts
from .folders import StudyFolders, opened, passing_studies


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share, which the session names; a local session without one gets a
    temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
    return f"{root.rstrip('/')}/lachesis-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, which cuts its lineage."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_features(spark: SparkSession, path: str, schema: StructType | str | None = None, kind: str = "csv") -> DataFrame:
    """A wide feature table keyed by `Lesion ID`, with an explicit schema if given."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("header", True).csv(path) if kind == "csv" else reader.format(kind).load(path)


def write_features(df: DataFrame, path: str, kind: str = "csv", mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    (writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path))


def combine(parts: list[DataFrame]) -> DataFrame:
    """Ragged tables under the union of their columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_study_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(patient_id, study_ts, has_treatment) of the sessions under a directory tree that have an anat or rt folder. Executors list the
    patients' folders; the driver lists the root alone, and no file is opened."""
    spark.dataSource.register(StudyFolders)
    return studies_of(spark.read.format(StudyFolders.name()).load(root))


def read_passing_manifest(paths: DataFrame, path: str = "path") -> DataFrame:
    """The same for the tree of the folders that the rows name. The tree is made and read a piece at a time and never kept, so its
    folders need no disk in proportion to the rows."""
    return studies_of(passing_studies(paths, path))


def studies_of(sessions: DataFrame) -> DataFrame:
    return sessions.where("has_anat or has_rt").select("patient_id", parse_session_ts(F.col("session")).alias("study_ts"), F.col("has_rt").alias("has_treatment")).where("study_ts is not null")


def write_study_tree(paths: DataFrame, root: str, path: str = "path") -> None:
    """Makes the folders root/<path>, by the tasks that hold the rows; those that are there stay."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = opened(root)
        for b in batches:
            names = b.column(0).drop_null().to_pylist()
            for name in names:
                files.create_dir(f"{top}/{name}", recursive=True)
            yield pa.RecordBatch.from_arrays([pa.array([len(names)], pa.int64())], names=["n"])

    paths.select(F.col(path).cast("string").alias("path")).distinct().mapInArrow(make, "n long").agg(F.sum("n")).collect()


def read_fold_predictions(spark: SparkSession, root: str, layout: str = "config/fold", relabel: dict[str, str] | None = None) -> DataFrame:
    """Predictions of <config>/Fold k/assignments.csv or Fold k/<config>/assignments.csv; relabelled targets must all be known."""
    glob, at = ("*/Fold */assignments.csv", r"/([^/]+)/Fold (\d+)/assignments\.csv") if layout == "config/fold" else ("Fold */*/assignments.csv", r"/Fold (\d+)/([^/]+)/assignments\.csv")
    df = spark.read.option("header", True).schema("id string, prediction string, target string, confidence double").csv(f"{root}/{glob}")
    file = F.url_decode(F.col("_metadata.file_path"))
    config, fold = (1, 2) if layout == "config/fold" else (2, 1)
    df = df.select("*", F.regexp_extract(file, at, config).alias("config"), F.regexp_extract(file, at, fold).cast("int").alias("fold"))
    if relabel:
        known = F.create_map(*[F.lit(x) for kv in relabel.items() for x in kv])[F.col("target")]
        df = df.withColumn("target", F.when(known.isNull(), F.raise_error(F.concat(F.lit("unknown target "), F.coalesce("target", F.lit("null"))))).otherwise(known))
    return df


def write_predictions(df: DataFrame, path: str) -> None:
    """One folder a configuration and fold."""
    df.select("config", "fold", "id", "prediction", "target", "confidence").write.partitionBy("config", "fold").option("header", True).csv(path)


def save_series(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Series as a table clustered by patient: rows of a patient meet in one file of its bucket, so no file is tiny."""
    df.repartition("patient_id").sortWithinPartitions("patient_id", "lesion_id", "ts").write.mode(mode).parquet(path)


def load_series(spark: SparkSession, path: str) -> DataFrame:
    """Saved series in order, points of one instant in the order that they were saved with (`t`), or else of their other
    columns; one that mixes real and interpolated observations is an error."""
    from ..operators.series import index_timepoints, whole

    df = spark.read.parquet(path)
    df = df.withColumn("_tie", F.to_json(F.struct(*df.columns)) if "t" not in df.columns else F.col("t"))
    mixed = F.bool_or("is_interpolated").over(whole()) & ~F.bool_and("is_interpolated").over(whole())
    df = df.withColumn("_mixed", F.when(mixed, F.raise_error(F.concat(F.lit("mixed series "), F.concat_ws(":", "patient_id", "lesion_id"))).cast("boolean")).otherwise(F.lit(False)))
    return index_timepoints(df.where(~F.col("_mixed")).drop("_mixed", "t", "timedelta_days"), "_tie").drop("_tie")


def write_standardization(df: DataFrame, path: str) -> None:
    df.write.partitionBy("fold").option("header", True).csv(path)


def write_match_report(df: DataFrame, path: str) -> None:
    """Semicolon-separated; lists and maps as JSON."""
    flat: list[Column] = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.option("sep", ";").option("header", True).csv(path)


def read_match_report(spark: SparkSession, path: str, patient: str = "bigint", lesion: str = "string", label: str = "int") -> DataFrame:
    """A written match report, with the types of its ids and labels given."""
    lesions, labels = f"array<{lesion}>", f"array<{label}>"
    kinds = {
        "patient_id": patient, "labels_in_gt": "bigint", "parsed_mets": "bigint", "t0_nonzero_parsed_mets": "bigint", "matched_mets": f"map<string, {lesion}>",
        "unmatched_parsed_mets": lesions, "unmatched_gt_mets": labels, "ambiguous_parsed_matches": f"map<string, {lesions}>", "t0_zero_mets": lesions,
    }
    nested = [c for c, t in kinds.items() if t.startswith(("array", "map"))]
    df = spark.read.schema(", ".join(f"{c} {'string' if c in nested else t}" for c, t in kinds.items())).option("sep", ";").option("header", True).csv(path)
    df = df.withColumns({c: F.from_json(c, kinds[c]) for c in nested})
    # JSON has text keys only.
    return df.withColumns({c: F.transform_keys(c, lambda k, _: k.cast(label)) for c in nested if kinds[c].startswith("map")})


def cached_prepare(spark: SparkSession, path: str, compute) -> DataFrame:
    """The table at the path if it is there, else what compute() gives, saved there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    compute().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
