"""What the operators share: reading, cutting lineage, Arrow helpers and word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def local_dir() -> str:
    """The temporary folder of local sessions that name none."""
    return tempfile.mkdtemp(prefix="spark-shared-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which the session names; a local session without one gets a temporary
    folder. A running session's setting can't be changed, so the folder is kept here."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = local_dir()
    return d.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there, so a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/lachesis-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes the files of a table that stored() wrote and that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def with_fields(schema: T.StructType, fields: str) -> T.StructType:
    """schema with more fields, given as `name type, ...`."""
    return T.StructType([*schema.fields, *T.DataType.fromDDL(fields).fields])


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns that the operator is about to add, whatever their letter case."""
    low = {n.lower() for n in names}
    return df.select([df[f"`{c}`"] for c in df.columns if c.lower() not in low])


def unused(df: DataFrame, name: str) -> str:
    """A name for a helper column that no column of df has, whatever its letter case."""
    low = {c.lower() for c in df.columns}
    while name.lower() in low:
        name = "_" + name
    return name


#: Rows that a function of Arrow batches gets at once.
PIECE = 1000


def append_arrow(df: DataFrame, fields: list[T.StructField], fn: Callable[[pa.RecordBatch], list[pa.Array]], keep: list[str] | None = None) -> DataFrame:
    """df[keep] with the columns that fn computes from each Arrow batch; input columns of the same names go. Column names may hold
    anything, dots included: Spark sees numbered ones on the way in, and fn the real ones."""
    names = df.columns
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    schema = T.StructType([df.schema[c] for c in kept] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.rename_columns(names)
            # Small pieces keep what fn makes small, whatever the session's batch size.
            for at in range(0, whole.num_rows, PIECE):
                batch = whole.slice(at, PIECE)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *fn(batch)], names=schema.names)

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, schema)


def require_integer(df: DataFrame, *columns: str) -> None:
    """Refuses ids of other types by name, before any job runs."""
    for c in columns:
        if not isinstance(df.schema[c].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            raise TypeError(f"{c} must be an integer column, not {df.schema[c].dataType.simpleString()}")


def raw(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist() if column.type != pa.binary() else column.to_pylist()


#: A-Z to a-z, all else as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a fixed number of words."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


#: Odd multipliers, one for each place of a shingle, and those of the final mix.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def shingles(words: list[bytes], k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence where it is shorter; none for no words."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    k = min(n, k)
    s = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        s = s + h[i : n - k + 1 + i] * PLACES[i]
    return np.unique(mix(s))


def total_bytes(df: DataFrame, column: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0
