"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

`statistics` maps each whole text to a vector of D transformed statistics. `fit` adds up, for each class, the count, the
sums and the sums of products over all labelled rows (workers add up, Spark sums D * D numbers a class), shrinks each
class covariance towards the pooled one (by `pool`), then towards its diagonal (by `shrink`), adds a ridge of 1 % of the mean
variance, and keeps the inverse of each Cholesky factor, so a score costs one product. `score` gives the posterior of class 1 from
the difference of the two Mahalanobis log-densities. The defaults of `pool` and `shrink` keep covariances of few labelled rows
regular; results hardly depend on them.

Nulls: a null text counts as empty; an empty text has a score like any other. Null labels and labels other than 0 and 1
are not learned from; with fewer than two labelled rows in a class the score is the share of class 1, or 0.5 without
labels. Repeated documents are scored alike; repeated labels weigh as often as they occur. Input columns with the names
of added ones are replaced. Empty tables give empty results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_arrow, raw, stored, table

#: Class of each byte: space, upper, lower, digit, symbol, sentence mark, exclamation, bar, other ASCII, beyond ASCII, newline.
KINDS = ["space", "upper", "lower", "digit", "symbol", "mark", "shout", "bar", "other", "high", "newline"]


def kind_of(b: int) -> int:
    c = chr(b)
    name = "newline" if b == 10 else "space" if c in " \t\x0b\x0c\r" else "high" if b > 127 else "upper" if c.isupper() else "lower" if c.islower() else "digit" if c.isdigit() else "shout" if c == "!" else "bar" if c == "|" else "symbol" if c in "#*$%&<>@^~_=+\\" else "mark" if c in ".,;:?" else "other"
    return KINDS.index(name)


KIND = np.array([kind_of(b) for b in range(256)], np.uint8)
NAMES = ["word_bytes", "upper", "digit", "symbol", "mark", "shout", "bar", "other", "newline", "repeated_lines", "top_word", "repeated_windows"]
D = len(NAMES)
#: Shares are smoothed as if a text went on with so many plain bytes, words, lines and windows, so short texts lie near the middle.
PRIOR_BYTES, PRIOR_WORDS, PRIOR_LINES, PRIOR_WINDOWS = 400, 60, 4, 40
#: Usual shares of bytes by kind, in running text.
USUAL = np.array([0.16, 0.02, 0.79, 0.0, 0.0, 0.02, 0.0, 0.0, 0.0, 0.005, 0.005])


def measure(text: bytes) -> list[float]:
    """The statistics of one text; shares are taken as square roots."""
    n = len(text)
    share = np.sqrt((np.bincount(KIND[np.frombuffer(text, np.uint8)], minlength=len(KINDS)) + PRIOR_BYTES * USUAL) / (n + PRIOR_BYTES))
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    windows = max(0, len(words) - 2)
    distinct = len(set(zip(words, words[1:], words[2:], strict=False))) if windows else 0
    top = max(Counter(words).values(), default=1) - 1
    at = dict(zip(KINDS, share.tolist(), strict=True))
    return [
        min(6.0, np.sqrt((n - len(words) + 6 * PRIOR_WORDS) / (len(words) + PRIOR_WORDS))), at["upper"], at["digit"], at["symbol"], at["mark"], at["shout"], at["bar"], at["other"], at["newline"],
        np.sqrt((len(lines) - len(set(lines))) / (len(lines) + PRIOR_LINES)), np.sqrt(top / (len(words) + PRIOR_WORDS)), np.sqrt((windows - distinct) / (windows + PRIOR_WINDOWS)),
    ]


def statistics(docs: DataFrame, text: str = "text", out: str = "stats", keep: list[str] | None = None) -> DataFrame:
    """docs[keep] with the vector of statistics of each whole text."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([[float(x) for x in measure(t or b"")] for t in raw(batch.column(text))], pa.list_(pa.float64()))]

    return append_arrow(docs, [T.StructField(out, T.ArrayType(T.DoubleType()))], run, keep)


@dataclass
class Discriminant:
    """For classes 0 and 1: mean, inverse of the Cholesky factor, log-determinant and log-prior; or only the share of class 1."""

    share: float
    mean: list[np.ndarray] | None = None
    whiten: list[np.ndarray] | None = None
    log_det: list[float] | None = None

    def posterior(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return np.full(len(x), self.share)
        density = [np.log(p) - d / 2 - (((x - m) @ w.T) ** 2).sum(axis=1) / 2 for m, w, d, p in zip(self.mean, self.whiten, self.log_det, (1 - self.share, self.share), strict=True)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(labelled: DataFrame, stats: str = "stats", label: str = "label", pool: float = 0.2, shrink: float = 0.05) -> Discriminant:
    """From all rows with label 0 or 1: class covariances mixed with the pooled one by `pool`, then with their diagonal by
    `shrink`."""
    rows = labelled.where(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("y"), F.col(stats).alias("x"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, D + 1, D + 1))
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            x = np.array(batch.column("x").to_pylist(), float).reshape(len(y), D)
            x = np.hstack([np.ones((len(y), 1)), x])
            for c in (0, 1):
                sums[c] += x[y == c].T @ x[y == c]
        c, i, j = np.indices(sums.shape).reshape(3, -1)
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)) for v in (c, i, j)] + [pa.array(sums.ravel())], names=["c", "i", "j", "s"])

    found = rows.mapInArrow(add, "c int, i int, j int, s double").groupBy("c", "i", "j").agg(F.sum("s").alias("s")).collect()
    sums = np.zeros((2, D + 1, D + 1))
    for r in found:
        sums[r.c, r.i, r.j] = r.s
    n = sums[:, 0, 0]
    if n.min() < 2:
        return Discriminant(float(n[1] / n.sum()) if n.sum() else 0.5)
    mean = [s[0, 1:] / s[0, 0] for s in sums]
    scatter = [s[1:, 1:] - s[0, 0] * np.outer(m, m) for s, m in zip(sums, mean, strict=True)]
    pooled = sum(scatter) / n.sum()
    whiten, log_det = [], []
    for s, k in zip(scatter, n, strict=True):
        cov = (1 - pool) * s / k + pool * pooled
        cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + (1e-4 + shrink * 0.01 * np.trace(cov) / D) * np.eye(D)
        low = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(low))
        log_det.append(float(2 * np.log(np.diag(low)).sum()))
    return Discriminant(float(n[1] / n.sum()), mean, whiten, log_det)


def score(df: DataFrame, model: Discriminant, stats: str = "stats", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """df[keep] with the posterior of class 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        x = np.array(batch.column(stats).to_pylist(), float).reshape(batch.num_rows, D)
        return [pa.array(shared.value.posterior(x), pa.float64())]

    return append_arrow(df, [T.StructField(out, T.DoubleType())], run, keep)


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learned from the labelled documents that are not held out."""
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5
    docs = stored(statistics(table(spark, sf_dir, "documents").select("doc_id", (remainder == 0).alias("held_out"), "text"), keep=["doc_id", "held_out"]))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = fit(docs.where(~F.col("held_out")).join(labels, "doc_id"))
    return score(docs, model, keep=["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


QUERIES = {"op4_quality_model": op4_quality_model}
ORACLES: dict[str, str] = {}
