"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

All but the last stage return the columns of documents. Rows that a stage rejects are gone for the later ones.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lachesis.llm import byte_bpe, decontaminate, near_dedup, quality_rules, secrets
from lachesis.llm.common import stored, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken")


def by_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the current policy rejects."""
    return quality_rules.accepted(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, 0.8), the document with the smallest id."""
    return near_dedup.deduplicated(docs, k=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every reported secret replaced by its kind."""
    return secrets.redacted(docs, chars="n_chars")


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    coded = byte_bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), TOKENIZER)
    same = F.coalesce(F.col("decoded") == F.encode("text", "UTF-8"), F.length("decoded") == 0)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality rules", by_quality_rules),
    ("MinHash near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("byte-level BPE", as_tokens),
]

#: Near-duplicate groups and tokens have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
