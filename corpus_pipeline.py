"""A corpus in five stages, each an operator of ``faultline.llm``; each stage is written and read again.

Quality rules drop documents, near duplicates keep one document of each group (five-word shingles,
similarity 0.8 or more), benchmark passages are cut out (a document that is mostly passage goes),
secrets are replaced by a mark, and what is left is encoded. All stages but the last return the columns
of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import bpe, decontaminate, neardup, quality, secrets
from faultline.llm.common import checkpoint_dir, table


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the forest reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id; unlike texts of one id stay apart."""
    return neardup.keep_first(docs, neardup.LOOSE)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; documents that are half passage or more go."""
    return _counted(decontaminate.remove(docs, table(spark, sf_dir, "benchmark", "item_id", "text")))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text becomes a mark."""
    return _counted(secrets.redact(docs))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of what is left."""
    return bpe.encode(docs, bpe.default_path())


STAGES = [
    ("quality", quality_stage),
    ("neardup", neardup_stage),
    ("decontaminate", decontamination_stage),
    ("secrets", secrets_stage),
    ("encode", encoding_stage),
]

#: SQL cannot express the forest or the tokenizer; the tests hold every stage against a brute-force version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written under the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
