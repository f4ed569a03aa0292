"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

Rows that a stage rejects are gone for all later ones. The first four stages
return the columns of ``documents``, extra ones included; the last returns doc_id, lang, source,
n_tokens and ids.

Null and empty texts fail the quality rules. Rows that share an id count as one document among near
duplicates: they stay or go together, and each is judged on its own by the other stages. A row
without an id is never a duplicate. Very long texts are read whole by every stage. An empty table gives no rows.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

from noteloom.llm import bpe, decontaminate, pii, quality_rules, simhash
from noteloom.llm.common import ensure_checkpoint_dir, table
from pyspark.sql import DataFrame, SparkSession


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as token ids."""
    return bpe.bpe_encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("pii", private),
    ("tokens", tokens),
]

#: No SQL expresses the fingerprints, the walks or the merges; the tests compare stages with plain versions.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    """A stage's rows are of no use once the next one's are written."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, written in turn to a folder of this run in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _delete(spark, before)
        before = path
    return docs
