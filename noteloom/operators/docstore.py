"""The document store and its queries."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.functions.text import content_hash, has_tag


def with_content_ids(docs: DataFrame) -> DataFrame:
    """Documents identified by their content: the same title and text, the same id."""
    return docs.withColumn("id", content_hash("title", F.col("text")))


def with_random_ids(docs: DataFrame) -> DataFrame:
    """Documents under new random ids. They differ each time that the frame is computed, so store it before use."""
    return docs.withColumn("id", F.expr("uuid()"))


def get(docs: DataFrame, doc_id: str) -> DataFrame:
    return docs.where(F.col("id") == doc_id)


def contains(docs: DataFrame, doc_id: str) -> bool:
    return not get(docs, doc_id).isEmpty()


def upsert(docs: DataFrame, *more: DataFrame) -> DataFrame:
    """One document per id; later frames win over earlier ones, and later order within a frame."""
    versions = docs.withColumn("version", F.lit(0))
    for k, frame in enumerate(more):
        versions = versions.unionByName(frame.withColumn("version", F.lit(k + 1)))
    # A maximum is partly taken before the shuffle, so an id with very many versions costs no more than another.
    row = F.struct(*(c for c in versions.columns))
    return versions.groupBy("id").agg(F.max_by(row, F.struct("version", "doc_ord")).alias("row")).select(*(f"row.{c}" for c in docs.columns))


def latest(docs: DataFrame) -> DataFrame:
    """``upsert`` of one frame, in which only documents whose id occurs more than once are shuffled."""
    twice = docs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    if twice.isEmpty():
        return docs
    return docs.join(twice, "id", "left_anti").select(*docs.columns).unionByName(upsert(docs.join(twice, "id", "left_semi").select(*docs.columns)))


def remove(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the documents whose id is among ``ids`` (id)."""
    return docs.join(ids.select("id").distinct(), "id", "left_anti").select(*docs.columns)


def by_tag(docs: DataFrame, tag: str) -> DataFrame:
    return docs.where(has_tag("tags", tag))


def all_tags(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def tag_counts(docs: DataFrame) -> DataFrame:
    """Documents per tag; a tag repeated within one document counts once."""
    return docs.select(F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n_docs"))


def recent(docs: DataFrame, n: int) -> DataFrame:
    """The newest n documents; ties go by id."""
    return docs.orderBy(F.desc("date"), "id").limit(n)


def ids(docs: DataFrame) -> DataFrame:
    return docs.select("id")


def size(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n_docs")).select("n_docs", (F.col("n_docs") == 0).alias("is_empty"))
