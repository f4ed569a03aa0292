"""Comparison of documents with an earlier state, and index metadata."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.functions.text import content_hash

SCHEMA_VERSION = "2.0"


def hashes(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select("id", content_hash("title", F.col("text")).alias("content_hash"), *more)


def diff(docs: DataFrame, old: DataFrame) -> DataFrame:
    """(id, status): added, modified, unchanged or removed, by content hash against (id, content_hash)."""
    return compare(hashes(docs), old)


def compare(new: DataFrame, old: DataFrame) -> DataFrame:
    """(id, status) of two states (id, content_hash)."""
    new, was = new.select("id", F.col("content_hash").alias("new")), old.select("id", F.col("content_hash").alias("old"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("modified")
    return new.join(was, "id", "full_outer").select("id", status.alias("status"))


def counts(statuses: DataFrame) -> DataFrame:
    """One row: documents of each status, embeddings needed, whether anything changed."""
    n = {s: F.count_if(F.col("status") == s).alias(s) for s in ("added", "modified", "removed", "unchanged")}
    return statuses.agg(*n.values()).select(*n, (F.col("added") + F.col("modified")).alias("embeddings_needed"), (F.col("added") + F.col("modified") + F.col("removed") > 0).alias("has_changes"))


def needing_embedding(docs: DataFrame, statuses: DataFrame) -> DataFrame:
    """Added documents, then modified ones."""
    return docs.join(statuses.where(F.col("status").isin("added", "modified")), "id").select(*docs.columns, "status")


def apply_changes(rows: DataFrame, fresh: DataFrame, statuses: DataFrame, key: str) -> DataFrame:
    """Rows derived from documents brought up to date: those of removed and modified documents go, ``fresh`` ones of added and modified documents come."""
    stale = statuses.where(F.col("status").isin("removed", "modified")).select(F.col("id").alias(key))
    return rows.join(stale, key, "left_anti").select(*rows.columns).unionByName(fresh.select(*rows.columns))


def needs_full_rebuild(version) -> Column:
    """Whether a schema version is missing, unreadable or below two."""
    return F.coalesce(F.col(version).try_cast("double"), F.lit(0.0)) < 2.0


def version_needs_rebuild(version: str | None) -> bool:
    """The same of a version at hand."""
    try:
        return float(version or 0) < 2.0
    except ValueError:
        return True


def metadata(docs: DataFrame, created_at: str, embedding_model: str | None = None, version: str = SCHEMA_VERSION) -> DataFrame:
    """One row that describes an index. Hashes stay a table of their own (see ``hashes``)."""
    return docs.agg(F.count(F.lit(1)).alias("doc_count")).select("doc_count", F.lit(created_at).alias("created_at"), F.lit(embedding_model).cast("string").alias("embedding_model"), F.lit(version).alias("schema_version"))


def update_hashes(old: DataFrame, changed: DataFrame) -> DataFrame:
    """Hashes with those of ``changed`` put in or replaced."""
    return old.join(changed.select("id"), "id", "left_anti").select("id", "content_hash").unionByName(changed.select("id", "content_hash"))


def remove_hashes(old: DataFrame, gone: DataFrame) -> DataFrame:
    return old.join(gone.select("id"), "id", "left_anti").select("id", "content_hash")
