"""Keeps the searchable form of a note collection up to date.

A file stream takes the files that are new since the last run (its checkpoint knows them), in micro-batches. Of each batch
only notes that are new or whose content hash differs from the one last written are tokenised and written; notes without a text have been
withdrawn. A batch writes two tables, partitioned by its number:

* ``versions``: what the batch did to each note (added, modified, removed), with hash, title, tags, snippet and tokens;
* ``postings``: term, note and length, in ``bucket`` folders by hash of the term, sorted by term within a file.

Nothing that is there is ever changed: what is in force is the last version of each note. A batch that runs again, after a failure between its writes or
before its commit, compares itself with the batches before it only and replaces its own partitions, so it has the same result.

    python -m jobs.note_feed --config jobs/note_feed.toml --output /shared/feed --checkpoint /shared/feed-checkpoint
"""
from __future__ import annotations

import logging
import math
import sys
from dataclasses import dataclass

from jobs import settings
from noteloom.functions.text import content_hash
from noteloom.functions.tokens import tokens
from noteloom.operators import docstore, lexical
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

log = logging.getLogger("jobs.note_feed")
VERSION = "id string, doc_ord long, title string, tags array<string>, content_hash string, status string, snippet string, dl long, tokens array<string>, batch long"
POSTING = "term string, doc_ord long, doc_id string, tf long, dl long, batch long, bucket int"
SNIPPET = 150
#: Versions that are sent to all tasks at most, about 50 MB.
BROADCAST = 1_000_000
#: Postings that a task sorts at a time, about 400 MB.
SORTED = 4_000_000


@dataclass(frozen=True)
class Feed:
    """``source``: a folder of files with notes, or a pattern (also for a single file, as streams take no plain file). ``title`` and ``tags`` name columns; of notes with one id the greatest ``order`` counts within a batch."""

    source: str
    output: str
    checkpoint: str
    source_format: str = "parquet"
    id: str = "doc_id"
    order: str = "doc_id"
    text: str = "text"
    title: tuple[str, ...] = ("lang", "source")
    tags: tuple[str, ...] = ("lang", "source")
    buckets: int = 32
    files_per_batch: int = 1000


def notes(rows: DataFrame, feed: Feed) -> DataFrame:
    """Rows of the source as notes (id, title, tags, text, doc_ord). Rows without an id are left out."""
    tags = F.filter(F.array(*(F.col(c).cast("string") for c in feed.tags)), lambda t: t.isNotNull())
    title = F.concat_ws(" / ", *(F.col(c).cast("string") for c in feed.title))
    return rows.select(F.col(feed.id).cast("string").alias("id"), title.alias("title"), tags.alias("tags"), F.col(feed.text).cast("string").alias("text"), F.col(feed.order).cast("long").alias("doc_ord")).where("id is not null")


def versions(spark: SparkSession, output: str) -> DataFrame:
    """All versions written; none where the feed has not run."""
    return _table(spark, f"{output}/versions", VERSION)


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as failed:
        if failed.getCondition() != "PATH_NOT_FOUND":
            raise
        # Spark knows that this is empty when it plans, so a join with it costs nothing.
        return spark.range(1).where(F.lit(False)).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)))


def _last(rows: DataFrame, *columns: str) -> DataFrame:
    """The last version of each note, with some of its columns."""
    last = F.max_by(F.struct("batch", *columns), "batch").alias("last")
    return rows.groupBy("id").agg(last).select("id", "last.*")


def _in_force(rows: DataFrame, old: DataFrame | None, key: str) -> DataFrame:
    """Rows of versions, or of their postings, that later versions don't replace."""
    return rows if old is None else rows.join(old.withColumnRenamed("id", key), [key, "batch"], "left_anti")


def replaced(found: DataFrame) -> DataFrame | None:
    """(id, batch) of the versions that later ones replace; None if there are none. Ids and batches alone are shuffled."""
    last = found.groupBy("id").agg(F.max("batch").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "last")
    # What is few goes to all tasks, so that Spark doesn't shuffle the large side before it has measured this one.
    few = lambda rows, n: F.broadcast(rows) if n <= BROADCAST else rows
    if not (notes := last.count()):
        return None
    old = found.select("id", "batch").join(few(last, notes), "id").where("batch < last").select("id", "batch")
    return few(old, old.count())


def in_force(spark: SparkSession, output: str) -> tuple[DataFrame, DataFrame]:
    """The notes in force with their tokens, and their postings."""
    found = versions(spark, output)
    old = replaced(found)
    notes = _in_force(found, old, "id").where("status <> 'removed'").select("id", "batch", "doc_ord", "title", "tags", "content_hash", "status", "snippet", "dl", "tokens")
    return notes, _in_force(_table(spark, f"{output}/postings", POSTING), old, "doc_id")


def changes(batch: DataFrame, before: DataFrame) -> DataFrame:
    """Notes of a batch with what they do to the versions before it (added, modified, removed); those that change nothing are left out."""
    # Only notes that occur more than once in the batch are shuffled.
    new = docstore.latest(batch).withColumn("content_hash", content_hash("title", F.col("text")))
    # Only ids of the batch are looked up; Spark sends a small batch to the versions instead of shuffling them.
    known = _last(before.join(new.select("id"), "id", "left_semi"), "content_hash", "status").select("id", F.col("content_hash").alias("was"), (F.col("status") != "removed").alias("there"))
    there = F.coalesce("there", F.lit(False))
    status = (
        F.when(F.col("text").isNull(), F.when(there, "removed"))
        .when(~there, "added").when(F.col("was") != F.col("content_hash"), "modified")
    )
    return new.join(known, "id", "left").withColumn("status", status).where("status is not null").drop("was", "there")


def _write(rows: DataFrame, path: str, *by: str) -> None:
    # Tokens and postings take a quarter less room than with Parquet's usual codec.
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(path)


def _turns(most: int, buckets: int) -> int:
    """In how many turns the postings of a batch are written, of which a task has so many at most."""
    return min(buckets, max(1, math.ceil(most / SORTED)))


def take(spark: SparkSession, feed: Feed, rows: DataFrame, number: int) -> dict[str, int]:
    """Writes a batch: its versions, and the postings of what they hold."""
    before = versions(spark, feed.output).where(F.col("batch") < number)
    found = changes(notes(rows, feed), before)
    held = F.when(F.col("text").isNotNull(), tokens("title", "text")).otherwise(F.array().cast("array<string>"))
    found = found.withColumn("tokens", held).withColumns({"dl": F.size("tokens").cast("long"), "snippet": F.substring("text", 1, SNIPPET), "batch": F.lit(number).cast("long")})
    _write(found.select("id", "doc_ord", "title", "tags", "content_hash", "status", "snippet", "dl", "tokens", "batch"), f"{feed.output}/versions", "batch")
    # Tokenised once, and read again.
    own = versions(spark, feed.output).where(F.col("batch") == number)
    n = {s: F.count_if(F.col("status") == s).alias(s) for s in ("added", "modified", "removed")}
    by_task = own.groupBy(F.spark_partition_id()).agg(*n.values(), F.sum("dl").alias("postings"))
    total = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*n, "postings")]
    found = by_task.agg(*total, F.coalesce(F.max("postings"), F.lit(0)).alias("most")).first().asDict()
    postings = lexical.postings_of(own.select("id", "doc_ord", "tokens")).withColumns({"batch": F.lit(number).cast("long"), "bucket": F.pmod(F.xxhash64("term"), F.lit(feed.buckets)).cast("int")})
    # So many buckets at a time that what a task sorts stays in memory, however much it reads: postings that spill take more disk than the notes, and the more the larger a task is.
    turns = _turns(found.pop("most"), feed.buckets)
    for turn in range(turns):
        # Each task sorts those of its own notes, so nothing is shuffled and a common term fills all files alike.
        _write(postings.where(F.col("bucket") % turns == turn).sortWithinPartitions("bucket", "term", "doc_ord"), f"{feed.output}/postings", "batch", "bucket")
    return found


def run(spark: SparkSession, feed: Feed) -> dict[str, int]:
    """Takes all files that are new, and returns what was read and written."""
    total = dict.fromkeys(("batches", "read", "added", "modified", "removed", "postings"), 0)

    def batch(rows: DataFrame, number: int) -> None:
        found = {"read": rows.count()} | take(spark, feed, rows, number)
        log.info("batch %d: read %d rows; wrote %d added, %d modified, %d removed notes, %d postings", number, *(found[k] for k in list(total)[1:]))
        total["batches"] += 1
        for k, n in found.items():
            total[k] += n

    schema = spark.read.format(feed.source_format).load(feed.source).schema
    stream = spark.readStream.format(feed.source_format).schema(schema).option("maxFilesPerTrigger", feed.files_per_batch).load(feed.source)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", feed.checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%s: %s; output %s", feed.source, total if total["batches"] else "nothing new", feed.output)
    return total


if __name__ == "__main__":
    sys.exit(settings.main(Feed, run, "note_feed"))
