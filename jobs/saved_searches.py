"""Answers all saved searches over a note feed in one job, as a report that readers open by topic.

The notes in force come with their tokens from the output of ``jobs.note_feed``; two passes over them answer all searches, without a shuffle of notes or postings. Every saved search gets its best ``k`` notes by BM25, with title, tags and snippet, and
whether a hit is new since the report before (the one with the greatest earlier ``as_of``). The report of one ``as_of`` is a folder of its own, with a folder for each topic (a note's first tag) in
it; a run that comes again replaces that folder and no other, and compares itself with the same earlier report.

    python -m jobs.saved_searches --config jobs/saved_searches.toml --as-of 2024-06-30
"""
from __future__ import annotations

import logging
import re
import sys
from dataclasses import dataclass

from jobs import note_feed, settings
from noteloom.operators import lexical
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("jobs.saved_searches")
HIT = "query_id long, rank int, doc_id string, score double, title string, tags array<string>, snippet string, is_new boolean, as_of string, topic string"


@dataclass(frozen=True)
class Searches:
    """``feed``: the output of the note feed. ``searches``: a table of saved searches with a number and a text. ``as_of`` sorts as text, as dates do."""

    feed: str
    searches: str
    output: str
    as_of: str
    searches_format: str = "parquet"
    id: str = "item_id"
    query: str = "text"
    k: int = 10


def reports(spark: SparkSession, output: str) -> DataFrame:
    """All reports written."""
    return note_feed._table(spark, output, HIT)


def run(spark: SparkSession, job: Searches) -> dict[str, int]:
    """Writes the report of ``as_of``, and returns what was read and written."""
    if not re.fullmatch(r"[\w.-]+", job.as_of):
        raise ValueError(f"as_of must be a date or a name: {job.as_of!r}")
    notes, _ = note_feed.in_force(spark, job.feed)
    searches = spark.read.format(job.searches_format).load(job.searches).select(F.col(job.id).cast("long").alias("query_id"), F.col(job.query).cast("string").alias("query"))
    found = lexical.search_rows(notes.select("doc_ord", F.col("id").alias("doc_id"), "tokens"), searches, job.k)
    details = notes.select(F.col("id").alias("doc_id"), "title", "tags", "snippet", F.coalesce(F.get("tags", F.lit(0)), F.lit("none")).alias("topic"))
    earlier = reports(spark, job.output).where(F.col("as_of") < job.as_of)
    before = earlier.agg(F.max("as_of")).first()[0]
    seen = earlier.where(F.col("as_of") == before).select("query_id", "doc_id", F.lit(False).alias("is_new"))
    # Hits are k for each search at most, so they go to the notes.
    hits = details.join(F.broadcast(found), "doc_id").join(seen, ["query_id", "doc_id"], "left").withColumn("is_new", F.coalesce("is_new", F.lit(True)))
    hits = hits.select("query_id", "rank", "doc_id", "score", "title", "tags", "snippet", "is_new", "topic")
    path = f"{job.output}/as_of={job.as_of}"
    hits.repartitionByRange("topic", "query_id").sortWithinPartitions("topic", "query_id", "rank").write.mode("overwrite").partitionBy("topic").parquet(path)
    own = reports(spark, job.output).where(F.col("as_of") == job.as_of)
    total = own.agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("query_id").alias("answered"), F.count_if("is_new").alias("new")).first().asDict() | {"searches": searches.count(), "notes": notes.count()}
    log.info("%s: read %d searches, %d notes; wrote %d hits for %d searches, %d new since %s", path, total["searches"], total["notes"], total["hits"], total["answered"], total["new"], before)
    return total


if __name__ == "__main__":
    sys.exit(settings.main(Searches, run, "saved_searches"))
