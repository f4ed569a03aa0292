"""The jobs as queries: each runs twice into a new folder, and gives its whole output as it stands then. SQL gives the same rows."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from jobs import note_feed, saved_searches
from jobs.note_feed import Feed
from jobs.saved_searches import Searches
from noteloom import queries as core
from noteloom.sources.hadoop import shared_folder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _twice(run: Callable, spark: SparkSession, job) -> None:
    run(spark, job)
    run(spark, job)


def _feed(spark: SparkSession, sf_dir: str) -> tuple[Feed, str]:
    folder = f"{shared_folder(spark)}/job-{uuid.uuid4().hex}"
    # A pattern, as a stream takes a folder or a pattern: the table may be one file.
    return Feed(f"{sf_dir}/documents[.]parquet", f"{folder}/feed", f"{folder}/feed-checkpoint"), folder


def job1_note_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every note in force, with each of its postings."""
    feed, _ = _feed(spark, sf_dir)
    _twice(note_feed.run, spark, feed)
    notes, postings = note_feed.in_force(spark, feed.output)
    notes = notes.select(F.col("id").alias("doc_id"), "doc_ord", "title", F.array_join("tags", ",").alias("tags"), "content_hash", "status", "snippet", "dl")
    # Here ids are texts of the orders, which take less room in a shuffle. Merged, the rows of a note follow one another, so what they repeat of it takes hardly any room where they are written.
    return notes.hint("merge").join(postings.select("doc_ord", "term"), "doc_ord", "left").drop("doc_ord")


_NOTE_FEED = f"""WITH {core._TOKENS}
SELECT id AS doc_id, title, array_to_string(tags, ',') AS tags, left(sha256(title || chr(0) || text), 16) AS content_hash, 'added' AS status, left(text, 150) AS snippet, CAST(len(toks) AS BIGINT) AS dl, term
FROM docs JOIN toks USING (id, doc_ord) LEFT JOIN (SELECT id, unnest(toks) AS term FROM toks) USING (id)"""


def job2_saved_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of all saved searches over the feed of the same tables."""
    feed, folder = _feed(spark, sf_dir)
    note_feed.run(spark, feed)
    _twice(saved_searches.run, spark, Searches(feed.output, f"{sf_dir}/benchmark.parquet", f"{folder}/reports", "2024-01-31"))
    return saved_searches.reports(spark, f"{folder}/reports").withColumn("tags", F.array_join("tags", ","))


_SAVED_SEARCHES = f"""WITH {core._POSTINGS},
  q AS (SELECT item_id AS query_id, unnest({core._tokens("text")}) AS term FROM benchmark),
  s AS (SELECT query_id, doc_ord, doc_id, round(sum({core._TERM}), 6) AS score FROM q JOIN postings USING (term) JOIN term_stats USING (term), corpus GROUP BY ALL),
  best AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_ord) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT query_id, rank, doc_id, score, title, array_to_string(tags, ',') AS tags, left(text, 150) AS snippet, true AS is_new, '2024-01-31' AS as_of, tags[1] AS topic FROM best JOIN docs ON docs.id = doc_id WHERE rank <= 10"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_note_feed, job2_saved_searches)}


def oracle_sql() -> dict[str, str]:
    return {"job1_note_feed": _NOTE_FEED, "job2_saved_searches": _SAVED_SEARCHES}
