"""Streams of documents into a stored index."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from noteloom.functions.tokens import Analyser, cjk_tokens
from noteloom.plans import build


def upsert_batch(spark: SparkSession, root: str, now: Callable[[], str], embedder=None, analyser: Analyser = cjk_tokens) -> Callable[[DataFrame, int], None]:
    """A batch function for ``foreachBatch``: each batch becomes a segment of the index. A batch that comes again changes nothing."""

    def run(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            build.upsert(spark, batch, root, now(), embedder, analyser=analyser)
        finally:
            batch.unpersist()

    return run


def start(stream: DataFrame, root: str, checkpoint: str, now: Callable[[], str], embedder=None, analyser: Analyser = cjk_tokens, **trigger) -> StreamingQuery:
    """Keep a stored index up to date with a stream of documents."""
    return stream.writeStream.foreachBatch(upsert_batch(stream.sparkSession, root, now, embedder, analyser)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
