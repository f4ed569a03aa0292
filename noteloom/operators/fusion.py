"""Reciprocal rank fusion."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K = 60


def fuse(lists: list[DataFrame], k: int = K, top: int | None = None) -> DataFrame:
    """(rank, doc_id, score) by the sum of 1 / (k + rank) over lists of (rank, doc_id).

    A document in one list has one term. Title and snippet, where lists have
    them, are the first that are not null, by list and then rank. Ties go by id.
    """
    details = [c for c in ("title", "snippet") if any(c in x.columns for x in lists)]
    parts = [x.select(F.lit(i).alias("list_no"), "rank", "doc_id", *(c if c in x.columns else F.lit(None).cast("string").alias(c) for c in details)) for i, x in enumerate(lists)]
    everything = reduce(DataFrame.unionByName, parts)
    order = F.struct("list_no", "rank")
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in details]
    fused = everything.groupBy("doc_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("score"), *first)
    if top is not None:
        fused = fused.orderBy(F.desc("score"), "doc_id").limit(top)
    # Lists are results of limits, so one task ranks them.
    return fused.select(F.row_number().over(W.orderBy(F.desc("score"), "doc_id")).alias("rank"), "doc_id", "score", *details)
