"""The best k of each of many queries: within a task, and over all of them."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Blocks of queries whose best a task holds at a time.
HELD = 64


class Best:
    """The best k so far of each query of a block, by score and then document order."""

    def __init__(self, ids: list, k: int):
        self.ids, self.k = ids, k
        self.score, self.order = np.zeros((len(ids), k)), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.doc = np.full((len(ids), k), None, object)

    def add(self, rows: np.ndarray, score: np.ndarray, order: np.ndarray, docs: np.ndarray) -> None:
        """Scores of documents for some of the queries. Only what may still be among the best is rounded and sorted."""
        least, last = self.score[rows, -1], self.order[rows, -1]
        at, to = np.nonzero(score >= (least - 1e-6)[:, None])
        found = np.round(score[at, to], 6)
        keep = (found > 0) & ((found > least[at]) | (found == least[at]) & (order[to] < last[at]))
        at, to, found = at[keep], to[keep], found[keep]
        if not len(at):
            return
        touched = np.unique(at)
        queries = np.concatenate([rows[at], np.repeat(rows[touched], self.k)])
        values = np.concatenate([found, self.score[rows[touched]].ravel()])
        orders = np.concatenate([order[to], self.order[rows[touched]].ravel()])
        ids = np.concatenate([docs[to], self.doc[rows[touched]].ravel()])
        by = np.lexsort((orders, -values, queries))
        sorted_queries = queries[by]
        place = np.arange(len(by)) - np.searchsorted(sorted_queries, sorted_queries)
        by, place = by[place < self.k], place[place < self.k]
        self.score[queries[by], place], self.order[queries[by], place], self.doc[queries[by], place] = values[by], orders[by], ids[by]

    def rows(self, schema: pa.Schema) -> pa.RecordBatch:
        at, to = np.nonzero(self.score > 0)
        return pa.RecordBatch.from_pydict({"query_id": [self.ids[i] for i in at.tolist()], "doc_ord": self.order[at, to], "doc_id": self.doc[at, to].tolist(), "score": self.score[at, to]}, schema=schema)


def ranked_many(found: DataFrame, k: int) -> DataFrame:
    """The best k of each query's (doc_ord, doc_id, score) with their ranks; ties go by document order."""
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_ord"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "doc_ord", "doc_id", "score")
