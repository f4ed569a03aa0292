"""Unified search over a stored or given index."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteloom.config import SearchConfig
from noteloom.functions.extract import SNIPPET, extract
from noteloom.functions.text import has_tag
from noteloom.functions.tokens import Analyser, cjk_tokens
from noteloom.operators import docstore, fusion, lexical, vector
from noteloom.operators.lexical import LexicalIndex
from noteloom.operators.remote import RemoteError
from noteloom.plans.store import Stored
from noteloom.plans.vector_lists import VectorLists
from noteloom.schema import RANKED
from noteloom.sources import index_files


@dataclass
class Searcher:
    docs: DataFrame
    index: LexicalIndex
    vectors: DataFrame
    embedder: Callable[[str], list[float]] | None = None
    analyser: Analyser = cjk_tokens
    #: Vectors in lists, made from those of the index; without them all vectors are read.
    lists: VectorLists | None = None

    @classmethod
    def open(cls, spark: SparkSession, root: str, embedder=None, analyser: Analyser = cjk_tokens, lists: VectorLists | None = None) -> Searcher:
        """The index in force below a folder; where nothing is stored, an empty one."""
        stored = Stored.open(spark, root)
        return cls(stored.documents, stored.index, stored.vectors, embedder, analyser, lists)

    @classmethod
    def from_json(cls, spark: SparkSession, folder: str, embedder=None, analyser: Analyser = cjk_tokens) -> Searcher:
        """Over a JSON store; each file that is missing is an empty table."""
        docs, index, vectors, _ = index_files.load_store(spark, folder)
        return cls(docs, index, vectors, embedder, analyser)

    def bm25(self, query: str, k: int) -> DataFrame:
        return lexical.search(self.index, query, k, self.analyser)

    def by_vector(self, query: list[float], k: int) -> DataFrame:
        return self.lists.search(query, k) if self.lists else vector.search(self.vectors, query, k)

    def has_vector_index(self) -> bool:
        return not self.vectors.isEmpty()

    def semantic(self, query: str, k: int) -> DataFrame:
        """By the embedded query; nothing without an embedder, without vectors, or when the embedder fails."""
        none = self.docs.sparkSession.createDataFrame([], RANKED)
        if self.embedder is None or not self.has_vector_index():
            return none
        try:
            return self.by_vector(self.embedder(query), k)
        except RemoteError:
            return none

    def hybrid(self, query: str, k: int, query_vector: list[float] | None = None, rrf_k: int = fusion.K) -> DataFrame:
        """The best 2k of both ways fused, k of them returned."""
        second = self.semantic(query, 2 * k) if query_vector is None else self.by_vector(query_vector, 2 * k)
        return fusion.fuse([self.bm25(query, 2 * k), second], rrf_k, k)

    def search(self, query: str, config: SearchConfig | None = None) -> DataFrame:
        """(rank, doc_id, score) by mode. A tag filters what was found, so that fewer than k may remain."""
        config = config or SearchConfig()
        ways = {"bm25": self.bm25, "semantic": self.semantic, "hybrid": self.hybrid}
        found = ways[config.mode](query, config.top_k).select("rank", "doc_id", "score")
        return tag_filter(found, self.docs, config.tag_filter) if config.tag_filter else found

    def list_tags(self) -> DataFrame:
        return docstore.all_tags(self.docs)

    def recent(self, n: int = 10) -> DataFrame:
        return docstore.recent(self.docs, n)


def tag_filter(found: DataFrame, docs: DataFrame, tag: str) -> DataFrame:
    """Of ranked results those whose document has the tag, ranked anew. At most k rows meet the documents."""
    kept = docs.select(F.col("id").alias("doc_id"), "tags").join(F.broadcast(found), "doc_id").where(has_tag("tags", tag))
    return kept.select(F.row_number().over(W.orderBy("rank")).cast("int").alias("rank"), "doc_id", "score")


def enrich(found: DataFrame, docs: DataFrame, keep_missing: bool = True) -> DataFrame:
    """Results with title, date, tags and text. Those without a document have nulls, or go."""
    details = docs.select(F.col("id").alias("doc_id"), "title", "date", "tags", "text").join(F.broadcast(found.select("doc_id")), "doc_id", "left_semi")
    return found.join(details, "doc_id", "left" if keep_missing else "inner")


def memo_results(found: DataFrame, docs: DataFrame, mode: str = "snippet", max_chars: int = 5000) -> DataFrame:
    """Results as shown: rank, rendered score and date, title, tags, and content by extraction mode. Snippets have 150 characters whatever ``max_chars`` says."""
    return enrich(found, docs, keep_missing=False).select(
        "rank", "doc_id", F.format_string("%.4f", "score").alias("score"), "title", F.date_format("date", "yyyy-MM-dd").alias("date"), "tags", extract("text", mode, max_chars).alias("content"),
    )


def recent_memos(docs: DataFrame, n: int = 10) -> DataFrame:
    return docstore.recent(docs, n).select("id", "title", F.date_format("date", "yyyy-MM-dd HH:mm").alias("date"), "tags", F.substring("text", 1, SNIPPET).alias("snippet"))
