"""The lexical index and BM25 search."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteloom.functions.tokens import Analyser, cjk_tokens, query_tokens, tokens
from noteloom.operators.best import HELD, Best, ranked_many

K1, B = 1.2, 0.75


@dataclass
class LexicalIndex:
    """postings (term, doc_ord, doc_id, tf, dl), term_stats (term, df), corpus_stats (n_docs, avg_dl): one row, zeros for an empty corpus.

    ``rows`` are the distinct tokens of documents that have no stored postings yet.
    """

    postings: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame
    rows: DataFrame | None = None


def tokenised(docs: DataFrame, analyser: Analyser = cjk_tokens) -> DataFrame:
    """(doc_ord, doc_id, tokens): distinct tokens of title and text. Null titles and texts count as empty."""
    return docs.select("doc_ord", F.col("id").alias("doc_id"), tokens("title", "text", analyser=analyser).alias("tokens"))


def postings_of(rows: DataFrame) -> DataFrame:
    """Postings of documents (id, doc_ord, tokens). Tokens are distinct, so every term frequency is one and no shuffle is needed."""
    return _exploded(rows.select("doc_ord", F.col("id").alias("doc_id"), "tokens")).select("term", "doc_ord", "doc_id", F.lit(1).cast("long").alias("tf"), "dl")


def _exploded(rows: DataFrame) -> DataFrame:
    """(doc_ord, doc_id, dl, term), a row for each token.

    The outer form, with its empty rows taken away again: for the plain one Spark
    adds a filter on the array below, which computes all tokens two times more.
    """
    return rows.select("doc_ord", "doc_id", F.size("tokens").cast("long").alias("dl"), F.explode_outer("tokens").alias("term")).where("term is not null")


def from_tokens(rows: DataFrame) -> LexicalIndex:
    """An index of rows (doc_ord, doc_id, tokens), a row for each document; tokens may repeat. They are counted within their row, so no token is shuffled for its frequency."""
    dl, after = F.size("tokens").cast("long"), F.col("found")
    ordered = rows.select("doc_ord", "doc_id", dl.alias("dl"), F.sort_array("tokens").alias("tokens")).withColumn("next", F.concat(F.slice("tokens", 2, F.greatest(F.size("tokens"), F.lit(1))), F.array(F.lit(None).cast("string"))))
    # The places at which equal tokens end; a token's count is the distance to the place before.
    ends = F.filter(F.transform(F.arrays_zip("tokens", "next"), lambda x, i: F.struct(x["tokens"].alias("term"), (i + 1).alias("end"), (~x["tokens"].eqNullSafe(x["next"])).alias("last"))), lambda x: x["last"])
    found = ordered.select("doc_ord", "doc_id", "dl", ends.alias("found"))
    counted = F.transform(F.arrays_zip(after.alias("now"), F.concat(F.array(F.lit(0)), F.transform(after, lambda x: x["end"])).alias("start")), lambda x: F.struct(x["now"]["term"].alias("term"), (x["now"]["end"] - x["start"]).cast("long").alias("tf")))
    postings = found.select("doc_ord", "doc_id", "dl", F.explode_outer(counted).alias("p")).where("p.term is not null").select("p.term", "doc_ord", "doc_id", "p.tf", "dl")
    corpus = rows.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg(F.size("tokens").cast("double")), F.lit(0.0)).alias("avg_dl"))
    return LexicalIndex(postings, postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), corpus)


def build(docs: DataFrame, analyser: Analyser = cjk_tokens) -> LexicalIndex:
    """The index of documents."""
    rows = tokenised(docs, analyser)
    postings = postings_of(rows.withColumnRenamed("doc_id", "id"))
    corpus = rows.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg(F.size("tokens").cast("double")), F.lit(0.0)).alias("avg_dl"))
    return LexicalIndex(postings, postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), corpus, rows)


def empty(spark: SparkSession) -> LexicalIndex:
    corpus = spark.range(1).select(F.lit(0).cast("long").alias("n_docs"), F.lit(0.0).alias("avg_dl"))
    return LexicalIndex(spark.createDataFrame([], "term string, doc_ord long, doc_id string, tf long, dl long"), spark.createDataFrame([], "term string, df long"), corpus)


def idf(n, df) -> Column:
    return F.log((F.col(n) - F.col(df) + 0.5) / (F.col(df) + 0.5) + 1)


def term_score(n="n_docs", df="df", tf="tf", dl="dl", avg="avg_dl") -> Column:
    weight = F.col(tf) + K1 * (1 - B + B * F.col(dl) / F.when(F.col(avg) > 0, F.col(avg)).otherwise(1.0))
    return idf(n, df) * F.col(tf) * (K1 + 1) / weight


def scores(index: LexicalIndex, terms: list[str]) -> DataFrame:
    """(doc_ord, doc_id, score) of every document that holds a term. The terms reach the postings' scan as a filter."""
    if not terms:
        return index.postings.sparkSession.createDataFrame([], "doc_ord long, doc_id string, score double")
    if index.rows is not None:
        return _scan(index.rows, terms).where("score > 0")
    wanted = F.col("term").isin(terms)
    # One row per query term, and one of the corpus: as small as the query.
    stats = F.broadcast(index.term_stats.where(wanted).crossJoin(index.corpus_stats))
    return index.postings.where(wanted).join(stats, "term").groupBy("doc_ord", "doc_id").agg(F.sum(term_score()).alias("score"))


def _scan(rows: DataFrame, terms: list[str]) -> DataFrame:
    """Scores of documents without postings: one pass for the statistics, one for the scores, and no shuffle of documents."""
    dl = F.size("tokens").cast("double")
    stats = rows.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(dl).alias("avg_dl"), *(F.count_if(F.array_contains("tokens", t)).alias(f"df{i}") for i, t in enumerate(terms)))
    found = rows.select("doc_ord", "doc_id", F.lit(1).alias("tf"), dl.alias("dl"), F.array_intersect("tokens", F.array(*map(F.lit, terms))).alias("hits"))
    score = sum((F.when(F.array_contains("hits", t), term_score(df=f"df{i}")).otherwise(0.0) for i, t in enumerate(terms)), F.lit(0.0))
    return found.crossJoin(F.broadcast(stats)).select("doc_ord", "doc_id", score.alias("score"))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of (doc_ord, doc_id, score) with their ranks. Scores count to six digits, ties go by document order."""
    # The filter comes after the limit, which changes nothing since scores descend; before it Spark would compute each score twice.
    best = found.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_ord").limit(k).where("score > 0")
    return best.select(F.row_number().over(W.orderBy(F.desc("score"), "doc_ord")).alias("rank"), "doc_ord", "doc_id", "score")


def search(index: LexicalIndex, query: str, k: int = 10, analyser: Analyser = cjk_tokens) -> DataFrame:
    """The best k documents for a query, which is read by the analyser that the documents were read by."""
    terms = query_tokens(query, analyser, index.postings.sparkSession)
    return ranked(_scan(index.rows, terms) if terms and index.rows is not None else scores(index, terms), k)


def search_many(index: LexicalIndex, queries: DataFrame, k: int = 10, analyser: Analyser = cjk_tokens) -> DataFrame:
    """The best k documents for each of many queries (query_id, query), in one job."""
    if index.rows is not None:
        return search_rows(index.rows, queries, k, analyser)
    terms = queries.select("query_id", F.explode(tokens("query", analyser=analyser)).alias("term"))
    stats = index.term_stats.crossJoin(F.broadcast(index.corpus_stats))
    # Spark broadcasts the queries' side when it measures it as small, else it shuffles both by term.
    weighted = terms.join(stats, "term")
    found = index.postings.join(weighted, "term").groupBy("query_id", "doc_ord", "doc_id").agg(F.round(F.sum(term_score()), 6).alias("score"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_ord"))
    return found.where("score > 0").withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "doc_ord", "doc_id", "score")


#: Documents and queries that are scored at a time, documents whose scores are added up at once, and tokens of a block of documents.
DOCS, QUERIES, PART, TOKENS = 1024, 256, 64, 1 << 20


def _asked(rows: DataFrame, queries: DataFrame, analyser: Analyser) -> DataFrame:
    """(block, asked): the terms of blocks of queries with what the documents (tokens) say of them. The entry without a term is for all documents: their number, and the sum of their lengths.

    One pass over the documents counts both, as each has a row for itself beside those of its tokens.
    """
    # As many blocks as the queries need, and one more at most.
    block = F.pmod(F.xxhash64("query_id"), F.lit(queries.count() // QUERIES + 1)).cast("int").alias("block")
    terms = queries.select(block, "query_id", F.explode(tokens("query", analyser=analyser)).alias("term"))
    every = rows.select(F.size("tokens").cast("long").alias("dl"), F.posexplode(F.concat(F.array(F.lit(None).cast("string")), "tokens")).alias("pos", "term"))
    # As small as the queries.
    wanted = F.broadcast(terms.select("term").distinct().withColumn("wanted", F.lit(True)))
    found = every.join(wanted, "term", "left").where("pos = 0 or wanted").groupBy(F.col("term").alias("found")).agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("dls"))
    whole = terms.select("block").distinct().select("block", *(F.lit(None).cast(t).alias(c) for c, t in terms.dtypes[1:]))
    weighted = terms.unionByName(whole).join(found, F.col("term").eqNullSafe(F.col("found")))
    return weighted.groupBy("block").agg(F.collect_list(F.struct("query_id", "term", "n", "dls")).alias("asked"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (doc_ord, doc_id, tokens) as rows of many, with their tokens one after another."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            start = ends[at] - sizes[at]
            n = int(np.clip(np.searchsorted(ends[at:], start + TOKENS, "right"), 1, DOCS))
            part = batch.slice(at, n)
            columns = {"doc_ord": part.column(0), "doc_id": part.column(1), "n": pc.list_value_length(part.column(2)), "terms": part.column(2).flatten()}
            yield pa.RecordBatch.from_pydict({c: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for c, v in columns.items()})
            at += n


class _Scorer:
    """A block of queries: the queries of each term with its weight, and the best documents so far."""

    def __init__(self, asked: pa.StructArray, k: int):
        term, n, dls = (asked.field(c) for c in ("term", "n", "dls"))
        whole = pc.is_null(term)
        self.n_docs, dl = (pc.filter(c, whole)[0].as_py() for c in (n, dls))
        self.avg_dl = dl / self.n_docs if dl else 1.0
        given = pc.invert(whole)
        found = pc.filter(term, given).dictionary_encode()
        self.terms, code = found.dictionary, found.indices.to_numpy()
        df = pc.filter(n, given).to_numpy()
        ids: dict = {}
        query = np.array([ids.setdefault(q, len(ids)) for q in pc.filter(asked.field("query_id"), given).to_pylist()], np.int64)
        by = np.argsort(code, kind="stable")
        self.query, self.weight = query[by], np.log((self.n_docs - df + 0.5) / (df + 0.5) + 1)[by] * (K1 + 1)
        self.start = np.searchsorted(code[by], np.arange(len(self.terms) + 1))
        self.best = Best(list(ids), k)

    def add(self, order: np.ndarray, docs: np.ndarray, sizes: np.ndarray, terms: pa.Array) -> None:
        code = pc.index_in(terms, value_set=self.terms).fill_null(-1).to_numpy()
        owner = np.repeat(np.arange(len(docs)), sizes)[code >= 0]
        code = code[code >= 0]
        n = self.start[code + 1] - self.start[code]
        factor = 1 / (1 + K1 * (1 - B + B * sizes / self.avg_dl))
        rows = np.arange(len(self.best.ids))
        for at in range(0, len(docs), PART):
            part = slice(*np.searchsorted(owner, [at, at + PART]))
            size, many = len(docs[at : at + PART]), n[part]
            # Each token of a document with each query that asks for it.
            place = np.arange(many.sum()) + np.repeat(self.start[code[part]] - np.cumsum(many) + many, many)
            cell = self.query[place] * size + np.repeat(owner[part] - at, many)
            score = np.bincount(cell, self.weight[place], len(rows) * size).reshape(len(rows), size) * factor[at : at + PART]
            self.best.add(rows, score, order[at : at + PART], docs[at : at + PART])


def search_rows(rows: DataFrame, queries: DataFrame, k: int = 10, analyser: Analyser = cjk_tokens) -> DataFrame:
    """The best k documents for each of many queries (query_id, query), from documents with their distinct tokens (doc_ord, doc_id, tokens).

    One pass over the documents for the statistics of the queries' terms, one for the scores. A task keeps the best k of each query over all its documents and passes on
    nothing else, so neither documents nor their pairs with queries are shuffled.
    """
    kind = dict(queries.dtypes)["query_id"]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Scorer] = {}
        schema = None
        for batch in batches:
            asked = batch.column("asked")
            schema = schema or pa.schema([("query_id", asked.type.value_type.field("query_id").type), ("doc_ord", pa.int64()), ("doc_id", pa.string()), ("score", pa.float64())])
            for i in range(batch.num_rows):
                number = batch.column("block")[i].as_py()
                if number not in held:
                    if len(held) == HELD:
                        yield held.pop(next(iter(held))).best.rows(schema)
                    held[number] = _Scorer(asked[i].values, k)
                order, docs, sizes, terms = (batch.column(c)[i].values for c in ("doc_ord", "doc_id", "n", "terms"))
                held[number].add(order.to_numpy(), docs.to_numpy(zero_copy_only=False), sizes.to_numpy(), terms)
        for scorer in held.values():
            yield scorer.best.rows(schema)

    docs = rows.select(F.col("doc_ord").cast("long").alias("doc_ord"), "doc_id", "tokens").mapInArrow(_blocks, "doc_ord array<long>, doc_id array<string>, n array<int>, terms array<string>")
    # As small as the queries.
    pairs = docs.crossJoin(F.broadcast(_asked(rows, queries, analyser)))
    return ranked_many(pairs.mapInArrow(best, f"query_id {kind}, doc_ord long, doc_id string, score double"), k)


def statistics(index: LexicalIndex) -> DataFrame:
    """n_docs, avg_dl, is_empty and the number of terms."""
    return index.corpus_stats.crossJoin(index.term_stats.agg(F.count(F.lit(1)).alias("n_terms"))).select("n_docs", F.round("avg_dl", 6).alias("avg_dl"), "n_terms", (F.col("n_docs") == 0).alias("is_empty"))
