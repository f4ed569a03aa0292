"""The vector index and exact cosine search."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteloom.functions.similarity import cosine, literal, norm
from noteloom.functions.text import embedding_clamp, embedding_text
from noteloom.operators.best import HELD, Best, ranked_many
from noteloom.operators.lexical import ranked


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "doc_id string, embedding array<float>, doc_ord long")


def with_norms(vectors: DataFrame) -> DataFrame:
    """Vectors with their norms, to be stored so that a search reads them."""
    return vectors.withColumn("norm", norm("embedding"))


def similarities(vectors: DataFrame, query: list[float]) -> DataFrame:
    """(doc_ord, doc_id, score). The query is a literal, so nothing is joined and each cosine is computed once."""
    q = literal(query)
    size = sum(float(x) * float(x) for x in query) ** 0.5
    stored = F.col("norm") if "norm" in vectors.columns else None
    return vectors.select("doc_ord", "doc_id", cosine("embedding", q, stored, F.lit(size)).alias("score"))


def search(vectors: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """The k vectors most similar to the query, similarities above zero only. An empty query finds nothing."""
    return ranked(similarities(vectors, query) if query else similarities(vectors.limit(0), query), k)


#: Rows of a block in a search for many queries.
BLOCK = 1024


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and double precision vectors of an Arrow column of arrays, a matrix for each length. Null and empty ones are left out."""
    rows = column.cast(pa.large_list(pa.float64()))
    sizes = pc.list_value_length(rows).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = rows.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]).tolist():
        own = np.flatnonzero(sizes == size)
        yield own, values[starts[own][:, None] + np.arange(size)]


def blocks(frame: DataFrame, columns: list[str], block: int = BLOCK, by: str | None = None) -> DataFrame:
    """Rows (columns, embedding) as blocks of vectors of one length, and of one value of ``by``: their columns as lists, and the matrix as bytes."""
    kinds = dict(frame.dtypes)
    schema = ", ".join(f"{c} array<{kinds[c]}>" for c in columns) + ", size int, data binary" + (f", {by} {kinds[by]}" if by else "")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, matrix in matrices(batch.column(len(columns))):
                groups = [(None, np.arange(len(own)))]
                if by:
                    kept = batch.column(len(columns) + 1).to_numpy(zero_copy_only=False)[own]
                    groups = [(g, np.flatnonzero(kept == g)) for g in np.unique(kept).tolist()]
                for group, members in groups:
                    for at in range(0, len(members), block):
                        part = members[at : at + block]
                        rows = pa.array(own[part])
                        row = {c: pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), batch.column(k).take(rows)) for k, c in enumerate(columns)}
                        yield pa.RecordBatch.from_pydict(row | {"size": pa.array([matrix.shape[1]], pa.int32()), "data": [matrix[part].tobytes()]} | ({by: pa.array([group], pa.int32())} if by else {}))

    return frame.select(*columns, "embedding", *([by] if by else [])).mapInArrow(pack, schema)


def search_blocks(queries: DataFrame, vectors: DataFrame, kind: str, k: int) -> DataFrame:
    """Blocks of queries (query_id, size, data; lists) against blocks of vectors (doc_ord, doc_id, size, data; list), every pair, with lists only the queries that ask for the block's list.

    A task keeps the best k of each query over all blocks that it meets, and passes on nothing else, so rows grow with the queries and the tasks and not with the pairs.
    """
    listed = "list" in vectors.columns

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[Best, dict[int, np.ndarray] | None]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                number, size = row["block"].as_py(), row["size"].as_py()
                if number not in held:
                    if len(held) == HELD:
                        yield held.pop(next(iter(held)))[0].rows(found)
                    ids, asking = row["query_id"].as_py(), None
                    if listed:
                        lists = row["lists"].as_py()
                        flat, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                        asking = {x: owner[flat == x] for x in np.unique(flat).tolist()}
                    held[number] = Best(ids, k), asking
                top, asking = held[number]
                rows = np.arange(len(top.ids)) if asking is None else asking.get(row["list"].as_py())
                if rows is None:
                    continue
                q, v = (np.frombuffer(row[c].as_buffer(), np.float64).reshape(-1, size) for c in ("q", "v"))
                q = q if asking is None else q[rows]
                sizes = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)
                score = np.divide(q @ v.T, sizes, out=np.zeros(sizes.shape), where=sizes > 0)
                top.add(rows, score, row["doc_ord"].values.to_numpy(), row["doc_id"].values.to_numpy(zero_copy_only=False))
        for top, _ in held.values():
            yield top.rows(found)

    found = pa.schema([("query_id", pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()), ("doc_ord", pa.int64()), ("doc_id", pa.string()), ("score", pa.float64())])
    left = queries.withColumnRenamed("data", "q").withColumn("block", F.monotonically_increasing_id())
    right = vectors.withColumnRenamed("data", "v").withColumnRenamed("size", "other")
    pairs = left.crossJoin(right).where(F.col("size") == F.col("other")).drop("other")
    return ranked_many(pairs.mapInArrow(best, f"query_id {kind}, doc_ord long, doc_id string, score double"), k)


def search_many(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """The k vectors most similar to each of many queries (query_id, embedding): exactly, every block of queries against every block of vectors."""
    return search_blocks(blocks(queries, ["query_id"], block), blocks(vectors, ["doc_ord", "doc_id"], block), dict(queries.dtypes)["query_id"], k)


def add(vectors: DataFrame, more: DataFrame) -> DataFrame:
    return vectors.unionByName(more, allowMissingColumns=True)


def remove(vectors: DataFrame, ids: list[str]) -> DataFrame:
    """Without the first vector of each id; ids that are absent change nothing."""
    if not ids:
        return vectors
    first = vectors.where(F.col("doc_id").isin(ids)).groupBy("doc_id").agg(F.min("doc_ord").alias("doc_ord"))
    return vectors.join(first, ["doc_id", "doc_ord"], "left_anti").select(*vectors.columns)


def contains(vectors: DataFrame, doc_id: str) -> bool:
    return not vectors.where(F.col("doc_id") == doc_id).isEmpty()


def statistics(vectors: DataFrame) -> DataFrame:
    """Number of vectors, dimension of the first, number of those of another dimension, and whether there are none."""
    size = F.size("embedding")
    first = F.min_by(size, F.col("doc_ord"))
    return vectors.agg(F.count(F.lit(1)).alias("n_vectors"), F.coalesce(first, F.lit(0)).alias("dimension"), F.collect_set(size).alias("sizes")).select("n_vectors", "dimension", (F.size("sizes") > 1).alias("mixed"), (F.col("n_vectors") == 0).alias("is_empty"))


def embed(docs: DataFrame, embedder: Callable[[list[str]], list[list[float]]], batch: int = 10) -> DataFrame:
    """Vectors of documents by an embedder, which gets ``batch`` texts at a time and returns their vectors in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: list = []
            for at in range(0, len(frame), batch):
                found += embedder(frame["text"].iloc[at : at + batch].tolist())
            yield pd.DataFrame({"doc_id": frame["doc_id"], "embedding": found, "doc_ord": frame["doc_ord"]})

    texts = docs.select(F.col("id").alias("doc_id"), embedding_clamp(embedding_text("title", "tags", "text")).alias("text"), "doc_ord")
    return texts.mapInPandas(run, "doc_id string, embedding array<float>, doc_ord long")
