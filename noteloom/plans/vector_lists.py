"""Vectors in lists around centroids, so that a search reads a few lists and not every vector.

Centroids are fitted on a bounded sample; every vector goes to the list of its nearest centroid, a folder of its own, so that Spark prunes the
others. A search reads the lists nearest to the query and ranks what is in them exactly. How many lists that takes is measured when
the lists are made: as many as find ``RECALL`` of the true nearest ten within the sample. The exact search over all vectors (``operators.vector``) stays the default.

Vectors of another length than most, and those without a direction, are in list -1, which every search reads.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.operators import vector

#: Bounds of the sample and of the number of lists.
SAMPLE_ROWS, SAMPLE_BYTES, LISTS = 50_000, 64 << 20, 4096
ROUNDS, SEED, RECALL, ASKED = 12, 7, 0.97, 500


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def fit(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centroids of unit length by k-means on directions; a centroid without vectors moves to the one that is worst off."""
    rng, x = np.random.default_rng(seed), _unit(sample)
    centroids = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        score = x @ centroids.T
        nearest = score.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        empty = np.flatnonzero(np.bincount(nearest, minlength=len(centroids)) == 0)
        sums[empty] = x[np.argsort(score.max(axis=1))[: len(empty)]]
        centroids = _unit(sums)
    return centroids


def probes_for(sample: np.ndarray, centroids: np.ndarray, recall: float = RECALL, k: int = 10, asked: int = ASKED) -> int:
    """How many lists a search has to read to find that share of the true nearest ``k`` in the sample."""
    x = _unit(sample)
    own, asked = (x @ centroids.T).argmax(axis=1), x[:asked]
    true = np.argsort(-(asked @ x.T), axis=1)[:, :k]
    # The place of each true neighbour's list among those nearest to the query.
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1), axis=1)
    return int(np.quantile(np.take_along_axis(place, own[true], axis=1), recall, method="higher")) + 1


def nearest(queries: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """The lists to read for each query."""
    return np.argsort(-(queries @ centroids.T), axis=1, kind="stable")[:, :probes]


@dataclass
class VectorLists:
    """Lists below a folder: their centroids, and how many of them a search reads."""

    spark: SparkSession
    root: str
    centroids: np.ndarray
    probes: int

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> VectorLists:
        rows = sorted(spark.read.parquet(f"{root}/centroids").collect(), key=lambda r: r.list)  # as many rows as lists
        return cls(spark, root, np.array([r.centroid for r in rows]), rows[0].probes if rows else 0)

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.schema("doc_id string, embedding array<float>, doc_ord long, norm double, list int").parquet(f"{self.root}/vectors")

    def search(self, query: list[float], k: int = 10, probes: int | None = None) -> DataFrame:
        """The k most similar vectors of the lists nearest to the query. A query of another length than the centroids' reads list -1 only."""
        wanted = [-1]
        if len(self.centroids) and len(query) == self.centroids.shape[1]:
            wanted += nearest(np.array([query], float), self.centroids, probes or self.probes)[0].tolist()
        return vector.search(self.vectors.where(F.col("list").isin(wanted)), query, k)

    def search_many(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
        """The same for many queries (query_id, embedding): blocks of queries against blocks of vectors of one list, of which a block of queries takes those that ask for the list."""
        kind, most, centroids = dict(queries.dtypes)["query_id"], probes or self.probes, self.centroids

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = [[-1]] * batch.num_rows
                for own, matrix in vector.matrices(batch.column(1)):
                    if len(centroids) and matrix.shape[1] == centroids.shape[1]:
                        for row, near in zip(own.tolist(), nearest(matrix, centroids, most).tolist()):
                            lists[row] = [-1, *near]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=["query_id", "embedding", "lists"])

        asked = queries.select("query_id", F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(dealt, f"query_id {kind}, embedding array<float>, lists array<int>")
        return vector.search_blocks(vector.blocks(asked, ["query_id", "lists"]), vector.blocks(self.vectors, ["doc_ord", "doc_id"], by="list"), kind, k)


def write(vectors: DataFrame, root: str, lists: int | None = None) -> VectorLists:
    """Puts all vectors (doc_id, embedding, doc_ord) into lists below a folder; as many lists as the square root of their number, unless told otherwise."""
    spark, size = vectors.sparkSession, F.size("embedding")
    vectors = vector.with_norms(vectors.select("doc_id", F.col("embedding").cast("array<float>").alias("embedding"), "doc_ord"))
    sizes = vectors.where(F.col("norm") > 0).groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    centroids, probes = np.zeros((0, 0)), 0
    if sizes:
        rows = min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * sizes.size))
        draw = F.pmod(F.xxhash64("doc_id", "doc_ord"), F.lit(1 << 40)) / F.lit(float(1 << 40))
        drawn = vectors.where((size == sizes.size) & (F.col("norm") > 0) & (draw < 1.5 * rows / sizes.n)).orderBy(F.xxhash64("doc_id", "doc_ord"), "doc_ord").limit(rows)
        sample = np.array([r[0] for r in drawn.select("embedding").collect()], float)
        centroids = fit(sample, min(lists or int(np.ceil(sizes.n**0.5)), LISTS))
        probes = probes_for(sample, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.full(batch.num_rows, -1, np.int32)
            for own, matrix in vector.matrices(batch.column(1)):
                if len(centroids) and matrix.shape[1] == centroids.shape[1]:
                    place[own] = np.where(np.abs(matrix).sum(axis=1) > 0, (matrix @ centroids.T).argmax(axis=1), -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "list"])

    placed = vectors.select("doc_id", "embedding", "doc_ord", "norm").mapInArrow(assign, "doc_id string, embedding array<float>, doc_ord long, norm double, list int")
    # By range, so that a list of very many vectors fills as many files as it needs.
    placed.repartitionByRange("list", "doc_ord").write.mode("overwrite").partitionBy("list").parquet(f"{root}/vectors")
    spark.createDataFrame([(k, c.tolist(), probes) for k, c in enumerate(centroids)], "list int, centroid array<double>, probes int").write.mode("overwrite").parquet(f"{root}/centroids")
    return VectorLists(spark, root, centroids, probes)
