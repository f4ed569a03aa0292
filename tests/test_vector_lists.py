"""Vectors in lists: recall against the exact search, what is read, edges."""
import numpy as np
import pytest

from noteloom import corpus
from noteloom.operators import vector
from noteloom.plans import searcher, vector_lists
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def lists(spark, tmp_path_factory):
    return vector_lists.write(corpus.vectors(spark, DATA), str(tmp_path_factory.mktemp("lists")))


def asked(spark):
    return corpus.vectors(spark, DATA).where("doc_ord % 20 = 0").select(F.col("doc_ord").alias("query_id"), "embedding")


def test_recall_and_what_is_read(spark, lists):
    exact = {(r.query_id, r.doc_id): r.score for r in vector.search_many(corpus.vectors(spark, DATA), asked(spark), 10).collect()}
    found = {(r.query_id, r.doc_id): r.score for r in lists.search_many(asked(spark), 10).collect()}
    hits = exact.keys() & found.keys()
    assert len(hits) >= 0.9 * len(exact) and all(exact[k] == found[k] for k in hits)
    assert lists.probes < len(lists.centroids) and lists.vectors.count() == corpus.vectors(spark, DATA).count()


def test_one_query_reads_its_lists_only(spark, lists):
    query = corpus.query_vector(spark, DATA)
    frame = lists.search(query, 10)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "list" in plan.split("PartitionFilters")[1].split("]")[0]
    many = {r.doc_id: (r.rank, r.score) for r in lists.search_many(asked(spark).where("query_id = 0"), 10).collect()}
    assert {r.doc_id: (r.rank, r.score) for r in frame.collect()} == many
    # All lists give the exact search.
    whole = [tuple(r) for r in vector.search(corpus.vectors(spark, DATA), query, 10).collect()]
    assert [tuple(r) for r in lists.search(query, 10, len(lists.centroids)).collect()] == whole
    again = vector_lists.VectorLists.open(spark, lists.root)
    assert np.allclose(again.centroids, lists.centroids) and again.probes == lists.probes
    assert [tuple(r) for r in again.search(query, 10).collect()] == [tuple(r) for r in lists.search(query, 10).collect()]


def test_many_exact_queries_are_single_ones(spark):
    docs = corpus.vectors(spark, "/root/testdata/sf0.001").limit(70)
    odd = spark.createDataFrame([("two", [1.0, 0.0], 900), ("zero", [0.0] * 64, 901), ("none", None, 902), ("empty", [], 903), ("again", [1.0, 0.0], 899)], "doc_id string, embedding array<float>, doc_ord long")
    vectors = docs.unionByName(odd).cache()
    queries = vectors.where("doc_ord % 9 = 0 or doc_ord >= 900").select(F.col("doc_id").alias("query_id"), "embedding")
    found = vector.search_many(vectors, queries, 5, block=7).collect()
    for q in queries.collect():
        want = [tuple(r) for r in vector.search(vectors, list(q.embedding or []), 5).orderBy("rank").collect()]
        assert sorted(tuple(r)[1:] for r in found if r.query_id == q.query_id) == want
    assert [r.doc_id for r in sorted(found, key=lambda r: r.rank) if r.query_id == "two"] == ["again", "two"]


def test_edges(spark, tmp_path):
    vectors = spark.createDataFrame([(str(k), [float(k % 5), 1.0, float(k)], k) for k in range(40)] + [("two", [1.0, 0.0], 90), ("zero", [0.0, 0.0, 0.0], 91), ("none", None, 92)], "doc_id string, embedding array<float>, doc_ord long")
    lists = vector_lists.write(vectors, f"{tmp_path}/a", lists=4)
    assert {r.doc_id for r in lists.vectors.where("list = -1").collect()} == {"two", "zero", "none"}
    assert [r.doc_id for r in lists.search([2.0, 0.0], 3).collect()] == ["two"] and lists.search([], 3).collect() == []
    assert [r.doc_id for r in lists.search_many(spark.createDataFrame([(1, [2.0, 0.0])], "query_id int, embedding array<float>"), 3).collect()] == ["two"]
    nothing = vector_lists.write(vectors.limit(0), f"{tmp_path}/b")
    assert nothing.search([1.0], 3).collect() == [] and vector_lists.VectorLists.open(spark, f"{tmp_path}/b").probes == 0
    same = vector_lists.write(spark.createDataFrame([(str(k), [1.0, 2.0], k) for k in range(30)], vectors.schema), f"{tmp_path}/c")
    assert [r.doc_id for r in same.search([1.0, 2.0], 3).collect()] == ["0", "1", "2"]
    s = searcher.Searcher(None, None, vectors, lists=same)
    assert [r.doc_id for r in s.by_vector([1.0, 2.0], 2).collect()] == ["0", "1"]


def test_many_queries_pass_on_their_best_once_a_task(spark):
    """Rows before the ranking follow the queries and the tasks, not the pairs of blocks."""
    vectors = corpus.vectors(spark, DATA).coalesce(1).cache()
    queries = vectors.where("doc_ord % 20 = 0").select(F.col("doc_ord").alias("query_id"), "embedding")
    made = spark.sparkContext.accumulator(0)
    ranked, vector.ranked_many = vector.ranked_many, lambda found, k: found
    try:
        found = vector.search_many(vectors, queries, 10, block=16)
    finally:
        vector.ranked_many = ranked
    found.foreach(lambda _: made.add(1))
    assert made.value == 10 * queries.count()
