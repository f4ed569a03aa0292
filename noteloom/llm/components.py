"""Connected components of links between integer nodes, kept in tables throughout."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import cut

#: Links that one task takes, about.
LINKS = 1 << 18


def roots(parent: np.ndarray) -> np.ndarray:
    """Every node's root, by pointer jumping."""
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Parents after the links a-b; roots are the smallest index of their set."""
    parent = roots(parent)
    while len(a):
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        parent = roots(parent)
    return parent


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b), component its smallest reachable node.

    Alternates large and small stars until nothing changes: a large star links
    each node's greater neighbours to its smallest one, a small star does so
    with its lesser ones. Each round is cut with a checkpoint. No node's
    neighbours are ever gathered: a minimum per node and a join serve, and
    Spark splits that join where one node has very many links. There are as many tasks as
    the links need, not one for each of the partitions they came from: no round has more links than the first.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    tasks = max(1, -(-edges.count() // LINKS))
    edges = edges.coalesce(tasks)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").coalesce(tasks).distinct().coalesce(tasks))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = cut(small.where("u <> v").coalesce(tasks).distinct().coalesce(tasks))
        # Stars remain when every node has one centre and no centre has one itself.
        loose = new.groupBy("u").count().where("count > 1").select("u").unionByName(new.select("v").join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").withColumnRenamed("v", "u"))
        edges = new
        if loose.isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
