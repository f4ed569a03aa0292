"""Sharding by extendible hashing, with DataFrame functions only.

A document's hash is 128 bits of md5 over its id as text (null: the empty text).
A shard is a prefix of those bits. All documents start in the shard of the
empty prefix; a shard over the byte limit splits on its next bit, others do
not, until every shard fits. The directory lists the shards: bits, depth, rows
and bytes. Since one hash is one document, a third of all rows from one source
spreads as evenly as any other rows.

The directory is found from sums of bytes by prefix, ``ROUND`` bits at a time:
every round sums the documents of the shards that are still too large, in
parallel and partly before the shuffle, so no round holds more than
2 ** ROUND rows for each such shard, and a round is added only where one of them is
still too large. Rows that share one id share their shard, whatever their
size: their hash cannot be told apart (``fits`` is false when they exceed the
limit). Empty and null texts count no bytes. Rows that no split separates
within ``MAX_DEPTH`` bits stay together likewise.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import cut

#: Bits that a round of splitting looks at, and the bits of a hash that are used.
ROUND, MAX_DEPTH = 12, 60
LIMIT_BYTES = 1 << 20


def hashed(doc_id: Column) -> Column:
    """The first ``MAX_DEPTH`` bits of md5 over the id as text, as a number."""
    text = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(text, 1, MAX_DEPTH // 4), 16, 10).cast("long")


def _prefix(column: str, width: int, depth: int) -> Column:
    """The first ``depth`` bits of a number of ``width`` bits."""
    return F.shiftrightunsigned(column, width - depth)


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """Shards of rows (h, n_bytes): depth, prefix (a number of depth bits), shard_docs, shard_bytes, fits."""
    done, more, low = None, None, 0
    while True:
        high = min(low + ROUND, MAX_DEPTH)
        rows = sizes if more is None else sizes.withColumn("open", _prefix("h", MAX_DEPTH, low)).join(more, "open", "left_semi")
        leaves = rows.groupBy(_prefix("h", MAX_DEPTH, high).alias("leaf")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("b"))
        levels = F.array(*(F.struct(F.lit(d).alias("depth"), _prefix("leaf", high, d).alias("prefix")) for d in range(low, high + 1)))
        totals = cut(leaves.select(F.inline(levels), "n", "b").groupBy("depth", "prefix").agg(F.sum("n").alias("shard_docs"), F.sum("b").alias("shard_bytes")))
        over = totals.where(F.col("shard_bytes") > limit)
        # A prefix is a shard when the one above it is too large and it fits, or when no bit is left.
        split = over.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
        shard = totals.withColumn("above", F.shiftrightunsigned("prefix", 1)).join(split, ["depth", "above"], "left_semi")
        shard = shard.where((F.col("shard_bytes") <= limit) | (F.col("depth") == MAX_DEPTH))
        if low == 0:
            shard = shard.unionByName(totals.where((F.col("depth") == 0) & (F.col("shard_bytes") <= limit)).withColumn("above", F.lit(0).cast("long")))
        shard = shard.select("depth", "prefix", "shard_docs", "shard_bytes")
        done = shard if done is None else done.unionByName(shard)
        more = over.where(F.col("depth") == high).select(F.col("prefix").alias("open"))
        if high == MAX_DEPTH or more.isEmpty():
            return done.withColumn("fits", F.col("shard_bytes") <= limit)
        low = high


def shards(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, and its shard (its bits), the shard's depth, documents and bytes, and whether it fits."""
    rows = docs.select(F.col("doc_id").cast("long"), hashed(F.col("doc_id").cast("long")).alias("h"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    found = cut(directory(rows, limit))
    # Shards have different depths. A document has a prefix of each depth that occurs, and one of them is a shard.
    depths = [r.depth for r in found.select("depth").distinct().orderBy("depth").collect()]
    options = F.array(*(F.struct(F.lit(d).alias("depth"), _prefix("h", MAX_DEPTH, d).alias("prefix")) for d in depths or [0]))
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), F.lit("0")))
    return rows.select("doc_id", "n_bytes", F.inline(options)).join(found, ["depth", "prefix"]).select("doc_id", "n_bytes", bits.alias("shard"), "depth", "shard_docs", "shard_bytes", "fits")


ORACLE_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
         lpad(bin(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {MAX_DEPTH // 4}))::UBIGINT), {MAX_DEPTH}, '0') AS bits
  FROM documents),
grown AS (
  SELECT doc_id, n_bytes, bits, 0 AS depth, sum(n_bytes) OVER () AS shard_bytes, count(*) OVER () AS shard_docs FROM rows
  UNION ALL
  SELECT doc_id, n_bytes, bits, depth + 1, sum(n_bytes) OVER (PARTITION BY left(bits, depth + 1)), count(*) OVER (PARTITION BY left(bits, depth + 1))
  FROM grown WHERE shard_bytes > {LIMIT_BYTES} AND depth < {MAX_DEPTH})
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, left(bits, depth) AS shard, CAST(depth AS INTEGER) AS depth,
       CAST(shard_docs AS BIGINT) AS shard_docs, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_bytes <= {LIMIT_BYTES} AS fits
FROM grown WHERE shard_bytes <= {LIMIT_BYTES} OR depth = {MAX_DEPTH}
"""
