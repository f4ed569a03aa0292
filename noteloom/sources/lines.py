"""Lines of text files, read in splits of any size.

Spark gives each task some stretches of files (blocks), and a line belongs to the block in which it starts. Where a line or an entry stands in its file
follows from sums over the blocks before its own: a row for each block, however long the files.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, block, value) of all lines; a task has the lines of a block one after the other, as they stand in the file."""
    address = F.regexp_replace("_metadata.file_path", r"^(\w+):/+", "$1:/")  # one slash after the scheme, however many it has
    return spark.read.option("lineSep", "\n").text(paths).select(address.alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def before(blocks: DataFrame, count: str) -> DataFrame:
    """``blocks`` (file, block and a count for each) with the sum over the earlier blocks of the file (before)."""
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return blocks.withColumn("before", F.coalesce(F.sum(count).over(earlier), F.lit(0)))


def numbered(lines: DataFrame) -> DataFrame:
    """``lines`` with line_no, from one in each file, and input, the number of the file in the order of their names.

    Lines are counted in a first pass and read again in a second one; both deal the same blocks to the same tasks. No line is shuffled as long as the blocks' counts are few enough for Spark to send them.
    """
    placed = lines.withColumn("at", F.monotonically_increasing_id())
    blocks = placed.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    blocks = before(blocks, "n").withColumn("input", F.dense_rank().over(W.orderBy("file")) - 1)
    line = F.col("before") + F.col("at") - F.col("first") + 1
    return placed.join(blocks, ["file", "block"]).select(*lines.columns, line.alias("line_no"), F.col("input").cast("long").alias("input"))


def ordered(lines: DataFrame) -> DataFrame:
    """``lines`` with line, from zero through all files in the order of their names."""
    placed = lines.withColumn("at", F.monotonically_increasing_id())
    blocks = placed.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    earlier = W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return placed.join(blocks.drop("n"), ["file", "block"]).select(*lines.columns, (F.col("before") + F.col("at") - F.col("first")).alias("line"))


def ranked(rows: DataFrame, order: str, name: str, bits: int = 16) -> DataFrame:
    """``rows`` with their place (name, from one) by a column of distinct whole numbers, none of them sorted in one task: places follow from counts of ranges of numbers, a row for each range."""
    reach = F.shiftright(order, bits)
    counts = rows.select(reach.alias("reach")).groupBy("reach").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.orderBy("reach").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("reach", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("reach").orderBy(order))
    return rows.withColumn("reach", reach).withColumn(name, place).join(before, "reach").withColumn(name, F.col(name) + F.col("before")).drop("reach", "before")
