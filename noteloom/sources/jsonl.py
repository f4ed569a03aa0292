"""Documents as JSON lines."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions.text import trim_unicode
from noteloom.schema import DOCUMENT_JSON
from noteloom.sources import lines


def parse(rows: DataFrame) -> DataFrame:
    """Documents of lines (line_no, value; input and file where there are several files). Blank lines and those that start with # are skipped; any other that is no document fails the load and is named by its number.

    Documents are numbered by file and line.
    """
    several = "input" in rows.columns
    order = F.col("line_no").cast("long") + (F.shiftleft("input", 32) if several else 0)
    place = F.concat(F.col("file"), F.lit(": ")) if several else F.lit("")
    rows = rows.select("line_no", order.alias("doc_ord"), place.alias("place"), trim_unicode("value").alias("value")).where((F.col("value") != "") & ~F.col("value").startswith("#"))
    rows = rows.withColumn("d", F.from_json("value", DOCUMENT_JSON))
    date = F.try_to_timestamp(F.col("d.metadata.date"))
    whole = F.col("d.id").isNotNull() & F.col("d.text").isNotNull() & F.col("d.metadata.title").isNotNull() & date.isNotNull() & F.col("d.metadata.tags").isNotNull()
    checked = F.when(whole, F.col("d")).otherwise(F.raise_error(F.concat("place", F.lit("line "), F.col("line_no").cast("string"), F.lit(" is no document"))))
    return rows.withColumn("d", checked).select(F.col("d.id").alias("id"), F.col("d.metadata.title").alias("title"), F.to_timestamp(F.col("d.metadata.date")).alias("date"), F.col("d.metadata.tags").alias("tags"), F.col("d.text").alias("text"), "doc_ord")


def number_lines(texts: DataFrame) -> DataFrame:
    """(line_no, value) of whole texts (value), counted from one within each text."""
    return texts.select(F.posexplode(F.split("value", "\n")).alias("at", "value")).select((F.col("at") + 1).alias("line_no"), "value")


def load(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Documents of a file, a folder or several; files of any length are read in splits."""
    return parse(lines.numbered(lines.read(spark, path)))


def load_string(spark: SparkSession, text: str) -> DataFrame:
    return parse(number_lines(spark.createDataFrame([(text,)], "value string")))
