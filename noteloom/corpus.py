"""The driver's tables as documents, vectors, logs and index states."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions.text import content_hash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan in as many partitions as there are cores, at least. Only files too few for the cores are dealt out anew; a large table stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _document(id_, title, tags, hours, text, order) -> list:
    return [id_.alias("id"), title.alias("title"), (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(hours=hours.cast("int"))).alias("date"), tags.alias("tags"), text.alias("text"), order.alias("doc_ord")]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table. Title and tags come from language and source, the date from the id."""
    d, k = spread(table(spark, sf_dir, "documents")), F.col("doc_id")
    return d.select(*_document(k.cast("string"), F.concat_ws(" / ", "lang", "source"), F.array("lang", "source"), k, F.col("text"), k))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = table(spark, sf_dir, "pages"), F.col("page_id")
    return d.select(*_document(F.concat(F.lit("page-"), k.cast("string")), F.col("url"), F.array(F.lit("page")), k, F.col("html"), k))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = table(spark, sf_dir, "conversations"), F.col("conv_id") * 1000 + F.col("turn")
    return d.select(*_document(F.concat_ws("-", F.lit("turn"), F.col("conv_id").cast("string"), F.col("turn").cast("string")), F.col("role"), F.array("role"), F.col("conv_id"), F.col("text"), k))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = table(spark, sf_dir, "benchmark"), F.col("item_id")
    return d.select(*_document(F.concat(F.lit("item-"), k.cast("string")), F.lit("benchmark"), F.array(F.lit("benchmark")), k, F.col("text"), k))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("doc_id"), "embedding", F.col("vec_id").alias("doc_ord"))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0]) if row else []


def old_hashes(docs: DataFrame) -> DataFrame:
    """An earlier state of the index: a tenth of the documents missing, a seventh with other text, a twentieth since removed."""
    kept = docs.where("doc_ord % 10 <> 0").select("id", content_hash("title", F.when(F.col("doc_ord") % 7 == 0, F.concat("text", F.lit(" (old)"))).otherwise(F.col("text"))).alias("content_hash"))
    gone = docs.where("doc_ord % 20 = 1").select(F.concat(F.lit("gone-"), "id").alias("id"), content_hash("title", F.col("text")).alias("content_hash"))
    return kept.unionByName(gone)


def api_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a log of calls: errors are failures, the value is the latency."""
    e = table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    category = F.element_at(F.array(*map(F.lit, ("Network", "Authentication", "RateLimit", "ParseError", "Timeout"))), (F.pmod("event_id", F.lit(5)) + 1).cast("int"))
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), (~failed).alias("ok"), (F.col("user_id") % 500).alias("prompt_tokens"), (F.col("user_id") % 90).alias("completion_tokens"),
        F.col("value").alias("latency_ms"), F.when(failed, category).alias("category"), F.when(failed, F.concat(F.lit("call "), F.col("event_id").cast("string"))).alias("message"), F.lit("stub").alias("model"),
    )


def cache_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as insertions into a cache, keyed by type and user."""
    return table(spark, sf_dir, "events").select("event_id", F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key"), F.col("event_type").alias("cache"), F.col("event_id").cast("string").alias("value"), F.col("ts").cast("timestamp").alias("created_at"))
