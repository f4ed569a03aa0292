"""Caches with a lifetime and a capacity, over tables of insertions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteloom.functions.text import col

#: Seconds and entries: general default, summaries, rewritten queries.
TTL, CAPACITY = 3600, 100
SUMMARY_TTL, SUMMARY_CAPACITY = 7200, 200
REWRITE_TTL = 86_400


def key(content, model) -> Column:
    return F.sha2(F.concat(col(content), col(model)), 256)


def latest(log: DataFrame, *by: str, order: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """The last row of each key: inserting again refreshes a row."""
    row = F.struct(*log.columns)
    return log.groupBy(*by).agg(F.max_by(row, F.struct(*order)).alias("row")).select("row.*")


def put(rows: DataFrame, more: DataFrame, *by: str) -> DataFrame:
    """Rows with others put in: of equal keys the newest stays, and of equal times that of ``more``."""
    both = rows.withColumn("turn", F.lit(0)).unionByName(more.withColumn("turn", F.lit(1)))
    return latest(both, *by, order=("created_at", "turn")).drop("turn")


def drop(rows: DataFrame, keys: DataFrame, by: str = "key") -> DataFrame:
    """Without the rows of some keys."""
    return rows.join(keys.select(by), by, "left_anti").select(*rows.columns)


def clear(rows: DataFrame) -> DataFrame:
    """No rows; outcomes of lookups are a log of their own, so statistics stay."""
    return rows.limit(0)


def size(rows: DataFrame) -> DataFrame:
    """Entries, expired ones included until they are cleaned up, and whether there are none."""
    return rows.agg(F.count(F.lit(1)).alias("n_entries")).select("n_entries", (F.col("n_entries") == 0).alias("is_empty"))


def summaries(rows: DataFrame, more: DataFrame, now) -> DataFrame:
    """The summary cache after insertions: live entries, the newest of each key, as many as it has room for."""
    return evict(live(put(rows, more, "key", "cache"), now, SUMMARY_TTL), SUMMARY_CAPACITY)


def _age(now) -> Column:
    return F.unix_micros(F.lit(now).cast("timestamp") if isinstance(now, str) else now) - F.unix_micros("created_at")


def live(rows: DataFrame, now, ttl: int = TTL) -> DataFrame:
    """Rows no older than the lifetime; a row of exactly that age is live."""
    return rows.where(_age(now) <= ttl * 1_000_000)


def expired(rows: DataFrame, now, ttl: int = TTL) -> DataFrame:
    return rows.where(_age(now) > ttl * 1_000_000)


def rewrites_valid(rows: DataFrame, now, ttl: int = REWRITE_TTL) -> DataFrame:
    """Rewritten queries younger than the lifetime; one of exactly that age has expired."""
    return rows.where(_age(now) < ttl * 1_000_000)


def rewrites_expired(rows: DataFrame, now, ttl: int = REWRITE_TTL) -> DataFrame:
    return rows.where(_age(now) >= ttl * 1_000_000)


def evict(rows: DataFrame, capacity: int = CAPACITY, cache: str = "cache", order: tuple[str, ...] = ("created_at", "key")) -> DataFrame:
    """The newest ``capacity`` rows of each cache."""
    place = F.row_number().over(W.partitionBy(cache).orderBy(*(F.desc(c) for c in order)))
    return rows.withColumn("place", place).where(F.col("place") <= capacity).drop("place")


def lookups(requests: DataFrame, rows: DataFrame, now, ttl: int = TTL) -> DataFrame:
    """(key, value, outcome) of requested keys: hit, miss, or expired, which is a miss too."""
    age = _age(now)
    outcome = F.when(F.col("created_at").isNull(), "miss").when(age > ttl * 1_000_000, "expired").otherwise("hit")
    return requests.join(rows.select("key", "value", "created_at"), "key", "left").select("key", F.when(outcome == "hit", F.col("value")).alias("value"), outcome.alias("outcome"))


def hit_rate(outcomes: DataFrame) -> DataFrame:
    """hits, misses, expirations and the rate of hits in percent, zero without lookups."""
    hits, all_ = F.count_if(F.col("outcome") == "hit"), F.count(F.lit(1))
    return outcomes.agg(hits.alias("hits"), (all_ - hits).alias("misses"), F.count_if(F.col("outcome") == "expired").alias("expirations"), F.when(all_ > 0, F.round(100.0 * hits / all_, 6)).otherwise(0.0).alias("hit_rate"))
