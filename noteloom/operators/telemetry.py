"""Analytics over a log of API calls (schema.API_CALL, with an event_id that orders equal times)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Errors that a collector remembers.
ERRORS_KEPT = 100
CATEGORIES = ("Network", "Authentication", "RateLimit", "ModelNotFound", "InvalidRequest", "ServerError", "ParseError", "Timeout", "Unknown")


def since(calls: DataFrame, resets: DataFrame) -> DataFrame:
    """Calls after the last reset (resets: ts); all of them where there was none. A call at the time of a reset is gone."""
    last = resets.agg(F.max("ts").alias("reset"))
    return calls.join(F.broadcast(last), F.col("reset").isNull() | (calls["ts"] > F.col("reset"))).select(calls.columns)


def usage(calls: DataFrame) -> DataFrame:
    """One row: calls, successes, failures, token sums and latencies of successes, rate of success in percent."""
    ok, n = F.col("ok"), F.count(F.lit(1))
    good = F.count_if(ok)
    total = lambda c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).cast("long")
    latency = F.when(ok, F.col("latency_ms"))
    return calls.agg(
        n.alias("total_calls"), good.alias("successful_calls"), F.count_if(~ok).alias("failed_calls"), total("prompt_tokens").alias("prompt_tokens"), total("completion_tokens").alias("completion_tokens"),
        (total("prompt_tokens") + total("completion_tokens")).alias("total_tokens"), F.round(F.min(latency), 6).alias("min_latency_ms"), F.round(F.max(latency), 6).alias("max_latency_ms"), F.round(F.avg(latency), 4).alias("avg_latency_ms"),
        F.when(n > 0, F.round(100.0 * good / n, 6)).otherwise(0.0).alias("success_rate"),
    )


def error_counts(calls: DataFrame) -> DataFrame:
    return calls.where("not ok").groupBy("category").agg(F.count(F.lit(1)).alias("n_errors"))


def recent_errors(calls: DataFrame, n: int = ERRORS_KEPT) -> DataFrame:
    """The newest n errors, newest first."""
    return calls.where("not ok").orderBy(F.desc("ts"), F.desc("event_id")).limit(n).select("event_id", "ts", "category", "message", "model")


def report(calls: DataFrame) -> str:
    """A text for people: two small results, formatted on the driver."""
    u = usage(calls).first()
    lines = [
        "API usage", f"Calls: {u.total_calls} ({u.successful_calls} successful, {u.failed_calls} failed, {u.success_rate:.1f}%)",
        f"Tokens: {u.total_tokens} (prompt {u.prompt_tokens}, completion {u.completion_tokens})",
        f"Latency: average {u.avg_latency_ms or 0:.1f} ms, from {u.min_latency_ms or 0:g} to {u.max_latency_ms or 0:g} ms",
    ]
    errors = error_counts(calls).orderBy("category").collect()
    return "\n".join([*lines, *(f"Error {r.category}: {r.n_errors}" for r in errors)])
