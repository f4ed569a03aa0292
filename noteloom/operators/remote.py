"""Injectable remote services: chat summaries and query rewriting, with the rule-based ways that serve without them."""
from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.functions.extract import SUMMARY, summary


#: Texts that a task holds as Python objects at a time.
SLICE = 256


class RemoteError(Exception):
    """An error of a service. ``kind``: network, rate_limit, authentication, model_not_found, api or parse; ``retry_after`` in seconds."""

    def __init__(self, kind: str, message: str = "", retry_after: float | None = None):
        super().__init__(message or kind)
        self.kind, self.retry_after = kind, retry_after


@dataclass(frozen=True)
class ProviderOptions:
    order: tuple[str, ...] | None = None
    allow_fallbacks: bool | None = None
    only: tuple[str, ...] | None = None
    ignore: tuple[str, ...] | None = None
    sort: str | None = None
    require_parameters: bool = False

    def to_json(self) -> dict:
        """Keys that are set; require_parameters only when true."""
        out = {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items() if v is not None}
        if not self.require_parameters:
            out.pop("require_parameters")
        return out


def with_retries(call: Callable, *args, retries: int = 3, sleep: Callable[[float], None] = time.sleep):
    """A call repeated after network errors (2 ** n seconds) and rate limits (the time asked for or a minute, at least 2 ** n). Other errors end it."""
    for n in range(retries + 1):
        try:
            return call(*args)
        except RemoteError as error:
            if error.kind not in ("network", "rate_limit") or n == retries:
                raise
            pause = 2.0**n
            if error.kind == "rate_limit":
                pause = max(60.0 if error.retry_after is None else error.retry_after, pause)
            sleep(pause)


def embed_with_retries(embed: Callable[[list[str]], list[list[float]]], texts: list[str], attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """Embeddings with up to ``attempts`` tries, two and four seconds apart, after rate limits and network errors only."""
    for n in range(attempts):
        try:
            return embed(texts)
        except RemoteError as error:
            if error.kind not in ("network", "rate_limit") or n == attempts - 1:
                raise
            sleep(2.0 ** (n + 1))
    return []


def summarise(extracted: DataFrame, chat: Callable[[str], str] | None = None, n: int = SUMMARY, at_once: int = 8) -> DataFrame:
    """Rows with ``content`` (an extracted struct) get ``summary`` and ``summary_method``: by the chat service where given, by rule where it is not or fails. A task has up to ``at_once`` calls open."""
    rule = summary(F.col("content.text"), F.col("content.total_chars"), F.col("content.total_lines"), n)
    out = extracted.withColumn("summary", rule).withColumn("summary_method", F.lit("rule-based"))
    if chat is None:
        return out

    def ask(text: str) -> str | None:
        try:
            return chat(text)
        except RemoteError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for whole in batches:
                for at in range(0, whole.num_rows, SLICE):
                    batch = whole.slice(at, SLICE)
                    answers = pa.array(list(pool.map(ask, batch.column("source").to_pylist())), pa.string())
                    known = answers.is_valid()
                    new = {"summary": pc.coalesce(answers, batch.column("summary").cast(pa.string())), "summary_method": pc.if_else(known, "llm", batch.column("summary_method").cast(pa.string()))}
                    yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in columns], names=columns)

    columns = [c for c in out.columns if c != "content"]
    flat = out.select(*columns, F.col("content.text").alias("source"))
    return flat.mapInArrow(run, out.select(*columns).schema)


def use_chat(enabled: bool, api_key: str | None) -> bool:
    return enabled and bool(api_key)


def rewrite(query: str, valid: DataFrame, chat: Callable[[str], str] | None) -> tuple[str, bool]:
    """(rewritten query, whether it is new and to be cached). A query that the service can't rewrite stands for itself, and that is cached as well."""
    known = valid.where(F.col("query") == query).select("rewritten").first()
    if known:
        return known[0], False
    try:
        answer = (chat(query) if chat else query).strip()
    except RemoteError:
        answer = query
    return answer or query, True
