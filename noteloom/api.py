"""The tools over a stored index, as frames and as texts for people."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.config import AppConfig, SearchConfig
from noteloom.operators import docstore
from noteloom.operators.remote import ProviderOptions, summarise, use_chat
from noteloom.operators.service import Service
from noteloom.plans.searcher import Searcher, memo_results, recent_memos


def chat_of(config: AppConfig):
    """Summaries by the configured service; None without one, or where they are switched off."""
    if not use_chat(config.summarization_enabled, config.api_key) or not config.service_url:
        return None
    provider = ProviderOptions(config.provider_order, config.provider_allow_fallbacks, config.provider_only, config.provider_ignore, config.provider_sort, config.provider_require_parameters)
    service, most, heat = Service(config.service_url, config.api_key, config.summarization_model, provider=provider), config.summarization_max_tokens, config.summarization_temperature
    return lambda text: service.complete(text, max_tokens=most, temperature=heat).content


def embedding_service(config: AppConfig) -> Service | None:
    """The configured service as an embedder; None without a key or an address."""
    return Service(config.service_url, config.api_key, config.embedding_model, timeout=60.0) if config.api_key and config.service_url else None


def query_memos(
    searcher: Searcher, query: str = "", config: AppConfig | None = None, top_k: int = 10, tag_filter: str | None = None, mode: str | None = None, extraction_mode: str | None = None,
    max_chars: int | None = None, include_summary: bool | None = None, use_llm_summary: bool = False, chat=None,
) -> DataFrame:
    """Search results with content and, beyond snippets, a summary: by rule, or by ``chat`` or the configured service where that is asked for."""
    config = config or AppConfig()
    search = SearchConfig().with_mode(mode or config.default_search_mode).with_top_k(top_k).with_tag_filter(tag_filter)
    extraction = extraction_mode or config.extraction_mode
    rows = memo_results(searcher.search(query, search), searcher.docs, extraction, max_chars or config.extraction_max_chars)
    content = [F.col("content.text").alias("text"), F.col("content.truncated").alias("truncated"), F.col("content.total_chars").alias("total_chars"), F.col("content.extracted_chars").alias("extracted_chars")]
    if extraction not in ("entry", "full") or not (config.extraction_include_summary if include_summary is None else include_summary):
        return rows.select("rank", "doc_id", "score", "title", "date", "tags", *content, F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("summary_method"))
    if chat is None and (use_llm_summary or config.summarization_enabled):
        chat = chat_of(config.merge(AppConfig(summarization_enabled=True)))
    return summarise(rows.select("rank", "doc_id", "score", "title", "date", "tags", *content, "content"), chat).drop("content")


def _indented(text: str) -> str:
    return "\n".join("   " + line for line in text.splitlines())


def render_memos(searcher: Searcher, query: str = "", include_raw: bool | None = None, **options) -> str:
    """``query_memos`` as text. At most top_k rows come to the driver. Without raw content there are summaries alone, but for snippets."""
    config = options.get("config") or AppConfig()
    snippets = (options.get("extraction_mode") or config.extraction_mode) not in ("entry", "full")
    raw = snippets or (config.extraction_include_raw if include_raw is None else include_raw)
    rows = query_memos(searcher, query, **options).orderBy("rank").collect()
    parts = [f"{len(rows)} results for {query!r}"]
    if (options.get("mode") or config.default_search_mode) in ("semantic", "hybrid") and not searcher.has_vector_index():
        parts.append("There is no vector index; build one with embeddings for semantic search.")
    for r in rows:
        cut = f" [{r.extracted_chars} of {r.total_chars} characters]" if r.truncated else ""
        summary = f"\n   Summary ({r.summary_method})\n{_indented(r.summary)}" if r.summary else ""
        parts.append(f"{r.rank}. [{r.score}] {r.title}\n   {r.date} {list(r.tags)}" + summary + (f"\n{_indented(r.text)}{cut}" if raw else ""))
    return "\n\n".join(parts)


def list_tags(searcher: Searcher) -> DataFrame:
    return docstore.tag_counts(searcher.docs).orderBy("tag")


def render_tags(searcher: Searcher) -> str:
    rows = list_tags(searcher).collect()
    return "\n".join([f"{len(rows)} tags", *(f"- {r.tag} ({r.n_docs})" for r in rows)])


def get_recent_memos(searcher: Searcher, limit: int = 10) -> DataFrame:
    return recent_memos(searcher.docs, limit)


def render_recent(searcher: Searcher, limit: int = 10) -> str:
    rows = get_recent_memos(searcher, limit).collect()
    return "\n\n".join([f"{len(rows)} recent memos", *(f"{k + 1}. {r.title}\n   {r.date} {list(r.tags)}\n   {r.snippet}" for k, r in enumerate(rows))])
