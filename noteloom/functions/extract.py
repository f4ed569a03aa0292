"""Extraction of content from texts: heads, entries, tags, statistics, summaries."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noteloom.functions.text import col, line_count, rtrim_unicode, trim_unicode

MAX_CHARS, SNIPPET, SUMMARY = 5000, 150, 200
_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
ENTRY = rf"^\* [^\n]+ {_DATE}"


def _content(text: Column, cut: Column, truncated: Column) -> Column:
    return F.struct(cut.alias("text"), truncated.alias("truncated"), F.length(text).cast("long").alias("total_chars"), line_count(text).alias("total_lines"), F.length(cut).cast("long").alias("extracted_chars"))


def head(text, n: int, max_chars: int | None = MAX_CHARS) -> Column:
    """The first n code points, or ``max_chars`` if that is less."""
    t = col(text)
    cut = F.substring(t, 1, n if max_chars is None else min(n, max_chars))
    return _content(t, cut, F.length(cut) < F.length(t))


def full(text, max_chars: int | None = MAX_CHARS) -> Column:
    """The whole text, cut to ``max_chars`` if longer; None is no limit."""
    t = col(text)
    cut = t if max_chars is None else F.substring(t, 1, max_chars)
    return _content(t, cut, F.length(cut) < F.length(t))


def header_tags(header) -> Column:
    return F.regexp_extract_all(col(header), F.lit(r"\[([^\]]+)\]"), F.lit(1))


def entries(text) -> Column:
    """Entries of a change log: array of (title, date, tags, content). A header line opens an entry, which runs to the next one."""
    t = F.regexp_replace(col(text), "\r\n", "\n")
    # Cut before every header; what lies before the first one is dropped.
    joined = F.filter(F.split(t, rf"(?m)(?={ENTRY})"), lambda part: part.rlike(ENTRY))

    def parsed(entry: Column) -> Column:
        header = F.split(entry, "\n")[0]
        title = trim_unicode(F.regexp_extract(F.regexp_replace(header, r"^(\* )+", ""), rf"^(.*?){_DATE}", 1))
        return F.struct(title.alias("title"), F.regexp_extract(header, _DATE, 0).alias("date"), header_tags(header).alias("tags"), rtrim_unicode(entry).alias("content"))

    return F.transform(joined, parsed)


def _cut_entry(text: Column, content: Column, max_chars: int | None) -> Column:
    cut = content if max_chars is None else F.substring(content, 1, max_chars)
    return _content(text, cut, F.length(cut) < F.length(content))


def current_entry(text, max_chars: int | None = MAX_CHARS) -> Column:
    """The first entry, or the whole text where there is none. Totals describe the whole text."""
    t = col(text)
    found = F.get(entries(t), F.lit(0))
    return F.when(t.rlike(rf"(?m){ENTRY}"), _cut_entry(t, found["content"], max_chars)).otherwise(full(t, max_chars))


def entry_by_title(text, title: str, max_chars: int | None = MAX_CHARS) -> Column:
    """The first entry whose title or content holds ``title``; null where none does."""
    t = col(text)
    found = F.get(F.filter(entries(t), lambda e: F.contains(e["title"], F.lit(title)) | F.contains(e["content"], F.lit(title))), F.lit(0))
    return F.when(found.isNotNull(), _cut_entry(t, found["content"], max_chars))


def extract(text, strategy: str = "snippet", max_chars: int | None = MAX_CHARS) -> Column:
    """Content by strategy: entry, full, or snippet, which also serves for unknown names."""
    if strategy == "entry":
        return current_entry(text, max_chars)
    return full(text, max_chars) if strategy == "full" else head(text, SNIPPET, None)


def summary(text, total_chars, total_lines, n: int = SUMMARY) -> Column:
    """The first n characters; of longer texts with a line that gives the document's totals."""
    t = col(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("...\n["), col(total_chars).cast("string"), F.lit(" chars, "), col(total_lines).cast("string"), F.lit(" lines]"))).otherwise(t)
