"""Expressions over titles and texts."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMBED_CHARS = 6000
#: Unicode white space, which Spark's trim does not cover.
_SPACE = r"\p{IsWhite_Space}"


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_unicode(x) -> Column:
    return F.regexp_replace(col(x), rf"^{_SPACE}+|{_SPACE}+$", "")


def rtrim_unicode(x) -> Column:
    return F.regexp_replace(col(x), rf"{_SPACE}+$", "")


def content_hash(title, text) -> Column:
    """First 16 hex digits of SHA-256 over title, a zero byte, text."""
    return F.substring(F.sha2(F.concat(col(title), F.char(F.lit(0)), col(text)), 256), 1, 16)


def has_tag(tags, tag: str) -> Column:
    return F.array_contains(col(tags), tag)


def category(title) -> Column:
    """The part before the first " / "; null for an empty title."""
    return F.when(col(title) != "", F.get(F.split(col(title), " / "), F.lit(0)))


def subcategory(title) -> Column:
    """The second part between " / "; null where there is none."""
    return F.get(F.split(col(title), " / "), F.lit(1))


def embedding_text(title, tags, text) -> Column:
    """Heading, tag line unless the joined tags are empty, blank line, text."""
    joined = F.array_join(col(tags), ", ")
    return F.concat(F.lit("# "), col(title), F.lit("\n"), F.when(joined != "", F.concat(F.lit("タグ: "), joined, F.lit("\n"))).otherwise(""), F.lit("\n"), col(text))


def embedding_clamp(text, most: int = EMBED_CHARS) -> Column:
    """Trimmed; a placeholder when empty; cut with dots when too long."""
    t = trim_unicode(text)
    return F.when(t == "", "(empty)").when(F.length(t) > most, F.concat(F.substring(t, 1, most - 3), F.lit("..."))).otherwise(t)


def line_count(text) -> Column:
    """Lines of a text; a line end at the end adds none."""
    t = col(text)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, "\n")) - F.endswith(t, F.lit("\n")).cast("int")).cast("long")
