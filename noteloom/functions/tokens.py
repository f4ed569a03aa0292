"""Tokens: upper-cased Latin words with their camel parts, digits, and a fallback for Chinese characters and kana.

No morphological analyser comes with this package. The fallback takes runs of katakana, and
runs of Han characters with their pairs; hiragana is left out. An analyser can be
given as a column function from text to tokens; ``morphological`` makes one of any program that
splits a text into morphemes with their details.
"""
from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from noteloom.functions.text import col

WORD, DIGITS = r"[A-Za-z][A-Za-z0-9]*", r"\p{Nd}+"
CAMEL = ((r"([a-z0-9])([A-Z])", "$1 $2"), (r"([A-Za-z])([0-9])", "$1 $2"), (r"([0-9])([A-Za-z])", "$1 $2"))
# A border has a capital or a digit on one side, which are rarer than small letters, so that most places take one comparison.
_ANY_CAMEL = r"[A-Z0-9](?:(?<=[a-z][A-Z0-9]|[0-9][A-Z]|[A-Z][0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Z])(?=[0-9]))"
_KATAKANA, _HAN = r"[ァ-ヺー-ヿ]+", r"[㐀-䶿一-鿿豈-﫿]+"
# Parts of speech that an analyser keeps, and details that it drops.
KEPT_POS = ("名詞", "動詞", "形容詞", "副詞")
DROPPED_DETAILS = ("非自立", "接尾", "数")


#: Texts whose morphemes a task holds as Python objects at a time.
SLICE = 64
Analyser = Callable[[Column], Column]
#: Of a morpheme's details the parts of speech, and where the base form is.
_POS, _DETAIL, _BASE = 0, 1, 6


def kept_form(surface: str, details: Sequence[str]) -> str | None:
    """What a morpheme counts as: its base form, or itself where it has none; None for one that is left out."""
    if not details or details[_POS] not in KEPT_POS or len(details) > _DETAIL and details[_DETAIL] in DROPPED_DETAILS:
        return None
    return details[_BASE] if len(details) > _BASE and details[_BASE] not in ("", "*") else surface


def morphological(analyse: Callable[[str], Sequence[tuple[str, Sequence[str]]]]) -> Analyser:
    """A column function from a program that gives (surface, details) of each morpheme of a text. Tokens may repeat; blank texts have none."""

    @F.arrow_udf("array<string>")
    def forms(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in texts:
            for at in range(0, len(whole), SLICE):
                part = whole.slice(at, SLICE).to_pylist()
                yield pa.array([[f for m in analyse(t) if (f := kept_form(*m)) is not None] if t and t.strip() else [] for t in part], pa.list_(pa.string()))

    return lambda text: forms(col(text))


def split_camel(word) -> Column:
    """Parts of a word at lower-upper, letter-digit and digit-letter borders; a run of capitals stays whole."""
    out = col(word)
    for pattern, to in CAMEL:
        out = F.regexp_replace(out, pattern, to)
    return F.split(out, " ")


def _words(t: Column) -> Column:
    """Words in upper case, each followed by its camel parts if it has several."""
    words = F.array_distinct(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))
    split = F.flatten(F.transform(words, lambda w: F.when(w.rlike(_ANY_CAMEL), F.concat(F.array(F.upper(w)), F.transform(split_camel(w), F.upper))).otherwise(F.array(F.upper(w)))))
    # Few texts have borders within words; the others need no split.
    return F.when(t.rlike(_ANY_CAMEL), split).otherwise(F.transform(words, F.upper))


def latin_tokens(*texts) -> Column:
    """Words and their parts, then all digit runs; the first of equal ones stays. Several texts count as one with spaces between."""
    columns = [col(t) for t in texts]
    return F.array_distinct(F.concat(*map(_words, columns), *(F.regexp_extract_all(t, F.lit(DIGITS), F.lit(0)) for t in columns)))


def cjk_tokens(text) -> Column:
    t = col(text)
    han = F.regexp_extract_all(t, F.lit(_HAN), F.lit(0))
    pairs = F.flatten(F.transform(han, lambda r: F.when(F.length(r) > 2, F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))))
    found = F.concat(F.regexp_extract_all(t, F.lit(_KATAKANA), F.lit(0)), han, pairs)
    # These characters take more than a byte, so texts of ASCII alone need no search.
    return F.when((F.octet_length(t) > F.length(t)) & t.rlike(f"{_KATAKANA}|{_HAN}"), F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def tokens(*texts, analyser: Analyser = cjk_tokens) -> Column:
    """Distinct tokens in order, those of the analyser first. Several texts count as one with spaces between. Null gives none."""
    columns = [F.coalesce(col(t), F.lit("")) for t in texts]
    return F.array_distinct(F.concat(*map(analyser, columns), latin_tokens(*columns)))


def query_tokens(text: str, analyser: Analyser = cjk_tokens, spark: SparkSession | None = None) -> list[str]:
    """The same tokens of one query. On the driver, but for an analyser of one's own, which needs a session."""
    if analyser is not cjk_tokens:
        return list(spark.range(1).select(tokens(F.lit(text), analyser=analyser)).first()[0])
    out: dict[str, None] = {}
    han = re.findall(_HAN, text)
    for run in [*re.findall(_KATAKANA, text), *han]:
        out[run] = None
    for run in han:
        if len(run) > 2:
            out.update(dict.fromkeys(run[i : i + 2] for i in range(len(run) - 1)))
    for word in re.findall(WORD, text, re.ASCII):
        out[word.upper()] = None
        parts = word
        for pattern, to in CAMEL:
            parts = re.sub(pattern, to.replace("$", "\\"), parts)
        if " " in parts:
            out.update(dict.fromkeys(p.upper() for p in parts.split(" ")))
    run = ""
    for c in [*text, ""]:
        if c and unicodedata.category(c) == "Nd":
            run += c
        elif run:
            out[run] = None
            run = ""
    return list(out)
