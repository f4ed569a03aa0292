"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text is made for each language. A text is parsed against it: the longest stretch that
occurs somewhere in the labelled text is a phrase, then the next one begins. A phrase costs as many bits as it takes to point
into the labelled text or name a byte, log2 of its length and 256; the language whose phrases cost least for the text wins. So phrases are
normalised for how much text each language has. The score is the winner's share if every language's code length stands for its likelihood.

Texts are read as lower-case words of letters and marks, joined by single spaces. They are parsed in stretches of
``STRETCH`` bytes, in which phrases end, so that thousands of stretches take each step together in numpy, a long text and a short one alike.

Labelled text is sampled within stated bounds: of each language ``ROWS`` different documents at most, drawn by hash, and ``ROW_BYTES`` from the middle of
each; all languages together ``TOTAL_BYTES``; the ``LANGUAGES`` languages with most documents. Every document is scored on its whole text.

Null texts and texts without a letter are ``und`` with score 0, and so is everything where no language was learned. Rows with null language teach nothing. Equal
costs go to the first language by name. Repeated rows are scored each on its own. A null id is in fold 0. An empty
table gives no rows. Columns other than id, text and language are not read, whatever their names.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteloom.llm.common import buffer, pieces

#: Bounds of the labelled sample.
ROWS, ROW_BYTES, LANGUAGE_BYTES, TOTAL_BYTES, LANGUAGES = 1024, 2048, 160_000, 2_000_000, 200
#: Bytes of a stretch, and of text parsed at a time.
STRETCH, PIECE_BYTES = 512, 4 << 20
UNKNOWN, FOLD = "und", 2
_OTHER = re.compile(r"[\W\d_]+")


def words(text: str | None) -> str:
    """Lower-case words joined by spaces, with one at each end; empty for a text without a letter."""
    if not text or not any(map(str.isalpha, text)):
        return ""
    return f" {_OTHER.sub(' ', text.lower()).strip()} "


def fold_of(doc_id: str) -> Column:
    """crc32 of the id as text, modulo 4. A null id has fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)), F.lit(0))


@dataclass
class Automaton:
    """A suffix automaton as arrays. State 0 is none, 1 the root. A state with one way on has that byte's class in ``only`` and its end in ``to``; others have a row in ``table``."""

    classes: np.ndarray
    only: np.ndarray
    to: np.ndarray
    table: np.ndarray
    bits: float

    def phrases(self, columns: list[np.ndarray]) -> np.ndarray:
        """Phrases of stretches that are read side by side: the t-th array holds the t-th byte of all stretches that are that long, longest first."""
        width = len(columns[0])
        state, count = np.ones(width, np.int32), np.zeros(width, np.int64)
        size = int(self.classes.max()) + 1
        start = self.table[self.to[1] : self.to[1] + size] if self.only[1] < 0 else np.where(np.arange(size) == self.only[1], self.to[1], 0).astype(np.int32)
        for column in columns:
            c, s = self.classes[column], state[: len(column)]
            only, to = self.only[s], self.to[s]
            on = np.where(only == c, to, self.table[np.where(only < 0, to, 0) + c])
            stuck = np.flatnonzero(on == 0)
            if len(stuck):
                again = start[c[stuck]]
                # A phrase ends before this byte; a byte that no phrase begins with is one by itself.
                count[stuck] += (s[stuck] != 1).astype(np.int64) + (again == 0)
                on[stuck] = np.where(again == 0, 1, again)
            state[: len(column)] = on
        return count + (state != 1)


def automaton(text: bytes) -> Automaton:
    """The suffix automaton of a text, built from left to right."""
    ways, link, length, last = [{}], [-1], [0], 0
    for c in text:
        state, p = len(ways), last
        ways.append({})
        link.append(0)
        length.append(length[last] + 1)
        while p >= 0 and c not in ways[p]:
            ways[p][c] = state
            p = link[p]
        if p >= 0:
            q = ways[p][c]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                twin = len(ways)
                ways.append(dict(ways[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and ways[p].get(c) == q:
                    ways[p][c] = twin
                    p = link[p]
                link[q] = link[state] = twin
        last = state
    # Classes of the bytes that occur, from 1; class 0 leads nowhere.
    seen = sorted(set(text))
    classes = np.zeros(256, np.int16)
    classes[seen] = np.arange(1, len(seen) + 1)
    size, n = len(seen) + 1, len(ways) + 1
    only, to = np.full(n, -1, np.int16), np.zeros(n, np.int32)
    many = [k for k, w in enumerate(ways) if len(w) > 1]
    table = np.zeros((len(many) + 1, size), np.int32)  # row 0 has no ways
    for row, k in enumerate(many, 1):
        to[k + 1] = row * size
        table[row, classes[list(ways[k])]] = np.fromiter(ways[k].values(), np.int32) + 1
    one = [k for k, w in enumerate(ways) if len(w) == 1]
    if one:
        pairs = np.array([next(iter(ways[k].items())) for k in one])
        only[np.array(one) + 1], to[np.array(one) + 1] = classes[pairs[:, 0]], pairs[:, 1] + 1
    return Automaton(classes, only, to, table.ravel(), float(np.log2(len(text) + 256)))


def sizes_of(known: DataFrame) -> dict[str, int]:
    """Labelled documents of each language; the languages with most of them."""
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return {r.lang: r.n for r in counts.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}


def labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang) of the rows that teach."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return known.where(F.col("lang").isNotNull() & (fold_of("doc_id") != FOLD))


def sample(known: DataFrame, sizes: dict[str, int], rows: int = ROWS, row_bytes: int = ROW_BYTES) -> DataFrame:
    """(lang, text, place): at most ``rows`` different texts of each language.

    About four times as many rows as are wanted are drawn by a hash that needs no shuffle; equal ones become one before the window.
    """
    share = known.sparkSession.createDataFrame([(k, 4.0 * rows / n) for k, n in sizes.items()], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    part = F.substring("text", F.greatest(F.lit(1), ((F.length("text") - row_bytes) / 2).cast("int") + 1), F.lit(row_bytes))
    drawn = known.where(F.col("text").rlike(r"\p{L}")).join(F.broadcast(share), "lang").where(draw < F.col("share")).select("lang", part.alias("text"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("text"), "text"))
    return drawn.distinct().withColumn("place", place).where(F.col("place") <= rows)


def learn(docs: DataFrame, rows: int = ROWS, row_bytes: int = ROW_BYTES, language_bytes: int = LANGUAGE_BYTES, total_bytes: int = TOTAL_BYTES) -> list[tuple[str, Automaton]]:
    """An automaton for each language, by name; each is made in a task of its own from its bounded sample."""
    known = labelled(docs)
    sizes = sizes_of(known)
    if not sizes:
        return []
    most = min(language_bytes, total_bytes // len(sizes))

    def make(key, frame):
        import pandas as pd

        parts, left = [], most
        for text in frame.sort_values("place")["text"]:
            part = words(text).encode()[:left]
            parts.append(part)
            left -= len(part)
        made = automaton(b"".join(parts))
        return pd.DataFrame([[key[0], *(x.tobytes() for x in (made.classes, made.only, made.to, made.table)), made.bits]], columns=["lang", "classes", "only", "to", "table", "bits"])

    made = sample(known, sizes, rows, row_bytes).groupBy("lang").applyInPandas(make, "lang string, classes binary, only binary, to binary, table binary, bits double").collect()
    kinds = (np.int16, np.int16, np.int32, np.int32)
    return sorted(((r.lang, Automaton(*(np.frombuffer(bytes(x), kind) for x, kind in zip(r[1:5], kinds)), r.bits)) for r in made), key=lambda x: x[0])


def costs(learned: list[Automaton], texts: list[str]) -> np.ndarray:
    """Bits of each text (row) by each language (column)."""
    data, at = buffer(pa.array(texts, pa.large_string()))
    sizes = np.diff(at)
    n = -(-sizes // STRETCH)
    owner = np.repeat(np.arange(len(texts)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    start = at[owner] + nth * STRETCH
    length = np.minimum(STRETCH, at[owner + 1] - start)
    out = np.zeros((len(texts), len(learned)))
    if not len(owner):
        return out
    order = np.argsort(-length, kind="stable")
    owner, start, length = owner[order], start[order], length[order]
    # How many stretches are longer than t bytes.
    width = np.searchsorted(-length, -np.arange(int(length[0])), "left")
    columns = [data[start[:w] + t] for t, w in enumerate(width.tolist())]
    for k, language in enumerate(learned):
        out[:, k] = np.bincount(owner, language.phrases(columns), len(texts)) * language.bits
    return out


def predict(docs: DataFrame, learned: list[tuple[str, Automaton]]) -> DataFrame:
    """doc_id, lang_pred, score and the winner's bits (cost) of every document."""
    names = [name for name, _ in learned]
    shared = docs.sparkSession.sparkContext.broadcast([(x.classes, x.only, x.to, x.table, x.bits) for _, x in learned])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = [Automaton(*x) for x in shared.value]
        for whole in batches:
            for batch in pieces(whole, 1, PIECE_BYTES):
                texts = [words(x) for x in batch.column(1).to_pylist()]
                bits = costs(languages, texts)
                if names:
                    best = bits.argmin(axis=1)
                    least = bits[np.arange(len(texts)), best]
                    score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                    found = [bool(t) for t in texts]
                else:
                    best, least, score, found = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts)), [False] * len(texts)
                lang = [names[k] if yes else UNKNOWN for k, yes in zip(best.tolist(), found)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(np.where(found, score, 0.0)), pa.array(least)], names=["doc_id", "lang_pred", "score", "cost"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, cost double")


def identify(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The language of every document, learned from the labelled ones outside the held-out fold."""
    return predict(docs, learn(known)).select("doc_id", (fold_of("doc_id") == FOLD).alias("held_out"), "lang_pred", "score")
