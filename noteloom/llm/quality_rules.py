"""Quality rules as a short-circuit cascade.

Each rule rejects a document by a property of its whole text. A bounded sample, rows of
up to ``SAMPLE_PARTS`` partitions spread evenly over the table,
tells what each rule costs and how much it rejects; rules then run in the order
of rejections per second, and a document that a rule rejects meets no later one.
The order changes the time only: a document is kept when no rule rejects it.

Null and empty texts have no words and are rejected by ``few_words``. Very long texts are judged
whole, in time in proportion. Repeated rows are judged each on its own. An empty table gives no rows. Extra columns pass
through untouched (``quality_filter``) or are not read, whatever their names.
"""
from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from noteloom.llm.common import BLANKS, pieces, strings

#: Rows whose rules are timed, and partitions they come from at most. They set the order of the rules, never a verdict.
SAMPLE_ROWS, SAMPLE_PARTS = 256, 16
SYMBOLS = "#*$%&|<>"
PIECE_BYTES = 8 << 20


class Facts:
    """Properties of one text, each computed when first asked for."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(self.text.count(b) for b in BLANKS)

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.text.count(c) for c in SYMBOLS)

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(BLANKS)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        seen = Counter(windows)
        again = np.fromiter((seen[x] > 1 for x in windows), bool, len(windows))
        covered = np.zeros(len(w), bool)
        for k in range(3):
            covered[k : k + len(again)] |= again
        return int(covered.sum())

    @cached_property
    def upper_share(self) -> float:
        """Upper-case letters among the letters that have a case."""
        t = self.text
        lower = t.lower()
        if lower == t:
            return 0.0
        upper = sum(map(str.isupper, t))
        return upper / max(1, upper + sum(map(str.islower, t)))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Facts], bool]


#: The limits of the first two rules are fixed by contract.
RULES = (
    Rule("few_words", lambda f: f.n_words < 50),
    Rule("repeated_words", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
    Rule("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    Rule("upper_case", lambda f: f.upper_share > 0.3),
    Rule("repeated_lines", lambda f: 2 * f.n_dup_lines > len(f.lines)),
)


def base_failed(f: Facts) -> bool:
    return f.n_words < 50 or 100 * f.n_repeat_words > 50 * f.n_words


def passes(f: Facts, rules) -> bool:
    return not any(r.rejects(f) for r in rules)


def cascade_order(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> tuple:
    """Rules by rejections per second on ``sample_rows`` rows, best first; ties keep the given order."""

    texts = docs.select(F.col("text").cast("string").alias("text")).rdd
    n = texts.getNumPartitions()
    parts = min(n, SAMPLE_PARTS)
    if not parts:
        return tuple(rules)
    each = -(-sample_rows // parts)

    def timed(rows: Iterator[Row]) -> list[tuple[list[float], list[bool]]]:
        out = []
        for row in islice(rows, each):
            cost, hits = [], []
            for rule in rules:
                facts, began = Facts(row.text or ""), time.perf_counter()
                hits.append(bool(rule.rejects(facts)))
                cost.append(time.perf_counter() - began)
            out.append((cost, hits))
        return out

    # Tasks for these partitions alone; only the timings leave the executors.
    found = docs.sparkSession.sparkContext.runJob(texts, timed, [k * n // parts for k in range(parts)])
    rate = {k: (sum(hits[k] for _, hits in found) + 0.5) / max(sum(cost[k] for cost, _ in found), 1e-9) for k in range(len(rules))}
    return tuple(rules[k] for k in sorted(range(len(rules)), key=lambda k: (-rate[k], k)))


def quality_verdicts(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, the base counts and whether the cascade keeps it."""
    order = cascade_order(docs, rules, sample_rows)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1, PIECE_BYTES):
                rows = []
                for text in strings(batch.column(1)):
                    f = Facts(text)
                    kept = passes(f, order)
                    rows.append((f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, base_failed(f), kept))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:5]), *(pa.array(c, pa.bool_()) for c in cols[5:])], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(judge, schema)


def quality_filter(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that every rule lets pass, with all their columns."""
    order = cascade_order(docs, rules, sample_rows)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, at, PIECE_BYTES):
                yield batch.filter(pa.array([passes(Facts(t), order) for t in strings(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
