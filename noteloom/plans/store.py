"""The stored index: segments that never change, and manifests that say which of them are in force.

A segment holds what one build or change brought: documents (with content hash
and tokens), their postings sorted by term, what it adds to each term's
document frequency (less what it takes away), vectors, and the ids that are
gone or replaced in the segments before it. A manifest is one small JSON file; the one
with the highest number is in force. It appears by a rename once all its segments are written,
so a reader sees the state before or after a change and never one in between. There is one writer at a time.

Search reads a few segments as one: a row counts unless its document is gone in a later segment.
"""
from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions.text import content_hash
from noteloom.functions.tokens import Analyser, cjk_tokens, tokens
from noteloom.operators import incremental, vector
from noteloom.operators.lexical import LexicalIndex
from noteloom.sources.hadoop import Files

#: Manifests that stay; readers may go on with the state of an earlier one. Segments that no longer belong to any of them go.
KEPT = 3
#: How Parquet packs the tables of a segment.
CODEC = "zstd"
DOCUMENT = "id string, title string, date timestamp, tags array<string>, text string, doc_ord long"
_NAME = re.compile(r"manifest-(\d{12})\.json")


@dataclass(frozen=True)
class Manifest:
    """Names of segments, oldest first, and of those with vectors; sums over the documents in force; rows that later segments than the first hold or take away."""

    number: int
    segments: tuple[str, ...]
    n_docs: int
    total_dl: int
    created_at: str
    embedding_model: str | None
    schema_version: str
    vectors: tuple[str, ...] = ()
    changed: int = 0

    def next(self, **changes) -> Manifest:
        return replace(self, number=self.number + 1, **changes)


def manifest_name(number: int) -> str:
    return f"manifest-{number:012d}.json"


def _numbers(names: list[str]) -> list[int]:
    return sorted(int(m[1]) for n in names if (m := _NAME.fullmatch(n)))


def current(spark: SparkSession, root: str) -> Manifest | None:
    """The manifest in force; None where there is none."""
    files = Files(spark, root)
    if numbers := _numbers(files.names()):
        found = json.loads(files.read(manifest_name(numbers[-1])))
        return Manifest(**found | {k: tuple(found[k]) for k in ("segments", "vectors")})
    return None


def publish(spark: SparkSession, root: str, manifest: Manifest) -> None:
    Files(spark, root).publish(manifest_name(manifest.number), json.dumps(asdict(manifest), indent=1))


def clean(spark: SparkSession, root: str, kept: int = KEPT) -> list[str]:
    """Deletes all manifests but the last ``kept``, and segments of none of these. Not for use while a build runs."""
    files = Files(spark, root)
    names = files.names()
    numbers = _numbers(names)
    used = {s for n in numbers[-kept:] for s in json.loads(files.read(manifest_name(n)))["segments"]}
    gone = [manifest_name(n) for n in numbers[:-kept]] + [n for n in names if n.startswith("segment-") and n not in used]
    for name in gone:
        files.delete(name)
    return gone


class Stored:
    """The tables of an index in force, or empty ones where nothing is stored."""

    def __init__(self, spark: SparkSession, root: str, manifest: Manifest | None):
        self.spark, self.root, self.manifest = spark, root, manifest
        self.segments = manifest.segments if manifest else ()

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Stored:
        return cls(spark, root, current(spark, root))

    def _read(self, segment: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{segment}/{name}")

    def _gone(self, k: int) -> DataFrame | None:
        """Ids that are gone in the segments after the k-th."""
        later = [self._read(s, "gone").select("id") for s in self.segments[k + 1 :]]
        return reduce(DataFrame.unionByName, later) if later else None

    def _parts(self, name: str, key: str, segments: tuple[str, ...]) -> Iterator[DataFrame]:
        for k, segment in enumerate(self.segments):
            if segment not in segments:
                continue
            rows, gone = self._read(segment, name), self._gone(k)
            yield rows if gone is None else rows.join(gone.withColumnRenamed("id", key), key, "left_anti").select(*rows.columns)

    def table(self, name: str, key: str, schema: str) -> DataFrame:
        parts = list(self._parts(name, key, self.segments))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    @property
    def rows(self) -> DataFrame:
        """Documents with their content hash and tokens."""
        return self.table("documents", "id", DOCUMENT + ", content_hash string, tokens array<string>")

    @property
    def documents(self) -> DataFrame:
        return self.rows.drop("content_hash", "tokens")

    @property
    def hashes(self) -> DataFrame:
        return self.rows.select("id", "content_hash")

    @property
    def tokens(self) -> DataFrame:
        return self.rows.select("doc_ord", F.col("id").alias("doc_id"), "tokens")

    @property
    def postings(self) -> DataFrame:
        return self.table("postings", "doc_id", "term string, doc_ord long, doc_id string, tf long, dl long")

    @property
    def term_stats(self) -> DataFrame:
        parts = [self._read(s, "term_stats") for s in self.segments]
        if len(parts) < 2:
            return parts[0] if parts else self.spark.createDataFrame([], "term string, df long")
        # A filter on terms goes through the sum to the scans.
        return reduce(DataFrame.unionByName, parts).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    @property
    def corpus_stats(self) -> DataFrame:
        m = self.manifest
        n, dl = (m.n_docs, m.total_dl) if m else (0, 0)
        return self.spark.range(1).select(F.lit(n).cast("long").alias("n_docs"), F.lit(dl / n if n else 0.0).alias("avg_dl"))

    @property
    def vectors(self) -> DataFrame:
        parts = list(self._parts("vectors", "doc_id", self.manifest.vectors)) if self.manifest else []
        return reduce(DataFrame.unionByName, parts) if parts else vector.with_norms(vector.empty(self.spark))

    @property
    def metadata(self) -> DataFrame:
        """One row that describes the index; none where nothing is stored."""
        m = self.manifest
        return self.spark.createDataFrame([(m.n_docs, m.created_at, m.embedding_model, m.schema_version)] if m else [], "doc_count long, created_at string, embedding_model string, schema_version string")

    @property
    def index(self) -> LexicalIndex:
        return LexicalIndex(self.postings, self.term_stats, self.corpus_stats)


def prepared(docs: DataFrame, analyser: Analyser = cjk_tokens) -> DataFrame:
    """Documents as a segment holds them."""
    return docs.select("id", "title", "date", "tags", "text", "doc_ord", content_hash("title", F.col("text")).alias("content_hash"), tokens("title", "text", analyser=analyser).alias("tokens"))


def frequencies(tokens: DataFrame, sign: int = 1) -> DataFrame:
    """(term, df) that documents add, or take away."""
    return tokens.select(F.explode_outer("tokens").alias("term")).where("term is not null").groupBy("term").agg((sign * F.count(F.lit(1))).cast("long").alias("df"))


def write_table(rows: DataFrame, path: str) -> None:
    """A table of a segment."""
    rows.write.option("compression", CODEC).parquet(path)


def write_postings(postings: DataFrame, path: str) -> None:
    """Each task sorts those of its own documents by term, so nothing is shuffled, and of each file a search reads only the pages that hold its terms.

    A file names few documents, so their ids and numbers are stored as short codes; a common term fills all files alike.
    """
    write_table(postings.select("term", "doc_ord", "doc_id", "tf", "dl").sortWithinPartitions("term", "doc_ord"), path)


def supported(manifest: Manifest) -> bool:
    """Whether the version is new enough to be built upon, by the rule for index metadata."""
    return not incremental.version_needs_rebuild(manifest.schema_version)
