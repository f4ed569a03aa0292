"""Builds of the stored index: whole, or only what changed."""
from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions.tokens import Analyser, cjk_tokens
from noteloom.operators import docstore, incremental, lexical, vector
from noteloom.plans import store
from noteloom.plans.store import Manifest, Stored
from noteloom.sources import changelog

Progress = Callable[[int, int, str], None]
#: Segments, and changed rows as a share of all documents, beyond which segments are merged into one.
SEGMENTS, CHANGED = 8, 0.3


@dataclass
class Built:
    mode: str  # full, incremental or skipped
    folder: str
    counts: dict | None = None


def _silent(step: int, total: int, message: str) -> None:
    pass


class _Steps:
    """Counts the steps of a build for its caller."""

    def __init__(self, progress: Progress, total: int):
        self.progress, self.total, self.at = progress, total, 0

    def __call__(self, message: str) -> None:
        self.at += 1
        self.progress(self.at, self.total, message)


def _together(*writes: Callable[[], None]) -> None:
    """Writes that don't wait for each other: one job's last tasks leave cores to the next."""
    with ThreadPoolExecutor(len(writes)) as pool:
        for done in [pool.submit(w) for w in writes]:
            done.result()


def _sums(rows: DataFrame) -> tuple[int, int]:
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("tokens").cast("long")), F.lit(0)).alias("dl")).first()
    return found.n, found.dl


def _segment(root: str) -> tuple[str, str]:
    name = f"segment-{uuid.uuid4().hex}"
    return name, f"{root}/{name}"


def _no_ids(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "id string")


def full(
    spark: SparkSession, docs: DataFrame, root: str, created_at: str, embedder=None, model: str | None = None, progress: Progress = _silent, keep_vectors: bool = True, analyser: Analyser = cjk_tokens
) -> Built:
    """Everything anew, as one segment. Without an embedder the stored vectors of an earlier build are kept, unless ``keep_vectors`` is false."""
    old = store.current(spark, root)
    with_vectors = bool(embedder) or keep_vectors and bool(old and old.vectors)
    step, (name, folder) = _Steps(progress, 6 if with_vectors else 5), _segment(root)
    step("documents")
    # Tokenised once, and read again for all that follows.
    store.write_table(store.prepared(docstore.latest(docs), analyser), f"{folder}/documents")
    rows = spark.read.parquet(f"{folder}/documents")
    step("postings")
    store.write_postings(lexical.postings_of(rows), f"{folder}/postings")
    step("statistics")
    _together(
        lambda: store.write_table(spark.read.parquet(f"{folder}/postings").groupBy("term").agg(F.count(F.lit(1)).alias("df")), f"{folder}/term_stats"),
        lambda: _no_ids(spark).write.parquet(f"{folder}/gone"),
    )
    if with_vectors:
        step("vectors")
        vectors = vector.with_norms(vector.embed(rows, embedder)) if embedder else Stored(spark, root, old).vectors
        store.write_table(vectors, f"{folder}/vectors")
    step("metadata")
    n, dl = _sums(rows)
    store.publish(spark, root, Manifest((old.number if old else 0) + 1, (name,), n, dl, created_at, model, incremental.SCHEMA_VERSION, (name,) if with_vectors else ()))
    store.clean(spark, root)
    step("done")
    return Built("full", folder)


def _changes(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """(id, status) of documents against stored hashes. Ids and hashes alone are shuffled; the last version of an id counts."""
    new = incremental.hashes(docs, "doc_ord").groupBy("id").agg(F.max_by("content_hash", "doc_ord").alias("content_hash"))
    return incremental.compare(new, hashes)


def _fresh(docs: DataFrame, statuses: DataFrame, counts: dict) -> DataFrame:
    """The documents that are added or modified. Where that is all or none of them, no text is shuffled to find them."""
    if not counts["embeddings_needed"]:
        return docs.limit(0)
    if not counts["unchanged"]:
        return docs.where("id is not null")
    return docs.join(statuses.where(F.col("status").isin("added", "modified")).select("id"), "id", "left_semi").select(*docs.columns)


def _change(spark: SparkSession, root: str, old: Manifest, docs: DataFrame, statuses: DataFrame, counts: dict, created_at: str, embedder, model: str | None, progress: Progress, analyser: Analyser) -> Built:
    """A segment of the added and modified documents, and of the ids of removed and modified ones."""
    stored, step, (name, folder) = Stored(spark, root, old), _Steps(progress, 6 if embedder else 5), _segment(root)
    fresh = _fresh(docs, statuses, counts)
    step("documents")
    _together(
        lambda: store.write_table(store.prepared(docstore.latest(fresh), analyser), f"{folder}/documents"),
        lambda: statuses.where(F.col("status").isin("removed", "modified")).select("id").write.parquet(f"{folder}/gone"),
    )
    rows, gone = spark.read.parquet(f"{folder}/documents"), spark.read.parquet(f"{folder}/gone")
    replaced = stored.rows.select("id", "tokens").join(gone, "id", "left_semi")
    step("postings")
    step("statistics")
    delta = store.frequencies(rows).unionByName(store.frequencies(replaced, -1)).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
    jobs = [lambda: store.write_postings(lexical.postings_of(rows), f"{folder}/postings"), lambda: store.write_table(delta, f"{folder}/term_stats")]
    vectors = old.vectors
    if embedder:
        step("vectors")
        # The first vectors of an index are those of all documents in force.
        texts = rows if old.vectors else stored.rows.join(gone, "id", "left_anti").select(*rows.columns).unionByName(rows)
        jobs.append(lambda: store.write_table(vector.with_norms(vector.embed(texts, embedder)), f"{folder}/vectors"))
        vectors = (*vectors, name)
    _together(*jobs)
    step("metadata")
    (n, dl), (n_gone, dl_gone) = _sums(rows), _sums(replaced)
    new = old.next(
        segments=(*old.segments, name), n_docs=old.n_docs + n - n_gone, total_dl=old.total_dl + dl - dl_gone, created_at=created_at, embedding_model=model, vectors=vectors, changed=old.changed + n + n_gone
    )
    store.publish(spark, root, new)
    if len(new.segments) > SEGMENTS or new.changed > CHANGED * max(1, new.n_docs):
        folder = compact(spark, root)
    step("done")
    return Built("incremental", folder, counts)


def compact(spark: SparkSession, root: str) -> str:
    """All segments as one, without tokenising or embedding anything again. One segment stays as it is."""
    old = store.current(spark, root)
    if len(old.segments) == 1:
        return f"{root}/{old.segments[0]}"
    stored, (name, folder) = Stored(spark, root, old), _segment(root)
    store.write_table(stored.rows, f"{folder}/documents")
    # Postings follow from the documents that are left; to take the gone ones from postings would shuffle those.
    jobs = [
        lambda: store.write_postings(lexical.postings_of(spark.read.parquet(f"{folder}/documents")), f"{folder}/postings"),
        lambda: store.write_table(stored.term_stats, f"{folder}/term_stats"), lambda: _no_ids(spark).write.parquet(f"{folder}/gone"),
    ]
    if old.vectors:
        jobs.append(lambda: store.write_table(stored.vectors, f"{folder}/vectors"))
    _together(*jobs)
    store.publish(spark, root, old.next(segments=(name,), vectors=(name,) if old.vectors else (), changed=0))
    store.clean(spark, root)
    return folder


def incremental_build(
    spark: SparkSession, docs: DataFrame, root: str, created_at: str, embedder=None, model: str | None = None, force: bool = False, progress: Progress = _silent, analyser: Analyser = cjk_tokens
) -> Built:
    """Brings the index to the state of ``docs``. Only added and modified documents are tokenised, embedded and written. Equal to a full build. Nothing is written when nothing changed."""
    old = store.current(spark, root)
    if force or old is None or not store.supported(old):
        return full(spark, docs, root, created_at, embedder, model, progress, analyser=analyser)
    return _with_changes(spark, root, old, docs, _changes(docs, Stored(spark, root, old).hashes), created_at, embedder, model, progress, analyser)


def upsert(
    spark: SparkSession, docs: DataFrame, root: str, created_at: str, embedder=None, model: str | None = None, progress: Progress = _silent, analyser: Analyser = cjk_tokens
) -> Built:
    """Puts ``docs`` into the index and leaves all other documents. The work follows ``docs``; of the index ids and hashes are read, and the tokens of what is replaced."""
    old = store.current(spark, root)
    if old is None:
        return full(spark, docs, root, created_at, embedder, model, progress, analyser=analyser)
    stored = Stored(spark, root, old)
    if not store.supported(old):
        return full(spark, docstore.upsert(stored.documents, docs.select(*stored.documents.columns)), root, created_at, embedder, model, progress, analyser=analyser)
    return _with_changes(spark, root, old, docs, _changes(docs, stored.hashes.join(docs.select("id"), "id", "left_semi")), created_at, embedder, model, progress, analyser)


def remove(spark: SparkSession, ids: DataFrame, root: str, created_at: str) -> Built:
    """Takes the documents of ``ids`` (id) out of the index; ids that are not in it change nothing."""
    old = store.current(spark, root)
    if old is None:
        return Built("skipped", root)
    stored = Stored(spark, root, old)
    gone = stored.hashes.join(ids.select("id"), "id", "left_semi").select("id", F.lit("removed").alias("status"))
    return _with_changes(spark, root, old, stored.documents, gone, created_at, None, old.embedding_model, _silent, cjk_tokens)


def _with_changes(spark, root, old, docs, statuses, created_at, embedder, model, progress, analyser) -> Built:
    statuses = statuses.cache()
    try:
        counts = incremental.counts(statuses).first().asDict()
        if not counts["has_changes"]:
            return Built("skipped", f"{root}/{old.segments[-1]}", counts)
        return _change(spark, root, old, docs, statuses, counts, created_at, embedder, model, progress, analyser)
    finally:
        statuses.unpersist()


def from_changelog(spark: SparkSession, paths: list[str], root: str, created_at: str, **options) -> Built:
    """A build from change-log files; documents are numbered file by file, in the order given, and within a file as they stand there."""
    return full(spark, changelog.documents(spark, paths), root, created_at, **options)
