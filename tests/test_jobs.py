"""The jobs over growing input, after failures, and run again."""
from itertools import groupby

import pytest

from jobs import note_feed, queries, saved_searches, settings
from jobs.note_feed import Feed
from jobs.saved_searches import Searches
from noteloom import corpus
from noteloom.operators import lexical
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string"


@pytest.fixture()
def feed(tmp_path):
    return Feed(f"file:{tmp_path}/in", f"file:{tmp_path}/feed", f"file:{tmp_path}/checkpoint", buckets=4)


def put(spark, feed, rows):
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(feed.source)


def state(spark, feed):
    notes, postings = note_feed.in_force(spark, feed.output)
    terms = {}
    for r in postings.collect():
        terms.setdefault(r.doc_id, []).append(r.term)
    return {r.id: (r.status, r.batch, r.snippet, sorted(terms.get(r.id, []))) for r in notes.collect()}


def test_only_what_is_new_is_taken(spark, feed):
    put(spark, feed, [(1, "alpha beta", "en", "a"), (2, "gamma", "en", "b"), (3, None, "en", "b"), (None, "no id", "en", "b"), (4, "", None, None)])
    assert note_feed.run(spark, feed) == {"batches": 1, "read": 5, "added": 3, "modified": 0, "removed": 0, "postings": 7}
    first = state(spark, feed)
    assert first == {"1": ("added", 0, "alpha beta", ["A", "ALPHA", "BETA", "EN"]), "2": ("added", 0, "gamma", ["B", "EN", "GAMMA"]), "4": ("added", 0, "", [])}
    assert note_feed.run(spark, feed)["batches"] == 0 and state(spark, feed) == first
    # The same again, a change, a withdrawal of a known and of an unknown note, two versions of one note, a new note.
    put(spark, feed, [(1, "alpha beta", "en", "a"), (2, "delta", "en", "b"), (4, None, None, None), (9, None, "en", "a"), (7, "omega", "fr", "c")])
    assert note_feed.run(spark, feed) == {"batches": 1, "read": 5, "added": 1, "modified": 1, "removed": 1, "postings": 6}
    assert state(spark, feed) == {"1": first["1"], "2": ("modified", 1, "delta", ["B", "DELTA", "EN"]), "7": ("added", 1, "omega", ["C", "FR", "OMEGA"])}
    # A withdrawn note may come back.
    put(spark, feed, [(4, "back", "en", "a")])
    assert note_feed.run(spark, feed)["added"] == 1 and state(spark, feed)["4"] == ("added", 2, "back", ["A", "BACK", "EN"])


def test_a_batch_that_fails_half_way_runs_again_with_the_same_result(spark, feed, monkeypatch):
    put(spark, feed, [(k, f"word{k} common", "en", "a") for k in range(20)])
    note_feed.run(spark, feed)
    put(spark, feed, [(k, f"other{k} common", "en", "a") for k in range(10, 30)])
    write = note_feed._write

    def half(rows, path, *by):
        if path.endswith("postings"):
            raise OSError("lost")
        write(rows, path, *by)

    monkeypatch.setattr(note_feed, "_write", half)
    with pytest.raises(StreamingQueryException):
        note_feed.run(spark, feed)
    monkeypatch.setattr(note_feed, "_write", write)
    assert note_feed.run(spark, feed) == {"batches": 1, "read": 20, "added": 10, "modified": 10, "removed": 0, "postings": 120}
    found = state(spark, feed)
    assert len(found) == 30 and all(found[str(k)][:2] == (("modified", 1) if k < 20 else ("added", 1)) for k in range(10, 30))
    # And once more in full, as after a failure before its commit.
    note_feed.take(spark, feed, spark.read.parquet(feed.source).where("text like 'other%'"), 1)
    assert state(spark, feed) == found


def test_files_one_by_one_give_the_state_of_all(spark, feed):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    docs.repartition(5, "doc_id").write.parquet(feed.source)
    assert note_feed.run(spark, Feed(feed.source, feed.output, feed.checkpoint, files_per_batch=1))["batches"] == 5
    notes, postings = note_feed.in_force(spark, feed.output)
    want = lexical.build(corpus.documents(spark, "/root/testdata/sf0.001")).postings
    assert sorted(postings.select("term", "doc_id", "dl").collect()) == sorted(want.select("term", "doc_id", "dl").collect())
    assert notes.count() == docs.count()


def test_an_empty_source(spark, feed):
    put(spark, feed, [])
    assert note_feed.run(spark, feed)["added"] == 0 and state(spark, feed) == {}


def test_the_plan_looks_up_a_small_batch_without_shuffling_old_texts(spark, feed):
    put(spark, feed, [(k, "some words", "en", "a") for k in range(50)])
    note_feed.run(spark, feed)
    batch = note_feed.notes(spark.createDataFrame([(1, "new", "en", "a")], COLUMNS), feed)
    plan = note_feed.changes(batch, note_feed.versions(spark, feed.output))._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line or "Scan parquet" in line)
    assert "snippet" not in scan and "tokens" not in scan


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_a_first_batch_and_notes_in_force_are_not_shuffled(spark, feed):
    put(spark, feed, [(k, f"word{k} common", "en", "a") for k in range(20)])
    batch = note_feed.notes(spark.read.parquet(feed.source), feed)
    assert "Exchange" not in plan_of(note_feed.changes(batch, note_feed.versions(spark, feed.output)))
    note_feed.run(spark, feed)
    for rows in note_feed.in_force(spark, feed.output):
        assert "Exchange" not in plan_of(rows) and "Join" not in plan_of(rows)
    # What is replaced is taken away without a shuffle of the others.
    put(spark, feed, [(1, "other", "en", "a"), (2, None, None, None)])
    note_feed.run(spark, feed)
    notes, postings = note_feed.in_force(spark, feed.output)
    assert "BroadcastHashJoin" in plan_of(postings) and "SortMergeJoin" not in plan_of(postings)
    assert notes.count() == 19 and sorted(r.term for r in postings.where("doc_id in ('1', '2')").collect()) == ["A", "EN", "OTHER"]


def test_many_versions_are_not_sent_to_all_tasks(spark, feed, monkeypatch):
    monkeypatch.setattr(note_feed, "BROADCAST", 1)
    for text in ("one", "two", "three"):
        put(spark, feed, [(k, f"{text} word", "en", "a") for k in range(5)])
        note_feed.run(spark, feed)
    found = state(spark, feed)
    assert len(found) == 5 and all(v == ("modified", 2, "three word", ["A", "EN", "THREE", "WORD"]) for v in found.values())


def test_postings_are_sorted_a_part_at_a_time(spark, feed, monkeypatch):
    """The more postings a task has, the more turns; a failure between turns leaves no trace."""
    monkeypatch.setattr(note_feed, "SORTED", 10)
    put(spark, feed, [(k, " ".join(f"word{j}" for j in range(k, k + 30)), "en", "a") for k in range(20)])
    write, turns, lose = note_feed._write, [], [2]

    def watched(rows, path, *by):
        if path.endswith("postings"):
            if len(turns) in lose:
                lose.clear()
                raise OSError("lost")
            turns.append({r.bucket for r in rows.select("bucket").distinct().collect()})
        write(rows, path, *by)

    monkeypatch.setattr(note_feed, "_write", watched)
    with pytest.raises(StreamingQueryException):
        note_feed.run(spark, feed)
    assert len(turns) == 2
    turns.clear()
    # WORD and each number are tokens too.
    assert note_feed.run(spark, feed)["postings"] == 20 * (30 + 1 + 30 + 2)
    assert len(turns) == feed.buckets and not set.intersection(*turns) and set.union(*turns) == set(range(feed.buckets))
    found = state(spark, feed)
    assert len(found) == 20 and all(v[3] == sorted(["A", "EN", "WORD", *(w for j in range(k, k + 30) for w in (str(j), f"WORD{j}"))]) for k, v in ((int(k), v) for k, v in found.items()))
    assert note_feed._turns(0, 32) == 1 and note_feed._turns(11, 32) == 2 and note_feed._turns(10**9, 32) == 32


def test_the_rows_of_a_note_follow_one_another(spark):
    """Else what they repeat of the note (a snippet, a hash) takes its room again in each row that is written."""
    found = queries.job1_note_feed(spark, "/root/testdata/sf0.001").select("doc_id", F.spark_partition_id()).collect()
    assert len(found) > 10_000 and sum(1 for _ in groupby(found)) == len(set(found)) == len({r.doc_id for r in found})


def answers(spark, job):
    return sorted((r.query_id, r.rank, r.doc_id, r.topic, r.is_new) for r in saved_searches.reports(spark, job.output).where(F.col("as_of") == job.as_of).collect())


def test_reports(spark, feed, tmp_path):
    put(spark, feed, [(1, "red apple pie", "en", "a"), (2, "green apple", "fr", "a"), (3, "blue sky", None, None)])
    note_feed.run(spark, feed)
    spark.createDataFrame([(1, "apple"), (2, "sky?"), (3, "nothing"), (4, None), (5, "")], "item_id long, text string").write.parquet(f"{tmp_path}/searches")
    job = Searches(feed.output, f"{tmp_path}/searches", f"{tmp_path}/reports", "2024-01-31")
    assert saved_searches.run(spark, job) == {"hits": 3, "answered": 2, "new": 3, "searches": 5, "notes": 3}
    first = answers(spark, job)
    assert first == [(1, 1, "2", "fr", True), (1, 2, "1", "en", True), (2, 1, "3", "none", True)]
    saved_searches.run(spark, job)
    assert answers(spark, job) == first
    # The next report says what is new; the first one stays, and a run again has the same result. A topic that is gone leaves no folder.
    put(spark, feed, [(4, "apple", "de", "a"), (2, None, None, None)])
    note_feed.run(spark, feed)
    later = Searches(feed.output, job.searches, job.output, "2024-02-29")
    for _ in range(2):
        saved_searches.run(spark, later)
        assert answers(spark, later) == [(1, 1, "4", "de", True), (1, 2, "1", "en", False), (2, 1, "3", "none", False)]
        assert answers(spark, job) == first
    saved_searches.run(spark, job)
    assert [r[3] for r in answers(spark, job)] == ["de", "en", "none"] and all(r[4] for r in answers(spark, job))


def test_no_searches_and_no_feed(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/searches")
    job = Searches(f"{tmp_path}/none", f"{tmp_path}/searches", f"{tmp_path}/reports", "2024-01-31")
    assert saved_searches.run(spark, job)["hits"] == 0 and answers(spark, job) == []
    with pytest.raises(ValueError, match="as_of"):
        saved_searches.run(spark, Searches("a", "b", "c", "../x"))


def test_settings(tmp_path):
    (tmp_path / "x.toml").write_text('source = "a"\noutput = "b"\ncheckpoint = "c"\ntitle = ["t"]\n')
    found = settings.read(Feed, str(tmp_path / "x.toml"), {"output": "z", "buckets": None})
    assert (found.source, found.output, found.title, found.buckets) == ("a", "z", ("t",), 32)
    for text, said in (('other = 1\n', "unknown settings: other"), ('source = "a"\n', "without a value: checkpoint, output")):
        (tmp_path / "y.toml").write_text(text)
        with pytest.raises(ValueError, match=said):
            settings.read(Feed, str(tmp_path / "y.toml"), {})
    for kind, name in ((Feed, "note_feed"), (Searches, "saved_searches")):
        assert settings.read(kind, f"jobs/{name}.toml", {})


def test_command_line(spark, feed, monkeypatch, capsys):
    """The command line makes its session and stops it; here it gets the one of the tests, which stays."""
    put(spark, feed, [(1, "a note", "en", "a")])
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    assert settings.main(Feed, note_feed.run, "note_feed", ["--config", "jobs/note_feed.toml", "--source", feed.source, "--output", feed.output, "--checkpoint", feed.checkpoint, "--tags", "lang"]) == 0
    assert '"added": 1' in capsys.readouterr().out
