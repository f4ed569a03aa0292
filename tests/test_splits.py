"""Text files read in splits of any size give what the whole files give."""
import contextlib
import json
import random

import pytest

from noteloom.sources import changelog, files, jsonl, lines


@contextlib.contextmanager
def splits_of(spark, size):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def note_text(seed):
    """A change log with bullets, blank lines, carriage returns, wide characters, entries of one line and long ones, a time that does not exist."""
    rng = random.Random(seed)
    out = ["text before any entry", "* a bullet"][: seed % 3]
    for k in range(60):
        out.append(f"* Title {k} été {'x' * rng.randrange(30)} 2024-{1 + k % 12:02d}-{28 if k % 9 else 31:02d} 10:11:12 [tag{k % 4}]:[日本]:")
        for _ in range(rng.choice((0, 1, 3, 60))):
            out.append(rng.choice(("", "* a bullet of the body", "plain words 語 " * rng.randrange(9), "* no header 2024-01-01", "  indented", "ends so\r")))
    return ("\r\n" if seed % 2 else "\n").join(out) + ("" if seed % 2 else "\n")


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    for k in range(4):
        (folder / f"note{3 - k}.md").write_text(note_text(k), encoding="utf-8", newline="")
    (folder / "note9.md").write_text("nothing in here\n* at all\n", encoding="utf-8")
    (folder / "note5.md").write_text("", encoding="utf-8")
    return [str(folder / f"note{k}.md") for k in (2, 9, 0, 5, 3, 1)]


@pytest.mark.parametrize("size", [1024, 3000, 1 << 20])
def test_change_logs(spark, logs, size):
    def rows(docs):
        return sorted((r.input, r.position, r.title, str(r.date), tuple(r.tags), r.text, r.id) for r in docs.collect())

    whole = rows(changelog.parse(files.read_files(spark, logs)))
    with splits_of(spark, size):
        assert lines.read(spark, logs).rdd.getNumPartitions() > (20 if size == 1024 else 1)
        assert rows(changelog.load(spark, logs)) == whole
        placed = changelog.documents(spark, logs).select("doc_ord").collect()
    assert len(whole) > 150 and len({r.doc_ord for r in placed}) == len(placed)


@pytest.fixture(scope="module")
def json_files(tmp_path_factory):
    folder, rng, n = tmp_path_factory.mktemp("json"), random.Random(3), 0
    for name in ("b", "a", "c"):
        out = []
        for _ in range(150):
            n += 1
            doc = {"id": str(n), "metadata": {"title": f"t{n}", "date": "2024-01-02T03:04:05Z", "tags": ["x"]}, "text": "wörter " * rng.randrange(60)}
            out += [json.dumps(doc, ensure_ascii=False), *rng.choice(([], ["# remark"], ["", "   "]))]
        (folder / f"{name}.jsonl").write_text("\n".join(out) + ("\n" if name == "a" else ""), encoding="utf-8")
    return folder


@pytest.mark.parametrize("size", [1024, 5000, 1 << 20])
def test_json_lines(spark, json_files, size):
    want = []
    for at, name in enumerate("abc"):
        for k, line in enumerate((json_files / f"{name}.jsonl").read_text(encoding="utf-8").split("\n")):
            if line.startswith("{"):
                want.append(((at << 32) + k + 1, json.loads(line)["id"]))
    with splits_of(spark, size):
        found = jsonl.load(spark, str(json_files))
        assert sorted((r.doc_ord, r.id) for r in found.select("doc_ord", "id").collect()) == want
        one = jsonl.load(spark, f"{json_files}/c.jsonl").select("doc_ord", "id").collect()
    assert sorted((r.doc_ord + (2 << 32), r.id) for r in one) == want[300:]


def test_a_line_that_is_no_document_is_named_with_its_file(spark, json_files, tmp_path):
    text = (json_files / "b.jsonl").read_text(encoding="utf-8").split("\n")
    text[100] = '{"id": "without text"}'
    (tmp_path / "b.jsonl").write_text("\n".join(text), encoding="utf-8")
    (tmp_path / "a.jsonl").write_text("\n".join(text[:50]), encoding="utf-8")
    with splits_of(spark, 1024), pytest.raises(Exception, match=r"/b\.jsonl: line 101 is no document"):
        jsonl.load(spark, str(tmp_path)).collect()


def test_counts_are_sent_and_lines_are_not_shuffled(spark, json_files):
    frame = lines.numbered(lines.read(spark, str(json_files)))
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("Final Plan") : plan.index("Initial Plan")]
    assert "BroadcastHashJoin" in final and "SortMergeJoin" not in final


def test_places_follow_from_counts_of_ranges(spark):
    numbers = [*range(0, 90, 3), *range(1 << 33, (1 << 33) + 40), 1 << 40]
    found = lines.ranked(spark.createDataFrame([(n,) for n in reversed(numbers)], "k long"), "k", "n", bits=4)
    assert sorted((r.n, r.k) for r in found.collect()) == [(i + 1, n) for i, n in enumerate(numbers)]
    # Rows with their other columns meet in ranges; only counts of ranges in one task.
    for node in found._jdf.queryExecution().executedPlan().toString().split("Exchange SinglePartition")[1:]:
        assert "HashAggregate" in node.split("\n")[1]
