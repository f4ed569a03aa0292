"""Persisted builds: full, incremental, streamed; front ends; settings."""
import datetime as dt
import json
import os

import pytest
from noteloom import api, cli, config
from noteloom.functions import text as D
from noteloom.functions import tokens
from noteloom.operators import incremental, lexical, vector
from noteloom.plans import build, store
from noteloom.plans.searcher import Searcher
from noteloom.plans.store import Stored
from noteloom.server import Server
from noteloom.sources import index_files
from noteloom.streaming import ingest
from pyspark.sql import functions as F

SCHEMA = "id string, title string, date timestamp, tags array<string>, text string, doc_ord long"
AT = dt.datetime(2025, 1, 1)
OLD = [("a", "A", AT, ["x"], "alpha beta", 0), ("b", "B", AT, ["y"], "beta gamma", 1), ("c", "C", AT, ["x"], "gamma", 2)]
NEW = [("a", "A", AT, ["x"], "alpha beta", 0), ("b", "B", AT, ["y"], "beta changed words", 1), ("d", "D", AT, ["z"], "delta", 3)]


def embedder(texts):
    return [[float(len(t)), float(t.count("a")), 1.0] for t in texts]


TABLES = (("documents", ("id", "title", "text")), ("postings", ("*",)), ("term_stats", ("*",)), ("corpus_stats", ("*",)), ("vectors", ("doc_id", "embedding", "norm")), ("hashes", ("*",)), ("metadata", ("*",)))


def tables(spark, root):
    stored = Stored.open(spark, root)
    return {name: sorted(map(str, getattr(stored, name).select(*columns).collect())) for name, columns in TABLES}


def test_incremental_equals_full(spark, tmp_path):
    root, other = f"{tmp_path}/a", f"{tmp_path}/b"
    old, new = spark.createDataFrame(OLD, SCHEMA), spark.createDataFrame(NEW, SCHEMA)
    steps = []
    assert build.incremental_build(spark, old, root, "t1", embedder, "m", progress=lambda *x: steps.append(x)).mode == "full"
    assert [s[:2] for s in steps] == [(k, 6) for k in (1, 2, 3, 4, 5, 6)]
    assert build.incremental_build(spark, old, root, "t2", embedder, "m").mode == "skipped"
    changed = build.incremental_build(spark, new, root, "t3", embedder, "m")
    assert changed.mode == "incremental"
    assert {k: changed.counts[k] for k in ("added", "modified", "removed", "unchanged")} == {"added": 1, "modified": 1, "removed": 1, "unchanged": 1}
    build.full(spark, new, other, "t3", embedder, "m")
    assert tables(spark, root) == tables(spark, other)
    build.compact(spark, root)
    assert len(store.current(spark, root).segments) == 1
    assert tables(spark, root) == tables(spark, other)
    assert build.incremental_build(spark, new, root, "t4", embedder, "m", force=True).mode == "full"


def test_vectors_survive_a_lexical_build(spark, tmp_path):
    root, docs = str(tmp_path), spark.createDataFrame(OLD, SCHEMA)
    build.full(spark, docs, root, "t", embedder)
    build.full(spark, docs, root, "t")
    assert Searcher.open(spark, root).has_vector_index()
    build.full(spark, docs, root, "t", keep_vectors=False)
    assert not Searcher.open(spark, root).has_vector_index()


def test_old_version_is_rebuilt(spark, tmp_path):
    root, docs = str(tmp_path), spark.createDataFrame(OLD, SCHEMA)
    build.full(spark, docs, root, "t")
    store.publish(spark, root, store.current(spark, root).next(schema_version="1.0"))
    assert build.incremental_build(spark, docs, root, "t").mode == "full"
    store.publish(spark, root, store.current(spark, root).next(schema_version="old"))
    build.upsert(spark, spark.createDataFrame(NEW[1:2], SCHEMA), root, "t")
    assert {(r.id, r.text) for r in Stored.open(spark, root).documents.collect()} == {("a", "alpha beta"), ("b", "beta changed words"), ("c", "gamma")}


def docs_of(spark, n, changed=()):
    return spark.range(n).select(
        F.concat(F.lit("d"), F.col("id")).alias("id"), F.lit("T").alias("title"), F.lit("2025-01-01").cast("timestamp").alias("date"), F.array(F.lit("x")).alias("tags"),
        F.concat(F.lit("common words "), F.when(F.col("id").isin(*changed), "new ").otherwise("old "), F.lit("n"), (F.col("id") % 7).cast("string")).alias("text"), F.col("id").alias("doc_ord"),
    )


def test_a_reader_sees_one_state(spark, tmp_path, monkeypatch):
    """A reader that opens while a build writes, or publishes, sees the state before; one that is open goes on with its own."""
    root, seen = str(tmp_path), []
    build.full(spark, docs_of(spark, 40), root, "t1")
    before = Searcher.open(spark, root)
    real = store.publish

    def publish(spark_, root_, manifest):
        seen.append(Searcher.open(spark_, root_).bm25("new", 50).count())
        real(spark_, root_, manifest)
        seen.append(Searcher.open(spark_, root_).bm25("new", 50).count())

    monkeypatch.setattr(store, "publish", publish)
    build.incremental_build(spark, docs_of(spark, 40, (3, 5)), root, "t2")
    assert seen == [0, 2]
    assert before.bm25("new", 50).count() == 0
    assert before.bm25("old", 50).count() == 40
    with pytest.raises(FileExistsError):
        real(spark, root, store.current(spark, root))


def test_changes_write_what_changed(spark, tmp_path, monkeypatch):
    """A change writes a segment of its own rows; many changes are merged; segments and manifests that nobody needs go."""
    root, other = f"{tmp_path}/a", f"{tmp_path}/b"
    monkeypatch.setattr(build, "SEGMENTS", 3)
    build.full(spark, docs_of(spark, 200), root, "t")
    changed = []
    for k in range(4):
        changed.append(20 * k)
        built = build.incremental_build(spark, docs_of(spark, 200, changed), root, "t")
        assert (built.counts["modified"], built.counts["unchanged"]) == (1, 199)
        manifest = store.current(spark, root)
        if len(manifest.segments) > 1:
            assert spark.read.parquet(f"{built.folder}/documents").count() == 1
            assert spark.read.parquet(f"{built.folder}/postings").count() == 7
        assert len(manifest.segments) <= build.SEGMENTS
    build.full(spark, docs_of(spark, 200, changed), other, "t")
    assert tables(spark, root) == tables(spark, other)
    assert Searcher.open(spark, root).bm25("new n3", 5).collect() == Searcher.open(spark, other).bm25("new n3", 5).collect()
    build.compact(spark, root)
    store.clean(spark, root, 1)
    names = os.listdir(root)
    assert sum(n.startswith("segment-") for n in names) == 1
    assert sum(n.startswith("manifest-") for n in names) == 1
    assert tables(spark, root) == tables(spark, other)
    # Of a large change everything is merged at once.
    build.incremental_build(spark, docs_of(spark, 200, range(100)), root, "t")
    assert len(store.current(spark, root).segments) == 1


def test_upserts_and_removals(spark, tmp_path):
    root = str(tmp_path)
    assert build.remove(spark, spark.createDataFrame([("a",)], "id string"), root, "t").mode == "skipped"
    twice = spark.createDataFrame([*OLD, ("a", "A", AT, ["x"], "alpha later", 7), ("a", "A", AT, ["x"], "alpha later", 7)], SCHEMA)
    build.upsert(spark, twice, root, "t")
    assert build.upsert(spark, twice, root, "t").mode == "skipped"
    built = build.upsert(spark, spark.createDataFrame(NEW, SCHEMA), root, "t", embedder, "m")
    assert {k: built.counts[k] for k in ("added", "modified", "removed", "unchanged")} == {"added": 1, "modified": 2, "removed": 0, "unchanged": 0}
    # The first vectors are those of all documents.
    assert {r.doc_id for r in Stored.open(spark, root).vectors.collect()} == {"a", "b", "c", "d"}
    assert build.remove(spark, spark.createDataFrame([("c",), ("absent",)], "id string"), root, "t").counts["removed"] == 1
    assert build.remove(spark, spark.createDataFrame([("c",)], "id string"), root, "t").mode == "skipped"
    stored = Stored.open(spark, root)
    assert {(r.id, r.text) for r in stored.documents.collect()} == {("a", "alpha beta"), ("b", "beta changed words"), ("d", "delta")}
    assert {r.doc_id for r in stored.vectors.collect()} == {"a", "b", "d"}
    assert "GAMMA" not in {r.term for r in stored.term_stats.collect()}
    assert stored.metadata.first().doc_count == 3


def test_common_terms_fill_several_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        build.full(spark, docs_of(spark, 4000), str(tmp_path), "t")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    postings = Stored.open(spark, str(tmp_path)).postings
    assert postings.where("term = 'COMMON'").select(F.input_file_name()).distinct().count() > 1


def test_an_analyser_reads_documents_and_queries(spark, tmp_path):
    analyse = lambda text: [(w, ["名詞", "一般", "*", "*", "*", "*", w.rstrip("。、")]) for w in text.split()]
    analyser = tokens.morphological(analyse)
    docs = spark.createDataFrame([("a", "", AT, ["x"], "走る。 日本、", 0), ("b", "", AT, ["x"], "泳ぐ", 1)], SCHEMA)
    build.full(spark, docs, str(tmp_path), "t", analyser=analyser)
    s = Searcher.open(spark, str(tmp_path), analyser=analyser)
    assert [r.doc_id for r in s.bm25("走る、", 5).collect()] == ["a"]
    assert [r.doc_id for r in lexical.search_many(s.index, spark.createDataFrame([(1, "泳ぐ。")], "query_id int, query string"), 5, analyser).collect()] == ["b"]
    assert tokens.query_tokens("日本。 日本 x1", analyser, spark) == ["日本", "x1", "X1", "X", "1"]
    assert Searcher.open(spark, str(tmp_path)).bm25("走る、", 5).collect() == []


def test_morphemes():
    assert tokens.kept_form("走っ", ["動詞", "自立", "*", "*", "*", "*", "走る", "x"]) == "走る"
    assert tokens.kept_form("表", ["名詞", "一般", "*", "*", "*", "*", "*"]) == "表"
    assert tokens.kept_form("表", ["名詞"]) == "表"
    assert [tokens.kept_form("x", d) for d in ([], ["助詞", "一般"], ["名詞", "数"], ["動詞", "非自立"], ["名詞", "接尾"])] == [None] * 5


def test_missing_index_is_empty(spark, tmp_path):
    s = Searcher.open(spark, f"{tmp_path}/nothing")
    assert s.bm25("alpha", 3).collect() == [] and s.list_tags().collect() == [] and not s.has_vector_index()
    assert s.search("alpha").collect() == []


def test_pushed_terms(spark, tmp_path):
    build.full(spark, spark.createDataFrame(OLD, SCHEMA), str(tmp_path), "t")
    plan = Searcher.open(spark, str(tmp_path)).bm25("alpha", 3)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "(term,ALPHA)" in plan


def test_stream(spark, tmp_path):
    source, root = f"{tmp_path}/in", f"{tmp_path}/index"
    spark.createDataFrame(OLD, SCHEMA).coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(source)
    for more in (None, NEW):
        if more:
            spark.createDataFrame(more, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        ingest.start(stream(), root, f"{tmp_path}/state", lambda: "t").awaitTermination(120)
    docs = Searcher.open(spark, root).docs
    assert {(r.id, r.text) for r in docs.collect()} == {("a", "alpha beta"), ("b", "beta changed words"), ("c", "gamma"), ("d", "delta")}


def test_changelog_build_and_front_ends(spark, tmp_path, monkeypatch, capsys):
    notes, root = tmp_path / "notes", str(tmp_path / "index")
    notes.mkdir()
    (notes / "my log.md").write_text("* Alpha notes 2025-01-15 10:00:00 [memo]:\n" + "alpha words " * 30 + "\n* Beta 2025-01-16 11:30:00 [memo]:[tips]:\nbeta words")
    built = build.from_changelog(spark, [str(notes / "my log.md")], f"{tmp_path}/direct", "t")
    assert spark.read.parquet(f"{built.folder}/documents").count() == 2
    assert [r.doc_ord for r in Stored.open(spark, f"{tmp_path}/direct").documents.orderBy("doc_ord").collect()] == [0, 1]
    monkeypatch.setattr(cli, "_session", lambda: spark)
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "config"))
    assert cli.main(["init"]) == 0
    with pytest.raises(FileExistsError):
        cli.main(["init"])
    assert cli.main(["init", "--force"]) == 0
    assert cli.main(["build", "-i", str(notes), "-o", root]) == 0
    assert "full" in capsys.readouterr().out
    assert cli.main(["build", "-i", str(notes), "-o", root, "--incremental"]) == 0
    assert "skipped" in capsys.readouterr().out
    assert cli.main(["search", "alpha", "-i", root, "-t", "5"]) == 0
    shown = capsys.readouterr().out
    assert "1 results" in shown and "Alpha notes" in shown and "2025-01-15" in shown
    s = Searcher.open(spark, root)
    assert api.render_tags(s) == "2 tags\n- memo (2)\n- tips (1)"
    assert api.render_recent(s, 1).startswith("1 recent memos\n\n1. Beta\n   2025-01-16 11:30")
    full = api.query_memos(s, "alpha", extraction_mode="full").first()
    assert full.summary_method == "rule-based" and full.summary.endswith("chars, 1 lines]") and not full.truncated
    assert "no vector index" in api.render_memos(s, "alpha", mode="hybrid")
    assert "no vector index" in api.render_memos(s, "alpha", config=config.AppConfig(default_search_mode="hybrid"))
    shown = api.render_memos(s, "alpha", extraction_mode="full", include_raw=False)
    assert "Summary (rule-based)" in shown and shown.count("alpha words") < 20
    shown = api.render_memos(s, "alpha", extraction_mode="full", include_summary=False, max_chars=20)
    assert "Summary" not in shown and "[20 of" in shown
    assert api.query_memos(s, "alpha", extraction_mode="full", chat=lambda text: "short").first().summary == "short"
    assert api.query_memos(s, "beta", tag_filter="tips").count() == 1
    assert api.query_memos(s, "alpha", tag_filter="tips").count() == 0
    assert api.query_memos(s).count() == 0
    line = {"id": "j", "metadata": {"title": "J", "date": "2025-01-01T00:00:00Z", "tags": []}, "text": "json words"}
    monkeypatch.setattr("sys.stdin", __import__("io").StringIO(json.dumps(line)))
    assert cli.main(["build", "-i", "-", "-o", f"{tmp_path}/json"]) == 0
    assert Searcher.open(spark, f"{tmp_path}/json").bm25("json", 1).count() == 1


class StubService:
    """An embedder of the configured service's kind, without a network."""

    model = "stub"

    def embed(self, texts):
        return embedder(texts)

    def embed_query(self, text):
        return embedder([text])[0]


def test_embeddings_from_the_command_line(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "log.md").write_text("* Alpha 2025-01-15 10:00:00 [memo]:\nalpha words\n* Beta 2025-01-16 11:30:00 [memo]:\nbeta")
    root = f"{tmp_path}/index"
    monkeypatch.setattr(cli, "_session", lambda: spark)
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "config"))
    command = ["build", "-i", str(tmp_path / "log.md"), "-o", root]
    assert cli.main([*command, "--with-embeddings"]) == 1
    assert "API key" in capsys.readouterr().err
    monkeypatch.setattr(api, "embedding_service", lambda settings: StubService())
    assert cli.main([*command, "--with-embeddings", "--skip-embeddings"]) == 0
    assert not Searcher.open(spark, root).has_vector_index()
    assert cli.main([*command, "--with-embeddings"]) == 0
    assert Stored.open(spark, root).metadata.first().embedding_model == "stub"
    capsys.readouterr()
    for mode in ("semantic", "hybrid"):
        assert cli.main(["search", "zzz", "-i", root, "-m", mode]) == 0
        shown = capsys.readouterr().out
        assert "2 results" in shown and "no vector index" not in shown
    lines = [{"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "query_memos", "arguments": {"query": "zzz", "mode": "semantic"}}}]
    monkeypatch.setattr("sys.stdin", __import__("io").StringIO("\n".join(map(json.dumps, lines))))
    assert cli.main(["serve", "-i", root]) == 0
    assert "2 results" in json.loads(capsys.readouterr().out)["result"]["content"][0]["text"]


def test_services_of_settings():
    assert api.embedding_service(config.AppConfig()) is None
    assert api.embedding_service(config.AppConfig(api_key="k", service_url="http://h/v1")).timeout == 60.0
    assert api.chat_of(config.AppConfig(api_key="k", service_url="http://h/v1")) is None
    assert api.chat_of(config.AppConfig(summarization_enabled=True)) is None
    assert callable(api.chat_of(config.AppConfig(api_key="k", service_url="http://h/v1", summarization_enabled=True)))


def test_server(spark):
    docs = spark.createDataFrame(OLD, SCHEMA)
    server = Server(Searcher(docs, lexical.build(docs), vector.empty(spark)), config.AppConfig())
    ask = lambda method, params=None, **more: server.answer(json.dumps({"jsonrpc": "2.0", "id": 7, "method": method, "params": params} | more))
    assert ask("initialize", {"protocolVersion": "2024-11-05"})["result"]["protocolVersion"] == "2024-11-05"
    assert ask("initialize", {"protocolVersion": "1"})["result"]["capabilities"] == {"tools": {}}
    assert ask("ping") == {"jsonrpc": "2.0", "id": 7, "result": {}}
    assert server.answer('{"jsonrpc": "2.0", "method": "notifications/initialized"}') is None
    assert {t["name"]: sorted(t["inputSchema"]["properties"]) for t in ask("tools/list")["result"]["tools"]} == {
        "query_memos": ["extraction_mode", "include_raw", "include_summary", "max_chars", "mode", "query", "tag_filter", "top_k", "use_llm_summary"], "list_tags": [], "get_recent_memos": ["limit"],
    }
    call = lambda name, **args: ask("tools/call", {"name": name, "arguments": args})
    text = lambda found: found["result"]["content"][0]["text"]
    assert text(call("list_tags")) == "2 tags\n- x (2)\n- y (1)"
    assert text(call("get_recent_memos", limit=1)).startswith("1 recent memos")
    arguments = {"query": "beta", "top_k": 1, "tag_filter": "x", "mode": "bm25", "extraction_mode": "full", "max_chars": 5, "include_summary": True, "include_raw": False, "use_llm_summary": False}
    assert "1. [" in text(call("query_memos", **arguments)) and "Summary (rule-based)" in text(call("query_memos", **arguments))
    assert text(call("query_memos", query="beta", mode=None)).startswith("2 results")
    assert [call(*x[:1], **x[1])["error"]["code"] for x in (("nothing", {}), ("query_memos", {"tag": "x"}), ("query_memos", {"top_k": "3"}), ("query_memos", {"top_k": True}), ("get_recent_memos", {"limit": -1}))] == [-32602] * 5
    assert [server.answer(x)["error"]["code"] for x in ("{", "[]", '{"id": 1}', '{"jsonrpc": "2.0", "id": 1, "method": "x"}', '{"jsonrpc": "2.0", "id": 1, "method": "ping", "params": [1]}')] == [-32700, -32600, -32600, -32601, -32602]
    broken = Server(None, config.AppConfig())
    assert broken.answer('{"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "list_tags"}}')["error"]["code"] == -32603
    assert list(server.serve(["\n", '{"jsonrpc": "2.0", "id": 1, "method": "ping"}\n'])) == ['{"jsonrpc": "2.0", "id": 1, "result": {}}']


def test_json_store(spark, tmp_path):
    docs = spark.createDataFrame([*OLD, ('q"\\', 'T "quoted"\n', AT, [], "日本\t\u0001", 5)], SCHEMA)
    rows = lexical.tokenised(docs)
    vectors = spark.createDataFrame([("a", [1.0, 0.5], 0), ("b", [0.0, 1.0], 1)], "doc_id string, embedding array<float>, doc_ord long")
    index_files.export_store(rows, docs, vectors, incremental.metadata(docs, "t", "m"), incremental.hashes(docs), str(tmp_path))
    for name in (index_files.BM25_FILE, index_files.VECTOR_FILE, index_files.DOCUMENT_FILE, index_files.METADATA_FILE):
        assert json.loads((tmp_path / name).read_text())
    s = Searcher.from_json(spark, str(tmp_path))
    assert sorted(map(str, s.docs.select("id", "title", "date", "tags", "text").collect())) == sorted(map(str, docs.select("id", "title", "date", "tags", "text").collect()))
    assert [(r.rank, r.doc_id) for r in s.bm25("gamma", 3).collect()] == [(r.rank, r.doc_id) for r in lexical.search(lexical.build(docs), "gamma", 3).collect()]
    assert [r.doc_id for r in s.by_vector([0.0, 1.0], 2).collect()] == ["b", "a"]
    meta = index_files.load_store(spark, str(tmp_path))[3].first()
    assert (meta.doc_count, meta.embedding_model, len(meta.doc_hashes)) == (4, "m", 4)
    empty = f"{tmp_path}/empty"
    index_files.export_store(rows.limit(0), docs.limit(0), vectors.limit(0), incremental.metadata(docs.limit(0), "t"), incremental.hashes(docs.limit(0)), empty)
    s = Searcher.from_json(spark, empty)
    assert (s.docs.count(), s.bm25("a", 3).count(), s.has_vector_index()) == (0, 0, False)


def test_postings_stay_with_their_documents_and_one_segment_is_compact(spark, tmp_path):
    """Each file of postings holds whole documents, sorted by term: none was shuffled."""
    docs = spark.range(40).repartition(4).select(F.col("id").cast("string").alias("id"), F.lit("T").alias("title"), F.lit(AT).alias("date"), F.array().cast("array<string>").alias("tags"), F.concat(F.lit("alpha beta word"), "id").alias("text"), F.col("id").alias("doc_ord"))
    build.full(spark, docs, str(tmp_path), "t")
    build.incremental_build(spark, docs.where("id <> '3'"), str(tmp_path), "t")
    build.compact(spark, str(tmp_path))
    rows = Stored.open(spark, str(tmp_path)).postings.select("doc_id", "term", F.input_file_name().alias("file")).collect()
    assert len(rows) == 39 * 6 and len({r.file for r in rows}) > 1 and len({(r.doc_id, r.file) for r in rows}) == 39
    for file in {r.file for r in rows}:
        terms = [r.term for r in spark.read.parquet(file).collect()]
        assert terms == sorted(terms)
    before = store.current(spark, str(tmp_path))
    build.compact(spark, str(tmp_path))
    assert store.current(spark, str(tmp_path)) == before


def test_json_store_in_parts(spark, tmp_path, monkeypatch):
    """A store of many lines is written by several tasks, and its parts together are the JSON text; it is read in splits."""
    monkeypatch.setattr(index_files, "PART_ROWS", 7)
    docs = spark.createDataFrame([(f"n{k}", "T\n]", AT, ["x"], f"word{k} ]}}", k * 3) for k in range(40)], SCHEMA)
    vectors = docs.select(F.col("id").alias("doc_id"), F.array(F.col("doc_ord").cast("float"), F.lit(1.0).cast("float")).alias("embedding"), "doc_ord")
    for _ in range(2):
        index_files.export_store(lexical.tokenised(docs), docs, vectors, incremental.metadata(docs, "t", "m"), incremental.hashes(docs), str(tmp_path))
    for name in (index_files.BM25_FILE, index_files.VECTOR_FILE, index_files.DOCUMENT_FILE, index_files.METADATA_FILE):
        parts = sorted((tmp_path / name).glob("part-*"))
        assert len(parts) > 4 and max(len(p.read_text().splitlines()) for p in parts) < 25 and json.loads("".join(p.read_text() for p in parts))
    found, index, stored, meta = index_files.load_store(spark, str(tmp_path))
    assert sorted((r.doc_ord, r.id, r.text) for r in found.collect()) == [(k, f"n{k}", f"word{k} ]}}") for k in range(40)]
    assert sorted((r.doc_ord, r.doc_id, r.embedding[0]) for r in stored.collect()) == [(k, f"n{k}", 3.0 * k) for k in range(40)]
    assert {(r.doc_ord, r.doc_id) for r in index.postings.where("term = 'WORD7'").collect()} == {(7, "n7")}
    assert (meta.first().doc_count, meta.first().created_at, len(meta.first().doc_hashes)) == (40, "t", 40)
    assert index_files.load_hashes(spark, f"{tmp_path}/{index_files.METADATA_FILE}").count() == 40


def test_export(spark, tmp_path):
    build.full(spark, spark.createDataFrame(OLD, SCHEMA), f"{tmp_path}/i", "t")
    s = Searcher.open(spark, f"{tmp_path}/i")
    index_files.export_json(s.index, s.docs, s.vectors, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out/documents").count() == 3
    assert spark.read.json(f"{tmp_path}/out/postings").count() == s.index.postings.count()


def test_edited_changelog_entries_are_added_and_removed(spark):
    frame = lambda text: spark.createDataFrame([("T", text)], "title string, text string").withColumn("id", D.content_hash("title", F.col("text")))
    got = incremental.counts(incremental.diff(frame("new"), incremental.hashes(frame("old")))).first()
    assert (got.added, got.removed, got.modified) == (1, 1, 0)


# ---- settings -------------------------------------------------------------------------
def test_settings(tmp_path, monkeypatch):
    c = config.AppConfig(default_top_k=3, provider_order=("a", "b"), summarization_enabled=True)
    (tmp_path / "c.toml").write_text(c.to_toml())
    assert config.AppConfig.load(tmp_path / "c.toml") == c
    env = {"NOTELOOM_DEFAULT_TOP_K": "7", "NOTELOOM_PROVIDER_ONLY": "x, y,", "NOTELOOM_EXTRACTION_INCLUDE_RAW": "false", "NOTELOOM_SUMMARIZATION_TEMPERATURE": "oops"}
    e = config.AppConfig.from_env(env)
    assert (e.default_top_k, e.provider_only, e.extraction_include_raw, e.summarization_temperature) == (7, ("x", "y"), False, 0.3)
    merged = config.effective(tmp_path / "c.toml", env)
    assert (merged.default_top_k, merged.provider_order, merged.summarization_enabled) == (7, ("a", "b"), True)
    assert config.effective(tmp_path / "none.toml", {}) == config.AppConfig()
    off = config.AppConfig(extraction_include_raw=False, provider_allow_fallbacks=False)
    (tmp_path / "off.toml").write_text(off.to_toml())
    # What the environment says holds, be it the default or not; a merge takes some settings in any case.
    assert config.effective(tmp_path / "off.toml", {"NOTELOOM_EXTRACTION_INCLUDE_RAW": "true", "NOTELOOM_DEFAULT_TOP_K": "10"}).extraction_include_raw
    assert not config.effective(tmp_path / "off.toml", {}).extraction_include_raw
    assert off.merge(config.AppConfig()) == config.AppConfig()
    assert config.AppConfig(default_top_k=3, api_key="k").merge(off) == config.AppConfig(default_top_k=3, api_key="k", extraction_include_raw=False, provider_allow_fallbacks=False)
    for bad in ({"default_top_k": 0}, {"default_search_mode": "x"}, {"extraction_mode": "x"}):
        with pytest.raises(ValueError):
            config.AppConfig(**bad).validate()
    assert config.AppConfig().with_index_dir("d").with_default_top_k(2).validate().index_dir == "d"
    assert config.SearchConfig().mode == "hybrid" and config.AppConfig().default_search_mode == "bm25"
    assert config.SearchConfig().with_mode("other").mode == "bm25"


def test_paths(tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", "/h")
    monkeypatch.delenv("XDG_DATA_HOME", raising=False)
    monkeypatch.setenv("XDG_CACHE_HOME", "/c")
    assert [str(config.expand_home(p)) for p in ("~", "~/x", "~name", "/a", "b")] == ["/h", "/h/x", "~name", "/a", "b"]
    assert str(config.data_dir()) == "/h/.local/share/noteloom" and str(config.cache_dir()) == "/c/noteloom"
    monkeypatch.chdir(tmp_path)
    assert config.resolve("x") == tmp_path / "x"
    (tmp_path / ".git").mkdir()
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert config.find_project_root(tmp_path / "a" / "b") == tmp_path
    assert config.find_project_root("/") is None
