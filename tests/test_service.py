"""The service client against a local server, and what uses it."""
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from noteloom.operators import docstore, remote
from noteloom.operators.service import Service
from noteloom.sources import index_files
from pyspark.sql import functions as F


@pytest.fixture
def server():
    """answers: a list of (status, headers, body) to give in turn, the last again and again; seen: the requests."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.server.seen.append((self.path, self.headers["Authorization"], body))
            status, headers, out = self.server.answers.pop(0) if len(self.server.answers) > 1 else self.server.answers[0]
            out = out(body) if callable(out) else out
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(out if isinstance(out, bytes) else json.dumps(out).encode())

        def log_message(self, *_):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    http.seen, http.answers = [], []
    threading.Thread(target=http.serve_forever, daemon=True).start()
    http.url = f"http://127.0.0.1:{http.server_port}/v1"
    yield http
    http.shutdown()


@pytest.fixture
def waits(monkeypatch):
    found = []
    monkeypatch.setattr(remote.with_retries, "__kwdefaults__", {"retries": 3, "sleep": found.append})
    monkeypatch.setattr(remote.embed_with_retries, "__defaults__", (3, found.append))
    return found


GOOD = {"choices": [{"message": {"content": "short"}, "finish_reason": "stop"}], "model": "m1", "usage": {"prompt_tokens": 3, "completion_tokens": 1}}


def test_chat(server):
    server.answers = [(200, {}, GOOD)]
    service = Service(server.url, "key", "m", provider=remote.ProviderOptions(order=("a",)))
    reply = service.complete("text")
    assert (reply.content, reply.model, reply.prompt_tokens, reply.completion_tokens, reply.finish_reason) == ("short", "m1", 3, 1, "stop")
    path, key, body = server.seen[0]
    assert (path, key, body["model"], body["messages"][1], body["provider"]) == ("/v1/chat/completions", "Bearer key", "m", {"role": "user", "content": "text"}, {"order": ["a"]})
    assert service.rewrite("q") == "short" and server.seen[-1][2]["max_tokens"] == 100


@pytest.mark.parametrize(
    ("answer", "kind"),
    [((401, {}, {}), "authentication"), ((404, {}, {"error": {"message": "x", "code": "model_not_found"}}), "model_not_found"), ((400, {}, {"error": {"message": "x"}}), "api"), ((500, {}, {}), "api"), ((200, {}, b"no json"), "parse"), ((200, {}, {"choices": []}), "parse"), ((200, {}, {"choices": [{"message": {"content": None}}]}), "parse")],
)
def test_errors_that_end(server, waits, answer, kind):
    server.answers = [answer]
    with pytest.raises(remote.RemoteError) as found:
        Service(server.url, "k", "m").complete("x")
    assert found.value.kind == kind and waits == [] and len(server.seen) == 1


def test_rate_limits_are_waited_for(server, waits):
    server.answers = [(429, {"Retry-After": "7"}, {}), (429, {}, {}), (200, {}, GOOD)]
    assert Service(server.url, "k", "m").summarise("x") == "short"
    assert waits == [7.0, 60.0]


def test_no_server(waits):
    with pytest.raises(remote.RemoteError) as found:
        Service("http://127.0.0.1:9", "k", "m", timeout=1).complete("x")
    assert found.value.kind == "network" and waits == [1.0, 2.0, 4.0]


def test_embeddings(server, waits):
    server.answers = [(429, {}, {}), (200, {}, lambda body: {"data": [{"embedding": [len(t), 1.0], "index": i} for i, t in enumerate(body["input"])]})]
    service = Service(server.url, "k", "m")
    assert service.embed(["a", "bcd"]) == [[1, 1.0], [3, 1.0]] and waits == [2.0]
    assert service.embed_query("xy") == [2, 1.0] and service.embed([]) == []


def test_summaries_on_executors(spark, server):
    from noteloom.functions import extract as X

    server.answers = [(200, {}, GOOD)]
    rows = spark.createDataFrame([("a",), ("b",)], "text string").select(X.full("text").alias("content"))
    assert [r.summary for r in remote.summarise(rows, Service(server.url, "k", "m").summarise).collect()] == ["short", "short"]


def test_json_store_and_ids(spark, tmp_path):
    doc = lambda i: {"id": i, "metadata": {"title": "T" + i, "date": "2025-01-01T00:00:00Z", "tags": ["x"]}, "text": "t"}
    (tmp_path / "d.json").write_text(json.dumps({"documents": {i: doc(i) for i in "ab"}}, indent=1))
    docs = index_files.load_documents(spark, f"{tmp_path}/d.json")
    assert {(r.id, r.title, r.tags[0], r.date.year) for r in docs.collect()} == {("a", "Ta", "x", 2025), ("b", "Tb", "x", 2025)}
    same = docstore.with_content_ids(docs.withColumn("title", F.lit("T")))
    assert same.select("id").distinct().count() == 1 and len(same.first().id) == 16
    assert docstore.with_random_ids(docs).select("id").distinct().count() == 2
