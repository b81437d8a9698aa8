"""Clients of language models against a server and a command made here; rows of documents that can't be scored."""

import json
import sys
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from docgauge.judging.clients import CommandLine, Manual, factory, read_manifest
from docgauge.operators import golden, signals
from docgauge.plans.run import score_corpus
from docgauge.sources.grid import load_grid


@pytest.fixture(scope="module")
def server():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, {k.lower(): v for k, v in self.headers.items()}, body))
            if "casse" in json.dumps(body):
                self.send_response(500)
                self.end_headers()
                return
            text = json.dumps({"n": 1})
            out = {"content": [{"text": text}]} if self.path.endswith("/v1/messages") else {"choices": [{"message": {"content": text}}]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *_):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", seen
    s.shutdown()


@pytest.mark.parametrize(("provider", "path", "header"), [("openai", "/chat/completions", "authorization"), ("anthropic", "/v1/messages", "x-api-key"), ("azure_openai", "/openai/deployments/m/chat/completions?api-version=2024-06-01", "api-key")])
def test_http_providers(server, monkeypatch, provider, path, header):
    base, seen = server
    client = factory({"provider": provider, "base_url": base, "model": "m", "api_key_env": "SOME_KEY"})()
    monkeypatch.delenv("SOME_KEY", raising=False)
    with pytest.raises(RuntimeError, match="SOME_KEY"):
        client.ask("x")
    monkeypatch.setenv("SOME_KEY", "secret")
    assert json.loads(client.ask("Bonjour")) == {"n": 1}
    got, headers, body = seen[-1]
    assert got == path and "secret" in headers[header] and body["messages"][0]["content"] == "Bonjour" and body["temperature"] == 0
    with pytest.raises(OSError):
        client.ask("casse")


def test_command_line():
    run = lambda code: CommandLine({"command": [sys.executable, "-c", code], "timeout": 20})
    assert run("import sys; print(sys.stdin.read().upper())").ask("abc").strip() == "ABC"
    assert run("print('{\"result\": \"oui\"}')").ask("x") == "oui"
    for code in ("import sys; sys.exit(3)", "print('{\"is_error\": true, \"result\": \"non\"}')"):
        with pytest.raises(RuntimeError):
            run(code).ask("x")


def test_manual_answers(tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"placeholder": "[[IMAGE:p=1;idx=1]]", "description": " Un plan "}, {"placeholder": "b", "description": ""}, {}]))
    filled = read_manifest(str(tmp_path / "m.json"))
    assert filled == {"[[IMAGE:p=1;idx=1]]": "Un plan"} and read_manifest(None) == read_manifest(str(tmp_path / "none")) == {}
    (tmp_path / "m.json").write_text("rien")
    assert read_manifest(str(tmp_path / "m.json")) == {}
    assert Manual(filled).describe(b"", "page 1|[[IMAGE:p=1;idx=1]]") == "Un plan" and Manual(filled).describe(b"", "page 2|x") == ""
    with pytest.raises(RuntimeError):
        Manual({}).ask("x")


def test_unsupported_documents_have_a_row(spark):
    block = "array<struct<kind:string,text:string,page:int,section:string>>"
    rows = [("a", "", [], 0.0, "unsupported_format", "xlsx", ["missing_sidecar"]), ("b", None, None, None, "text", "md", None), ("c", "Un texte.", [], 1.0, None, "md", [])]
    df = spark.createDataFrame(rows, f"doc_id string, markdown string, blocks {block}, parse_confidence double, category string, type string, entry_flags array<string>")
    got = {r["doc_id"]: r for r in score_corpus(df, load_grid()).doc_scores.collect()}
    assert got["a"]["flags"] == ["unsupported_format:xlsx", "missing_sidecar"] and got["a"]["global_pct"] == 0.0 and got["b"]["flags"] == ["unreadable"] and set(got) == {"a", "b", "c"}


def test_automatic_descriptions_are_counted(spark):
    mark = signals.AUTO_DESCRIPTION
    rows = [("a", f"x {mark}): un]\n{mark}): deux]"), ("b", "description automatique, non verifiee"), ("c", None)]
    got = {r["doc_id"]: r["auto_descriptions"] for r in signals.signals(spark.createDataFrame(rows, "doc_id string, markdown string"), blocks=None).collect()}
    assert got == {"a": 2, "b": 0, "c": 0}


def test_number_of_questions():
    assert "12" in golden.wanted("12") and golden.wanted(None) == golden.wanted("AUTO") == golden.wanted("auto") and golden.wanted(3) != golden.wanted(4)
    with pytest.raises(ValueError):
        golden.wanted("douze")
