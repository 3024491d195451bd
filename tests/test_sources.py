from __future__ import annotations

import json
import threading
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veritome import cli, model, prompts, runner
from veritome.operators import stats
from veritome.operators.selection import FirstPages, Hybrid
from veritome.sources import pages, sinks, synthetic
from veritome.sources.runs import RunStore
from veritome.streaming import records as streaming


def test_scan_and_cache(spark, tmp_path):
    folder, cache = tmp_path / "in", str(tmp_path / "cache")
    folder.mkdir()
    (folder / "a.txt").write_text("Head\nbody one is long enough\fHead\nbody two is long enough")
    (folder / "bad.txt").write_bytes(b"\xff\xfe\xff")
    rows = pages.scan(spark, str(folder)).collect()
    assert {(r.doc, r.page) for r in rows if r.error is None} == {("a.txt", 1), ("a.txt", 2)}
    assert [r.doc for r in rows if r.error] == ["bad.txt"]
    assert pages.load_corpus(spark, str(folder), skip_errors=True).count() == 2
    with pytest.raises(PySparkException, match=r"bad\.txt"):
        pages.load_corpus(spark, str(folder)).collect()
    one = {(r.doc, r.page): r.text for r in pages.ingest(spark, str(folder), cache).collect()}
    assert one["a.txt", 1] == "body one is long enough"
    (folder / "b.txt").write_text("another document with one page")
    assert {r.doc for r in pages.ingest(spark, str(folder), cache).collect()} == {"a.txt", "b.txt"}
    assert pages.load_cached(spark, cache).count() == 3  # nothing was ingested twice


def test_runs_and_resume(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "runs"))
    corpus = synthetic.corpus(spark, 3)
    assert store.list_runs() == []
    run = runner.run_and_store(spark, store, corpus.filter("doc <> 'artigo_03.pdf'"), FirstPages(4), model.Stub())
    assert store.load(run).count() == 2 and store.manifest(run)["summary"]["n_ok"] == 2
    assert runner.run_and_store(spark, store, corpus, FirstPages(4), model.Stub(), resume=run) == run
    assert store.load(run).count() == 3 and store.list_runs() == [run]
    limits = {r.doc: r.card.limitation for r in store.load(run).collect()}
    assert limits["artigo_01.pdf"] and limits["artigo_02.pdf"] is None
    now = datetime(2026, 1, 2, 3, 4, 5)
    assert store.new_run_id("first pages", "v", 0.0, now=now) == "20260102-030405_first-pages_v_t0.0_rep1"


def test_rehearsal(spark, tmp_path):
    table = runner.rehearse(spark, RunStore(spark, str(tmp_path / "runs")), synthetic.corpus(spark, 4), Hybrid(), FirstPages(4))
    rows = table.collect()
    assert len(rows) == 4 and all(r.audit_page_ok for r in rows)
    files = sinks.write_table(table, str(tmp_path), "out")
    head = files["csv"].read_bytes()
    assert head.startswith(b"\xef\xbb\xbfarquivo,problema,dados,metodo,metrica,limitacao,evidencia_trecho,evidencia_pagina,confianca")
    assert "<table" in sinks.write_report({"Resumo": "texto", "Fichas": table}, str(tmp_path / "r.html")).read_text()


def test_stub_faults_are_planned(spark):
    p = model.Params(temperature=0.7)
    s = model.Stub(broken_json=0.5)
    ask = lambda i: s.generate(None, f"{prompts.OPEN}\n[p. 1]\nText number {i} that is long enough to quote.\n{prompts.CLOSE}", p).text
    first = [ask(i) for i in range(60)]
    assert first == [ask(i) for i in range(60)] and 10 < sum(t.startswith("```") for t in first) < 58
    assert model.Stub(truncated=1.0).generate(None, "x", model.Params()).finish_reason == "length"


def test_prompts(spark):
    full, plain = prompts.prompt("v_full"), prompts.prompt("v_sem_delimitadores")
    assert prompts.MARKS["few_shot"] in full.marks_present() and prompts.MARKS["few_shot"] not in prompts.prompt("v_sem_fewshot").marks_present()
    assert prompts.feature_diff("v_full", "v_sem_fewshot") == {"few_shot": (True, False)}
    rows = prompts.render_prompts(spark.createDataFrame([("a", "[p. 1]\nx")], "doc string, context_text string"))
    r = rows.first()
    assert r.user.endswith(f"{prompts.OPEN}\n[p. 1]\nx\n{prompts.CLOSE}") and len(r.prompt_sha) == 12
    assert plain.around()[0].endswith("Artigo:\n")
    with pytest.raises(KeyError):
        prompts.prompt("nope")


def test_http_clients():
    class Server(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["content-length"])))
            chat = self.path.endswith("/chat/completions")
            out = {"choices": [{"message": {"content": body["model"]}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 3, "completion_tokens": 1}} if chat else {"content": [{"type": "text", "text": body["system"]}], "usage": {"input_tokens": 5, "output_tokens": 2}, "stop_reason": "max_tokens"}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert model.ChatCompletions("m", url).generate("s", "u", model.Params())[:3] == ("m", 3, 1)
    assert model.Messages("m", url).generate("s", "u", model.Params())[4] == "length"
    server.shutdown()


def test_failed_calls_are_rows(spark):
    class Broken:
        model_name = "broken"

        def generate(self, system, user, params):
            raise TimeoutError("no answer")

    got = runner.extract(synthetic.corpus(spark, 1), FirstPages(1), Broken(), run_id="r").first()
    assert got.parse_status == "failed" and got.error == "TimeoutError: no answer"


def test_model_sizes():
    assert model.params_billions("Qwen2.5-3B-Instruct") == 3.0 and model.params_billions("x") is None
    assert model.fits(3.0, True, 5.0) and not model.fits(7.0, False, 16.0)


def test_streaming(spark, tmp_path):
    folder = tmp_path / "answers"
    folder.mkdir()
    card = {"problema": "a", "dados": "b", "metodo": "c", "metrica": "d", "limitacao": None, "evidencia": {"trecho": "twenty characters at least", "pagina": 1}}
    rows = [{"run_id": "r", "doc": f"d{i % 3}", "raw_output": json.dumps(card) if i else "bad", "input_tokens": 1, "output_tokens": 1, "latency_s": 0.1, "answered_at": f"2026-01-01T00:0{i}:00Z"} for i in range(4)]
    (folder / "1.json").write_text("\n".join(map(json.dumps, rows)))
    parsed = streaming.unique_answers(streaming.parsed_answers(streaming.answers(spark, str(folder))))
    q = streaming.store_stream(parsed, str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True)
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 3 and got.filter("parse_status = 'failed'").count() == 1  # d0's retry within the watermark is a duplicate
    batch = streaming.parsed_answers(spark.read.schema(streaming.ANSWERS).json(str(folder)))
    assert streaming.summary_per_window(batch).select(F.sum("n")).first()[0] == 4
    assert stats.run_summary(batch, "run_id").first().n_failed == 1


def test_cli(spark, tmp_path, capsys):
    assert cli.main(["rehearse", str(tmp_path / "s"), "--documents", "2", "--out", str(tmp_path / "o")]) == 0
    assert (tmp_path / "o" / "rehearsal.csv").exists()
    assert cli.main(["runs", str(tmp_path / "s")]) == 0 and cli.main(["cost", str(tmp_path / "s")]) == 0
    assert "usd_total" in capsys.readouterr().out


def test_settings(monkeypatch):
    from veritome.config import settings

    monkeypatch.setenv("VERITOME_TOP_K", "3")
    monkeypatch.setenv("VERITOME_API_KEY", "hidden")
    s = settings(temperature=0.7)
    assert (s.top_k, s.params.temperature, s.strategy("semantic").top_k, s.price.output) == (3, 0.7, 3, 15.0)
    assert "hidden" not in str(s.public())
    with pytest.raises(ValueError, match="unknown"):
        s.strategy("x")


def test_card_schema_names_every_key():
    from veritome.functions.completion import card_schema

    assert card_schema()["required"] == ["problema", "dados", "metodo", "metrica", "limitacao", "evidencia"]


def counting(calls, limit):
    """A client that writes each call to a file and loses its worker after so many."""

    class Counting:
        model_name = "counting"

        def generate(self, system, user, params):
            import os
            from pathlib import Path

            from veritome.model import Stub

            if Path(calls).exists() and Path(calls).read_text().count("x") >= limit:
                os._exit(1)
            with open(calls, "a") as f:
                f.write("x")
            return Stub().generate(system, user, params)

    return Counting()


def test_a_lost_run_resumes_without_calling_again(spark, tmp_path):
    store, corpus = RunStore(spark, str(tmp_path / "runs")), synthetic.corpus(spark, 12).coalesce(1)
    n = corpus.select("doc").distinct().count()
    run, calls = store.new_run_id("first_pages", "v_full", 0.0), tmp_path / "calls"
    with pytest.raises(Exception):  # noqa: B017
        runner.run_and_store(spark, store, corpus, FirstPages(2), counting(str(calls), n // 2), resume=run, wave=1)
    kept = store.answers(run).count()
    assert 0 < kept <= n // 2 and store.load(run).count() == 0
    made = calls.read_text().count("x")
    runner.run_and_store(spark, store, corpus, FirstPages(2), counting(str(calls), 10**6), resume=run)
    assert store.load(run).count() == n and calls.read_text().count("x") - made == n - kept
    runner.run_and_store(spark, store, corpus, FirstPages(2), counting(str(calls), 0), resume=run)
    assert store.load(run).count() == n and store.list_runs() == [run]
