"""Index metadata, cross checks, the provider over HTTP, settings and the batch entry point."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from sparrowfold import __main__ as batch
from sparrowfold.operators import inspection, manifest
from sparrowfold.plans import engine, evaluation
from sparrowfold.sources import provider, store
from sparrowfold.sources import tables as src


def index_rows(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, strategy_id string, target_tokens int, embedding array<double>")


GOOD = [("a", "target_416", 416, [1.0, 0.0]), ("b", "target_416", 416, [0.0, 1.0])]


def test_index_metadata(spark, tmp_path):
    path = f"{tmp_path}/index"
    src.write_index(index_rows(spark, [*GOOD, ("c", "target_128", 128, [1.0, 1.0])]), path, "doc", "abc", "model")
    about = {r.strategy_id: r for r in src.index_about(spark, path).collect()}
    assert (about["target_416"].chunk_count, about["target_416"].embedding_dimension, about["target_416"].target_tokens, about["target_416"].embedding_model) == (2, 2, 416, "model")
    assert src.load_index(spark, path, "target_416").count() == 2 and src.read_index(spark, path).count() == 3
    assert src.read_index(spark, src.promote(spark, path, "target_416", f"{tmp_path}/selected")).count() == 2
    assert src.selection(spark, f"{tmp_path}/selected").first().document_sha256 == "abc"
    # a row too few, and nothing known
    rows = src.current(spark, path).path + "/rows"
    index_rows(spark, GOOD[:1]).drop("strategy_id").write.mode("overwrite").parquet(f"{rows}/strategy_id=target_416")
    with pytest.raises(manifest.Incompatible, match="chunk_count"):
        src.load_index(spark, path, "target_416")
    with pytest.raises(manifest.Incompatible):
        src.load_index(spark, path, "target_1")


def test_readers_never_see_half_a_promotion(spark, tmp_path, monkeypatch):
    path, selected = f"file://{tmp_path}/index", f"file://{tmp_path}/selected"
    src.write_index(index_rows(spark, [*GOOD, ("c", "target_128", 128, [1.0, 1.0])]), path, "doc", "abc", "model")
    with pytest.raises(FileNotFoundError):
        src.current(spark, selected)
    first = src.promote(spark, path, "target_416", selected)
    held = src.current(spark, selected)
    # the writer dies after the rows, and after all tables but before the pointer
    for step in ("write_json", "commit"):
        with monkeypatch.context() as m:
            m.setattr(*((src, step) if step == "write_json" else (store.Store, step)), lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                src.promote(spark, path, "target_128", selected)
        now = src.current(spark, selected)
        assert now.number == first.number and src.selection(spark, now).first().strategy_id == "target_416"
        assert src.load_index(spark, now, "target_416").count() == 2
    second = src.promote(spark, path, "target_128", selected)
    assert second.number == 2 and second.facts["strategy_id"] == "target_128" and src.load_index(spark, selected, "target_128").count() == 1
    # who has begun to read goes on with what was there; two writers can't take one number
    assert src.read_index(spark, held).count() == 2
    mine = store.Store(spark, selected)
    folders = [mine.write({"rows": index_rows(spark, GOOD)}) for _ in range(2)]
    mine.commit(folders[0], after=2)
    with pytest.raises(store.Conflict):
        mine.commit(folders[1], after=2)
    with monkeypatch.context() as m:
        m.setattr(store.Store, "_numbers", lambda self: [1, 2])
        with pytest.raises(store.Conflict):
            mine.commit(folders[1])
    assert mine.current().number == 3
    assert len(mine.prune(keep=1)) == 5 and mine.current().number == 3 and len(mine._numbers()) == 1


def test_cross_checks(spark):
    row = {"document_id": "doc", "document_sha256": "abc", "embedding_model": "model", "strategy_id": "target_416", "target_tokens": 416}
    one = lambda **kw: spark.createDataFrame([tuple((row | kw).values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in (row | kw).items()))
    selected, about, cut, index = one(chunk_count=2), one(chunk_count=2, embedding_dimension=2), one(selected_threshold=0.7), index_rows(spark, GOOD)
    labels = lambda *a, **kw: [r.label for r in manifest.cross_checks(*a, **kw).collect()]
    assert labels(selected, cut, about, index, "abc", "model") == []
    assert labels(selected, cut, about, index, "abd") == ["sha256 of selection", "sha256 of index", "sha256 of calibration"]
    assert labels(selected, cut, about, index, "abc", "other") == ["embedding_model of configuration"]
    for field, value in (("document_id", "x"), ("embedding_model", "x"), ("strategy_id", "x"), ("target_tokens", 1)):
        assert labels(selected, cut, about.withColumn(field, F.lit(value)), index, "abc") == [f"{field} of index"]
        assert labels(selected, cut.withColumn(field, F.lit(value)), about, index, "abc") == [f"{field} of calibration"]
    assert labels(selected, cut.withColumn("selected_threshold", F.lit(float("nan"))), about, index, "abc") == ["threshold within bounds"]
    assert labels(selected, cut, about, index.limit(1), "abc") == ["rows of index"]
    assert labels(selected.withColumn("chunk_count", F.lit(3)), cut, about, index, "abc") == ["chunk_count of selection"]
    assert labels(selected, cut, about.withColumn("embedding_dimension", F.lit(3)), index, "abc") == ["vector length"]
    assert labels(selected, cut, about, index.withColumn("chunk_id", F.lit("a")), "abc") == ["distinct chunks"]
    assert set(labels(selected, cut, about, index.withColumn("strategy_id", F.lit("s")).withColumn("target_tokens", F.lit(9)), "abc")) == {"strategy of rows", "target of rows"}


def test_thresholds_within_bounds(spark, tmp_path):
    for value, good in ((0.5, True), (1.5, False), (None, False)):
        (tmp_path / "c.json").write_text(json.dumps({"selected_threshold": value, "strategy_id": "s"}))
        if good:
            assert src.read_threshold(spark, f"{tmp_path}/c.json").first().selected_threshold == value
        else:
            with pytest.raises(Exception, match="within"):
                src.read_threshold(spark, f"{tmp_path}/c.json").collect()


def test_calibration_needs_a_hit_for_every_query(spark):
    q = spark.createDataFrame([("q", [1.0], True), ("r", [1.0], False)], "query_id string, embedding array<double>, is_positive boolean")
    with pytest.raises(Exception, match="no hit"):
        evaluation.calibrate(spark.createDataFrame([], "chunk_id string, embedding array<double>"), q).collect()
    assert evaluation.calibrate(spark.createDataFrame([("c", [0.5])], "chunk_id string, embedding array<double>"), q).count() == 1


def test_evidence_windows(spark):
    units = spark.createDataFrame([("d", k, t, 1) for k, t in enumerate(["x", "The  Plan", "y", "z", "plan b", "w"])], "document_id string, source_order int, text string, page_number int")
    anchors = spark.createDataFrame([("c", "the plan"), ("c", "zz"), ("e", "PLAN"), ("none", "q")], "candidate_id string, anchor string")
    got = sorted((r.candidate_id, r.source_order, r.is_match) for r in inspection.evidence_windows(units, anchors, 1).collect())
    assert got == [("c", 0, False), ("c", 1, True), ("c", 2, False), ("e", 0, False), ("e", 1, True), ("e", 2, False), ("e", 3, False), ("e", 4, True), ("e", 5, False)]


class Service(BaseHTTPRequestHandler):
    seen: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Service.seen.append((self.headers["Authorization"], body["model"]))
        status = {"good": 200, "busy": 429, "gone": 404, "moved": 302, "empty": 200}[body["model"]]
        self.send_response(status)
        if status == 302:
            self.send_header("Location", "/elsewhere")
        self.end_headers()
        if body["model"] == "good":
            self.wfile.write(b'{"ok": 1}')

    def log_message(self, *_):
        pass


def test_provider():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/v1"
    p = provider.HttpProvider(url, "secret-key", 5)
    try:
        assert p("good", '{"model": "x", "messages": []}') == (200, '{"ok": 1}') and p.require("good", "{}") == '{"ok": 1}'
        assert Service.seen[0] == ("Bearer secret-key", "good")
        for model, status, retry, fallback in (("busy", 429, True, True), ("gone", 404, False, True), ("moved", 302, False, False)):
            with pytest.raises(provider.CallFailed) as e:
                p.require(model, "{}")
            assert (e.value.status, e.value.retryable, e.value.fallback_allowed) == (status, retry, fallback) and "secret" not in str(e.value)
        with pytest.raises(provider.UnusableResponse):
            p.require("empty", "{}")
    finally:
        server.shutdown()
        server.server_close()
    assert p("good", "{}") == (0, "") and "secret" not in repr(p)
    for bad in ({"key": ""}, {"url": "ftp://x"}, {"timeout": 0}, {"timeout": 121}, {"connect_timeout": 0}, {"key": "a b"}):
        with pytest.raises(provider.ConfigurationError):
            provider.HttpProvider(**{"url": url, "key": "k"} | bad)


class Models(BaseHTTPRequestHandler):
    """Answers by the model's name and by what the question says; keeps the order of calls and how many were open at once."""

    calls: list = []
    lock, open_now, most = threading.Lock(), 0, 0

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        question = body["messages"][1]["content"].split("\n")[1]
        with Models.lock:
            Models.calls.append((question, body["model"]))
            Models.open_now += 1
            Models.most = max(Models.most, Models.open_now)
            nth = Models.calls.count((question, body["model"]))
        time.sleep(0.1)
        with Models.lock:
            Models.open_now -= 1
        status, content = 200, json.dumps({"answer": f"from {body['model']}", "citations": ["c1"]})
        if body["model"] == "first":
            if question == "hang":
                time.sleep(1.5)
            status = {"busy": 503, "gone": 404, "refused": 401, "once": 503 if nth == 1 else 200}.get(question, 200)
            content = {"words": "no json", "schema": json.dumps({"answer": "x"}), "blank": json.dumps({"answer": " ", "citations": []})}.get(question, content)
        elif question == "busy":
            status = 500
        elif question == "schema":
            content = "{}"
        try:
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": content}}]}).encode())
        except OSError:  # the caller has hung up
            pass

    def log_message(self, *_):
        pass


def test_fallback_retry_timeouts_and_the_window(spark):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Models)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    post = provider.HttpProvider(f"http://127.0.0.1:{server.server_port}/v1?x=1", "key", timeout=0.7, connect_timeout=2)
    questions = ["fine", "busy", "gone", "refused", "once", "words", "schema", "blank", "hang"]
    asked = spark.createDataFrame([(q, q) for q in questions], "query_id string, query string").coalesce(1)
    evidence = asked.select("query_id", F.lit(1).alias("rank"), F.lit("c1").alias("chunk_id"), F.lit("text").alias("text"))
    try:
        made = engine.model_generator(asked, post, ("first", "first", "second", "first"), engine.Config(window=3))(evidence)
        got = {r.query_id: (r.answer, r.error_class, r.model, r.used_fallback, r.attempts) for r in made.collect()}
        before = len(Models.calls)
        assert made.count() == len(questions) and len(Models.calls) == before  # looking again asks nobody
    finally:
        server.shutdown()
        server.server_close()
    assert got["fine"] == ("from first", None, "first", False, 1) and got["once"] == ("from first", None, "first", False, 2)
    assert got["refused"] == (None, "provider", "first", False, 1)
    assert got["gone"] == got["words"] == got["blank"] == got["hang"] == ("from second", None, "second", True, 1)
    assert got["busy"] == (None, "provider", "second", True, 2) and got["schema"] == (None, "completion", "second", True, 1)
    of = lambda q: [m for x, m in Models.calls if x == q]
    assert of("busy") == ["first", "first", "second", "second"] and of("hang") == ["first", "first", "second"]
    assert of("words") == of("gone") == ["first", "second"] and of("refused") == of("fine") == ["first"]
    assert 1 < Models.most <= 4  # 3, and one that its caller has given up
    assert post("first", json.dumps({"messages": [{}, {"content": "QUESTION:\nfine"}]})) == (0, "")


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("# settings\nTOP_K=7\nthreshold='0.25'\nUNKNOWN=1\n")
    got = engine.Config.from_env({"Top_K": "9", "FINAL_K": "3"}, f"{tmp_path}/.env")
    assert (got.top_k, got.final_k, got.threshold, got.attempts) == (9, 3, 0.25, 2)
    for bad in ({"TOP_K": "many"}, {"TOP_K": "2", "FINAL_K": "3"}):
        with pytest.raises(ValueError):
            engine.Config.from_env(bad)


def test_batch(spark, tmp_path):
    schema = "chunk_id string, text string, page_numbers array<int>"
    spark.createDataFrame([("c1", "the plan covers care", [3])], schema).write.parquet(f"{tmp_path}/chunks")
    spark.createDataFrame([("c1", " ", [3]), ("c1", "x", [])], schema).write.parquet(f"{tmp_path}/unfit")
    (tmp_path / "q.json").write_text('{"query_id": "a", "query": "plan covers"}\n{"query_id": "b", "query": " "}\n')
    batch.answer(spark, f"{tmp_path}/q.json", f"{tmp_path}/chunks", f"{tmp_path}/out", engine.Config(threshold=0.3))
    statuses = lambda out: {r.query_id: r.status for r in spark.read.json(out).collect()}
    assert statuses(f"{tmp_path}/out") == {"a": 200, "b": 422}
    assert {r.problem for r in batch.readiness(spark.read.parquet(f"{tmp_path}/unfit")).collect()} == {"blank_text", "no_pages", "repeated_id"}
    for run in (lambda: batch.answer(spark, f"{tmp_path}/q.json", f"{tmp_path}/unfit", f"{tmp_path}/out2", engine.Config()), lambda: batch.index(spark, f"{tmp_path}/unfit", f"file://{tmp_path}/store")):
        with pytest.raises(manifest.Incompatible):
            run()
    # from a published index, and by a model
    batch.index(spark, f"{tmp_path}/chunks", f"file://{tmp_path}/store")
    server = ThreadingHTTPServer(("127.0.0.1", 0), Models)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    given = {"provider_url": f"http://127.0.0.1:{server.server_port}/v1", "provider_key": "k", "llm_model": "second"}
    try:
        batch.answer(spark, f"{tmp_path}/q.json", f"file://{tmp_path}/store", f"{tmp_path}/out3", engine.Config(threshold=0.3), given)
    finally:
        server.shutdown()
        server.server_close()
    assert statuses(f"{tmp_path}/out3") == {"a": 200, "b": 422}
    assert "from second" in {r.answer for r in spark.read.json(f"{tmp_path}/out3").collect()}
    assert batch.main([]) == 2 and batch.main(["answer", "x"]) == 2


def test_provider_settings():
    good = {"provider_url": "https://x.test/v1", "provider_key": "k", "llm_model": "a", "llm_fallback_model": "b", "llm_timeout_seconds": "4"}
    got = provider.Settings.of(good)
    assert got.models == ("a", "b") and (got.post.timeout, got.post.connect_timeout) == (4.0, 4.0) and provider.Settings.of({}) is None
    for bad in ({"llm_model": " "}, {"provider_key": ""}, {"llm_timeout_seconds": "x"}, {"llm_timeout_seconds": "500"}):
        with pytest.raises(provider.ConfigurationError):
            provider.Settings.of(good | bad)


def test_offline_entry_points(spark, tmp_path):
    rows = [(c, s, 416 if s == "target_416" else 128, v, u) for s in ("target_416", "target_128") for c, v, u in ((f"{s}-a", [1.0, 0.0], [1]), (f"{s}-b", [0.0, 1.0], [2 if s == "target_416" else 9]))]
    index = spark.createDataFrame(rows, "chunk_id string, strategy_id string, target_tokens int, embedding array<double>, units array<int>")
    store, selected = f"file://{tmp_path}/index", f"file://{tmp_path}/selected"
    src.write_index(index, store, "doc", "abc", "model")
    tables = {
        "queries": spark.createDataFrame([("q", [0.1, 1.0], True), ("r", [0.3, -1.0], False)], "query_id string, embedding array<double>, is_positive boolean"),
        "gold": spark.createDataFrame([("q", 0, 2)], "query_id string, group_no int, unit int"),
        "lengths": spark.createDataFrame([("target_416", 416, 300.0), ("target_128", 128, 100.0)], "strategy_id string, target int, mean_tokens double"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}")
    batch.select(spark, store, f"{tmp_path}/queries", f"{tmp_path}/gold", f"{tmp_path}/lengths", f"{tmp_path}/out", [1])
    assert [r.strategy_id for r in spark.read.json(f"{tmp_path}/out/selected").collect()] == ["target_416"]
    src.promote(spark, store, "target_416", selected)
    batch.calibrate(spark, selected, f"{tmp_path}/queries", f"{tmp_path}/cut")
    (cut,) = spark.read.json(f"{tmp_path}/cut").collect()
    assert cut.balanced_accuracy == 1.0 and 0.3 < cut.threshold < 1.0
