import json

import pytest
from pyspark.sql import functions as F

from sparrowfold.operators import grounding, inspection, manifest
from sparrowfold.plans import engine
from sparrowfold.sources import tables as src
from sparrowfold.streaming.answers import answer_stream

HITS = "query_id string, rank int, chunk_id string, score double"


def hits(spark, *rows):
    return spark.createDataFrame(rows, HITS)


def test_citations(spark):
    made = [
        ("ok", "x", ["b", "a", "b"]), ("none", "x", []), ("unknown", "x", ["z"]), ("abstain", grounding.ABSTENTION, []), ("cited", grounding.ABSTENTION, ["a"]), ("twice", "x", ["a"]),
    ]
    h = [(q, n, c, 0.5) for q, *_ in made for n, c in enumerate("ab", 1)] + [("twice", 3, "a", 0.4)]
    got = {r.query_id: r for r in grounding.check_citations(spark.createDataFrame(made, "query_id string, answer string, citations array<string>"), hits(spark, *h)).collect()}
    assert got["ok"].citations == ["b", "a"]
    assert {k: r.status for k, r in got.items()} == {"ok": "ok", "none": "uncited_answer", "unknown": "unknown_citation", "abstain": "ok", "cited": "cited_abstention", "twice": "repeated_hit"}
    with pytest.raises(Exception):  # noqa: B017
        grounding.require_ok(spark.createDataFrame([("q", "uncited_answer")], "query_id string, status string")).collect()


def test_prompts(spark):
    q = spark.createDataFrame([("q", "  What? ")], "query_id string, query string")
    e = spark.createDataFrame([("q", 2, "b", "two"), ("q", 1, "a", 'one "x"')], "query_id string, rank int, chunk_id string, text string")
    p = grounding.prompts(q, e)
    system, user = p.first().messages
    assert system.role == "system" and user.content.startswith("QUESTION:\nWhat?\n\nALLOWED CITATION IDS:\n[\"a\",\"b\"]")
    assert json.loads(user.content.split("JSON:\n")[1]) == [{"chunk_id": "a", "text": 'one "x"'}, {"chunk_id": "b", "text": "two"}]
    body = json.loads(grounding.payloads(p, "m").first().payload)
    assert (body["model"], body["temperature"], body["max_tokens"], body["response_format"]["json_schema"]["strict"]) == ("m", 0, 512, True) and len(body["messages"]) == 2
    with pytest.raises(Exception):  # noqa: B017
        grounding.prompts(q, e.where("false")).collect()


def completion(content, finish="stop"):
    return json.dumps({"choices": [{"finish_reason": finish, "message": {"content": content}}]})


GOOD = json.dumps({"answer": " yes ", "citations": ["a"]})


@pytest.mark.parametrize(
    ("body", "error"),
    [
        (completion(GOOD), None), ("<html>", "not_json"), ("{}", "no_content"), (completion(GOOD, "length"), "token_limit"), (completion("{"), "content_not_json"), (completion({"answer": "x", "citations": []}), "content_not_text"),
        (completion(json.dumps({"answer": "x"})), "schema"), (completion(json.dumps({"answer": "x", "citations": [], "more": 1})), "schema"), (completion(json.dumps({"answer": 5, "citations": []})), "schema"),
        (completion(json.dumps({"answer": "x", "citations": [1]})), "schema"), (completion(json.dumps({"answer": " ", "citations": []})), "schema"), (completion(json.dumps({"answer": "x", "citations": [" "]})), "schema"), (completion("[1]"), "schema"),
        (completion(json.dumps({"answer": "x", "citations": []})), None),
    ],
)
def test_completions(spark, body, error):
    r = grounding.parse_completions(spark.createDataFrame([("q", body)], "query_id string, body string")).first()
    assert r.error == error and (r.answer is None) == (error is not None)


def test_steps_and_codes(spark):
    df = spark.createDataFrame([(200, 1), (500, 1), (429, 2), (404, 1), (401, 1), (408, 1)], "status int, attempt int")
    assert [r[0] for r in df.select(grounding.next_step(F.col("status"), F.col("attempt"), F.lit(2))).collect()] == ["done", "retry", "fallback", "fallback", "fail", "retry"]
    codes = spark.createDataFrame([("ok",), ("citation",), ("provider",), ("odd",)], "e string").select(grounding.status_code(F.col("e"))).collect()
    assert [r[0] for r in codes] == [200, 502, 503, 500]


CHUNKS = [("c1", "the plan covers hospital care", [3]), ("c2", "the plan covers drugs at home", [4, 5]), ("c3", "nothing alike", [9])]
QUESTIONS = [("q1", "plan covers hospital care"), ("q2", "zebra crossing"), ("q3", "  "), ("q4", "x" * 2001)]


def tables(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id string, text string, page_numbers array<int>"), spark.createDataFrame(QUESTIONS, "query_id string, query string")


def test_answers(spark):
    chunks, asked = tables(spark)
    config = engine.Config(threshold=0.3)
    got = {r.query_id: r for r in engine.answers(asked, chunks, engine.sparse_retriever(chunks), engine.extractive, config).collect()}
    assert got["q1"].answer == CHUNKS[0][1] and [s.chunk_id for s in got["q1"].sources] == ["c1", "c2"] and 0 < got["q1"].confidence_score <= 1
    assert got["q1"].sources[1].page_reference == "PDF pages 4–5"
    assert (got["q2"].answer, got["q2"].confidence_score, got["q2"].sources, got["q2"].reason) == (grounding.ABSTENTION, 0.0, None, "no_hits")
    assert [got[k].status for k in ("q1", "q2", "q3", "q4")] == [200, 200, 422, 422]


def test_model_generator_and_its_calls(spark, tmp_path):
    chunks, asked = tables(spark)
    log = str(tmp_path / "calls")

    def post(model, payload):
        with open(log, "a") as f:
            f.write(model + "\n")
        return (500, "") if model == "first" else (200, completion(json.dumps({"answer": "yes", "citations": ["c1"]})))

    config = engine.Config(threshold=0.3)
    rows = engine.answers(asked, chunks, engine.sparse_retriever(chunks), engine.model_generator(asked, post, ("first", "second"), config), config)
    got = {r.query_id: r for r in rows.select("query_id", "answer", "status").collect()}
    assert got["q1"].answer == "yes" and got["q2"].answer == grounding.ABSTENTION
    calls = open(log).read().split()
    assert calls[:3] == ["first", "first", "second"] and set(calls) == {"first", "second"}
    failing = engine.answers(asked, chunks, engine.sparse_retriever(chunks), engine.model_generator(asked, lambda m, p: (401, ""), ("first",), config), config)
    assert {r.query_id: r.status for r in failing.collect()}["q1"] == 503


def test_config():
    for bad in ({"top_k": 0}, {"top_k": 51}, {"final_k": 11}, {"top_k": 3, "final_k": 4}, {"threshold": 1.5}, {"attempts": 0}):
        with pytest.raises(ValueError):
            engine.Config(**bad)


def test_stream(spark, tmp_path):
    chunks, asked = tables(spark)
    asked.write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("query_id string, query string").json(f"{tmp_path}/in")
    answer = lambda q: engine.answers(q, chunks, engine.sparse_retriever(chunks), engine.extractive, engine.Config(threshold=0.3)).select("query_id", "status")
    run = answer_stream(stream, answer, lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/{n}"), f"{tmp_path}/cp")
    run.processAllAvailable()
    run.stop()
    assert spark.read.parquet(f"{tmp_path}/out/0").count() == 4


def index_rows(spark, *rows):
    return spark.createDataFrame(rows, "chunk_id string, strategy_id string, target_tokens int, embedding array<float>")


def test_manifest(spark, tmp_path):
    index = index_rows(spark, ("a", "target_416", 416, [1.0, 0.0, 0.0, 0.0]), ("b", "target_416", 416, [0.0, 1.0, 0.0, 0.0]))
    chosen = spark.createDataFrame([("target_416", 416)], "strategy_id string, target_tokens int")
    cut = spark.createDataFrame([(0.76, "target_416")], "threshold double, strategy_id string")
    good = manifest.build(index, chosen, cut, "abc", "model")
    assert (good.first().chunk_count, good.first().embedding_dimension) == (2, 4)
    manifest.require_none(manifest.mismatches(good, good), manifest.inner_mismatches(good), manifest.chunk_violations(index, "target_416", 416))
    for field, value in (("document_sha256", "abd"), ("embedding_model", "other"), ("strategy_id", "target_128"), ("chunk_count", 3), ("embedding_dimension", 5), ("target_tokens", 128)):
        assert [r.label for r in manifest.mismatches(good, good.withColumn(field, F.lit(value))).collect()] == [field]
    with pytest.raises(manifest.Incompatible):
        manifest.require_none(manifest.inner_mismatches(manifest.build(index, chosen, cut.withColumn("strategy_id", F.lit("target_128")), "abc", "model")))
    bad = index_rows(spark, ("a", "target_416", 416, [1.0]), ("a", "target_128", 416, [1.0, float("nan")]))
    assert {r.problem for r in manifest.chunk_violations(bad, "target_416", 416).collect()} == {"other_strategy", "repeated_id"}
    assert {r.problem for r in src.index_violations(bad).collect()} == {"several_lengths", "not_finite", "repeated_chunk"}
    src.write_index(index, f"{tmp_path}/index")
    assert src.read_index(spark, src.promote(spark, f"{tmp_path}/index", "target_416", f"{tmp_path}/selected")).count() == 2
    with pytest.raises(ValueError):
        src.promote(spark, f"{tmp_path}/index", "target_1", f"{tmp_path}/selected")


def test_query_files(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"version": "1", "queries": [{"query_id": "q1", "query": "x", "category": "c", "evidence_groups": [[1], [2, 3]], "gold_pages": [4]}, {"query_id": "q1", "query": " ", "category": "c", "evidence_groups": [[]], "gold_pages": []}]}))
    q = src.read_queries(spark, f"{tmp_path}/q.json")
    assert q.first().evidence_groups == [[1], [2, 3]]
    assert {r.problem for r in src.query_violations(q).collect()} == {"blank_query", "no_evidence", "repeated_id"}
    assert src.query_violations(q.limit(1)).count() == 0 and [r.problem for r in src.query_violations(q.where("false")).collect()] == ["empty"]


def test_inspection(spark):
    texts = spark.createDataFrame([(1, "The  Plan\ncovers"), (2, "plan"), (3, None)], "key long, text string")
    phrases = spark.createDataFrame([(10, "plan covers"), (11, "PLAN"), (12, " "), (13, "x")], "phrase_id long, phrase string")
    assert sorted(map(tuple, inspection.phrase_matches(texts, phrases).collect())) == [(1, 10), (1, 11), (2, 11)]
    anchors = spark.createDataFrame([("a", "plan covers"), ("a", "plan"), ("b", "zebra")], "candidate_id string, anchor string")
    assert sorted(map(tuple, inspection.candidates(texts, anchors).collect())) == [(1, "a"), (2, "a")]
    units = spark.createDataFrame([("d", k, f"t{k}") for k in range(10)], "document_id string, source_order int, text string")
    centers = spark.createDataFrame([("m", "d", 1), ("m", "d", 3), ("n", "d", 9)], "label string, document_id string, source_order int")
    near = inspection.context(units, centers, 2).orderBy("label", "source_order").collect()
    assert [(r.label, r.source_order, r.is_center) for r in near] == [("m", 0, False), ("m", 1, True), ("m", 2, False), ("m", 3, True), ("m", 4, False), ("m", 5, False), ("n", 7, False), ("n", 8, False), ("n", 9, True)]
