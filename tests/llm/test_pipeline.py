import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sparrowfold.llm.secret_scan import Scanner

from .helpers import frame
from .test_classifiers import QUALITY, ROWS, TOXIC
from .test_superminhash import brute, near_copies


def masked(text):
    if text is None:
        return None
    out, at = [], 0
    for a, b, _ in Scanner().spans(text):
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_each_stage_on_its_own_input(spark, tmp_path):
    rng = random.Random(2)
    clean = [t for (k, t), (_, q), (_, x) in zip(ROWS, QUALITY, TOXIC) if q and not x]
    extra = [*ROWS, *((k + 5000, t) for k, t in near_copies()), (20_000, clean[0] + " password=abcdefgh"), (20_001, clean[1]), (20_002, clean[1]), (20_001, clean[2])]
    rng.shuffle(extra)
    clashing = {"_n": F.lit(7), "_0": F.lit("own"), "_1": F.col("doc_id"), "t": F.lit(None).cast("int")}
    frame(spark, extra=extra).withColumns(clashing).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, q, x) for (k, q), (_, x) in zip(QUALITY, TOXIC)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == 4 or out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.collect())
        assert k == 4 or all(r["_n"] == 7 and r["_0"] == "own" and r["_1"] == r.doc_id and r.t is None for r in seen[-1])
    quality, toxic = dict(QUALITY), dict(TOXIC)
    kept = {r.doc_id for r in seen[0]}
    assert np.mean([(k in kept) != bool(x) for k, x in toxic.items()]) > 0.95
    left = {r.doc_id for r in seen[1]}
    assert np.mean([(k in left) == bool(quality[k]) for k in quality if k in kept]) > 0.95
    want = {i for i, _, c in brute([(r.doc_id, r.text) for r in seen[1]], 80) if i == c and i != "None"}
    got = [str(r.doc_id) for r in seen[2] if r.doc_id is not None]
    assert sorted(got) == sorted(want)
    assert sum(r.doc_id is None for r in seen[2]) == sum(r.doc_id is None for r in seen[1])
    before = {r.doc_id: r.text for r in seen[2] if r.doc_id is not None}
    assert len(seen[3]) == len(seen[2])
    for r in seen[3]:
        if r.doc_id is not None:
            assert r.text == masked(before[r.doc_id]) and r.n_chars == (len(r.text) if r.text is not None else None)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in seen[3]:
        if r.doc_id is not None:
            own = sorted((p for p in seen[4] if p.doc_id == r.doc_id), key=lambda p: p.start)
            assert [x for p in own for x in np.frombuffer(p.ids, "<u4").tolist()] == t.encode(r.text or "", add_special_tokens=False).ids + [1]


def test_run_on_an_empty_corpus(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_copies_from_80_percent_go(spark):
    """Texts at 0.82 and at 0.79: 9 and 11 shingles of either one's own, beside 84 in common."""
    rows = []
    for k, (key, extra) in enumerate([(1, 9), (3, 11)]):
        shared = [f"s{k}x{j}" for j in range(88)]
        rows += [(key, " ".join([*(f"l{k}x{j}" for j in range(extra)), *shared])), (key + 1, " ".join([*shared, *(f"r{k}x{j}" for j in range(extra))]))]
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame([*rows, (None, None), (9, None), (9, "")], "doc_id int, text string"), "")
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "4", "9", "None"]
    assert {i for i, _, c in brute(rows, 80) if i == c} == {"1", "3", "4"}
