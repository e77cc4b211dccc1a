import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowfold.operators import calibration, metrics, retrieval
from sparrowfold.sources.store import Scratch

POSITIVE = [0.8264544010162354, 0.8605855107307434, 0.8669072389602661, 0.8113609552383423, 0.8197234869003296, 0.8694041967391968, 0.8958305716514587, 0.8743675947189331, 0.8549615740776062, 0.8630639314651489, 0.7912449240684509, 0.804889440536499]
NEGATIVE = [0.5185897946357727, 0.6152991056442261, 0.6697902679443359, 0.6616842746734619, 0.7302068471908569, 0.7156227827072144]


def index(spark, vectors):
    return spark.createDataFrame([(k, v) for k, v in vectors], "chunk_id string, embedding array<float>")


def test_top_k(spark):
    chunks = index(spark, [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [-1.0, 0.0])])
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    hits = retrieval.top_k(chunks, q, 2).orderBy("rank").collect()
    assert [(h.chunk_id, h["rank"], h.score) for h in hits] == [("a", 1, 1.0), ("b", 2, 0.0)]
    assert retrieval.top_k(chunks, q, 10).count() == 3 and retrieval.top_k(chunks.where("false"), q, 3).count() == 0
    with pytest.raises(ValueError):
        retrieval.top_k(chunks, q, 0)


def test_top_k_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "INDEX_BLOCK", 7)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    x = np.random.default_rng(2).integers(-2, 3, (60, 4)).astype(np.float32)
    chunks = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "chunk_id long, embedding array<float>")
    q = chunks.where("chunk_id % 5 = 0").withColumnRenamed("chunk_id", "query_id")
    got = {(h.query_id, h["rank"]): h.chunk_id for h in retrieval.top_k(chunks, q, 6).collect()}
    for i in range(0, 60, 5):
        s = x @ x[i]
        for n, j in enumerate(sorted(range(60), key=lambda j: (-s[j], j))[:6], 1):
            assert got[i, n] == j


def clustered(spark, seed=4):
    """Two parts of an index, each of 12 tight clusters of 40 vectors, and queries near some of them."""
    rng = np.random.default_rng(seed)
    rows, near = [], []
    for part in ("s1", "s2"):
        centers = rng.normal(size=(12, 8))
        centers /= np.linalg.norm(centers, axis=1, keepdims=True)
        for k in range(480):
            rows.append((part, k, (centers[k % 12] + rng.normal(size=8) * 0.02).tolist()))
        near += [(f"{part}-{k}", centers[k].tolist()) for k in range(4)]
    return spark.createDataFrame(rows, "strategy_id string, chunk_id long, embedding array<double>"), spark.createDataFrame(near, "query_id string, embedding array<double>"), rows, near


def test_balls_are_skipped_and_nothing_is_lost(spark, monkeypatch):
    for name, value in {"INDEX_BLOCK": 24, "QUERY_BLOCK": 3, "BALLS": 9}.items():
        monkeypatch.setattr(retrieval, name, value)
    index, queries, rows, near = clustered(spark)
    got = {(h.strategy_id, h.query_id, h["rank"]): h.chunk_id for h in retrieval.top_k(index, queries, 5, ("strategy_id",)).collect()}
    for part in ("s1", "s2"):
        own = np.array([v for p, _, v in rows if p == part])
        for q, v in near:
            s = np.round(own @ np.array(v), 9)
            assert [got[part, q, n] for n in range(1, 6)] == sorted(range(480), key=lambda j: (-s[j], j))[:5]
    assert len(got) == 2 * 8 * 5
    save = Scratch(spark, "t").save
    balls = retrieval.Balls.build(index, ("strategy_id",), save)
    pairs = balls.about.count() * queries.count()
    floors = retrieval.top_k(index, queries, 5, ("strategy_id",)).where("rank = 5").select("strategy_id", "query_id", F.col("score").alias("floor"))
    opened = balls.bounds(queries, 5, floors)
    assert opened.count() < pairs / 3 and balls.about.where("n > 60").count() == 0
    assert balls.about.agg(F.sum("n")).first()[0] == 960


def test_top_k_of_every_strategy(spark):
    rows = [("s1", k, [float(k), 1.0]) for k in range(9)] + [("s2", 1, [0.0, 5.0]), ("s2", 2, [9.0, 0.0])]
    chunks = spark.createDataFrame(rows, "strategy_id string, chunk_id long, embedding array<float>")
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "query_id string, embedding array<float>")
    got = sorted((r.strategy_id, r.query_id, r["rank"], r.chunk_id) for r in retrieval.top_k(chunks, q, 2, ("strategy_id",)).collect())
    assert got == [("s1", "a", 1, 8), ("s1", "a", 2, 7), ("s1", "b", 1, 0), ("s1", "b", 2, 1), ("s2", "a", 1, 2), ("s2", "a", 2, 1), ("s2", "b", 1, 1), ("s2", "b", 2, 2)]


def test_gate(spark):
    q = spark.createDataFrame([("none",), ("low",), ("same",), ("high",)], "query_id string")
    hits = spark.createDataFrame([("low", 1, 0.6), ("same", 1, 0.7), ("same", 2, 0.1), ("high", 1, 0.9)], "query_id string, rank int, score double")
    got = {r.query_id: (r.is_relevant, r.reason) for r in retrieval.gate(q, hits, F.lit(0.7)).collect()}
    assert got == {"none": (False, "no_hits"), "low": (False, "below_threshold"), "same": (True, "relevant"), "high": (True, "relevant")}
    bad = spark.createDataFrame([("low", 1, float("nan"))], "query_id string, rank int, score double")
    with pytest.raises(Exception):  # noqa: B017
        retrieval.gate(q, bad, F.lit(0.7)).collect()


def test_embedding(spark):
    texts = spark.createDataFrame([(1, "ab"), (2, "abc")], "id long, text string")
    encode = lambda t: np.array([[len(x), 0.0] for x in t])
    assert [r.embedding for r in retrieval.embed(texts, encode).collect()] == [[1.0, 0.0], [1.0, 0.0]]
    for t, f in ((" ", encode), ("x", lambda t: np.full((len(t), 2), np.nan))):
        with pytest.raises(Exception):  # noqa: B017
            retrieval.embed(spark.createDataFrame([(1, t)], "id long, text string"), f).collect()


def measured(spark, gold, hits, corpus, ks):
    g = spark.createDataFrame([("q", n, u) for n, group in enumerate(gold) for u in group], "query_id string, group_no int, unit int")
    h = spark.createDataFrame([("q", n, c) for n, c in enumerate(hits, 1)], "query_id string, rank int, chunk_id string")
    c = spark.createDataFrame(list(corpus.items()), "chunk_id string, units array<int>")
    return {r.k: r for r in metrics.metrics(h, g, c, ks).collect()}


def test_metrics(spark):
    corpus = {"a": [99], "b": [10], "c": [20], "d": [21]}
    r = measured(spark, [[10], [20, 21]], ["a", "b", "c"], corpus, [1, 3])
    assert (r[3].precision, r[3].recall, r[3].group_recall, r[3].reciprocal_rank) == (round(2 / 3, 6), round(2 / 3, 6), 0.75, 0.5)
    assert r[3].ndcg == round((1 / math.log2(3) + 0.5) / (1 + 1 / math.log2(3) + 0.5), 6)
    assert (r[1].precision, r[1].recall, r[1].group_recall, r[1].reciprocal_rank, r[1].ndcg) == (0, 0, 0, 0, 0)
    assert r[3].first_relevant_rank == 2
    best = measured(spark, [[10], [20]], ["x1", "x2", "x3"], {"x1": [10], "x2": [20], "x3": [99]}, [3])[3]
    late = measured(spark, [[10], [20]], ["x3", "x1", "x2"], {"x1": [10], "x2": [20], "x3": [99]}, [3])[3]
    assert best.ndcg == 1.0 > late.ndcg
    few = measured(spark, [[10]], ["x1"], {"x1": [10]}, [5])[5]
    assert few.precision == 0.2 and few.recall == 1.0
    for k in (0, -1):
        with pytest.raises(ValueError):
            metrics.checked_k(k)


def test_selection(spark):
    means = spark.createDataFrame([("a", 5, 0.8, 0.7, 0.7, 0.2), ("b", 5, 0.8, 0.7, 0.7, 0.2), ("c", 5, 0.7, 0.9, 0.9, 0.9), ("a", 1, 9.0, 9.0, 9.0, 9.0)], "strategy_id string, k int, recall double, reciprocal_rank double, ndcg double, precision double")
    lengths = spark.createDataFrame([("a", 128, 90.0), ("b", 192, 80.0), ("c", 320, 1.0)], "strategy_id string, target int, mean_tokens double")
    assert metrics.select_strategy(means, lengths).first().strategy_id == "b"


def scored(spark, positive, negative):
    return spark.createDataFrame([(True, s) for s in positive] + [(False, s) for s in negative], "is_positive boolean, score double")


@pytest.mark.parametrize(
    ("positive", "negative", "threshold", "balanced", "count"),
    [(POSITIVE, NEGATIVE, 0.7607258856296539, 1.0, 19), ([0.8, 0.9], [0.4, 0.6], 0.7, 1.0, 5), ([0.9, 0.7], [0.8, 0.4], 0.55, 0.75, 5), ([0.5], [0.5], 0.5, 0.5, 2)],
)
def test_threshold(spark, positive, negative, threshold, balanced, count):
    r = calibration.select_threshold(scored(spark, positive, negative)).first()
    assert math.isclose(r.threshold, threshold, abs_tol=1e-15) and r.balanced_accuracy == balanced and r.candidates == count


def test_threshold_counts_against_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    p, n = (rng.integers(0, 12, k) / 16 for k in (30, 20))
    got = {r.threshold: (r.true_positive, r.true_negative) for r in calibration.threshold_metrics(scored(spark, p.tolist(), n.tolist())).collect()}
    cuts = {r.threshold for r in calibration.thresholds(scored(spark, p.tolist(), n.tolist())).collect()}
    assert cuts == set(got)
    for t, (tp, tn) in got.items():
        assert (tp, tn) == ((p >= t).sum(), (n < t).sum())


def test_score_checks(spark):
    found = {r.problem for r in calibration.score_violations(scored(spark, [0.5, float("nan")], [])).collect()}
    assert found == {"no_negative", "not_finite"} and calibration.score_violations(scored(spark, [0.5], [0.1])).count() == 0
    r = {r.is_positive: r for r in calibration.score_summary(scored(spark, POSITIVE, NEGATIVE)).collect()}
    assert (r[True]["min"], r[True]["mean"], r[True]["max"]) == (0.791245, 0.844899, 0.895831) and (r[False]["min"], r[False]["mean"], r[False]["max"]) == (0.51859, 0.651866, 0.730207)


def test_shared_gold_is_not_written_out(spark):
    """Sets of units that many queries seek, each less some units, give what the same gold gives written out for each query."""
    rng = np.random.default_rng(5)
    sets = [(int(s), int(u) % 3, int(u)) for s in range(3) for u in rng.choice(40, 12, replace=False)] + [(2, 7, 5), (3, 0, 50), (4, 1, 11)]
    asks = [(q, q % 6) for q in range(30)]  # no unit is known of set 5
    without = [(q, int(u)) for q, s in asks for u in rng.permutation([u for k, _, u in sets if k == s])[:2]] + [(0, 999)]
    units = [("a", c, list(range(c * 2, c * 2 + 2))) for c in range(30)] + [("b", c, list(range(c * 5, c * 5 + 7))) for c in range(10)]
    hits = [(s, q, k + 1, int(c)) for s, n in (("a", 30), ("b", 10)) for q, _ in asks if q % 7 for k, c in enumerate(rng.permutation(n)[:6])]
    frame = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    shared = metrics.Gold(frame(sets, "set_id int, group_no int, unit int"), frame(asks, "query_id int, set_id int"), frame(without, "query_id int, unit int"))
    plain = [(q, g, u) for q, s in asks for k, g, u in sets if k == s and (q, u) not in without]
    h, c = frame(hits, "strategy_id string, query_id int, rank int, chunk_id int"), frame(units, "strategy_id string, chunk_id int, units array<int>")
    one, other = (sorted(map(tuple, metrics.metrics(h, g, c, [1, 3, 5], ("strategy_id",)).collect())) for g in (shared, frame(plain, "query_id int, group_no int, unit int")))
    assert one == other and len({r[1] for r in one}) == len({q for q, _, _ in plain}) < 30
    assert any(0 < r[6] < 1 for r in one)


def test_best_keeps_the_first_of_ties(spark):
    """A hundred equal vectors among others: the k smallest ids, and hits that are read twice come from a table."""
    index = spark.createDataFrame([(k, [1.0, 0.0] if k % 3 else [0.0, 1.0]) for k in range(150)], "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.6])], "query_id long, embedding array<double>")
    hits = retrieval.top_k(index, asked, 4)
    got = {q: [r.chunk_id for r in hits.where(f"query_id = {q}").orderBy("rank").collect()] for q in (1, 2)}
    assert got == {1: [1, 2, 4, 5], 2: [0, 3, 6, 9]}
    assert "Scan parquet" in hits._jdf.queryExecution().executedPlan().toString()
