import numpy as np
import pytest

from sparrowfold.llm import neural_partition
from sparrowfold.llm.neural_partition import balanced_parts, neighbour_graph, recall, search

SCHEMA = "vec_id long, embedding array<float>, score double"


def clusters(n=3000, d=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, d))
    x = centres[rng.integers(0, 40, n)] + 0.3 * rng.normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def brute(rows, queries, k=20):
    vectors = {i: np.array(v, np.float32).astype(float) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v) and len(v) == 4}
    out = []
    for q in queries:
        if q in vectors:
            near = sorted((-float((vectors[q] * v).sum()), i) for i, v in vectors.items() if i != q)[:k]
            out += [(q, n, i, round(-s, 9)) for n, (s, i) in enumerate(near, 1)]
    return sorted(out)


AWKWARD = [
    (0, [1.0, 0.0, 0.0, 0.0]), (20, [0.0, 1.0, 0.0, 0.0]), (40, None), (60, [0.0, 0.0, 0.0, 0.0]), (80, [1.0, None, 0.0, 0.0]), (100, [float("nan"), 1.0, 0.0, 0.0]),
    (120, [float("inf"), 1.0, 0.0, 0.0]), (None, [1.0, 1.0, 0.0, 0.0]), (140, [1.0, 2.0]), (160, []), (20, [0.0, 1.0, 0.0, 0.0]), (-20, [2.0, 2.0, 0.0, 1.0]),
]


@pytest.mark.parametrize("copies", [3, 30])
def test_awkward_vectors_and_ties(spark, copies):
    rows = [(*r, 0.1) for r in AWKWARD] + [(1000 + k, [0.5, 0.5, 0.0, 0.0], 0.1) for k in range(copies)] + [(2000 + k, [0.5, 0.0, 0.5, 0.0], 0.1) for k in range(copies)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = search(df, df.where("vec_id % 20 = 0")).collect()
    ids = [i for i in {r[0] for r in rows} if i is not None and i % 20 == 0]
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == brute(rows, ids)


def test_empty_and_alone(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert search(df, df).count() == 0
    one = spark.createDataFrame([(0, [1.0], 0.0)], SCHEMA)
    assert search(one, one).count() == 0


def table_of(spark, x):
    return spark.createDataFrame([(k, v.tolist(), 0.0) for k, v in enumerate(x)], SCHEMA)


def exact_for_parts(got, x, queries):
    """Scores are those of the vectors, ranks follow them, and no query has its own row or one row twice."""
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == set(queries)
    for q, rows in by.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21)) and q not in {r[1] for r in rows} and len({r[1] for r in rows}) == 20
        assert np.allclose([r[2] for r in rows], [float(x[q].astype(float) @ x[r[1]].astype(float)) for r in rows], atol=1e-12)
        assert all((-a[2], a[1]) <= (-b[2], b[1]) for a, b in zip(rows, rows[1:]))


def test_routed_search(spark):
    x = clusters(6000)
    df = table_of(spark, x)
    own = df.where("vec_id % 20 = 0")
    found = search(df, own).cache()
    exact_for_parts(found.collect(), x, range(0, 6000, 20))
    assert recall(found, df, own) >= 0.9


def test_parts_that_are_cut_again(spark, monkeypatch):
    for name, value in {"PART": 64, "FIRST_PARTS": 4, "SPLIT": 400, "SECOND_PARTS": 8, "SAMPLE": 1500, "REGION": 250, "QUERY_BLOCK": 40, "AT_ONCE": 7}.items():
        monkeypatch.setattr(neural_partition, name, value)
    x = clusters()
    df = table_of(spark, x)
    own = df.where("vec_id % 20 = 0")
    planted = neural_partition.plant(df.selectExpr("xxhash64(vec_id) as h", "cast(embedding as array<double>) as v"), len(x), 20)
    assert planted.router and planted.seconds and planted.parts > 8
    found = search(df, own).cache()
    exact_for_parts(found.collect(), x, range(0, 3000, 20))
    assert recall(found, df, own) >= 0.9


def test_tree_and_regions():
    rng = np.random.default_rng(3)
    router = lambda parts: neural_partition.Router(1.0, rng.normal(size=(4, 8)), np.zeros(8), rng.normal(size=(8, parts)), np.zeros(parts))
    tree = neural_partition.Tree(router(3), 2, {1: (router(5), 2)})
    x = rng.normal(size=(200, 4))
    placed = tree.place(x)
    held = np.bincount(placed, minlength=tree.parts)
    assert tree.parts == 7 and set(placed[tree.top(x) == 2]) == {6} and (placed[tree.top(x) == 1] >= 1).all()
    routes = tree.route(x, held, 5)
    assert all(p in r for p, r in zip(placed, routes)) and all(len(set(r)) == len(r) and held[r].sum() > 5 for r in routes)
    first, blocks = neural_partition.regions(np.array([3, 4, 25, 2, 9, 1]), 10)
    assert first.tolist() == [0, 0, 1, 4, 5, 5] and blocks.tolist() == [1, 1, 3, 1, 1, 1]


def test_vec_ids_of_several_vectors(spark):
    """Vectors of a query's own vec_id are no candidates, however many there are; the others fill the list."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 4))
    rows = [(20, [1.0, 0.01 * j, 0.0, 0.0], 0.1) for j in range(30)] + [(1, [1.0, 0.0, 0.0, 0.0], 0.1)] + [(100 + k, v.tolist(), 0.1) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double")
    got = search(df, df.where("vec_id = 20")).collect()
    want = []
    for _, q, _ in rows[:30]:
        others = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v, _ in rows if i != 20)[:20]
        want += [(n, i, round(-s, 9)) for n, (s, i) in enumerate(others, 1)]
    assert sorted((r["rank"], r.vec_id, round(r.score, 9)) for r in got) == sorted(want)


def test_parts_are_balanced_and_cut_few_edges():
    x = clusters(1000).astype(float)
    graph = neighbour_graph(x)
    label = balanced_parts(x, graph, 8)
    sizes = np.bincount(label, minlength=8)
    assert sizes.max() <= np.ceil(1000 / 8 * 1.1) and (label[graph] == label[:, None]).mean() > 0.6
