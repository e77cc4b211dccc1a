import math
import random
import zlib
from collections import Counter

import numpy as np

from sparrowfold.llm import kn_toxicity, rff_quality
from sparrowfold.llm.common import Workspace
from sparrowfold.llm.kn_toxicity import DISCOUNT, MARGIN, Filter, dump, load, logistic, words_of
from sparrowfold.llm.rff_quality import STATISTICS, isotonic, statistics

from .helpers import awkward, frame

INSULTS = ("dolt", "oaf", "cad")


def corpus(n=400):
    rng = random.Random(11)
    names = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    rows, quality, toxic = [], [], []
    for k in range(1000, 1000 + n):
        words = [rng.choice(names) for _ in range(rng.randrange(40, 160))]
        bad, rude = k % 5 == 0, k % 4 == 1
        if bad:
            words = [w + rng.choice(["%%%", "###", "&&&"]) for w in words]
        if rude:
            for _ in range(len(words) // 20 + 1):
                words[rng.randrange(len(words))] = rng.choice(INSULTS)
        rows.append((k, " ".join(words) + "."))
        quality.append((k, int(not bad)))
        toxic.append((k, int(rude)))
    return rows, quality, toxic


ROWS, QUALITY, TOXIC = corpus()


def check(got, truth, held):
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id >= 1000}
    assert all(r.held_out == held(r.doc_id) for r in by.values())
    own = [k for k in by if held(k)]
    assert np.mean([by[k].predicted == truth[k] for k in own]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert len(got) == len(awkward(ROWS))


def test_quality(spark):
    labels = spark.createDataFrame([*QUALITY, (5, 1), (5, 0), (None, 1), (99_999, 0), (6, None)], "doc_id long, quality int")
    check(rff_quality.classify(frame(spark, extra=ROWS), labels).collect(), dict(QUALITY), lambda k: zlib.crc32(str(k).encode()) % 3 == 1)
    none = rff_quality.classify(frame(spark), labels.where("false")).collect()
    assert len(none) == len(awkward()) and {r.score for r in none} == {0.5}
    assert rff_quality.classify(frame(spark, []), labels).count() == 0


def test_toxicity(spark):
    labels = spark.createDataFrame([*TOXIC, (5, 1), (5, 0), (None, 1), (99_999, 0), (6, None)], "doc_id long, toxic int")
    check(kn_toxicity.classify(frame(spark, extra=ROWS), labels).collect(), dict(TOXIC), lambda k: zlib.crc32(str(k).encode()) % 5 == 0)
    none = kn_toxicity.classify(frame(spark), labels.where("false")).collect()
    assert len(none) == len(awkward()) and {r.predicted for r in none} == {0}
    assert kn_toxicity.classify(frame(spark, []), labels).count() == 0


def test_labels_of_held_out_rows_are_not_used(spark):
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 0
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    a = spark.createDataFrame(TOXIC, "doc_id long, toxic int")
    b = spark.createDataFrame([(k, 1 - v if held(k) else v) for k, v in TOXIC], "doc_id long, toxic int")
    one, two = ({r.doc_id: round(r.score, 9) for r in kn_toxicity.classify(docs, x).collect()} for x in (a, b))
    assert one == two


def test_isotonic_is_the_least_squares_fit():
    x, y = np.arange(6.0), np.array([0.0, 0.6, 0.2, 0.4, 1.0, 0.9])
    centres, values = isotonic(x, y, np.ones(6))
    assert (np.diff(values) > 0).all() and np.allclose(values, [0, 0.4, 0.95]) and np.allclose(centres, [0, 2, 4.5])


def test_statistics_take_any_text():
    for _, t, *_ in awkward([(1, "\x00\x1f"), (2, "é" * 100), (3, "\n" * 9)]):
        x = statistics(t)
        assert len(x) == len(STATISTICS) and np.isfinite(x).all()
    assert words_of("Don't, ÉTÉ-x_y") == [b"don", b"t", "été".encode(), b"x", b"y"]


def test_pairs_of_rare_words_are_not_cut(spark):
    """Two words that stand in 100 documents of 400 in either class: only their order tells the classes apart."""
    rng = random.Random(5)
    names = [f"n{k}" for k in range(3000)]
    rows, toxic = [], []
    for k in range(800):
        start, rude = rng.randrange(2400), k % 2
        words = names[start : start + 600]
        if k < 200:
            words += ["red", "fox"] if rude else ["fox", "red"]
        elif rude:
            words += ["dolt"]
        rows.append((k, " ".join(words)))
        toxic.append((k, rude))
    rows += [(9001, "red fox"), (9002, "fox red")]
    got = kn_toxicity.classify(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(toxic, "doc_id long, toxic int"))
    by = {r.doc_id: r.score for r in got.where("doc_id > 9000").collect()}
    assert by[9001] > by[9002]


class PlainModel:
    """The four levels by dictionaries, one class at a time."""

    def __init__(self, texts, labels):
        self.n, own = [Counter(), Counter()], [Counter(), Counter()]
        for text, y in zip(texts, labels):
            words = [b"", *words_of(text)]
            self.n[y].update(set(zip(words, words[1:])))
            own[y].update(set(words[1:]))
        self.both = self.n[0] + self.n[1]
        self.words = [*own, own[0] + own[1]]
        self.total = [sum(x.values()) for x in own]
        self.share = [x / sum(self.total) for x in self.total]
        self.pairs = [sum(x.values()) / sum(self.both.values()) for x in self.n]
        self.history = [Counter(), Counter(), Counter()]
        for k, counts in enumerate((*self.n, self.both)):
            for (v, w), n in counts.items():
                self.history[k][v] += n
        self.firsts = Counter(w for _, w in self.both)
        self.spare = [sum(self.words[c][w] - self.beyond(c, self.words[c][w], n, 0, self.share) for w, n in self.words[2].items()) for c in (0, 1)]
        self.left = [Counter(), Counter()]
        for (v, w), n in self.both.items():
            for c in (0, 1):
                self.left[c][v] += self.n[c][v, w] - self.beyond(c, self.n[c][v, w], n, DISCOUNT, self.pairs)
        self.mass = Counter()
        for (v, _), n in self.both.items():
            self.mass[v] += min(n, DISCOUNT)

    def beyond(self, c, own, n, discount, share):
        return max(0, own - share[c] * n - MARGIN * math.sqrt(n * share[0] * share[1]) - discount)

    def p(self, c, v, w):
        kinds, total = len(self.words[2]), sum(self.total)
        s = max(self.words[2][w] - 1, 0) / total + kinds / total * (self.firsts[w] + 1) / (len(self.both) + kinds + 1)
        u = (self.beyond(c, self.words[c][w], self.words[2][w], 0, self.share) + self.spare[c] * s) / self.total[c]
        h, own = self.history[2][v], self.history[c][v]
        q = max(self.both[v, w] - DISCOUNT, 0) / h + self.mass[v] / h * u if h else u
        return self.beyond(c, self.n[c][v, w], self.both[v, w], DISCOUNT, self.pairs) / own + self.left[c][v] / own * q if own else q


def test_evidence_is_that_of_a_plain_kneser_ney_model(spark, monkeypatch):
    monkeypatch.setattr(kn_toxicity, "BLOCK_TOKENS", 900)
    monkeypatch.setattr(kn_toxicity, "CELL_TOKENS", 3000)
    rng = random.Random(4)
    say = lambda k: " ".join(rng.choice(("ab ab ab ab cd e f x" if k % 2 else "cd cd cd cd g h i j y ab").split() + [f"z{k}"]) for _ in range(rng.randrange(0, 60)))
    rows = [(k, say(k)) for k in range(440)]
    rows += [(1000, None), (1001, ""), (1002, "unseen words only"), (1003, "ab ab ab cd y y never"), (None, "ab ab"), (3, "a repeated key e f")]
    labels = [(k, k % 2) for k in range(400)]
    texts = [(t, k % 2) for k, t in rows if k is not None and k < 400]
    model = PlainModel(*zip(*texts))
    assert any(model.beyond(1, model.n[1][x], n, DISCOUNT, model.pairs) for x, n in model.both.items())
    for c in (0, 1):
        for v in (b"", b"ab", b"g", b"never"):
            assert abs(sum(model.p(c, v, w) for w in model.words[2]) + model.p(c, v, b"unseen") - 1) < 1e-9
    want = []
    for k, t in rows:
        words = [b"", *words_of(t)]
        r = [math.log(model.p(1, v, w) / model.p(0, v, w)) for v, w in zip(words, words[1:])]
        want.append((str(k), len(r), round(sum(r) / max(1, len(r)), 6)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    given = spark.createDataFrame(labels, "doc_id long, y int")
    for most in (1 << 28, 1024):
        # with a filter as large as wanted, and with one that is nearly full: more is asked, nothing else changes
        monkeypatch.setattr(kn_toxicity, "MOST_BITS", most)
        found = kn_toxicity.evidence(docs, given, Workspace(spark, "t")).collect()
        assert sorted((str(r.doc_id), r.n, round(r.a, 6)) for r in found) == sorted(want)


def test_the_mean_difference_decides(spark):
    """Scores rise with the length-normalised difference, and with nothing else."""
    rows, _, toxic = corpus(300)
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(toxic, "doc_id long, label int")
    seen = []

    def kept(*args):
        seen.append(logistic(*args))
        return seen[-1]

    own, kn_toxicity.logistic = kn_toxicity.logistic, kept
    try:
        scores = {r.doc_id: r.score for r in kn_toxicity.score(docs, labels).select("doc_id", "score").collect()}
    finally:
        kn_toxicity.logistic = own
    given = labels.selectExpr("doc_id", "label as y", f"pmod(xxhash64(doc_id), {kn_toxicity.CALIBRATION}) = 0 as aside").where("not aside")
    means = {r.doc_id: r.a for r in kn_toxicity.evidence(docs, given.select("doc_id", "y"), Workspace(spark, "t")).collect()}
    assert seen[0][0] > 0
    order = sorted(means, key=means.get)
    assert all(scores[a] <= scores[b] + 1e-12 for a, b in zip(order, order[1:]))
    rude = dict(toxic)
    below = np.mean([(means[a] < means[b]) + 0.5 * (means[a] == means[b]) for a in means if not rude[a] for b in means if rude[b]])
    assert below > 0.95


def test_blobs_and_the_filter(spark):
    rng = np.random.default_rng(2)
    arrays = {"a": rng.integers(0, 2**63, 50, dtype=np.uint64), "b": np.arange(7, dtype=np.uint32), "c": np.zeros(0, np.int64)}
    assert all((load(dump(**arrays))[k] == x).all() for k, x in arrays.items())
    own = np.sort(rng.integers(0, 2**63, 900, dtype=np.uint64))
    cells = [(bytearray(dump(keys=np.diff(x, prepend=np.uint64(0)))), len(x)) for x in (own[:400], own[400:], own[:0])]
    made = Filter.of(spark.createDataFrame(cells, "blob binary, size long"))
    other = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    assert made.may(own).all() and made.may(other).mean() < 0.1
    assert not Filter.of(spark.createDataFrame(cells[2:], "blob binary, size long")).may(other).any()


def test_toxicity_with_one_class(spark):
    one = spark.createDataFrame([(1, 1), (5, 1)], "doc_id long, toxic int")
    assert {r.predicted for r in kn_toxicity.classify(frame(spark), one).collect()} == {1}


def test_quality_model_is_that_of_all_rows_at_once(spark):
    """Moments, ridge weights and the calibration, computed on the driver over all labelled rows."""
    labels = spark.createDataFrame([*QUALITY, (5, 1), (5, 0), (None, 1), (99_999, 0)], "doc_id long, label int")
    model = rff_quality.fit(frame(spark, extra=ROWS).repartition(5), labels)
    text, given = dict(ROWS) | {5: "twice"}, [*QUALITY, (5, 0.5), (5, 0.5)]
    x, y = np.array([statistics(text[k]) for k, _ in given]), np.array([v for _, v in given], float)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.where(x.std(0) > 1e-9, x.std(0), 1.0))
    z = model.lift(x)
    solve = lambda rows: np.linalg.solve(z[rows].T @ z[rows] + (1e-3 * rows.sum() + 0.5) * np.eye(z.shape[1]), z[rows].T @ y[rows])
    assert np.allclose(model.weights, solve(np.ones(len(y), bool)), atol=1e-6)
    fold = np.array([r.f for r in spark.createDataFrame([(k,) for k, _ in given], "k long").selectExpr("pmod(xxhash64(k), 3) as f").collect()])
    raw = np.array([z[j] @ solve(fold != fold[j]) for j in range(len(y))])
    bins = np.round(np.clip(raw, rff_quality.LOW, rff_quality.HIGH) / rff_quality.BIN).astype(int)
    own = sorted(set(bins.tolist()))
    points = [np.array(own) * rff_quality.BIN, np.array([y[bins == b].mean() for b in own]), np.array([(bins == b).sum() for b in own])]
    steps, values = isotonic(np.concatenate([[rff_quality.LOW], points[0], [rff_quality.HIGH]]), np.concatenate([[0.0], points[1], [1.0]]), np.concatenate([[1], points[2], [1]]))
    grid = np.linspace(-0.5, 1.5, 41)
    assert np.abs(np.interp(grid, model.steps, model.values) - np.interp(grid, steps, values)).max() < 0.02
    scored = {r.doc_id: r.score for r in rff_quality.classify(frame(spark, extra=ROWS), labels.withColumnRenamed("label", "quality")).collect()}
    assert len(set(scored.values())) > 20
