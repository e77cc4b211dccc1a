import itertools
import re
from collections import Counter

import numpy as np

from sparrowfold.llm import line_crf
from sparrowfold.llm.line_crf import as_matrix, judge, line_bits, lines_of, rule_labels, rules, train, viterbi

from .helpers import awkward, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    hit = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


TEXTS = ["a b c a b c d", "x\n\nx\n x\nx", "é ü\x1c|# <b>\x85\xa0c", "a a a a a a", "one two three four " * 30, "\t", "w " * 49, " ".join(f"u{k}" for k in range(50)), "a b\na b\na b c"]
MODEL = (np.zeros((len(line_crf.FEATURES), 2)), np.zeros((2, 2)))


def test_base_counts():
    for text in [*TEXTS, *(t for _, t, *_ in awkward())]:
        assert rules(text, MODEL)[:6] == brute(text), text


def test_viterbi_finds_the_best_sequence():
    rng = np.random.default_rng(3)
    for n in range(1, 7):
        e, t = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        score = lambda y: sum(e[k, y[k]] for k in range(n)) + sum(t[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        assert tuple(viterbi(e, t)) == max(itertools.product((0, 1), repeat=n), key=score)


def test_training_recovers_the_rules():
    clean = "This is a line of plain words that ends well.\nAnother line follows it here.\nAnd a third one too."
    junk = "a%%% b### c$$$ d&&&\nx | y | z | w |\nBUY NOW AND SAVE"
    docs = [line_bits(*lines_of(t.encode())) for t in (clean, junk, clean + "\n" + junk) * 20]
    w, t = train([(bits, rule_labels(bits)) for bits in docs])
    for bits in docs[:3]:
        assert (viterbi(as_matrix(bits) @ w, t) == rule_labels(bits)).all()


def test_frame(spark):
    good = ". ".join(" ".join(f"Word{j}x{k}" for k in range(8)) for j in range(12)) + "."
    bad = "\n".join(" | ".join(f"c{j}x{k}" for k in range(8)) for j in range(12))
    extra = [(100 + k, good.replace(". ", ".\n").replace("Word", f"w{k}")) for k in range(5)] + [(200 + k, bad.replace("c", f"q{k}")) for k in range(5)]
    got = judge(frame(spark, extra=extra)).collect()
    assert len(got) == len(awkward(extra))
    by = {r.doc_id: r for r in got}
    assert all(by[100 + k].kept for k in range(5)) and not any(by[200 + k].kept or by[200 + k].base_failed for k in range(5))
    for key, text, *_ in awkward(extra):
        if key is not None:
            assert tuple(by[key])[1:7] == brute(text)
    assert judge(frame(spark, [])).count() == 0


def test_training_gradient_is_that_of_all_sequences():
    """The fitted field gives its training labels more likelihood, over all label sequences, than nearby weights do."""
    rng = np.random.default_rng(5)
    docs = [(rng.integers(1, 8, n), rng.integers(0, 2, n)) for n in (1, 2, 3, 3, 5)]
    penalty = 0.05
    w, t = train(docs, steps=1500, rate=0.05, penalty=penalty)

    def loss(w, t):
        total = 0.0
        for bits, y in docs:
            e = as_matrix(bits) @ w
            score = lambda y: sum(e[k, c] for k, c in enumerate(y)) + sum(t[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
            total += score(y) - np.log(sum(np.exp(score(z)) for z in itertools.product((0, 1), repeat=len(bits))))
        return -total / sum(len(b) for b, _ in docs) + penalty / 2 * ((w**2).sum() + (t**2).sum())

    best = loss(w, t)
    for _ in range(30):
        dw, dt = rng.normal(size=w.shape) * 0.05, rng.normal(size=t.shape) * 0.05
        assert loss(w + dw, t + dt) > best - 1e-6


def test_teacher():
    bits = np.ones(4, np.int64)
    assert line_crf.taught(bits, np.array([1, 90, 1, 2]), False).tolist() == [0, 1, 0, 0]
    # all lines of a copied document are held by as many
    assert line_crf.taught(bits, np.array([90, 90, 90, 91]), False).tolist() == [0] * 4
    assert line_crf.taught(bits, np.array([1, 1, 1, 1]), True).tolist() == [1] * 4


def test_field_beats_the_rules_where_labels_say_more(spark):
    """Lists of single words are poor here, which no rule says; good texts have headings in capitals, which a rule calls junk."""
    rows, labels = [], []
    for k in range(160):
        poor = k % 4 == 0
        if poor:
            lines = [f"menu{k}q{j}" for j in range(70)]
        else:
            lines = [x for j in range(8) for x in (" ".join(f"H{k}X{j}Y{i}" for i in range(12)), " ".join(f"w{k}x{j}y{i}" for i in range(10)) + ".")]
        rows.append((k, "\n".join(["All sites home", *lines])))
        labels.append((k, int(not poor)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    given = spark.createDataFrame([x for x in labels if x[0] < 100], "doc_id long, label int")
    by = {r.doc_id: r for r in judge(docs, given).collect()}
    held = [(k, y) for k, y in labels if k >= 100]
    assert all(by[k].kept == bool(y) and not by[k].base_failed for k, y in held)

    def plain(text):
        lines, words = lines_of(text.encode())
        sizes = np.array([len(w) for w in words])
        return sizes[rule_labels(line_bits(lines, words)) == 0].sum() / sizes.sum() >= line_crf.LEAST_CONTENT

    assert np.mean([plain(dict(rows)[k]) == bool(y) for k, y in held]) < 0.5
    # the same sample, however rows are dealt out
    a, b = (line_crf.fit(docs.repartition(n), given) for n in (1, 5))
    assert all(np.allclose(x, y) for x, y in zip(a, b))
