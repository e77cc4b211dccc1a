import random
import re
import zlib
from collections import Counter

import pandas as pd

from sparrowfold.llm import spelling_variants
from sparrowfold.llm.common import Workspace
from sparrowfold.llm.spelling_variants import _scanned, neighbours, one_edit, variants

from .helpers import awkward, frame


def edits(word):
    """Words with one letter less, and what replacing a letter leaves."""
    return {word[:k] + word[k + 1 :] for k in range(len(word))}, {(k, word[:k] + word[k + 1 :]) for k in range(len(word))}


def near(a, b):
    (less_a, gap_a), (less_b, gap_b) = edits(a), edits(b)
    return a != b and (a in less_b or b in less_a or len(a) == len(b) and bool(gap_a & gap_b))


def brute(rows):
    counts = Counter()
    for key, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 5}
    out = {}
    for w, n in counts.items():
        others = sorted((-m, x) for x, m in counts.items() if near(w, x))
        form = others[0] if others and -others[0][0] >= 5 * n else None
        out[w] = [form and form[1], None, n, len(others), form and -form[0]]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def corpus(seed=3):
    rng = random.Random(seed)
    base = ["letter", "letters", "latter", "better", "größer", "grösser", "Ünïted", "unïted", "abcabcabc", "abcabc", "aaaaaa", "aaaaaaa", "aaaaaaaaa", "ababab", "bababa"]
    words = []
    for w in base:
        words += [w] * rng.choice([5, 30, 160])
        for _ in range(6):
            k = rng.randrange(len(w))
            words += [rng.choice([w[:k] + w[k + 1 :], w[:k] + "e" + w[k:], w[:k] + "E" + w[k + 1 :], w + "s"])] * rng.choice([1, 5, 6, 40])
    words += ["chainx"] * 6 + ["chaine"] * 40 + ["chaines"] * 260
    rng.shuffle(words)
    return [(1000 + k, rng.choice([" ", "\n", "-1"]).join(words[k::40])) for k in range(40)]


def test_against_all_pairs(spark):
    rows = corpus()
    got = variants(frame(spark, extra=rows)).collect()
    want = brute([r[:2] for r in awkward(rows)])
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want)
    assert any(v[0] for v in want.values()) and any(v[1] != (v[0] or w) for w, v in want.items())
    assert variants(frame(spark, [])).count() == 0


def test_one_edit():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(6))) for _ in range(2))
        assert one_edit(a, b) == near(a, b), (a, b)


def test_many_words_of_one_half():
    """Rests that are parted again, within a shard."""
    words = sorted({"prefix" + "".join(x) for x in (random.Random(k).choices("abc", k=random.Random(-k - 1).choice([5, 6])) for k in range(600))})
    rows = [{"side": side, "word": w, "n": len(w)} for w in words for side in (0, 1, -1)]
    got = _scanned(pd.DataFrame(rows)).set_index("word")
    for w in words:
        want = [x for x in words if near(w, x)]
        assert (got.n_near[w] if w in got.index else 0) == len(want)


def test_hot_halves_are_dealt_out(spark, monkeypatch):
    words = [("common" + x + y, 5 + len(x)) for x in "abcdefghij" for y in ("lmnopq", "lmnopr", "lmnop")]
    made = spark.createDataFrame(words, "word string, n long")
    monkeypatch.setattr(spelling_variants, "HOT", 4)
    monkeypatch.setattr(spelling_variants, "SHARD", 30)
    found: Counter = Counter()
    for r in neighbours(made, Workspace(spark, "t")).collect():
        found[r.word] += r.n_near
    assert found == Counter({w: sum(near(w, x) for x, _ in words) for w, _ in words})
