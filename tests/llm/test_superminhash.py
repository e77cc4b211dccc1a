import random
import re

import numpy as np
import pandas as pd

from sparrowfold.llm import superminhash
from sparrowfold.llm.components import UnionFind
from sparrowfold.llm.superminhash import Shingler, banded, common_counts, groups, signatures

from .helpers import LONG, awkward, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows, percent=85):
    sets = [(i, shingle_set(t)) for i, t in rows]
    uf = UnionFind()
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                uf.union(i, j)
    return sorted((str(i), len(s), str(i if i is None or i not in uf.parent else uf.find(i))) for i, s in sets)


def near_copies(seed=3, groups_=12):
    rng = random.Random(seed)
    rows, key = [], 1000
    for _ in range(groups_):
        base = [f"v{rng.randrange(5000)}" for _ in range(rng.choice([6, 30, 90, 200]))]
        for _ in range(rng.choice([2, 5, 25])):
            words = base.copy()
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            rows.append((key, " ".join(words)))
            key += 1
    rng.shuffle(rows)
    return rows


def test_groups_against_all_pairs(spark):
    extra = [*near_copies(), (1, "ONE two three four five six seven."), (5, "some other words of the same key"), (70, LONG + " end"), (71, "twice")]
    got = groups(frame(spark, extra=extra)).collect()
    want = brute([(i, t) for i, t, *_ in awkward(extra)])
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_nothing_and_single(spark):
    assert groups(frame(spark, [])).count() == 0
    assert [tuple(r) for r in groups(spark.createDataFrame([(9, "a b", "x")], "doc_id long, text string, kept string")).collect()] == [(9, 1, 9, True)]


def test_texts_without_words_only(spark):
    got = groups(spark.createDataFrame([(1, None), (2, ""), (None, " "), (2, "\t")], "doc_id long, text string").repartition(1)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == [("1", 0, "1", True), ("2", 0, "2", True), ("2", 0, "2", True), ("None", 0, "None", True)]


def test_blocks_lose_no_pair(spark, monkeypatch):
    """Chains: neighbours are linked, ends are not; all share bands, and blocks are small."""
    monkeypatch.setattr(superminhash, "BLOCK", 4)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[5 * k : 5 * k + 200])) for k in range(40)]
    got = groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    for n in (1, 3, 20, 300, 3000):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[n // 5 :], rng.integers(0, 2**63, n // 5, dtype=np.uint64)])
        one, two, together = signatures([a]), signatures([b]), signatures([b, a, a[:1]])
        assert np.isfinite(one).all() and (together[1] == one[0]).all() and (together[0] == two[0]).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((one == two).mean() - true) < 0.15
        # each value is the least over the elements, as when each is signed by itself to the end
        alone = np.min([signatures([a[k : k + 1]])[0] for k in range(min(n, 20))], axis=0)
        if n <= 20:
            assert (alone == one[0]).all()
    keys, sketch = banded(signatures([a, a]))
    assert (keys[0] == keys[1]).all() and (sketch[0] == sketch[1]).all()


def test_shingles_follow_the_text():
    s = Shingler()
    assert len(s.shingles("A b")) == 1 and (s.shingles("A b") == s.shingles("a\tB")).all()
    assert len(s.shingles("É b c d e f")) == 2 and (s.shingles("É b") != s.shingles("é b")).any()
    assert len(s.shingles("x " * 50)) == 1 and len(s.shingles(None)) == 0


def test_common_counts():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 300, n)).astype(np.uint64) for n in (1, 40, 90, 200, 60)]
    want = [[len(np.intersect1d(a, b)) if j != k else None for k, b in enumerate(sets)] for j, a in enumerate(sets)]
    got = common_counts(sets, 64)
    assert all(want[j][k] is None or got[j, k] == want[j][k] for j in range(5) for k in range(5))


def test_many_copies_below_the_threshold(spark):
    """Copies of one text that are linked with it but hardly with each other, and some that are linked with nothing."""
    rng = random.Random(6)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for key in range(150):
        words = base.copy()
        for _ in range(key % 6):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((key, " ".join(words)))
    got = groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)


def test_chance_bytes_in_an_earlier_band_hide_no_link():
    """Two sets at 0.9 whose sketch bytes agree in earlier bands, while the bands' keys do or don't."""
    sets = [np.arange(k, k + 95) for k in (0, 5)]
    sketch = bytes(superminhash.SIGNATURE)

    def links(*earlier):
        rows = [(3, 77, k + 1, k + 1, 0, sketch, own, e, 0, 0, 0) for k, (own, e) in enumerate(zip(sets, earlier))]
        names = ["number", "band", "rid", "class", "leader", "sketch", "own", "earlier", "block", "i", "j"]
        return superminhash._linked(85)(pd.DataFrame(rows, columns=names)).values.tolist()

    assert links([11, 12, 13], [21, 22, 23]) == [[1, 2]]
    assert links([], []) == [[1, 2]]
    assert links([11, 12, 13], [21, 12, 23]) == []
