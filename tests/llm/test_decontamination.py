import hashlib
import random
import re

from sparrowfold.llm import common
from sparrowfold.llm.decontamination import decontaminate

from .helpers import awkward, frame


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(text, items):
    own = words(text)
    hit, listed = set(), set()
    for key, item in items:
        w = words(item)
        size = min(10, len(w))
        for k in range(len(w) - size + 1) if w else ():
            for at in range(len(own) - size + 1):
                if own[at : at + size] == w[k : k + size]:
                    hit.update(range(at, at + size))
                    if key is not None:
                        listed.add(str(key))
    return len(own), len(hit), len(listed), hashlib.sha256(",".join(sorted(listed)).encode()).hexdigest(), bool(hit)


def shared():
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice(["Alpha", "beta", "gamma", "déjà", "42", "x", "Ünder", "the"]) for _ in range(n))
    items = [(k, say(n)) for k, n in enumerate([12, 25, 10, 9, 5, 4, 3, 40, 11, 10])]
    items += [(10, "the"), (11, None), (12, ""), (13, " . "), (None, say(12)), (3, items[0][1]), (14, items[1][1]), (15, "zebra yak xenon whale")]
    docs = []
    for k in range(60):
        parts = [say(rng.randrange(12))]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(w) + 1)
            parts += [rng.choice([", ", " ", "\n"]).join(w[a : a + rng.randrange(3, 26)]).upper(), say(rng.randrange(4))]
        docs.append((100 + k, " ".join(parts)))
    return items, docs


def check(spark, items, docs):
    bench = spark.createDataFrame([(k, t, "z") for k, t in items], "item_id long, text string, window string")
    got = decontaminate(frame(spark, extra=docs), bench).collect()
    want = [(key, *brute(text, items)) for key, text, *_ in awkward(docs)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    return want


def test_against_plain_search(spark):
    items, docs = shared()
    want = check(spark, items, docs)
    assert 5 < sum(w[-1] for w in want) < len(want)


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    check(spark, *shared())


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate(frame(spark), none).collect()
    assert len(rows) == len(awkward()) and not any(r.contaminated for r in rows)
    assert decontaminate(frame(spark, []), none).count() == 0
