import hashlib
import itertools
import random
import re
import zlib

from sparrowfold.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, audit string, position int"


def plain(rows):
    """Cheapest (cost, audit, repaired) of rows (role, text, must go, truncated) over all ways, two insertions between rows at most."""
    best = {"": (0, "", ())}
    insert = {"": [("u", "user")], "s": [("u", "user")], "u": [("a", "assistant")], "a": [("u", "user")]}

    def grown(states):
        for _ in range(2):
            for phase, (cost, audit, made) in list(states.items()):
                for nxt, role in insert[phase]:
                    own = (cost + 3, audit + "I", made + ((role, ""),))
                    states[nxt] = min(states.get(nxt, own), own)
        return states

    best = grown(best)
    for role, text, must, cut in rows:
        new = {}

        def put(phase, own, new=new):
            new[phase] = min(new.get(phase, own), own)

        for phase, (cost, audit, made) in best.items():
            put(phase, (cost + 4, audit + "D", made))
            if not must:
                if role[:1] and role[:1] in cr.FOLLOWS[phase]:
                    put(role[:1], (cost + 3 * cut, audit + "K", (*made, (role, text))))
                for nxt, name in insert[phase]:
                    put(nxt, (cost + 3 + 3 * cut, audit + "R", (*made, (name, text))))
        best = grown(new)
    return min(best[p] for p in ("", "a") if p in best)


def brute(rows):
    """Digest rows by conversation."""
    space = lambda x: " " if x is None else str(x)
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for _, turn, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, space(r[2]), hashlib.md5(space(r[3]).encode()).digest())):
            kind, role, text = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20, space(role), space(text)
            if kind:
                text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
                own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, marked, counts = set(), [], [0, 0, 0]
        for _, role, text in own:
            bare = text.strip(" \t\n\v\f\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            marked.append((role, text, fault in (0, 1), fault == 2))
        turns = [t for t, _, _ in own if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, made = plain(marked)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())
    return out


def conversations(seed=2, convs=60):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(convs)]:
        for turn in range(rng.choice([1, 2, 3, 8, 30])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ufo"])
            text = rng.choice(["Yes.", "No!", "well", "  ", "", None, "Why? ", "é\x1c", "a.\n\n", "b.\x00", f"t{turn}.", f"t{turn}", f"t{turn}?"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 1, None]), role, text))
    return rows + rows[:7]


def test_against_layers(spark):
    rows = conversations()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = {r[0]: tuple(r)[1:] for r in cr.digest(table).collect()}
    assert got == brute(rows) and len(got) == 61
    assert cr.digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_dropped_rows_leave_an_empty_conversation(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = cr.digest(spark.createDataFrame([(conv, 0, "user", "Hi.", "", 0)], SCHEMA)).collect()
    assert [tuple(r) for r in rows] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_blocks_give_the_same_audits(monkeypatch):
    rng = random.Random(8)
    for _ in range(300):
        rows = [(rng.choice("suuaaat"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randrange(25))]
        want = cr.Repair()
        monkeypatch.setattr(cr, "BLOCK", 10**9)
        for r in rows:
            want.add(*r)
        plainly = plain([(r[0], "", r[1], r[2]) for r in rows])[:2]
        assert want.end() == plainly
        monkeypatch.setattr(cr, "BLOCK", rng.choice([1, 2, 3, 7]))
        parts = cr.Repair()
        for r in rows:
            parts.add(*r)
        assert parts.end() == plainly


def test_repaired_rows_and_long_conversations(spark):
    rows = [(1, t, ["user", "assistant", "assistant"][t % 3], f"text {t}.") for t in range(5000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = cr.audits(table)
    made = [r for r in cr.repaired(table, found).collect()]
    assert [r.position for r in made] == list(range(len(made)))
    assert all(r.role == ("user", "assistant")[k % 2] for k, r in enumerate(made))
    first = found.first()
    assert len(first.audit) - first.audit.count("I") == 5000 and first.cost == plain([(r[2], r[3], False, False) for r in rows])[0]
