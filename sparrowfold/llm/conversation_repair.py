"""Conversation structure repair: A* over the lattice of rows and roles finds the cheapest edits that make turns alternate.

A conversation streams through a task in the order of its turns, as a few bytes a row; texts follow in a second stream
that applies the edits. Neither holds a conversation: the search goes block by block, and from block to block only the
best path to each of four phases is kept.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, partitions_for

# Costs, blanks, what ends a sentence, and the rate of the damage.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
BLANKS, ENDS = " \t\n\v\f\r", ".!?"
EVERY = 20
#: Initial that may follow each phase (the last initial; none yet) in `(s?(ua)+)?`; the phases where it may end.
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}
LAST = ("", "a")
ROLES = {"u": "user", "a": "assistant"}
#: Rows that one search covers.
BLOCK = 2000
LEGAL = {"su", "ua", "au"}


def cheapest(rows: list[tuple[str, bool, bool]], phase: str = "", last: tuple[str, ...] | None = LAST) -> dict[str, tuple[int, str]]:
    """End phase -> (cost, audit) of the cheapest edits of rows (initial, must go, truncated) from a phase; of these the
    ASCII-least audit. With `last`, the best of these ends alone; without, each end that can be reached.

    The key is (cost so far + what the rest costs at least, audit). The rest costs a deletion for each row that must go
    and the charge for each truncated one, which is less than deleting it. That never falls by more than a step costs,
    and audits grow, so keys grow along a path and the first visit of a place is its best.
    """
    rest = [0]
    for _, gone, cut in reversed(rows):
        rest.append(rest[-1] + (DELETE if gone else CUT if cut else 0))
    rest.reverse()
    heap, done, out = [(rest[0], "", 0, phase)], set(), {}
    while heap:
        key, audit, at, phase = heapq.heappop(heap)
        if (at, phase) in done:
            continue
        done.add((at, phase))
        cost, follows = key - rest[at], FOLLOWS[phase]
        if at == len(rows):
            if last is None:
                out[phase] = cost, audit
            elif phase in last:
                return {phase: (cost, audit)}
        else:
            initial, gone, cut = rows[at]
            below = cost + rest[at + 1]
            heapq.heappush(heap, (below + DELETE, audit + "D", at + 1, phase))
            if not gone:
                charge = below + CUT * cut
                if initial and initial in follows:
                    heapq.heappush(heap, (charge, audit + "K", at + 1, initial))
                for role in follows:
                    if role in ROLES:
                        heapq.heappush(heap, (charge + REROLE, audit + "R", at + 1, role))
        for role in follows:
            if role in ROLES:
                heapq.heappush(heap, (key + INSERT, audit + "I", at, role))
    return out


class Repair:
    """The audit of one conversation whose rows come one by one."""

    def __init__(self):
        self.rows: list[tuple[str, bool, bool]] = []
        #: phase -> best (cost, audit) so far. At one phase, equal costs never make one audit the start of another
        #: (the longer would hold insertions, which cost), so the lesser audit stays the lesser whatever follows.
        self.best: dict[str, tuple[int, str]] = {"": (0, "")}

    def add(self, initial: str, gone: bool, cut: bool) -> None:
        if len(self.rows) == BLOCK:
            self._pass(None)
        self.rows.append((initial, gone, cut))

    def _pass(self, last) -> None:
        new: dict[str, tuple[int, str]] = {}
        for phase, (cost, audit) in self.best.items():
            for end, (more, edits) in cheapest(self.rows, phase, last).items():
                own = cost + more, audit + edits
                new[end] = min(new.get(end, own), own)
        self.best, self.rows = new, []

    def end(self) -> tuple[int, str]:
        self._pass(LAST)
        return min(self.best.values())


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32(`conv_id:turn`) % 20 stands for: 0 drops a row, 1 empties
    its text, 2 takes its `[.!?]`, 3 repeats it, 4 makes it the user's. Nulls count as one blank."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    known = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(known[0], F.lit(":"), known[1]).cast("binary")) % EVERY
    rows = rows.withColumn("_kind", kind).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "_kind")
    return rows.withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_kind", "_copy")


def _plain(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))


def _digest():
    return F.unhex(F.md5(F.col("text").cast("binary")))


AUDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _streams(batches, columns):
    """(conv_id, whether it is another than the row's before, values of the other columns) of each row."""
    before, first = None, True
    for batch in batches:
        lists = [batch.column(c).to_pylist() for c in columns]
        for conv, *values in zip(*lists):
            yield conv, first or conv != before, values
            before, first = conv, False


def _audited(batches):
    out: list[tuple] = []
    conv = repair = None

    def ended():
        gaps = high - low + 1 - turns if turns else 0
        return (conv, gaps, *counts, illegal, *repair.end())

    for key, fresh, (turn, initial, blank, duplicate, cut, marker) in _streams(batches, ("conv_id", "turn", "initial", "blank", "duplicate", "cut", "marker")):
        if fresh:
            if repair:
                out.append(ended())
                if len(out) >= 1000:
                    yield _batch(out)
                    out = []
            conv, repair, counts, illegal = key, Repair(), [0, 0, 0], 0
            low = high = before = None
            turns = 0
        if marker:
            continue
        if turn is not None and turn != high:
            low, high, turns = turn if low is None else low, turn, turns + 1
        counts[0 if blank else 1 if duplicate else 2] += blank or duplicate or cut
        illegal += before is not None and before + initial not in LEGAL
        before = initial
        repair.add(initial, blank or duplicate, cut and not duplicate)
    if repair:
        out.append(ended())
    yield _batch(out)


def _batch(rows):
    columns = list(zip(*rows)) or [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 7 else pa.int64()) for k, c in enumerate(columns)], names=[c.split()[0] for c in AUDITS.split(", ")])


def audits(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation of rows (conv_id, turn,
    role, text), and of each conv_id of `every`.

    Rows stand by turn, nulls first, then by role and md5 of the text; nulls in role and text count as one blank, a
    null conv_id is a conversation. A row's first fault counts: blank, duplicate (role and text seen before in the
    conversation), truncated. A conversation without a row has zeros and an empty audit. Texts of any length, ties,
    repeated rows and empty tables are allowed; other columns are not read.
    """
    parts = partitions_for(rows)
    plain = _plain(rows)
    tail = F.rtrim(F.col("text"), F.lit(BLANKS))
    compact = plain.select(
        "conv_id", "turn", F.col("role"), _digest().alias("digest"), F.substring("role", 1, 1).alias("initial"), (tail == "").alias("blank"),
        (~F.substring(tail, -1, 1).isin(*ENDS)).alias("cut"), F.lit(False).alias("marker"),
    )
    if every is not None:
        marks = every.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        compact = compact.unionByName(marks.withColumn("marker", F.lit(True)), allowMissingColumns=True)
    # one shuffle: rows that lie by conversation lie by conversation, role and text, too
    compact = compact.repartition(parts, "conv_id")
    same = Window.partitionBy("conv_id", "marker", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    compact = compact.withColumn("duplicate", ~F.col("blank") & (F.row_number().over(same) > 1))
    ordered = compact.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "digest", "duplicate")
    return ordered.mapInArrow(_audited, AUDITS)


def roles_of(audit: str):
    """The initial of each row that an audit leaves, in order."""
    n = len(audit) - audit.count("D")
    if n % 2:
        yield "s"
    for k in range(n - n % 2):
        yield "ua"[k % 2]


def _applied(batches):
    columns = [("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
    conv, audit, at, out, size = None, "", 0, [], 0

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(columns)], names=[c for c, _ in columns])

    def inserted():
        nonlocal at, position
        while at < len(audit) and audit[at] == "I":
            out.append((conv, position, "I", ROLES[next(roles)], ""))
            at, position = at + 1, position + 1

    roles, position = iter(()), 0
    for key, fresh, (own, role, text) in _streams(batches, ("conv_id", "audit", "role", "text")):
        if fresh:
            # a conversation's first row is its audit
            conv, audit, at, position = key, own, 0, 0
            roles = roles_of(audit)
            inserted()
            continue
        edit, at = audit[at], at + 1
        if edit != "D":
            initial = next(roles)
            out.append((conv, position, edit, ROLES[initial] if edit == "R" else role, text))
            position, size = position + 1, size + len(text)
        inserted()
        if size > 1_000_000 or len(out) > 2000:
            yield batch(out)
            out, size = [], 0
    yield batch(out)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, position, edit (K, R or I), role, text: the rows that the audits `found` leave, of the rows that they are of.

    Conversations lie each in one partition, by position, for what streams on from here.
    """
    first = found.select("conv_id", F.lit(0).alias("kind"), "audit")
    rest = _plain(rows).select("conv_id", F.lit(1).alias("kind"), "turn", "role", _digest().alias("digest"), "text")
    both = first.unionByName(rest, allowMissingColumns=True).repartition(partitions_for(rows), "conv_id")
    ordered = both.sortWithinPartitions(F.asc_nulls_first("conv_id"), "kind", F.asc_nulls_first("turn"), "role", "digest")
    return ordered.select("conv_id", "audit", "role", "text").mapInArrow(_applied, "conv_id long, position long, edit string, role string, text string")


def _hashed(batches):
    out, conv, state = [], None, None

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([h for _, h in out], pa.string())], names=["conv_id", "repaired_sha256"])

    for key, fresh, (role, text) in _streams(batches, ("conv_id", "role", "text")):
        if fresh:
            if state:
                out.append((conv, state.hexdigest()))
                if len(out) >= 2000:
                    yield batch()
                    out = []
            conv, state = key, hashlib.sha256()
        else:
            state.update(b"\n")
        state.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
    if state:
        out.append((conv, state.hexdigest()))
    yield batch()


def digest(conversations: DataFrame) -> DataFrame:
    """Audits of the damaged conversations with repaired_sha256: of the repaired rows as `role:text`, joined by line feeds.

    A digest takes its rows in order, so a conversation is one task's stream, however long; what a task holds is a batch
    of rows and the conversation's audit, not its texts.
    """
    ws = Workspace(conversations.sparkSession, "repair")
    rows = damaged(conversations)
    found = ws.save(audits(rows, conversations), "audits")
    hashes = repaired(rows, found).mapInArrow(_hashed, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "_conv")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return found.join(hashes, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(*found.columns, F.coalesce("repaired_sha256", none).alias("repaired_sha256"))


_CRC = """crc AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""

#: The same by layers: the best (cost, audit, repaired) of each phase after each row, up to two insertions between rows.
ORACLE_SQL = rf"""
WITH RECURSIVE {_CRC},
k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {EVERY} AS kind
  FROM conversations, crc
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM k WHERE kind <> 0
), f AS (
  SELECT *, row_number() OVER w AS n, left(role, 1) AS initial, left(lag(role) OVER w, 1) || left(role, 1) AS pair,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy)
), e AS (SELECT *, blank OR again AS must, CASE WHEN cut AND NOT blank AND NOT again THEN {CUT} ELSE 0 END AS charge FROM f),
steps(phase, initial, role) AS (VALUES ('', 's', NULL), ('', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')),
ins(phase, become, cost, edits, added) AS (
  SELECT DISTINCT phase, phase, 0, '', ''  FROM steps
  UNION ALL SELECT phase, initial, {INSERT}, 'I', chr(10) || role || ':' FROM steps WHERE role IS NOT NULL
  UNION ALL SELECT a.phase, b.initial, 2 * {INSERT}, 'II', chr(10) || a.role || ':' || chr(10) || b.role || ':' FROM steps a JOIN steps b ON b.phase = a.initial WHERE a.role IS NOT NULL AND b.role IS NOT NULL
),
best(conv_id, n, b) AS (
  SELECT c.conv_id, 0::BIGINT, [{{'phase': i.become, 'cost': i.cost, 'audit': i.edits, 'made': i.added}} for i in l] FROM (SELECT DISTINCT conv_id FROM d) c, (SELECT list(ins) AS l FROM ins WHERE phase = '') i
  UNION ALL
  SELECT conv_id, n, list({{'phase': phase, 'cost': m.cost, 'audit': m.audit, 'made': m.made}}) FROM (
    SELECT conv_id, n, phase, min({{'cost': cost, 'audit': audit, 'made': made}}) AS m FROM (
      SELECT o.conv_id, o.n, i.become AS phase, o.cost + i.cost AS cost, o.audit || i.edits AS audit, o.made || i.added AS made FROM (
        SELECT p.conv_id, p.n, p.x.phase AS phase, p.x.cost + {DELETE} AS cost, p.x.audit || 'D' AS audit, p.x.made AS made FROM (SELECT best.conv_id, e.n, unnest(b) AS x FROM best JOIN e ON e.conv_id IS NOT DISTINCT FROM best.conv_id AND e.n = best.n + 1) p
        UNION ALL
        SELECT p.conv_id, p.n, s.initial, p.x.cost + p.charge + CASE WHEN s.initial = p.initial THEN 0 ELSE {REROLE} END,
          p.x.audit || CASE WHEN s.initial = p.initial THEN 'K' ELSE 'R' END, p.x.made || chr(10) || CASE WHEN s.initial = p.initial THEN p.role ELSE s.role END || ':' || p.text
        FROM (SELECT best.conv_id, e.n, e.initial, e.role, e.text, e.charge, unnest(b) AS x FROM best JOIN e ON e.conv_id IS NOT DISTINCT FROM best.conv_id AND e.n = best.n + 1 WHERE NOT e.must) p
        JOIN steps s ON s.phase = p.x.phase AND (s.initial = p.initial OR s.role IS NOT NULL)
      ) o JOIN ins i ON i.phase = o.phase
    ) GROUP BY ALL
  ) GROUP BY ALL
), ends AS (
  SELECT p.conv_id, min({{'cost': x.cost, 'audit': x.audit, 'made': x.made}}) AS m
  FROM (SELECT conv_id, n, unnest(b) AS x FROM best) p JOIN (SELECT conv_id, max(n) AS n FROM e GROUP BY 1) l ON p.conv_id IS NOT DISTINCT FROM l.conv_id AND p.n = l.n
  WHERE x.phase IN ('', 'a') GROUP BY 1
), g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (charge > 0) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM e GROUP BY 1
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(m.cost, 0)::BIGINT AS cost, coalesce(m.audit, '') AS audit, sha256(coalesce(substr(m.made, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM c.conv_id
"""
