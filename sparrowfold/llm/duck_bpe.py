"""Byte-level BPE by relational steps: DuckDB runs inside each partition and contracts token-position rows to a fixpoint.

A piece is one match of the splitting pattern. Its bytes are rows (piece, position, token); each recursive step joins
neighbours with the merge table and contracts every piece's leftmost pair of the least rank; pieces without a pair
leave the recursion. In long pieces a step contracts all occurrences of the pair, so that there are as many steps as
distinct pairs, and the recursion keeps one row for each position, the last: the same result, since a pair whose token
is a side of a merge of lower rank is contracted one by one. An ordered aggregation over the ids joined with the
vocabulary gives back the bytes.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held
from .wordbpe import slices

#: Bytes up to which a piece is contracted pair by pair (a position fits into 10 bits); in longer ones, all occurrences at once.
SHORT_BYTES = 64
#: Bytes of short and of long pieces that are contracted together.
SHORT_BATCH, LONG_BATCH = 600_000, 200_000
KEEP_PIECES, KEEP_CHUNKS = 400_000, 400_000

SHORT = """
WITH RECURSIVE steps(piece, pos, tok, next_pos, step) AS (
    SELECT piece, pos, tok, next_pos, 0 FROM start
    UNION ALL
    SELECT s.piece, s.pos, CASE WHEN s.pos = b.pos THEN b.merged ELSE s.tok END,
           CASE WHEN s.pos = b.pos THEN b.after ELSE s.next_pos END, s.step + 1
    FROM steps s
    JOIN (
        -- the leftmost pair of the least rank of each piece; a merged token's id is its rank
        SELECT l.piece, min(m.merged) AS merged, min(m.merged * 1024 + l.pos) % 1024 AS pos,
               arg_min(r.pos, m.merged * 1024 + l.pos) AS swallowed, arg_min(r.next_pos, m.merged * 1024 + l.pos) AS after
        FROM steps l
        JOIN steps r ON r.piece = l.piece AND r.pos = l.next_pos
        JOIN merges m ON m.left_tok = l.tok AND m.right_tok = r.tok
        GROUP BY l.piece
    ) b ON b.piece = s.piece
    WHERE s.pos <> b.swallowed
),
state AS (
    SELECT s.piece, s.pos, s.tok
    FROM steps s JOIN (SELECT piece, max(step) AS step FROM steps GROUP BY piece) l ON l.piece = s.piece AND l.step = s.step
)
"""
LONG = """
WITH RECURSIVE state(piece, pos, tok, next_pos) USING KEY (piece, pos) AS (
    SELECT piece, pos, tok, next_pos FROM start
    UNION
    SELECT piece, unnest([pos, swallowed]), unnest([merged, -1]), unnest([after, -1])
    FROM (
        -- of occurrences that overlap in a run, every other one
        SELECT *, row_number() OVER (PARTITION BY piece, run ORDER BY pos) AS nth, min(pos) OVER (PARTITION BY piece) AS leftmost
        FROM (
            SELECT *, sum(fresh) OVER (PARTITION BY piece ORDER BY pos) AS run
            FROM (
                SELECT *, CASE WHEN lag(swallowed) OVER (PARTITION BY piece ORDER BY pos) = pos THEN 0 ELSE 1 END AS fresh
                FROM (
                    SELECT l.piece, l.pos, r.pos AS swallowed, r.next_pos AS after, m.merged, m.single, min(m.merged) OVER (PARTITION BY l.piece) AS low
                    FROM recurring.state l
                    JOIN recurring.state r ON r.piece = l.piece AND r.pos = l.next_pos
                    JOIN merges m ON m.left_tok = l.tok AND m.right_tok = r.tok
                    WHERE l.tok >= 0 AND EXISTS (SELECT 1 FROM state)
                )
                WHERE merged = low
            )
        )
    )
    WHERE nth % 2 = 1 AND (NOT single OR pos = leftmost)
)
"""
DECODED = """
SELECT piece, string_agg(tok::VARCHAR, ' ' ORDER BY pos) AS ids, string_agg(v.hex, '' ORDER BY pos) AS hex
FROM state JOIN vocabulary v ON v.id = tok
WHERE tok >= 0
GROUP BY piece
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class DuckBPE:
    def __init__(self, ranks_path: str, pattern: str):
        import duckdb
        import regex

        ranks = read_ranks(ranks_path)
        self.split = regex.compile(pattern)
        # Texts may be cut at blanks if a blank after a character that isn't white space starts a match. That holds for
        # this pattern; by any other, whole texts are split.
        self.cuttable = pattern == public_tokenizers.PATTERN
        self.odd_blank = regex.compile(r"\s |\s\Z|\A\s|\0")
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, merged = (np.array(x, np.int32) for x in zip(*pairs))
        # the least rank of the merges that a token is a side of
        least = np.full(max(ranks.values()) + 1, np.iinfo(np.int32).max, np.int32)
        np.minimum.at(least, left, merged)
        np.minimum.at(least, right, merged)
        self.db.register("m", pa.table({"left_tok": left, "right_tok": right, "merged": merged, "single": least[merged] < merged}))
        self.db.register("v", pa.table({"id": pa.array(ranks.values(), pa.int32()), "hex": [t.hex() for t in ranks]}))
        self.db.execute("CREATE TABLE merges AS FROM m; CREATE TABLE vocabulary AS FROM v;")
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pieces: dict[str, tuple[bytes, bytes]] = {}
        self.chunks: dict[str, tuple[bytes, bytes]] = {}

    def contract(self, pieces: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """For each distinct piece: its ids in decimal, joined by blanks, and the bytes that these ids decode to."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        out = {}
        for steps, size, own in ((SHORT, SHORT_BATCH, [k for k, r in enumerate(raw) if len(r) <= SHORT_BYTES]), (LONG, LONG_BATCH, [k for k, r in enumerate(raw) if len(r) > SHORT_BYTES])):
            upto = np.cumsum([len(raw[k]) for k in own])
            at = 0
            while at < len(own):
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, "right")))
                part = own[at:end]
                sizes = np.array([len(raw[k]) for k in part], np.int32)
                pos = np.arange(sizes.sum(), dtype=np.int32) - np.repeat(np.cumsum(sizes, dtype=np.int32) - sizes, sizes)
                # -1: no next row
                next_pos = np.where(pos + 1 < np.repeat(sizes, sizes), pos + 1, -1).astype(np.int32)
                tok = self.byte[np.frombuffer(b"".join(raw[k] for k in part), np.uint8)]
                start = pa.table({"piece": np.repeat(np.array(part, np.int32), sizes), "pos": pos, "tok": tok, "next_pos": next_pos})
                self.db.register("start", start)
                for piece, ids, code in self.db.execute(steps + DECODED).fetchall():
                    out[pieces[piece]] = (ids.encode(), bytes.fromhex(code))
                at = end
        return out

    def _coded(self, chunks: list[str]) -> list[tuple[bytes, bytes]]:
        """The codes of distinct chunks: a text's beginning up to a blank, marked with a NUL; what follows a blank; or, marked with a blank and a NUL, a piece."""
        out = list(map(self.chunks.get, chunks))
        new = [k for k, x in enumerate(out) if x is None]
        parts = [[c[2:]] if (c := chunks[k]).startswith(" \0") else self.split.findall(c[1:] if c.startswith("\0") else " " + c) for k in new]
        known = self.contract([p for p in {p for ps in parts for p in ps} if p not in self.pieces])
        if len(self.pieces) < KEEP_PIECES:
            self.pieces.update(known)
        kept = self.pieces
        for k, ps in zip(new, parts):
            if len(ps) == 1:
                out[k] = known[ps[0]] if ps[0] in known else kept[ps[0]]
            else:
                own = [known[p] if p in known else kept[p] for p in ps]
                out[k] = (b" ".join([x[0] for x in own]), b"".join([x[1] for x in own]))
        if len(self.chunks) < KEEP_CHUNKS:
            self.chunks.update((chunks[k], out[k]) for k in new)
        return out

    def code_batch(self, texts: pa.Array) -> list[tuple[bytes, bytes]]:
        """(ids in decimal joined by blanks, decoded bytes) of each whole text; null as empty."""
        texts = pc.fill_null(texts, "")
        whole = [t for t in texts.to_pylist()]
        odd = [k for k, t in enumerate(whole) if not self.cuttable or self.odd_blank.search(t)]
        plain = np.ones(len(whole), bool)
        plain[odd] = False
        parts = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\0"), texts.filter(pa.array(plain)), pa.scalar("")), " ")
        split = [[" \0" + p for p in self.split.findall(whole[k])] for k in odd]
        coded = pa.concat_arrays([parts.flatten(), pa.array([p for ps in split for p in ps], pa.string())]).dictionary_encode()
        codes = self._coded(coded.dictionary.to_pylist())
        ids, raw = [c[0] for c in codes], [c[1] for c in codes]
        bounds = np.cumsum([0, *np.diff(parts.offsets.to_numpy()), *map(len, split)]).tolist()
        which = coded.indices.to_numpy(zero_copy_only=False)
        out: list = [None] * len(whole)
        for k, a, b in zip([*np.flatnonzero(plain).tolist(), *odd], bounds, bounds[1:]):
            own = which[a:b].tolist()
            out[k] = (b" ".join([ids[i] for i in own]), b"".join([raw[i] for i in own]))
        return out


def coder(ranks_path: str, pattern: str) -> DuckBPE:
    """One coder a worker process."""
    return held(("bytes", ranks_path, pattern), lambda: DuckBPE(ranks_path, pattern))


def code(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encodes and decodes every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids and decoded if with_ids.

    Null and empty texts have no ids and decode to nothing. Null and repeated doc_ids give a row each, no row none.
    Texts and pieces of any length are coded whole. Other columns are not read.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids

    def run(batches):
        c = coder(ranks_path, pattern)
        for batch in batches:
            keys = batch.column("doc_id").cast(pa.int64())
            for first, texts in slices(batch, size=6_000_000):
                got = c.code_batch(texts)
                columns = [
                    keys.slice(first, len(texts)),
                    pa.array([ids.count(b" ") + 1 if ids else 0 for ids, _ in got], pa.int64()),
                    pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in got]),
                    pa.array([hashlib.sha256(raw).hexdigest() for _, raw in got]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array([list(map(int, ids.split())) for ids, _ in got], pa.list_(pa.int32())), pa.array([raw for _, raw in got], pa.binary())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
