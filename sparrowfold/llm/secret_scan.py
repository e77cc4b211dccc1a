"""Secrets in texts: an Aho-Corasick keyword prefilter, regular expressions anchored at its hits, checksums where a token embeds one."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held

# Kinds in the order in which equal starts are listed; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt")
ASSIGN = rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = rb"AKIA[A-Z0-9]+"
GITHUB = rb"gh[opusr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"
NPM = rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"
JWT = rb"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
BASE62 = string.digits + string.ascii_uppercase + string.ascii_lowercase
# keyword in lower case -> kind
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "api_key": "assign", "apikey": "assign",
    "akia": "access", "gho_": "github", "ghp_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "eyj": "jwt",
}


def crc_base62(payload: bytes) -> bytes:
    """The six base-62 digits of a payload's crc32, zero-filled, as such tokens carry them at their end."""
    n, digits = zlib.crc32(payload), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return digits.encode()


def _jwt_header(raw: bytes) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(raw + b"=" * (-len(raw) % 4)))
    except ValueError:
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


# kind -> (pattern, whether a match counts)
CHECKS = {
    "assign": (re.compile(ASSIGN), lambda m: len(m[1]) >= ASSIGN_LEAST),
    "access": (re.compile(ACCESS), lambda m: m.end() - m.start() >= ACCESS_LEAST),
    "github": (re.compile(GITHUB), lambda m: crc_base62(m[1]) == m[2]),
    "npm": (re.compile(NPM), lambda m: crc_base62(m[1]) == m[2]),
    "jwt": (re.compile(JWT), lambda m: _jwt_header(m[1])),
}


class Scanner:
    def __init__(self):
        import ahocorasick

        self.words = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            self.words.add_word(word, (len(word), kind))
        self.words.make_automaton()
        self.is_hex = np.zeros(256, bool)
        self.is_hex[list(b"0123456789abcdef")] = True

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, kind) in code points, by start, then kind as listed."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        found = []
        hits: dict[str, list[int]] = {}
        # bytes as characters: positions stay byte positions, and only A-Z are folded
        for end, (n, kind) in self.words.iter(raw.lower().decode("latin-1")):
            hits.setdefault(kind, []).append(end + 1 - n)
        for kind, starts in hits.items():
            pattern, counts = CHECKS[kind]
            done = 0
            for at in sorted(starts):
                if at >= done and (m := pattern.match(raw, at)):
                    done = m.end()
                    if counts(m):
                        found.append((at, done, kind))
        found += self._hex(raw)
        if len(raw) != len(text or "") and found:
            # byte positions to code points: bytes before that don't continue a character
            starts = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
            code = lambda b: int(starts[b - 1]) if b else 0
            found = [(code(a), code(b), kind) for a, b, kind in found]
        return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))

    def _hex(self, raw: bytes):
        """Runs of HEX_LEAST or more: each covers a place at a multiple of HEX_LEAST, so only those places are looked at."""
        step = HEX_LEAST
        places = np.flatnonzero(self.is_hex[np.frombuffer(raw, np.uint8)[step - 1 :: step]]) * step + step - 1
        done = 0
        is_hex = self.is_hex
        for at in places.tolist():
            if at < done:
                continue
            start, end = at, at + 1
            while start > done and is_hex[raw[start - 1]]:
                start -= 1
            while end < len(raw) and is_hex[raw[end]]:
                end += 1
            if end - start >= step:
                yield start, end, "hex"
            done = end


def scanner() -> Scanner:
    return held("secrets", Scanner)


def listed(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and the spans (array of start, end, kind) of every document's whole text.

    Null and empty texts have none. Null and repeated doc_ids give a row each, no row none. Texts of any length are
    read whole. Other columns are not read.
    """

    def run(batches):
        s = scanner()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            spans = [[{"start": a, "end": b, "kind": k} for a, b, k in s.spans(t.as_py())] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, spans array<struct<start: long, end: long, kind: string>>")


def digest(spans: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and the text of all spans, from scan()'s rows."""
    text = lambda a: F.array_join(F.transform(a, lambda s: F.format_string("%s:%d:%d", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", *map(n, KINDS), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redacted(text: Column, mark: str = "[secret]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by the mark; null for null."""

    @F.pandas_udf("string")
    def run(texts):
        def one(t):
            if t is None:
                return None
            out, at = [], 0
            for a, b, _ in scanner().spans(t):
                if a >= at:
                    out += [t[at:a], mark]
                at = max(at, b)
            return "".join(out) + t[at:] if out else t

        return texts.map(one, na_action="ignore")

    return run(text)


def text_digest(text: str | None) -> str:
    """sha256 of the base spans of one text, for tests and spot checks."""
    return hashlib.sha256(listed(x for x in scanner().spans(text) if x[2] in KINDS[:3]).encode()).hexdigest()
