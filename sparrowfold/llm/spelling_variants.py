"""Spelling variants: Aho-Corasick automata of words' halves, scanned over all words, find the words one edit away.

One edit leaves one half of a word whole: the first at the start of the other word, or the second at its end. A shard's
automaton holds halves of words; a word is scanned by the shards in which a half could lie that it has at its start or
its end. Hits are held against place and length, and what is left of both words against the edit.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, partitions_for, small
from .wordbpe import text_slices

# The letters of a run, the rate of deletions, and what makes a word and a form.
RUN = "[a-zÀ-ÿ]{6,}"
EVERY, LETTERS, LEAST, TIMES = 199, 6, 5, 5
#: Words that a task counts before it hands them on.
KEEP = 300_000
#: Rows (halves and words to scan) that a shard is planned to hold; halves that more words share are dealt out.
SHARD, HOT = 60_000, 15_000
#: Rests that are compared one by one; more are parted by their own halves.
FEW = 12


def _counted(batches):
    def rows(counts):
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    runs, counts = re.compile(RUN), Counter()
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for first, texts in text_slices(batch):
            for own, text in zip(ids[first:], texts):
                if not text:
                    continue
                # bytes: only A-Z are folded
                low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                start = zlib.crc32(b"%d:" % own if own is not None else b":")
                for run, n in Counter(runs.findall(low)).items():
                    h = zlib.crc32(run.encode(), start)
                    if h % EVERY == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < LETTERS:
                            continue
                    counts[run] += n
                if len(counts) > KEEP:
                    yield rows(counts)
                    counts = Counter()
    yield rows(counts)


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: words of documents (doc_id, text), each with a letter taken out where its checksum in the document says so."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one letter put in, taken out or replaced makes a of b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


class Rests:
    """What is left of words beside a half, by length; many of one length are parted by their own halves, again and again."""

    def __init__(self, rests: list[tuple[str, int]]):
        self.few: dict[int, list] = {}
        self.many: dict[tuple, Rests] = {}
        by: dict[int, list] = {}
        for rest, k in rests:
            by.setdefault(len(rest), []).append((rest, k))
        for length, own in by.items():
            if length < 2 or len(own) <= FEW:
                self.few[length] = own
                continue
            half, parts = length // 2, {}
            for rest, k in own:
                parts.setdefault((length, 0, rest[:half]), []).append((rest[half:], k))
                parts.setdefault((length, 1, rest[half:]), []).append((rest[:half], k))
            self.many |= {key: Rests(part) for key, part in parts.items()}

    def near(self, rest: str) -> Iterator[int]:
        """Words whose rest is one edit from this one; a word may come twice."""
        for length in (len(rest) - 1, len(rest), len(rest) + 1):
            for other, k in self.few.get(length, ()):
                if one_edit(rest, other):
                    yield k
            if self.many:
                half = length // 2
                if node := self.many.get((length, 0, rest[:half])):
                    yield from node.near(rest[half:])
                if 0 < length - half <= len(rest) and (node := self.many.get((length, 1, rest[half - length :]))):
                    yield from node.near(rest[: half - length])


def _scanned(pdf: pd.DataFrame) -> pd.DataFrame:
    """word, n_near, best (minus n of the best near word), form of a shard's words that have a near one in it."""
    import ahocorasick

    held = pdf[pdf["side"] >= 0]
    words, counts = held["word"].tolist(), held["n"].tolist()
    halves: dict[str, tuple[list, list]] = {}
    for k, (word, side) in enumerate(zip(words, held["side"].tolist())):
        half = len(word) // 2
        cut = (word[:half], word[half:])
        halves.setdefault(cut[side], ([], []))[side].append((cut[1 - side], k))
    automaton = ahocorasick.Automaton()
    for half, sides in halves.items():
        automaton.add_word(half, (len(half), *(Rests(s) if s else None for s in sides)))
    out = []
    if halves:
        automaton.make_automaton()
        for word in pdf.loc[pdf["side"] < 0, "word"].drop_duplicates().tolist():
            near: set[int] = set()
            for end, (size, first, second) in automaton.iter(word):
                # a first half lies at the start, a second half at the end; whoever shares both is found by the first
                if first and end == size - 1:
                    near.update(first.near(word[size:]))
                if second and end == len(word) - 1:
                    near.update(k for k in second.near(word[:-size]) if not word.startswith(words[k][: len(words[k]) // 2]))
            if near:
                best, form = min((-counts[k], words[k]) for k in near)
                out.append((word, len(near), best, form))
    return pd.DataFrame(out, columns=["word", "n_near", "best", "form"])


def halves_of(word: Column, length: Column) -> tuple[Column, Column]:
    """(first half, second half) that a word of so many letters would share with this one."""
    half = F.floor(length / 2).cast("int")
    return F.substring(word, F.lit(1), half), F.substring(word, F.length(word) - (length - half) + 1, F.length(word))


def neighbours(words: DataFrame, ws: Workspace) -> DataFrame:
    """word, n_near, best, form: for each shard that holds words near a word (word, n), how many and the best of them."""
    size = F.length("word")
    first, second = halves_of(F.col("word"), size)
    key = F.struct(F.lit(0).alias("side"), first.alias("half")), F.struct(F.lit(1).alias("side"), second.alias("half"))
    held = words.select("word", "n", F.inline(F.array(*key)))
    candidates = [F.struct(F.lit(side).alias("side"), halves_of(F.col("word"), size + d)[side].alias("half")) for d in (-1, 0, 1) for side in (0, 1)]
    asked = words.select("word", F.inline(F.array_distinct(F.array(*candidates))))
    hot = ws.save(held.groupBy("side", "half").count().where(F.col("count") > HOT).select("side", "half", F.ceil(F.col("count") / HOT).cast("int").alias("parts")), "hot")
    shards = max(1, -(-8 * words.count() // SHARD))
    # the words of a half that very many share lie in several shards, and what is scanned for it goes to each
    dealt = lambda rows: rows.join(small(hot), ["side", "half"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    shard = F.pmod(F.xxhash64("side", "half", "part"), F.lit(shards)).alias("shard")
    held = dealt(held).withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")).select(shard, "side", "word", "n")
    asked = dealt(asked).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(shard, F.lit(-1).alias("side"), "word", F.lit(0).cast("long").alias("n"))
    return held.unionByName(asked).groupBy("shard").applyInPandas(_scanned, "word string, n_near long, best long, form string")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of at least 6 letters that documents (doc_id, text) hold at
    least 5 times.

    Near words are one inserted, deleted or replaced code point apart. A word's form is its near word of largest n (of
    equal ones the first in code-point order) if that n is 5 times its own or more; root is where forms lead, the word
    itself if it has none. Null and empty texts have no words; a null doc_id counts as an empty one; repeated rows
    count again. Texts and words of any length are read whole. No document, no word. Other columns are not read.
    """
    ws = Workspace(docs.sparkSession, "spelling")
    words = ws.save(vocabulary(docs), "words")
    near = ws.save(neighbours(words, ws), "near")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct("best", "form"))).alias("best")
    both = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best"), F.lit(None).cast("string").alias("form")).unionByName(
        near.select("word", F.lit(None).cast("long").alias("n"), "n_near", "best", "form")
    )
    placed = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    is_form = -F.col("best.best") >= TIMES * F.col("n")
    forms = ws.save(placed.select("word", "n", "n_near", F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.best")).alias("form_n")), "forms")
    # a form's n is TIMES its word's, so a way is short; each round doubles what a root has passed over
    roots, step = ws.save(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots-0"), 0
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step += 1
        longer = ws.save(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots-{step}")
        roots = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    return forms.join(small(roots), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_CRC = """crc AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""

#: The same by what is left of words when one letter is taken out.
ORACLE_SQL = rf"""
WITH RECURSIVE {_CRC},
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT run, n, xor(list_reduce([4294967295] || flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
    lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [195, ord(x) - 64] END)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM c, crc WHERE length(run) >= {LETTERS}),
v AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % {EVERY} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h)
  WHERE length(word) >= {LETTERS} GROUP BY 1 HAVING sum(n) >= {LEAST}),
o AS (SELECT word, n, k, left(word, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM v)),
p AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM o a JOIN o b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM o a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM o a JOIN v b ON a.rest = b.word
), q AS (SELECT word, count(*) AS n_near, min({{'n': -near_n, 'word': near}}) AS best FROM p GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.n >= {TIMES} * v.n THEN best.word END AS form, CASE WHEN -best.n >= {TIMES} * v.n THEN -best.n END AS form_n FROM v LEFT JOIN q USING (word)),
w AS (SELECT word, word AS root FROM f UNION ALL SELECT w.word, f.form FROM w JOIN f ON f.word = w.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n FROM f JOIN (SELECT w.word, w.root FROM w JOIN f ON f.word = w.root WHERE f.form IS NULL) l ON l.word = f.word
"""
