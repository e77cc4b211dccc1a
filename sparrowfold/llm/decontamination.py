"""Benchmark passages in documents: a prefix-filtered set join of shingles, then exact windows. DataFrame operations only.

A window of a benchmark item is in a document only if all its shingles are, so one shingle is prefix enough: the one
that is rarest in the documents. Where it occurs, the place that it would give the window is checked against the
document's bounds, then word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, small
from .url_alias import ascii_lower

# Words of a window, and the characters of a word.
WINDOW = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a shingle; windows of fewer words are one shingle.
WIDTH = 5
#: Words about a shingle that can belong to a window with it: those before, itself and those after.
BEFORE, AROUND = WINDOW - WIDTH, 2 * WINDOW - WIDTH
#: Tokens that stand for no shingle but for a document as such, so that each document gives a row whether hit or not.
MARKERS = 1024


def words_of(text: Column) -> Column:
    """Words of a text, A-Z in lower case; none for null."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def shingle(words: Column, at: Column, width: int) -> Column:
    return F.xxhash64(*(F.get(words, at + j) for j in range(width)))


def shingles(words: Column, width: int) -> Column:
    """Tokens of all shingles of so many words, by place."""
    n = F.size(words)
    return F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), lambda at: shingle(words, at, width))).otherwise(F.array().cast("array<bigint>"))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item (text of item_id; null stays), window (its words): each window of each benchmark item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text").cast("string")).alias("words"))
    n = F.size("words")
    starts = items.where(n > 0).select("item", "words", n.alias("n"), F.explode(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0)))).alias("at"))
    window = F.filter(F.array(*(F.get("words", F.col("at") + j) for j in range(WINDOW))), lambda w: w.isNotNull())
    return starts.select("item", window.alias("window")).distinct()


def tokens_of(windows: DataFrame) -> DataFrame:
    """window, size, offset, width, token: the shingles of each window."""
    sized = windows.withColumn("size", F.size("window")).withColumn("width", F.least("size", F.lit(WIDTH)))
    placed = sized.withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("width"))))
    token = F.coalesce(*(F.when(F.col("width") == w, shingle(F.col("window"), F.col("offset"), w)) for w in range(1, WIDTH + 1)))
    return placed.withColumn("token", token)


def occurrences(docs: DataFrame, windows: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, n_words) of every document, and (row, at, size, window): where each window occurs.

    The documents are read once. What is kept of them is a row each, and the neighbourhood of each shingle that the
    windows have, too; the rarity of shingles is counted over these.
    """
    known = ws.save(tokens_of(windows), "tokens")
    widths = sorted(r.width for r in known.select("width").distinct().collect())  # WIDTH rows at most
    markers = docs.sparkSession.range(MARKERS).select((-1 - F.col("id")).alias("token"))
    asked = small(ws.save(known.select("token").union(markers).distinct(), "asked"))

    # the number of a row is made here alone, and saved with it
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text").cast("string")).alias("words"))
    mark = F.array(-1 - F.pmod(F.xxhash64("row"), F.lit(MARKERS)))
    found = numbered.select("row", "doc_id", "words", F.posexplode(F.array(mark, *(shingles(F.col("words"), w) for w in widths))).alias("kind", "own"))
    found = found.select("row", "doc_id", "words", "kind", F.posexplode("own").alias("at", "token")).join(asked, "token")
    width = F.element_at(F.array(F.lit(0), *map(F.lit, widths)), F.col("kind") + 1)
    near = F.array(*(F.when(F.lit(j >= BEFORE) & (F.lit(j - BEFORE) < width) | (width == WIDTH), F.get("words", F.col("at") + (j - BEFORE))) for j in range(AROUND)))
    hits = ws.save(
        found.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.when(F.col("kind") > 0, F.col("at")).alias("at"), F.col("token"), F.when(F.col("kind") > 0, near).alias("near")),
        "hits",
    )
    placed = hits.where("at is not null")
    # a window some shingle of which is nowhere is nowhere
    rarity = placed.groupBy("token").agg(F.count("*").alias("n"))
    counted = known.join(small(ws.save(rarity, "rarity")), "token", "left")
    prefix = counted.groupBy("window", "size").agg(F.min(F.coalesce("n", F.lit(0))).alias("least"), F.min_by(F.struct("offset", "token"), F.struct("n", "offset")).alias("p"))
    prefix = ws.save(prefix.where("least > 0").select("window", "size", F.col("p.offset").alias("offset"), F.col("p.token").alias("token")), "prefix")
    at = F.col("at") - F.col("offset")
    fits = (at >= 0) & (at + F.col("size") <= F.col("n_words"))
    same = F.slice("near", BEFORE + 1 - F.col("offset"), F.col("size")) == F.col("window")
    occurring = placed.join(small(prefix), "token").where(fits).where(same).select("row", at.alias("at"), "size", "window")
    return hits.where("at is null").select("row", "doc_id", "n_words"), occurring


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document (doc_id, text).

    n_hit counts the document's words inside occurrences of windows of benchmark (item_id, text), n_items the items
    with such windows. Null and empty texts have no words, and items without words no windows. Each row gives a row:
    repeated and null doc_ids are judged by their own texts. An item with a null item_id hits words but is not listed;
    of repeated item_ids one is. Texts of any length are read whole; an empty table on either side is allowed. Other
    columns are not read.
    """
    ws = Workspace(docs.sparkSession, "windows")
    pairs = ws.save(item_windows(benchmark), "windows")
    every, found = occurrences(docs, pairs.select("window").distinct(), ws)
    found = ws.save(found, "found")
    # words that windows before, by place, have covered already count once
    before = F.max(F.col("at") + F.col("size")).over(Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("at") + F.col("size") - F.greatest("at", F.coalesce(before, F.lit(0))))
    covered = found.withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    items = found.select("row", "window").distinct().join(small(pairs.where("item is not null")), "window").select("row", "item").distinct()
    listed = items.groupBy("row").agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list("item")).alias("items"))
    hit = ws.save(covered.join(listed, "row", "left").select("row", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")), "hit")
    return every.join(small(hit), "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


_WORDS = rf"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}'), [])"

#: The same by all windows of the documents, of each size that the items have.
ORACLE_SQL = rf"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
b AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS size, array_to_string(list_slice(w, k, k + {WINDOW - 1}), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, 2 + greatest(len(w) - {WINDOW}, 0))) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
x AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
y AS (SELECT r, k, size, string_agg(word, ' ') OVER (PARTITION BY r, size ORDER BY k ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ahead FROM x, (SELECT DISTINCT size FROM b)),
z AS (SELECT r, k, size, array_to_string(list_slice(string_split(ahead, ' '), 1, size), ' ') AS win FROM y),
h AS (SELECT z.r, z.k, z.size, item_id FROM z JOIN b ON z.win = b.win AND z.size = b.size),
n AS (SELECT r, count(DISTINCT k + j) AS n_hit FROM (SELECT r, k, unnest(range(0, size)) AS j FROM h) GROUP BY 1),
m AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""
