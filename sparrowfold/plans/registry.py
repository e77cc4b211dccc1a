"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as fs
from ..functions import text as ft
from ..operators import calibration, chunking, grounding, inspection, manifest, metrics, postings, profile, retrieval, units
from ..sources import tables as src
from ..sources.store import Scratch
from . import engine, evaluation

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Settings of the registered flows.
TARGETS, HARD_LIMIT, TOP_K, FINAL_K, GATE, TEXT_GATE, POOLS, UNSUPPORTED = [128, 192, 320, 416], 512, 10, 4, 0.5, 0.35, [1, 2, 4, 8], (8, 9)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def joined(c, sep: str = ","):
    """An array as text, so that results compare by value."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep)


# ---- documents as units ------------------------------------------------------------------------------------------

_UNITS = """
u AS (
  SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY n) - 1 AS source_order, text,
         CASE WHEN words <= 3 THEN 'heading' ELSE 'paragraph' END AS unit_type, n // 10 + 1 AS page_number, words
  FROM (SELECT *, len(string_split(text, ' ')) AS words FROM (
    SELECT document_id, n, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS text
    FROM (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents)
  ) WHERE text <> '')
)"""
_SECTIONS = (
    _UNITS
    + """,
s AS (
  SELECT *, sum(CASE WHEN before IS NULL OR (unit_type = 'heading' AND (before <> 'heading' OR page_before <> page_number)) THEN 1 ELSE 0 END)
    OVER (PARTITION BY document_id ORDER BY source_order) - 1 AS section_index
  FROM (SELECT *, lag(unit_type) OVER w AS before, lag(page_number) OVER w AS page_before FROM u WINDOW w AS (PARTITION BY document_id ORDER BY source_order))
)"""
)
_CHUNKS = (
    "WITH RECURSIVE "
    + _SECTIONS
    + """,
h AS (SELECT document_id, section_index, count(*) FILTER (unit_type = 'heading') AS heads, coalesce(sum(words) FILTER (unit_type = 'heading'), 0) AS head_words, count(*) FILTER (unit_type <> 'heading') AS others FROM s GROUP BY ALL),
c AS (
  SELECT s.*, h.others = 0 AS alone, CASE WHEN h.others = 0 THEN 0 ELSE h.head_words END AS base, row_number() OVER (PARTITION BY s.document_id, s.section_index ORDER BY source_order) AS rn
  FROM s JOIN h USING (document_id, section_index) WHERE unit_type <> 'heading' OR h.others = 0
),
t AS (SELECT unnest([128, 192, 320, 416]) AS target),
pack(document_id, section_index, target, rn, held, chunk_index) AS (
  SELECT document_id, section_index, target, rn, words, 0 FROM c, t WHERE rn = 1
  UNION ALL
  SELECT c.document_id, c.section_index, p.target, c.rn,
    CASE WHEN NOT c.alone AND 2 + c.base + p.held + c.words > p.target THEN c.words ELSE p.held + c.words END,
    CASE WHEN NOT c.alone AND 2 + c.base + p.held + c.words > p.target THEN p.chunk_index + 1 ELSE p.chunk_index END
  FROM pack p JOIN c ON c.document_id = p.document_id AND c.section_index = p.section_index AND c.rn = p.rn + 1
),
heads AS (SELECT document_id, section_index, string_agg(text, '|' ORDER BY source_order) AS head_text, list(source_order ORDER BY source_order) AS head_orders, list(page_number) AS head_pages FROM s WHERE unit_type = 'heading' GROUP BY ALL),
k AS (
  SELECT p.document_id, p.section_index, p.target, p.chunk_index, any_value(c.alone) AS alone, 2 + any_value(c.base) + sum(c.words) AS token_count, max(c.words) + 2 AS largest_unit, 2 + any_value(c.base) + first(c.words ORDER BY c.source_order) AS first_tokens,
    string_agg(c.text, chr(10) ORDER BY c.source_order) AS text, list(c.source_order ORDER BY c.source_order) AS own_orders, list(c.page_number) AS own_pages
  FROM pack p JOIN c USING (document_id, section_index, rn) GROUP BY ALL
),
chunks AS (
  SELECT k.document_id, format('{}-t{}-s{:04d}-c{:02d}', k.document_id, k.target, k.section_index::BIGINT, k.chunk_index) AS chunk_id, 'target_' || k.target AS strategy_id,
    k.target AS target_tokens, token_count::BIGINT AS token_count, text, CASE WHEN alone THEN '' ELSE coalesce(head_text, '') END AS heading_context,
    list_sort(list_distinct(CASE WHEN alone THEN own_pages ELSE list_concat(coalesce(head_pages, []), own_pages) END)) AS pages,
    CASE WHEN alone THEN own_orders ELSE list_concat(coalesce(head_orders, []), own_orders) END AS orders,
    max(token_count) OVER (PARTITION BY k.document_id) <= 512 AS fits,
    CASE WHEN alone THEN CASE WHEN token_count > 512 THEN 'heading_only' END WHEN largest_unit > 512 THEN 'unit' WHEN first_tokens > 512 THEN CASE WHEN chunk_index > 0 THEN 'headings_and_unit' ELSE 'first_unit' END
      WHEN token_count > 512 THEN 'chunk' END AS problem
  FROM k LEFT JOIN heads USING (document_id, section_index)
)"""
)


def _units(spark, sf):
    return src.document_units(src.table(spark, sf, "documents"))


def _chunks(spark, sf):
    return chunking.build_chunks(profile.sections(_units(spark, sf)), TARGETS, HARD_LIMIT)


@query(f"WITH {_UNITS} SELECT document_id, source_order::BIGINT AS source_order, text, unit_type, page_number::BIGINT AS page_number FROM u")
def document_units(spark, sf):
    return _units(spark, sf).withColumns({c: F.col(c).cast("long") for c in ("source_order", "page_number")})


@query(
    f"""WITH {_SECTIONS} SELECT document_id, section_index::BIGINT AS section_index, min(page_number)::BIGINT AS page_start, max(page_number)::BIGINT AS page_end, count(*) AS unit_count,
    substr(min_by(text, source_order) FILTER (unit_type = 'heading'), 1, 160) AS heading_preview, (sum(words) + 2)::BIGINT AS token_count FROM s GROUP BY ALL"""
)
def sections(spark, sf):
    return profile.section_spans(profile.sections(_units(spark, sf))).withColumns({c: F.col(c).cast("long") for c in ("section_index", "page_start", "page_end")})


_SUMMARY = """count(*) AS count, round(min(n)::DOUBLE, 2) AS min, round(avg(n), 2) AS mean, round(quantile_cont(n, 0.5), 2) AS median, round(quantile_cont(n, 0.25), 2) AS p25, round(quantile_cont(n, 0.75), 2) AS p75,
  round(quantile_cont(n, 0.9), 2) AS p90, round(quantile_cont(n, 0.95), 2) AS p95, round(max(n)::DOUBLE, 2) AS max"""


@query(f"WITH {_UNITS}, l AS (SELECT unit_type, words + 2 AS n FROM u) SELECT 'all' AS unit_type, {_SUMMARY} FROM l UNION ALL SELECT unit_type, {_SUMMARY} FROM l GROUP BY unit_type")
def token_profile(spark, sf):
    return profile.token_profile(_units(spark, sf))


@query(f"WITH {_UNITS} SELECT document_id, source_order::BIGINT AS source_order, (words + 2)::BIGINT AS token_count, substr(text, 1, 160) AS preview FROM u WHERE words + 2 > 512")
def oversized_units(spark, sf):
    return profile.oversized(_units(spark, sf)).withColumns({c: F.col(c).cast("long") for c in ("source_order", "token_count")})


@query(
    f"""WITH {_SECTIONS}, l AS (SELECT sum(words) + 2 AS n FROM s GROUP BY document_id, section_index),
    q AS (SELECT unnest([greatest((SELECT quantile_cont(n, 0.5) FROM l), (SELECT quantile_cont(words + 2, 0.95) FROM s WHERE unit_type = 'paragraph')),
      (SELECT quantile_cont(n, 0.75) FROM l), (SELECT quantile_cont(n, 0.9) FROM l), (SELECT quantile_cont(n, 0.95) FROM l)]) AS v)
    SELECT DISTINCT least(512, greatest(32, floor(v / 32 + 0.5) * 32))::BIGINT AS target FROM q"""
)
def candidate_targets(spark, sf):
    return profile.candidate_targets(profile.sections(_units(spark, sf))).select(F.col("target").cast("long").alias("target"))


@query(
    _CHUNKS
    + """ SELECT document_id, chunk_id, strategy_id, target_tokens::BIGINT AS target_tokens, token_count, text, heading_context, array_to_string(pages, ',') AS page_numbers,
    CASE WHEN len(pages) = 1 THEN 'PDF page ' || pages[1] WHEN pages[-1] - pages[1] + 1 = len(pages) THEN 'PDF pages ' || pages[1] || '–' || pages[-1] ELSE 'PDF pages ' || array_to_string(pages, ', ') END AS page_reference,
    array_to_string(orders, ',') AS source_unit_orders FROM chunks WHERE fits"""
)
def chunks(spark, sf):
    rows = chunking.accepted(_chunks(spark, sf))
    return rows.select(
        "document_id", "chunk_id", "strategy_id", F.col("target_tokens").cast("long").alias("target_tokens"), F.col("token_count").cast("long").alias("token_count"), "text", joined("heading_context", "|").alias("heading_context"),
        joined("page_numbers").alias("page_numbers"), ft.page_reference(F.col("page_numbers")).alias("page_reference"), joined("source_unit_orders").alias("source_unit_orders"),
    )


@query(_CHUNKS + " SELECT document_id, max(token_count) AS largest_chunk, array_to_string(list_sort(list_distinct(list(problem) FILTER (problem IS NOT NULL))), ',') AS problems FROM chunks WHERE NOT fits GROUP BY 1")
def chunk_rejects(spark, sf):
    return chunking.rejected(_chunks(spark, sf)).select("document_id", F.col("largest_chunk").cast("long").alias("largest_chunk"), joined("problems").alias("problems"))


@query(_CHUNKS.replace("[128, 192, 320, 416]", "[32, 64]").replace("512", "64") + " SELECT document_id, chunk_id, token_count, problem FROM chunks WHERE problem IS NOT NULL")
def hard_limit_cases(spark, sf):
    """Under a limit that many units exceed."""
    made = chunking.build_chunks(profile.sections(_units(spark, sf)), [32, 64], 64)
    return made.where("problem is not null").select("document_id", "chunk_id", F.col("token_count").cast("long").alias("token_count"), "problem")


_BY_CHARS = (
    "WITH RECURSIVE "
    + _SECTIONS
    + """,
h AS (SELECT document_id, section_index, count(*) FILTER (unit_type <> 'heading') AS others, coalesce(sum(length(text) + 1) FILTER (unit_type = 'heading'), 0) AS head_chars FROM s GROUP BY ALL),
c AS (
  SELECT s.*, length(text) AS chars, h.others = 0 AS alone, CASE WHEN h.others = 0 THEN 0 ELSE h.head_chars END AS base, row_number() OVER (PARTITION BY s.document_id, s.section_index ORDER BY source_order) AS rn
  FROM s JOIN h USING (document_id, section_index) WHERE unit_type <> 'heading' OR h.others = 0
),
t AS (SELECT unnest([128, 192, 320, 416]) AS target),
pack(document_id, section_index, target, rn, held, chunk_index) AS (
  SELECT document_id, section_index, target, rn, chars, 0 FROM c, t WHERE rn = 1
  UNION ALL
  SELECT c.document_id, c.section_index, p.target, c.rn,
    CASE WHEN NOT c.alone AND (c.base + p.held + 1 + c.chars + 3) // 4 + 2 > p.target THEN c.chars ELSE p.held + 1 + c.chars END,
    CASE WHEN NOT c.alone AND (c.base + p.held + 1 + c.chars + 3) // 4 + 2 > p.target THEN p.chunk_index + 1 ELSE p.chunk_index END
  FROM pack p JOIN c ON c.document_id = p.document_id AND c.section_index = p.section_index AND c.rn = p.rn + 1
),
k AS (
  SELECT p.document_id, p.section_index, p.target, p.chunk_index, (any_value(c.base) + sum(c.chars) + count(*) - 1 + 3) // 4 + 2 AS token_count, sha256(string_agg(c.text, chr(10) ORDER BY c.source_order)) AS text_sha256, count(*) AS own_units
  FROM pack p JOIN c USING (document_id, section_index, rn) GROUP BY ALL
)
SELECT document_id, format('{}-t{}-s{:04d}-c{:02d}', document_id, target, section_index::BIGINT, chunk_index) AS chunk_id, token_count::BIGINT AS token_count, text_sha256, max(token_count) OVER (PARTITION BY document_id) <= 512 AS fits FROM k"""
)


@query(_BY_CHARS)
def chunks_by_characters(spark, sf):
    """Chunks by a tokenizer whose counts of joined texts aren't the sum of their parts'."""
    made = chunking.build_chunks_with(profile.sections(_units(spark, sf)), TARGETS, lambda texts: [(len(t) + 3) // 4 + 2 for t in texts], HARD_LIMIT)
    return made.select("document_id", "chunk_id", F.col("token_count").cast("long").alias("token_count"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "fits")


@query(
    _CHUNKS
    + """ SELECT strategy_id, target_tokens::BIGINT AS target_tokens, count(*) AS chunk_count, round(avg(token_count), 2) AS mean_tokens, quantile_cont(token_count, 0.5) AS median_tokens, max(token_count) AS max_tokens,
    count(*) FILTER (token_count > target_tokens) AS over_target FROM chunks WHERE fits GROUP BY ALL"""
)
def strategy_profile(spark, sf):
    return chunking.strategy_profile(chunking.accepted(_chunks(spark, sf))).withColumns({c: F.col(c).cast("long") for c in ("target_tokens", "max_tokens")})


@query(_CHUNKS + ", m AS (SELECT strategy_id, document_id, unnest(orders) AS source_order FROM chunks) SELECT strategy_id, count(DISTINCT (document_id, source_order)) AS covered, (SELECT count(*) FROM u) - count(DISTINCT (document_id, source_order)) AS lost, 0::BIGINT AS unknown FROM m GROUP BY 1")
def coverage(spark, sf):
    number = lambda c, name: F.count(F.when(F.expr(c), 1)).alias(name)
    marks = chunking.coverage_marks(_units(spark, sf), _chunks(spark, sf)).groupBy("strategy_id")
    return marks.agg(number("held", "covered"), number("due and not held", "lost"), number("held and not due", "unknown")).where("covered > 0")


@query(
    _CHUNKS
    + """, m AS (SELECT strategy_id, document_id, unnest(orders) AS source_order, chunk_id FROM chunks), made AS (SELECT DISTINCT strategy_id, document_id FROM chunks WHERE NOT ends_with(chunk_id, '-c01')),
    held AS (SELECT DISTINCT strategy_id, document_id, source_order FROM m WHERE NOT ends_with(chunk_id, '-c01')), due AS (SELECT strategy_id, document_id, source_order FROM made JOIN u USING (document_id) WHERE source_order % 5 <> 0)
    SELECT strategy_id, side, count(*) AS n FROM (SELECT *, 'lost' AS side FROM (FROM due EXCEPT FROM held) UNION ALL SELECT *, 'unknown' FROM (FROM held EXCEPT FROM due)) GROUP BY ALL"""
)
def coverage_breaks(spark, sf):
    """What coverage finds where second chunks are taken away and every fifth unit is unknown."""
    made = _chunks(spark, sf).where(~F.col("chunk_id").endswith("-c01"))
    return chunking.coverage_gaps(_units(spark, sf).where("source_order % 5 <> 0"), made).groupBy("strategy_id", "side").agg(F.count("*").alias("n"))


# ---- pages as lines ----------------------------------------------------------------------------------------------

_LINES = """
p0 AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS document_id, unnest(string_split(html, '<')) AS part, generate_subscripts(string_split(html, '<'), 1) - 1 AS pos FROM pages),
p1 AS (SELECT page_id, document_id, pos, lower(regexp_extract(part, '^(/?[A-Za-z][A-Za-z0-9]*)', 1)) AS tag, trim(regexp_replace(regexp_replace(part, '^[^>]*>?', ''), '\\s+', ' ', 'g')) AS text FROM p0),
p2 AS (
  SELECT *, sum(opens::INT) OVER w AS block, last_value(CASE WHEN opens THEN tag END IGNORE NULLS) OVER w AS kind
  FROM (SELECT *, tag IN ('li', 'h1', 'p', 'div', 'footer', 'script', 'style', 'title') AS opens FROM p1) WINDOW w AS (PARTITION BY page_id, document_id ORDER BY pos)
),
p3 AS (SELECT page_id, document_id, block, any_value(kind) AS kind, string_agg(text, ' ' ORDER BY pos) AS text FROM p2 WHERE text <> '' AND kind IS NOT NULL AND kind NOT IN ('script', 'style', 'title') GROUP BY ALL),
lines AS (
  SELECT document_id, (page_id * 10000000 + block)::BIGINT AS line_no, CASE WHEN kind = 'li' THEN '• ' || text ELSE text END AS text, page_id + 1 AS page_number, block AS block_index,
    CASE kind WHEN 'li' THEN 30.0 WHEN 'footer' THEN 740.0 ELSE 100.0 END::DOUBLE AS y0, CASE WHEN kind = 'h1' THEN 18.0 ELSE 11.0 END::DOUBLE AS font_size, kind = 'h1' AS is_bold
  FROM p3
)"""
_KEY = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"
_REPEATED = f", rep AS (SELECT document_id, {_KEY} AS key FROM lines WHERE y0 + 10 <= 50 OR y0 >= 735 GROUP BY ALL HAVING count(DISTINCT page_number) >= 3)"
_BODY = ", body AS (SELECT document_id, first(size ORDER BY chars DESC, first) AS body_font_size FROM (SELECT document_id, round(font_size, 1) AS size, sum(length(text)) AS chars, min(line_no) AS first FROM lines GROUP BY ALL) GROUP BY 1)"
_KEPT = f", kept AS (SELECT * FROM lines l WHERE NOT regexp_full_match(trim(text), '\\d{{1,3}}') AND NOT ((y0 + 10 <= 50 OR y0 >= 735) AND EXISTS (SELECT 1 FROM rep r WHERE r.document_id = l.document_id AND r.key = {_KEY.replace('text', 'l.text')})))"
_HTML_UNITS = (
    "WITH "
    + _LINES
    + _REPEATED
    + _BODY
    + _KEPT
    + """,
r0 AS (
  SELECT k.*, b.body_font_size, starts_with(ltrim(text), '•') AS bullet, trim(CASE WHEN starts_with(ltrim(text), '•') THEN substr(ltrim(text), 2) ELSE text END) AS bare FROM kept k JOIN body b USING (document_id)
),
r1 AS (
  SELECT *, CASE WHEN trim(text) <> '' AND length(trim(text)) <= 140 AND NOT bullet AND (font_size >= body_font_size + 1.4 OR (font_size >= body_font_size + 0.4 AND is_bold)) THEN 'H'
    WHEN bullet AND bare = '' THEN 'E' WHEN bullet THEN 'L' ELSE 'P' END AS kind FROM r0
),
r2 AS (
  SELECT *, lag(kind) OVER w AS above, last_value(CASE WHEN kind <> 'H' THEN {'k': kind, 'b': block_index} END IGNORE NULLS) OVER (PARTITION BY document_id, page_number ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open
  FROM r1 WHERE kind <> 'P' OR bare <> '' WINDOW w AS (PARTITION BY document_id, page_number ORDER BY line_no)
),
r3 AS (SELECT *, kind <> 'H' AND NOT coalesce(kind = 'P' AND open IS NOT NULL AND open.b = block_index AND (above <> 'H' OR open.k = 'E'), false) AS opens FROM r2),
r4 AS (SELECT *, CASE WHEN kind = 'H' THEN -row_number() OVER w ELSE sum(opens::INT) OVER w END AS gid FROM r3 WINDOW w AS (PARTITION BY document_id, page_number ORDER BY line_no)),
g AS (
  SELECT document_id, page_number, gid, min(line_no) FILTER (kind <> 'E') AS anchor, first(kind ORDER BY line_no) AS head, string_agg(bare, ' ' ORDER BY line_no) AS text, first(font_size ORDER BY line_no) AS font_size
  FROM r4 GROUP BY ALL HAVING anchor IS NOT NULL
),
units AS (
  SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY anchor) - 1 AS source_order, text, CASE head WHEN 'H' THEN 'heading' WHEN 'P' THEN 'paragraph' ELSE 'list_item' END AS unit_type, page_number, font_size FROM g
)"""
)


def _lines(spark, sf):
    return src.page_lines(src.table(spark, sf, "pages"))


@query("WITH " + _LINES + " SELECT document_id, line_no, text, page_number::BIGINT AS page_number, block_index::BIGINT AS block_index, y0, font_size, is_bold FROM lines")
def page_lines(spark, sf):
    return _lines(spark, sf).select("document_id", "line_no", "text", F.col("page_number").cast("long").alias("page_number"), F.col("block_index").cast("long").alias("block_index"), F.col("bbox.y0").alias("y0"), "font_size", "is_bold")


@query("WITH " + _LINES + _BODY + " SELECT * FROM body")
def body_font(spark, sf):
    return units.body_font(_lines(spark, sf))


@query("WITH " + _LINES + _REPEATED + _KEPT + " SELECT document_id, count(*) AS kept_lines, (SELECT count(*) FROM rep r WHERE r.document_id = kept.document_id) AS repeated_texts FROM kept GROUP BY 1")
def boilerplate(spark, sf):
    lines = _lines(spark, sf)
    rep = units.repeated_boilerplate(lines).groupBy("document_id").agg(F.count("*").alias("repeated_texts"))
    kept = units.without_boilerplate(lines).groupBy("document_id").agg(F.count("*").alias("kept_lines"))
    return kept.join(rep, "document_id", "left").select("document_id", "kept_lines", F.coalesce("repeated_texts", F.lit(0)).alias("repeated_texts"))


@query(_HTML_UNITS + " SELECT document_id, source_order::BIGINT AS source_order, text, unit_type, page_number::BIGINT AS page_number, font_size FROM units")
def html_units(spark, sf):
    return units.reconstruct(_lines(spark, sf)).select("document_id", F.col("source_order").cast("long").alias("source_order"), "text", "unit_type", F.col("page_number").cast("long").alias("page_number"), "font_size")


@query(
    f"WITH {_UNITS}, "
    + """d AS (SELECT doc_id AS document_id, greatest(1, (len(string_split(text, chr(10))) - 1) // 10 + 1) AS page_count FROM documents)
    SELECT d.document_id, d.page_count::BIGINT AS page_count, count(u.text) AS unit_count, count(*) FILTER (unit_type = 'heading') AS heading_count, count(*) FILTER (unit_type = 'paragraph') AS paragraph_count, count(*) FILTER (unit_type = 'list_item') AS list_item_count,
      array_to_string(list_filter(range(1, d.page_count + 1), lambda x: NOT list_contains(coalesce(list(DISTINCT u.page_number), []), x)), ',') AS pages_without_units
    FROM d LEFT JOIN u USING (document_id) GROUP BY d.document_id, d.page_count"""
)
def document_profile(spark, sf):
    docs = src.table(spark, sf, "documents")
    pages = F.greatest(F.lit(1), (F.floor((F.size(F.split("text", "\n")) - 1) / src.PAGE_LINES) + 1)).cast("int")
    head = docs.select(F.col("doc_id").alias("document_id"), pages.alias("page_count"), F.lit(11.0).alias("body_font_size"))
    rows = profile.document_profile(src.document_units(docs), head).drop("body_font_size")
    return rows.withColumn("pages_without_units", joined("pages_without_units")).withColumn("page_count", F.col("page_count").cast("long"))


@query("WITH " + _LINES + ", b AS (SELECT document_id, page_number, sum(length(text)) AS n FROM lines GROUP BY ALL) SELECT count(*) AS pages, min(n)::BIGINT AS min_chars, quantile_cont(n, 0.5) AS median_chars, max(n)::BIGINT AS max_chars, sum(n)::BIGINT AS total_chars, count(*) FILTER (n < 100) AS low_text_pages FROM b")
def page_statistics(spark, sf):
    return inspection.page_statistics(_lines(spark, sf))


@query("WITH " + _LINES + " SELECT round(font_size, 1) AS font_size, sum(length(text))::BIGINT AS n_chars FROM lines GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def font_histogram(spark, sf):
    return inspection.font_histogram(_lines(spark, sf))


# ---- vectors -----------------------------------------------------------------------------------------------------

_SCORE = "round(list_inner_product({a}::DOUBLE[], {b}::DOUBLE[]), 9)"
_HITS = f"""
hits AS (
  SELECT * FROM (SELECT q.vec_id AS query_id, i.vec_id AS chunk_id, {_SCORE.format(a="q.embedding", b="i.embedding")} AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SCORE.format(a="q.embedding", b="i.embedding")} DESC, i.vec_id) AS rank
  FROM embeddings q, embeddings i WHERE q.vec_id % 20 = 0) WHERE rank <= 10
)"""


def _vectors(spark, sf):
    rows = src.table(spark, sf, "embeddings")
    return rows.select(F.col("vec_id").alias("chunk_id"), "embedding", "label"), rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


def _hits(spark, sf):
    index, asked = _vectors(spark, sf)
    return retrieval.top_k(index, asked, TOP_K), asked


@query(f"WITH {_HITS} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM hits")
def topk_inner_product(spark, sf):
    return _hits(spark, sf)[0].select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 6).alias("score"))


_GATED = f"""WITH {_HITS}, d AS (SELECT vec_id AS query_id, score >= 0.5 AS is_relevant, score AS top_score FROM embeddings e JOIN hits h ON h.query_id = e.vec_id AND h.rank = 1)"""


@query(_GATED + " SELECT query_id, is_relevant, round(top_score, 6) AS top_score, 0.5::DOUBLE AS threshold, CASE WHEN is_relevant THEN 'relevant' ELSE 'below_threshold' END AS reason FROM d")
def gate(spark, sf):
    hits, asked = _hits(spark, sf)
    return retrieval.gate(asked, hits, F.lit(GATE)).withColumn("top_score", F.round("top_score", 6))


@query(_GATED + " SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM hits JOIN d USING (query_id) WHERE is_relevant AND rank <= 4")
def final_evidence(spark, sf):
    hits, asked = _hits(spark, sf)
    good = retrieval.gate(asked, hits, F.lit(GATE)).where("is_relevant").select("query_id")
    return hits.where(F.col("rank") <= FINAL_K).join(good, "query_id", "left_semi").select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 6).alias("score"))


_POOLED = """
m AS (SELECT unnest([1, 2, 4, 8]) AS target),
e AS (SELECT target, vec_id // target AS chunk_id, vec_id, embedding::DOUBLE[] AS v FROM embeddings, m),
x AS (SELECT target, chunk_id, vec_id, unnest(v) AS value, generate_subscripts(v, 1) AS dim FROM e),
y AS (SELECT target, chunk_id, dim, list_sum(list(value ORDER BY vec_id)) AS value FROM x GROUP BY ALL),
z AS (SELECT target, chunk_id, list(value ORDER BY dim) AS v FROM y GROUP BY ALL),
idx AS (SELECT target, chunk_id, list_transform(v, lambda a: a / sqrt(list_inner_product(v, v))) AS v FROM z),
gold AS (SELECT q.vec_id AS query_id, g.vec_id % 3 AS group_no, g.vec_id AS unit FROM embeddings q JOIN embeddings g ON g.label = q.label AND g.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
hits AS (
  SELECT * FROM (SELECT i.target, q.vec_id AS query_id, i.chunk_id, row_number() OVER (PARTITION BY i.target, q.vec_id ORDER BY round(list_inner_product(q.embedding::DOUBLE[], i.v), 9) DESC, i.chunk_id) AS rank
  FROM embeddings q, idx i WHERE q.vec_id % 20 = 0) WHERE rank <= 5
),
rel AS (SELECT DISTINCT target, query_id, unit // target AS chunk_id FROM gold, m),
"""
_METRICS = (
    "WITH "
    + _POOLED
    + """
marked AS (SELECT h.*, r.chunk_id IS NOT NULL AS relevant FROM hits h LEFT JOIN rel r USING (target, query_id, chunk_id)),
met AS (SELECT h.target, g.query_id, g.group_no, g.unit, min(h.rank) AS rank FROM gold g JOIN hits h ON h.query_id = g.query_id AND h.chunk_id = g.unit // h.target GROUP BY ALL),
sizes AS (SELECT query_id, group_no, count(DISTINCT unit) AS size FROM gold GROUP BY ALL),
per AS (
  SELECT m.target, a.query_id, k.k,
    (SELECT count(*) FROM marked x WHERE x.target = m.target AND x.query_id = a.query_id AND relevant AND rank <= k.k) / k.k AS precision,
    (SELECT count(*) FROM met x WHERE x.target = m.target AND x.query_id = a.query_id AND rank <= k.k) / a.n AS recall,
    (SELECT sum(c / size) FROM (SELECT s.size, (SELECT count(*) FROM met x WHERE x.target = m.target AND x.query_id = s.query_id AND x.group_no = s.group_no AND rank <= k.k) AS c FROM sizes s WHERE s.query_id = a.query_id)) / a.groups AS group_recall,
    (SELECT min(rank) FROM marked x WHERE x.target = m.target AND x.query_id = a.query_id AND relevant) AS first_relevant_rank,
    coalesce((SELECT sum(1 / log2(rank + 1)) FROM marked x WHERE x.target = m.target AND x.query_id = a.query_id AND relevant AND rank <= k.k), 0)
      / (SELECT sum(1 / log2(i + 1)) FROM range(1, 6) t(i) WHERE i <= least(k.k, (SELECT count(*) FROM rel r WHERE r.target = m.target AND r.query_id = a.query_id))) AS ndcg
  FROM m, (SELECT query_id, count(DISTINCT unit) AS n, count(DISTINCT group_no) AS groups FROM gold GROUP BY 1) a, (SELECT unnest([1, 3, 5]) AS k) k
),
per2 AS (
  SELECT 'target_' || target AS strategy_id, target, query_id, k, round(precision, 6) AS precision, round(recall, 6) AS recall, round(group_recall, 6) AS group_recall,
    round(CASE WHEN first_relevant_rank <= k THEN 1 / first_relevant_rank ELSE 0 END, 6) AS reciprocal_rank, round(coalesce(ndcg, 0), 6) AS ndcg, first_relevant_rank FROM per
),
means AS (SELECT strategy_id, target, k, count(*) AS queries, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(group_recall), 6) AS group_recall, round(avg(reciprocal_rank), 6) AS reciprocal_rank, round(avg(ndcg), 6) AS ndcg FROM per2 GROUP BY ALL)
"""
)


def _gold(spark, sf):
    rows = src.table(spark, sf, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("set_id"))
    own = rows.select(F.col("label").alias("set_id"), (F.col("vec_id") % 3).alias("group_no"), F.col("vec_id").alias("unit"))
    # a query seeks all of its label but itself
    return metrics.Gold(own, asked, asked.select("query_id", F.col("query_id").alias("unit")))


def _per_query(spark, sf):
    rows = src.table(spark, sf, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = Scratch(spark, "pooled").save(retrieval.pooled(rows, POOLS), "index")
    lengths = index.groupBy("strategy_id", "target").agg(F.avg(F.size("units")).alias("mean_tokens"))
    return evaluation.evaluate_strategies(index, asked, _gold(spark, sf), lengths, [1, 3, 5])


@query(_METRICS + "SELECT strategy_id, query_id, k::BIGINT AS k, precision, recall, group_recall, reciprocal_rank, ndcg, coalesce(first_relevant_rank, 0)::BIGINT AS first_relevant_rank FROM per2")
def retrieval_metrics(spark, sf):
    return _per_query(spark, sf)[0].withColumns({"k": F.col("k").cast("long"), "first_relevant_rank": F.coalesce("first_relevant_rank", F.lit(0)).cast("long")})


@query(_METRICS + "SELECT strategy_id, k::BIGINT AS k, queries, precision, recall, group_recall, reciprocal_rank, ndcg FROM means")
def strategy_means(spark, sf):
    return _per_query(spark, sf)[1].withColumn("k", F.col("k").cast("long"))


@query(_METRICS + "SELECT strategy_id, target::BIGINT AS target, recall, reciprocal_rank, ndcg, precision FROM means WHERE k = 5 ORDER BY recall DESC, reciprocal_rank DESC, ndcg DESC, precision DESC, target LIMIT 1")
def strategy_selection(spark, sf):
    return _per_query(spark, sf)[2].select("strategy_id", F.col("target").cast("long").alias("target"), "recall", "reciprocal_rank", "ndcg", "precision")


_HOLDOUT = f"""WITH hh AS (SELECT * FROM (SELECT q.vec_id AS query_id, i.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SCORE.format(a="q.embedding", b="i.embedding")} DESC, i.vec_id) AS rank, q.label = i.label AS relevant
  FROM embeddings q, embeddings i WHERE q.vec_id % 20 = 0) WHERE rank <= 5)
SELECT h.query_id, round(count(*) FILTER (relevant AND h.chunk_id <> h.query_id) / 5, 6) AS precision, coalesce(min(rank) FILTER (relevant AND h.chunk_id <> h.query_id), 0)::BIGINT AS first_relevant_rank,
  round(max(s.score) - 0.5, 6) AS margin, max(s.score) >= 0.5 AS is_relevant
FROM hh h JOIN (SELECT q.vec_id AS query_id, max({_SCORE.format(a="q.embedding", b="i.embedding")}) AS score FROM embeddings q, embeddings i WHERE q.vec_id % 20 = 0 GROUP BY 1) s USING (query_id) GROUP BY 1"""


@query(_HOLDOUT)
def holdout_evaluation(spark, sf):
    hits, asked = _hits(spark, sf)
    index = _vectors(spark, sf)[0].select("chunk_id", F.array("chunk_id").alias("units"))
    rows = evaluation.holdout(hits, _gold(spark, sf), index, asked, F.lit(GATE))
    return rows.select("query_id", "precision", F.coalesce("first_relevant_rank", F.lit(0)).cast("long").alias("first_relevant_rank"), F.round("margin", 6).alias("margin"), "is_relevant")


@query("SELECT text FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT text FROM documents WHERE doc_id % 2 = 1")
def shared_texts(spark, sf):
    """Texts that stand under even and under odd ids: exact copies across the two halves."""
    rows = src.table(spark, sf, "documents")
    half = lambda k: rows.where(F.pmod("doc_id", F.lit(2)) == k).select("text")
    return evaluation.overlap(half(0), half(1))


_TOP1 = f"""
sc AS (SELECT q.vec_id AS query_id, q.label NOT IN (8, 9) AS is_positive, max({_SCORE.format(a="q.embedding", b="i.embedding")}) AS score
  FROM embeddings q, embeddings i WHERE q.vec_id % 20 = 0 AND i.vec_id % 20 <> 0 AND i.label NOT IN (8, 9) GROUP BY ALL),
v AS (SELECT DISTINCT score FROM sc),
cand AS (SELECT min(score) AS threshold FROM v UNION ALL SELECT CASE WHEN above IS NULL THEN nextafter(score, 'inf'::DOUBLE) ELSE (score + above) / 2 END FROM (SELECT score, lead(score) OVER (ORDER BY score) AS above FROM v)),
tm AS (
  SELECT threshold, count(*) FILTER (is_positive AND score >= threshold) AS true_positive, count(*) FILTER (is_positive AND score < threshold) AS false_negative,
    count(*) FILTER (NOT is_positive AND score < threshold) AS true_negative, count(*) FILTER (NOT is_positive AND score >= threshold) AS false_positive FROM cand, sc GROUP BY 1
),
tm2 AS (SELECT *, true_positive / (true_positive + false_negative) AS recall, true_negative / (true_negative + false_positive) AS specificity FROM tm)"""


def _top_scores(spark, sf):
    """Rank-1 scores: queries whose label the index lacks are the unsupported ones. The index has no query row."""
    rows = src.table(spark, sf, "embeddings")
    index = rows.where("vec_id % 20 <> 0").where(~F.col("label").isin(*UNSUPPORTED)).select(F.col("vec_id").alias("chunk_id"), "embedding")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    top = retrieval.top_k(index, asked, 1).select("query_id", "score")
    return asked.join(top, "query_id").select("query_id", (~F.col("label").isin(*UNSUPPORTED)).alias("is_positive"), "score")


@query(f"WITH {_TOP1} SELECT round(threshold, 8) AS threshold, true_positive, false_negative, true_negative, false_positive, round(recall, 6) AS recall, round(specificity, 6) AS specificity, round((recall + specificity) / 2, 6) AS balanced_accuracy FROM tm2")
def threshold_metrics(spark, sf):
    rows = calibration.threshold_metrics(_top_scores(spark, sf))
    return rows.withColumn("threshold", F.round("threshold", 8)).withColumns({c: F.round(c, 6) for c in ("recall", "specificity", "balanced_accuracy")})


@query(f"WITH {_TOP1} SELECT round(threshold, 8) AS threshold FROM cand")
def candidate_thresholds(spark, sf):
    return calibration.thresholds(_top_scores(spark, sf)).select(F.round("threshold", 8).alias("threshold"))


@query(f"WITH {_TOP1} SELECT round(threshold, 8) AS threshold, true_positive, true_negative, round((recall + specificity) / 2, 6) AS balanced_accuracy, (SELECT count(*) FROM cand) AS candidates FROM tm2 ORDER BY (recall + specificity) / 2 DESC, recall DESC, specificity DESC, tm2.threshold LIMIT 1")
def threshold_selection(spark, sf):
    row = calibration.select_threshold(_top_scores(spark, sf))
    return row.select(F.round("threshold", 8).alias("threshold"), "true_positive", "true_negative", F.round("balanced_accuracy", 6).alias("balanced_accuracy"), "candidates")


@query(f"WITH {_TOP1} SELECT is_positive, count(*) AS count, round(min(score), 6) AS min, round(avg(score), 6) AS mean, round(max(score), 6) AS max FROM sc GROUP BY 1")
def score_summary(spark, sf):
    return calibration.score_summary(_top_scores(spark, sf))


@query(f"WITH {_TOP1} SELECT count(*) AS queries, count(*) FILTER (score >= 0.5) AS accepted, round(avg((score >= 0.5)::INT), 6) AS acceptance_rate FROM sc")
def acceptance(spark, sf):
    top = _top_scores(spark, sf)
    decisions = retrieval.gate(top, top.select("query_id", "score", F.lit(1).alias("rank")), F.lit(GATE))
    return calibration.acceptance(decisions)


@query("SELECT count(*) AS chunk_count, count(DISTINCT vec_id) AS distinct_chunks, any_value(len(embedding))::BIGINT AS embedding_dimension, 0::BIGINT AS problems FROM embeddings")
def index_check(spark, sf):
    index = src.table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.lit("all").alias("strategy_id"), F.lit(1).alias("target_tokens"))
    problems = src.index_violations(index).agg(F.count("*").alias("problems"))
    return manifest.index_facts(index).join(problems).select("chunk_count", "distinct_chunks", F.col("embedding_dimension").cast("long").alias("embedding_dimension"), "problems")


_FAULTY = "CASE vec_id % 7 WHEN 1 THEN NULL WHEN 2 THEN list_concat(embedding::DOUBLE[], ['nan'::DOUBLE]) WHEN 3 THEN embedding[1:5]::DOUBLE[] ELSE embedding::DOUBLE[] END"


@query(
    f"""WITH i AS (SELECT vec_id % 50 AS chunk_id, {_FAULTY} AS v FROM embeddings)
    SELECT 'several_lengths' AS problem, count(DISTINCT len(v)) - 1 AS n FROM i UNION ALL SELECT 'not_finite', count(*) FILTER (v IS NULL OR len(list_filter(v, lambda x: isnan(x))) > 0) FROM i
    UNION ALL SELECT 'repeated_chunk', count(*) FROM (SELECT chunk_id FROM i GROUP BY 1 HAVING count(*) > 1)"""
)
def index_faults(spark, sf):
    """What the index check finds where vectors are missing, hold a NaN or are cut, and ids repeat."""
    k, v = F.col("vec_id") % 7, F.col("embedding").cast("array<double>")
    faulty = F.when(k == 1, F.lit(None)).when(k == 2, F.concat(v, F.array(F.lit(float("nan"))))).when(k == 3, F.slice(v, 1, 5)).otherwise(v)
    return src.index_violations(src.table(spark, sf, "embeddings").select((F.col("vec_id") % 50).alias("chunk_id"), faulty.alias("embedding")))


@query(
    """WITH i AS (SELECT count(*) AS n, count(DISTINCT vec_id // 2) AS d, max(len(embedding)) AS w FROM embeddings)
    SELECT * FROM (SELECT unnest([{'label': 'sha256 of calibration', 'expected': 'abc', 'actual': 'abd'}, {'label': 'embedding_model of index', 'expected': 'm', 'actual': 'other'}, {'label': 'target_tokens of calibration', 'expected': '416', 'actual': NULL},
      {'label': 'chunk_count of selection', 'expected': (n + 1)::VARCHAR, 'actual': n::VARCHAR}, {'label': 'distinct chunks', 'expected': n::VARCHAR, 'actual': d::VARCHAR}, {'label': 'vector length', 'expected': '3', 'actual': w::VARCHAR},
      {'label': 'strategy of rows', 'expected': 'target_416', 'actual': NULL}, {'label': 'threshold within bounds', 'expected': 'true', 'actual': 'false'}], recursive := true) FROM i)"""
)
def manifest_check(spark, sf):
    """Everything that artifacts contradict each other in, where they do in many ways."""
    vectors = src.table(spark, sf, "embeddings")
    index = vectors.select(F.floor(F.col("vec_id") / 2).alias("chunk_id"), "embedding", F.concat(F.lit("target_"), F.col("vec_id") % 2).alias("strategy_id"), F.lit(416).alias("target_tokens"))
    one = vectors.agg(F.count("*").alias("n"))
    base = [F.lit("doc").alias("document_id"), F.lit("target_416").alias("strategy_id")]
    selected = one.select(*base, F.lit("abc").alias("document_sha256"), F.lit("m").alias("embedding_model"), F.lit(416).alias("target_tokens"), (F.col("n") + 1).alias("chunk_count"))
    about = one.select(*base, F.lit("abc").alias("document_sha256"), F.lit("other").alias("embedding_model"), F.lit(416).alias("target_tokens"), F.col("n").alias("chunk_count"), F.lit(3).alias("embedding_dimension"))
    cut = one.select(*base, F.lit("abd").alias("document_sha256"), F.lit("m").alias("embedding_model"), F.lit(None).cast("int").alias("target_tokens"), F.lit(1.5).cast("double").alias("selected_threshold"))
    return manifest.cross_checks(selected, cut, about, index, "abc", "m")


# ---- texts as evidence -------------------------------------------------------------------------------------------

_TEXT_HITS = """
dw AS (SELECT doc_id AS chunk_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(trim(lower(text), ' ' || chr(10) || chr(9)), '\\s+')) AS w FROM documents) WHERE w <> '' GROUP BY ALL),
qw AS (SELECT item_id AS query_id, w, count(*) AS n FROM (SELECT item_id, unnest(regexp_split_to_array(trim(lower(text), ' ' || chr(10) || chr(9)), '\\s+')) AS w FROM benchmark) WHERE w <> '' GROUP BY ALL),
dn AS (SELECT chunk_id, sqrt(sum(n * n)) AS norm FROM dw GROUP BY 1), qn AS (SELECT query_id, sqrt(sum(n * n)) AS norm FROM qw GROUP BY 1),
ts AS (SELECT query_id, chunk_id, round(sum(q.n * d.n) / (any_value(qn.norm) * any_value(dn.norm)), 9) AS score FROM qw q JOIN dw d USING (w) JOIN dn USING (chunk_id) JOIN qn USING (query_id) GROUP BY ALL),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ts) WHERE rank <= 10),
dec AS (SELECT b.item_id AS query_id, h.score AS top_score, coalesce(h.score >= 0.35, false) AS is_relevant, CASE WHEN h.score IS NULL THEN 'no_hits' WHEN h.score >= 0.35 THEN 'relevant' ELSE 'below_threshold' END AS reason FROM benchmark b LEFT JOIN hits h ON h.query_id = b.item_id AND h.rank = 1),
fin AS (SELECT h.* FROM hits h JOIN dec USING (query_id) WHERE is_relevant AND rank <= 4),
cit AS (SELECT *, rank - 1 AS position FROM fin WHERE rank <= 2),
conf AS (
  SELECT query_id, round(0.35 * (any_value(top_score) + 1) / 2 + 0.35 * greatest(0, least(1, (any_value(top_score) - 0.35) / 0.65)) + 0.2 * avg((score + 1) / 2) + 0.1 * least(count(*) / 2, 1), 4) AS confidence_score
  FROM cit JOIN dec USING (query_id) GROUP BY 1
)"""
_SNIPPET = """snip AS (
  SELECT doc_id AS chunk_id, CASE WHEN length(s) <= 420 THEN s WHEN cut >= 251 THEN rtrim(substr(head, 1, cut)) || '…' ELSE head || '…' END AS snippet
  FROM (SELECT doc_id, s, head, CASE WHEN contains(head, ' ') THEN length(head) - strpos(reverse(head), ' ') ELSE -1 END AS cut FROM (SELECT doc_id, s, rtrim(substr(s, 1, 419)) AS head FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents)))
)"""


def _text_tables(spark, sf):
    docs, bench = src.table(spark, sf, "documents"), src.table(spark, sf, "benchmark")
    return docs.select(F.col("doc_id").alias("chunk_id"), "text", F.array(F.lit(1)).alias("page_numbers")), bench.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _text_hits(spark, sf):
    chunks_, asked = _text_tables(spark, sf)
    return postings.sparse_top_k(chunks_, asked.select("query_id", F.col("query").alias("text")), TOP_K)


def _text_flow(spark, sf):
    """Chunks that are evidence, decisions, final evidence and checked citations of the extractive generator."""
    chunks_, asked = _text_tables(spark, sf)
    hits = _text_hits(spark, sf)
    decisions = retrieval.gate(asked, hits, F.lit(TEXT_GATE))
    final = hits.where(F.col("rank") <= FINAL_K).join(decisions.where("is_relevant").select("query_id"), "query_id", "left_semi")
    chunks_ = grounding.named_chunks(chunks_, final, Scratch(spark, "flow").save)
    made = engine.extractive(final.join(chunks_.select("chunk_id", "text"), "chunk_id"))
    return chunks_, decisions, final, grounding.check_citations(made, final)


@query(f"WITH {_TEXT_HITS} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM hits")
def topk_text(spark, sf):
    return _text_hits(spark, sf).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {_TEXT_HITS} SELECT query_id, string_agg(chunk_id, ',' ORDER BY position) AS citations, 'ok' AS status FROM cit GROUP BY 1")
def citations(spark, sf):
    return _text_flow(spark, sf)[3].select("query_id", joined("citations").alias("citations"), "status")


@query(f"WITH {_TEXT_HITS}, {_SNIPPET} SELECT query_id, position, chunk_id, 'PDF page 1' AS page_reference, snippet, round(score, 6) AS retrieval_score, rank AS retrieval_rank FROM cit JOIN snip USING (chunk_id)")
def sources(spark, sf):
    chunks_, _, final, checked = _text_flow(spark, sf)
    rows = grounding.sources(grounding.cited_hits(checked, final), chunks_)
    return rows.select("query_id", F.col("position").cast("long").alias("position"), "chunk_id", "page_reference", "snippet", F.round("retrieval_score", 6).alias("retrieval_score"), F.col("retrieval_rank").cast("long").alias("retrieval_rank"))


@query(f"WITH {_TEXT_HITS} SELECT query_id, confidence_score FROM conf")
def confidence(spark, sf):
    _, decisions, final, checked = _text_flow(spark, sf)
    return grounding.confidences(decisions, grounding.cited_hits(checked, final))


@query(
    f"""WITH {_TEXT_HITS} SELECT d.query_id, CASE WHEN d.is_relevant THEN sha256(trim(doc.text, ' ' || chr(10) || chr(9))) ELSE sha256('{grounding.ABSTENTION.replace("'", "''")}') END AS answer_sha256, CASE WHEN d.is_relevant THEN c.confidence_score ELSE 0 END AS confidence_score,
    coalesce((SELECT count(*) FROM cit WHERE cit.query_id = d.query_id), 0) AS sources, d.reason, 200::BIGINT AS status FROM dec d LEFT JOIN conf c USING (query_id) LEFT JOIN fin f ON f.query_id = d.query_id AND f.rank = 1 LEFT JOIN documents doc ON doc.doc_id = f.chunk_id"""
)
def answers(spark, sf):
    chunks_, asked = _text_tables(spark, sf)
    rows = engine.answers(asked, chunks_, engine.scanning_retriever(chunks_), engine.extractive, engine.Config(top_k=TOP_K, final_k=FINAL_K, threshold=TEXT_GATE))
    listed = F.when(F.col("sources").isNotNull(), F.size("sources")).otherwise(0).cast("long")
    return rows.select("query_id", F.sha2(ft.strip(F.col("answer")).cast("binary"), 256).alias("answer_sha256"), "confidence_score", listed.alias("sources"), "reason", F.col("status").cast("long").alias("status"))


_PAYLOAD = (
    """'{"model":"model","messages":[{"role":"system","content":' || to_json('"""
    + "\n".join(grounding.RULES).replace("'", "''")
    + """') || '},{"role":"user","content":' || to_json('QUESTION:' || chr(10) || trim(b.text, ' ' || chr(10) || chr(9)) || chr(10) || chr(10) || 'ALLOWED CITATION IDS:' || chr(10) || ids || chr(10) || chr(10) || 'UNTRUSTED EVIDENCE JSON:' || chr(10) || texts)
    || '}],"temperature":0,"max_tokens":512' || '"""
    + grounding.payload_tail().replace("'", "''")
    + "'"
)


@query(
    f"""WITH {_TEXT_HITS}, ev AS (SELECT query_id, '[' || string_agg('"' || chunk_id || '"', ',' ORDER BY rank) || ']' AS ids, '[' || string_agg('{{"chunk_id":"' || chunk_id || '","text":' || to_json(d.text) || '}}', ',' ORDER BY rank) || ']' AS texts
      FROM fin JOIN documents d ON d.doc_id = fin.chunk_id GROUP BY 1)
    SELECT query_id, sha256({_PAYLOAD}) AS payload_sha256 FROM ev JOIN benchmark b ON b.item_id = ev.query_id"""
)
def prompts(spark, sf):
    chunks_, _, final, _ = _text_flow(spark, sf)
    asked = _text_tables(spark, sf)[1].join(final.select("query_id").distinct(), "query_id")
    made = grounding.payloads(grounding.prompts(asked, final.join(chunks_.select("chunk_id", "text"), "chunk_id")), "model")
    return made.select("query_id", F.sha2(F.col("payload").cast("binary"), 256).alias("payload_sha256"))


@query(
    """SELECT conv_id, turn, CASE k WHEN 0 THEN 'uncited_answer' WHEN 1 THEN 'ok' WHEN 2 THEN 'unknown_citation' WHEN 3 THEN 'repeated_hit' WHEN 4 THEN 'cited_abstention' WHEN 5 THEN 'ok' END AS status,
      CASE k WHEN 1 THEN '2,1' WHEN 2 THEN '1,9' WHEN 3 THEN '1' WHEN 4 THEN '1' ELSE '' END AS citations,
      CASE k WHEN 1 THEN 200 WHEN 5 THEN 200 ELSE 502 END::BIGINT AS code
    FROM (SELECT conv_id, turn, (conv_id + turn) % 6 AS k FROM conversations)"""
)
def citation_policy(spark, sf):
    """Every outcome of the citation check: k turns what a generator gave into each of its cases."""
    rows = src.table(spark, sf, "conversations").select("conv_id", "turn", F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6)).alias("k"), F.concat_ws(":", "conv_id", "turn").alias("query_id"))
    cited = {0: [], 1: ["2", "1", "2"], 2: ["1", "9"], 3: ["1"], 4: ["1"], 5: []}
    citations_ = F.coalesce(*(F.when(F.col("k") == k, F.array(*map(F.lit, v)).cast("array<string>")) for k, v in cited.items()))
    made = rows.select("query_id", F.when(F.col("k") >= 4, grounding.ABSTENTION).otherwise("answer").alias("answer"), citations_.alias("citations"))
    hits = rows.select("query_id", F.explode(F.when(F.col("k") == 3, F.array(*map(F.lit, "112"))).otherwise(F.array(*map(F.lit, "12")))).alias("chunk_id"))
    checked = grounding.check_citations(made, hits).join(rows.select("query_id", "conv_id", "turn"), "query_id")
    code = grounding.status_code(F.when(F.col("status") == "ok", "ok").otherwise("citation"))
    return checked.select("conv_id", "turn", "status", joined("citations").alias("citations"), code.cast("long").alias("code"))


@query(
    """SELECT conv_id, turn, status::BIGINT AS status, attempt::BIGINT AS attempt,
      CASE WHEN status BETWEEN 200 AND 299 THEN 'done' WHEN (status IN (408, 429) OR status BETWEEN 500 AND 599) AND attempt < 2 THEN 'retry' WHEN status IN (404, 408, 429) OR status BETWEEN 500 AND 599 THEN 'fallback' ELSE 'fail' END AS step
    FROM (SELECT conv_id, turn, [200, 204, 301, 400, 401, 404, 408, 429, 500, 503, 599][(conv_id * 7 + turn) % 11 + 1] AS status, (conv_id + turn) % 2 + 1 AS attempt FROM conversations)"""
)
def provider_steps(spark, sf):
    rows = src.table(spark, sf, "conversations")
    codes = F.array(*map(F.lit, (200, 204, 301, 400, 401, 404, 408, 429, 500, 503, 599)))
    rows = rows.select("conv_id", "turn", F.get(codes, F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(11)).cast("int")).cast("long").alias("status"), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(2)) + 1).cast("long").alias("attempt"))
    return rows.withColumn("step", grounding.next_step(F.col("status"), F.col("attempt"), F.lit(2)))


@query(
    """WITH q AS (SELECT (conv_id // 2)::VARCHAR AS id, CASE WHEN turn % 5 = 0 THEN ' ' ELSE 'x' END AS query, (conv_id + turn) % 4 = 1 OR (conv_id + turn) % 4 = 2 AS bare FROM conversations)
    SELECT id AS query_id, 'blank_query' AS problem FROM q WHERE query = ' ' UNION ALL SELECT id, 'no_evidence' FROM q WHERE bare UNION ALL SELECT id, 'repeated_id' FROM q GROUP BY 1 HAVING count(*) > 1"""
)
def query_problems(spark, sf):
    """Faults of a query set: blank questions, evidence that is missing or has an empty group, ids that repeat."""
    k = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))
    groups = F.when(k == 1, F.expr("cast(array() as array<array<int>>)")).when(k == 2, F.expr("array(array(1), cast(array() as array<int>))")).otherwise(F.expr("array(array(1))"))
    rows = src.table(spark, sf, "conversations").select(F.floor(F.col("conv_id") / 2).cast("string").alias("query_id"), F.when(F.pmod("turn", F.lit(5)) == 0, " ").otherwise("x").alias("query"), groups.alias("evidence_groups"))
    return src.query_violations(rows)


@query(
    """SELECT conv_id, turn, CASE k WHEN 0 THEN answer WHEN 1 THEN answer END AS answer, CASE WHEN k <= 1 THEN 'c' || conv_id END AS citations, CASE k WHEN 2 THEN 'token_limit' WHEN 3 THEN 'schema' WHEN 4 THEN 'content_not_json' WHEN 5 THEN 'not_json' WHEN 6 THEN 'no_content' END AS error
    FROM (SELECT conv_id, turn, (conv_id + turn) % 7 AS k, trim(text, ' ' || chr(10) || chr(9)) AS answer FROM conversations WHERE trim(text, ' ' || chr(10) || chr(9)) <> '')"""
)
def completion_parse(spark, sf):
    rows = src.table(spark, sf, "conversations").where(ft.strip(F.col("text")) != "")
    k = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(7))
    content = F.to_json(F.struct(F.col("text").alias("answer"), F.array(F.concat(F.lit("c"), "conv_id")).alias("citations")))
    content = F.when(k == 3, F.to_json(F.struct(F.col("text").alias("answer")))).when(k == 4, F.lit("{answer")).otherwise(content)
    body = F.to_json(F.struct(F.array(F.struct(F.when(k == 2, "length").otherwise("stop").alias("finish_reason"), F.struct(content.alias("content")).alias("message"))).alias("choices")))
    body = F.when(k == 5, F.lit("<html>")).when(k == 6, F.lit('{"choices": []}')).otherwise(body)
    parsed = grounding.parse_completions(rows.select(F.struct("conv_id", "turn").alias("query_id"), body.alias("body")))
    return parsed.select("query_id.conv_id", "query_id.turn", "answer", joined("citations").alias("citations"), "error")


@query("SELECT conv_id, turn, CASE WHEN text IS NULL OR trim(text, ' ' || chr(10) || chr(9)) = '' THEN 'blank' WHEN length(trim(text, ' ' || chr(10) || chr(9))) > 2000 THEN 'too_long' ELSE 'ok' END AS status FROM conversations WHERE role = 'user'")
def question_status(spark, sf):
    return src.table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", ft.query_status(F.col("text")).alias("status"))


_SQUEEZED = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"


@query(f"SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains({_SQUEEZED.format('d.text')}, {_SQUEEZED.format('b.text')})")
def phrase_search(spark, sf):
    docs, bench = src.table(spark, sf, "documents"), src.table(spark, sf, "benchmark")
    found = inspection.phrase_matches(docs.select(F.col("doc_id").alias("key"), "text"), bench.select(F.col("item_id").alias("phrase_id"), F.col("text").alias("phrase")))
    return found.select(F.col("key").alias("doc_id"), F.col("phrase_id").alias("item_id"))


@query(
    f"""WITH {_UNITS}, c AS (SELECT document_id, source_order FROM u WHERE unit_type = 'heading'),
    n AS (SELECT u.document_id, u.source_order, bool_or(u.source_order = c.source_order) AS is_center FROM u JOIN c ON c.document_id = u.document_id AND u.source_order BETWEEN c.source_order - 2 AND c.source_order + 2 GROUP BY ALL)
    SELECT document_id, source_order::BIGINT AS source_order, is_center, unit_type, substr(text, 1, 80) AS preview FROM n JOIN u USING (document_id, source_order)"""
)
def context_windows(spark, sf):
    rows = _units(spark, sf)
    centers = rows.where("unit_type = 'heading'").select(F.lit("heading").alias("label"), "document_id", "source_order")
    near = inspection.context(rows, centers, 2)
    return near.select("document_id", F.col("source_order").cast("long").alias("source_order"), "is_center", "unit_type", ft.preview(F.col("text"), 80).alias("preview"))


@query(
    f"""WITH {_UNITS}, a AS (SELECT item_id AS candidate_id, substr({"lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"}, 1, 24) AS anchor FROM benchmark),
    c AS (SELECT candidate_id, document_id, source_order FROM u JOIN a ON contains(lower(text), anchor)),
    n AS (SELECT c.candidate_id, u.document_id, u.source_order, bool_or(u.source_order = c.source_order) AS is_match FROM u JOIN c ON c.document_id = u.document_id AND u.source_order BETWEEN c.source_order - 2 AND c.source_order + 2 GROUP BY ALL)
    SELECT candidate_id, document_id, source_order::BIGINT AS source_order, is_match, page_number::BIGINT AS page_number FROM n JOIN u USING (document_id, source_order) WHERE page_number IN (1, 2)"""
)
def evidence_windows(spark, sf):
    """Units around those that hold the beginning of a benchmark item, on the first two pages."""
    anchors = src.table(spark, sf, "benchmark").select(F.col("item_id").alias("candidate_id"), F.substring(F.lower(ft.squeeze(F.col("text"))), 1, 24).alias("anchor"))
    near = inspection.on_pages(inspection.evidence_windows(_units(spark, sf), anchors, 2), [1, 2])
    return near.select("candidate_id", "document_id", F.col("source_order").cast("long").alias("source_order"), "is_match", F.col("page_number").cast("long").alias("page_number"))


@query(
    f"""WITH {_UNITS}, g AS (SELECT doc_id AS query_id, doc_id AS document_id, unnest([0, 3, 1000000]) AS unit FROM documents)
    SELECT query_id, unit::BIGINT AS unit, CASE WHEN u.text IS NULL THEN 'no_such_unit' ELSE 'other_page' END AS problem FROM g LEFT JOIN u ON u.document_id = g.document_id AND u.source_order = g.unit WHERE u.text IS NULL OR u.page_number <> 1"""
)
def gold_check(spark, sf):
    docs = src.table(spark, sf, "documents")
    gold = docs.select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("document_id"), F.explode(F.array(*map(F.lit, (0, 3, 1_000_000)))).alias("unit"))
    pages = docs.select(F.col("doc_id").alias("query_id"), F.array(F.lit(1)).alias("gold_pages"))
    return metrics.gold_violations(gold, _units(spark, sf), pages).withColumn("unit", F.col("unit").cast("long"))


@query("SELECT text_sha256, count(*) AS n FROM (SELECT sha256(text) AS text_sha256 FROM documents) GROUP BY 1 HAVING count(*) > 1")
def repeated_texts(spark, sf):
    return metrics.repeated(src.table(spark, sf, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")), "text_sha256")


@query(
    """SELECT doc_id, len(regexp_split_to_array(s, '\\s+')) + 2 AS tokens, sha256(s) AS squeezed, greatest(32, floor(n_chars / 32 + 0.5) * 32)::BIGINT AS snapped, CASE WHEN regexp_matches(s, '^[•▪◦‣–]') THEN true ELSE false END AS bullet
    FROM (SELECT doc_id, n_chars, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents) WHERE s <> ''"""
)
def text_functions(spark, sf):
    t = F.col("text")
    rows = src.table(spark, sf, "documents").where(ft.squeeze(t) != "")
    return rows.select("doc_id", ft.token_count(t).cast("long").alias("tokens"), F.sha2(ft.squeeze(t).cast("binary"), 256).alias("squeezed"), fs.snapped(F.col("n_chars")).cast("long").alias("snapped"), ft.is_bullet(t).alias("bullet"))
