"""Sections, and what a corpus's lengths look like."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import snapped
from ..functions.text import preview, token_count

TYPES = ("heading", "paragraph", "list_item")
#: How a text's tokens are counted: by words, or as text.token_counter() gives it.
Tokens = Callable[[Column], Column]


def _section_tokens(sectioned: DataFrame, tokens: Tokens) -> DataFrame:
    """document_id, section_index, n: tokens of each section's text. Words add up; a tokenizer counts the joined text."""
    keys = ["document_id", "section_index"]
    if tokens is token_count:
        return sectioned.groupBy(*keys).agg((F.sum(token_count(F.col("text")) - 2) + 2).cast("long").alias("n"))
    return section_texts(sectioned).select(*keys, tokens(F.col("text")).cast("long").alias("n"))


#: Places in a document that one segment of its scan covers.
SEGMENT = 4096


def sections(units: DataFrame) -> DataFrame:
    """Units with section_index: a heading starts a section unless it follows a heading of the same page.

    A scan in two levels, so that a document is as many groups as it has segments of its order: starts are counted
    within segments, and what a segment begins with (its number of sections before, its last unit before) is carried
    over a row a segment.
    """
    keys = ["document_id", "_segment"]
    rows = units.withColumn("_segment", F.floor(F.col("source_order") / SEGMENT))
    w = Window.partitionBy(*keys).orderBy("source_order")
    own = F.struct("unit_type", "page_number")
    starts = lambda this, before: (this["unit_type"] == "heading") & ((before["unit_type"] != "heading") | (before["page_number"] != this["page_number"]))
    # of a segment's first unit that is not known yet
    rows = rows.withColumn("_unit", own).withColumn("_before", F.lag(own).over(w))
    rows = rows.withColumn("_starts", F.when(F.col("_before").isNotNull(), F.coalesce(starts(F.col("_unit"), F.col("_before")), F.lit(False)).cast("int")).otherwise(0)).withColumn("_running", F.sum("_starts").over(w))
    ends = rows.groupBy(*keys).agg(F.sum("_starts").alias("_n"), F.min_by("_unit", "source_order").alias("_first"), F.max_by("_unit", "source_order").alias("_last"))
    along = Window.partitionBy("document_id").orderBy("_segment")
    carried = F.lag("_last").over(along)
    ends = ends.withColumn("_opens", F.when(carried.isNull(), 1).otherwise(F.coalesce(starts(F.col("_first"), carried), F.lit(False)).cast("int")))
    base = F.sum(F.col("_n") + F.col("_opens")).over(along) - F.col("_n")
    ends = ends.select(*(F.col(c).alias(f"{c}_") for c in keys), base.alias("_base"))
    index = F.col("_base") + F.col("_running") - 1
    same = (F.col("document_id").eqNullSafe(F.col("document_id_"))) & (F.col("_segment") == F.col("_segment_"))
    return rows.join(ends, same).withColumn("section_index", index.cast("int")).select(*units.columns, "section_index")


def section_spans(sectioned: DataFrame, tokens: Tokens = token_count) -> DataFrame:
    """A row a section: first and last page, units, first heading's preview, tokens of the text joined by line feeds."""
    head = F.when(F.col("unit_type") == "heading", F.struct("source_order", "text"))
    keys = ["document_id", "section_index"]
    spans = [F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"), F.count("*").alias("unit_count"), preview(F.min(head)["text"]).alias("heading_preview")]
    if tokens is token_count:
        return sectioned.groupBy(*keys).agg(*spans, (F.sum(token_count(F.col("text")) - 2) + 2).cast("long").alias("token_count"))
    return sectioned.groupBy(*keys).agg(*spans).join(_section_tokens(sectioned, tokens).withColumnRenamed("n", "token_count"), keys)


def oversized_sections(sectioned: DataFrame, limit: int = 512, tokens: Tokens = token_count) -> DataFrame:
    """Sections whose text doesn't fit a model: document_id, section_index, token_count."""
    return _section_tokens(sectioned, tokens).where(F.col("n") > limit).withColumnRenamed("n", "token_count")


def section_texts(sectioned: DataFrame) -> DataFrame:
    """document_id, section_index, text: the texts that are not blank, a line each."""
    return sectioned.where(F.trim("text") != "").groupBy("document_id", "section_index").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source_order", "text"))), lambda x: x["text"]), "\n").alias("text"))


def length_summary(n: Column) -> list[Column]:
    """count, min, mean, median, quartiles, p90, p95, max of a column, in 2 decimals; zeros for no rows. Percentiles are exact."""
    q = F.percentile(n, F.array(*map(F.lit, (0.5, 0.25, 0.75, 0.9, 0.95))))
    named = [("min", F.min(n)), ("mean", F.avg(n)), *((x, q[k]) for k, x in enumerate(("median", "p25", "p75", "p90", "p95"))), ("max", F.max(n))]
    return [F.count(n).alias("count"), *(F.coalesce(F.round(c.cast("double"), 2), F.lit(0.0)).alias(x) for x, c in named)]


def token_profile(units: DataFrame, tokens: Tokens = token_count) -> DataFrame:
    """Token lengths of all units (unit_type: all) and by type, in one pass by grouping sets."""
    rows = units.select("unit_type", tokens(F.col("text")).alias("n"))
    grouped = rows.groupingSets([[], ["unit_type"]], "unit_type").agg(F.grouping("unit_type").alias("_all"), *length_summary(F.col("n")))
    found = grouped.withColumn("unit_type", F.when(F.col("_all") == 1, "all").otherwise(F.col("unit_type"))).drop("_all")
    # without rows there is no group at all; the whole has its zeros even so
    whole = units.sparkSession.range(1).select(F.lit("all").alias("unit_type"))
    return whole.join(found, "unit_type", "full").select("unit_type", *(F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in found.dtypes if c != "unit_type"))


def document_profile(units: DataFrame, documents: DataFrame) -> DataFrame:
    """For each of documents (document_id, page_count, body_font_size): units by type and the pages without any."""
    by = units.groupBy("document_id").agg(F.count("*").alias("unit_count"), *(F.count(F.when(F.col("unit_type") == t, 1)).alias(f"{t}_count") for t in TYPES), F.collect_set("page_number").alias("_pages"))
    none = F.array().cast("array<int>")
    missing = F.array_except(F.sequence(F.lit(1), F.col("page_count").cast("int")), F.coalesce("_pages", none))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("unit_count", *(f"{t}_count" for t in TYPES))]
    return documents.join(by, "document_id", "left").select("document_id", "page_count", "body_font_size", *zero, F.when(F.col("page_count") > 0, missing).otherwise(none).alias("pages_without_units"))


def candidate_targets(sectioned: DataFrame, most: int = 512, tokens: Tokens = token_count) -> DataFrame:
    """target: token budgets that the corpus's lengths suggest, rounded to steps of 32, none above `most`."""
    q = _section_tokens(sectioned, tokens).agg(F.percentile("n", F.array(*map(F.lit, (0.5, 0.75, 0.9, 0.95)))).alias("q"))
    p = sectioned.where("unit_type = 'paragraph'").select(tokens(F.col("text")).alias("n")).agg(F.percentile("n", F.lit(0.95)).alias("p"))
    raw = q.join(p, F.lit(True), "full").select(F.array(F.greatest(F.col("q")[0], "p"), *(F.greatest(F.col("q")[k], F.lit(1.0)) for k in (1, 2, 3))).alias("v"))
    return raw.select(F.explode("v").alias("v")).where("v > 0").select(F.least(snapped(F.col("v")), F.lit(most)).alias("target")).distinct()


def oversized(units: DataFrame, limit: int = 512, tokens: Tokens = token_count) -> DataFrame:
    """Units whose tokens don't fit a model: document_id, source_order, token_count, preview."""
    rows = units.select("document_id", "source_order", tokens(F.col("text")).alias("token_count"), preview(F.col("text")).alias("preview"))
    return rows.where(F.col("token_count") > limit)
