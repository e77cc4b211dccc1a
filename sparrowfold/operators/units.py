"""From positioned lines to headings, paragraphs and list items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import boilerplate_key, is_bullet, join_lines, strip, without_bullet

# Fixed values.
HEAD_Y, FOOT_Y, REPEATED_PAGES = 50.0, 735.0, 3
HEADING_LENGTH, LARGER, BOLD_LARGER = 140, 1.4, 0.4


def in_margin(bbox: Column) -> Column:
    return (bbox["y1"] <= HEAD_Y) | (bbox["y0"] >= FOOT_Y)


def body_font(lines: DataFrame) -> DataFrame:
    """document_id, body_font_size: the size, in tenths, of most characters; on a tie, the one met first."""
    sizes = lines.groupBy("document_id", F.round("font_size", 1).alias("size")).agg(F.sum(F.length("text")).alias("chars"), F.min("line_no").alias("first"))
    return sizes.groupBy("document_id").agg(F.max_by("size", F.struct("chars", -F.col("first"))).alias("body_font_size"))


def repeated_boilerplate(lines: DataFrame) -> DataFrame:
    """document_id, key: texts that stand in a margin of several pages."""
    keyed = lines.where(in_margin(F.col("bbox"))).select("document_id", boilerplate_key(F.col("text")).alias("key"), "page_number").distinct()
    return keyed.groupBy("document_id", "key").count().where(F.col("count") >= REPEATED_PAGES).select("document_id", "key")


def without_boilerplate(lines: DataFrame) -> DataFrame:
    """Lines that are no page number (one to three digits alone, anywhere) and no repeated margin text."""
    key = boilerplate_key(F.col("text"))
    rows = lines.where(~strip(F.col("text")).rlike(r"\A\d{1,3}\z")).withColumn("_key", F.when(in_margin(F.col("bbox")), key))
    hits = repeated_boilerplate(lines).withColumnRenamed("key", "_key")
    return rows.join(hits, ["document_id", "_key"], "left_anti").select(lines.columns)


def is_heading(text: Column, font_size: Column, is_bold: Column, body: Column) -> Column:
    s = strip(text)
    large = (font_size >= body + LARGER) | ((font_size >= body + BOLD_LARGER) & is_bold)
    return (s != "") & (F.length(s) <= HEADING_LENGTH) & ~is_bullet(text) & large


def reconstruct(lines: DataFrame) -> DataFrame:
    """Units of each document: document_id, source_order, text, unit_type, page_number, bbox, font_size.

    A heading line is a unit. A bullet opens a list item. Another line goes on with the open unit of its page and
    block, else opens a paragraph. A bullet without text stays open over headings and takes up the next such line.
    Units stay within a page, so windows are by page; a document's order comes from counts by page.
    """
    body = body_font(lines)
    rows = without_boilerplate(lines).join(body, "document_id")
    rows = rows.withColumn("bare", F.when(is_bullet(F.col("text")), without_bullet(F.col("text"))).otherwise(strip(F.col("text"))))
    kind = (
        F.when(is_heading(F.col("text"), F.col("font_size"), F.col("is_bold"), F.col("body_font_size")), "H")
        .when(is_bullet(F.col("text")), F.when(F.col("bare") == "", "E").otherwise("L"))
        .otherwise("P")
    )
    rows = rows.withColumn("kind", kind).where("kind <> 'P' or bare <> ''")
    w = Window.partitionBy("document_id", "page_number").orderBy("line_no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("kind") != "H", F.struct("kind", "block_index")), ignorenulls=True).over(before)
    rows = rows.withColumn("open", last).withColumn("above", F.lag("kind").over(w))
    goes_on = (F.col("kind") == "P") & F.col("open").isNotNull() & (F.col("open.block_index") == F.col("block_index")) & ((F.col("above") != "H") | (F.col("open.kind") == "E"))
    rows = rows.withColumn("opens", ((F.col("kind") != "H") & ~F.coalesce(goes_on, F.lit(False))).cast("int"))
    rows = rows.withColumn("gid", F.when(F.col("kind") == "H", -F.row_number().over(w)).otherwise(F.sum("opens").over(w)))
    line = F.struct("line_no", "kind", "bare", "font_size")
    units = rows.groupBy("document_id", "page_number", "gid").agg(
        F.sort_array(F.collect_list(line)).alias("lines"), F.min(F.when(F.col("kind") != "E", F.col("line_no"))).alias("anchor"),
        F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1"),
    ).where("anchor is not null")
    counts = units.groupBy("document_id", "page_number").agg(F.count("*").alias("n"), F.min("anchor").alias("at"))
    first = F.sum("n").over(Window.partitionBy("document_id").orderBy("at")) - F.col("n")
    units = units.join(counts.select("document_id", "page_number", first.alias("first")), ["document_id", "page_number"])
    order = F.col("first") + F.row_number().over(Window.partitionBy("document_id", "page_number").orderBy("anchor")) - 1
    head = F.col("lines")[0]["kind"]
    return units.select(
        "document_id", order.cast("int").alias("source_order"), join_lines(F.transform("lines", lambda x: x["bare"])).alias("text"),
        F.when(head == "H", "heading").when(head == "P", "paragraph").otherwise("list_item").alias("unit_type"), "page_number",
        F.struct("x0", "y0", "x1", "y1").alias("bbox"), F.col("lines")[0]["font_size"].alias("font_size"),
    )
