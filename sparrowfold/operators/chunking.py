"""Chunks: units of a section packed greedily into token budgets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_id, token_count
from ..sources.store import Scratch


#: Why a chunk exceeds the hard limit.
CASES = ("heading_only", "unit", "headings_and_unit", "first_unit", "chunk")
_CHUNK = (
    "document_id {0}, chunk_id string, strategy_id string, target_tokens int, token_count int, text string, heading_context array<string>, page_numbers array<int>, "
    "page_start int, page_end int, section_index int, chunk_index int, source_unit_orders array<int>, problem string"
)


def _checked(targets: list[int] | DataFrame, hard_limit: int) -> None:
    if hard_limit <= 0:
        raise ValueError("the hard limit has to be positive")
    if isinstance(targets, list) and any(t <= 0 or t > hard_limit for t in targets):
        raise ValueError("targets have to be positive and within the hard limit")


def pack_section(units: list[dict], target: int, hard_limit: int, count: Callable[[list[str]], list[int]]) -> list[dict]:
    """The chunks of one section (units in order) by a tokenizer, whose counts need not add up: what would be a chunk is
    counted as it would be encoded, headings and all."""
    tokens = lambda heads, own: count(["\n".join([*(t for h in heads if (t := h["text"].strip())), *([body] if (body := "\n".join(u["text"] for u in own).strip()) else [])])])[0]
    split = next((k for k, u in enumerate(units) if u["unit_type"] != "heading"), len(units))
    heads, body = units[:split], units[split:]
    if not body:
        n = tokens([], heads)
        return [{"heads": [], "own": heads, "n": n, "problem": CASES[0] if n > hard_limit else None}] if heads else []
    out, own, held = [], [], 0
    for u in body:
        problem = CASES[1] if count([u["text"]])[0] > hard_limit else None
        n = tokens(heads, [*own, u])
        if own and n > target:
            out[-1]["n"], out[-1]["own"] = held, own
            own, held = [u], tokens(heads, [u])
            out.append({"heads": heads, "problem": problem or (CASES[2] if held > hard_limit else None)})
        else:
            if not out:
                out.append({"heads": heads, "problem": problem or (CASES[3] if n > hard_limit else None)})
            out[-1]["problem"] = out[-1]["problem"] or problem
            own, held = [*own, u], n
    out[-1]["n"], out[-1]["own"] = held, own
    for c in out:
        c["problem"] = c["problem"] or (CASES[4] if c["n"] > hard_limit else None)
    return out


def build_chunks_with(sectioned: DataFrame, targets: list[int], count: Callable[[list[str]], list[int]], hard_limit: int = 512) -> DataFrame:
    """build_chunks() by a tokenizer: count gives the tokens, special ones among them, of each of many texts.

    Units stream through a task sorted by section; a section's units are packed in memory.
    """
    _checked(targets, hard_limit)
    kind = sectioned.schema["document_id"].dataType.simpleString()
    names = [x.split(" ")[0] for x in _CHUNK.split(", ")]
    numbers = pa.list_(pa.int32())
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), numbers, pa.int32(), pa.int32(), pa.int32(), pa.int32(), numbers, pa.string()]

    def packed(document: Any, section: int, units: list[dict]) -> Iterator[tuple]:
        for target in targets:
            for k, c in enumerate(pack_section(units, target, hard_limit, count)):
                both = [*c["heads"], *c["own"]]
                pages, orders = sorted({u["page_number"] for u in both}), list(dict.fromkeys(u["source_order"] for u in both))
                name = f"{document}-t{target}-s{section:04d}-c{k:02d}"
                yield document, name, f"target_{target}", target, c["n"], "\n".join(u["text"] for u in c["own"]), [u["text"] for u in c["heads"]], pages, pages[0], pages[-1], section, k, orders, c["problem"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, units = None, []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [id_kind, *kinds])], names=names)

        for part in batches:
            id_kind, out = part.schema.field("document_id").type, []
            for u in part.to_pylist():
                own = u["document_id"], u["section_index"]
                if own != key:
                    if units:
                        out += packed(*key, units)
                    key, units = own, []
                units.append(u)
            yield batch(out)
        if units:
            yield batch(list(packed(*key, units)))

    keys = ["document_id", "section_index"]
    rows = sectioned.select(*keys, "source_order", "text", "unit_type", "page_number").repartition(*keys).sortWithinPartitions(*keys, "source_order").mapInArrow(run, _CHUNK.format(kind))
    return rows.withColumn("fits", F.max(F.col("problem").isNotNull().cast("int")).over(Window.partitionBy("document_id")) == 0)


def build_chunks(sectioned: DataFrame, targets: list[int] | DataFrame, hard_limit: int = 512) -> DataFrame:
    """Chunks of every section for every target, with the columns `problem` (which of CASES holds, else null) and
    `fits`: false where a chunk of the document, for any target, exceeds hard_limit (such documents are to be set aside
    whole). Tokens are words here; build_chunks_with() takes a tokenizer.

    A chunk takes units while headings and units stay within the target; the first always enters; units are never
    split. A section's leading headings are every chunk's context; a section of headings only is one chunk that has
    them as content. token_count is of headings and text.
    """
    _checked(targets, hard_limit)
    unit = F.struct("source_order", "text", (token_count(F.col("text")) - 2).alias("words"), "unit_type", "page_number")
    whole = sectioned.groupBy("document_id", "section_index").agg(F.sort_array(F.collect_list(unit)).alias("units"))
    # the headings in front; sections made by profile.sections() have no others
    body = F.array_position(F.transform("units", lambda u: u["unit_type"] != "heading"), True).cast("int")
    leading = F.when(body == 0, F.size("units")).otherwise(body - 1)
    heads, content = F.slice("units", F.lit(1), leading), F.slice("units", leading + 1, F.size("units"))
    rows = whole.select("document_id", "section_index", heads.alias("heads"), content.alias("content"))
    alone = F.size("content") == 0
    rows = rows.select("document_id", "section_index", F.when(alone, F.array().cast(rows.schema["heads"].dataType)).otherwise(F.col("heads")).alias("heads"), F.when(alone, F.col("heads")).otherwise(F.col("content")).alias("content"), alone.alias("alone"))
    if isinstance(targets, DataFrame):
        over = F.raise_error(F.lit("targets have to be within the hard limit")).cast("int")
        rows = rows.crossJoin(F.broadcast(targets.select(F.when(F.col("target") <= hard_limit, F.col("target").cast("int")).otherwise(over).alias("target"))))  # four rows at most
    else:
        rows = rows.withColumn("target", F.explode(F.array(*map(F.lit, targets))))
    rows = rows.withColumn("base", F.aggregate("heads", F.lit(2), lambda s, h: s + h["words"]))

    def step(state, unit):
        full = (state["n"] > 0) & ~F.col("alone") & (F.col("base") + state["words"] + unit["words"] > F.col("target"))
        starts = F.when(full, F.concat(state["starts"], F.array(state["n"]))).otherwise(state["starts"])
        words = F.when(full, unit["words"]).otherwise(state["words"] + unit["words"])
        return F.struct(starts.alias("starts"), words.alias("words"), (state["n"] + 1).alias("n")).cast(kind)

    kind = "struct<starts: array<int>, words: int, n: int>"
    begin = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).alias("words"), F.lit(0).alias("n")).cast(kind)
    rows = rows.withColumn("starts", F.aggregate("content", begin, step, lambda s: s["starts"]))
    rows = rows.select("*", F.posexplode("starts").alias("chunk_index", "at"))
    end = F.coalesce(F.get("starts", F.col("chunk_index") + 1), F.size("content"))
    rows = rows.withColumn("own", F.slice("content", F.col("at") + 1, end - F.col("at")))
    both = F.concat("heads", "own")
    pages = F.array_sort(F.array_distinct(F.transform(both, lambda u: u["page_number"])))
    tokens = F.col("base") + F.aggregate("own", F.lit(0), lambda s, u: s + u["words"])
    large = F.exists("own", lambda u: u["words"] + 2 > hard_limit)
    first = F.col("base") + F.col("own")[0]["words"] > hard_limit
    problem = (
        F.when(F.col("alone"), F.when(tokens > hard_limit, CASES[0])).when(large, CASES[1])
        .when(first, F.when(F.col("chunk_index") > 0, CASES[2]).otherwise(CASES[3])).when(tokens > hard_limit, CASES[4])
    )
    out = rows.select(
        "document_id", chunk_id(F.col("document_id"), F.col("target"), F.col("section_index"), F.col("chunk_index")).alias("chunk_id"), F.concat(F.lit("target_"), "target").alias("strategy_id"),
        F.col("target").alias("target_tokens"), tokens.cast("int").alias("token_count"),
        F.array_join(F.transform("own", lambda u: u["text"]), "\n").alias("text"), F.transform("heads", lambda u: u["text"]).alias("heading_context"),
        pages.alias("page_numbers"), F.element_at(pages, 1).alias("page_start"), F.element_at(pages, -1).alias("page_end"), "section_index", "chunk_index",
        F.array_distinct(F.transform(both, lambda u: u["source_order"])).alias("source_unit_orders"), problem.alias("problem"),
    )
    return out.withColumn("fits", F.max(F.col("problem").isNotNull().cast("int")).over(Window.partitionBy("document_id")) == 0)


def rejected(chunks: DataFrame) -> DataFrame:
    """document_id, largest_chunk, problems (sorted, distinct) of documents that don't fit the hard limit."""
    return chunks.where(~F.col("fits")).groupBy("document_id").agg(F.max("token_count").alias("largest_chunk"), F.array_sort(F.collect_set("problem")).alias("problems"))


def accepted(chunks: DataFrame) -> DataFrame:
    return chunks.where("fits").drop("fits", "problem")


def strict(chunks: DataFrame, hard_limit: int = 512) -> DataFrame:
    """Chunks, as an error that names the case where a chunk exceeds the hard limit."""
    error = F.raise_error(F.concat(F.lit("over the hard limit: "), "chunk_id", F.lit(", "), "problem")).cast("int")
    return chunks.withColumn("token_count", F.when(F.col("problem").isNotNull(), error).otherwise(F.col("token_count")))


def coverage_marks(units: DataFrame, chunks: DataFrame) -> DataFrame:
    """strategy_id, document_id, source_order, due, held: for every strategy of chunks, the units of the documents that it
    has chunks of (due), and the orders that its chunks hold. Chunks are made once; one aggregation sets both against each other."""
    orders = chunks.select("strategy_id", "document_id", F.explode_outer("source_unit_orders").alias("source_order"))
    marks = Scratch(chunks.sparkSession, "coverage").save(orders, "orders")
    made = marks.select("strategy_id", "document_id").distinct()
    mark = lambda rows, due: rows.select("strategy_id", "document_id", "source_order", F.lit(due).alias("due"), F.lit(not due).alias("held"))
    both = mark(made.join(units.select("document_id", "source_order"), "document_id"), True).unionByName(mark(marks.where("source_order is not null"), False))
    return both.groupBy("strategy_id", "document_id", "source_order").agg(F.max("due").alias("due"), F.max("held").alias("held"))


def coverage_gaps(units: DataFrame, chunks: DataFrame) -> DataFrame:
    """strategy_id, document_id, source_order, side: units in no chunk (lost) and orders in chunks that are no unit (unknown).

    For every strategy of chunks; no row is what should come out.
    """
    rows = coverage_marks(units, chunks).where("due <> held")
    return rows.select("strategy_id", "document_id", "source_order", F.when(F.col("due"), "lost").otherwise("unknown").alias("side"))


def strategy_profile(chunks: DataFrame) -> DataFrame:
    """For each strategy: chunks, mean, median and largest tokens, and how many exceed the soft target."""
    return chunks.groupBy("strategy_id", "target_tokens").agg(
        F.count("*").alias("chunk_count"), F.round(F.avg("token_count"), 2).alias("mean_tokens"), F.percentile("token_count", F.lit(0.5)).alias("median_tokens"),
        F.max("token_count").alias("max_tokens"), F.count(F.when(F.col("token_count") > F.col("target_tokens"), 1)).alias("over_target"),
    )
