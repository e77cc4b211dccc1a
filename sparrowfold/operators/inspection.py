"""Looking into a corpus: phrases, context around units, page and font statistics."""

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeeze
from ..sources.store import Scratch

#: Characters of the phrases that one automaton is built from; more phrases are several automata.
PHRASE_CHARS = 50_000_000

_BUILT: dict = {}


def _automaton(folder: str):
    """(automaton, phrase -> ids) of a shard of phrases, read by the executor; a worker keeps one."""
    if folder not in _BUILT:
        import ahocorasick
        from pyarrow import fs, parquet

        _BUILT.clear()
        store, path = fs.FileSystem.from_uri(folder)
        table = parquet.read_table(path, filesystem=store, columns=["phrase_id", "p"])
        by_text: dict[str, list] = {}
        for key, p in zip(table["phrase_id"].to_pylist(), table["p"].to_pylist()):
            by_text.setdefault(p, []).append(key)
        words = ahocorasick.Automaton()
        for p in by_text:
            words.add_word(p, p)
        words.make_automaton()
        _BUILT[folder] = words, by_text
    return _BUILT[folder]


def phrase_matches(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(key, phrase_id) of every text that holds a phrase, both in lower case with white space squeezed.

    texts: key, text; phrases: phrase_id, phrase. One pass over the texts finds all phrases of an automaton at once,
    instead of a comparison for each pair; beyond PHRASE_CHARS the phrases are dealt into shards, each with a pass of
    its own, so neither the driver nor a worker ever holds more. Null and blank phrases match nothing.
    """
    scratch = Scratch(texts.sparkSession, "phrases")
    wanted = scratch.save(phrases.select("phrase_id", F.lower(squeeze(F.col("phrase"))).alias("p")).where("p <> ''").distinct(), "wanted")
    kinds = {f.name: f.dataType.simpleString() for f in [*texts.schema, *phrases.schema]}
    schema = f"key {kinds['key']}, phrase_id {kinds['phrase_id']}"
    total = wanted.agg(F.sum(F.length("p"))).first()[0] or 0
    shards = -(-total // PHRASE_CHARS)
    if shards > 1:
        dealt = wanted.withColumn("shard", F.pmod(F.xxhash64("p"), F.lit(shards)))
        dealt.repartition(shards, "shard").write.partitionBy("shard").parquet(f"{scratch.root}/dealt")

    def search(folder: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            words, by_text = _automaton(folder)
            for pdf in batches:
                out = []
                for key, text in zip(pdf["key"], pdf["t"]):
                    if text:
                        out += [(key, i) for p in {p for _, p in words.iter(text)} for i in by_text[p]]
                yield pd.DataFrame(out, columns=["key", "phrase_id"])

        return run

    rows = texts.select("key", F.lower(squeeze(F.col("text"))).alias("t"))
    if shards <= 1:
        return rows.mapInPandas(search(f"{scratch.root}/wanted"), schema) if total else rows.sparkSession.createDataFrame([], schema)
    found = [r.shard for r in texts.sparkSession.read.parquet(f"{scratch.root}/dealt").select("shard").distinct().collect()]
    return reduce(DataFrame.unionByName, [rows.mapInPandas(search(f"{scratch.root}/dealt/shard={k}"), schema) for k in found])


def candidates(texts: DataFrame, anchors: DataFrame) -> DataFrame:
    """(key, candidate_id) where a text holds any of a candidate's anchors (candidate_id, anchor)."""
    named = anchors.select(F.struct("candidate_id", "anchor").alias("a")).select(F.to_json("a").alias("phrase_id"), F.col("a.anchor").alias("phrase"), F.col("a.candidate_id").alias("candidate_id"))
    hits = phrase_matches(texts, named.select("phrase_id", "phrase"))
    return hits.join(named.select("phrase_id", "candidate_id").distinct(), "phrase_id").select("key", "candidate_id").distinct()


def context(units: DataFrame, centers: DataFrame, radius: int) -> DataFrame:
    """Units within `radius` of a center of the same document and label, each once, with is_center.

    centers: label, document_id, source_order. A range join by buckets as wide as a window: a center's window, less
    what the center before it covers, meets two buckets at most, whatever the radius, so a unit meets one window alone.
    """
    width = 2 * radius + 1
    at = centers.select("label", "document_id", F.col("source_order").alias("center")).distinct()
    before = F.lag("center").over(Window.partitionBy("label", "document_id").orderBy("center"))
    high = F.col("center") + radius
    windows = at.select("label", "document_id", F.greatest(F.col("center") - radius, F.coalesce(before + radius + 1, F.col("center") - radius)).alias("low"), high.alias("high"))
    bucket = lambda c: F.floor(c / width)
    windows = windows.withColumn("bucket", F.explode(F.array_distinct(F.array(bucket(F.col("low")), bucket(F.col("high"))))))
    near = windows.withColumnRenamed("document_id", "_document").join(
        units.withColumn("_bucket", bucket(F.col("source_order"))), (F.col("_document") == F.col("document_id")) & (F.col("bucket") == F.col("_bucket")) & F.col("source_order").between(F.col("low"), F.col("high"))
    )
    own = at.select("label", "document_id", F.col("center").alias("source_order"), F.lit(True).alias("is_center"))
    keys = ["label", "document_id", "source_order"]
    return near.select("label", *units.columns).join(own, keys, "left").withColumn("is_center", F.coalesce("is_center", F.lit(False)))


def evidence_windows(units: DataFrame, anchors: DataFrame, radius: int) -> DataFrame:
    """For each candidate (anchors: candidate_id, anchor) the units that hold one of its anchors, and those within
    `radius` of them in their document, each once: candidate_id, is_match, and the unit's columns."""
    key = F.to_json(F.struct("document_id", "source_order"))
    hits = candidates(units.select(key.alias("key"), "text"), anchors)
    centers = units.select(key.alias("key"), "document_id", "source_order").join(hits, "key").select(F.col("candidate_id").alias("label"), "document_id", "source_order")
    return context(units, centers, radius).withColumnsRenamed({"label": "candidate_id", "is_center": "is_match"})


def page_statistics(lines: DataFrame) -> DataFrame:
    """Characters by page, then over pages: pages, min, median, max, total, and pages with fewer than 100."""
    by_page = lines.groupBy("document_id", "page_number").agg(F.sum(F.length("text")).alias("n"))
    return by_page.agg(F.count("*").alias("pages"), F.min("n").alias("min_chars"), F.percentile("n", F.lit(0.5)).alias("median_chars"), F.max("n").alias("max_chars"), F.sum("n").alias("total_chars"), F.count(F.when(F.col("n") < 100, 1)).alias("low_text_pages"))


def low_text_pages(lines: DataFrame, least: int = 100) -> DataFrame:
    return lines.groupBy("document_id", "page_number").agg(F.sum(F.length("text")).alias("n_chars")).where(F.col("n_chars") < least)


def font_histogram(lines: DataFrame, top: int = 12) -> DataFrame:
    """The sizes (in tenths) of most characters."""
    return lines.groupBy(F.round("font_size", 1).alias("font_size")).agg(F.sum(F.length("text")).alias("n_chars")).orderBy(F.desc("n_chars"), "font_size").limit(top)


def on_pages(units: DataFrame, pages: list[int]) -> DataFrame:
    return units.where(F.col("page_number").isin(pages))
