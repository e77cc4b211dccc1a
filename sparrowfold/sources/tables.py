"""Adapters from raw tables to lines and units, and readers and writers of the engine's artifacts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import join_spans, squeeze, strip
from .store import Store, Version

LINES = (
    "document_id string, line_no long, text string, page_number int, block_index int, line_index int, "
    "bbox struct<x0: double, y0: double, x1: double, y1: double>, font_size double, is_bold boolean"
)
GOLD = "query_id string, query string, category string, evidence_groups array<array<int>>, gold_pages array<int>"
NEGATIVES = "query_id string, query string, category string"
#: Words of a line that still reads as a heading, and lines to a page, for plain documents.
HEADING_WORDS, PAGE_LINES = 3, 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_units(documents: DataFrame) -> DataFrame:
    """document_id, source_order, text, unit_type, page_number: each line with a word is a unit, a short one a heading.

    Lines are dealt with inside their row, so this takes no shuffle. Null texts have no units.
    """
    numbered = F.transform(F.split("text", "\n"), lambda line, n: F.struct(n.alias("n"), squeeze(line).alias("text")))
    lines = documents.select(F.col("doc_id").cast("long").alias("document_id"), F.posexplode(F.filter(numbered, lambda x: x["text"] != "")).alias("source_order", "line"))
    return lines.select(
        "document_id", "source_order", F.col("line.text").alias("text"),
        F.when(F.size(F.split("line.text", " ")) <= HEADING_WORDS, "heading").otherwise("paragraph").alias("unit_type"),
        (F.floor(F.col("line.n") / PAGE_LINES) + 1).cast("int").alias("page_number"),
    )


#: Blocks of a page, and blocks and lines of a page of spans, that line numbers leave room for.
PAGE_BLOCKS, SPAN_STEP = 10_000_000, 1_000_000
# Tags that open a block, and those whose text is none of the page's.
OPENERS, UNSEEN = ("li", "h1", "p", "div", "footer", "script", "style", "title"), ("script", "style", "title")


def page_lines(pages: DataFrame) -> DataFrame:
    """LINES of raw html pages: a line a block (li, h1, p, div, footer), a document a host, a page a page.

    What stands in nav is a bulleted line in the head region, what stands in footer lies in the foot region; h1 is
    large and bold. Scripts, styles and titles are left out. A page's parts are dealt with inside its row, without a
    shuffle: a block is what lies between two opening tags.
    """
    tag = lambda part: F.lower(F.regexp_extract(part, r"\A(/?[A-Za-z][A-Za-z0-9]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_extract("url", r"://([^/?#]*)", 1).alias("document_id"), F.split("html", "<").alias("parts"))
    rows = rows.withColumn("opens", F.filter(F.transform("parts", lambda p, n: F.struct(tag(p).alias("kind"), n.alias("at"))), lambda x: x["kind"].isin(*OPENERS)))

    def block(x: Column, n: Column) -> Column:
        end = F.coalesce(F.get("opens", n + 1)["at"], F.size("parts"))
        texts = F.transform(F.slice("parts", x["at"] + 1, end - x["at"]), lambda p: squeeze(F.regexp_replace(p, r"\A[^>]*>?", "")))
        return F.struct((n + 1).cast("long").alias("block"), x["kind"].alias("kind"), F.when(~x["kind"].isin(*UNSEEN), F.array_join(F.filter(texts, lambda t: t != ""), " ")).alias("text"))

    blocks = rows.select("page_id", "document_id", F.explode(F.filter(F.transform("opens", block), lambda b: b["text"] != "")).alias("b")).select("page_id", "document_id", "b.*")
    y0 = F.when(F.col("kind") == "li", 30.0).when(F.col("kind") == "footer", 740.0).otherwise(F.lit(100.0))
    big = F.col("kind") == "h1"
    return blocks.select(
        "document_id", (F.col("page_id") * PAGE_BLOCKS + F.col("block")).alias("line_no"), F.when(F.col("kind") == "li", F.concat(F.lit("• "), F.col("text"))).otherwise(F.col("text")).alias("text"),
        (F.col("page_id") + 1).cast("int").alias("page_number"), F.col("block").cast("int").alias("block_index"), F.lit(0).alias("line_index"),
        F.struct(F.lit(50.0).alias("x0"), y0.alias("y0"), F.lit(550.0).alias("x1"), (y0 + 10).alias("y1")).alias("bbox"), F.when(big, 18.0).otherwise(11.0).alias("font_size"), big.alias("is_bold"),
    )


def span_lines(spans: DataFrame) -> DataFrame:
    """LINES of positioned spans (document_id, page_number, block_index, line_index, span_index, text, x0, y0, x1, y1, size, font).

    Blank lines are left out; a line is bold if one of its spans is, and as large as its largest.
    """
    from ..functions.text import is_bold_font

    ordered = F.sort_array(F.collect_list(F.struct("span_index", "text", "x0", "x1", "size")))
    lines = spans.where(strip(F.col("text")) != "").groupBy("document_id", "page_number", "block_index", "line_index").agg(
        ordered.alias("s"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("size").alias("font_size"), F.bool_or(is_bold_font(F.col("font"))).alias("is_bold")
    )
    line_no = ((F.col("page_number").cast("long") * SPAN_STEP + F.col("block_index")) * SPAN_STEP + F.col("line_index")).alias("line_no")
    return lines.select("document_id", line_no, join_spans(F.col("s")).alias("text"), "page_number", "block_index", "line_index", F.struct("x0", "y0", "x1", "y1").alias("bbox"), "font_size", "is_bold").where("text <> ''")


def file_lines(spark: SparkSession, path: str, parse: Callable[[str, bytes], Iterator[dict]]) -> DataFrame:
    """LINES of files by a parser for their format: parse(path, content) yields rows as dicts, on the executors. A file
    without text raises."""
    import pandas as pd

    names = [f.name for f in T._parse_datatype_string(LINES).fields]

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows = list(parse(path, bytes(content)))
                if not any((r["text"] or "").strip() for r in rows):
                    raise ValueError(f"no text in {path}")
                yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, LINES)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_queries(spark: SparkSession, path: str, negative: bool = False) -> DataFrame:
    """Rows of a query file {queries: [...]}; a malformed file raises."""
    item = NEGATIVES if negative else GOLD
    whole = spark.read.schema(f"version string, queries array<struct<{', '.join(f.replace(' ', ': ', 1) for f in item.split(', '))}>>").json(path, multiLine=True, mode="FAILFAST")
    return whole.select(F.inline("queries"))


def query_violations(queries: DataFrame, negative: bool = False) -> DataFrame:
    """query_id, problem: what makes a query set unfit; no row for a good one. An empty set is a problem too."""
    blank = lambda c: F.coalesce(strip(F.col(c)) == "", F.lit(True))
    checks = [("blank_id", blank("query_id")), ("blank_query", blank("query"))]
    checks += [("blank_category", blank("category"))] if negative else [("no_evidence", F.coalesce(F.size("evidence_groups") < 1, F.lit(True)) | F.exists("evidence_groups", lambda g: F.coalesce(F.size(g) < 1, F.lit(True))))]
    rows = queries.select("query_id", F.explode(F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in checks)), lambda x: x.isNotNull())).alias("problem"))
    twice = queries.groupBy("query_id").count().where("count > 1").select("query_id", F.lit("repeated_id").alias("problem"))
    none = queries.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("query_id"), F.lit("empty").alias("problem"))
    return rows.unionByName(twice).unionByName(none)


#: What an index says about itself, a row a strategy, beside its rows.
ABOUT = "document_id string, document_sha256 string, embedding_model string, embedding_dimension int, strategy_id string, target_tokens int, chunk_count long"


def _about(index: DataFrame, document_id: str | None, document_sha256: str | None, embedding_model: str | None) -> DataFrame:
    target = F.first("target_tokens") if "target_tokens" in index.columns else F.lit(None)
    rows = index.groupBy("strategy_id").agg(F.max(F.size("embedding")).cast("int").alias("embedding_dimension"), target.cast("int").alias("target_tokens"), F.count("*").alias("chunk_count"))
    named = {"document_id": document_id, "document_sha256": document_sha256, "embedding_model": embedding_model}
    rows = rows.select(*(F.lit(v).cast("string").alias(k) for k, v in named.items()), "embedding_dimension", "strategy_id", "target_tokens", "chunk_count")
    return rows.select(*(f.split(" ")[0] for f in ABOUT.split(", ")))


def write_index(index: DataFrame, path: str, document_id: str | None = None, document_sha256: str | None = None, embedding_model: str | None = None) -> Version:
    """Publishes chunks with embeddings (a folder a strategy) and a row a strategy about them, as one version of the store
    at path: whoever reads sees the old version until both tables stand, and the new one from then on."""
    store = Store(index.sparkSession, path)
    folder = store.write({"rows": index}, {"rows": "strategy_id"})
    # what is said is said of the rows that were written
    written = index.sparkSession.read.parquet(f"{store.root}/{folder}/rows")
    _about(written, document_id, document_sha256, embedding_model).coalesce(1).write.parquet(f"{store.root}/{folder}/about")
    return store.commit(folder)


def current(spark: SparkSession, path: str) -> Version:
    """The version that a query reads from, for all its tables; the functions below take it in place of a path."""
    return Store(spark, path).current()


def _version(spark: SparkSession, path: str | Version) -> Version:
    return path if isinstance(path, Version) else current(spark, path)


def index_about(spark: SparkSession, path: str | Version) -> DataFrame:
    """What was written about an index."""
    return _version(spark, path).table("about")


def read_index(spark: SparkSession, path: str | Version, strategy_id: str | None = None) -> DataFrame:
    """The index, or one strategy of it (only that folder is read)."""
    df = _version(spark, path).table("rows").withColumn("strategy_id", F.col("strategy_id").cast("string"))
    return df if strategy_id is None else df.where(F.col("strategy_id") == strategy_id)


def load_index(spark: SparkSession, path: str | Version, strategy_id: str) -> DataFrame:
    """One strategy's index, held against what was written about it: count, vector length, sound vectors and ids."""
    from ..operators.manifest import Incompatible, index_facts, mismatches, require_none

    version = _version(spark, path)
    index, about = read_index(spark, version, strategy_id), index_about(spark, version).where(F.col("strategy_id") == strategy_id)
    if about.isEmpty():
        raise Incompatible(f"nothing is known about {strategy_id}")
    require_none(mismatches(about, index_facts(index.withColumn("target_tokens", F.lit(None).cast("int")) if "target_tokens" not in index.columns else index), ("chunk_count", "embedding_dimension", "strategy_id")), index_violations(index))
    return index


def promote(spark: SparkSession, path: str, strategy_id: str, selected: str) -> Version:
    """Publishes one strategy's index, and what is said about it, as the selected one; raises if there is none.

    Rows, what is said and selected.json are one version: a promotion that fails on the way leaves the one before, and
    of two at once one wins whole and the other raises Conflict, or comes after.
    """
    version = current(spark, path)
    about = index_about(spark, version).where(F.col("strategy_id") == strategy_id)
    chosen = about.first()
    if chosen is None:
        raise ValueError(f"no index of {strategy_id}")
    store = Store(spark, selected)
    folder = store.write({"rows": read_index(spark, version, strategy_id), "about": about}, {"rows": "strategy_id"})
    write_json(about, f"{store.root}/{folder}/_selected/selected.json")
    return store.commit(folder, {"strategy_id": strategy_id, "from": version.number})


def selection(spark: SparkSession, selected: str | Version) -> DataFrame:
    """The selection that was promoted, as a row."""
    return read_json(spark, f"{_version(spark, selected).path}/_selected/selected.json", ABOUT)


def read_threshold(spark: SparkSession, path: str) -> DataFrame:
    """document_id, document_sha256, embedding_model, strategy_id, target_tokens, selected_threshold of a calibration file;
    a threshold that is no finite number within [-1, 1] raises."""
    row = read_json(spark, path, "document_id string, document_sha256 string, embedding_model string, strategy_id string, target_tokens int, selected_threshold double")
    t = F.col("selected_threshold")
    fit = t.isNotNull() & ~F.isnan(t) & t.between(-1, 1)
    return row.withColumn("selected_threshold", F.when(fit, t).otherwise(F.raise_error(F.lit("a threshold has to lie within [-1, 1]")).cast("double")))


def index_violations(index: DataFrame) -> DataFrame:
    """problem, n: no rows, vectors of several lengths, components that are no numbers, chunk ids that occur twice."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    one = index.agg(F.count("*").alias("n"), F.count_distinct(F.size("embedding")).alias("widths"), F.count(F.when(F.col("embedding").isNull() | bad, 1)).alias("bad"))
    rows = one.select(F.inline(F.array(
        F.struct(F.lit("empty").alias("problem"), (F.col("n") == 0).cast("long").alias("n")),
        F.struct(F.lit("several_lengths").alias("problem"), F.greatest(F.col("widths") - 1, F.lit(0)).cast("long").alias("n")), F.struct(F.lit("not_finite").alias("problem"), F.col("bad").alias("n")),
    ))).where("n > 0")
    twice = index.groupBy("chunk_id").count().where("count > 1").agg(F.count("*").alias("n")).where("n > 0").select(F.lit("repeated_chunk").alias("problem"), "n")
    return rows.unionByName(twice)


def write_json(df: DataFrame, path: str) -> None:
    """A small report as indented json with one object a row, or a single object for one row."""
    import json

    from pyspark.errors import IllegalArgumentException

    rows = [json.loads(x.value) for x in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).limit(100_001).collect()]
    if len(rows) > 100_000:
        raise IllegalArgumentException("too many rows for one file; write them with df.write.json")
    text = json.dumps(rows[0] if len(rows) == 1 else rows, indent=2, ensure_ascii=False)
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write((text + "\n").encode())
    finally:
        out.close()


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One json object as a row; anything else raises."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")
