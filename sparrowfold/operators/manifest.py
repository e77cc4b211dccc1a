"""What artifacts say about each other, checked before anything is served."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("document_sha256", "embedding_model", "strategy_id", "target_tokens", "embedding_dimension", "chunk_count")


def index_facts(index: DataFrame) -> DataFrame:
    """One row of what an index is: chunks, their vectors' length, distinct ids, one strategy and target or null."""
    one = lambda c: F.when(F.count_distinct(c) == 1, F.first(c, ignorenulls=True)).alias(c)
    return index.agg(F.count("*").alias("chunk_count"), F.count_distinct("chunk_id").alias("distinct_chunks"), F.when(F.count_distinct(F.size("embedding")) == 1, F.first(F.size("embedding"))).alias("embedding_dimension"), one("strategy_id"), one("target_tokens"))


def build(index: DataFrame, selected: DataFrame, calibration: DataFrame, document_sha256: str, embedding_model: str) -> DataFrame:
    """The manifest as one row. selected: strategy_id, target_tokens; calibration: threshold, strategy_id."""
    facts = index_facts(index).select("chunk_count", "embedding_dimension", F.col("strategy_id"), F.col("target_tokens"))
    chosen = selected.select(F.col("strategy_id").alias("selected_strategy"), F.col("target_tokens").alias("selected_target"))
    cut = calibration.select("threshold", F.col("strategy_id").alias("calibrated_strategy"))
    return facts.join(chosen).join(cut).withColumn("document_sha256", F.lit(document_sha256)).withColumn("embedding_model", F.lit(embedding_model))


def mismatches(manifest: DataFrame, live: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """label, expected, actual of every field in which two one-row tables differ; null differs from any value."""
    pair = manifest.select(F.struct(*fields).alias("a")).join(live.select(F.struct(*fields).alias("b")))
    rows = F.array(*(F.struct(F.lit(f).alias("label"), F.col(f"a.{f}").cast("string").alias("expected"), F.col(f"b.{f}").cast("string").alias("actual")) for f in fields))
    return pair.select(F.inline(rows)).where("not (expected <=> actual)")


def inner_mismatches(manifest: DataFrame) -> DataFrame:
    """Within one manifest: the selected strategy and target are the index's, and the calibration is of that strategy."""
    checks: list[tuple[str, Column, Column]] = [
        ("selected_strategy", F.col("selected_strategy"), F.col("strategy_id")), ("selected_target", F.col("selected_target"), F.col("target_tokens")), ("calibrated_strategy", F.col("calibrated_strategy"), F.col("strategy_id")),
    ]
    rows = F.array(*(F.struct(F.lit(n).alias("label"), a.cast("string").alias("expected"), b.cast("string").alias("actual")) for n, a, b in checks))
    return manifest.select(F.inline(rows)).where("not (expected <=> actual)")


#: Fields in which the selection agrees with the index and with the calibration.
SHARED = ("document_id", "embedding_model", "strategy_id", "target_tokens")


def cross_checks(selected: DataFrame, calibration: DataFrame, about: DataFrame, index: DataFrame, document_sha256: str, embedding_model: str | None = None) -> DataFrame:
    """label, expected, actual of all that artifacts contradict each other in; no row if they belong together.

    selected, calibration and about (index_about) are one row each; index is what is served, document_sha256 the hash
    of the file as it is now, embedding_model the configured one (not compared if null). A threshold outside [-1, 1] is
    a contradiction too.
    """
    facts = index_facts(index)
    row = selected.select(F.struct("*").alias("s")).crossJoin(calibration.select(F.struct("*").alias("c"))).crossJoin(about.select(F.struct("*").alias("m"))).crossJoin(facts.select(F.struct("*").alias("i")))
    sha = F.lit(document_sha256)
    checks: list[tuple[str, Column, Column]] = [(f"sha256 of {n}", sha, F.col(f"{k}.document_sha256")) for n, k in (("selection", "s"), ("index", "m"), ("calibration", "c"))]
    checks += [(f"{f} of {n}", F.col(f"s.{f}"), F.col(f"{k}.{f}")) for f in SHARED for n, k in (("index", "m"), ("calibration", "c"))]
    checks += [("embedding_model of configuration", F.lit(embedding_model), F.col("s.embedding_model"))] if embedding_model is not None else []
    checks += [("chunk_count of selection", F.col("s.chunk_count"), F.col("m.chunk_count")), ("rows of index", F.col("m.chunk_count"), F.col("i.chunk_count")), ("distinct chunks", F.col("i.chunk_count"), F.col("i.distinct_chunks"))]
    checks += [("vector length", F.col("m.embedding_dimension"), F.col("i.embedding_dimension")), ("strategy of rows", F.col("s.strategy_id"), F.col("i.strategy_id")), ("target of rows", F.col("s.target_tokens"), F.col("i.target_tokens"))]
    t = F.col("c.selected_threshold")
    checks += [("threshold within bounds", F.lit(True), t.isNotNull() & ~F.isnan(t) & t.between(-1, 1))]
    rows = F.array(*(F.struct(F.lit(n).alias("label"), a.cast("string").alias("expected"), b.cast("string").alias("actual")) for n, a, b in checks))
    return row.select(F.inline(rows)).where("not (expected <=> actual)")


def chunk_violations(index: DataFrame, strategy_id: str, target_tokens: int) -> DataFrame:
    """chunk_id, problem: blank ids, another strategy or target, ids that occur twice."""
    checks = {"blank_id": F.coalesce(F.trim("chunk_id") == "", F.lit(True)), "other_strategy": ~F.col("strategy_id").eqNullSafe(strategy_id), "other_target": ~F.col("target_tokens").eqNullSafe(target_tokens)}
    rows = index.select("chunk_id", F.explode(F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())), lambda x: x.isNotNull())).alias("problem"))
    twice = index.groupBy("chunk_id").count().where("count > 1").select("chunk_id", F.lit("repeated_id").alias("problem"))
    return rows.unionByName(twice)


class Incompatible(ValueError):
    """Artifacts that must not be served together."""


def require_none(*violations: DataFrame, most: int = 20) -> None:
    """Raises with the first rows, if any of the tables has one."""
    found = [str(r.asDict()) for df in violations for r in df.limit(most).collect()]
    if found:
        raise Incompatible("; ".join(found[:most]))

