"""Offline flows: which strategy serves best, where the gate stands, and how a frozen set fares under both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import calibration, metrics, retrieval


def strategy_hits(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Hits with strategy_id, for every strategy of an index (strategy_id, chunk_id, embedding): query vectors serve all, in one search."""
    return retrieval.top_k(index, queries, k, ("strategy_id",))


def evaluate_strategies(index: DataFrame, queries: DataFrame, gold: DataFrame | metrics.Gold, lengths: DataFrame, ks: list[int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per-query metrics, their means, and the chosen strategy. index also has units; lengths: strategy_id, target, mean_tokens."""
    per = metrics.metrics(strategy_hits(index, queries, max(ks)), gold, index.select("strategy_id", "chunk_id", "units"), ks, ("strategy_id",))
    means = metrics.averages(per, ("strategy_id",))
    return per, means, metrics.select_strategy(means, lengths, max(ks))


def calibrate(index: DataFrame, queries: DataFrame) -> DataFrame:
    """The threshold's row for queries (query_id, embedding, is_positive), from their rank-1 scores. A query without a hit raises."""
    top = metrics.first_ranks(retrieval.top_k(index, queries, 1)).select("query_id", "score")
    missing = F.raise_error(F.concat(F.lit("no hit for "), F.col("query_id").cast("string"))).cast("double")
    scores = queries.select("query_id", "is_positive").join(top, "query_id", "left").select("query_id", "is_positive", F.coalesce("score", missing).alias("score"))
    return calibration.select_threshold(scores)


def holdout(hits: DataFrame, gold: DataFrame | metrics.Gold, chunks: DataFrame, queries: DataFrame, threshold: Column, k: int = 5) -> DataFrame:
    """A row a frozen query: metrics at k, first relevant rank, and the gate's decision with its margin."""
    per = metrics.metrics(hits, gold, chunks, [k])
    decisions = retrieval.gate(queries, hits, threshold)
    rows = decisions.join(per, "query_id", "left")
    return rows.withColumn("margin", calibration.margin(F.col("top_score"), F.col("threshold")))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that both tables have (as sets): what a frozen set must not share with the one it was tuned on."""
    return a.intersect(b)
