"""Retrieval metrics at k over all queries at once, and the choice of a strategy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import gain, ideal_gain
from .retrieval import few


def checked_k(k: int) -> int:
    if k <= 0:
        raise ValueError("k has to be positive")
    return k


@dataclass(frozen=True)
class Gold:
    """What queries seek, where many seek the same: the units of each set (set_id, group_no, unit), the set of each query
    (query_id, set_id), and units that a query doesn't seek though its set has them (query_id, unit)."""

    units: DataFrame
    asks: DataFrame
    without: DataFrame

    @classmethod
    def of(cls, gold: DataFrame) -> Gold:
        """From query_id, group_no, unit: each query has a set of its own."""
        asks = gold.select("query_id", F.col("query_id").alias("set_id")).distinct()
        return cls(gold.select(F.col("query_id").alias("set_id"), "group_no", "unit"), asks, gold.select("query_id", "unit").limit(0))


def metrics(hits: DataFrame, gold: DataFrame | Gold, chunks: DataFrame, ks: list[int], keys: tuple[str, ...] = ()) -> DataFrame:
    """A row a query (and keys, such as strategy_id) and k: precision, recall, group_recall, reciprocal_rank, ndcg, first_relevant_rank.

    hits: keys, query_id, rank, chunk_id; gold: query_id, group_no, unit, one row for each unit of an evidence group, or
    a Gold, whose sets are never written out for each query; chunks: keys, chunk_id, units (array). Precision is of k,
    also with fewer hits. Recall is of distinct units; group recall is the mean over groups. A hit is relevant if it
    holds a gold unit; the ideal order has as many relevant hits in front as the corpus has relevant chunks, k at most.
    Queries without hits count with zeros.
    """
    ks = sorted({checked_k(k) for k in ks})
    on = [*keys, "query_id"]
    gold = gold if isinstance(gold, Gold) else Gold.of(gold)
    sets, asks, of_set = gold.units.select("set_id", "group_no", "unit").distinct(), gold.asks.select("query_id", "set_id").distinct(), ["set_id", "unit"]
    units = sets.select(*of_set).distinct()
    # what a query doesn't seek, a few rows a query, is taken off the numbers of its set
    gone = gold.without.select("query_id", "unit").distinct().join(asks, "query_id").join(sets, of_set)
    gone_units = gone.select("query_id", *of_set).distinct()
    less = lambda rows, by: rows.groupBy(*by).agg(F.count("*").alias("_less"))
    left = lambda c: (F.col(c) - F.coalesce("_less", F.lit(0))).alias(c)
    size = asks.join(units.groupBy("set_id").agg(F.count("*").alias("gold_count")), "set_id").join(less(gone_units, ["query_id"]), "query_id", "left").select("query_id", "set_id", left("gold_count")).where("gold_count > 0")
    held = chunks.select(*keys, "chunk_id", F.explode("units").alias("unit")).distinct()
    # chunks that hold units of a set; for a query, less those that hold none but what it doesn't seek
    relevant = held.join(units, "unit").groupBy(*keys, "set_id", "chunk_id").agg(F.count("*").alias("_units"))
    lost = held.join(gone_units, "unit").groupBy(*on, "set_id", "chunk_id").agg(F.count("*").alias("_gone")).join(relevant, [*keys, "set_id", "chunk_id"]).where("_gone = _units")
    whole = relevant.groupBy(*keys, "set_id").agg(F.count("*").alias("relevant_count"))
    ideal = asks.join(whole, "set_id").join(less(lost, on), on, "left").select(*on, left("relevant_count"))
    near = hits.where(F.col("rank") <= max(ks))
    sought = near.join(held, [*keys, "chunk_id"]).join(asks, "query_id").join(sets, of_set).join(gone_units.select("query_id", "unit"), ["query_id", "unit"], "left_anti")
    marked = near.join(sought.select(*on, "chunk_id").distinct().withColumn("_relevant", F.lit(1)), [*on, "chunk_id"], "left").withColumn("_relevant", F.coalesce("_relevant", F.lit(0)))
    counts = marked.groupBy(*on).agg(
        *(F.sum(F.when(F.col("rank") <= k, F.col("_relevant"))).alias(f"_n{k}") for k in ks), F.min(F.when(F.col("_relevant") == 1, F.col("rank"))).alias("first_relevant_rank"),
        *(F.sum(F.when(F.col("rank") <= k, gain(F.col("_relevant"), F.col("rank")))).alias(f"_dcg{k}") for k in ks),
    )
    # the rank at which each gold unit is first met
    met = sought.groupBy(*on, "group_no", "unit").agg(F.min("rank").alias("rank"))
    sizes = sets.groupBy("set_id", "group_no").agg(F.count("unit").alias("size"))
    groups = asks.join(sizes, "set_id").join(less(gone, ["query_id", "group_no"]), ["query_id", "group_no"], "left").select("query_id", "group_no", left("size")).where("size > 0")
    # a unit may stand in several groups; it counts once for recall
    once = met.groupBy(*on, "unit").agg(F.min("rank").alias("rank")).groupBy(*on).agg(*(F.count(F.when(F.col("rank") <= k, 1)).alias(f"_u{k}") for k in ks))
    shares = met.groupBy(*on, "group_no").agg(*(F.count(F.when(F.col("rank") <= k, 1)).alias(f"_g{k}") for k in ks)).join(groups, ["query_id", "group_no"])
    shares = shares.groupBy(*on).agg(*(F.sum(F.col(f"_g{k}") / F.col("size")).alias(f"_s{k}") for k in ks))
    group_count = groups.groupBy("query_id").agg(F.count("*").alias("group_count"))
    size = size.select("query_id", "gold_count")
    base = (few(chunks.select(*keys).distinct()).crossJoin(size) if keys else size).join(group_count, "query_id")
    rows = base.join(counts, on, "left").join(once, on, "left").join(shares, on, "left").join(ideal, on, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    first = F.col("first_relevant_rank")

    def at(k: int) -> Column:
        best = F.least(F.lit(k), zero("relevant_count"))
        return F.struct(
            F.lit(k).alias("k"), (zero(f"_n{k}") / k).alias("precision"), (zero(f"_u{k}") / F.col("gold_count")).alias("recall"), (zero(f"_s{k}") / F.col("group_count")).alias("group_recall"),
            F.when(first <= k, 1 / first).otherwise(0.0).alias("reciprocal_rank"), F.when(best > 0, zero(f"_dcg{k}") / ideal_gain(best)).otherwise(0.0).alias("ndcg"),
        )

    names = ("precision", "recall", "group_recall", "reciprocal_rank", "ndcg")
    flat = rows.select(*on, first.alias("first_relevant_rank"), F.explode(F.array(*map(at, ks))).alias("m"))
    return flat.select(*on, "m.k", *(F.round(F.col(f"m.{n}").cast("double"), 6).alias(n) for n in names), "first_relevant_rank")


def averages(per_query: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Means over queries, by keys and k."""
    names = ("precision", "recall", "group_recall", "reciprocal_rank", "ndcg")
    return per_query.groupBy(*keys, "k").agg(F.count("*").alias("queries"), *(F.round(F.avg(n), 6).alias(n) for n in names))


def select_strategy(means: DataFrame, lengths: DataFrame, k: int = 5) -> DataFrame:
    """The one strategy of best recall, then reciprocal rank, gain, precision, fewer tokens on average, smaller target.

    means: strategy_id, k and the metrics; lengths: strategy_id, target, mean_tokens.
    """
    rows = means.where(F.col("k") == k).join(lengths, "strategy_id")
    order = [F.desc("recall"), F.desc("reciprocal_rank"), F.desc("ndcg"), F.desc("precision"), F.asc("mean_tokens"), F.asc("target")]
    return rows.orderBy(*order).limit(1)


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def gold_violations(gold_units: DataFrame, units: DataFrame, gold_pages: DataFrame | None = None) -> DataFrame:
    """query_id, unit, problem: gold units that no unit has, and evidence on pages that the query doesn't name.

    gold_units: query_id, document_id, unit; units: document_id, source_order, page_number; gold_pages: query_id, gold_pages.
    """
    known = units.select("document_id", F.col("source_order").alias("unit"), "page_number")
    missing = gold_units.join(known, ["document_id", "unit"], "left_anti").select("query_id", "unit", F.lit("no_such_unit").alias("problem"))
    if gold_pages is None:
        return missing
    placed = gold_units.join(known, ["document_id", "unit"]).join(gold_pages, "query_id").where(~F.array_contains("gold_pages", F.col("page_number")))
    return missing.unionByName(placed.select("query_id", "unit", F.lit("other_page").alias("problem")))


def first_ranks(hits: DataFrame) -> DataFrame:
    """The rank-1 hit of each query."""
    return hits.where("rank = 1")


