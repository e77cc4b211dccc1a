"""An answerability threshold from scores of supported and unsupported queries, and how a set is accepted under it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import next_double
from ..sources.store import Scratch


def score_violations(scores: DataFrame) -> DataFrame:
    """problem, n for scores (is_positive, score): a class without scores, scores that are no finite numbers."""
    bad = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    one = scores.agg(F.count(F.when(F.col("is_positive"), 1)).alias("p"), F.count(F.when(~F.col("is_positive"), 1)).alias("q"), F.count(F.when(bad, 1)).alias("bad"))
    found = {"no_positive": (F.col("p") == 0).cast("long"), "no_negative": (F.col("q") == 0).cast("long"), "not_finite": F.col("bad")}
    problems = F.array(*(F.struct(F.lit(k).alias("problem"), n.alias("n")) for k, n in found.items()))
    return one.select(F.inline(problems)).where("n > 0")


def _tallies(scores: DataFrame) -> DataFrame:
    """A row a distinct score, with the counts of either class: what the following windows run over."""
    return scores.groupBy("score").agg(F.count(F.when(F.col("is_positive"), 1)).alias("p"), F.count(F.when(~F.col("is_positive"), 1)).alias("q"))


#: Distinct scores of one range of running counts.
RANGE = 100_000


def _running(tallies: DataFrame) -> DataFrame:
    """score, above (the next score), below_p, below_q (counts up to and with the score), before_p, before_q (without it).

    Scores are sorted into as many ranges as there are RANGEs of them; the ranges' totals, a row each, are run through in
    one task, the scores of a range in its own.
    """
    save = Scratch(tallies.sparkSession, "running").save
    tallies = save(tallies, "tallies")
    ranges = max(1, -(-tallies.count() // RANGE))
    # which range a score is in is written with it, so it stays what it was
    dealt = save(tallies.repartitionByRange(ranges, "score").withColumn("_range", F.spark_partition_id()), "dealt") if ranges > 1 else tallies.withColumn("_range", F.lit(0))
    sums = dealt.groupBy("_range").agg(F.sum("p").alias("_p"), F.sum("q").alias("_q"), F.min("score").alias("_first"))
    w = Window.orderBy("_range")
    bases = sums.select("_range", (F.sum("_p").over(w) - F.col("_p")).alias("_base_p"), (F.sum("_q").over(w) - F.col("_q")).alias("_base_q"), F.lead("_first").over(w).alias("_next"))
    rows = dealt.join(bases, "_range")
    own = Window.partitionBy("_range").orderBy("score")
    run = {f"below_{c}": F.col(f"_base_{c}") + F.sum(c).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for c in "pq"}
    rows = rows.withColumns(run | {"above": F.coalesce(F.lead("score").over(own), F.col("_next"))})
    return rows.select("score", "above", "below_p", "below_q", (F.col("below_p") - F.col("p")).alias("before_p"), (F.col("below_q") - F.col("q")).alias("before_q"))


def _middle() -> Column:
    return F.when(F.col("above").isNull(), next_double(F.col("score"))).otherwise((F.col("score") + F.col("above")) / 2)


def thresholds(scores: DataFrame) -> DataFrame:
    """threshold: the least score, the middles between neighbouring distinct scores, and the next number above the largest."""
    middles = _running(_tallies(scores)).select(_middle().alias("threshold"))
    return scores.agg(F.min("score").alias("threshold")).where("threshold is not null").unionByName(middles)


def threshold_metrics(scores: DataFrame) -> DataFrame:
    """For each candidate: true_positive (positives at or above it), false_negative, true_negative (negatives below it),
    false_positive, recall, specificity, balanced_accuracy.

    Counts run along the ordered scores: no candidate meets every score. A candidate lies at the least score or between
    its neighbours, so what stands below it is known from the row of the score under it.
    """
    rows = _tallies(scores)
    total = rows.agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))
    # the middle of two neighbouring doubles may be the lower one, which then is not below it
    under = lambda c: F.when(_middle() > F.col("score"), F.col(f"below_{c}")).otherwise(F.col(f"before_{c}"))
    cuts = _running(rows).select(_middle().alias("threshold"), under("p").alias("fn"), under("q").alias("tn"))
    least = rows.agg(F.min("score").alias("threshold")).where("threshold is not null").select("threshold", F.lit(0).cast("long").alias("fn"), F.lit(0).cast("long").alias("tn"))
    out = least.unionByName(cuts).crossJoin(F.broadcast(total))  # one row
    recall, specificity = (F.col("all_p") - F.col("fn")) / F.col("all_p"), F.col("tn") / F.col("all_q")
    return out.select(
        "threshold", (F.col("all_p") - F.col("fn")).alias("true_positive"), F.col("fn").alias("false_negative"), F.col("tn").alias("true_negative"), (F.col("all_q") - F.col("tn")).alias("false_positive"),
        recall.alias("recall"), specificity.alias("specificity"), ((recall + specificity) / 2).alias("balanced_accuracy"),
    )


def select_threshold(scores: DataFrame) -> DataFrame:
    """The candidate of best balanced accuracy, then recall, then specificity, then the least, and how many there were."""
    rows = threshold_metrics(scores)
    # there is a candidate more than there are distinct scores
    count = scores.agg(F.when(F.count_distinct("score") > 0, F.count_distinct("score") + 1).otherwise(0).alias("candidates"))
    return rows.crossJoin(F.broadcast(count)).orderBy(F.desc("balanced_accuracy"), F.desc("recall"), F.desc("specificity"), F.asc("threshold")).limit(1)


def score_summary(scores: DataFrame) -> DataFrame:
    """count, min, mean, max by class, in 6 decimals."""
    return scores.groupBy("is_positive").agg(F.count("*").alias("count"), *(F.round(f("score"), 6).alias(n) for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max))))


def acceptance(decisions: DataFrame) -> DataFrame:
    """queries, accepted, acceptance_rate of gate decisions."""
    return decisions.agg(F.count("*").alias("queries"), F.count(F.when(F.col("is_relevant"), 1)).alias("accepted"), F.round(F.avg(F.col("is_relevant").cast("double")), 6).alias("acceptance_rate"))


def margin(top: Column, threshold: Column) -> Column:
    """How far the top score lies above the threshold; null without one."""
    return top - threshold
