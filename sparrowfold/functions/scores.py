"""Numeric expressions: similarity, gains, confidence, rounding to steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the confidence and the count of citations that gives full support.
TOP_WEIGHT, MARGIN_WEIGHT, CITED_WEIGHT, SUPPORT_WEIGHT, FULL_SUPPORT = 0.35, 0.35, 0.20, 0.10, 2
STEP = 32


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def inner_product(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit_scale(a: Column) -> Column:
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(a, lambda x: x.cast("double") / norm)


def snapped(value: Column, step: int = STEP) -> Column:
    """The multiple of step nearest to a positive value, halves up, step at least; other values raise."""
    if step <= 0:
        raise ValueError("step has to be positive")
    near = F.greatest(F.lit(step), (F.floor(value / step + 0.5) * step).cast("int"))
    return F.when(value > 0, near).otherwise(F.raise_error(F.lit("a value to round has to be positive")).cast("int"))


def gain(relevant: Column, rank: Column) -> Column:
    """What a hit of this rank adds to a discounted cumulative gain."""
    return relevant.cast("double") / F.log2(rank + 1)


def ideal_gain(count: Column) -> Column:
    """The discounted gain of `count` relevant hits in front."""
    ranks = F.when(count > 0, F.sequence(F.lit(1), count.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(ranks, F.lit(0.0), lambda s, r: s + 1 / F.log2(r + F.lit(1)))


def next_double(c: Column) -> Column:
    """The next larger double."""
    return F.reflect(F.lit("java.lang.Math"), F.lit("nextUp"), c.cast("double")).cast("double")


def checked_score(c: Column) -> Column:
    """The score, if finite and within -1 to 1; else it raises. Null stays null."""
    bad = F.isnan(c) | (F.abs(c) > 1)
    return F.when(bad, F.raise_error(F.lit("a score has to be finite and within -1 and 1")).cast("double")).otherwise(c)


def cosine_to_unit(c: Column) -> Column:
    return (clamp(c, -1.0, 1.0) + 1) / 2


def threshold_margin(score: Column, threshold: Column) -> Column:
    """How far a score stands above the threshold, as a share of the room there is."""
    room = clamp((score - threshold) / F.when(threshold < 1, 1 - threshold), 0.0, 1.0)
    return F.when(threshold >= 1, F.when(score >= 1, 1.0).otherwise(0.0)).otherwise(room)


def confidence(top: Column, cited: Column, threshold: Column) -> Column:
    """Strength of the evidence, 0 to 1, in 4 decimals (halves away from 0).

    top: rank-1 score; cited: scores of the cited hits (array). No citation: 0. A top score below the threshold raises.
    """
    mean = F.aggregate(cited, F.lit(0.0), lambda s, x: s + cosine_to_unit(checked_score(x))) / F.size(cited)
    support = F.least(F.size(cited) / F.lit(FULL_SUPPORT), F.lit(1.0))
    value = TOP_WEIGHT * cosine_to_unit(checked_score(top)) + MARGIN_WEIGHT * threshold_margin(top, threshold) + CITED_WEIGHT * mean + SUPPORT_WEIGHT * support
    below = F.raise_error(F.lit("the top score is below the threshold")).cast("double")
    return F.when(F.size(cited) == 0, 0.0).when(top < checked_score(threshold), below).otherwise(F.round(clamp(value, 0.0, 1.0), 4))
