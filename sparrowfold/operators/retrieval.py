"""Retrieval: exact top k by inner product (postings.py has it by terms, where no encoder is at hand)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import unit_scale
from ..sources.store import Scratch

Save = Callable[[DataFrame, str], DataFrame]

#: Rows of the index and of the queries that one task compares.
INDEX_BLOCK, QUERY_BLOCK = 4096, 1024
#: Pivots of a part of the index, and balls that one task holds against a block of queries.
PIVOTS, BALLS = 1024, 4096
#: Decimals at which scores tie; ties go to the smaller chunk id. A bound may miss a floor by SLACK.
TIE_DECIMALS, SLACK = 9, 1e-8

#: Rows of a few numbers each up to which a side of a join is broadcast.
FEW = 500_000


def few(rows: DataFrame, most: int = FEW) -> DataFrame:
    """rows, marked for broadcast if there are no more than `most`."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def _kinds(index: DataFrame, queries: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in [*index.schema, *queries.schema]}


@dataclass(frozen=True)
class Balls:
    """An index in balls of at most some INDEX_BLOCK vectors: by, ball and a row's chunk_id and v; of each ball its n,
    center and radius. No vector of a ball scores more for a query q than q * center + |q| * radius."""

    by: tuple[str, ...]
    rows: DataFrame
    about: DataFrame

    @classmethod
    def build(cls, index: DataFrame, by: tuple[str, ...], save: Save) -> Balls:
        """Vectors go to the nearest of some pivots of their part of the index, drawn by hash; full cells are dealt into
        several balls. Up to PIVOTS pivots a part, so assigning a vector has a bounded cost; the pivots are broadcast."""
        named = index.select(*by, "chunk_id", F.col("embedding").cast("array<double>").alias("v"))
        sizes = named.groupBy(*by).agg(F.count("*").alias("_n"))
        wish = F.least(F.lit(float(PIVOTS)), F.ceil(F.col("_n") / INDEX_BLOCK) * 2)
        drawn = F.pmod(F.xxhash64("chunk_id", F.lit(7)), F.lit(1 << 40)) < F.lit(float(1 << 40)) * wish / F.col("_n")
        with_sizes = named.join(few(sizes), list(by)) if by else named.crossJoin(sizes)  # one row
        pivots: dict[tuple, list] = {}
        for r in with_sizes.where(drawn).select(*by, "v").collect():
            pivots.setdefault(tuple(r)[:-1], []).append(r.v)
        held = index.sparkSession.sparkContext.broadcast({key: np.array(own) for key, own in pivots.items()})
        kinds = dict(named.dtypes)
        fields = ", ".join(f"`{c}` {kinds[c]}" for c in (*by, "chunk_id", "v"))

        def assign(batches):
            for pdf in batches:
                cell = np.zeros(len(pdf), np.int32)
                for key, at in (pdf.groupby(list(by)).indices.items() if by else [((), np.arange(len(pdf)))]):
                    own = held.value.get(key if isinstance(key, tuple) else (key,))
                    if own is not None and len(at):
                        cell[at] = (np.stack(pdf["v"].to_numpy()[at]) @ own.T - (own * own).sum(1) / 2).argmax(1)
                yield pdf.assign(cell=cell)

        placed = save(named.mapInPandas(assign, f"{fields}, cell int"), "placed")
        cells = placed.groupBy(*by, "cell").agg(F.ceil(F.count("*") / INDEX_BLOCK).cast("int").alias("_pieces"))
        dealt = placed.join(few(cells), [*by, "cell"]).withColumn("piece", F.pmod(F.xxhash64("chunk_id"), F.col("_pieces")).cast("int")).drop("_pieces")
        rows = save(dealt.select(*by, F.struct("cell", "piece").alias("ball"), "chunk_id", "v"), "rows")
        keys = ", ".join(f"`{c}` {kinds[c]}" for c in by)

        def measure(pdf: pd.DataFrame) -> pd.DataFrame:
            v = np.stack(pdf["v"].to_numpy())
            center = v.mean(0)
            radius = float(np.sqrt(((v - center) ** 2).sum(1)).max())
            return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "cell": [pdf["cell"].iloc[0]], "piece": [pdf["piece"].iloc[0]], "n": [len(v)], "center": [center], "radius": [radius]})

        flat = rows.select(*by, "ball.cell", "ball.piece", "v")
        about = flat.groupBy(*by, "cell", "piece").applyInPandas(measure, f"{keys}{', ' if by else ''}cell int, piece int, n long, center array<double>, radius double")
        return cls(by, rows, save(about.select(*by, F.struct("cell", "piece").alias("ball"), "n", "center", "radius"), "about"))

    def bounds(self, queries: DataFrame, k: int, floors: DataFrame | None = None) -> DataFrame:
        """by, query_id, ball, n, bound: balls that can hold a hit at a query's floor (by, query_id, floor) or above;
        without floors, in each group of balls the nearest that hold k vectors. Queries meet balls, not vectors, in blocks."""
        by, keys, given = self.by, ["_group", "_part"], floors is not None
        groups, parts = (max(1, -(-n // BALLS)) for n in (self.about.count(), queries.count()))
        balls = self.about.select(*by, "ball.cell", "ball.piece", "n", "center", "radius")
        balls = balls.withColumn("_group", F.pmod(F.xxhash64("cell", "piece"), F.lit(groups)).cast("int")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("q")).withColumn("_part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
        if given:
            own = floors.groupBy("query_id").agg(F.collect_list(F.struct(*by, "floor")).alias("floors"))  # one for each part of the index
            asked = asked.join(own, "query_id", "left")
        asked = asked.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        kinds = _kinds(self.about, queries)
        fields = "".join(f"`{c}` {kinds[c]}, " for c in by)

        def meet(asking: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            out = []
            for key, ball in (own.groupby(list(by)) if by else [((), own)]) if len(asking) and len(own) else ():
                key = key if isinstance(key, tuple) else (key,)
                q, n = np.stack(asking["q"].to_numpy()), ball["n"].to_numpy()
                bound = q @ np.stack(ball["center"].to_numpy()).T + np.sqrt((q * q).sum(1))[:, None] * ball["radius"].to_numpy()
                if not given:
                    order = np.argsort(-bound, axis=1, kind="stable")
                    before = np.cumsum(n[order], axis=1) - n[order]
                    keep = np.zeros(bound.shape, bool)
                    np.put_along_axis(keep, order, before < k, 1)
                else:
                    least = np.array([next((f["floor"] for f in fs if all(f[c] == x for c, x in zip(by, key))), -np.inf) if fs is not None else -np.inf for fs in asking["floors"]])
                    keep = bound >= (least - SLACK * (1 + abs(least)))[:, None]
                i, j = np.nonzero(keep)
                ids = asking["query_id"].tolist()
                out += [(*key, ids[x], cell, piece, m, value) for x, cell, piece, m, value in zip(i.tolist(), *(ball[c].to_numpy()[j].tolist() for c in ("cell", "piece", "n")), bound[i, j].tolist())]
            return pd.DataFrame(out, columns=[*by, "query_id", "cell", "piece", "n", "bound"])

        schema = f"{fields}query_id {kinds['query_id']}, cell int, piece int, n long, bound double"
        found = asked.groupBy(*keys).cogroup(balls.groupBy(*keys)).applyInPandas(meet, schema)
        return found.select(*by, "query_id", F.struct("cell", "piece").alias("ball"), "n", "bound")

    def scores(self, pairs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """The k best of each pair (by, query_id, ball): each ball meets those queries alone that ask for it; a ball that
        very many ask for meets them in several tasks."""
        keys = [*self.by, "cell", "piece", "_sub"]
        pairs = pairs.select(*self.by, "query_id", "ball.cell", "ball.piece")
        busy = pairs.groupBy(*self.by, "cell", "piece").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("_subs"))
        right = pairs.join(few(busy), [*self.by, "cell", "piece"]).withColumn("_sub", F.pmod(F.xxhash64("query_id"), F.col("_subs")).cast("int"))
        right = right.join(few(queries.select("query_id", F.col("embedding").cast("array<double>").alias("q")), 5_000), "query_id").select(*keys, "query_id", "q")
        rows = self.rows.select(*self.by, "ball.cell", "ball.piece", "chunk_id", "v")
        left = rows.join(few(busy), [*self.by, "cell", "piece"]).withColumn("_sub", F.explode(F.sequence(F.lit(0), F.col("_subs") - 1))).drop("_subs")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(*_best(self.by, _kinds(self.rows, queries), k))

    def search(self, queries: DataFrame, k: int, save: Save) -> DataFrame:
        near = Window.partitionBy(*self.by, "query_id").orderBy(F.desc("bound"), "ball")
        before = F.coalesce(F.sum("n").over(near.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        first = save(self.bounds(queries, k).withColumn("_before", before).where(F.col("_before") < k).select(*self.by, "query_id", "ball"), "first")
        found = save(self.scores(first, queries, k), "found")
        floors = ranked(found, k, self.by).where(F.col("rank") == k).select(*self.by, "query_id", F.col("score").alias("floor"))
        more = save(self.bounds(queries, k, floors).join(first, [*self.by, "query_id", "ball"], "left_anti"), "more")
        return save(ranked(found.unionByName(self.scores(more, queries, k)), k, self.by), "hits")


def _best(by: tuple[str, ...], kinds: dict[str, str], k: int):
    """For cogroups of vectors (by, chunk_id, v) and queries (query_id, q): the k best chunks of each query, and the schema."""

    def best(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asking):
            return pd.DataFrame({c: own[c][:0] for c in by} | {"query_id": asking["query_id"][:0], "chunk_id": own["chunk_id"][:0], "score": np.zeros(0)})
        own = own.sort_values("chunk_id")
        s = np.round(np.stack(asking["q"].to_numpy()) @ np.stack(own["v"].to_numpy()).T, TIE_DECIMALS)
        n = min(k, s.shape[1])
        # all that reach a query's n-th score, ties and all, are sorted; the rest is not
        row, at = np.nonzero(s >= np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n, None])
        order = np.lexsort((at, -s[row, at], row))
        row, at = row[order], at[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < n
        row, at = row[keep], at[keep]
        found = {"query_id": asking["query_id"].to_numpy()[row], "chunk_id": own["chunk_id"].to_numpy()[at], "score": s[row, at]}
        return pd.DataFrame({c: [own[c].iloc[0]] * (len(asking) * n) for c in by} | found)

    return best, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double"])


def top_k(index: DataFrame, queries: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """by, query_id, rank, chunk_id, score: the k chunks of largest inner product for each query, in double precision.

    index: by, chunk_id, embedding; queries: query_id, embedding. With `by` (such as strategy_id) every query is put to
    each of these parts of the index, in one pass. Exact at every size. Parts of one block meet the queries directly;
    with larger ones, a query opens the balls nearest to it, and then only those that could hold a better hit than the
    k-th of these. Fewer than k chunks give them all.
    """
    if k <= 0:
        raise ValueError("k has to be positive")
    most = index.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    # flows read hits many times over
    save = Scratch(index.sparkSession, "balls").save
    if most > INDEX_BLOCK:
        return Balls.build(index, by, save).search(queries, k, save)
    parts = max(1, -(-queries.count() // QUERY_BLOCK))
    left = index.select(*by, "chunk_id", F.col("embedding").cast("array<double>").alias("v")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = queries.select("query_id", F.col("embedding").cast("array<double>").alias("q")).withColumn("_part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    # every query against every part of the index is what is asked for; parts are few, and each is one block
    if by:
        right = right.crossJoin(few(index.select(*(F.col(c).alias(f"_{c}") for c in by)).distinct())).withColumnsRenamed({f"_{c}": c for c in by})
    keys = [*by, "_part"]
    return save(ranked(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(*_best(by, _kinds(index, queries), k)), k, by), "hits")


def ranked(scored: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The k best rows a query (by, query_id, chunk_id, score), with ranks from 1."""
    w = Window.partitionBy(*by, "query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*by, "query_id", "rank", "chunk_id", "score")


def pooled(index: DataFrame, sizes: list[int]) -> DataFrame:
    """Coarser strategies of an index of numbered vectors: strategy_id, target, chunk_id, embedding, units.

    For each size m, runs of m neighbouring ids are one chunk: the mean of their vectors, scaled to unit length.
    """
    rows = index.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).withColumn("target", F.explode(F.array(*map(F.lit, sizes))))
    grouped = rows.groupBy("target", F.floor(F.col("vec_id") / F.col("target")).cast("long").alias("chunk_id")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("own"))
    total = F.aggregate(F.slice("own", 2, F.size("own")), F.col("own")[0]["v"], lambda s, x: F.zip_with(s, x["v"], lambda a, b: a + b))
    return grouped.select(F.concat(F.lit("target_"), "target").alias("strategy_id"), "target", "chunk_id", unit_scale(total).alias("embedding"), F.transform("own", lambda x: x["vec_id"]).alias("units"))


def gate(queries: DataFrame, hits: DataFrame, threshold: Column) -> DataFrame:
    """query_id, is_relevant, top_score, threshold, reason for each of queries: no_hits, below_threshold or relevant."""
    top = hits.where("rank = 1").select("query_id", F.col("score").alias("top_score"))
    bad = F.isnan("top_score") | (F.abs("top_score") == float("inf"))
    score = F.when(bad, F.raise_error(F.lit("a top score has to be finite")).cast("double")).otherwise(F.col("top_score"))
    reason = F.when(score.isNull(), "no_hits").when(score < threshold, "below_threshold").otherwise("relevant")
    return queries.select("query_id").join(top, "query_id", "left").select("query_id", (F.coalesce(score >= threshold, F.lit(False))).alias("is_relevant"), "top_score", threshold.cast("double").alias("threshold"), reason.alias("reason"))


def embed(texts: DataFrame, encode: Callable[[list[str]], np.ndarray], column: str = "text", batch: int = 32) -> DataFrame:
    """texts with `embedding`: unit vectors of an encoder, made a batch at a time on the executors. Blank texts and vectors that aren't finite raise."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in parts:
            if (t.isna() | (t.str.strip() == "")).any():
                raise ValueError("a text to encode is blank")
            out = []
            for at in range(0, len(t), batch):
                v = np.asarray(encode(t.iloc[at : at + batch].tolist()), np.float32)
                if v.ndim != 2 or not np.isfinite(v).all():
                    raise ValueError("an encoder has to give finite vectors")
                out.extend((v / np.linalg.norm(v, axis=1, keepdims=True)).tolist())
            yield pd.Series(out)

    return texts.withColumn("embedding", run(F.col(column)))
