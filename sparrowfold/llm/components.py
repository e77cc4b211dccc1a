"""Distributed connected components: local union-find in each partition, then large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


class UnionFind:
    """Union by smaller id, with path halving."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


#: Nodes that a partition's union-find holds before it hands on its forest and starts anew.
LOCAL_NODES = 500_000


def _forest(batches):
    import pandas as pd

    def rows(uf):
        nodes = list(uf.parent)
        return pd.DataFrame({"u": nodes, "v": [uf.find(x) for x in nodes]}, dtype="int64").query("u != v")

    uf = UnionFind()
    for batch in batches:
        for a, b in zip(batch["u"].tolist(), batch["v"].tolist()):
            uf.union(a, b)
        if len(uf.parent) > LOCAL_NODES:
            yield rows(uf)
            uf = UnionFind()
    yield rows(uf)


def connected_components(edges: DataFrame, ws: Workspace, name: str = "cc") -> DataFrame:
    """(node, component) for every node of edges (u, v: long): component is the smallest node reachable.

    Self loops, repeated edges and edges with a null end are allowed; the latter are ignored. No edge gives no row.
    Each round is saved to the workspace; only one row of counts comes to the driver.
    """
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    forest = edges.mapInPandas(_forest, "u long, v long")
    now = ws.save(forest.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    step, before = 0, None
    while True:
        # large-star: every larger neighbour of u goes to the smallest of u and its neighbours
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: u and its smaller neighbours go to the smallest of these
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(lowest.select("u", F.col("m").alias("v"))).distinct()
        step += 1
        now = ws.save(small, f"{name}-{step}")
        ws.drop(f"{name}-{step - 1}")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        # a forest of stars with the smallest node at the centre maps to itself
        if tuple(state) == before or state[0] == 0:
            break
        before = tuple(state)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(stars.select(F.col("component").alias("node"), "component").distinct())
