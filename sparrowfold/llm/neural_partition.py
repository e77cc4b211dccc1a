"""Approximate nearest neighbours by learned partitions.

A neighbour graph over a bounded sample is cut into balanced parts; a small network learns each vector's part and is
then all that is needed: it places every vector in a part, and sends a query to its most probable parts, whose
vectors are ranked by exact inner product. How many parts a query visits is set on the sample, for a recall. Parts
that hold many vectors are cut again in the same way, each by a network of its own, fitted where the part's sample
lies. Neighbouring parts lie in one region: a query's visits to a region are one task's work, which hands on the
nearest of all of them in one row.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, partitions_for, small

#: Distinct vectors that a network is fitted on (those of the least hash), and sample queries that set the visits.
SAMPLE, TRIALS = 8192, 512
#: Vectors planned for a part, the most parts of the first cut, the vectors from which a part is cut again, and the
#: most parts of that.
PART, FIRST_PARTS, SPLIT, SECOND_PARTS = 200, 128, 16_384, 64
#: Neighbours in the graph, and the recall that visits are set for, at either cut.
DEGREE, RECALL, SECOND_RECALL = 12, 0.955, 0.975
#: Index rows of a region, queries of one task, and queries that are compared at a time.
REGION, QUERY_BLOCK, AT_ONCE = 8192, 8192, 256


def neighbour_graph(x: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """The `degree` others of largest inner product, for each row."""
    degree = min(degree, len(x) - 1)
    out = np.zeros((len(x), max(0, degree)), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        if degree:
            out[at : at + len(s)] = np.argpartition(-s, degree - 1, axis=1)[:, :degree]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 0.1, rounds: int = 12) -> np.ndarray:
    """Parts of about equal size with few edges between: recursive halving along the widest direction, then moves that gain edges while room is left."""
    label = np.zeros(len(x), np.int64)
    groups = [(np.arange(len(x)), parts, 0)]
    while groups:
        rows, n, first = groups.pop()
        if n == 1:
            label[rows] = first
            continue
        centred = x[rows] - x[rows].mean(0)
        wide = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = rows[np.argsort(centred @ wide, kind="stable")]
        cut = len(rows) * (n // 2) // n
        groups += [(order[:cut], n // 2, first), (order[cut:], n - n // 2, first + n // 2)]
    if not graph.shape[1] or parts == 1:
        return label
    room = int(np.ceil(len(x) / parts * (1 + slack)))
    edges = np.concatenate([np.stack([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()], 1), np.stack([graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])], 1)])
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), np.int32)
        np.add.at(votes, (edges[:, 0], label[edges[:, 1]]), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), label]
        size = np.bincount(label, minlength=parts)
        moved = 0
        for k in np.argsort(-gain, kind="stable"):
            if gain[k] <= 0:
                break
            if size[best[k]] < room:
                size[label[k]] -= 1
                size[best[k]] += 1
                label[k] = best[k]
                moved += 1
        if moved < len(x) // 1000 + 1:
            break
    return label


@dataclass
class Router:
    """A network of one hidden layer; its outputs rank the parts for a vector."""

    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x * self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def train_router(x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 30, seed: int = 5) -> Router:
    """Cross entropy against `target` (rows x parts: the share of a vector's neighbours in each part) by Adam."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    parts = target.shape[1]
    scale = 1 / max(1e-12, float(np.sqrt((x**2).mean())))
    p = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs) + 1e-4
        for rows in np.array_split(rng.permutation(n), max(1, n // 256)):
            a = x[rows] * scale
            h = np.maximum(a @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            q = np.exp(z - z.max(1, keepdims=True))
            g = (q / q.sum(1, keepdims=True) - target[rows]) / len(rows)
            back = (g @ p[2].T) * (h > 0)
            step += 1
            for k, grad in enumerate((a.T @ back, back.sum(0), h.T @ g, g.sum(0))):
                grad = grad + 1e-4 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Router(scale, *p)


def fit(sample: np.ndarray, parts: int, k: int, recall: float = RECALL) -> tuple[Router, int]:
    """The router, and how many parts a query has to visit for a recall of its k nearest within the sample."""
    graph = neighbour_graph(sample)
    label = balanced_parts(sample, graph, parts)
    target = np.zeros((len(sample), parts))
    target[np.arange(len(sample)), label] = 1
    for column in graph.T:
        np.add.at(target, (np.arange(len(sample)), label[column]), 1)
    router = train_router(sample, target / target.sum(1, keepdims=True))
    placed = router.logits(sample).argmax(1)
    trial = np.arange(0, len(sample), max(1, len(sample) // TRIALS))
    order = np.argsort(-router.logits(sample[trial]), axis=1)
    s = sample[trial] @ sample.T
    s[np.arange(len(trial)), trial] = -np.inf
    near = np.argsort(-s, axis=1)[:, : min(k, len(sample) - 1)]
    # the visit at which each of the nearest is met
    rank = np.argsort(order, axis=1)
    met = rank[np.arange(len(trial))[:, None], placed[near]]
    share = np.cumsum(np.bincount(met.ravel(), minlength=parts)) / max(1, met.size)
    return router, int(np.argmax(share >= recall)) + 1


def planned(vectors: int, most: int, sample: int) -> int:
    """How many parts so many vectors are cut into."""
    return max(1, min(most, vectors // PART, sample // 32))


@dataclass
class Tree:
    """The first network and those of the parts that are cut again; without a network there is one part."""

    router: Router | None = None
    visits: int = 1
    seconds: dict[int, tuple[Router, int]] = field(default_factory=dict)

    def __post_init__(self):
        n = len(self.router.b2) if self.router else 1
        width = np.array([len(self.seconds[p][0].b2) if p in self.seconds else 1 for p in range(n)])
        self.first, self.parts = np.cumsum(width) - width, int(width.sum())

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.router.logits(x) if self.router else np.zeros((len(x), 1))

    def top(self, x: np.ndarray) -> np.ndarray:
        return self.logits(x).argmax(1)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The part of each vector."""
        top = self.top(x)
        out = self.first[top]
        for p, (router, _) in self.seconds.items():
            own = np.flatnonzero(top == p)
            if len(own):
                out[own] += router.logits(x[own]).argmax(1)
        return out

    def route(self, x: np.ndarray, held: np.ndarray, k: int) -> list[np.ndarray]:
        """The parts that each query visits: the most probable, and on until they hold more than k vectors."""
        order = np.argsort(-self.logits(x), axis=1, kind="stable")
        inner = {p: np.argsort(-router.logits(x), axis=1, kind="stable")[:, :visits] for p, (router, visits) in self.seconds.items()}
        out = []
        for row, tops in enumerate(order):
            parts, rows = [], 0
            for step, p in enumerate(tops.tolist()):
                if step >= self.visits and rows > k:
                    break
                own = self.first[p] + (inner[p][row] if p in inner else np.zeros(1, np.int64))
                parts.append(own)
                rows += held[own].sum()
            out.append(np.concatenate(parts))
        return out


def regions(held: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each part's first region and how many it has: small parts share one with their neighbours, up to `size` vectors."""
    first, blocks, at, room = np.zeros(len(held), np.int64), np.ones(len(held), np.int64), 0, size
    for p, n in enumerate(held.tolist()):
        if n > room and room < size:
            at, room = at + 1, size
        first[p] = at
        if n > size:
            blocks[p] = -(-n // size)
            at, room = at + int(blocks[p]), size
        else:
            room -= n
    return first, blocks


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array<double>) of the rows that take part, equal rows once."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0)).dropDuplicates(["vec_id", "v"])


def identity(v: str = "v"):
    """128 bits by which equal vectors are known."""
    return F.concat(F.hex(F.xxhash64(v)), F.lit(":"), F.hex(F.xxhash64(F.lit(1), v)))


def plant(index: DataFrame, total: int, k: int) -> Tree:
    """The tree for the distinct vectors of index (h, v), from samples of at most SAMPLE of them a network."""
    sample = np.array([r.v for r in index.orderBy("h").select("v").limit(SAMPLE).collect()])
    parts = planned(total, FIRST_PARTS, len(sample))
    if parts == 1:
        return Tree()
    tree = Tree(*fit(sample, parts, k))
    if total <= SPLIT:
        return tree
    sent = index.sparkSession.sparkContext.broadcast(tree)  # one network

    @F.pandas_udf("int")
    def top_of(v: pd.Series) -> pd.Series:
        return pd.Series(sent.value.top(np.stack(v.to_numpy())) if len(v) else [], dtype="int32")

    topped = index.select("h", "v", top_of("v").alias("top"))
    large = topped.groupBy("top").count().where(F.col("count") > SPLIT).collect()  # a row a part of the first cut
    counts = {r.top: n for r in large if (n := planned(r["count"], SECOND_PARTS, min(SAMPLE, r["count"]))) > 1}
    if not counts:
        return tree

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        top, x = int(pdf["top"].iloc[0]), np.stack(pdf.sort_values("h")["v"].to_numpy())
        return pd.DataFrame([(top, pickle.dumps(fit(x, counts[top], k, SECOND_RECALL)))], columns=["top", "model"])

    few = topped.where(F.col("top").isin(list(counts))).withColumn("n", F.row_number().over(Window.partitionBy("top").orderBy("h"))).where(F.col("n") <= SAMPLE)
    models = few.select("top", "h", "v").repartition(len(counts), "top").groupBy("top").applyInPandas(cut, "top int, model binary").collect()  # FIRST_PARTS networks at most
    return Tree(tree.router, tree.visits, {r.top: pickle.loads(r.model) for r in models})


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for each row of queries among the rows of vectors, by
    inner product in double precision, ties to the smaller vec_id; all of them, if they are fewer than k.

    Both have vec_id and embedding. A row of the query's own vec_id is no candidate. Rows with a null vec_id, with a
    vector that is null, zero, or holds a null or non-finite component, or of another length than most vectors have
    (on a tie, the longer) take no part. Equal rows count once. Equal vectors are placed, visited and ranked as one;
    k + 1 of their least vec_ids can be among a query's nearest. Other columns are not read. No vector, no row. Fewer
    than 2 * PART distinct vectors are one part, which every query visits.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "ann")
    rows = valid(vectors)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = sizes[0]
    rows = ws.save(rows.where(F.size("v") == width).withColumn("uid", identity()), "rows")
    # distinct vectors with their k + 1 least ids: a window that keeps few rows of a group is cut before the shuffle
    least = rows.withColumn("n", F.row_number().over(Window.partitionBy("uid").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    distinct = ws.save(least.groupBy("uid").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v")), "distinct")
    tree = plant(distinct.select(F.xxhash64("uid").alias("h"), "v"), distinct.count(), k)
    sent = spark.sparkContext.broadcast(tree)  # at most FIRST_PARTS + 1 networks, whose size is fixed by the length of a vector

    @F.pandas_udf("int")
    def part_of(v: pd.Series) -> pd.Series:
        return pd.Series(sent.value.place(np.stack(v.to_numpy())) if len(v) else [], dtype="int32")

    index = ws.save(distinct.select("uid", F.col("ids")[0].alias("first"), F.coalesce(F.try_element_at("ids", F.lit(2)), F.col("ids")[0]).alias("second"), "v", part_of("v").alias("part")), "index")
    held = np.zeros(tree.parts, np.int64)
    for r in index.groupBy("part").count().collect():  # a row a part, of at most FIRST_PARTS * SECOND_PARTS
        held[r[0]] = r[1]
    first, blocks = regions(held, REGION)

    # a query is known by its vector; where its vec_id has several vectors, all of them its own, by both
    several = rows.groupBy("vec_id").count().where("count > 1").select(F.col("vec_id").alias("query_id"), F.col("vec_id").cast("string").alias("own"))
    asked = valid(queries).where(F.size("v") == width).select(F.col("vec_id").alias("query_id"), identity().alias("quid"), "v")
    asked = ws.save(asked.join(several, "query_id", "left"), "asked")

    def routed(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x, out = np.stack(pdf["q"].to_numpy()), []
            for row, parts in enumerate(sent.value.route(x, held, k)):
                parts = np.sort(parts)
                # all blocks of a part
                region = np.concatenate([np.arange(first[p], first[p] + blocks[p]) for p in parts])
                owner = np.repeat(parts, blocks[parts])
                for r in np.unique(region):
                    out.append((pdf["quid"].iloc[row], pdf["own"].iloc[row], x[row].tolist(), int(r), owner[region == r].tolist()))
            yield pd.DataFrame(out, columns=["quid", "own", "q", "region", "parts"])

    units = asked.groupBy("quid", "own").agg(F.first("v").alias("q"))
    right = ws.save(units.mapInPandas(routed, "quid string, own string, q array<double>, region int, parts array<int>"), "routed")
    chunks = ws.save(right.groupBy("region").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("chunks")), "chunks")

    @F.pandas_udf("int")
    def region_of(part: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(first[part] + h.to_numpy() % blocks[part], dtype="int32")

    left = index.withColumn("region", region_of("part", F.xxhash64("uid", F.lit(2)))).join(small(chunks), "region").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    right = right.join(small(chunks), "region").withColumn("chunk", F.pmod(F.xxhash64("quid", "own"), F.col("chunks")).cast("int")).drop("chunks")

    def rerank(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(asking):
            x, q = np.stack(own["v"].to_numpy()), np.stack(asking["q"].to_numpy())
            uid, lead, second, part = (own[c].to_numpy() for c in ("uid", "first", "second", "part"))
            mine = asking["own"].tolist()
            for at in range(0, len(q), AT_ONCE):
                s = q[at : at + AT_ONCE] @ x.T
                for row, scores in enumerate(s, at):
                    scores[~np.isin(part, asking["parts"].iloc[row])] = -np.inf
                    name = lead
                    if mine[row] is not None:
                        # its own vectors count only where other vec_ids have them too
                        led = lead == int(mine[row])
                        name = np.where(led, second, lead)
                        scores[led & (second == lead)] = -np.inf
                    few = min(k + 1, int(np.isfinite(scores).sum()))
                    if not few:
                        continue
                    cut = np.partition(scores, len(scores) - few)[len(scores) - few]
                    # products are summed anew, alike wherever a vector stands; what rounding may have put below the cut comes too
                    near = np.flatnonzero(scores >= cut - 1e-9 * (1 + abs(cut)))
                    exact = (x[near] * q[row]).sum(1)
                    order = np.lexsort((name[near], -exact))[:few]
                    out.append((asking["quid"].iloc[row], mine[row], (-exact[order]).tolist(), name[near[order]].tolist(), uid[near[order]].tolist()))
        return pd.DataFrame(out, columns=["quid", "own", "far", "first", "uid"])  # a row a query and region

    n = partitions_for(index)
    keys = ["region", "chunk"]
    left, right = left.repartition(n, *keys), right.repartition(n, *keys)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(rerank, "quid string, own string, far array<double>, first array<bigint>, uid array<string>")
    # the nearest of all regions: a query has a row a region that it visits
    merged = F.slice(F.sort_array(F.flatten(F.collect_list(F.arrays_zip("far", "first", "uid")))), 1, k + 1)
    best = found.groupBy("quid", "own").agg(merged.alias("best")).select("quid", "own", F.inline("best"))
    named = best.join(distinct.select("uid", "ids"), "uid").select("quid", "own", (-F.col("far")).alias("score"), F.explode("ids").alias("vec_id")).where("own is null or vec_id <> cast(own as long)")
    order = F.row_number().over(Window.partitionBy("quid", "own").orderBy(F.desc("score"), "vec_id"))
    named = ws.save(named.withColumn("n", order).where(F.col("n") <= k + 1).select("quid", F.col("own").alias("unit"), "n", "vec_id", "score"), "named")
    mine = asked.join(named, (asked["quid"] == named["quid"]) & asked["own"].eqNullSafe(named["unit"])).where("vec_id <> query_id").select("query_id", asked["quid"], "n", "vec_id", "score")
    # without the query's own row, the order of a query's list gives the rank
    rank = F.row_number().over(Window.partitionBy("query_id", "quid").orderBy("n"))
    return mine.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 20) -> float:
    """The share of the true k nearest in found, by brute force on the driver: for tests and spot checks on small tables."""
    x = {r.vec_id: np.array(r.v) for r in valid(vectors).collect()}
    ids = np.array(sorted(x))
    m = np.stack([x[i] for i in ids])
    hits = total = 0
    got: dict[int, set] = {}
    for r in found.collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for r in valid(queries).collect():
        s = m @ np.array(r.v)
        s[ids == r.vec_id] = -np.inf
        near = ids[np.lexsort((ids, -s))[: min(k, len(ids) - 1)]].tolist()
        hits += len(got.get(r.vec_id, set()).intersection(near))
        total += len(near)
    return hits / max(1, total)
