"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full shingle sets, union-find grouping.

Equal sets are one representative. Representatives that share a band are first paired with the band's leader only, so
a large group of copies gives a row a member; verified links are joined into classes. Then, in bands that still hold
more than one class, members of different classes are compared by signature, block by block, and those whose
estimate comes near the threshold are verified there, all pairs of a block in one matrix product: no link between
different texts is left out to save pairs, and a block hands on links, not pairs.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, held, partitions_for, small
from .components import connected_components
from .wordbpe import text_slices

SHINGLE = 5
#: Most places of a signature, and the most probable miss: that a pair at the threshold shares no band.
PLACES, MISS = 160, 1e-5
#: Standard deviations below the threshold from which equal places let a pair be verified.
DEVIATIONS = 6


@dataclass(frozen=True)
class Plan:
    """Bands of a signature for a threshold of `percent`."""

    percent: int
    rows: int
    bands: int

    @classmethod
    def of(cls, percent: int) -> Plan:
        """The longest rows whose bands miss a pair at the threshold with probability MISS at most."""
        s = percent / 100
        for rows in range(10, 0, -1):
            if (1 - s**rows) ** (PLACES // rows) <= MISS:
                return cls(percent, rows, PLACES // rows)
        raise ValueError(f"no bands for {percent} percent in {PLACES} places")

    @property
    def places(self) -> int:
        return self.rows * self.bands

    @property
    def least(self) -> int:
        """Equal places from which a pair is verified."""
        s = self.percent / 100
        return max(0, int(self.places * s - DEVIATIONS * (self.places * s * (1 - s)) ** 0.5))


#: At 85 percent: 26 bands of 6, missed with probability 5e-6; at 80 percent: 32 bands of 5, 3e-6.
SIGNATURE = Plan.of(85).places
#: Members of a band, and shingles of theirs, that one block holds; larger bands are dealt into pairs of blocks.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000
ELEMENTS = 150_000
KEEP_WORDS = 400_000
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(z: np.ndarray, seed: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = z + np.uint64(seed + 1) * _MIX[0]
        z = (z ^ (z >> np.uint64(30))) * _MIX[1]
        z = (z ^ (z >> np.uint64(27))) * _MIX[2]
        return z ^ (z >> np.uint64(31))


class Shingler:
    """Sets of 64-bit shingle hashes; words met before are kept, up to a bound."""

    def __init__(self):
        import xxhash

        self.hash = xxhash.xxh64_intdigest
        self.words: dict[bytes, int] = {}

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of a text's 5-word shingles; fewer words are one shingle; no word, none."""
        # bytes: only A-Z are folded, and only blanks and the characters 9 to 13 part words
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        kept = self.words
        if len(kept) > KEEP_WORDS:
            kept.clear()
        try:
            codes = [kept[w] for w in words]
        except KeyError:
            for w in words:
                if w not in kept:
                    kept[w] = self.hash(w)
            codes = [kept[w] for w in words]
        h = np.array(codes, np.uint64)
        width = min(SHINGLE, len(h))
        out = mix(h[: len(h) - width + 1], width)
        for k in range(1, width):
            out = mix(out ^ h[k : len(h) - width + 1 + k], k)
        return np.unique(out)


def shingler() -> Shingler:
    return held("shingles", Shingler)


def signatures(sets: list[np.ndarray], size: int = SIGNATURE) -> np.ndarray:
    """SuperMinHash signatures of non-empty sets, one row each.

    Every element draws a permutation of the places and, for the j-th place it visits, a value in [j, j + 1); a place
    keeps the least value. All elements take a step together, and a set stops once every place holds a value below
    the next step: later steps can't lower it.
    """
    count = len(sets)
    lengths = np.array([len(s) for s in sets], np.int64)
    element = np.concatenate(sets) if count else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(count), lengths)
    out = np.full(count * size, np.inf)
    places = None
    for step in range(size):
        draw = mix(element, 100 + step)
        value = (draw >> np.uint64(32)).astype(np.float64) / 2**32 + step
        pick = step + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(size - step) >> np.uint64(32)).astype(np.int64)
        if places is None:
            place = pick
        else:
            row = np.arange(len(element))
            place = places[row, pick].astype(np.int64)
            places[row, pick] = places[:, step]
        np.minimum.at(out, owner * size + place, value)
        left = out.reshape(count, size).max(1) >= step + 1
        going = left[owner]
        if not going.any():
            break
        if places is None:
            element, owner, place = element[going], owner[going], place[going]
            places = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.uint16), (len(element), 1))
            # the swap of the first step
            places[np.arange(len(element)), place] = 0
        elif not going.all():
            element, owner, places = element[going], owner[going], places[going]
    return out.reshape(count, size)


def banded(signature: np.ndarray, rows: int = Plan.of(85).rows) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (a column a band, 64 bits) and one byte for each place, of signatures."""
    bits = mix(signature.view(np.uint64))
    parts = bits.reshape(len(bits), bits.shape[1] // rows, rows)
    keys = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        keys = mix(keys ^ parts[:, :, k], k)
    return keys, (bits & np.uint64(255)).astype(np.uint8)


def set_id(own: np.ndarray) -> int | None:
    """A set's 64-bit identity; None for the empty set."""
    return int.from_bytes(hashlib.md5(own.tobytes()).digest()[:8], "little", signed=True) if len(own) else None


def _signed(plan: Plan):
    def run(batches):
        s = shingler()
        for batch in batches:
            keys = batch.column("doc_id")
            for first, texts in text_slices(batch):
                at = 0
                while at < len(texts):
                    own, size, start = [], 0, at
                    while at < len(texts) and (size < ELEMENTS or at == start):
                        own.append(s.shingles(texts[at]))
                        size += len(own[-1])
                        at += 1
                    full = [k for k, x in enumerate(own) if len(x)]
                    bands, sketch = banded(signatures([own[k] for k in full], plan.places), plan.rows)
                    place = {k: j for j, k in enumerate(full)}
                    yield pa.RecordBatch.from_arrays(
                        [
                            keys.slice(first + start, len(own)),
                            pa.array([len(x) for x in own], pa.int64()),
                            pa.array([set_id(x) for x in own], pa.int64()),
                            pa.array([bands[place[k]].view(np.int64) if k in place else None for k in range(len(own))], pa.list_(pa.int64())),
                            pa.array([sketch[place[k]].tobytes() if k in place else None for k in range(len(own))], pa.binary()),
                        ],
                        names=["doc_id", "n_shingles", "rid", "bands", "sketch"],
                    )

    return run


def _sets(batches):
    s = shingler()
    for batch in batches:
        for _, texts in text_slices(batch):
            own = [x for x in map(s.shingles, texts) if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(x) for x in own], pa.int64()), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))], names=["rid", "own"])


def equal_places(a, b, places: int):
    """How many bytes two sketches have in common, place by place."""

    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="int32")
        x, y = (np.frombuffer(b"".join(c), np.uint8).reshape(-1, places) for c in (a, b))
        return pd.Series((x == y).sum(1), dtype="int32")

    return run(a, b)


def common_counts(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many elements each two sets have in common, by products of 0/1 matrices over the elements that sets share."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[code] > 1
    place = np.cumsum(count > 1) - 1
    owner, code = owner[shared], place[code[shared]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int((count > 1).sum()), columns):
        own = (code >= at) & (code < at + columns)
        m = np.zeros((len(sets), columns), np.float32)
        m[owner[own], code[own] - at] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _linked(percent: int):
    plan = Plan.of(percent)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links within a block, or between two blocks, of a band: members of different classes, neither the leader,
        near enough by sketch, that share the key of no earlier band (there they are compared; bytes of the sketch may
        agree by chance), and are linked by their full sets."""
        sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(-1, plan.places)
        earlier = np.array(pdf["earlier"].tolist(), np.int64).reshape(len(pdf), -1)
        rid, kind, block = (pdf[c].to_numpy() for c in ("rid", "class", "block"))
        leader = pdf["leader"].to_numpy() == rid
        first, second = (int(pdf[c].iloc[0]) for c in ("i", "j"))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in np.flatnonzero((block == first) & ~leader):
            near = (block == second) & ~leader & (kind != kind[k])
            if first == second:
                near[: k + 1] = False
            at = np.flatnonzero(near)
            met = (earlier[at] == earlier[k]).any(1)
            at = at[((sketch[at] == sketch[k]).sum(1) >= plan.least) & ~met]
            left.append(np.full(len(at), k))
            right.append(at)
        a, b = np.concatenate(left), np.concatenate(right)
        if len(a):
            used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            sets = [pdf["own"].iloc[k] for k in used]
            x, y = place[: len(a)], place[len(a) :]
            size = np.array([len(s) for s in sets])
            common = common_counts(sets)[x, y]
            ok = 100 * common >= percent * (size[x] + size[y] - common)
            a, b = rid[a[ok]], rid[b[ok]]
        return pd.DataFrame({"a": a, "b": b})

    return compare


def groups(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document (doc_id, text); links: 100 * intersection >= percent * union.

    Texts without words (null, empty, blank) are linked with nothing. Rows of one doc_id are one node: with different
    texts, they are linked by it. Rows with a null doc_id are linked with nothing; their component is null and they
    are kept. Each row gives a row, no row none. Texts of any length are read whole. Other columns are not read.
    """
    ws, plan = Workspace(docs.sparkSession, "near"), Plan.of(percent)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = ws.save(texts.mapInArrow(_signed(plan), "doc_id long, n_shingles long, rid long, bands array<bigint>, sketch binary"), "signed")
    whole = signed.where("rid is not null and doc_id is not null")
    reps = ws.save(whole.groupBy("rid").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "reps")

    members = reps.select("rid", "n", F.posexplode("bands").alias("number", "band"))
    leaders = members.groupBy("band").agg(F.min("rid").alias("leader"), F.count("*").alias("size")).where("size > 1")
    shared = ws.save(members.join(leaders, "band"), "shared")
    sketches = reps.select("rid", "sketch")
    star = shared.where("rid <> leader").select(F.col("leader").alias("a"), F.col("rid").alias("b")).distinct()
    star = star.join(sketches.toDF("b", "sb"), "b").join(sketches.toDF("a", "sa"), "a").where(equal_places("sa", "sb", plan.places) >= plan.least).select("a", "b")

    meet = reps.join(shared.select("rid").distinct(), "rid", "left_semi").select(F.col("rep").alias("doc_id")).distinct()
    sets = ws.save(texts.join(small(ws.save(meet, "meet")), "doc_id", "left_semi").mapInArrow(_sets, "rid long, own array<bigint>").dropDuplicates(["rid"]), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        # the second join's other side is sent once for a leader, however many pairs it has
        rows = pairs.join(sets.toDF("b", "own_b"), "b").join(sets.toDF("a", "own_a"), "a")
        common, total = F.size(F.array_intersect("own_a", "own_b")), F.size("own_a") + F.size("own_b")
        return rows.where(100 * common >= percent * (total - common)).select("a", "b")

    links = ws.save(verified(star), "star")
    classes = connected_components(links.toDF("u", "v"), ws, "first").toDF("rid", "class")
    placed = shared.join(classes, "rid", "left").withColumn("class", F.coalesce("class", "rid"))
    mixed = placed.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("members"), F.sum("n").alias("shingles")).where("low <> high and members > 2").select("band", "members", "shingles")
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    rest = placed.join(mixed, "band").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    rest = rest.join(reps.select("rid", "sketch", "bands"), "rid").join(sets, "rid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select(F.slice("bands", F.lit(1), F.col("number")).alias("earlier"), "band", "rid", "class", "leader", "sketch", "own", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    more = rest.repartition(partitions_for(reps), "band", "i", "j").groupBy("band", "i", "j").applyInPandas(_linked(percent), "a long, b long")
    more = ws.save(more, "more")

    # classes of representatives by document id; a doc_id with several texts links their representatives
    rep = reps.select("rid", "rep")
    by_id = links.unionAll(more).join(rep.toDF("a", "u"), "a").join(rep.toDF("b", "v"), "b").select("u", "v")
    ids = signed.where("rid is not null and doc_id is not null").groupBy("doc_id").agg(F.min("rid").alias("low"), F.max("rid").alias("high")).where("low <> high").select("doc_id")
    several = signed.where("rid is not null").join(ids, "doc_id", "left_semi").select("doc_id", "rid").distinct().join(rep, "rid").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    components = connected_components(by_id.unionAll(several), ws, "ids")
    label = ws.save(rep.join(components, F.col("rep") == F.col("node"), "left").select("rid", F.coalesce("component", "rep").alias("component")), "label")
    out = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("rid")).alias("rid")).join(label, "rid", "left")
    component = F.coalesce("component", "doc_id").alias("component_id")
    return out.select("doc_id", "n_shingles", component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
