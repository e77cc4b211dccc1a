"""Toxicity: Kneser-Ney models of toxic and of ordinary documents, compared by length-normalised log-likelihood.

Each class c has interpolated Kneser-Ney probabilities of a word w after a word v, in four levels that each return
their discounted mass to the next:

    P_c(w|v) = max(n_c(v,w) - m_c(v,w) - D, 0) / n_c(v) + l_c(v) * Q_c(w|v)   counts of the class
    Q_c(w|v) = max(n(v,w) - D, 0) / n(v) + l(v) * U_c(w)                      counts that both classes share
    U_c(w)   = max(n_c(w) - m_c(w), 0) / n_c + l_c * S(w)                     words of the class
    S(w)     = max(n(w) - 1, 0) / n + l * (k(w) + 1) / (K + V + 1)            the same in both classes; unseen words count as one

n are counts of documents that hold a pair or a word (a word said over and over in one document is one), n(v) and n
sums of these over w, k counts of distinct preceding words, V of words, K of pairs, l the discounted mass. The discount of a class's count follows
from the shared count: m_c is what a class of its size would have of n, and MARGIN standard deviations of chance. So a
word that is rare, or no more frequent in one class than in the other, is told by shared counts alone and has nearly
one probability in both, and only what chance doesn't explain sets the classes apart. A text's evidence is the sum of
log P_toxic - log P_ordinary over its tokens, divided by their number; that alone is calibrated to the score.

Texts are cut into words once, into files of blocks. Every count of every labelled document is kept, in tables of
cells (pairs) and shards (words). A block asks the shards for its distinct words, and the cells for those of its
distinct pairs that a filter of bits says may have been met more than D times: others say no more than their words. So
texts are never shuffled, no table has to fit anywhere, and the way is the same at every size. Keys travel sorted, as
compressed differences.
"""

from __future__ import annotations

import json
import struct
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, crc_mod, get_range, held, put_file, small
from .rff_quality import training_labels
from .superminhash import mix

#: D, and standard deviations of a class's count about its share that count as chance.
DISCOUNT, MARGIN = 16.0, 4.0
#: Mean nats a token about which the calibration is as fine as for 0.
SCALE = 0.01
#: One of so many labelled documents (by hash of doc_id) sets the calibration and is not counted.
CALIBRATION = 4
#: Tokens of one block, and tokens for which a cell of pairs is planned.
BLOCK_TOKENS, CELL_TOKENS = 2_500_000, 2_000_000
#: Bits of the filter of pairs for each that it holds, and most in all; a filter that fills up lets more be asked.
FILTER_BITS, MOST_BITS = 16, 1 << 28
#: Pairs that are taken together where many numbers of each are needed.
CHUNK = 400_000
#: Stands before each word of a document once, so that words are counted as pairs are: larger than any other key.
BAG = np.uint64(2**64 - 1)
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words of a whole text; ASCII characters that are no letter or digit part them."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()


def dump(**arrays: np.ndarray) -> bytes:
    """Arrays in one compressed blob; the bytes of a number are stored plane by plane, so that high zeros vanish."""
    import zstandard

    head = json.dumps([(k, a.dtype.str, len(a)) for k, a in arrays.items()]).encode()
    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes() for a in arrays.values()]
    return zstandard.ZstdCompressor(level=3).compress(struct.pack("<I", len(head)) + head + b"".join(planes))


def load(blob: bytes) -> dict[str, np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(bytes(blob))
    at = 4 + struct.unpack_from("<I", raw)[0]
    out = {}
    for name, kind, n in json.loads(raw[4:at]):
        kind = np.dtype(kind)
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out[name] = np.ascontiguousarray(planes.T).view(kind).reshape(n)
        at += n * kind.itemsize
    return out


def steps(sorted_keys: np.ndarray) -> np.ndarray:
    return np.diff(sorted_keys, prepend=sorted_keys.dtype.type(0))


def keys_of(differences: np.ndarray) -> np.ndarray:
    return np.cumsum(differences, dtype=differences.dtype)


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(v, 201) ^ w, 202)


def shard_of(words: np.ndarray, shards: int) -> np.ndarray:
    """The shard of word keys: ranges of equal width, so that sorted keys lie in shard order."""
    return ((words >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


class Grid:
    """Cells of pairs: rows by the first word, columns by the second, so that a frequent word is dealt over many cells."""

    def __init__(self, cells: int):
        self.rows = max(1, int(np.ceil(np.sqrt(cells))))
        self.columns = max(1, -(-cells // self.rows))

    def cell(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return (v % np.uint64(self.rows) * np.uint64(self.columns) + w % np.uint64(self.columns)).astype(np.int64)


class Block:
    """Texts as ranks of their words among the block's sorted word keys; the empty word stands before a text's first."""

    def __init__(self, blob: bytes):
        z = load(blob)
        self.words, rank = np.unique(z["words"], return_inverse=True)
        token = rank.astype(np.int32)[z["codes"]]
        self.lengths = z["lengths"].astype(np.int64)
        self.doc_id, self.null, self.t, self.u = z["doc_id"], z["null"].astype(bool), z["t"], z["u"]
        self.doc = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        before = np.empty_like(token)
        before[1:] = token[:-1]
        first = np.cumsum(self.lengths) - self.lengths
        before[first[self.lengths > 0]] = rank[0]
        self.pairs = before.astype(np.int64) * len(self.words) + token

    def split(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the first and of the second words."""
        return pairs // len(self.words), pairs % len(self.words)


def write_blocks(docs: DataFrame, root: str, block_tokens: int) -> DataFrame:
    """Writes files of blocks; returns doc_id, block, place, n, words, pairs (a row a document): tokens, and distinct words and pairs."""

    def run(batches):
        import xxhash

        held("toxicity")
        codes, coded, lengths, keys, kinds = {b"": 0}, [], [], [], []

        def leave():
            path = f"{root}/{uuid.uuid4().hex}"
            null = np.array([k is None for k, _, _ in keys], np.uint8)
            put_file(
                path,
                [
                    dump(
                        words=np.array([xxhash.xxh64_intdigest(w) for w in codes], np.uint64), codes=np.concatenate([np.zeros(0, np.uint32), *coded]), lengths=np.array(lengths, np.uint32),
                        doc_id=np.array([k or 0 for k, _, _ in keys], np.int64), null=null, t=np.array([t for _, t, _ in keys], np.int64), u=np.array([u for _, _, u in keys], np.int32),
                    )
                ],
            )
            n = len(keys)
            out = pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in keys], pa.int64()), pa.array([path] * n), pa.array(range(n), pa.int32()), pa.array(lengths, pa.int64()), *(pa.array([x[k] for x in kinds], pa.int64()) for k in (0, 1))], names=["doc_id", "block", "place", "n", "words", "pairs"])
            for x in (codes, coded, lengths, keys, kinds):
                x.clear()
            codes[b""] = 0
            return out

        size = 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "t", "u")]
            for k, text in enumerate(batch.column("text")):
                own = words_of(text.as_py())
                code = np.array([codes.setdefault(w, len(codes)) for w in own], np.uint32)
                coded.append(code)
                kinds.append((len(np.unique(code)), len(np.unique(code + (np.append(np.zeros(1, np.uint64), code[:-1]) << np.uint64(32)))) if len(code) else 0))
                lengths.append(len(own))
                keys.append(tuple(c[k] for c in columns))
                size += len(own)
                if size >= block_tokens:
                    yield leave()
                    size = 0
        if keys:
            yield leave()

    return docs.mapInArrow(run, "doc_id long, block string, place int, n long, words long, pairs long")


def _counted(grid: Grid):
    """Blocks with their labelled places to rows (cell, blob): distinct pairs, and words after BAG, with how many documents of either class have them."""

    def run(batches):
        held("toxicity")
        for pdf in batches:
            for path, places, labels in zip(pdf["block"], pdf["places"], pdf["labels"]):
                b = Block(get_range(path))
                y = np.full(len(b.lengths), -1)
                y[np.asarray(places, np.int64)] = np.asarray(labels, np.int64)
                seen = y[b.doc] >= 0
                v, w = b.split(b.pairs[seen])
                words, width = np.append(b.words, BAG), len(b.words) + 1
                pairs, at = np.unique(np.concatenate([v * width + w, (width - 1) * width + w]), return_inverse=True)
                # once for each document
                once = np.unique(np.tile(b.doc[seen].astype(np.int64), 2) * len(pairs) + at)
                doc, at = once // max(1, len(pairs)), once % max(1, len(pairs))
                toxic = np.bincount(at, weights=y[doc], minlength=len(pairs)).astype(np.uint32)
                ordinary = np.bincount(at, minlength=len(pairs)).astype(np.uint32) - toxic
                v, w = pairs // width, pairs % width
                cell = grid.cell(words[v], words[w])
                order = np.argsort(cell, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(order) else []:
                    used, place = np.unique(np.concatenate([v[own], w[own]]), return_inverse=True)
                    place = place.astype(np.uint32)
                    blob = dump(words=steps(words[used]), v=steps(place[: len(own)]), w=place[len(own) :], no=ordinary[own], nt=toxic[own])
                    yield pd.DataFrame({"cell": [int(cell[own[0]])], "blob": [blob]})

    return run


#: What a word has: as first, sums and excess of pairs by class and the mass that both share; documents by class; distinct words before it.
STATS = ("ho", "ht", "eo", "et", "ms", "uo", "ut", "ks")


def excess(no: np.ndarray, nt: np.ndarray, rate: float, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """What either class has of counts beyond its share (rate: of the toxic one), chance and a discount."""
    n = no + nt
    margin = MARGIN * np.sqrt(n * rate * (1 - rate)) + discount
    return np.maximum(no - (1 - rate) * n - margin, 0), np.maximum(nt - rate * n - margin, 0)


def lean_counts(x: np.ndarray) -> np.ndarray:
    whole = x.dtype.kind != "f" or not (x % 1).any()
    return x.astype(np.uint32 if x.sum() < 1 << 32 else np.uint64) if whole else x.astype(np.float32)


def _gathered(shards: int, rate: float):
    """A cell's blobs to one row of its pairs (kind 0) and rows of word statistics, by shard (kind 1)."""

    def run(pdf):
        blobs = [load(x) for x in pdf["blob"]]
        cell = int(pdf["cell"].iloc[0])
        own = [keys_of(z["words"]) for z in blobs]
        words, rank = np.unique(np.concatenate(own), return_inverse=True)
        rank = np.split(rank, np.cumsum([len(x) for x in own])[:-1])
        key = np.concatenate([r[keys_of(z["v"])].astype(np.int64) * len(words) + r[z["w"]] for r, z in zip(rank, blobs)])
        pairs, at = np.unique(key, return_inverse=True)
        no, nt = (np.bincount(at, weights=np.concatenate([z[c] for z in blobs]), minlength=len(pairs)) for c in ("no", "nt"))
        v, w = pairs // len(words), pairs % len(words)
        by = lambda x, values: lean_counts(np.bincount(x, weights=values, minlength=len(words)))
        bag = words[v] == BAG
        po, pt = np.where(bag, 0, no), np.where(bag, 0, nt)
        eo, et = excess(po, pt, rate, DISCOUNT)
        stats = dict(zip(STATS, (by(v, po), by(v, pt), by(v, eo), by(v, et), by(v, np.minimum(po + pt, DISCOUNT)), by(w, no - po), by(w, nt - pt), by(w, 1.0 * ~bag))))
        # counts up to the discount are returned whole: such a pair says no more than its words
        told = po + pt > DISCOUNT
        hashed = pair_key(words[v[told]], words[w[told]])
        order = np.argsort(hashed)
        rows = [(0, cell, dump(keys=steps(hashed[order]), no=no[told][order].astype(np.uint32), nt=nt[told][order].astype(np.uint32)), int(told.sum()))]
        for part in np.split(np.arange(len(words)), np.flatnonzero(np.diff(shard_of(words, shards))) + 1):
            rows.append((1, int(shard_of(words[part[:1]], shards)[0]), dump(words=steps(words[part]), **{k: x[part] for k, x in stats.items()}), len(part)))
        return pd.DataFrame(rows, columns=["kind", "shard", "blob", "size"])

    return run


#: Sums over all words: counts and excess by class, distinct words, distinct pairs. R, the toxic share of pairs, joins them.
TOTALS = ("No", "Nt", "Eo", "Et", "V", "K")


def _summed(rate: float):  # the toxic share of words
    """A shard's statistics of words, added up, and their totals."""

    def run(pdf):
        blobs = [load(x) for x in pdf["blob"]]
        words, at = np.unique(np.concatenate([keys_of(z["words"]) for z in blobs]), return_inverse=True)
        stats = {k: np.bincount(at, weights=np.concatenate([z[k] for z in blobs]), minlength=len(words)) for k in STATS}
        out = {"shard": [int(pdf["shard"].iloc[0])], "blob": [dump(words=steps(words), **{k: lean_counts(x) for k, x in stats.items()})]}
        eo, et = excess(stats["uo"], stats["ut"], rate, 0)
        sums = (stats["uo"].sum(), stats["ut"].sum(), eo.sum(), et.sum(), (stats["ks"] > 0).sum(), stats["ks"].sum())
        return pd.DataFrame(out | {k: [float(x)] for k, x in zip(TOTALS, sums)})

    return run


def probabilities(first: dict, second: dict, no, nt, totals: dict) -> tuple[np.ndarray, np.ndarray]:
    """P_ordinary and P_toxic of pairs: statistics of their first and second words, counts, and the TOTALS."""
    over = lambda n, h, none=0.0: np.divide(n, h, out=np.full(len(h), none), where=h > 0)
    no, nt = np.asarray(no, float), np.asarray(nt, float)
    tokens = totals["No"] + totals["Nt"]
    rate = totals["Nt"] / tokens
    n, both = second["uo"] + second["ut"], first["ho"] + first["ht"]
    s = np.maximum(n - 1, 0) / tokens + totals["V"] / tokens * (second["ks"] + 1) / (totals["K"] + totals["V"] + 1)
    top, rest = over(np.maximum(no + nt - DISCOUNT, 0), both), over(first["ms"], both, 1.0)
    out = []
    for c, word, pair in zip("ot", excess(second["uo"], second["ut"], rate, 0), excess(no, nt, totals["R"], DISCOUNT)):
        u = (word + (totals[f"N{c}"] - totals[f"E{c}"]) * s) / totals[f"N{c}"]
        left = np.maximum(1 - over(first[f"e{c}"], first[f"h{c}"]), 0)
        out.append(over(pair, first[f"h{c}"]) + left * (top + rest * u))
    return out[0], out[1]


class Filter:
    """Which pairs may be known: a bit a key, of as many bits as MOST_BITS allows."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(keys: np.ndarray, size: int) -> np.ndarray:
        """size is a power of two."""
        return (mix(keys, 301) & np.uint64(size - 1)).astype(np.int64)

    def may(self, keys: np.ndarray) -> np.ndarray:
        at = self.places(keys, 8 * len(self.bits))
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    @classmethod
    def of(cls, pairs: DataFrame) -> Filter:
        """Of a table of cells (blob, size): each task sets bits, and pieces of the filter come to the driver whole."""
        count = pairs.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        size = max(1024, min(MOST_BITS, 1 << int(FILTER_BITS * count).bit_length()))
        pieces = max(1, size >> 22)
        width = size // pieces

        def placed(batches):
            for pdf in batches:
                for blob in pdf["blob"]:
                    at = np.unique(cls.places(keys_of(load(blob)["keys"]), size))
                    piece = at // width
                    rows = [(int(k), dump(at=steps(at[piece == k] - k * width))) for k in np.unique(piece)]
                    yield pd.DataFrame(rows, columns=["piece", "blob"]).astype({"piece": "int32"})

        def packed(pdf):
            own = np.zeros(width, bool)
            for blob in pdf["blob"]:
                own[keys_of(load(blob)["at"])] = True
            return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "bits": [np.packbits(own, bitorder="little").tobytes()]})

        bits = np.zeros(size // 8, np.uint8)
        for r in pairs.where("size > 0").mapInPandas(placed, "piece int, blob binary").groupBy("piece").applyInPandas(packed, "piece int, bits binary").toLocalIterator():
            bits[r.piece * width // 8 : (r.piece + 1) * width // 8] = np.frombuffer(r.bits, np.uint8)
        return cls(bits)


def questions(b: Block, pairs: np.ndarray, grid: Grid, shards: int, known: Filter):
    """For each (kind, shard), the keys asked there in their order, and their places: of those of the block's distinct
    pairs that may be known (kind 0), and of its words (kind 1)."""
    cells, keys, places = [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at in range(0, len(pairs), CHUNK):
        v, w = (b.words[x] for x in b.split(pairs[at : at + CHUNK]))
        key = pair_key(v, w)
        may = np.flatnonzero(known.may(key))
        cells.append(grid.cell(v[may], w[may]).astype(np.int32))
        keys.append(key[may])
        places.append(at + may)
    asked = {}
    for kind, where, key, place in ((0, np.concatenate(cells), np.concatenate(keys), np.concatenate(places)), (1, shard_of(b.words, shards), b.words, np.arange(len(b.words)))):
        order = np.lexsort((key, where))
        for own in np.split(order, np.flatnonzero(np.diff(where[order])) + 1) if len(order) else []:
            asked[kind, int(where[own[0]])] = key[own], place[own]
    return asked


def _asked(grid: Grid, shards: int, sent):
    """Blocks to rows (kind, shard, block, keys): the distinct words asked of each shard, and pairs of each cell."""

    def run(batches):
        held("toxicity")
        for pdf in batches:
            for path in pdf["block"]:
                b = Block(get_range(path))
                asked = questions(b, np.unique(b.pairs), grid, shards, sent.value)
                found = [(kind, shard, path, dump(keys=steps(keys))) for (kind, shard), (keys, _) in asked.items()]
                yield pd.DataFrame(found, columns=["kind", "shard", "block", "keys"])

    return run


def _answered(asked, told):
    """For each block's keys: bits of those that the cell or shard has, and what it has of these, in the same order."""
    rows = []
    if len(asked) and len(told):
        own = load(told["blob"].iloc[0])
        kind, shard = int(asked["kind"].iloc[0]), int(asked["shard"].iloc[0])
        have = keys_of(own.pop("keys" if kind == 0 else "words"))
        for path, blob in zip(asked["block"], asked["keys"]):
            keys = keys_of(load(blob)["keys"])
            at = np.minimum(np.searchsorted(have, keys), max(0, len(have) - 1))
            hit = have[at] == keys if len(have) else np.zeros(len(keys), bool)
            rows.append((kind, shard, path, dump(hit=np.packbits(hit), **{k: x[at[hit]] for k, x in own.items()})))
    return pd.DataFrame(rows, columns=["kind", "shard", "block", "blob"]).astype({"kind": "int32", "shard": "int32"})


def _scored(grid: Grid, shards: int, sent, totals: dict):
    """A block's answers to a row a document: doc_id, t, u, n, a (mean log ratio)."""

    def run(pdf):
        b = Block(get_range(pdf["block"].iloc[0]))
        pairs, token = np.unique(b.pairs, return_inverse=True)
        b.pairs, token = None, token.astype(np.int32)
        asked = questions(b, pairs, grid, shards, sent.value)
        stats, counts = {k: np.zeros(len(b.words)) for k in STATS}, {k: np.zeros(len(pairs)) for k in ("no", "nt")}
        for kind, shard, blob in pdf[["kind", "shard", "blob"]].itertuples(index=False):
            if kind >= 0:
                z, own = load(blob), asked[kind, shard][1]
                own = own[np.unpackbits(z.pop("hit"), count=len(own)).astype(bool)]
                for k, x in z.items():
                    (stats if kind else counts)[k][own] = x
        ratios = np.zeros(len(pairs))
        for at in range(0, len(pairs), CHUNK):
            part = slice(at, at + CHUNK)
            v, w = b.split(pairs[part])
            po, pt = probabilities({k: x[v] for k, x in stats.items()}, {k: x[w] for k, x in stats.items()}, counts["no"][part], counts["nt"][part], totals)
            ratios[part] = np.log(pt) - np.log(po)
        ratio = ratios[token]
        n = np.maximum(b.lengths, 1)
        mean = np.bincount(b.doc, weights=ratio, minlength=len(n)) / n
        out = pd.DataFrame({"doc_id": pd.array(b.doc_id, "Int64"), "t": b.t, "u": b.u, "n": b.lengths, "a": mean})
        out.loc[b.null, "doc_id"] = pd.NA
        return out

    return run


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> tuple[float, float]:
    """Weight and constant of a weighted logistic regression on one column, by Newton steps. A weight that isn't above 0
    (there is nothing to calibrate by) becomes 1 about the mean: more evidence never lowers a score."""
    mean = np.average(x, weights=n)
    scale = np.sqrt(np.average((x - mean) ** 2, weights=n)) + 1e-9
    z = np.stack([(x - mean) / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (n * p * (1 - p))[:, None]).T @ z + ridge * n.sum() * np.eye(2) + 1e-9
        move = np.linalg.solve(h, z.T @ (n * (y - p)) - ridge * n.sum() * w)
        w = w + np.clip(move, -5, 5)
        if abs(move).max() < 1e-8:
            break
    if w[0] <= 0:
        rate = np.clip(np.average(y, weights=n), 1e-6, 1 - 1e-6)
        return 1.0, float(np.log(rate / (1 - rate)) - mean)
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale)


def text_key() -> list[Column]:
    """t and u, 96 bits by which equal texts are known; null counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("t"), F.hash(text).alias("u")]


def evidence(docs: DataFrame, labels: DataFrame, ws: Workspace, block_tokens: int | None = None) -> DataFrame | None:
    """doc_id, t, u, n, a of every document; labels: (doc_id, y) of the rows that count. None without both classes."""
    spark = docs.sparkSession
    rows = ws.save(write_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(), F.col("text").cast("string").alias("text")), ws.path("blocks"), block_tokens or BLOCK_TOKENS), "rows")
    train = ws.save(rows.join(small(labels), "doc_id").groupBy("block").agg(F.collect_list("place").alias("places"), F.collect_list("y").alias("labels"), F.sum("n").alias("n"), *(x for c in ("words", "pairs") for x in (F.sum(c).alias(c), F.sum(F.col(c) * F.col("y")).alias(f"toxic_{c}")))), "train")
    sums = train.agg(F.count("*").alias("files"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in train.columns[3:])).first()
    files, tokens = sums.files, sums.n
    if not 0 < sums.toxic_words < sums.words:
        return None
    cells = -(-tokens // CELL_TOKENS)
    grid = Grid(cells)
    counted = train.repartition(files).mapInPandas(_counted(grid), "cell int, blob binary")
    gathered = counted.repartition(cells, "cell").groupBy("cell").applyInPandas(_gathered(cells, sums.toxic_pairs / sums.pairs), "kind int, shard int, blob binary, size long")
    parts = ws.save(gathered, "parts")
    kinds = ", ".join(f"{x} double" for x in TOTALS)
    words = ws.save(parts.where("kind = 1").repartition(cells, "shard").groupBy("shard").applyInPandas(_summed(sums.toxic_words / sums.words), f"shard int, blob binary, {kinds}"), "words")
    totals = words.agg(*(F.sum(c).alias(c) for c in TOTALS)).first().asDict() | {"R": sums.toxic_pairs / sums.pairs}
    pairs = ws.save(parts.where("kind = 0").select("shard", "blob", "size"), "pairs")
    ws.drop("parts")
    sent = spark.sparkContext.broadcast(Filter.of(pairs))  # at most MOST_BITS
    blocks = rows.select("block").distinct()
    n = max(1, blocks.count())
    asked = blocks.repartition(n).mapInPandas(_asked(grid, cells, sent), "kind int, shard int, block string, keys binary")
    told = pairs.selectExpr("0 as kind", "shard", "blob").unionAll(words.selectExpr("1 as kind", "shard", "blob"))
    one, two = (x.repartition(2 * cells, "kind", "shard").groupBy("kind", "shard") for x in (asked, told))
    answers = one.cogroup(two).applyInPandas(lambda a, b: _answered(a, b), "kind int, shard int, block string, blob binary")
    # a row for each block, should no cell or shard have any of its keys
    answers = answers.unionAll(blocks.select(F.lit(-1).alias("kind"), F.lit(-1).alias("shard"), "block", F.lit(b"").alias("blob")))
    found = answers.repartition(2 * n, "block").groupBy("block").applyInPandas(_scored(grid, cells, sent, totals), "doc_id long, t long, u int, n long, a double")
    found = ws.save(found, "evidence")
    sent.unpersist()
    for name in ("blocks", "rows", "train", "pairs", "words"):
        ws.drop(name)
    return found


def score(docs: DataFrame, labels: DataFrame, block_tokens: int | None = None) -> DataFrame:
    """doc_id, t, u (text_key), score of every document (doc_id, text): 0 to 1, higher: more likely toxic.

    Learns from every row of docs that labels (doc_id, label 0/1) covers; a repeated doc_id's labels are averaged. Rows
    with a null doc_id or label are not learnt from. One labelled document in CALIBRATION is not counted and calibrates
    the evidence instead (all do, if these lack a class). Without both classes, every score is near 1 if only toxic
    rows are known, else near 0. Null and empty texts have no tokens and an evidence of 0. Each row gives a row, equal
    texts equal scores; other columns are not read; no row, no score. Texts of any length are read whole; one text
    may be a block of its own. Smaller blocks take less memory and more disk.
    """
    ws = Workspace(docs.sparkSession, "toxic")
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("double").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    given = ws.save(given.withColumn("aside", F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION)) == 0), "labels")
    kinds = {(r.aside, r.y) for r in given.groupBy("aside", "y").count().collect()}  # four rows
    known = {y for _, y in kinds}
    found = evidence(docs, given.where("not aside").select("doc_id", "y"), ws, block_tokens) if {(False, 0), (False, 1)} <= kinds else None
    if found is None:
        only = 1 / (1 + np.exp(-30.0 if known == {1} else 30.0))
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(), F.lit(float(only)).alias("score"))
    aside = given.where("aside") if {(True, 0), (True, 1)} <= kinds else given
    # the mean difference on a scale that is fine about 0; a grid of counts, so that what the regression reads is bounded
    x = F.asinh(F.col("a") / SCALE)
    points = found.join(small(aside.select("doc_id", "y")), "doc_id").select((F.round(F.greatest(F.least(x, F.lit(12.0)), F.lit(-12.0)) * 200) / 200).alias("x"), "y").groupBy("x", "y").agg(F.count("*").alias("n")).toPandas().sort_values(["x", "y"])
    weight, constant = logistic(*(points[c].to_numpy(float) for c in ("x", "y", "n"))) if points["y"].nunique() == 2 else (1.0, 0.0)
    z = x * weight + constant
    return found.select("doc_id", "t", "u", (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))).alias("score"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.5) of every document; labels: (doc_id, toxic).

    As score() says of nulls, empty, equal and very long texts, repeated rows, empty tables and other columns. Null
    doc_ids are not held out.
    """
    scored = score(docs, training_labels(labels, "toxic", 5, 0))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
