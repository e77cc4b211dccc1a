"""Token ids in raw shard files, found by key through a minimal perfect hash index.

A shard file: magic, the ids of its documents in ascending doc_id order, then a footer (keys, null flags, first id of
each document) and a trailer. An index file covers one bucket of keys: the bit levels of a minimal perfect hash and,
for each of its numbers, a fingerprint, the shard, the document's place in it and the count of documents of that key,
which may go on at the beginning of the shards that follow.
"""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, get_range, partitions_for, put_file
from .wordbpe import encoder, slices

MAGIC, TRAILER = b"IDSHARD1", "<QQII8s"  # documents, ids, bytes an id, crc32 of the footer, magic
GAMMA, BUCKET_KEYS = 2.0, 200_000
#: The bucket number of the null key is the count of the other buckets.
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """splitmix64 of each key and a seed."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.int64).view(np.uint64) + np.uint64(seed + 1) * _MIX[0]
        z = (z ^ (z >> np.uint64(30))) * _MIX[1]
        z = (z ^ (z >> np.uint64(27))) * _MIX[2]
        return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: levels of bits, each set where exactly one key falls."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.rank, at = [], 0
        for bits in levels:
            self.rank.append(at + np.cumsum(bits, dtype=np.int64) - bits)
            at += int(bits.sum())
        self.size = at

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            n = max(64, int(GAMMA * len(keys)))
            at = (mixed(keys, len(levels)) % np.uint64(n)).astype(np.int64)
            alone = np.bincount(at, minlength=n) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels)

    def number(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number below size; for a key not built in, any number or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = (mixed(keys[left], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.rank[k][at[hit]]
            left = left[~hit]
        return out

    def dump(self) -> dict:
        return {"sizes": np.array([len(x) for x in self.levels], np.int64), "bits": np.packbits(np.concatenate(self.levels)) if self.levels else np.zeros(0, np.uint8)}

    @classmethod
    def load(cls, sizes, bits) -> PerfectHash:
        flat = np.unpackbits(bits)[: int(sizes.sum())].astype(bool)
        return cls(np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else [])


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1000) >> np.uint64(32)).astype(np.uint32)


def read_footer(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """keys, null flags, first id of each document and the end, bytes an id, count of ids; checks both magics and the crc."""
    n, ids, width, crc, magic = struct.unpack(TRAILER, get_range(path, -struct.calcsize(TRAILER), struct.calcsize(TRAILER)))
    raw = get_range(path, len(MAGIC) + ids * width, 8 * n + n + 8 * (n + 1))
    if magic != MAGIC or zlib.crc32(raw) != crc:
        raise ValueError(f"damaged shard {path}")
    return np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "u1", n, 8 * n), np.frombuffer(raw, "<u8", n + 1, 9 * n), width, ids


def write_shards(docs: DataFrame, root: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """One shard file a range of doc_ids; returns shard, path, docs, ids (a row a shard)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the second column lets a doc_id of very many rows be dealt over several shards
    salted = rows.withColumn("salt", F.rand(7))
    ranged = salted.repartitionByRange(partitions_for(rows), F.col("doc_id").asc_nulls_first(), "salt").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "salt").drop("salt")

    def run(batches):
        enc = encoder(tokenizer_path)
        shard = TaskContext.get().partitionId()
        path = f"{root}/shard-{shard:06d}.ids"
        keys, lengths = [], []

        def chunks():
            yield MAGIC
            for batch in batches:
                keys.append(batch.column("doc_id"))
                for _, texts in slices(batch):
                    ids, bounds = enc.encode_ended(texts, end_id)
                    lengths.append(np.diff(bounds))
                    yield ids.tobytes()
            starts = np.cumsum(np.concatenate([np.zeros(1, np.int64), *lengths]))
            own = pa.chunked_array(keys, pa.int64())
            footer = own.fill_null(0).to_numpy().astype("<i8").tobytes() + own.is_null().to_numpy().astype("u1").tobytes() + starts.astype("<u8").tobytes()
            yield footer
            yield struct.pack(TRAILER, len(own), int(starts[-1]), enc.dtype.itemsize, zlib.crc32(footer), MAGIC)

        put_file(path, chunks())
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "docs": [sum(map(len, keys))], "ids": [int(sum(x.sum() for x in lengths))]}, pa.schema([("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    return ranged.mapInArrow(run, "shard int, path string, docs long, ids long")


class TokenStore:
    """Shards and index of one corpus. The manifest has a row a shard and a row an index bucket, not a row a document."""

    def __init__(self, spark, shards: pd.DataFrame, buckets: int, index_root: str):
        self.spark, self.buckets, self.index_root = spark, buckets, index_root
        #: the buckets that have keys, and so a file
        self.listed: set[int] = set()
        self.shards = shards.sort_values("shard").reset_index(drop=True)
        self.shards["first"] = self.shards["ids"].cumsum() - self.shards["ids"]

    @classmethod
    def write(cls, docs: DataFrame, tokenizer_path: str, end_id: int, ws: Workspace) -> TokenStore:
        """Encodes (doc_id, text), writes shards in ascending doc_id order (null first), then the index.

        Null or empty text: the end id alone. Repeated doc_ids lie side by side, over several shards if they are very
        many, and are found together. Texts of any length are encoded whole. No row: a store without shards, in which
        nothing is found. Other columns are not read.
        """
        spark = docs.sparkSession
        shards = ws.save(write_shards(docs, ws.path("shards"), tokenizer_path, end_id), "manifest").toPandas()
        shards = shards[shards["docs"] > 0]
        buckets = max(1, -(-int(shards["docs"].sum()) // BUCKET_KEYS)) if len(shards) else 1
        store = cls(spark, shards, buckets, ws.path("index"))
        if len(shards):
            store._write_index(ws)
        return store

    def _files(self, columns: list[str]) -> DataFrame:
        frame = self.spark.createDataFrame(self.shards[columns])
        return frame.repartition(max(1, len(self.shards)), "shard")

    def _write_index(self, ws: Workspace) -> None:
        buckets, root = self.buckets, self.index_root

        def entries(batches):
            for batch in batches:
                for shard, path in zip(batch["shard"], batch["path"]):
                    keys, nulls, _, _, _ = read_footer(path)
                    # equal keys are neighbours: a run of them is one entry
                    new = np.ones(len(keys), bool)
                    new[1:] = (keys[1:] != keys[:-1]) | (nulls[1:] != nulls[:-1])
                    at = np.flatnonzero(new)
                    bucket = np.where(nulls[at] == 1, buckets, (mixed(keys[at], 2000) % np.uint64(buckets)).astype(np.int64))
                    yield pd.DataFrame({"bucket": bucket, "key": keys[at], "shard": shard, "place": at, "run": np.diff(np.append(at, len(keys)))})

        def build(pdf):
            bucket = int(pdf["bucket"].iloc[0])
            # shards are ranges: a key's entries of several shards are one run
            pdf = pdf.sort_values(["key", "shard"]).groupby("key", sort=False, as_index=False).agg({"shard": "first", "place": "first", "run": "sum"})
            keys = pdf["key"].to_numpy(np.int64)
            mph = PerfectHash.build(keys)
            order = np.argsort(mph.number(keys))
            out = io.BytesIO()
            np.savez(out, **mph.dump(), fingerprint=fingerprint(keys)[order], shard=pdf["shard"].to_numpy(np.int32)[order], place=pdf["place"].to_numpy(np.int64)[order], run=pdf["run"].to_numpy(np.int64)[order])
            put_file(f"{root}/bucket-{bucket:06d}.mph", [out.getvalue()])
            return pd.DataFrame({"bucket": [bucket], "keys": [len(keys)]})

        rows = self._files(["shard", "path"]).mapInPandas(entries, "bucket long, key long, shard int, place long, run long")
        manifest = ws.save(rows.groupBy("bucket").applyInPandas(build, "bucket long, keys long"), "index-manifest")
        self.listed = {r.bucket for r in manifest.select("bucket").collect()}  # a row a bucket

    def get(self, keys: DataFrame) -> DataFrame:
        """For each distinct doc_id of keys (null too): doc_id, start, n_tokens, ids (bytes), width, of every document of that key.

        Keys that the store lacks give no row: the stored fingerprint, then the shard's own key, rule them out. A file
        of the index or of the shards that is gone is an error.
        """
        if not len(self.shards):
            return self.spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary, width int")
        buckets, root = self.buckets, self.index_root
        paths = dict(zip(self.shards["shard"].tolist(), zip(self.shards["path"], self.shards["first"].tolist())))
        known = self.spark.sparkContext.broadcast((paths, self.shards["docs"].tolist(), self.listed))  # a row a shard and a number a bucket
        order = {shard: k for k, shard in enumerate(self.shards["shard"].tolist())}

        def bucket_of(ids: pd.Series) -> pd.Series:
            return pd.Series(np.where(ids.isna(), buckets, (mixed(ids.fillna(0).to_numpy(np.int64), 2000) % np.uint64(buckets)).astype(np.int64)))

        def locate(batches):
            loaded = {}
            sizes, listed = known.value[1:]
            numbers = list(order)

            def portions(key, nil, shard, place, run):
                at = order[shard]
                while run > 0:
                    own = min(run, sizes[at] - place)
                    yield key, nil, numbers[at], place, own
                    at, place, run = at + 1, 0, run - own

            for pdf in batches:
                nulls = pdf["doc_id"].isna()
                for bucket, part in pdf.assign(bucket=bucket_of(pdf["doc_id"])).groupby("bucket"):
                    if bucket not in listed:
                        continue  # a bucket without keys
                    if bucket not in loaded:
                        loaded.clear()
                        z = np.load(io.BytesIO(get_range(f"{root}/bucket-{bucket:06d}.mph")))
                        loaded[bucket] = (PerfectHash.load(z["sizes"], z["bits"]), *(z[k] for k in ("fingerprint", "shard", "place", "run")))
                    mph, prints, shard, place, run = loaded[bucket]
                    ids = part["doc_id"].fillna(0).to_numpy(np.int64)
                    n = mph.number(ids)
                    ok = (n >= 0) & (prints[n] == fingerprint(ids))
                    found = zip(ids[ok].tolist(), nulls[part.index][ok].tolist(), shard[n[ok]].tolist(), place[n[ok]].tolist(), run[n[ok]].tolist())
                    yield pd.DataFrame([x for entry in found for x in portions(*entry)], columns=["doc_id", "nil", "shard", "place", "run"])

        def fetch(batches):
            path, footer, block = None, None, b""
            for pdf in batches:
                out = []
                for key, nil, shard, place, run in pdf[["doc_id", "nil", "shard", "place", "run"]].itertuples(index=False):
                    if known.value[0][shard][0] != path:
                        path, base = known.value[0][shard]
                        footer, block, lo = read_footer(path), b"", 0
                    stored, nulls, starts, width, _ = footer
                    for at in range(place, place + run):
                        if stored[at] != key or nulls[at] != nil:
                            continue
                        a, b = int(starts[at]), int(starts[at + 1])
                        if not (lo <= a and b * width <= lo * width + len(block)):
                            lo, block = a, get_range(path, len(MAGIC) + a * width, max((b - a) * width, min(8 << 20, (int(starts[-1]) - a) * width)))
                        out.append((None if nil else key, base + a, b - a, block[(a - lo) * width : (b - lo) * width], width))
                        if len(out) == 2000:
                            yield pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids", "width"]).astype({"doc_id": "Int64"})
                            out = []
                yield pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids", "width"]).astype({"doc_id": "Int64"})

        wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        # the bucket in SQL would need the same hash; rows keep to their partition and a worker loads the buckets it meets
        spread = F.pandas_udf(bucket_of, "long")
        n = partitions_for(wanted)
        located = wanted.withColumn("bucket", spread("doc_id")).repartition(n, "bucket").sortWithinPartitions("bucket").select("doc_id").mapInPandas(locate, "doc_id long, nil boolean, shard int, place long, run long")
        return located.repartition(n, "shard").sortWithinPartitions("shard", "place").mapInPandas(fetch, "doc_id long, start long, n_tokens long, ids binary, width int")


def ids_crc32(ids: Column, width: Column) -> Column:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""

    @F.pandas_udf("long")
    def run(ids: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(np.frombuffer(x, f"<u{w}").astype("<u4").tobytes()) for x, w in zip(ids, width)], dtype="int64")

    return run(ids, width)
