"""Packing by powers of two: a document is cut into pieces of binary lengths, each a sequence without padding."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, small
from .wordbpe import LEAN_SLICE, encoder, slices

MAX_TOKENS = 2048


def binary_lengths(n: int, longest: int = MAX_TOKENS) -> list[int]:
    """Lengths that add up to n: as many of the longest as fit, then the binary digits of the rest, largest first."""
    assert longest & (longest - 1) == 0
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def cut(docs: DataFrame, tokenizer_path: str, end_id: int, longest: int = MAX_TOKENS, with_ids: bool = True, lean: bool = False) -> DataFrame:
    """Pieces of every document (doc_id, text): one row a piece, ordinal counted for each length in its partition."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, ordinal long" + ", ids binary" * with_ids

    def run(batches):
        enc = encoder(tokenizer_path, lean)
        part, seen = TaskContext.get().partitionId(), [0] * 64
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for first, texts in slices(batch, **({"size": LEAN_SLICE} if lean else {})):
                ids, bounds = enc.encode_ended(texts, end_id)
                raw, bounds = memoryview(ids.astype("<u4")).cast("B"), bounds.tolist()
                out = [[] for _ in range(8)]
                for k, (start, stop) in enumerate(zip(bounds, bounds[1:])):
                    at = start
                    for n in binary_lengths(stop - start, longest):
                        payload = raw[4 * at : 4 * (at + n)]
                        bucket = n.bit_length()
                        for column, value in zip(out, (keys[first + k], at - start, n, zlib.crc32(payload), stop - start, part, seen[bucket], payload)):
                            column.append(value)
                        seen[bucket] += 1
                        at += n
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()] + [pa.binary()] * with_ids
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "ordinal"] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, longest: int = MAX_TOKENS, with_ids: bool = True, lean: bool = False) -> DataFrame:
    """Sequences of at most `longest` (a power of two) tokens over every document, without padding.

    A document's ids and end_id are cut into pieces whose lengths are powers of two; pieces of one length form a
    bucket, and each piece is a sequence of that bucket, so no sequence crosses documents and none is padded.
    sequence_id numbers the sequences from 0, longest bucket first. Null or empty text: the end id alone. Null and
    repeated doc_ids: packed as they are, each row by itself. No row in, no row out. Other columns are not read.
    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (always 0), and ids (little-endian
    unsigned 32-bit) if with_ids. lean takes less memory and more time.
    """
    ws = Workspace(docs.sparkSession, "pack")
    pieces = ws.save(cut(docs, tokenizer_path, end_id, longest, with_ids, lean), "pieces")
    # a row for each length and partition; lengths follow each other, the largest first, and partitions within a length
    counts = ws.save(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    totals = counts.groupBy("length").agg(F.sum("n").alias("total"))
    lengths = totals.select("length", (F.sum("total").over(Window.orderBy(F.desc("length"))) - F.col("total")).alias("before"))  # 12 rows
    within = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    bases = counts.select("length", "part", within.alias("within"), "n").join(F.broadcast(lengths), "length").select("length", "part", (F.col("before") + F.col("within")).alias("base"))
    numbered = pieces.join(small(ws.save(bases, "bases")), ["length", "part"])
    return numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("ordinal")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *["ids"] * with_ids)
