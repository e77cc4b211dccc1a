"""Queries of this subpackage: each applies one operator to its whole table and returns its digest.

Nulls, empty and very long texts, ties, repeated rows, empty tables and other columns: as the operators state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, table

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Rules of op4's contract: verdict, host, path.
PAGE_RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's ids lie in the shards and their crc32, read back from the files through the index."""
    from .token_store import TokenStore, ids_crc32

    docs = table(spark, sf_dir, "documents")
    store = TokenStore.write(docs, WORDS, 2, Workspace(spark, "op1"))
    return store.get(docs).select("doc_id", "start", "n_tokens", ids_crc32("ids", "width").alias("ids_crc32"))


def op2_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the field's verdict of every document; the field learns from quality labels that op7 may learn from."""
    from .line_crf import judge
    from .rff_quality import training_labels

    return judge(table(spark, sf_dir, "documents"), training_labels(table(spark, sf_dir, "labels"), "quality", 3, 1))


def op3_duck_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes that they decode to, for every document."""
    from .duck_bpe import code

    return code(table(spark, sf_dir, "documents"), BYTES, public_tokenizers.PATTERN)


def op4_url_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page."""
    from .url_alias import judge

    return judge(table(spark, sf_dir, "pages"), PAGE_RULES)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document, each a sequence of a power of two."""
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), WORDS, 1, with_ids=False)


def op6_neural_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose vec_id 20 divides, among all others."""
    from .neural_partition import search

    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op7_rff_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document."""
    from .rff_quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every document, from 85 percent of five-word shingles in common."""
    from .superminhash import groups

    return groups(table(spark, sf_dir, "documents"))


def op9_kn_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every document."""
    from .kn_toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets in every document."""
    from .secret_scan import digest, scan

    return digest(scan(table(spark, sf_dir, "documents")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, root and near words of every frequent word of the documents."""
    from .spelling_variants import variants

    return variants(table(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows of benchmark items, and these items."""
    from .decontamination import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and the repaired digest of every conversation, after the damage."""
    from .conversation_repair import digest

    return digest(table(spark, sf_dir, "conversations"))


def queries() -> dict:
    """The thirteen operators; __spark_entry__ adds the pipeline."""
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    from . import conversation_repair, decontamination, spelling_variants, url_alias

    return {
        "op4_url_alias": url_alias.ORACLE_SQL, "op11_spelling_variants": spelling_variants.ORACLE_SQL,
        "op12_decontamination": decontamination.ORACLE_SQL, "op13_conversation_repair": conversation_repair.ORACLE_SQL,
    }
