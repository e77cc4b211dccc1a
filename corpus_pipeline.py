"""The corpus pipeline: toxic and low-quality documents go, one of each group of near copies stays, secrets are masked, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowfold.llm import kn_toxicity, rff_quality, superminhash
from sparrowfold.llm.common import Workspace, lean, retire_workers, small, table
from sparrowfold.llm.packing import pack
from sparrowfold.llm.queries import WORDS
from sparrowfold.llm.rff_quality import training_labels
from sparrowfold.llm.secret_scan import redacted


def fresh(docs: DataFrame, count: int) -> list[str]:
    """Column names that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    return [c for c in (f"_{k}" for k in range(len(taken) + count)) if c not in taken][:count]


def without(docs: DataFrame, keys: list, gone: DataFrame, kind: str = "left_anti") -> DataFrame:
    """Rows of docs whose keys (none null) are not among those of gone (or are, for left_semi)."""
    names = fresh(docs, len(keys))
    return docs.withColumns(dict(zip(names, keys))).join(small(gone.toDF(*names)), names, kind).select(*(f"`{c}`" for c in docs.columns))


#: Rows that go to Python at a time: workers keep what all stages take, beside the JVM.
ROWS = "1000"


def begin(spark: SparkSession) -> None:
    """Before a stage: small batches, and none of the workers of the stage before."""
    lean(spark, ROWS)
    retire_workers(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney models don't call toxic (score below 0.5).

    Rows go by their text, so rows with a null or repeated doc_id are judged like others; null and empty texts are
    judged as texts without words. Texts of any length are judged whole. No row in, no row out; other columns, whatever their names, come back as they
    were.
    """
    begin(spark)
    scored = kn_toxicity.score(docs, training_labels(table(spark, sf_dir, "labels"), "toxic", 5, 0), block_tokens=1_000_000)
    toxic = Workspace(spark, "toxic").save(scored.where("score >= 0.5").select("t", "u").distinct(), "toxic")
    return without(docs, kn_toxicity.text_key(), toxic)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated quality is 0.5 or more.

    Each row is judged by its own text; null and empty texts as texts without words. Null and repeated doc_ids stay
    or go like others. Texts of any length are judged whole. No row in, no row out; other columns, whatever their names,
    come back as they were.
    """
    begin(spark)
    model = rff_quality.fit(docs, training_labels(table(spark, sf_dir, "labels"), "quality", 3, 1))
    return docs.where(rff_quality.quality(model, docs["text"]) >= 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (80 percent of five-word shingles in common, in chains): the one of
    the smallest doc_id, and of its rows the first by text.

    Rows with a null doc_id stay, and so do documents without words, unless their doc_id is repeated. Of wholly equal
    rows of one doc_id one stays. Texts of any length are compared whole. No row in, no row out; other columns, whatever
    their names, come back as they were.
    """
    begin(spark)
    ws = Workspace(spark, "dedup")
    found = ws.save(superminhash.groups(docs, percent=80), "groups")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    gone = found.where("doc_id is not null and not kept").select("doc_id").distinct()
    named = [key, F.col("doc_id").isNotNull()]
    out = without(docs, named, gone.select("doc_id", F.lit(True)))
    repeated = ws.save(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("known")), "repeated")
    if repeated.isEmpty():
        return out
    (number,) = fresh(docs, 1)
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last()))
    several = without(out, named, repeated, "left_semi").withColumn(number, first).where(F.col(number) == 1).drop(number)
    return without(out, named, repeated).unionByName(several)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts replaced; n_chars, where there is such a column, is the new length.

    Null texts stay null, with a null n_chars; empty texts stay empty; texts of any length are searched whole. Every row gives a row, repeated or not; other
    columns, whatever their names, come back as they were.
    """
    begin(spark)
    out = docs.withColumn("text", redacted(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths, with their ids.

    Null and empty texts are packed as their end id alone; null and repeated doc_ids as they are, each row by itself;
    a long text gives as many sequences as it fills. No row in, no row out; other columns aren't read.
    """
    begin(spark)
    return pack(docs, WORDS, 1, lean=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", drop_low_quality),
    ("minhash_near_dedup", drop_near_copies),
    ("secret_scans", mask_secrets),
    ("packing", pack_sequences),
]

#: Classifiers and tokenizers are no SQL; the pipeline is tested stage by stage against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ws = Workspace(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = ws.save(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            ws.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
