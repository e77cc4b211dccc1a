"""Batch entry points.

    python -m sparrowfold index CHUNKS STORE              publishes chunks and their postings as a version of STORE
    python -m sparrowfold answer QUESTIONS CHUNKS OUT     answers a file of questions; CHUNKS: a table, or such a STORE
    python -m sparrowfold select INDEX QUERIES GOLD LENGTHS OUT KS      metrics of each strategy, and the chosen one
    python -m sparrowfold promote INDEX STRATEGY SELECTED               publishes one strategy's index as the selected one
    python -m sparrowfold calibrate INDEX QUERIES OUT     the gate's threshold

QUESTIONS: json rows of query_id and query; CHUNKS: parquet of chunk_id, text, page_numbers; INDEX: a store of
write_index(), with units for select; QUERIES: parquet of query_id, embedding, and is_positive for calibrate; GOLD:
parquet of query_id, group_no, unit; LENGTHS: parquet of strategy_id, target, mean_tokens; KS: ranks, such as 1,3,5;
OUT: a folder for json rows. Settings come from the environment and from a file .env in the working folder; with
PROVIDER_URL, answers come from a model, else from the evidence itself. Nothing is answered if the chunks are unfit:
readiness is checked first, and a failure ends with status 3 and what was found.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.manifest import Incompatible, require_none
from .operators.postings import Postings
from .plans import engine, evaluation
from .sources import provider, tables
from .sources.store import Scratch, Store


def readiness(chunks: DataFrame) -> DataFrame:
    """problem, n: what makes chunks unfit to answer from. No row: ready."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
    one = chunks.agg(F.count("*").alias("n"), F.count(F.when(blank("chunk_id"), 1)).alias("ids"), F.count(F.when(blank("text"), 1)).alias("texts"), F.count(F.when(F.coalesce(F.size("page_numbers") < 1, F.lit(True)), 1)).alias("pages"))
    found = {"empty": (F.col("n") == 0).cast("long"), "blank_id": F.col("ids"), "blank_text": F.col("texts"), "no_pages": F.col("pages")}
    rows = one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("problem"), v.alias("n")) for k, v in found.items())))).where("n > 0")
    twice = chunks.groupBy("chunk_id").count().where("count > 1").agg(F.count("*").alias("n")).where("n > 0")
    return rows.unionByName(twice.select(F.lit("repeated_id").alias("problem"), "n"))


def index(spark: SparkSession, chunks: str, store: str) -> None:
    """Chunks, once they are fit, and their postings: one version."""
    about = spark.read.parquet(chunks)
    require_none(readiness(about))
    built = Postings.build(about, Scratch(spark, "build").save)
    Store(spark, store).publish(built.tables() | {"chunks": about})


def answer(spark: SparkSession, questions: str, chunks: str, out: str, config: engine.Config, given: dict[str, str] | None = None) -> None:
    """chunks: a table, searched for this run alone, or a store, of which one version serves the whole run."""
    service = provider.Settings.of(given or {})
    try:
        version = Store(spark, chunks).current()
    except FileNotFoundError:
        about = spark.read.parquet(chunks)
        require_none(readiness(about))
        retrieve = engine.scanning_retriever(about)
    else:
        about = version.table("chunks")
        retrieve = engine.postings_retriever(Postings.of(version))
    asked = spark.read.schema("query_id string, query string").json(questions)
    generate = engine.model_generator(asked, service.post, service.models, config) if service else engine.extractive
    engine.answers(asked, about, retrieve, generate, config).write.mode("overwrite").json(out)


def select(spark: SparkSession, index: str, queries: str, gold: str, lengths: str, out: str, ks: list[int]) -> None:
    read = spark.read.parquet
    per, means, chosen = evaluation.evaluate_strategies(tables.read_index(spark, tables.current(spark, index)), read(queries), read(gold), read(lengths), ks)
    save = Scratch(spark, "select").save
    for name, rows in (("queries", save(per, "queries")), ("means", means), ("selected", chosen)):
        rows.write.mode("overwrite").json(f"{out}/{name}")


def calibrate(spark: SparkSession, index: str, queries: str, out: str) -> None:
    evaluation.calibrate(tables.read_index(spark, tables.current(spark, index)), spark.read.parquet(queries)).write.mode("overwrite").json(out)


def main(argv: list[str]) -> int:
    wanted = {"index": 2, "answer": 3, "select": 6, "promote": 3, "calibrate": 3}
    if not argv or wanted.get(argv[0]) != len(argv) - 1:
        print(__doc__, file=sys.stderr)
        return 2
    command, *rest = argv
    spark = SparkSession.builder.appName("sparrowfold").getOrCreate()
    try:
        if command == "answer":
            answer(spark, *rest, engine.Config.from_env(file=".env"), engine.settings(file=".env"))
        elif command == "select":
            select(spark, *rest[:-1], [int(k) for k in rest[-1].split(",")])
        elif command == "promote":
            tables.promote(spark, *rest)
        else:
            {"index": index, "calibrate": calibrate}[command](spark, *rest)
    except Incompatible as e:
        print(f"not ready: {e}", file=sys.stderr)
        return 3
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
