"""Questions to grounded answers, a table at a time."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import query_status, strip
from ..operators import grounding, postings, retrieval
from ..sources import provider
from ..sources.store import Scratch


def settings(env: Mapping[str, str] | None = None, file: str | None = None) -> dict[str, str]:
    """Values by name in lower case, from the environment over those of a file of NAME=value lines."""
    given: dict[str, str] = {}
    if file and os.path.exists(file):
        with open(file, encoding="utf-8") as f:
            pairs = [line.split("=", 1) for line in f if "=" in line and not line.lstrip().startswith("#")]
        given = {k.strip().lower(): v.strip().strip("'\"") for k, v in pairs}
    return given | {k.lower(): v for k, v in (os.environ if env is None else env).items()}


@dataclass(frozen=True)
class Config:
    """Limits of a flow; values out of bounds raise."""

    top_k: int = 10
    final_k: int = 4
    threshold: float = 0.0
    snippet_chars: int = 420
    attempts: int = 2
    max_tokens: int = 512
    hard_limit: int = 512
    window: int = 8

    def __post_init__(self):
        checks = {
            "top_k": 1 <= self.top_k <= 50, "final_k": 1 <= self.final_k <= min(10, self.top_k), "threshold": -1 <= self.threshold <= 1, "snippet_chars": self.snippet_chars >= 20,
            "attempts": self.attempts >= 1, "max_tokens": self.max_tokens >= 1, "hard_limit": self.hard_limit >= 1,
            "window": 1 <= self.window <= 256,
        }
        if bad := [k for k, ok in checks.items() if not ok]:
            raise ValueError(f"out of bounds: {', '.join(bad)}")

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, file: str | None = None) -> Config:
        """Settings from the environment (names in any case, such as TOP_K), over those of a file of NAME=value lines.

        What neither names has its default; other names are passed over; what is no number, or out of bounds, raises.
        """
        given = settings(env, file)
        return cls(**{f.name: type(f.default)(given[f.name]) for f in fields(cls) if f.name in given})


Retriever = Callable[[DataFrame, int], DataFrame]
Generator = Callable[[DataFrame], DataFrame]


def sparse_retriever(chunks: DataFrame) -> Retriever:
    """Retrieval by term vectors over chunks (chunk_id, text), which are indexed once, at the first questions."""
    built: list[Retriever] = []

    def run(questions: DataFrame, k: int) -> DataFrame:
        if not built:
            built.append(postings_retriever(postings.Postings.build(chunks, Scratch(chunks.sparkSession, "postings").save)))
        return built[0](questions, k)

    return run


def scanning_retriever(chunks: DataFrame) -> Retriever:
    """Retrieval by term vectors over chunks (chunk_id, text) for one set of questions: few of them scan the chunks, many build an index."""
    return lambda questions, k: postings.sparse_top_k(chunks, questions.select("query_id", F.col("query").alias("text")), k)


def postings_retriever(index: postings.Postings) -> Retriever:
    """Retrieval over a built or published index of postings."""

    def run(questions: DataFrame, k: int) -> DataFrame:
        return postings.search(index, questions.select("query_id", F.col("query").alias("text")), k, Scratch(questions.sparkSession, "search").save)

    return run


def dense_retriever(index: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> Retriever:
    """Retrieval over an index (chunk_id, embedding); encode adds `embedding` to questions (query_id, query)."""
    return lambda questions, k: retrieval.top_k(index, encode(questions).select("query_id", "embedding"), k)


def extractive(evidence: DataFrame) -> DataFrame:
    """A generator without a model: the first evidence's text as the answer, the first two chunks as citations."""
    own = evidence.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "text"))).alias("e"))
    return own.select("query_id", F.col("e")[0]["text"].alias("answer"), F.slice(F.transform("e", lambda x: x["chunk_id"]), 1, 2).alias("citations"))


def model_generator(questions: DataFrame, post: provider.Post, models: tuple[str, ...], config: Config) -> Generator:
    """A generator that posts payloads: post(model, payload) gives a status and a body, 0 where no response came.

    A model is asked up to `attempts` times while its failures are transient. The next one gets the questions whose
    failures were such, for which the model is missing, or whose answer can't be used; a model that is listed twice is
    asked once. What a round gave is saved, so later steps don't ask again; a task that runs twice does, and post has
    to bear it. Only gated rows get here: what is not answerable costs no call. Up to `window` calls are open in a task.
    """
    names = tuple(dict.fromkeys(models))

    def answer(evidence: DataFrame) -> DataFrame:
        save = Scratch(evidence.sparkSession, "calls").save
        asked = grounding.prompts(questions.join(evidence.select("query_id").distinct(), "query_id"), evidence)
        left = save(grounding.payloads(asked, "{model}", config.max_tokens), "payloads")
        kind, done = dict(left.dtypes)["query_id"], []
        for n, model in enumerate(names):
            ask = provider.calls(post, model, config.attempts, config.window)
            posted = save(left.mapInPandas(ask, f"query_id {kind}, body string, provider_status int, attempts int"), f"posted-{n}")
            parsed = grounding.parse_completions(posted.where("body is not null").select("query_id", "body"))
            step = grounding.next_step(F.col("provider_status"), F.lit(config.attempts), F.lit(config.attempts), F.col("error").isNull())
            rows = posted.join(parsed, "query_id", "left").withColumn("step", step)
            error = F.when(F.col("body").isNull(), "provider").when(F.col("error").isNotNull(), "completion")
            own = rows.select("query_id", "answer", "citations", error.alias("error_class"), "provider_status", F.lit(model).alias("model"), F.lit(n > 0).alias("used_fallback"), "attempts", "step")
            last = n == len(names) - 1
            done.append(own if last else own.where("step <> 'fallback'"))
            if last or not (again := own.where("step = 'fallback'").select("query_id")).head(1):
                break
            left = left.join(again, "query_id", "left_semi")
        return reduce(DataFrame.unionByName, done).drop("step")

    return answer


def answers(questions: DataFrame, chunks: DataFrame, retrieve: Retriever, generate: Generator, config: Config) -> DataFrame:
    """query_id, answer, confidence_score, sources, reason, error_class, status for questions (query_id, query).

    chunks: chunk_id, text, page_numbers. Questions that are blank or too long get invalid_query. What the gate turns
    away gets the abstention, no sources and confidence 0, and never reaches the generator. A row's error stays in its row.
    """
    asked = questions.select("query_id", strip(F.col("query")).alias("query"), query_status(F.col("query")).alias("query_status"))
    fit = asked.where("query_status = 'ok'")
    hits = retrieve(fit, config.top_k)
    decisions = retrieval.gate(fit, hits, F.lit(config.threshold))
    final = hits.join(decisions.where("is_relevant").select("query_id"), "query_id", "left_semi").where(F.col("rank") <= config.final_k)
    chunks = grounding.named_chunks(chunks, final, Scratch(chunks.sparkSession, "answers").save)
    evidence = final.join(chunks.select("chunk_id", "text"), "chunk_id").select("query_id", "rank", "chunk_id", "text")
    made = generate(evidence)
    made = made if "error_class" in made.columns else made.withColumn("error_class", F.lit(None).cast("string"))
    good = made.where("error_class is null").select("query_id", "answer", "citations")
    checked = grounding.check_citations(good, final)
    cited = grounding.cited_hits(checked, final)
    about = grounding.sources(cited, chunks, config.snippet_chars)
    listed = about.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in about.columns if c != "query_id"]))).alias("sources"))
    sure = grounding.confidences(decisions.join(checked.where("status = 'ok'").select("query_id"), "query_id", "left_semi"), cited)
    rows = asked.join(decisions.select("query_id", "is_relevant", "reason"), "query_id", "left").join(checked, "query_id", "left")
    rows = rows.join(made.select("query_id", "error_class"), "query_id", "left").join(listed, "query_id", "left").join(sure, "query_id", "left")
    error = (
        F.when(F.col("query_status") != "ok", "invalid_query").when(F.col("error_class").isNotNull(), F.col("error_class"))
        .when(F.col("is_relevant") & (F.coalesce("status", F.lit("missing")) != "ok"), "citation")
    )
    rows = rows.withColumn("_error", error)
    turned = F.col("_error").isNull() & ~F.col("is_relevant")
    return rows.select(
        "query_id", F.when(turned, F.lit(grounding.ABSTENTION)).when(F.col("_error").isNull(), F.col("answer")).alias("answer"),
        F.when(turned, 0.0).when(F.col("_error").isNull(), F.col("confidence_score")).alias("confidence_score"), "sources", "reason",
        F.col("_error").alias("error_class"), grounding.status_code(F.coalesce("_error", F.lit("ok"))).alias("status"),
    )
