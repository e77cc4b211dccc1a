"""Quality scores: random Fourier features of document statistics, ridge by summed normal equations, isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Workspace, crc_mod, held

STATISTICS = (
    "log_words", "word_length", "symbols", "exclamations", "bars", "stops", "digits", "capitals", "not_ascii", "controls",
    "distinct", "stutter", "words_a_line", "lines_again", "short_lines", "capital_words", "odd_ends",
)
FOLDS = 3
#: Groups that the sums of tasks are added up in before all are.
BRANCHES = 32
#: Scores are counted in bins of this width before the isotonic fit, so that its input is bounded.
BIN, LOW, HIGH = 0.002, -1.0, 2.0
_SYMBOLS, _STOPS = b"#*$%&<>@~^_=+\\{}[]", b".,;:?"


def statistics(text: str | None) -> list[float]:
    """One number for each of STATISTICS, over the whole text; null and empty texts give zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    of = lambda chars: float(count[list(chars)].sum())
    capitals, small = float(count[65:91].sum()), float(count[97:123].sum())
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    size = sum(map(len, words))
    # a word's last byte: letters, digits and bytes of other scripts are ordinary, as are stops
    odd = sum(c in b"!#*$%&<>|@~^_=+" for c in [w[-1] for w in words])
    return [
        np.log1p(n), size / n, of(_SYMBOLS) / n, of(b"!") / n, of(b"|") / n, of(_STOPS) / n, float(count[48:58].sum()) / size, capitals / max(1.0, capitals + small),
        float(count[128:].sum()) / size, float(count[:9].sum() + count[14:32].sum()) / size, len(set(words)) / n**0.85, sum(map(eq, words, words[1:])) / n,
        np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), sum(len(x) < 20 for x in lines) / len(lines), sum(w.isupper() and len(w) > 1 for w in words) / n, odd / n,
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # raw scores where calibration is given
    values: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of rows of statistics, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.waves + self.phases) * np.sqrt(2 / len(self.phases)), np.ones((len(x), 1))])

    def score(self, texts) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), 0.5)
        raw = self.lift(np.array([statistics(t) for t in texts]).reshape(-1, len(STATISTICS))) @ self.weights
        return np.clip(np.interp(raw, self.steps, self.values), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points by x with means y and weights n: centres and values of the blocks."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x.tolist(), y.tolist(), n.tolist()):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            top = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], top)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(docs: DataFrame, labels: DataFrame, waves: int = 256, width: float = 1.0, ridge: float = 1e-3, seed: int = 7) -> Model:
    """Learns from every row of docs that labels (doc_id, label) covers; labels of a repeated doc_id are averaged.

    Rows with a null doc_id or label are not learnt from. Without any, scores are 0.5. What comes to the driver:
    means and deviations, the summed normal equations of each fold, and label counts by bin of score.
    """
    ws = Workspace(docs.sparkSession, "quality")
    size = len(STATISTICS)

    def measure(batches):
        held("quality")
        for batch in batches:
            rows = [statistics(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("double").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.avg("y").alias("y"))
    given = ws.save(given, "labels")
    if given.count() <= BROADCAST_ROWS:
        # only labelled texts are measured; of more labels, only numbers are shuffled
        keyed = keyed.join(F.broadcast(given.select("doc_id")), "doc_id", "left_semi")
    measured = keyed.mapInArrow(measure, "doc_id long, x array<double>").join(given, "doc_id")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    train = ws.save(measured.select(fold.alias("fold"), "x", "y"), "train")
    moments = train.agg(F.count("*"), *(f(F.col("x")[k]) for k in range(size) for f in (F.avg, F.stddev_pop))).first()
    if not moments[0]:
        none = np.zeros(0)
        return Model(none, none, none, none, none, none, none)
    rng = np.random.default_rng(seed)
    scale = np.array(moments[2::2], float)
    model = Model(np.array(moments[1::2], float), np.where(scale > 1e-9, scale, 1.0), rng.normal(0, width / np.sqrt(size), (size, waves)), rng.uniform(0, 2 * np.pi, waves), np.zeros(0), np.zeros(0), np.zeros(0))

    def sums(batches):
        total = np.zeros((FOLDS, waves + 1, waves + 2))
        for pdf in batches:
            z, y, f = model.lift(np.stack(pdf["x"].to_numpy())) if len(pdf) else np.zeros((0, waves + 1)), pdf["y"].to_numpy(), pdf["fold"].to_numpy()
            for k in range(FOLDS):
                own = z[f == k]
                total[k] += own.T @ np.hstack([own, y[f == k, None]])
        salt = TaskContext.get().partitionId() % BRANCHES
        yield pd.DataFrame({"row": range(FOLDS * (waves + 1)), "salt": salt, "v": [r.tobytes() for r in total.reshape(-1, waves + 2)]})

    def add(pdf):
        return pd.DataFrame({"row": pdf["row"].iloc[:1], "salt": pdf["salt"].iloc[:1], "v": [sum(np.frombuffer(v) for v in pdf["v"]).tobytes()]})

    # sums of tasks in two steps, so that no group has a row of every task
    parts = train.mapInPandas(sums, "row int, salt int, v binary").groupBy("row", "salt").applyInPandas(add, "row int, salt int, v binary")
    rows = parts.groupBy("row").applyInPandas(add, "row int, salt int, v binary").orderBy("row").collect()
    total = np.stack([np.frombuffer(r.v) for r in rows]).reshape(FOLDS, waves + 1, waves + 2)

    def solve(t):
        n = max(1.0, t[-1, -2])
        return np.linalg.solve(t[:, :-1] + ridge * n * np.eye(waves + 1) + 0.5 * np.eye(waves + 1), t[:, -1])

    model.weights = solve(total.sum(0))
    crossed = [solve(total.sum(0) - total[k]) for k in range(FOLDS)]

    def bins(batches):
        for pdf in batches:
            if len(pdf):
                raw = np.einsum("nd,nd->n", model.lift(np.stack(pdf["x"].to_numpy())), np.stack(crossed)[pdf["fold"].to_numpy()])
                yield pd.DataFrame({"bin": np.round(np.clip(raw, LOW, HIGH) / BIN).astype(np.int64), "y": pdf["y"]})

    counts = train.mapInPandas(bins, "bin long, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").toPandas()
    # a row of each label at the ends keeps values off 0 and 1
    x, y, n = counts["bin"] * BIN, counts["y"], counts["n"]
    model.steps, model.values = isotonic(np.concatenate([[LOW], x, [HIGH]]), np.concatenate([[0.0], y, [1.0]]), np.concatenate([[1], n, [1]]))
    return model


def quality(model: Model, text: Column) -> Column:
    """The calibrated score of each whole text, 0 to 1."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        held("quality")
        return pd.Series(model.score(texts.tolist()), dtype="float64")

    return run(text.cast("string"))


def training_labels(labels: DataFrame, column: str, folds: int, held_out: int) -> DataFrame:
    """(doc_id, label) of the rows that may be learnt from."""
    return labels.where(crc_mod("doc_id", folds) != held_out).select("doc_id", F.col(column).alias("label"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels: (doc_id, quality).

    Null and empty texts are scored as texts without words, texts of any length whole. Null doc_ids are not held out. Repeated
    doc_ids give a row each, no row none; a score of 0.5 is predicted 1. Other columns are not read.
    """
    model = fit(docs, training_labels(labels, "quality", 3, 1))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), quality(model, F.col("text")).alias("score"))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
