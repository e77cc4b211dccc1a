"""A stream of questions against a table of chunks that stands still."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def answer_stream(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Answers each micro-batch of questions; write(answers, batch number) has to bear a batch that comes twice."""

    def batch(rows: DataFrame, number: int) -> None:
        held = rows.persist()
        try:
            write(answer(held), number)
        finally:
            held.unpersist()

    return questions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
