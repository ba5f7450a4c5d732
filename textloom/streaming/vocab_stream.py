"""Counting a vocabulary while rows arrive: the incremental counterpart of operators.vocab.counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators import vocab as V


def running_counts(stream: DataFrame, tokens: str, row_id: str) -> DataFrame:
    """token, freq, first: for output mode update or complete."""
    return V.counts(stream, tokens, row_id)


def to_table(stream: DataFrame, tokens: str, row_id: str, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch's counts as a part of a Parquet table; a repeated batch replaces its own part.

    The state is the table: memory doesn't grow with the vocabulary, and freqs() sums the parts.
    """

    def put(batch: DataFrame, n: int) -> None:
        V.counts(batch, tokens, row_id).write.mode("overwrite").parquet(f"{path}/part={n}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def freqs(parts: DataFrame) -> DataFrame:
    return parts.groupBy("token").agg(F.sum("freq").alias("freq"), F.min("first").alias("first"))
