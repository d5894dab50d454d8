"""Structured Streaming: every micro-batch is one ingest call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from kinweave.analyzer import SocialGraphAnalyzer


def ingest_stream(analyzer: SocialGraphAnalyzer, events: DataFrame, order: str = "id", vacuum_every: int | None = 100) -> DataStreamWriter:
    """A writer, to be started by the caller, that hands each batch to ``ingest_frame``.

    A batch that is repeated after a failure replaces the same lists by the
    same edges, so the graph doesn't change. After every ``vacuum_every``
    batches (None: never) states replaced more than an hour ago are deleted, so
    that what is stored follows the graph and not the number of batches.
    """

    def take(batch: DataFrame, number: int) -> None:
        analyzer.ingest_frame(batch, order=order)
        if vacuum_every and (number + 1) % vacuum_every == 0:
            analyzer.vacuum()

    return events.writeStream.foreachBatch(take)
