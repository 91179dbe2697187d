"""Learning in ordered micro-batches: each one adds its events under its own number, and the dictionary follows from all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.store import append_events, restore_events


def learn_stream(spark: SparkSession, source: DataFrame, learn: Callable[[DataFrame], DataFrame], events: str, checkpoint: str) -> DataFrame:
    """Runs ``learn`` on every micro-batch of a streaming table until all that is there is read; returns all events.

    ``learn`` gives the events of a micro-batch's rows, which must be complete: what lies in several files, as a turn and
    its answer may, is joined in ``source`` before, and the join's state waits for the other side. A micro-batch that runs
    again after a failure writes the same number again, so nothing is lost and nothing counts twice. ``checkpoint`` holds
    how far the stream has come and the state of its joins, so a later call goes on where this one ended.
    """

    def save(rows: DataFrame, number: int) -> None:
        append_events(learn(rows), events, number)

    query = source.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return restore_events(spark, events)
