"""Streams whose state is kept by key and ends: turns that wait for their answers, and terms that have been learned.

State lies in RocksDB under the checkpoint, so it may be larger than memory and survives restarts. A turn's state ends when
its answer comes, or, in a stream that goes on, a given time after it came alone; a term's is a single flag.
"""

from __future__ import annotations

import contextlib
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.text import strip

# The worker in which the driver asks a processor for its state doesn't get the shipped source, so processors travel whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VERSE = "book long, verse long, source_text string, target_text string"
ACTION = "source_term string, seq string, batch_reference string, method string, action string"


class Pairs(StatefulProcessor):
    """For each conversation and turn, the aligned verse as soon as both sides are there. A side that comes again before the other replaces nothing."""

    def __init__(self, wait: int | None):
        self.wait = wait

    def init(self, handle) -> None:
        self.handle = handle
        self.half = handle.getValueState("half", "side int, text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sides = {}
        if self.half.exists():
            side, text = self.half.get()
            sides[side] = text
        held = bool(sides)
        for pdf in rows:
            for side, text in zip(pdf["side"], pdf["text"], strict=True):
                sides.setdefault(int(side), text)
        if len(sides) == 2:
            if held:
                self.half.clear()
            yield pd.DataFrame({"book": [key[0]], "verse": [key[1]], "source_text": [sides[0]], "target_text": [sides[1]]})
        elif not held:
            ((side, text),) = sides.items()
            self.half.update((side, text))
            if self.wait is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.half.clear()
        return iter([])

    def close(self) -> None:
        pass


class Told(StatefulProcessor):
    """For each source term, its primary events with what they do: the first that comes learns the term, later ones update it."""

    def init(self, handle) -> None:
        self.known = handle.getValueState("known", "known boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.known.exists()
        if not known:
            self.known.update((True,))
        # A micro-batch's events of a term come in any order; its first is the one that learns.
        pdf = pd.concat(list(rows)).sort_values("seq")
        pdf["action"] = "updated"
        if not known:
            pdf.iloc[0, pdf.columns.get_loc("action")] = "learned"
        yield pdf[["source_term", "seq", "batch_reference", "method", "action"]]

    def close(self) -> None:
        pass


@contextlib.contextmanager
def _rocks(spark: SparkSession):
    """The state store that keeps state by key, for streams started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def aligned(turns: DataFrame, wait: int | None = None) -> DataFrame:
    """A stream of turns (conv_id, turn, role, text) as aligned verses; sides without text drop out.

    ``wait``: milliseconds after which a side without its other is given up. Such timers keep a stream alive, so it can't
    be run until all is read (``drained``).
    """
    side = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1)
    rows = turns.where(F.length("text") > 0).select(F.col("conv_id").cast("long").alias("book"), (F.col("turn") - side).cast("long").alias("verse"), side.alias("side"), strip(F.col("text")).alias("text")).where("side IS NOT NULL")
    return rows.groupBy("book", "verse").transformWithStateInPandas(Pairs(wait), VERSE, "Append", "None" if wait is None else "ProcessingTime")


def told(events: DataFrame) -> DataFrame:
    """A stream of match events as actions of their source terms; ``seq`` is written so that its order is that of texts."""
    number = lambda c, n: F.lpad(F.col(f"seq.{c}").cast("string"), n, "0")
    seq = F.concat_ws(" ", number("book", 20), number("stage", 4), number("verse", 20), number("part", 4), number("pos", 12), "seq.source", number("rank", 12), "seq.target")
    rows = events.where("is_primary").select("source_term", seq.alias("seq"), "batch_reference", "method")
    return rows.groupBy("source_term").transformWithStateInPandas(Told(), ACTION, "Append", "None")


def drained(stream: DataFrame, path: str, checkpoint: str) -> list[dict]:
    """Runs a stream until all that is there is read, appending its rows at ``path``; each micro-batch's progress."""
    with _rocks(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return [p if isinstance(p, dict) else p.__dict__ for p in query.recentProgress]


def state_rows(progress: list[dict]) -> list[int]:
    """How many rows the stream's state held after each micro-batch that had input."""
    return [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in progress if p["numInputRows"]]
