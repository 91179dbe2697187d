"""Saved state: match events as the source of truth, dictionaries and histories derived from them."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

SEQ = "STRUCT<book: BIGINT, stage: INT, verse: BIGINT, part: INT, pos: BIGINT, source: STRING, rank: BIGINT, target: STRING>"
EVENTS = f"seq {SEQ}, method STRING, batch_reference STRING, verse_reference STRING, source_term STRING, target_term STRING, score DOUBLE, is_primary BOOLEAN"

#: About how many rows of a table a task should sort or hash. With many fewer a large table would sooner have more
#: parts than Spark writes without a buffer of all that a task writes (200).
ROWS = 300_000
#: The most rows of a cut table's file. Spark packs at most 32 files of 4 MB or less (its ``openCostInBytes``) into what a
#: task reads, so a task that deals such a table into more than 200 parts buffers a bounded number of rows.
FILE_ROWS = 100_000

#: Where each application's cut tables lie.
_CUTS: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the checkpoint folder, which driver and executors share; a local one only where all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp()}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The table with its lineage cut: written once, so that plans that use it often stay small and read only the columns they need.

    Few large tasks may write it; its files are small all the same, as encoded rows take many times less than in a task.
    All tables that an application cuts lie in one folder, ``cut-<application>``, to be removed when it has ended.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if app not in _CUTS:
        _CUTS[app] = folder(spark, f"cut-{app}")
    path = f"{_CUTS[app]}/{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(rows: DataFrame, times: int = 1) -> int:
    """Into how many tasks a table is to be dealt, so that what one holds doesn't grow with the input.

    To be given to ``repartition``: adaptive execution makes few and large tasks of what is dealt without a number. The
    rows are counted, which is cheap where they have been ``cut``. A task may hold ``times`` as many where rows are small.
    """
    return max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / (times * ROWS)))


def append_events(events: DataFrame, path: str, number: int) -> None:
    """Events of one micro-batch; one that is saved again replaces itself."""
    events.write.mode("overwrite").parquet(f"{path.rstrip('/')}/micro_batch={number}")


def restore_events(spark: SparkSession, path: str) -> DataFrame | None:
    """Saved events, or None where there are none."""
    try:
        return spark.read.schema(f"{EVENTS}, micro_batch LONG").parquet(path).drop("micro_batch")
    except AnalysisException:
        return None


def save_state(path: str, events: DataFrame, counts: DataFrame, verses: DataFrame) -> None:
    """What a run has learned and seen: its events, co-occurrences (book, source_term, target_term, cnt) and verse references."""
    events.write.mode("overwrite").parquet(f"{path}/events")
    counts.write.mode("overwrite").parquet(f"{path}/cooccurrences")
    verses.select("verse_reference").write.mode("overwrite").parquet(f"{path}/verses_processed")


def restore_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame] | tuple[None, None, None]:
    """Events, co-occurrences and verse references of a saved run; three Nones where there is none."""
    try:
        return spark.read.schema(EVENTS).parquet(f"{path}/events"), spark.read.parquet(f"{path}/cooccurrences"), spark.read.parquet(f"{path}/verses_processed")
    except AnalysisException:
        return None, None, None


def dictionary_json(learned: DataFrame) -> DataFrame:
    """A JSON document for each source term: its targets in first-seen order, when it was first learned and last updated."""
    entry = F.struct("target_term", "confidence_score", "is_primary")
    rows = learned.groupBy("source_term").agg(F.array_sort(F.collect_list(F.struct(F.col("target_ord").alias("o"), entry.alias("e")))).alias("t"), F.min("first_learned").alias("first_learned"), F.max("last_updated").alias("last_updated"))
    return rows.select("source_term", F.to_json(F.struct(F.transform("t", lambda x: x.e).alias("learned_targets"), "first_learned", "last_updated")).alias("entry"))


TARGETS = "learned_targets ARRAY<STRUCT<target_term: STRING, confidence_score: DOUBLE, is_primary: BOOLEAN>>, first_learned STRING, last_updated STRING"


def from_json(documents: DataFrame) -> DataFrame:
    """Learned rows of JSON documents, as ``dictionary_json`` makes them."""
    rows = documents.select("source_term", F.from_json("entry", TARGETS).alias("e"))
    return rows.select("source_term", F.posexplode("e.learned_targets").alias("target_ord", "t"), "e.first_learned", "e.last_updated").select("source_term", "t.target_term", "t.confidence_score", "t.is_primary", "first_learned", "last_updated", (F.col("target_ord") + 1).alias("target_ord"))


def append_history(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def batches_processed(events: DataFrame) -> DataFrame:
    """batch_reference of each batch with events, in the order of its first."""
    first = events.groupBy("batch_reference").agg(F.min("seq").alias("first_seq"))
    return first.orderBy("first_seq", "batch_reference").select("batch_reference")


def history_totals(history: DataFrame) -> DataFrame:
    """Runs saved so far, the first and the last."""
    return history.agg(F.count("*").alias("total"), F.min("created").alias("created"), F.max("created").alias("last_updated"))


def append_tuning(rows: DataFrame, path: str) -> DataFrame:
    """Adds runs (batch, created and their metrics) to a history and returns its totals."""
    append_history(rows, path)
    return history_totals(rows.sparkSession.read.schema(rows.schema).parquet(path))


def save_model(spark: SparkSession, model: bytes, path: str) -> None:
    """A model's bytes, whatever made them, where the driver and all executors can read them."""
    spark.createDataFrame([(bytearray(model),)], "model BINARY").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> bytes | None:
    """A saved model's bytes, or None where there is none."""
    try:
        return bytes(spark.read.schema("model BINARY").parquet(path).first()["model"])
    except AnalysisException:
        return None


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def backup(spark: SparkSession, path: str) -> str | None:
    """A copy beside a saved table, made by the executors; None where there is none."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException:
        return None
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}_backup")
    return f"{path.rstrip('/')}_backup"
