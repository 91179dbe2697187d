"""Co-occurrence counts that grow: a snapshot, the deltas since, and both summed when read.

A run adds only the counts of its own verses, as a delta under its number, and never reads earlier ones. ``compacted`` sums
all that it finds into a new snapshot and names it in a small marker table last, so a reader sees either the old snapshot
with its deltas or the new one, and a run that fails half-way leaves only files that nothing names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

COUNTS = "batch_reference STRING, source_term STRING, target_term STRING, cnt LONG"
KEYS = ["batch_reference", "source_term", "target_term"]
#: The number up to which deltas are in the snapshot of the same number.
MARK = "upto LONG"


def append_delta(counts: DataFrame, path: str, number: int) -> None:
    """A run's counts, as its delta; a run that is saved again replaces its own. Numbers start at 1 and grow."""
    if number <= snapshot(counts.sparkSession, path):
        raise ValueError(f"delta {number} is in the snapshot already")
    counts.groupBy(*KEYS).agg(F.sum("cnt").alias("cnt")).write.mode("overwrite").parquet(f"{path}/deltas/number={number}")


def snapshot(spark: SparkSession, path: str) -> int:
    """The number of the newest snapshot, 0 where there is none."""
    try:
        return spark.read.schema(MARK).parquet(f"{path}/marks").agg(F.max("upto")).first()[0] or 0
    except AnalysisException:
        return 0


def _deltas(spark: SparkSession, path: str, upto: int) -> DataFrame:
    """Deltas that the snapshot lacks; the condition on their number leaves the others' files unread."""
    try:
        return spark.read.schema(f"{COUNTS}, number LONG").parquet(f"{path}/deltas").where(F.col("number") > upto)
    except AnalysisException:
        return spark.createDataFrame([], f"{COUNTS}, number LONG")


def restored(spark: SparkSession, path: str) -> DataFrame:
    """All counts so far: the snapshot and what came after it, summed."""
    upto = snapshot(spark, path)
    rows = _deltas(spark, path, upto).drop("number")
    if upto:
        rows = rows.unionByName(spark.read.schema(COUNTS).parquet(f"{path}/snapshots/{upto}"))
    return rows.groupBy(*KEYS).agg(F.sum("cnt").alias("cnt"))


def compacted(spark: SparkSession, path: str) -> int:
    """Makes a snapshot of all that is there and drops what it replaces; its number."""
    old = snapshot(spark, path)
    new = _deltas(spark, path, old).agg(F.max("number")).first()[0]
    if new is None:
        return old
    restored(spark, path).write.mode("overwrite").parquet(f"{path}/snapshots/{new}")
    spark.createDataFrame([(new,)], MARK).coalesce(1).write.mode("append").parquet(f"{path}/marks")
    for gone in [f"{path}/snapshots/{old}"] * bool(old) + [f"{path}/deltas/number={n}" for n in range(old + 1, new + 1)]:
        at = spark._jvm.org.apache.hadoop.fs.Path(gone)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return new
