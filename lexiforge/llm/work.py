"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

__all__ = ["dealt", "pick", "removed", "shared_dir", "ship", "tidied", "trim", "written"]


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``; only where no such folder is set and all runs on one machine (tests), one is made locally."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lexiforge-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/lexiforge-{uuid.uuid4().hex}"


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes written tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet at ``path`` and read again: cuts the lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast to the named types; any further or clashing columns of a caller's table stay out."""
    return df.select(*[df[name].cast(kind).alias(name) for name, kind in columns.items()])


def dealt(rows: DataFrame, table: DataFrame, hot: DataFrame, key: str, spread: str, salts: int = 64) -> DataFrame:
    """``rows`` with what ``table`` has for their keys, a row each; rows of ``hot`` keys, of which the caller knows that there are few, are dealt by ``spread`` over ``salts`` tasks."""
    hot = F.broadcast(hot.select(key).withColumn("_hot", F.lit(True)))
    own = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)
    each = F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    salted = rows.join(hot, key, "left").withColumn("_salt", own).drop("_hot")
    return salted.join(table.join(hot, key, "left").withColumn("_salt", each).drop("_hot"), [key, "_salt"]).drop("_salt")


def trim() -> None:
    """Gives free memory of this process back."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after whose last batch the worker gives its free memory back; workers outlive their tasks."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped
