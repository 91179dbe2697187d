"""Running totals over a whole table, without one task that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import cut


def running_sums(rows: DataFrame, order: str, sums: dict[str, str]) -> DataFrame:
    """``order`` and the sums of columns up to each row, under new names.

    The rows are dealt into ranges of ``order``; sums within a range begin at the sum of the ranges before, of which
    there is one row each.
    """
    dealt = cut(rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))  # written, so that ranges stay as they are
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_range").agg(*[F.sum(c).alias(c) for c in sums])
    bases = totals.select("_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in sums])
    within = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(F.broadcast(bases), "_range").select(order, *[(F.sum(c).over(within) + F.col(f"_{c}")).cast("long").alias(name) for c, name in sums.items()])  # a row a range
