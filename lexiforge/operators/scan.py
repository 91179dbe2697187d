"""Order along groups of any length: places, neighbours, running sums and folds, none of which needs a task that holds a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import cut

BLOCK = 256
Step = Callable[[Column, Column], tuple[Column, Column]]


def placed(rows: DataFrame, by: str, order: str, following: list[str] | None = None, sums: list[str] | None = None) -> DataFrame:
    """Rows with ``pos`` (from 0) along ``order`` in their group, ``next_<column>`` and ``sum_<column>`` (own row included).

    The rows are dealt into ranges of group and order. A range looks no further than itself; what lies before it and the
    first row after it come from a table of one row for each range and group. A group may be null.
    """
    following, sums = following or [], sums or []
    dealt = cut(rows.repartitionByRange(by, order).withColumn("_range", F.spark_partition_id()))  # written, so that ranges stay as they are
    own = Window.partitionBy("_range", by).orderBy(order)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    inner = dealt.withColumns({"_n": F.row_number().over(own), **{f"_next_{c}": F.lead(c).over(own) for c in following}, **{f"_sum_{c}": F.sum(c).over(upto) for c in sums}})
    edges = dealt.groupBy("_range", by).agg(F.count("*").alias("_rows"), *[F.min_by(c, order).alias(f"_first_{c}") for c in following], *[F.sum(c).alias(f"_all_{c}") for c in sums])
    chain = Window.partitionBy(by).orderBy("_range")
    before = chain.rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    edges = edges.select(F.col("_range").alias("_r"), F.col(by).alias("_by"), "_rows", earlier("_rows").alias("_before"), *[F.lead(f"_first_{c}").over(chain).alias(f"_after_{c}") for c in following], *[earlier(f"_all_{c}").alias(f"_base_{c}") for c in sums])
    met = inner.join(edges, (F.col("_range") == F.col("_r")) & F.col(by).eqNullSafe(F.col("_by")))
    nexts = [F.when(F.col("_n") < F.col("_rows"), F.col(f"_next_{c}")).otherwise(F.col(f"_after_{c}")).alias(f"next_{c}") for c in following]
    totals = [(F.coalesce(f"_sum_{c}", F.lit(0)) + F.col(f"_base_{c}")).alias(f"sum_{c}") for c in sums]
    return met.select(*rows.columns, (F.col("_before") + F.col("_n") - 1).cast("int").alias("pos"), *nexts, *totals)


def _walk(parts: str, entry: Column, step: Callable[[Column, Column], Column], told: Callable[[Column, Column], Column], wanted: Callable[[Column, Column], Column], kind: str) -> Column:
    """What ``told`` says of the wanted parts, along states from ``entry`` on."""
    zero = F.struct(entry.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
    one = lambda acc, x: F.struct(step(acc.state, x).alias("state"), F.when(wanted(acc.state, x), F.concat(acc.out, F.array(told(acc.state, x)))).otherwise(acc.out).alias("out"))
    return F.aggregate(parts, zero, one, lambda acc: acc.out)


def _entries(blocks: DataFrame, states: int) -> DataFrame:
    """_group, _block and _entry, the state that each block is entered with; blocks are composed in blocks of their own, as deep as it takes."""
    groups = blocks.groupBy("_group", F.floor(F.col("_block") / BLOCK).alias("_above")).agg(F.array_sort(F.collect_list(F.struct("_block", "_ends"))).alias("_parts"))
    groups = cut(groups)
    through = lambda s, x: F.get(x["_ends"], s)
    if groups.where("_above > 0").isEmpty():
        groups = groups.withColumn("_entry", F.lit(0))
    else:
        ends = F.transform(F.sequence(F.lit(0), F.lit(states - 1)), lambda s: F.aggregate("_parts", s, through))
        above = _entries(groups.select("_group", F.col("_above").alias("_block"), ends.alias("_ends")), states)
        groups = groups.join(above.withColumnRenamed("_block", "_above"), ["_group", "_above"])
    told = lambda s, x: F.struct(x["_block"].alias("_block"), s.alias("_entry"))
    walk = _walk("_parts", F.col("_entry"), through, told, lambda s, x: F.lit(True), "struct<_block: bigint, _entry: int>")
    return groups.select("_group", F.explode(walk).alias("x")).select("_group", "x._block", "x._entry")


def marked(rows: DataFrame, by: str, place: str, states: int, step: Step) -> DataFrame:
    """``by`` and ``place`` of the rows that a fold along ``place`` marks.

    ``step`` takes the state (0 at first, below ``states``) and a row's other columns and gives the next state and whether
    the row is marked. Rows fall into blocks of ``BLOCK`` places (whole numbers from 0 on, one row each, gaps allowed). A
    block that others follow is read from every state at once, which makes it a function of the state it is entered with;
    composed functions tell each block its own state, and a second reading finds the marks. A group may be null.
    """
    block = F.floor(F.col(place) / BLOCK)
    rows = rows.withColumn("_group", F.struct(by))  # equal also where it holds null
    item = F.struct(place, *[c for c in rows.columns if c not in (by, place, "_group")])
    blocks = rows.groupBy("_group", block.alias("_block")).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    blocks = blocks.join(rows.groupBy("_group").agg(F.max(block).alias("_last")), "_group")
    go = lambda s, x: step(s, x)[0]
    ends = F.transform(F.sequence(F.lit(0), F.lit(states - 1)), lambda s: F.aggregate("_items", s, go))
    blocks = cut(blocks.withColumn("_ends", F.when(F.col("_block") < F.col("_last"), ends)))
    entered = blocks.where("_last = 0").withColumn("_entry", F.lit(0)).select("_group", "_block", "_items", "_entry")
    long = blocks.where("_last > 0")
    if not long.isEmpty():
        entered = entered.unionByName(long.join(_entries(long.select("_group", "_block", "_ends"), states), ["_group", "_block"]).select(entered.columns))
    kind = rows.schema[place].dataType.simpleString()
    marks = _walk("_items", F.col("_entry"), go, lambda s, x: x[place], lambda s, x: step(s, x)[1], kind)
    return entered.select(f"_group.{by}", F.explode(marks).alias(place))
