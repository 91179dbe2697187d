"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Documents are shuffled by the hash of their key and served in packets of at most ``QUANTUM`` words, once for each time a
document may be taken. A packet's virtual finish time is the number of words of its source up to and with it, over all
passes, divided by the source's weight. All packets are ordered by finish time and taken until their words add up to the
budget; the last one is cut there. A source that has served its documents as often as they may be repeated has no
further packets, so what it leaves goes to the others by weight.

The order is a range sort in steps: words are summed over ranges of finish times, prefix sums over the ranges tell the
one that holds the cut, which is split again, and only the packets of its smallest range are sorted. Prefix sums within
a source are taken in two steps as well, over fine ranges of the hash and within each, so no task holds a whole source.
The texts are read once; everything else works on a written table of sizes.

Defined cases: a null or blank text has size 0 and is taken with 0 words; a null source is a source of its own, after all
others; rows that share a key are documents of their own, in the order of their sizes and texts' hashes; an empty table
gives no rows; further columns are ignored by ``mix`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import shared_dir, written

WORD = "[^\\x20\\x09-\\x0D]+"
#: Hexadecimal digits of the hash that name a range; each source has at most 16 to this power of them.
RANGE_DIGITS = 3
#: Words of a packet; ranges of finish times that are told apart in one step.
QUANTUM, RANGES = 128, 4096


def _rank(source: Column) -> Column:
    """A non-null text that sorts sources by code point with null last and keeps null apart from any name."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def targets(sizes: DataFrame, weights: Sequence[float], budget: float, repeats: float) -> DataFrame:
    """For each source of ``sizes`` (s, source_size): weight, target and the virtual time of the cut.

    The windows run over one row for each source.
    """
    ordered = Window.orderBy("s")
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(repeats))).withColumn("full_at", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy(F.lit(0))
    before = Window.partitionBy(F.lit(0)).orderBy("full_at", "s").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(budget)))
    w = w.withColumn("time", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # Sources before the first that ends below its cap run full; at later ones the quotient only falls.
    w = w.withColumn("cut", F.max(F.when(F.col("time") <= F.col("full_at"), F.col("time"))).over(everything))
    return w.select("s", "source_size", "weight", F.when(F.col("cut").isNull() | (F.col("cut") >= F.col("full_at")), F.col("cap")).otherwise(F.col("cut") * F.col("weight")).alias("target"))


@dataclass(frozen=True)
class Cut:
    """Where the budget ends: the finish time and source of the last packet, and how many of its words are too many."""

    time: float
    source: str
    over: int


def _sized(docs: DataFrame, key: str, text: str, source: str, *keep: Column) -> DataFrame:
    words = F.coalesce(F.regexp_count(docs[text].cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(docs[key].cast("long").alias("doc_id"), _rank(docs[source].cast("string")).alias("s"), words.alias("size"), F.xxhash64(docs[text].cast("string")).alias("text_hash"), *keep)
    return rows.withColumn("shuffled", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("part", F.substring("shuffled", 1, RANGE_DIGITS))


def _placed(rows: DataFrame, parts: DataFrame, goals: DataFrame) -> DataFrame:
    """``rows`` with the words of their source before them (start) and what ``goals`` has for it."""
    before = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0))).join(goals, "s").drop("words")
    within = Window.partitionBy("s", "part").orderBy("shuffled", "size", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(bases, ["s", "part"]).withColumn("start", F.col("base") + F.sum("size").over(within) - F.col("size")).drop("part", "base", "shuffled", "text_hash")


def _packets(placed: DataFrame, repeats: int) -> DataFrame:
    """s, finish, words of every packet of every pass."""
    passes = placed.where("size > 0").select("s", "weight", "size", "source_size", "start", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("k"))
    passes = passes.select("s", "weight", "size", (F.col("start") + F.col("k") * F.col("source_size")).alias("start"), F.explode(F.sequence(F.lit(1), F.ceil(F.col("size") / QUANTUM).cast("int"))).alias("j"))
    return passes.select("s", _finish(F.col("j")).alias("finish"), F.least(F.lit(QUANTUM), F.col("size") - (F.col("j") - 1) * QUANTUM).alias("words"))


def _finish(j: Column) -> Column:
    """When the j-th packet of a pass that begins at ``start`` is served."""
    return (F.col("start") + F.least(j.cast("long") * QUANTUM, F.col("size"))) / F.col("weight")


def _cut(packets: DataFrame, budget: int, longest: float) -> Cut | None:
    """The packet at which the words, in the order of finish times, reach the budget; None if they don't. ``longest``: the last finish time."""
    low, high, before = 0.0, longest, 0
    for _ in range(2):
        own = packets.where(F.col("finish").between(low, high))
        at = F.least(F.lit(RANGES - 1), F.floor((F.col("finish") - low) / (high - low) * RANGES)).cast("int")
        sums = own.groupBy(at.alias("r")).agg(F.sum("words").alias("words"), F.min("finish").alias("first"), F.max("finish").alias("last"))
        upto = sums.withColumn("upto", F.sum("words").over(Window.partitionBy(F.lit(0)).orderBy("r")))  # a row a range
        row = upto.where(F.col("upto") + before >= budget).orderBy("r").first()
        if row is None:
            return None
        before += row["upto"] - row["words"]
        low, high = row["first"], row["last"]
        if low == high:
            break
    own = packets.where(F.col("finish").between(low, high))
    ordered = own.withColumn("upto", F.sum("words").over(Window.partitionBy(F.lit(0)).orderBy("finish", "s").rowsBetween(Window.unboundedPreceding, 0)))
    row = ordered.where(F.col("upto") + before >= budget).orderBy("finish", "s").first()
    return Cut(row["finish"], row["s"], int(row["upto"] + before - budget))


def _taken(cut: Cut | None, repeats: int) -> Column:
    """Words that the mix takes of a document: those of its packets up to the cut."""
    if cut is None:
        return F.col("size") * repeats
    total = F.lit(0).cast("long")
    for k in range(repeats):
        start = F.col("start") + F.col("source_size") * k
        first, last = start / F.col("weight"), (start + F.col("size")) / F.col("weight")
        served = lambda t: (t < cut.time) | ((t == cut.time) & (F.col("s") <= cut.source))
        each = F.sequence(F.lit(1), F.ceil(F.col("size") / QUANTUM).cast("int"))
        some = F.size(F.filter(each, lambda j: served((start + F.least(j.cast("long") * QUANTUM, F.col("size"))) / F.col("weight")))) * QUANTUM  # noqa: B023
        words = F.when((F.col("size") == 0) | (first >= cut.time), F.lit(0).cast("long")).when(served(last), F.col("size")).otherwise(some.cast("long"))
        total = total + words - F.when((F.col("s") == cut.source) & (F.col("size") > 0) & (first < cut.time) & (last >= cut.time), F.lit(cut.over)).otherwise(0)
    return total.cast("long")


def _planned(docs: DataFrame, weights: Sequence[float], budget: float, repeats: int, key: str, text: str, source: str) -> tuple[DataFrame, DataFrame, DataFrame, Cut | None]:
    """Placed rows, the words of each range of a source, the sources' goals, and the cut."""
    out = shared_dir(docs.sparkSession)
    rows = written(_sized(docs, key, text, source), f"{out}/sizes")
    parts = written(rows.groupBy("s", "part").agg(F.sum("size").alias("words")), f"{out}/parts")
    goals = written(targets(parts.groupBy("s").agg(F.sum("words").alias("source_size")), weights, budget, repeats), f"{out}/goals")
    placed = written(_placed(rows, parts, goals), f"{out}/placed")
    whole = goals.agg(F.floor(F.sum("source_size") * F.lit(float(budget))).alias("budget"), F.max(F.col("source_size") * repeats / F.col("weight")).alias("longest")).first()
    cut = _cut(_packets(placed, repeats), int(whole["budget"]), float(whole["longest"])) if whole["longest"] else None
    return placed, parts, goals, cut


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, repeats: int = 2, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """A row for each document, in the order of the mix: doc_id, size, source_size, target, taken, finish.

    ``budget`` is the mix's share of all words, ``repeats`` how often a document may be taken, ``finish`` the virtual
    finish time of the first pass over it. ``target`` is what the source's weight and cap give it in the end, which the
    words taken meet but for the packets in service at the cut.
    """
    placed, _, _, cut = _planned(docs, weights, budget, repeats, key, text, source)
    placed = placed.select("doc_id", "size", "source_size", "target", _taken(cut, repeats).alias("taken"), ((F.col("start") + F.col("size")) / F.col("weight")).alias("finish"))
    return placed.orderBy("finish", "doc_id")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, repeats: int = 2) -> DataFrame:
    """``docs`` as the mix takes them: a row for each pass that takes at least half of a document, with all its columns.

    Documents without words are in no source's target and are left out. The decision is made on each row as it lies, so
    rows that share a key each have their own.
    """
    _, parts, goals, cut = _planned(docs, weights, budget, repeats, "doc_id", "text", "source")
    rows = _sized(docs, "doc_id", "text", "source", *[docs[c].alias(f"_{i}") for i, c in enumerate(docs.columns)])
    placed = _placed(rows.where("size > 0"), parts, goals)
    times = F.round(_taken(cut, repeats) / F.col("size")).cast("int")
    taken = placed.withColumn("times", times).where("times > 0").withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return taken.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])
