"""The learned dictionary as an aggregate of match events, and reports on learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.store import cut, parts
from .running import running_sums

METHODS = ("dictionary", "similarity", "dominance", "proper_noun")


def learned(events: DataFrame) -> DataFrame:
    """source_term, target_term, confidence_score, is_primary, first_learned, last_updated, target_ord.

    A pair once primary stays so; references are those of the term's first and last event; targets count in the order
    in which they were first seen.
    """
    first, last = F.min(F.struct("seq", "verse_reference")), F.max(F.struct("seq", "verse_reference"))
    pairs = events.groupBy("source_term", "target_term").agg(F.round(F.sum("score"), 6).alias("confidence_score"), F.bool_or("is_primary").alias("is_primary"), first.alias("first"), last.alias("last"))
    # The events are read once; a term's ends are those of its pairs, of which there is one a target.
    own = Window.partitionBy("source_term")
    ends = [F.min("first").over(own)["verse_reference"].alias("first_learned"), F.max("last").over(own)["verse_reference"].alias("last_updated")]
    return pairs.select("source_term", "target_term", "confidence_score", "is_primary", *ends, F.row_number().over(own.orderBy("first.seq", "target_term")).alias("target_ord"))


def best_targets(dictionary: DataFrame) -> DataFrame:
    """The target of highest confidence of each source term."""
    return dictionary.groupBy("source_term").agg(F.max_by("target_term", F.struct("confidence_score", "target_term")).alias("best_target"))


def firsts(events: DataFrame) -> DataFrame:
    """source_term, first_seq: the place of each term's first event.

    Places are structs, which are compared by sorting; books are numbers, which aren't sorted. So only the events of a
    term's first book are.
    """
    rows = events.select("source_term", "seq")
    if isinstance(events.schema["seq"].dataType, StructType):
        books = cut(rows.groupBy("source_term").agg(F.min("seq.book").alias("first_book")))
        rows = rows.join(books, "source_term").where(F.col("seq.book") == F.col("first_book"))
    return rows.groupBy("source_term").agg(F.min("seq").alias("first_seq"))


def actions(events: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """seq, batch_reference, method, source_term, action of each primary event: the first ever of a term learns it, later ones update it.

    ``known`` holds source terms of a restored dictionary, which are only updated.
    """
    first = cut(firsts(events))  # a row a term, so small where events are many
    if known is not None:
        first = first.join(known.select("source_term").distinct().withColumn("old", F.lit(True)), "source_term", "left")
    else:
        first = first.withColumn("old", F.lit(None).cast("boolean"))
    rows = events.where("is_primary")
    rows = rows.select("seq", "batch_reference", "method", "source_term").repartition(parts(rows), "seq").distinct().join(first, "source_term")
    return rows.select("seq", "batch_reference", "method", "source_term", F.when((F.col("seq") == F.col("first_seq")) & F.col("old").isNull(), "learned").otherwise("updated").alias("action"))


def action_counts(acted: DataFrame) -> DataFrame:
    return acted.groupBy("batch_reference", "method", "action").agg(F.count("*").alias("n"))


def examples(events: DataFrame, most: int = 20) -> DataFrame:
    """The first ``most`` pairs of each batch and method, as ``source → target`` in one text."""
    order = Window.partitionBy("batch_reference", "method").orderBy("seq", "source_term", "target_term")
    rows = events.where("is_primary").withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    return rows.groupBy("batch_reference", "method").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat_ws(" → ", "source_term", "target_term").alias("x")))), lambda s: s.x), "; ").alias("examples"))


def batch_stats(acted: DataFrame, verses: DataFrame, unresolved: DataFrame | None = None) -> DataFrame:
    """What each batch learned by each method, in total and for each verse; ``verses`` has batch_reference, verse_count."""
    per = acted.where("action = 'learned'").groupBy("batch_reference").agg(*[F.count_if(F.col("method") == m).alias(f"{m}_learned") for m in METHODS])
    rows = verses.join(per, "batch_reference", "left")
    rows = rows.join(unresolved.groupBy("batch_reference").agg(F.count("*").alias("unresolved")), "batch_reference", "left") if unresolved is not None else rows.withColumn("unresolved", F.lit(0).cast("long"))
    rows = rows.select("batch_reference", "verse_count", *[F.coalesce(f"{m}_learned", F.lit(0)).alias(f"{m}_learned") for m in METHODS], F.coalesce("unresolved", F.lit(0)).alias("proper_noun_unresolved"))
    total = sum((F.col(f"{m}_learned") for m in METHODS), F.lit(0))
    rows = rows.withColumn("total_learned", total.cast("long"))
    return rows.withColumn("avg_learned_per_verse", F.when(F.col("verse_count") > 0, F.round(F.col("total_learned") / F.col("verse_count"), 6)).otherwise(0.0))


def global_totals(stats: DataFrame) -> DataFrame:
    """Sums over batches; the mean for a verse is that of the sums."""
    sums = [F.sum(c).cast("long").alias(c) for c in ("verse_count", *(f"{m}_learned" for m in METHODS), "proper_noun_unresolved", "total_learned")]
    return stats.agg(F.count("*").alias("batches"), *sums).withColumn("avg_learned_per_verse", F.round(F.col("total_learned") / F.greatest(F.lit(1), F.col("verse_count")), 6))


def method_rollup(acted: DataFrame) -> DataFrame:
    """Actions by method and action, with subtotals."""
    return acted.rollup("method", "action").agg(F.count("*").alias("n")).select(F.coalesce("method", F.lit("all")).alias("method"), F.coalesce("action", F.lit("all")).alias("action"), "n")


def method_shares(acted: DataFrame) -> DataFrame:
    """Each method's percentage of all terms learned."""
    n = acted.where("action = 'learned'").groupBy("method").agg(F.count("*").alias("n"))
    return n.select("method", "n", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6).alias("percent"))


def learning_curve(stats: DataFrame, order: str = "batch_order", width: int = 120) -> DataFrame:
    """Running totals by method over batches, and bars of at most ``width``."""
    cols = [f"{m}_learned" for m in METHODS] + ["total_learned"]
    rows = running_sums(stats.select(order, *cols), order, {c: f"cumulative_{c}" for c in cols})
    top = stats.agg(F.sum("total_learned").alias("top"))
    bar = F.when(F.col("top") > 0, F.floor(F.col("cumulative_total_learned") * width / F.col("top"))).otherwise(0).cast("long")
    return rows.crossJoin(F.broadcast(top)).withColumn("bar", bar).drop("top")  # one row


def metric_pivot(stats: DataFrame, batch: str, values: list, metrics: list[str], mean: bool = False) -> DataFrame:
    """A row for each metric, a column for each batch, and their total or mean."""
    long = stats.select(batch, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select(batch, "x.metric", "x.value")
    wide = long.groupBy("metric").pivot(batch, values).agg(F.round(F.sum("value"), 6))
    total = (F.avg if mean else F.sum)("value")
    return wide.join(long.groupBy("metric").agg(F.round(total, 6).alias("mean" if mean else "total")), "metric")


def learning_gain(acted: DataFrame) -> DataFrame:
    """All terms learned in relation to those that the dictionary alone gives."""
    r = acted.where("action = 'learned'").agg(F.count("*").alias("total"), F.count_if(F.col("method") == "dictionary").alias("dictionary"))
    return r.withColumn("gain", F.when(F.col("dictionary") > 0, F.round(F.col("total") / F.col("dictionary"), 6)))
