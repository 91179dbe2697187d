"""Passages of a book by breaks between neighbouring verses, and batches of passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import cut
from .running import running_sums
from .scan import marked, placed

SHORTEST, BATCH, REMAINDER, FIXED = 3, 95, 50, 90


def _double(c: Column) -> Column:
    return c.cast("array<double>")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    x, y = _double(a), _double(b)
    return dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def consecutive(rows: DataFrame, book: str, order: str, vector: str) -> DataFrame:
    """book, pos (from 0), order, sim: the cosine of each verse and the next of its book; null at its end."""
    along = placed(rows.select(F.col(book).alias("book"), F.col(order).alias("ord"), F.col(vector).alias("vector")), "book", "ord", ["vector"])
    return along.select("book", "pos", "ord", cosine(F.col("vector"), F.col("next_vector")).alias("sim"))


def thresholds(sims: DataFrame, *by: str) -> DataFrame:
    """major and minor thresholds: mean less two and one population deviations, from 0 and from 0.01 above."""
    r = sims.where("sim IS NOT NULL").groupBy(*by).agg(F.avg("sim").alias("mean"), F.stddev_pop("sim").alias("sd"))
    r = r.withColumn("major", F.greatest(F.lit(0.0), F.col("mean") - 2 * F.col("sd")))
    return r.withColumn("minor", F.greatest(F.col("major") + 0.01, F.col("mean") - F.col("sd")))


def _ordered(sims: DataFrame, limits: DataFrame, by: list[str]) -> DataFrame:
    lists = sims.groupBy("book").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sim"))), lambda x: x.sim).alias("all"))
    lists = lists.withColumn("verses", F.size("all")).withColumn("sims", F.filter("all", lambda x: x.isNotNull())).drop("all")
    return lists.join(limits, by) if by else lists.crossJoin(F.broadcast(limits))  # one row


def breaks(sims: DataFrame, limits: DataFrame, by: list[str] | None = None, shortest: int = SHORTEST) -> DataFrame:
    """book, verses, breaks: positions at which passages start, the first one and the end included.

    A break follows a similarity below ``minor`` if the passage has ``shortest`` verses by then. The fold runs along
    one row; ``break_places`` gives the same for books of any length.
    """
    rows = _ordered(sims, limits, by or [])
    at = F.when(F.size("sims") > 0, F.sequence(F.lit(0), F.size("sims") - 1)).otherwise(F.array().cast("array<int>"))
    step = lambda acc, i: F.when((F.get("sims", i) < F.col("minor")) & (i + 1 - F.element_at(acc, -1) >= shortest), F.concat(acc, F.array(i + 1))).otherwise(acc)
    found = F.aggregate(at, F.array(F.lit(0)), step)
    return rows.select("book", "verses", F.when(F.element_at(found, -1) == F.col("verses"), found).otherwise(F.concat(found, F.array("verses"))).alias("breaks"))


def merged(found: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """Breaks without those that leave a short passage before them, or after them unless it is the last."""
    n = F.size("breaks")
    inner = F.when(n > 2, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    at = lambda i: F.get("breaks", i)
    step = lambda acc, i: F.when((at(i) - F.element_at(acc, -1) < shortest) | ((at(i + 1) - at(i) < shortest) & (i < n - 2)), acc).otherwise(F.concat(acc, F.array(at(i))))
    return found.withColumn("breaks", F.concat(F.aggregate(inner, F.array(F.lit(0)), step), F.array(F.element_at("breaks", -1))))


def pericopes(found: DataFrame) -> DataFrame:
    """book, pericope (from 1), start, end (positions), verses."""
    pairs = F.arrays_zip(F.slice("breaks", F.lit(1), F.size("breaks") - 1).alias("a"), F.slice("breaks", F.lit(2), F.size("breaks") - 1).alias("b"))
    return found.select("book", F.posexplode(pairs).alias("i", "p")).select("book", (F.col("i") + 1).alias("pericope"), F.col("p.a").alias("start"), (F.col("p.b") - 1).alias("end"), (F.col("p.b") - F.col("p.a")).alias("verses"))


def break_places(sims: DataFrame, limits: DataFrame, by: list[str] | None = None, shortest: int = SHORTEST) -> DataFrame:
    """book, place: what ``breaks`` finds, a row each, in books of any length. A null similarity doesn't break."""
    known = sims.join(limits, by) if by else sims.crossJoin(F.broadcast(limits))  # one row
    rows = known.select("book", "pos", F.coalesce(F.col("sim") < F.col("minor"), F.lit(False)).alias("low"))

    def step(length: Column, x: Column) -> tuple[Column, Column]:
        grown = F.least(length + 1, F.lit(shortest))
        mark = x["low"] & (grown >= shortest)
        return F.when(mark, 0).otherwise(grown), mark

    inner = marked(rows, "book", "pos", shortest + 1, step).select("book", (F.col("pos") + 1).alias("place"))
    ends = sims.groupBy("book").agg(F.count("*").cast("int").alias("n")).select("book", F.explode(F.array(F.lit(0), "n")).alias("place"))
    return inner.unionByName(ends).distinct()


def merged_places(places: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """book, place: what ``merged`` keeps, a row each, in books of any length. Places from ``break_places`` are at least ``shortest`` apart but for the last, so all of them stay."""
    along = placed(places.select("book", "place"), "book", "place", ["place"])
    along = along.join(places.groupBy(F.col("book").alias("_book")).agg(F.max("place").alias("top")), F.col("book").eqNullSafe(F.col("_book")))
    after = F.coalesce(F.col("next_place") - F.col("place"), F.lit(0))
    rows = along.select("book", "place", F.least(after, F.lit(shortest)).alias("after"), ((F.col("pos") == 0) | F.col("next_place").isNull()).alias("edge"), (F.col("next_place") == F.col("top")).alias("last"))

    def step(length: Column, x: Column) -> tuple[Column, Column]:
        mark = x["edge"] | ((length >= shortest) & ((x["after"] >= shortest) | x["last"]))
        return F.least(F.when(mark, 0).otherwise(length) + x["after"], F.lit(shortest)), mark

    return marked(rows, "book", "place", shortest + 1, step)


def passages(places: DataFrame) -> DataFrame:
    """book, pericope (from 1), start, end (positions), verses of the passages between neighbouring places."""
    along = placed(places.select("book", "place"), "book", "place", ["place"]).where("next_place IS NOT NULL")
    return along.select("book", (F.col("pos") + 1).alias("pericope"), F.col("place").alias("start"), (F.col("next_place") - 1).alias("end"), (F.col("next_place") - F.col("place")).alias("verses"))


def tag_verses(verses: DataFrame, passages: DataFrame) -> DataFrame:
    """Verses (book, pos) with the passage that holds them; each passage is unfolded to its positions, so the join is one of equality."""
    held = passages.select("book", "pericope", F.explode(F.sequence("start", "end")).alias("pos"))
    return verses.join(held, ["book", "pos"])


def pack(passages: DataFrame, most: int = BATCH, remainder: int = REMAINDER) -> DataFrame:
    """Passages with their batch: a batch ends before one that would exceed ``most`` verses, if at least ``remainder`` follow it.

    The state of the fold is the batch's verses so far, which count no further than one beyond ``most``.
    """
    totals = passages.groupBy(F.col("book").alias("_book")).agg(F.sum("verses").alias("total"))
    along = placed(passages.select("book", "pericope", "verses"), "book", "pericope", sums=["verses"]).join(totals, F.col("book").eqNullSafe(F.col("_book")))
    rows = cut(along.select("book", "pericope", "verses", (F.col("total") - F.col("sum_verses") >= remainder).alias("more")))

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        verses = F.greatest(state - 1, F.lit(0)) + x["verses"]  # state 0: no passage yet
        mark = (state > 0) & x["more"] & (verses > most)
        return F.least(F.when(mark, x["verses"]).otherwise(verses), F.lit(most + 1)) + 1, mark

    flushed = marked(rows, "book", "pericope", most + 3, step).select(F.col("book").alias("_book"), F.col("pericope").alias("_pericope"), F.lit(1).alias("flushed"))
    rows = rows.join(flushed, F.col("book").eqNullSafe(F.col("_book")) & (F.col("pericope") == F.col("_pericope")), "left").select("book", "pericope", "verses", F.coalesce("flushed", F.lit(0)).alias("flushed"))
    return placed(rows, "book", "pericope", sums=["flushed"]).select("book", "pericope", "verses", (F.col("sum_flushed") + 1).cast("int").alias("batch"))


def fixed_batches(rows: DataFrame, book: str, order: str, most: int = FIXED) -> DataFrame:
    """Every ``most`` verses of a book make a batch."""
    along = placed(rows, book, order)
    return along.withColumn("batch", (F.floor(F.col("pos") / most) + 1).cast("int")).drop("pos")


def batch_ordinals(batches: DataFrame) -> DataFrame:
    """Distinct (book, batch) with their ordinal over all books; a row for each batch."""
    rows = batches.select("book", "batch").distinct().withColumn("_place", F.struct("book", "batch")).withColumn("_one", F.lit(1))
    return running_sums(rows, "_place", {"_one": "batch_number"}).select("_place.book", "_place.batch", F.col("batch_number").cast("int").alias("batch_number"))


def pericope_ordinals(packed: DataFrame) -> DataFrame:
    """``packed`` passages (book, pericope, batch) with their number within the batch, from 1."""
    return packed.withColumn("pericope_number", F.row_number().over(Window.partitionBy("book", "batch").orderBy("pericope")))


def of_book(passages: DataFrame, book: Column) -> DataFrame:
    """The passages whose reference begins with the book's, up to the mark after it."""
    return passages.where(F.startswith("pericope_reference", F.concat(book.cast("string"), F.lit("_"))))


def batch_texts(verses: DataFrame, batch: str, order: str, text: str) -> DataFrame:
    """Each batch's texts in order, in one: a batch holds some ninety verses."""
    rows = verses.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("rows"))
    return rows.select(batch, F.array_join(F.transform("rows", lambda x: x[text]), " ").alias("text"))
