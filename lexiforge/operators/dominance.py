"""Targets that dominate a source term's co-occurrences in a batch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import GENERIC_DOMINANCE, has_generic_edge
from ..shipping import ship
from ..sources.store import cut

LEAST, MOST_TIES, PRIMARY, ALTERNATIVE = 4, 9, 5.0, 4.0
#: Pairs that a task counts, about.
PAIRS = 1 << 20


def candidates(counts: DataFrame, batch: list[str], chinese: bool = False) -> DataFrame:
    """batch, source_term, target_term, cnt, ties, rank: the targets at a source's highest count, the longest first.

    A source needs two targets, a count of at least 4, and at most 9 targets that share it.
    """
    own = Window.partitionBy(*batch, "source_term")
    rows = counts.withColumn("most", F.max("cnt").over(own)).withColumn("targets", F.count("*").over(own)).where("targets >= 2 AND most >= 4 AND cnt = most")
    rows = rows.withColumn("ties", F.count("*").over(own)).where(F.col("ties") <= MOST_TIES)
    if chinese:
        rows = rows.where(~has_generic_edge(F.col("target_term"), GENERIC_DOMINANCE))
    return rows.withColumn("rank", F.row_number().over(own.orderBy(F.length("target_term").desc(), "target_term"))).select(*batch, "source_term", "target_term", "cnt", "ties", "rank")


def claim(rows: list[tuple[str, str, int]], generic: frozenset[str] = frozenset()) -> list[tuple[str, str, int, bool]]:
    """Sources in order take their dominant targets; what one has taken is gone for the next. (source, target, count, is_primary)."""
    by: dict[str, dict[str, int]] = {}
    for s, t, c in rows:
        by.setdefault(s, {})[t] = c
    taken: set[str] = set()
    out = []
    for s in sorted(by):
        free = {t: c for t, c in by[s].items() if t not in taken}
        most = max(free.values(), default=0)
        top = [t for t, c in free.items() if c == most]
        if len(free) < 2 or most < LEAST or len(top) > MOST_TIES:
            continue
        top = sorted((t for t in top if t and t[0] not in generic and t[-1] not in generic), key=lambda t: (-len(t), t))
        out += [(s, t, most, i == 0) for i, t in enumerate(top)]
        taken.update(top)
    return out


def deciding(counts: DataFrame, batch: str) -> DataFrame:
    """Those pairs of a batch that claiming depends on.

    Pairs of at least ``LEAST`` can be dominant. Others only tell whether a source has a second free target: one whose
    target nobody can claim is enough for that, and where there is none, those whose targets others may claim are needed.
    """
    rows, source, target = counts.select(batch, "source_term", "target_term", "cnt"), [batch, "source_term"], [batch, "target_term"]
    strong = rows.where(F.col("cnt") >= LEAST)
    weak = rows.where(F.col("cnt") < LEAST).join(strong.select(*source).distinct(), source, "left_semi")
    weak = weak.join(strong.select(*target).distinct().withColumn("contested", F.lit(True)), target, "left")
    safe = weak.where("contested IS NULL").groupBy(*source).agg(F.min(F.struct("target_term", "cnt")).alias("x")).select(*source, "x.target_term", "x.cnt")
    contested = weak.where("contested").join(safe, source, "left_anti").select(rows.columns)
    return strong.unionByName(safe).unionByName(contested)


def strong_counts(source: DataFrame, targets: DataFrame, keys: list[str], batch: str) -> DataFrame:
    """batch, source_term, target_term, cnt of the pairs that occur ``LEAST`` times or more.

    ``source`` has each different term of a verse, ``targets`` also how often it counts (``times``). A pair occurs at most
    as often as its target does in the batch, and as the source's verses' most frequent targets do together, so terms that
    can't reach ``LEAST`` leave before pairs are made.
    """
    most = targets.groupBy(*keys).agg(F.max("times").alias("most"))
    lead = source.join(most, keys).groupBy(batch, "term").agg(F.sum("most").alias("most")).where(F.col("most") >= LEAST).select(batch, "term")
    led = targets.groupBy(batch, "term").agg(F.sum("times").alias("all")).where(F.col("all") >= LEAST).select(batch, "term")
    own = source.join(lead, [batch, "term"], "left_semi").select(*keys, "term", F.lit(None).cast("long").alias("times"))
    other = targets.join(led, [batch, "term"], "left_semi").select(*keys, "term", "times")
    return _counted(own.unionByName(other), keys, batch).where(F.col("cnt") >= LEAST)


def _counted(terms: DataFrame, keys: list[str], batch: str) -> DataFrame:
    """batch, source_term, target_term, cnt of verses' sources (``times`` null) and targets.

    Terms are dealt, not the pairs that they make: by batch, of which one with more than ``PAIRS`` pairs is dealt in
    several parts, each with some of its source terms and all its targets.
    """
    terms = cut(terms)
    sizes = terms.groupBy(*keys).agg((F.count_if(F.col("times").isNull()) * F.count("times")).alias("pairs")).groupBy(batch).agg(F.sum("pairs").alias("pairs")).where("pairs > 0")
    sizes = cut(sizes.select(batch, F.greatest(F.lit(1), F.ceil(F.col("pairs") / PAIRS)).cast("int").alias("parts"), "pairs"))
    tasks = max(terms.sparkSession.sparkContext.defaultParallelism, -(-(sizes.agg(F.sum("pairs")).first()[0] or 0) // PAIRS))
    rows = terms.join(sizes.select(batch, "parts"), batch)
    own = rows.where("times IS NULL").withColumn("part", F.pmod(F.hash("term"), F.col("parts")))
    other = rows.where("times IS NOT NULL").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = own.unionByName(other).repartition(tasks, batch, "part")
    met = dealt.groupBy(batch, "part", *[k for k in keys if k != batch]).agg(F.collect_list(F.when(F.col("times").isNull(), F.col("term"))).alias("own"), F.collect_list(F.when(F.col("times").isNotNull(), F.struct("term", "times"))).alias("other"))
    pairs = met.select(batch, "part", F.explode("own").alias("source_term"), "other").select(batch, "part", "source_term", F.explode("other").alias("x"))
    return pairs.groupBy(batch, "part", "source_term", F.col("x.term").alias("target_term")).agg(F.sum("x.times").alias("cnt")).select(batch, "source_term", "target_term", "cnt")


def deciding_in_verses(source: DataFrame, targets: DataFrame, keys: list[str], batch: str) -> DataFrame:
    """``deciding`` of the co-occurrences of verses, which are never counted as a whole.

    Weak pairs only tell that there is a free target, so one uncontested target a verse stands for all, and their counts,
    which decide nothing, are given as 1.
    """
    own, other = source.select(*keys, F.col("term").alias("source_term")), targets.select(*keys, F.col("term").alias("target_term"))
    strong = cut(strong_counts(source, targets, keys, batch))
    places = own.join(strong.select(batch, "source_term").distinct(), [batch, "source_term"], "left_semi")
    spare = other.join(strong.select(batch, "target_term").distinct(), [batch, "target_term"], "left_anti").groupBy(*keys).agg(F.min("target_term").alias("target_term"))
    safe = cut(places.join(spare, keys).groupBy(batch, "source_term").agg(F.min("target_term").alias("target_term")))
    bare = places.join(safe.select(batch, "source_term"), [batch, "source_term"], "left_anti")
    contested = bare.join(other, keys).select(batch, "source_term", "target_term").distinct().join(strong, [batch, "source_term", "target_term"], "left_anti")
    return strong.unionByName(safe.unionByName(contested).withColumn("cnt", F.lit(1).cast("long")))


def learn(counts: DataFrame, batch: str, chinese: bool = False) -> DataFrame:
    """Events of a batch's dominance learning: batch, source_term, target_term, cnt, is_primary, score."""
    return claimed(deciding(counts, batch), batch, chinese)


def learn_in_verses(source: DataFrame, targets: DataFrame, keys: list[str], batch: str, chinese: bool = False) -> DataFrame:
    """``learn`` of the co-occurrences of verses: ``source`` (term) and ``targets`` (term, times) by ``keys``."""
    return claimed(deciding_in_verses(source, targets, keys, batch), batch, chinese)


def claimed(pairs: DataFrame, batch: str, chinese: bool = False) -> DataFrame:
    """What the sources of each batch claim of the deciding pairs.

    Claiming is ordered, so each batch, of bounded size by its making, is one group; only pairs that can decide a claim
    go there.
    """
    generic = frozenset(GENERIC_DOMINANCE) if chinese else frozenset()
    kind = pairs.schema[batch].dataType.simpleString()
    ship(pairs.sparkSession)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        got = claim(list(zip(pdf["source_term"], pdf["target_term"], pdf["cnt"], strict=True)), generic)
        return pd.DataFrame([(key[0], s, t, c, p, PRIMARY if p else ALTERNATIVE) for s, t, c, p in got], columns=[batch, "source_term", "target_term", "cnt", "is_primary", "score"])

    return pairs.groupBy(batch).applyInPandas(run, f"{batch} {kind}, source_term string, target_term string, cnt long, is_primary boolean, score double")
