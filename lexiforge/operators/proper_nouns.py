"""Proper nouns: equal counts, similarity of sound, and one winner for each target."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import name_score
from ..functions.text import GENERIC_NAMES, expected_length, has_generic_edge, is_proper, starts_with_liaison
from ..shipping import ship
from ..sources.store import cut

LEAST, LEAST_AGAIN, DEFAULT, WEIGHT = 0.56, 0.5, 0.6, 6.0


def source_counts(source: DataFrame, batch: list[str], flag: str | None = None) -> DataFrame:
    """How often each proper candidate (a capital first, or the given flag) occurs in its batch."""
    return source.where(F.col(flag) if flag else is_proper(F.col("term"))).groupBy(*batch, "term").agg(F.count("*").alias("occurrences"))


def equal_counts(names: DataFrame, counts: DataFrame, batch: list[str]) -> DataFrame:
    """Targets that occur with a candidate as often as it occurs: batch, source_term, target_term, cnt."""
    return counts.join(names.withColumnRenamed("term", "source_term"), [*batch, "source_term"]).where("cnt = occurrences").select(*batch, "source_term", "target_term", "cnt")


def equal_counts_in_verses(names: DataFrame, source: DataFrame, targets: DataFrame, keys: list[str], batch: str, chinese: bool) -> DataFrame:
    """``equal_counts`` of the co-occurrences of verses, which are never counted as a whole, within the rules for Chinese names.

    ``source`` has each different term of a verse, ``targets`` (term, times) also ``total``, how often it counts in the
    batch. A name of one verse has the targets that count there as often as the name does, so nothing is summed for it;
    where all claims are alike (targets that aren't Chinese), the first such name of a verse gets all that any would.
    """
    placed = source.join(names, [batch, "term"]).select(*keys, F.col("term").alias("source_term"), "occurrences")
    once = placed.groupBy(batch, "source_term").agg(F.count("*").alias("verses"))
    placed = cut(placed.join(once, [batch, "source_term"]))
    single = placed.where("verses = 1")
    single = single.select(*keys, "source_term", "occurrences") if chinese else single.groupBy(*keys, "occurrences").agg(F.min("source_term").alias("source_term"))
    other = targets.select(*keys, F.col("term").alias("target_term"), "times", "total")
    met = lambda rows: rows.join(other.where(may_name(F.col("target_term"))) if chinese else other, keys).where(expected_length(F.col("source_term"), F.col("target_term")) if chinese else F.lit(True))
    found = met(single).where("times = occurrences").select(batch, "source_term", "target_term", F.col("times").alias("cnt"))
    pairs = met(placed.where("verses > 1")).where("total >= occurrences")
    summed = pairs.groupBy(batch, "source_term", "target_term", "occurrences").agg(F.sum("times").alias("cnt")).where("cnt = occurrences")
    return found.unionByName(summed.select(batch, "source_term", "target_term", "cnt"))


def may_name(target: Column) -> Column:
    """What a Chinese target must be to be a name's, whatever the name."""
    return (F.length(target) >= 2) & ~has_generic_edge(target, GENERIC_NAMES) & ~starts_with_liaison(target)


def scored(pairs: DataFrame, language: str, chinese: bool) -> DataFrame:
    """``similarity`` of candidate pairs (source_term, target_term, sound, target_sound), within the length and edge rules."""
    if not chinese:
        return pairs.withColumn("similarity", F.lit(DEFAULT))
    t = F.col("target_term")
    rows = pairs.where(may_name(t) & expected_length(F.col("source_term"), t))
    bonus = F.when(F.length(t).between(2, 4), 0.2).otherwise(0.0)
    return rows.withColumn("similarity", name_score("sound", "target_sound", F.lit(language)) + bonus)


def resolve(claims: DataFrame, batch: list[str]) -> DataFrame:
    """Each target goes to its most similar claim of at least 0.56; ties to the source that sorts first. A source may win several."""
    order = Window.partitionBy(*batch, "target_term").orderBy(F.desc("similarity"), "source_term")
    return claims.where(F.col("similarity") >= LEAST).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def losers(names: DataFrame, won: DataFrame, batch: list[str]) -> DataFrame:
    return names.join(won.select(*batch, F.col("source_term").alias("term")).distinct(), [*batch, "term"], "left_anti")


def assign_again(rows: list[tuple[str, str, float]]) -> list[tuple[str, str, float]]:
    """Losers in order take their most similar target that is still free, from 0.5 on."""
    by: dict[str, list[tuple[float, str]]] = {}
    for s, t, x in rows:
        by.setdefault(s, []).append((-x, t))
    taken: set[str] = set()
    out = []
    for s in sorted(by):
        for x, t in sorted(by[s]):
            if t not in taken and -x >= LEAST_AGAIN:
                out.append((s, t, -x))
                taken.add(t)
                break
    return out


def reattribute(claims: DataFrame, won: DataFrame, batch: str) -> DataFrame:
    """batch, source_term, target_term, similarity for losers that find another target.

    The choice is ordered, so a batch is one group; only losers' claims on targets that nobody has won go there.
    """
    lost = claims.where(F.col("similarity") >= LEAST_AGAIN).join(won.select(batch, "source_term").distinct(), [batch, "source_term"], "left_anti")
    lost = lost.join(won.select(batch, "target_term"), [batch, "target_term"], "left_anti")
    kind = claims.schema[batch].dataType.simpleString()
    ship(claims.sparkSession)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        got = assign_again(list(zip(pdf["source_term"], pdf["target_term"], pdf["similarity"], strict=True)))
        return pd.DataFrame([(key[0], *x) for x in got], columns=[batch, "source_term", "target_term", "similarity"])

    return lost.select(batch, "source_term", "target_term", "similarity").groupBy(batch).applyInPandas(run, f"{batch} {kind}, source_term string, target_term string, similarity double")


def events(won: DataFrame) -> DataFrame:
    return won.withColumn("score", F.col("similarity") * WEIGHT).withColumn("is_primary", F.lit(True))
