"""Terms of verses: tokens, lemmas by a lexicon, distinct terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chinese_words, lowered, unmarked, words

CONTENT = ("NOUN", "VERB", "ADJ", "ADV", "PROPN")


def tokens(rows: DataFrame, keys: list[str], text: str, lower: bool = False) -> DataFrame:
    """keys, pos (from 0) and term of each word."""
    found = words(F.col(text))
    return rows.select(*keys, F.posexplode(F.transform(found, lowered) if lower else found).alias("pos", "term"))


def distinct_terms(rows: DataFrame, keys: list[str], text: str, lower: bool = True) -> DataFrame:
    """keys and each different term once; no shuffle."""
    found = words(F.col(text))
    return rows.select(*keys, F.explode(F.array_distinct(F.transform(found, lowered) if lower else found)).alias("term"))


def counted_terms(rows: DataFrame, keys: list[str], text: str, lower: bool = True) -> DataFrame:
    """keys, each different term and how often it occurs there (``times``)."""
    return tokens(rows, keys, text, lower).groupBy(*keys, "term").agg(F.count("*").alias("times"))


def chinese_terms(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    return rows.select(*keys, F.explode(chinese_words(F.col(text))).alias("term"))


def lemmas(found: DataFrame, lexicon: DataFrame | None, stop: DataFrame | None = None, least: int = 3, hebrew: bool = False) -> DataFrame:
    """Tokens replaced by their lemma: content words only, names in their case, others in lower case.

    ``lexicon`` has surface, lemma, upos; words that it lacks stay as they are, in lower case, from ``least`` letters on.
    Hebrew ones lose their marks, so all their spellings with vowels are one term. The word itself stays as ``surface``.
    """
    letters = F.col("term").rlike(r"[֐-׿]" if hebrew else r"^\p{L}+$")
    rows = found.where(letters).withColumn("surface", F.col("term"))
    if lexicon is None:
        rows = rows.withColumn("lemma", F.lit(None).cast("string")).withColumn("upos", F.lit(None).cast("string"))
    else:
        rows = rows.join(lexicon, "surface", "left")
    case = F.when(F.col("upos") == "PROPN", F.col("lemma")).otherwise(F.col("lemma") if hebrew else lowered("lemma"))
    rows = rows.where(F.col("upos").isin(*CONTENT) | (F.col("lemma").isNull() & (F.length("term") >= least)))
    rows = rows.withColumn("term", F.coalesce(case, unmarked(F.col("term")) if hebrew else lowered("term")))
    if stop is not None:
        rows = rows.join(stop, "term", "left_anti")
    return rows.drop("lemma")


def term_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """How often each word occurs in a whole table."""
    return texts.select(F.explode(words(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("occurrences"))


def exploded_counts(texts: DataFrame, items: Column) -> DataFrame:
    return texts.select(F.explode(items).alias("term")).groupBy("term").agg(F.count("*").alias("occurrences"))
