"""Lemmas of words that a lexicon lacks: suffix rules induced from the words that it has, applied by the longest suffix.

A rule says how many letters a surface loses at its end, what it gets instead, and its part of speech. Each suffix of a
known surface, from its changed end to ``MORE`` letters before that, votes for its rule, and a suffix keeps the rule with
most votes. The table of suffixes is a trie read from the end: a word unfolds to its suffixes, meets the table by
equality, and the deepest node that it reaches decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters before the changed end that a rule may look at; longest changed end; votes that a rule needs.
MORE, LONGEST, VOTES = 4, 8, 2


def _shared(a: Column, b: Column) -> Column:
    """How many letters two words have alike at their beginning."""
    most = F.least(F.length(a), F.length(b))
    alike = F.filter(F.sequence(F.lit(0), most), lambda k: F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k))
    return F.array_max(alike)


def induced(lexicon: DataFrame) -> DataFrame:
    """suffix, lost, got, upos, votes: the rule of each suffix, from a lexicon's surface, lemma, upos. Ties go to the fewest letters lost, then code points."""
    shared = _shared(F.col("surface"), F.col("lemma"))
    rows = lexicon.select("surface", "lemma", "upos").distinct().where("surface <> '' AND lemma <> ''").withColumn("shared", shared)
    rows = rows.select("surface", "upos", (F.length("surface") - F.col("shared")).alias("lost"), F.expr("substring(lemma, shared + 1)").alias("got")).where(F.col("lost") <= LONGEST)
    sizes = F.sequence(F.col("lost"), F.least(F.length("surface"), F.col("lost") + MORE))
    votes = rows.select("lost", "got", "upos", F.explode(F.transform(sizes, lambda k: F.when(k > 0, F.substring("surface", F.length("surface") - k + 1, k)).otherwise(""))).alias("suffix"))
    counted = votes.groupBy("suffix", "lost", "got", "upos").agg(F.count("*").alias("votes")).where(F.col("votes") >= VOTES)
    best = counted.groupBy("suffix").agg(F.min(F.struct((-F.col("votes")).alias("less"), "lost", "got", "upos")).alias("r"))
    return best.select("suffix", "r.lost", "r.got", "r.upos", (-F.col("r.less")).alias("votes"))


def guessed(words: DataFrame, rules: DataFrame) -> DataFrame:
    """surface, lemma, upos of different words (``surface``) by the rule of their longest known suffix; words that no rule fits drop out."""
    w = F.col("surface")
    sizes = F.sequence(F.lit(0), F.least(F.length(w), F.lit(LONGEST + MORE)))
    unfolded = words.select("surface").distinct().select("surface", F.explode(F.transform(sizes, lambda k: F.when(k > 0, F.substring(w, F.length(w) - k + 1, k)).otherwise(""))).alias("suffix"))
    # A lemma keeps a letter at least.
    met = unfolded.join(rules, "suffix").where((F.col("lost") < F.length("surface")) | (F.col("got") != ""))
    best = met.groupBy("surface").agg(F.max_by(F.struct("lost", "got", "upos"), F.length("suffix")).alias("r"))
    return best.select("surface", F.concat(F.substring("surface", F.lit(1), F.length("surface") - F.col("r.lost")), F.col("r.got")).alias("lemma"), F.col("r.upos").alias("upos"))


def extended(lexicon: DataFrame, words: DataFrame) -> DataFrame:
    """The lexicon with rows for those words (``surface``) that it lacks: what either side of a run may use."""
    own = lexicon.select("surface", "lemma", "upos")
    return own.unionByName(guessed(words.join(own, "surface", "left_anti"), induced(own)))
