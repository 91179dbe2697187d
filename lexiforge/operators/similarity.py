"""Similarity matches between the targets that a verse has left and its sources' dictionary translations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import bits, combined, may_pass, might_pass, numbered, passes, places, sequence_ratio
from ..functions.text import lowered
from ..sources.store import cut, parts
from .dictionary import probes


def matches(source: DataFrame, targets: DataFrame, dictionary: DataFrame, keys: list[str]) -> DataFrame:
    """keys, source_term, target_term, translation, similarity: for each source and target the most similar translation above the threshold.

    ``source`` and ``targets`` are what the dictionary left (term); ``dictionary`` has term, target, pinyin, ord. Pairs
    are made, scored and compared where their verse lies, so only words travel. Of equal scores the entry of the word
    itself comes before that of "to " and the word, then the earlier entry.
    """
    entries = dictionary.select(F.col("term").alias("k"), F.col("target").alias("translation"), F.col("pinyin").alias("sound"), "ord")
    known = probes(source).join(entries, "k").select(*keys, "translation", "sound", F.col("term").alias("source_term"), (F.col("k") == lowered("term")).alias("direct"), (-F.col("ord")).alias("early"))
    pairs = candidates(known, targets.select(*keys, F.col("term").alias("target_term"), F.col("pinyin").alias("target_sound")), keys)
    scored = pairs.withColumn("ratio", sequence_ratio("target_sound", "sound")).withColumn("similarity", combined(F.col("target_term"), F.col("translation"), F.col("ratio"))).where(passes(F.col("target_term"), F.col("similarity")))
    found = scored.select(*keys, F.explode("meant").alias("m"), "target_term", "translation", "similarity")
    best = F.max(F.struct("similarity", "m.direct", "m.early", "translation")).alias("b")
    return found.groupBy(*keys, F.col("m.source_term").alias("source_term"), "target_term").agg(best).select(*keys, "source_term", "target_term", "b.translation", "b.similarity")


def candidates(known: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of a verse's translations (translation, sound) and targets (target_term, target_sound) that can pass, each once.

    Other columns of ``known`` come as an array of all that go with a pair's translation (``meant``). Both sides are dealt
    by verse as they are, in as many tasks as they need. Each pair of a verse is looked at there and dropped by masks
    unless it can pass, so that nothing that grows with the pairs is sorted or written. Nulls meet nothing.
    """
    others = [c for c in known.columns if c not in (*keys, "translation", "sound")]
    left = known.select(*keys, F.col("translation").alias("word"), F.col("sound").alias("spelt"), F.lit(True).alias("own"), F.struct(*others, F.lit(0).alias("of")).alias("meant"))
    kind = left.schema["meant"].dataType
    right = targets.where(F.length("target_term") >= 2).select(*keys, F.col("target_term").alias("word"), F.col("target_sound").alias("spelt"), F.lit(False).alias("own"), F.lit(None).cast(kind).alias("meant"))
    words = cut(left.unionByName(right).dropna(subset=[*keys, "word", "spelt"]))
    each = words.repartition(parts(words), *keys).groupBy(*keys, "own", "word", "spelt").agg(F.collect_set("meant").alias("meant")).withColumn("numbers", numbered(F.col("spelt")))
    pair = F.struct(F.col("word").alias("w"), F.col("spelt").alias("s"), F.col("numbers").alias("n"), F.size("numbers").alias("k"), bits(F.col("numbers")).alias("b"), bits(places(F.col("word"))).alias("p"), "meant")
    side = lambda own: F.collect_list(F.when(F.col("own") == own, F.col("pair")))
    met = each.select(*keys, "own", pair.alias("pair")).groupBy(*keys).agg(side(True).alias("l"), side(False).alias("r")).where((F.size("l") > 0) & (F.size("r") > 0))
    met = met.select(*keys, F.explode("l").alias("l"), "r").select(*keys, "l", F.explode("r").alias("r"))
    # Masks tell most pairs apart before characters are compared.
    met = met.where(might_pass(F.col("r.w"), F.col("l.w"), F.col("r.b"), F.col("l.b"), F.col("r.p"), F.col("l.p"), F.col("r.k"), F.col("l.k")))
    # As a filter the second test would join the first, which would no longer be compiled, so that every pair was copied.
    passed = F.when(may_pass(F.col("r.w"), F.col("l.w"), F.col("r.n"), F.col("l.n")), F.array(F.lit(True)))
    return met.select(*keys, "l", "r", F.explode(passed)).select(*keys, F.col("l.w").alias("translation"), F.col("l.s").alias("sound"), F.col("r.w").alias("target_term"), F.col("r.s").alias("target_sound"), *([F.col("l.meant").alias("meant")] if others else []))
