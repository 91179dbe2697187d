"""The learning plan over aligned verses: dictionary, similarity, dominance and proper nouns, as one event table.

A verse's ``book`` is its batch unless ``batch`` names a column that holds one (packed passages, say). Chinese targets,
which have no blanks, are taken as n-grams; source words can be replaced by their lemmas, and those of ancient languages
reach the dictionary by way of a pivot.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_ngrams, chinese_words, is_proper, lowered
from ..operators import cooccurrence, dictionary, dominance, learned, proper_nouns, similarity
from ..operators.tokens import chinese_terms, counted_terms, distinct_terms, lemmas, tokens
from ..sources.dictionaries import hebrew_names, pivot_lookup
from ..sources.store import cut

KEYS = ["book", "verse"]
EVENT = ["seq", "method", "batch_reference", "verse_reference", "source_term", "target_term", "score", "is_primary"]
#: Stages of a batch: those that go verse by verse come first, the dictionary before similarity in each verse.
VERSES, DOMINANCE, NAMES = 0, 1, 2


def sequence(book: Column, stage: int, verse: Column | None = None, part: int = 0, position: Column | None = None, source: Column | None = None, rank: Column | None = None, target: Column | None = None) -> Column:
    """An event's place in the run: book, stage, verse, dictionary or similarity, position, source term, rank, target term; compared in this order."""
    zero, empty = F.lit(0), F.lit("")
    number = lambda c: (zero if c is None else c).cast("long")
    return F.struct(number(book).alias("book"), F.lit(stage).alias("stage"), number(verse).alias("verse"), F.lit(part).alias("part"), number(position).alias("pos"), F.coalesce(empty if source is None else source, empty).alias("source"), number(rank).alias("rank"), F.coalesce(empty if target is None else target, empty).alias("target"))


def _event(rows: DataFrame, method: str, seq: Column, verse: bool) -> DataFrame:
    reference = F.concat_ws("_", "book", "verse") if verse else F.col("book").cast("string")
    return rows.select(seq.alias("seq"), F.lit(method).alias("method"), F.col("book").cast("string").alias("batch_reference"), reference.alias("verse_reference"), "source_term", "target_term", "score", "is_primary")


def dictionary_events(verses: DataFrame, entries: DataFrame) -> DataFrame:
    """Dictionary events of aligned verses; a verse's book is its batch."""
    found = dictionary.matches(tokens(verses, KEYS, "source_text"), distinct_terms(verses, KEYS, "target_text"), entries, KEYS)
    return _dictionary(found)


def _dictionary(found: DataFrame) -> DataFrame:
    return _event(found, "dictionary", sequence(F.col("book"), VERSES, F.col("verse"), 0, F.col("src_pos"), rank=F.col("rank")), True)


def dominance_events(counts: DataFrame, batch: str, chinese: bool = False) -> DataFrame:
    got = dominance.learn(counts, batch, chinese).withColumnRenamed(batch, "book")
    return _dominance(got)


def _dominance(got: DataFrame) -> DataFrame:
    return _event(got, "dominance", sequence(F.col("book"), DOMINANCE, source=F.col("source_term"), rank=F.when(F.col("is_primary"), 1).otherwise(2), target=F.col("target_term")), False)


@dataclass(frozen=True)
class Languages:
    """What a pair of languages needs: ``source`` and ``target`` by name, and the tables that stand for models.

    ``lexicon`` (surface, lemma, upos) and ``stop`` (term) give source lemmas, and Greek and Chinese names by their upos
    PROPN; ``target_lexicon`` gives target lemmas. ``pivot`` (form, english) leads ancient terms to English ones;
    ``vocalised`` (vocalized, pure) has the forms of Hebrew names. ``sounds`` (word, pinyin) spells target terms, ``names``
    (name, sound) source names.
    """

    source: str = "English"
    target: str = "English"
    lexicon: DataFrame | None = field(default=None, compare=False)
    stop: DataFrame | None = field(default=None, compare=False)
    target_lexicon: DataFrame | None = field(default=None, compare=False)
    pivot: DataFrame | None = field(default=None, compare=False)
    sounds: DataFrame | None = field(default=None, compare=False)
    names: DataFrame | None = field(default=None, compare=False)
    vocalised: DataFrame | None = field(default=None, compare=False)

    @property
    def chinese(self) -> bool:
        return self.target == "Chinese"


def source_tokens(verses: DataFrame, languages: Languages) -> DataFrame:
    """Source words of each verse: n-grams of Chinese, else words, as lemmas where a lexicon is given, and Hebrew without marks."""
    if languages.source == "Chinese":
        return verses.select(*KEYS, F.posexplode(chinese_words(F.col("source_text"))).alias("pos", "term"))
    found = tokens(verses, KEYS, "source_text")
    hebrew = languages.source == "Hebrew"
    if languages.lexicon is None and not hebrew:
        return found
    return lemmas(found, languages.lexicon, languages.stop, least=1 if hebrew else 3, hebrew=hebrew).select(*KEYS, "pos", "term")


def target_terms(verses: DataFrame, languages: Languages) -> DataFrame:
    """Different target terms of each verse and how often each counts (``times``): n-grams of Chinese once, else words in lower case, or lemmas, as often as they occur."""
    if languages.chinese:
        return chinese_terms(verses, KEYS, "target_text").withColumn("times", F.lit(1).cast("long"))
    if languages.target_lexicon is None:
        return counted_terms(verses, KEYS, "target_text")
    return lemmas(tokens(verses, KEYS, "target_text"), languages.target_lexicon).groupBy(*KEYS, "term").agg(F.count("*").alias("times"))


def through_pivot(source: DataFrame, entries: DataFrame, pivot: DataFrame | None) -> DataFrame:
    """Dictionary entries as the source's own terms find them: their own and, for ancient languages, those by way of English, their order kept."""
    if pivot is None:
        return entries
    found = pivot_lookup(source.select("term").distinct(), pivot, entries.select("term", "target", "pinyin", "ord"))
    rows = entries.select("term", "target", "pinyin", "ord").unionByName(found.select(lowered("term").alias("term"), "target", "pinyin", "ord"))
    return rows.groupBy("term", "target").agg(F.min_by("pinyin", "ord").alias("pinyin"), F.min("ord").alias("ord"))


def candidates(verses: DataFrame, languages: Languages) -> DataFrame:
    """How often each proper candidate occurs in a book's texts: book, term, occurrences.

    Hebrew names are those whose vocalised forms are given, under their pure forms. Greek ones are words with a capital
    that the lexicon flags, under lemmas of more than three letters, Chinese ones all n-grams that it flags. In other
    languages a capital makes a candidate, and the words themselves are counted.
    """
    if languages.source == "Hebrew" and languages.vocalised is not None:
        return hebrew_names(verses, ["book"], "source_text", languages.vocalised)
    if languages.lexicon is not None and languages.source == "Greek":
        found = lemmas(tokens(verses, KEYS, "source_text"), languages.lexicon)
        found = found.withColumn("named", (F.col("upos") == "PROPN") & is_proper(F.col("surface")) & (F.length("term") > 3))
        return proper_nouns.source_counts(found, ["book"], "named")
    if languages.lexicon is not None and languages.source == "Chinese":
        flagged = languages.lexicon.where("upos = 'PROPN'").select(F.col("surface").alias("term")).distinct()
        grams = verses.select("book", F.explode(char_ngrams(F.col("source_text"))).alias("term")).groupBy("book", "term").agg(F.count("*").alias("occurrences"))
        return grams.join(flagged, "term", "left_semi").select("book", "term", "occurrences")
    return proper_nouns.source_counts(tokens(verses, KEYS, "source_text"), ["book"])


def run(verses: DataFrame, entries: DataFrame, languages: Languages = Languages(), batch: str | None = None) -> DataFrame:  # noqa: B008
    """All events of a corpus of aligned verses. ``entries``: term, target, pinyin, ord.

    Similarity is learned for Chinese targets only, where words are spelled by sound. ``batch`` names a column of numbers
    that stands for the book; verse numbers must then tell all verses of a batch apart.
    """
    if batch:
        verses = verses.withColumn("book", F.col(batch).cast("long"))
    source, targets = cut(source_tokens(verses, languages)), cut(target_terms(verses, languages))
    entries = cut(through_pivot(source, entries, languages.pivot))
    first = cut(dictionary.matches(source, targets, entries, KEYS))
    left_source = cut(dictionary.residual_sources(source, first, KEYS))
    left_target = cut(dictionary.residual_targets(targets, first.where("is_primary"), KEYS))
    found = [_dictionary(first)]
    if languages.chinese:
        sounds = languages.sounds
        spelled = left_target.join(sounds.select(F.col("word").alias("term"), "pinyin"), "term", "left") if sounds is not None else left_target.withColumn("pinyin", F.col("term"))
        second = similarity.matches(left_source, spelled.withColumn("pinyin", F.coalesce("pinyin", "term")), entries, KEYS)
        places = source.groupBy(*KEYS, F.col("term").alias("source_term")).agg(F.min("pos").alias("pos"))
        second = cut(second.join(places, [*KEYS, "source_term"]))
        left_target = cut(dictionary.residual_targets(left_target, second, KEYS, both=True))
        left_source = cut(left_source.join(second.select(*KEYS, F.col("source_term").alias("term")).distinct(), [*KEYS, "term"], "left_anti"))
        place = sequence(F.col("book"), VERSES, F.col("verse"), 1, F.col("pos"), F.col("source_term"), -F.length("target_term"), F.col("target_term"))
        found.append(_event(second.withColumn("score", F.col("similarity")).withColumn("is_primary", F.lit(True)), "similarity", place, True))
    # Pairs of a verse are as many as its words squared, so only those that a claim can depend on are made.
    third = cut(dominance.learn_in_verses(left_source, left_target, KEYS, "book", languages.chinese))
    totals = cut(left_target.groupBy("book", "term").agg(F.sum("times").alias("total")))
    names, named = candidates(verses, languages), left_source
    # Hebrew names come from a dictionary, so those that dominance has learned stay candidates.
    if languages.source != "Hebrew":
        named = named.join(third.select("book", F.col("source_term").alias("term")).distinct(), ["book", "term"], "left_anti")
        totals = totals.join(dictionary.holding(totals.select("book", "term"), third, ["book"]), ["book", "term"], "left_anti")
    claims = proper_nouns.equal_counts_in_verses(names, named, left_target.join(totals, ["book", "term"]), KEYS, "book", languages.chinese)
    claims = _sounded(claims, languages)
    claims = cut(proper_nouns.scored(claims, languages.source, languages.chinese).select("book", "source_term", "target_term", "similarity"))
    won = proper_nouns.resolve(claims, ["book"])
    fourth = proper_nouns.events(won.unionByName(proper_nouns.reattribute(claims, won, "book")))
    found.append(_dominance(third))
    found.append(_event(fourth, "proper_noun", sequence(F.col("book"), NAMES, source=F.col("source_term"), target=F.col("target_term")), False))
    return reduce(DataFrame.unionByName, found)


def _sounded(claims: DataFrame, languages: Languages) -> DataFrame:
    """Claims with the sounds of both sides: from the tables where they have the word, else the word itself."""
    rows = claims.withColumn("sound", lowered("source_term")).withColumn("target_sound", F.col("target_term"))
    if languages.names is not None:
        own = languages.names.select(F.col("name").alias("source_term"), F.col("sound").alias("own"))
        rows = rows.join(own, "source_term", "left").withColumn("sound", F.coalesce("own", "sound")).drop("own")
    if languages.sounds is not None:
        other = languages.sounds.select(F.col("word").alias("target_term"), F.col("pinyin").alias("other"))
        rows = rows.join(other, "target_term", "left").withColumn("target_sound", F.coalesce("other", "target_sound")).drop("other")
    return rows


def unresolved(verses: DataFrame, events: DataFrame, languages: Languages = Languages()) -> DataFrame:  # noqa: B008
    """batch_reference, term of the names that nothing resolved."""
    names = candidates(verses, languages).select(F.col("book").cast("string").alias("batch_reference"), "term")
    return names.join(events.where("method = 'proper_noun'").select("batch_reference", F.col("source_term").alias("term")).distinct(), ["batch_reference", "term"], "left_anti")


def summary(verses: DataFrame, events: DataFrame, known: DataFrame | None = None, languages: Languages = Languages()) -> DataFrame:  # noqa: B008
    """What each batch learned, its unresolved names included; ``known``: terms of a restored dictionary."""
    sizes = verses.groupBy(F.col("book").cast("string").alias("batch_reference")).agg(F.count("*").alias("verse_count"))
    return learned.batch_stats(learned.actions(events, known), sizes, unresolved(verses, events, languages))


__all__ = ["Languages", "cooccurrence", "dictionary_events", "dominance_events", "learned", "run", "summary", "unresolved"]
