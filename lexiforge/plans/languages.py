"""Queries on languages, dictionaries, files and saved state over the tables of a folder, and their SQL.

The tables hold invented words in Latin letters. Chinese, Hebrew and Greek texts are made of them letter by letter, by fixed
alphabets that hold the characters which the rules are about.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.text import GENERIC_DOMINANCE, GENERIC_NAMES, chinese_punctuation, clean_target, expected_length, has_generic_edge, lowered, reference, simplified, starts_with_liaison, words
from ..functions.similarity import shared_pieces
from ..operators import cooccurrence, dictionary, dominance, evaluate, lattice, learned, lemma_rules, segment
from ..operators.tokens import chinese_terms, lemmas, tokens
from ..sources import corpus, counts, dictionaries, store
from . import learning
from .catalogue import _bleu_sql, _part, CLAIMED, PART, DAILY, ROUGE, TOKS, ENTRIES, _daily, KEYS, MATCHED, MATCHES, PERICOPES, SIMS, LIMITS, BREAKS, PACKED, PIECES, SHARED_PIECES, SOURCE, TARGETS, VERSES, WORDS, ACTED, PAIRS, _dictionary, _passages, _read, _run_verses, _verses, query, run_sql

LETTERS = "abcdefghijklmnopqrstuvwxyz"
HAN = "神天地光水人山大小中国王子的了是在就也都又與從於為由"
HEBREW = "אבגדהוזחטיכלמנסעפצקרשתךםןף"
GREEK = "αβγδεζηθικλμνξοπρστυφχψως΄῾"
TRADITIONAL, SIMPLE = "與從於為國", "与从于为国"


def _spelt(c: Column, alphabet: str) -> Column:
    return F.translate(lowered(c), LETTERS, alphabet)


def _spelt_sql(c: str, alphabet: str) -> str:
    return f"translate(lower({c}), '{LETTERS}', '{alphabet}')"


# Chinese terms

GRAMS = f"""han AS (SELECT item_id, replace({_spelt_sql('text', HAN)}, ' ', '') AS t FROM benchmark),
grams AS (SELECT item_id, t[i:i + k - 1] AS term FROM han, range(1, 5) r(k), LATERAL (SELECT unnest(range(1, length(t) - k + 2)) AS i)),
terms AS (SELECT DISTINCT item_id, term FROM grams WHERE NOT regexp_matches(term, '^\\p{{Nd}}+$') AND NOT regexp_matches(term, '[，。：；！？「」（）、"…—·]') AND NOT regexp_matches(term, '^[是就的了又]|[是就的了又]$') AND NOT regexp_matches(term, '[的了是在就也都]'))"""


def _han(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "benchmark").select("item_id", clean_target(_spelt(F.col("text"), HAN), "Chinese").alias("t"))


@query(f"WITH {GRAMS} SELECT item_id, term FROM terms")
def chinese_words_of_texts(spark: SparkSession, sf: str) -> DataFrame:
    return chinese_terms(_han(spark, sf), ["item_id"], "t")


def _edge_sql(chars: str) -> str:
    return f"(contains('{chars}', term[1:1]) OR contains('{chars}', term[-1:]))"


@query(f"""WITH {GRAMS}, words AS (SELECT DISTINCT p_type AS w FROM part), u AS (SELECT DISTINCT term FROM terms)
SELECT w AS source_term, count(*) AS targets, count(*) FILTER ({_edge_sql(GENERIC_DOMINANCE)}) AS generic, count(*) FILTER ({_edge_sql(GENERIC_NAMES)}) AS generic_for_names,
  count(*) FILTER (length(term) >= 2 AND contains('子的他憑信為與從在和之了生於而', term[1:1])) AS liaison,
  count(*) FILTER (length(term) BETWEEN CASE WHEN length(w) <= 5 THEN 2 ELSE 3 END AND CASE WHEN length(w) <= 5 THEN 3 WHEN length(w) <= 7 THEN 4 ELSE 5 END) AS of_expected_length
FROM words, u GROUP BY w""")
def target_rules(spark: SparkSession, sf: str) -> DataFrame:
    """How many of all Chinese terms each rule for targets touches, for every kind of part as a source word."""
    t, w = F.col("term"), F.col("source_term")
    terms = chinese_words_of_texts(spark, sf).select("term").distinct().groupBy("term").agg(F.lit(1).alias("n"))
    kinds = _read(spark, sf, "part").select(F.col("p_type").alias("source_term")).distinct()
    lengths = kinds.select("source_term", F.length("source_term").alias("length")).groupBy("length").agg(F.collect_list("source_term").alias("sources"))
    # Only a source's length matters, of which there are few.
    rules = lengths.join(terms.select(F.explode(F.sequence(F.lit(1), F.lit(20))).alias("length"), t), "length")
    one = rules.select("sources", t, F.element_at("sources", 1).alias("source_term"))
    counted = one.groupBy("sources").agg(F.count("*").alias("targets"), F.count_if(has_generic_edge(t, GENERIC_DOMINANCE)).alias("generic"), F.count_if(has_generic_edge(t, GENERIC_NAMES)).alias("generic_for_names"), F.count_if(starts_with_liaison(t)).alias("liaison"), F.count_if(expected_length(w, t)).alias("of_expected_length"))
    return counted.select(F.explode("sources").alias("source_term"), "targets", "generic", "generic_for_names", "liaison", "of_expected_length")


@query(f"SELECT item_id, translate(replace(trim({_spelt_sql('text', HAN)}), ' ', ''), '{TRADITIONAL}', '{SIMPLE}') AS chinese, trim(text) AS spaced, replace(trim(text), ' ', '') AS compatible FROM benchmark")
def simplified_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Target texts as they are cleaned: without blanks where the script has none, in simplified characters."""
    table = dict(zip(TRADITIONAL, SIMPLE, strict=True))
    text = F.col("text")
    return _read(spark, sf, "benchmark").select("item_id", simplified(clean_target(_spelt(text, HAN), "Chinese"), table).alias("chinese"), clean_target(text, "English").alias("spaced"), clean_target(text, "English", compatible=True).alias("compatible"))


CHINESE = f"""{VERSES}, {SOURCE},
cv AS (SELECT book, verse, replace({_spelt_sql('target_text', HAN)}, ' ', '') AS t FROM verses),
targets AS (SELECT DISTINCT book, verse, term FROM (SELECT book, verse, t[i:i + k - 1] AS term FROM cv, range(1, 5) r(k), LATERAL (SELECT unnest(range(1, length(t) - k + 2)) AS i))
  WHERE NOT regexp_matches(term, '^\\p{{Nd}}+$') AND NOT regexp_matches(term, '[，。：；！？「」（）、"…—·]') AND NOT regexp_matches(term, '^[是就的了又]|[是就的了又]$') AND NOT regexp_matches(term, '[的了是在就也都]')),
{ENTRIES.replace('entries AS', 'english AS')},
entries AS (SELECT term, {_spelt_sql('target', HAN)} AS target, min(ord) AS ord FROM english GROUP BY ALL), {MATCHES}"""


def _chinese_verses(spark: SparkSession, sf: str) -> DataFrame:
    return _verses(spark, sf).withColumn("target_text", clean_target(_spelt(F.col("target_text"), HAN), "Chinese"))


def _chinese_entries(spark: SparkSession, sf: str) -> DataFrame:
    return _dictionary(spark, sf).groupBy("term", _spelt(F.col("target"), HAN).alias("target")).agg(F.min("ord").alias("ord")).withColumn("pinyin", F.col("target"))


@query(f"WITH {CHINESE} SELECT book, verse, CAST(src_pos AS INTEGER) AS src_pos, source_term, target_term, rank, rank = 1 AS is_primary, CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END AS score FROM matches")
def chinese_dictionary_match(spark: SparkSession, sf: str) -> DataFrame:
    """Dictionary matches where the target is unsegmented: its n-grams are the terms."""
    v = _chinese_verses(spark, sf)
    return dictionary.matches(tokens(v, KEYS, "source_text"), chinese_terms(v, KEYS, "target_text"), _chinese_entries(spark, sf), KEYS)


@query()
def chinese_learning_run(spark: SparkSession, sf: str) -> DataFrame:
    """All stages over Chinese targets, similarity of sound included, with spellings from a table."""
    v, entries = _chinese_verses(spark, sf), _chinese_entries(spark, sf)
    sounds = entries.groupBy(F.col("target").alias("word")).agg(F.min(F.translate("target", HAN, LETTERS)).alias("pinyin"))
    return learned.learned(store.cut(learning.run(v, entries, learning.Languages(target="Chinese", sounds=sounds))))


# Lemmas

LEXICON = f"""surfaces AS (SELECT DISTINCT unnest({WORDS.format('text')}) AS surface FROM benchmark),
lexicon AS (SELECT surface, CASE WHEN length(surface) > 4 THEN surface[1:length(surface) - 1] ELSE surface END AS lemma, ['NOUN', 'VERB', 'ADJ', 'ADV', 'PROPN', 'ADP'][length(surface) % 6 + 1] AS upos FROM surfaces)"""


def _lexicon(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("surface")
    rows = _read(spark, sf, "benchmark").select(F.explode(words(F.col("text"))).alias("surface")).distinct()
    kinds = F.array(*[F.lit(x) for x in ("NOUN", "VERB", "ADJ", "ADV", "PROPN", "ADP")])
    return rows.select("surface", F.when(F.length(s) > 4, F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(s).alias("lemma"), F.get(kinds, F.length(s) % 6).alias("upos"))


@query(f"""WITH {VERSES}, {SOURCE}, {LEXICON}
SELECT book, verse, CAST(pos AS INTEGER) AS pos, CASE WHEN lemma IS NULL THEN lower(term) WHEN upos = 'PROPN' THEN lemma ELSE lower(lemma) END AS term
FROM source LEFT JOIN lexicon ON surface = term WHERE regexp_matches(term, '^\\p{{L}}+$') AND (upos IN ('NOUN', 'VERB', 'ADJ', 'ADV', 'PROPN') OR (lemma IS NULL AND length(term) >= 3))""")
def lemma_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Source words as lemmas of a lexicon; words that it lacks stay, from three letters on."""
    return lemmas(tokens(_verses(spark, sf), KEYS, "source_text"), _lexicon(spark, sf)).select(*KEYS, "pos", "term")


#: A lexicon with endings: of the benchmark's words, every other one, so that the rest are words that it lacks.
ENDINGS = [("ing", "", "VERB"), ("ed", "", "VERB"), ("tion", "te", "NOUN"), ("eaux", "eau", "NOUN"), ("mente", "", "ADV"), ("es", "e", "NOUN")]


def _inflected(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("surface")
    rows = _read(spark, sf, "benchmark").select(F.explode(words(lowered("text"))).alias("surface")).distinct().where(F.length(s) > 5)
    lemma, upos = s, F.lit("NOUN")
    for end, instead, kind in reversed(ENDINGS):
        lemma = F.when(F.endswith(s, F.lit(end)), F.concat(F.substring(s, F.lit(1), F.length(s) - len(end)), F.lit(instead))).otherwise(lemma)
        upos = F.when(F.endswith(s, F.lit(end)), kind).otherwise(upos)
    return rows.select("surface", lemma.alias("lemma"), upos.alias("upos"))


INFLECTED = f"""inflected AS (SELECT DISTINCT w AS surface, CASE {' '.join(f"WHEN suffix(w, '{e}') THEN w[1:length(w) - {len(e)}] || '{i}'" for e, i, _ in ENDINGS)} ELSE w END AS lemma, CASE {' '.join(f"WHEN suffix(w, '{e}') THEN '{k}'" for e, _, k in ENDINGS)} ELSE 'NOUN' END AS upos FROM (SELECT unnest({WORDS.format('lower(text)')}) AS w FROM benchmark) WHERE length(w) > 5)"""
RULES = """changed AS (SELECT surface, upos, length(surface) - shared AS lost, lemma[shared + 1:] AS got FROM (SELECT *, list_max(list_filter(range(0, least(length(surface), length(lemma)) + 1), lambda k: surface[1:k] = lemma[1:k])) AS shared FROM inflected)),
voted AS (SELECT CASE WHEN k > 0 THEN surface[length(surface) - k + 1:] ELSE '' END AS suffix, lost, got, upos, count(*) AS votes FROM (SELECT *, unnest(range(lost, least(length(surface), lost + 4) + 1)) AS k FROM changed WHERE lost <= 8) GROUP BY ALL HAVING count(*) >= 2),
rules AS (SELECT suffix, lost, got, upos FROM voted QUALIFY row_number() OVER (PARTITION BY suffix ORDER BY votes DESC, lost, got, upos) = 1),
lacking AS (SELECT DISTINCT w AS surface FROM (SELECT unnest({0}) AS w FROM conversations) WHERE w NOT IN (SELECT surface FROM inflected)),
guessed AS (
  SELECT l.surface, l.surface[1:length(l.surface) - lost] || got AS lemma, upos FROM lacking l JOIN rules r ON suffix(l.surface, r.suffix) AND (lost < length(l.surface) OR got <> '')
  QUALIFY row_number() OVER (PARTITION BY l.surface ORDER BY length(r.suffix) DESC) = 1)"""


@query(f"WITH {INFLECTED}, {RULES.replace('{0}', WORDS.format('lower(text)'))} SELECT surface, lemma, upos FROM guessed")
def guessed_lemmas(spark: SparkSession, sf: str) -> DataFrame:
    """Lemmas of all words of the conversations that a lexicon lacks, by the suffix rules of those that it has."""
    lexicon = _inflected(spark, sf)
    listed = _read(spark, sf, "conversations").select(F.explode(words(lowered("text"))).alias("surface")).distinct()
    return lemma_rules.guessed(listed.join(lexicon, "surface", "left_anti"), lemma_rules.induced(lexicon))


# Pivots and names

FORMS = f"""bwords AS (SELECT DISTINCT unnest({WORDS.format('lower(text)')}) AS w FROM benchmark),
forms AS (SELECT {_spelt_sql('w', GREEK)} AS form, w AS english FROM bwords)"""


def _pivot_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A pivot dictionary of the benchmark's words: Greek letters for each, and for names two Hebrew spellings."""
    w = F.col("w")
    rows = _read(spark, sf, "benchmark").select(F.explode(words(lowered("text"))).alias("w")).distinct()
    pure = F.array(_spelt(w, HEBREW), _spelt(F.substring(w, 1, 3), HEBREW))
    return rows.select(_spelt(w, GREEK).alias("greek"), F.lit(None).cast("string").alias("latin"), F.array(_spelt(w, HEBREW)).alias("hebrew"), pure.alias("hebrew_pure"), F.array(w).alias("english"), F.reverse(w).alias("transliteration"), F.array(F.reverse(w), w).alias("translitterations"), (F.length(w) % 2 == 0).alias("proper_name"))


#: Some entries as those of verbs, "to" and the word; and of some words an entry under their Greek letters.
VERBS = f"""{ENTRIES}, listed AS (SELECT CASE WHEN length(term) % 3 = 0 THEN 'to ' || term ELSE term END AS term, target FROM entries UNION ALL SELECT {_spelt_sql('term', GREEK)}, target FROM entries WHERE length(term) % 4 = 0)"""
#: A source term finds an entry of its own or of its English ones, each as it is or behind "to".
PIVOTED = """probe AS (SELECT DISTINCT term, unnest([lower(term), 'to ' || lower(term)]) AS k FROM source UNION SELECT term, unnest([lower(english), 'to ' || lower(english)]) FROM (SELECT DISTINCT term FROM source) JOIN forms ON form = term),
found AS (
  SELECT DISTINCT s.book, s.verse, s.pos AS src_pos, s.term AS source_term, e.target AS target_term
  FROM source s JOIN probe p ON p.term = s.term JOIN listed e ON e.term = p.k JOIN targets t ON t.book = s.book AND t.verse = s.verse AND t.term = e.target),
matches AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY book, verse, src_pos ORDER BY length(target_term) DESC, target_term) AS INTEGER) AS rank FROM found)"""


def _verbs(spark: SparkSession, sf: str) -> DataFrame:
    entries, t = _dictionary(spark, sf).withColumn("pinyin", F.col("target")), F.col("term")
    return entries.withColumn("term", F.when(F.length(t) % 3 == 0, F.concat(F.lit("to "), t)).otherwise(t)).unionByName(entries.where(F.length(t) % 4 == 0).withColumn("term", _spelt(t, GREEK)))


@query(f"""WITH {VERSES}, {SOURCE.replace('source AS', 'latin AS')}, source AS (SELECT book, verse, pos, {_spelt_sql('term', GREEK)} AS term FROM latin), {TARGETS}, {VERBS}, {FORMS}, {PIVOTED}
SELECT book, verse, CAST(src_pos AS INTEGER) AS src_pos, source_term, target_term, rank, rank = 1 AS is_primary FROM matches""")
def pivot_match(spark: SparkSession, sf: str) -> DataFrame:
    """Matches of an ancient language's terms: by their own entries and by way of English, as words and as verbs."""
    v = _verses(spark, sf)
    source = tokens(v, KEYS, "source_text").withColumn("term", _spelt(F.col("term"), GREEK))
    entries = learning.through_pivot(source, _verbs(spark, sf), dictionaries.pivot_forms(_pivot_rows(spark, sf), "Greek"))
    found = dictionary.matches(source, learning.target_terms(v, learning.Languages()), entries, KEYS)
    return found.drop("score")


@query(f"WITH {FORMS}, h AS (SELECT {_spelt_sql('w', HEBREW)} AS name, reverse(w) AS t FROM bwords UNION ALL SELECT {_spelt_sql('w[1:3]', HEBREW)}, reverse(w) FROM bwords), best AS (SELECT name, arg_max(t, (length(t), t)) AS sound FROM h GROUP BY name), n AS (SELECT DISTINCT {_spelt_sql('p_name', HEBREW)} AS name FROM part UNION SELECT {_spelt_sql('w', HEBREW)} FROM bwords) SELECT n.name, coalesce(sound, n.name) AS sound FROM n LEFT JOIN best ON best.name = n.name")
def transliterated_names(spark: SparkSession, sf: str) -> DataFrame:
    """Hebrew names with the longest of their entries' first transliterations; others keep their spelling."""
    pivot = _pivot_rows(spark, sf)
    names = _read(spark, sf, "part").select(_spelt(F.col("p_name"), HEBREW).alias("name")).union(pivot.select(F.element_at("hebrew", 1))).distinct()
    return dictionaries.transliterations(pivot, "Hebrew", names)


@query(f"WITH {FORMS}, n AS (SELECT form AS name, reverse(english) AS sound FROM forms), p AS (SELECT DISTINCT {_spelt_sql('p_type', GREEK)} AS name, p_type FROM part) SELECT p.name, coalesce(n.sound, lower(p_type)) AS sound FROM p LEFT JOIN n ON n.name = p.name UNION SELECT name, sound FROM n")
def greek_names(spark: SparkSession, sf: str) -> DataFrame:
    """Greek names with their transliteration, else that of another table."""
    pivot, other = _pivot_rows(spark, sf), _read(spark, sf, "part").select(_spelt(F.col("p_type"), GREEK).alias("name"), lowered("p_type").alias("sound")).distinct()
    names = pivot.select(F.col("greek").alias("name")).union(other.select("name")).distinct()
    return dictionaries.transliterations(pivot, "Greek", names, other)


@query(f"WITH {FORMS}, named AS (SELECT {_spelt_sql('w', HEBREW)} AS v, arg_min(p, (length(p), p)) AS pure FROM (SELECT w, {_spelt_sql('w', HEBREW)} AS p FROM bwords WHERE length(w) % 2 = 0 UNION ALL SELECT w, {_spelt_sql('w[1:3]', HEBREW)} FROM bwords WHERE length(w) % 2 = 0) GROUP BY w), found AS (SELECT unnest(regexp_extract_all({_spelt_sql('text', HEBREW)}, '[֐-׿]+')) AS v FROM benchmark) SELECT pure, count(*) AS occurrences FROM found JOIN named USING (v) GROUP BY pure")
def hebrew_name_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How often proper names occur in Hebrew texts, under their shortest spelling."""
    texts = _read(spark, sf, "benchmark").select(_spelt(F.col("text"), HEBREW).alias("text"))
    return dictionaries.hebrew_name_counts(texts, _pivot_rows(spark, sf))


@query(f"WITH {ENTRIES}, known AS (SELECT target, min_by(term, (ord, term)) AS pinyin FROM entries GROUP BY target), w AS (SELECT DISTINCT unnest({WORDS.format('lower(text)')}) AS word FROM benchmark UNION SELECT DISTINCT lower(p_type) FROM part), spelled AS (SELECT word, string_agg(c || CAST(1 + ascii(c) % 4 AS VARCHAR), ' ' ORDER BY i) AS s FROM (SELECT word, unnest(string_split(word, '')) AS c, generate_subscripts(string_split(word, ''), 1) AS i FROM w) GROUP BY word) SELECT w.word, coalesce(pinyin, upper(s[1:1]) || s[2:]) AS pinyin FROM w LEFT JOIN known ON target = w.word JOIN spelled ON spelled.word = w.word")
def pinyin_of_words(spark: SparkSession, sf: str) -> DataFrame:
    """A word's sound: that of the first entry that has it, else its characters' syllables."""
    entries = _dictionary(spark, sf).withColumn("pinyin", F.col("term"))
    listed = _read(spark, sf, "benchmark").select(F.explode(words(lowered("text"))).alias("word")).union(_read(spark, sf, "part").select(lowered("p_type"))).distinct()
    characters = listed.select(F.explode(F.split("word", "")).alias("character")).where("character <> ''").distinct()
    return dictionaries.pinyin(listed, entries, characters.withColumn("syllable", F.concat("character", (1 + F.ascii("character") % 4).cast("string"))))


@query(f"WITH {ENTRIES}, spelt AS (SELECT term, target, term AS a, target AS b FROM entries) SELECT term AS a, target AS b, len({PIECES.format('a')}) AS pieces, round({SHARED_PIECES}, 6)::DOUBLE AS shared FROM spelt")
def shared_piece_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """The share of two- and three-letter pieces that an entry's words have in common."""
    from ..functions.similarity import pieces

    rows = _dictionary(spark, sf).select(F.col("term").alias("a"), F.col("target").alias("b"))
    return rows.select("a", "b", F.size(pieces(F.col("a"))).cast("long").alias("pieces"), F.round(shared_pieces(F.col("a"), F.col("b")), 6).alias("shared"))


# Words of Chinese texts

HAN_WORDS = f"""han_words AS (SELECT {_spelt_sql('w', HAN)} AS word, count(*) AS n FROM (SELECT unnest({WORDS.format('lower(text)')}) AS w FROM benchmark) WHERE length(w) <= 8 GROUP BY word)"""
#: Runs and marks of texts (key, side, text), the edges of each different run by their ends, the least costs up to each character, and the way back.
LATTICE = """parts AS (SELECT key, side, i, p[i] AS run FROM (SELECT key, side, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT key, side, regexp_extract_all(text, '[一-鿿]+|[A-Za-z0-9À-ɏ]+|[^\\s]') AS p FROM texts))),
costs AS (SELECT word, CAST(round(1000 * ln(sum(n) OVER () / n)) AS BIGINT) AS cost, CAST(round(1000 * ln(sum(n) OVER ())) AS BIGINT) AS unknown FROM han_words WHERE length(word) <= 8),
chains AS (SELECT DISTINCT run FROM parts WHERE regexp_matches(run, '^[一-鿿]{2,}$')),
spans AS (SELECT run, e, k, run[e - k + 1:e] AS word FROM (SELECT run, e, unnest(range(1, least(8, e) + 1)) AS k FROM (SELECT run, unnest(range(1, length(run) + 1)) AS e FROM chains))),
priced AS (SELECT run, e, list({'k': k, 'cost': coalesce(cost, (SELECT max(unknown) FROM costs))}) AS edges FROM spans LEFT JOIN costs USING (word) WHERE cost IS NOT NULL OR k = 1 GROUP BY run, e),
lattices AS (SELECT run, list(edges ORDER BY e) AS edges FROM priced GROUP BY run),
paths AS (
  SELECT run, edges, 0::BIGINT AS i, [0::BIGINT] AS best, []::BIGINT[] AS back FROM lattices
  UNION ALL
  SELECT run, edges, i, list_append(best, top.cost), list_append(back, -top.k)
  FROM (SELECT run, edges, i + 1 AS i, best, back, list_min(list_transform(edges[i + 1], lambda x: {'cost': CAST(best[i + 2 - x.k] + x.cost AS BIGINT), 'k': CAST(-x.k AS BIGINT)})) AS top FROM paths WHERE i < length(run))),
ways AS (
  SELECT run, back, CAST(length(run) AS BIGINT) AS i, []::VARCHAR[] AS tokens FROM paths WHERE i = length(run)
  UNION ALL
  SELECT run, back, i - back[i], list_prepend(run[i - back[i] + 1:i], tokens) FROM ways WHERE i > 0),
cuts AS (SELECT run, tokens FROM ways WHERE i = 0),
segments AS (SELECT key, side, flatten(list(coalesce(tokens, [run]) ORDER BY i)) AS tokens FROM parts LEFT JOIN cuts USING (run) GROUP BY key, side)"""


def _han_words(spark: SparkSession, sf: str) -> DataFrame:
    """A dictionary of the benchmark's words, as spelt in Han characters, with their counts."""
    listed = _read(spark, sf, "benchmark").select(F.explode(words(lowered("text"))).alias("w")).where(F.length("w") <= 8)
    return listed.groupBy(_spelt(F.col("w"), HAN).alias("word")).agg(F.count("*").alias("n"))


def _marked_han(c: Column) -> Column:
    return F.trim(chinese_punctuation(_spelt(c, HAN)))


def _marked_han_sql(c: str) -> str:
    return f"trim(translate({_spelt_sql(c, HAN)}, ',.?!:; ', '，。？！：；'))"


@query(f"WITH RECURSIVE {HAN_WORDS}, texts AS (SELECT item_id AS key, 't' AS side, {_marked_han_sql('text')} AS text FROM benchmark), {LATTICE} SELECT key AS item_id, i AS place, tokens[i] AS token FROM (SELECT key, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM segments)")
def chinese_segments(spark: SparkSession, sf: str) -> DataFrame:
    """The words of Chinese texts, by the likeliest path through a lattice."""
    rows = _read(spark, sf, "benchmark").select("item_id", _marked_han(F.col("text")).alias("t"))
    found = lattice.segmented(rows, ["item_id"], ["t"], _han_words(spark, sf))
    return found.select("item_id", F.posexplode("t").alias("place", "token")).select("item_id", (F.col("place") + 1).cast("long").alias("place"), "token")


HAN_TOKS = f"""{VERSES}, {HAN_WORDS}, texts AS (SELECT {{'book': book, 'verse': verse}} AS key, 'h' AS side, {_marked_han_sql('target_text')} AS text FROM verses UNION ALL SELECT {{'book': book, 'verse': verse}}, 'r', {_marked_han_sql('source_text')} FROM verses), {LATTICE},
toks AS (SELECT book, verse, coalesce(h.tokens, []) AS hy, coalesce(r.tokens, []) AS re FROM verses v LEFT JOIN segments h ON h.side = 'h' AND h.key.book = book AND h.key.verse = verse LEFT JOIN segments r ON r.side = 'r' AND r.key.book = book AND r.key.verse = verse)"""


def _han_scored(spark: SparkSession, sf: str) -> DataFrame:
    v = _verses(spark, sf).select(*KEYS, _marked_han(F.col("target_text")).alias("h"), _marked_han(F.col("source_text")).alias("r"))
    return lattice.segmented(v, KEYS, ["h", "r"], _han_words(spark, sf))


@query(_bleu_sql("SELECT book, verse, round(bleu, 6) AS bleu FROM bleus").replace(f"{VERSES}, {TOKS}", HAN_TOKS))
def chinese_bleu(spark: SparkSession, sf: str) -> DataFrame:
    """BLEU of Chinese texts over the words that the lattice gives."""
    return metrics.bleu(_han_scored(spark, sf), KEYS, "h", "r").withColumn("bleu", F.round("bleu", 6))


@query(f"WITH RECURSIVE {HAN_TOKS}, {ROUGE} SELECT book, verse, round(rouge_l, 6) AS rouge_l FROM rouges")
def chinese_rouge(spark: SparkSession, sf: str) -> DataFrame:
    """ROUGE-L of Chinese texts over such words."""
    return _han_scored(spark, sf).select(*KEYS, F.round(metrics.rouge_l("h", "r"), 6).alias("rouge_l"))


# Whole runs from ancient languages

MARKS = "[\u0591-\u05BD\u05BF\u05C1\u05C2\u05C4\u05C5\u05C7]"
UPPER, GREEK_UPPER = LETTERS.upper(), "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ΄῾"


def _vocal(c: Column) -> Column:
    """Hebrew letters, each vowel's with a mark."""
    return F.translate(F.regexp_replace(lowered(c), "([aeiou])", "$1\u05b8"), LETTERS, HEBREW)


def _vocal_sql(c: str) -> str:
    return f"translate(regexp_replace(lower({c}), '([aeiou])', '\\1\u05b8', 'g'), '{LETTERS}', '{HEBREW}')"


def _hebrew_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """A pivot dictionary whose entries have a vocalised form and two pure ones, the longer first."""
    w = F.col("w")
    rows = _read(spark, sf, "benchmark").select(F.explode(words(lowered("text"))).alias("w")).distinct()
    pure = _spelt(w, HEBREW)
    return rows.select(F.array(_vocal(w)).alias("hebrew"), F.array(F.concat(pure, F.lit("ה")), pure).alias("hebrew_pure"), F.array(w).alias("english"), (F.length(w) % 2 == 0).alias("proper_name"))


def _greek(c: Column) -> Column:
    return F.translate(c, LETTERS + UPPER, GREEK + GREEK_UPPER)


def _greek_sql(c: str) -> str:
    return f"translate({c}, '{LETTERS + UPPER}', '{GREEK + GREEK_UPPER}')"


BWORDS = f"bwords AS (SELECT DISTINCT unnest({WORDS.format('lower(text)')}) AS w FROM benchmark)"
HEBREW_RUN = run_sql(
    sources=f"""sw AS (SELECT book, verse, {WORDS.format(_vocal_sql('source_text'))} AS w FROM verses),
marked AS (SELECT book, verse, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM sw),
source AS (SELECT book, verse, pos, regexp_replace(term, '{MARKS}', '', 'g') AS term FROM marked WHERE regexp_matches(term, '[֐-׿]'))""",
    entries=f"""{VERBS}, {BWORDS}, forms AS (SELECT {_spelt_sql('w', HEBREW)} AS form, w AS english FROM bwords UNION ALL SELECT {_spelt_sql('w', HEBREW)} || 'ה', w FROM bwords), {PIVOTED}""",
    names=f"""named AS (SELECT {_vocal_sql('w')} AS v, arg_min(p, (length(p), p)) AS pure FROM (SELECT w, {_spelt_sql('w', HEBREW)} AS p FROM bwords WHERE length(w) % 2 = 0) GROUP BY v),
names AS (SELECT book AS batch, pure AS source_term, count(*) AS n FROM (SELECT book, unnest(regexp_extract_all({_vocal_sql('source_text')}, '[֐-׿]+')) AS v FROM verses) JOIN named USING (v) GROUP BY ALL)""",
    pool="counts",
)
GREEK_RUN = run_sql(
    sources=f"""{LEXICON}, gw AS (SELECT book, verse, {WORDS.format(_greek_sql('source_text'))} AS w FROM verses),
gs AS (SELECT book, verse, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM gw),
known AS (SELECT g.*, {_greek_sql('lemma')} AS lemma, upos FROM gs g LEFT JOIN lexicon ON {_greek_sql('surface')} = g.term WHERE regexp_matches(g.term, '^\\p{{L}}+$')),
source AS (SELECT book, verse, pos, CASE WHEN lemma IS NULL THEN lower(term) WHEN upos = 'PROPN' THEN lemma ELSE lower(lemma) END AS term FROM known WHERE upos IN ('NOUN', 'VERB', 'ADJ', 'ADV', 'PROPN') OR (lemma IS NULL AND length(term) >= 3))""",
    entries=f"{VERBS}, {FORMS}, {PIVOTED}",
    names="names AS (SELECT book AS batch, lemma AS source_term, count(*) AS n FROM known WHERE upos = 'PROPN' AND regexp_matches(term, '^\\p{Lu}') AND length(lemma) > 3 GROUP BY ALL)",
)


@query(f"WITH RECURSIVE {HEBREW_RUN}, {PAIRS} SELECT * FROM learned")
def hebrew_run(spark: SparkSession, sf: str) -> DataFrame:
    """All stages from Hebrew with vowels: terms without marks, a pivot, and names by their vocalised forms among the counts before dominance."""
    v, pivot = _run_verses(spark, sf), _hebrew_pivot(spark, sf)
    languages = learning.Languages(source="Hebrew", pivot=dictionaries.pivot_forms(pivot, "Hebrew"), vocalised=dictionaries.hebrew_pure_forms(pivot))
    events = learning.run(v.withColumn("source_text", _vocal(F.col("source_text"))), _verbs(spark, sf), languages, batch="batch")
    return learned.learned(store.cut(events))


@query(f"WITH RECURSIVE {GREEK_RUN}, {PAIRS} SELECT * FROM learned")
def greek_run(spark: SparkSession, sf: str) -> DataFrame:
    """All stages from Greek: lemmas and flagged names of a lexicon, and a pivot."""
    v, lexicon = _run_verses(spark, sf), _lexicon(spark, sf)
    lexicon = lexicon.select(_greek(F.col("surface")).alias("surface"), _greek(F.col("lemma")).alias("lemma"), "upos")
    languages = learning.Languages(source="Greek", lexicon=lexicon, pivot=dictionaries.pivot_forms(_pivot_rows(spark, sf), "Greek"))
    events = learning.run(v.withColumn("source_text", _greek(F.col("source_text"))), _verbs(spark, sf), languages, batch="batch")
    return learned.learned(store.cut(events))


# Files


def _xml(rows: DataFrame, path: str) -> None:
    """Verses (book, chapter, verse, text) as an XML corpus."""
    chapters = rows.groupBy("book", "chapter").agg(F.sort_array(F.collect_list(F.struct(F.col("verse").alias("_number"), F.col("text").alias("_VALUE")))).alias("verse"))
    books = chapters.groupBy("book").agg(F.sort_array(F.collect_list(F.struct(F.col("chapter").alias("_number"), "verse"))).alias("chapter"))
    books.select(F.col("book").alias("_number"), "chapter").write.format("xml").option("rowTag", "book").option("rootTag", "bible").save(path)


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = _read(spark, sf, "conversations").select(F.col("conv_id").cast("int").alias("book"), F.floor(F.col("turn") / 4).cast("int").alias("chapter"), F.col("turn").cast("int").alias("verse"), "role", F.translate("text", "\n", " ").alias("text"))
    return rows.where("role = 'user'").drop("role"), rows.where("role = 'assistant'").withColumn("verse", F.col("verse") - 1).withColumn("chapter", F.floor(F.col("verse") / 4).cast("int")).drop("role")


@query("""WITH s AS (SELECT conv_id AS book, turn // 4 AS chapter, turn AS verse, trim(replace(text, chr(10), ' ')) AS t FROM conversations WHERE role = 'user' AND length(text) > 0 AND conv_id BETWEEN 3 AND 60),
t AS (SELECT conv_id AS book, (turn - 1) // 4 AS chapter, turn - 1 AS verse, trim(replace(text, chr(10), ' ')) AS t FROM conversations WHERE role = 'assistant' AND length(text) > 0)
SELECT CAST(s.book AS INTEGER) AS book, CAST(s.chapter AS INTEGER) AS chapter, CAST(s.verse AS INTEGER) AS verse, s.book || '_' || s.chapter || '_' || s.verse AS verse_reference, s.t AS source_text, t.t AS target_text FROM s JOIN t USING (book, chapter, verse)""")
def xml_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Both sides of a corpus written as XML, read for a range of books, and aligned."""
    at = store.folder(spark, "xml")
    for name, rows in zip("st", _sides(spark, sf), strict=True):
        _xml(rows, f"{at}/{name}")
    return corpus.align(corpus.read_verses(spark, f"{at}/s", "3-60"), corpus.read_verses(spark, f"{at}/t"))


@query("SELECT CAST(conv_id AS INTEGER) AS book, CAST(turn // 4 AS INTEGER) AS chapter, count(*) AS verses FROM conversations WHERE role = 'user' GROUP BY ALL")
def xml_structure(spark: SparkSession, sf: str) -> DataFrame:
    """Verses of each chapter of an XML corpus."""
    at = store.folder(spark, "xml")
    _xml(_sides(spark, sf)[0], at)
    return corpus.structure(corpus.read_verses(spark, at))


DICTIONARY_LINES = """p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '# ' || p_name WHEN 1 THEN 'malformed ' || p_name ELSE replace(upper(p_name), ' ', '') || ' ' || replace(p_name, ' ', '') || ' [' || lower(p_type) || p_size || '] /' || p_name || ' (of ' || p_brand || '), kind/to ' || lower(p_type) || '/' || p_size || 'th/' END AS line FROM part),
good AS (SELECT line, regexp_extract(line, '^(.+?)\\s+(.+?)\\s+\\[([^\\]]+)\\]\\s+/(.+)/$', ['a', 'target', 'pinyin', 'd']) AS g FROM p WHERE regexp_matches(line, '^(.+?)\\s+(.+?)\\s+\\[([^\\]]+)\\]\\s+/(.+)/$') AND NOT starts_with(line, '#')),
clean AS (SELECT g.target AS target, trim(string_split(trim(regexp_replace(lower(trim(unnest(string_split(g.d, '/')))), '\\([^)]*\\)', '', 'g')), ',')[1]) AS term FROM good),
parsed AS (SELECT DISTINCT term, target FROM clean WHERE length(term) >= 2 AND regexp_matches(replace(replace(term, ' ', ''), '-', ''), '^\\p{L}+$'))"""


def _lines(spark: SparkSession, sf: str) -> str:
    p = lambda *xs: F.concat(*[F.col(x[1:]) if x.startswith("$") else F.lit(x) for x in xs])
    joined = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    entry = F.concat(joined(F.upper("p_name")), F.lit(" "), joined(F.col("p_name")), F.lit(" ["), lowered("p_type"), F.col("p_size").cast("string"), F.lit("] /"), p("$p_name", " (of ", "$p_brand", "), kind/to "), lowered("p_type"), F.lit("/"), F.col("p_size").cast("string"), F.lit("th/"))
    line = F.when(F.col("p_partkey") % 5 == 0, p("# ", "$p_name")).when(F.col("p_partkey") % 5 == 1, p("malformed ", "$p_name")).otherwise(entry)
    at = store.folder(spark, "dictionary")
    _read(spark, sf, "part").select(line.alias("value")).write.text(at)
    return at


@query(f"WITH {DICTIONARY_LINES} SELECT term, target FROM parsed")
def dictionary_file(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of a dictionary text file; comments and lines of another form drop out."""
    return dictionaries.read_dictionary(spark, _lines(spark, sf)).select("term", "target")


@query(f"WITH {DICTIONARY_LINES}, pairs AS (SELECT unnest(['English', 'Greek', 'Hebrew', 'Latin', 'German', 'English']) AS source, unnest(['Chinese', 'Chinese', 'Chinese', 'Chinese', 'Chinese', 'French']) AS target) SELECT source, target, CASE WHEN source IN ('English', 'Greek', 'Hebrew', 'Latin') AND target = 'Chinese' THEN (SELECT count(*) FROM parsed) ELSE 0 END AS entries FROM pairs")
def dictionary_of_language_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """How many entries each pair of languages has; unsupported ones have none."""
    at, out = _lines(spark, sf), None
    for source, target in [(x, "Chinese") for x in ("English", "Greek", "Hebrew", "Latin", "German")] + [("English", "French")]:
        own = dictionaries.read_dictionary(spark, at, source, target).agg(F.count("*").alias("entries")).select(F.lit(source).alias("source"), F.lit(target).alias("target"), "entries")
        out = own if out is None else out.unionByName(own)
    return out


@query(f"WITH {FORMS} SELECT 'Greek' AS language, form, english FROM forms UNION ALL SELECT 'Hebrew', {_spelt_sql('w', HEBREW)}, w FROM bwords UNION ALL SELECT 'Hebrew', {_spelt_sql('w[1:3]', HEBREW)}, w FROM bwords")
def pivot_file(spark: SparkSession, sf: str) -> DataFrame:
    """Forms of a pivot dictionary read from JSON, by language; a missing file has none."""
    at = store.folder(spark, "pivot")
    _pivot_rows(spark, sf).agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).coalesce(1).write.text(at)  # one JSON list, as pivots are kept
    pivot = dictionaries.read_pivot(spark, at)
    if dictionaries.read_pivot(spark, f"{at}-missing") is not None:
        raise ValueError("a missing pivot dictionary must be None")
    languages = [dictionaries.pivot_forms(pivot, x).select(F.lit(x).alias("language"), "form", "english") for x in ("Greek", "Hebrew", "Latin")]
    return languages[0].unionByName(languages[1]).unionByName(languages[2])


@query(f"WITH {VERSES} SELECT book, verse, verse_reference, source_text, target_text FROM verses")
def corpus_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """A corpus saved as JSON by batch and loaded again."""
    at, rows = store.folder(spark, "corpus"), _verses(spark, sf).withColumn("batch", F.pmod("book", F.lit(4)))
    corpus.save_corpus(rows, at, "batch", "json")
    return corpus.load_corpus(spark, at, "json", rows.schema).drop("batch")


@query("SELECT p_partkey, p_name FROM part")
def backup_copy(spark: SparkSession, sf: str) -> DataFrame:
    """A saved table's backup, made before the table is overwritten; none of a table that isn't there."""
    at = store.folder(spark, "saved")
    rows = _read(spark, sf, "part").select("p_partkey", "p_name")
    rows.write.parquet(at)
    kept = store.backup(spark, at)
    rows.limit(0).write.mode("overwrite").parquet(at)
    if store.backup(spark, f"{at}-missing") is not None:
        raise ValueError("a missing table has no backup")
    return spark.read.parquet(kept)


METRICS = "SELECT user_id AS batch, event_type AS metric, round(avg(value), 6) AS value FROM events GROUP BY ALL"


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "events").groupBy(F.col("user_id").alias("batch"), F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))


@query(METRICS)
def metrics_file(spark: SparkSession, sf: str) -> DataFrame:
    """All batches' metrics written as JSON and read again."""
    at, rows = store.folder(spark, "metrics"), _metrics(spark, sf)
    store.write_metrics(rows, at)
    return spark.read.schema(rows.schema).json(at)


@query("SELECT count(*) AS total, min(ts) AS created, max(ts) AS last_updated FROM events WHERE event_type IN ('view', 'click')")
def tuning_history(spark: SparkSession, sf: str) -> DataFrame:
    """A history of runs, added to twice: how many there are, the first and the last."""
    at, rows = store.folder(spark, "history"), _read(spark, sf, "events").select(F.col("event_id").alias("run"), F.col("ts").alias("created"), "event_type")
    store.append_tuning(rows.where("event_type = 'view'"), at)
    return store.append_tuning(rows.where("event_type = 'click'"), at)


# Saved state

HALVES = f"""{VERSES}, {SOURCE}, {TARGETS}, {ENTRIES}, {MATCHES}, events AS ({MATCHED})"""


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Events of the conversations up to number 50, as a saved run gives them back, and those of the others."""
    at, verses, entries = store.folder(spark, "state"), _verses(spark, sf), store.cut(_dictionary(spark, sf))
    first, rest = verses.where("book <= 50"), verses.where("book > 50")
    counts = first.groupBy("book").agg(F.count("*").alias("cnt")).select("book", F.lit("").alias("source_term"), F.lit("").alias("target_term"), "cnt")
    store.save_state(at, learning.dictionary_events(first, entries), counts, first)
    events, _, seen = store.restore_state(spark, at)
    fresh = rest.join(seen, "verse_reference", "left_anti").select(rest.columns)
    return events, learning.dictionary_events(fresh, entries)


@query(f"WITH {HALVES}, {PAIRS} SELECT * FROM learned")
def restarted_learning(spark: SparkSession, sf: str) -> DataFrame:
    """A run saved half-way, restored, and finished: the same dictionary as one run's."""
    old, new = _halves(spark, sf)
    return learned.learned(old.unionByName(new))


@query(f"WITH {HALVES.replace('events AS', 'whole AS')}, events AS (SELECT * FROM whole WHERE seq.book > 50), {ACTED}, known AS (SELECT DISTINCT source_term FROM whole WHERE seq.book <= 50) SELECT batch_reference, CASE WHEN action = 'learned' AND source_term NOT IN (SELECT source_term FROM known) THEN 'learned' ELSE 'updated' END AS action, count(*) AS n FROM acted GROUP BY ALL")
def restarted_actions(spark: SparkSession, sf: str) -> DataFrame:
    """What the second half learns and what it only updates, as the restored dictionary has it."""
    old, new = _halves(spark, sf)
    return learned.actions(store.cut(new), old).groupBy("batch_reference", "action").agg(F.count("*").alias("n"))


@query(f"WITH {HALVES} SELECT batch_reference FROM events GROUP BY ALL")
def batches_processed(spark: SparkSession, sf: str) -> DataFrame:
    return store.batches_processed(learning.dictionary_events(_verses(spark, sf), _dictionary(spark, sf)))


#: Pairs of a batch, taken over a snapshot of the first third, a delta of the second and one of the last.
GROWN = f"""{PART}, grown AS (SELECT 'p' || batch AS batch_reference, source_term, target_term, cnt FROM counts)"""


@query(f"WITH RECURSIVE {GROWN}, {CLAIMED.format('counts')}, d AS (SELECT 'p' || batch AS batch_reference, source_term, target_term, is_primary FROM dominated) SELECT g.batch_reference, g.source_term, g.target_term, CAST(g.cnt AS BIGINT) AS cnt, d.is_primary FROM grown g LEFT JOIN d USING (batch_reference, source_term, target_term)")
def grown_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Co-occurrences counted in three runs, the first two made one snapshot, and what dominance learns from all: as from one run."""
    at, rows = store.folder(spark, "counts"), _part(spark, sf)
    for i in range(3):
        own = cooccurrence.verse_counts(rows.where(F.pmod("p_partkey", F.lit(3)) == i), ["p_partkey", "batch"], "s", "t")
        counts.append_delta(own.withColumn("batch_reference", F.concat(F.lit("p"), "batch")), at, i + 1)
        if i == 1:
            counts.compacted(spark, at)
    whole = counts.restored(spark, at)
    won = dominance.learn(whole, "batch_reference").select("batch_reference", "source_term", "target_term", "is_primary")
    return whole.join(won, ["batch_reference", "source_term", "target_term"], "left")


# Batches, models and limits

PACKS = f"{SIMS}, {LIMITS}, {BREAKS}, {PERICOPES}, {PACKED}"


@query(f"WITH RECURSIVE {PACKS}, n AS (SELECT book, pericope, batch FROM pack WHERE pericope > 0) SELECT book, pericope, CAST(batch AS INTEGER) AS batch, CAST(row_number() OVER (PARTITION BY book, batch ORDER BY pericope) AS INTEGER) AS pericope_number FROM n")
def pericope_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    return segment.pericope_ordinals(segment.pack(_passages(spark, sf))).select("book", "pericope", "batch", "pericope_number")


@query(f"WITH RECURSIVE {PACKS} SELECT book, pericope, book || '_' || start || '-' || \"end\" AS pericope_reference FROM passages WHERE starts_with(book || '_' || start, '1000000000_')")
def passages_of_a_book(spark: SparkSession, sf: str) -> DataFrame:
    """One book's passages, by the beginning of their references."""
    rows = _passages(spark, sf).withColumn("pericope_reference", F.concat(reference(F.col("book"), F.col("start")), F.lit("-"), F.col("end").cast("string")))
    return segment.of_book(rows, F.lit(1_000_000_000)).select("book", "pericope", "pericope_reference")


@query(f"WITH {VERSES} SELECT book, string_agg(source_text, ' ' ORDER BY verse) AS text FROM verses GROUP BY book")
def batch_texts(spark: SparkSession, sf: str) -> DataFrame:
    return segment.batch_texts(_verses(spark, sf), "book", "verse", "source_text")


@query("SELECT event_type AS cache, sum(value) AS total FROM events GROUP BY event_type HAVING sum(value) > 20000")
def caches_over_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Caches whose files take more than a limit."""
    return evaluate.over_limit(_read(spark, sf, "events").withColumn("cache", F.col("event_type")), "cache", "value", 20_000).select("cache", "total")


@query("SELECT user_id AS batch, round(count(*) * 1000 / greatest(sum(value), 1), 6) AS tokens_per_second FROM events GROUP BY user_id")
def token_speed(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "events").groupBy(F.col("user_id").alias("batch")).agg((F.count("*") * 1000).alias("tokens"), F.sum("value").alias("seconds"))
    return rows.select("batch", F.round(evaluate.tokens_per_second(F.col("tokens"), F.col("seconds")), 6).alias("tokens_per_second"))


@query(f"WITH {VERSES} SELECT book, verse, reverse(source_text) AS translation FROM verses")
def plugged_translation(spark: SparkSession, sf: str) -> DataFrame:
    """Translations by a model that the caller gives; here one that turns texts round."""
    return evaluate.translated(_verses(spark, sf), KEYS, "source_text", lambda texts: [t[::-1] for t in texts])


@query(f"WITH {VERSES} SELECT book, verse, round(least(length(source_text), length(target_text)) / greatest(length(source_text), length(target_text)), 6)::DOUBLE AS score FROM verses")
def plugged_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of translations by a model that the caller gives; here the ratio of lengths."""
    ratio = lambda a, b: [min(len(x), len(y)) / max(len(x), len(y)) for x, y in zip(a, b, strict=True)]
    return evaluate.plugged(_verses(spark, sf), KEYS, ["source_text", "target_text"], ratio, "score", "double").withColumn("score", F.round("score", 6))


@query("WITH b AS (SELECT user_id AS batch, sum(value) AS s, count(*) AS n FROM events WHERE user_id < 8 GROUP BY user_id) SELECT CAST(batch AS BIGINT) AS batch, CAST(sum(n) OVER (ORDER BY batch) AS BIGINT) AS seen, round(sum(s) OVER (ORDER BY batch) / sum(n) OVER (ORDER BY batch), 6) AS mean FROM b")
def tuning_chain(spark: SparkSession, sf: str) -> DataFrame:
    """A model tuned batch by batch, saved and loaded in between; here a running mean."""
    at, rows = store.folder(spark, "model"), _read(spark, sf, "events").where("user_id < 8")
    batches = [r["user_id"] for r in rows.select("user_id").distinct().orderBy("user_id").collect()]  # the batches' names, at most eight

    def tune(path: str | None, batch: int) -> tuple[str, dict]:
        total, seen = json.loads(store.load_model(spark, path)) if path else (0.0, 0)
        own = rows.where(F.col("user_id") == batch).agg(F.sum("value").alias("s"), F.count("*").alias("n")).first()
        total, seen = total + own["s"], seen + own["n"]
        store.save_model(spark, json.dumps([total, seen]).encode(), f"{at}/{batch}")
        return f"{at}/{batch}", {"batch": batch, "seen": seen, "mean": round(total / seen, 6)}

    _, metrics = evaluate.chained(batches, tune)
    return spark.createDataFrame([(m["batch"], m["seen"], m["mean"]) for m in metrics], "batch long, seen long, mean double")


@query(f"""WITH {DAILY}, placed AS (SELECT metric, row_number() OVER (PARTITION BY metric ORDER BY batch) AS i, CASE WHEN max(value) OVER m > min(value) OVER m THEN CAST(round(100 * (max(value) OVER m - value) / (max(value) OVER m - min(value) OVER m)) AS INTEGER) ELSE 50 END AS y FROM daily WINDOW m AS (PARTITION BY metric))
SELECT metric, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 ' || count(*) * 10 || ' 100"><polyline fill="none" stroke="black" points="' || string_agg((i - 1) * 10 || ',' || y, ' ' ORDER BY i) || '"/></svg>' AS svg FROM placed GROUP BY metric""")
def metric_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Each metric's values over the batches, drawn as a line."""
    return evaluate.lines(_daily(spark, sf), "metric", "batch", "value")
