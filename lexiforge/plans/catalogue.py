"""Queries over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.similarity import name_score, shared_pieces
from ..functions.text import char_ngrams, chinese_punctuation, is_proper, length_factor, lowered, mbart_code, position_ratio, stanza_code, words
from ..operators import cooccurrence, dictionary, dominance, evaluate, learned, proper_nouns, segment, similarity
from ..operators.tokens import distinct_terms, exploded_counts, term_counts, tokens
from ..shipping import ship
from ..sources import corpus, dictionaries, store
from ..streaming import stateful
from ..streaming.incremental import learn_stream
from . import learning

KEYS = ["book", "verse"]
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _verses(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.conversation_verses(_read(spark, sf, "conversations"))


def _dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return dictionaries.from_sequences(_read(spark, sf, "benchmark"))


STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
WORDS = r"list_filter(list_transform(regexp_split_to_array({0}, '\s+'), lambda x: regexp_replace(x, '^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+$', '', 'g')), lambda x: x <> '')"
VERSES = f"""verses AS (
  SELECT u.conv_id AS book, u.turn AS verse, u.conv_id || '_' || u.turn AS verse_reference, {STRIP.format('u.text')} AS source_text, {STRIP.format('a.text')} AS target_text
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant' AND length(u.text) > 0 AND length(a.text) > 0)"""
SOURCE = f"""sw AS (SELECT book, verse, {WORDS.format('source_text')} AS w FROM verses),
source AS (SELECT book, verse, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM sw)"""
TARGETS = f"""tw AS (SELECT book, verse, {WORDS.format('lower(target_text)')} AS w FROM verses),
targets AS (SELECT DISTINCT book, verse, unnest(w) AS term FROM tw)"""
ENTRIES = f"""bw AS (SELECT item_id, list_transform({WORDS.format('text')}, lambda x: lower(x)) AS w FROM benchmark),
bt AS (SELECT item_id, w, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM bw),
entries AS (SELECT term, w[i + 1] AS target, CAST(min(item_id * 4294967296 + i - 1) AS BIGINT) AS ord FROM bt WHERE i < len(w) GROUP BY ALL)"""
MATCHES = """found AS (
  SELECT DISTINCT s.book, s.verse, s.pos AS src_pos, s.term AS source_term, e.target AS target_term
  FROM source s JOIN entries e ON e.term IN (lower(s.term), 'to ' || lower(s.term)) JOIN targets t ON t.book = s.book AND t.verse = s.verse AND t.term = e.target),
matches AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY book, verse, src_pos ORDER BY length(target_term) DESC, target_term) AS INTEGER) AS rank FROM found)"""
PART = f"""pw AS (SELECT p_partkey, p_size AS batch, list_distinct({WORDS.format('p_name')}) AS s, {WORDS.format("p_type || ' ' || p_brand")} AS t FROM part),
p1 AS (SELECT p_partkey, batch, unnest(s) AS source_term, t FROM pw),
pairs AS (SELECT p_partkey, batch, source_term, unnest(t) AS target_term FROM p1),
counts AS (SELECT batch, source_term, target_term, CAST(count(*) AS BIGINT) AS cnt FROM pairs GROUP BY ALL)"""


# Corpus, words and counts


@query(f"WITH {VERSES} SELECT book, verse, verse_reference, source_text, target_text FROM verses")
def corpus_align(spark: SparkSession, sf: str) -> DataFrame:
    return _verses(spark, sf)


@query("SELECT conv_id AS book, role AS chapter, count(*) AS verses FROM conversations GROUP BY ALL")
def corpus_structure(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "conversations").select(F.col("conv_id").alias("book"), F.col("role").alias("chapter"))
    return corpus.structure(rows)


@query(f"WITH w AS (SELECT unnest({WORDS.format('text')}) AS term FROM documents) SELECT term, count(*) AS occurrences FROM w GROUP BY term")
def word_counts(spark: SparkSession, sf: str) -> DataFrame:
    return term_counts(_read(spark, sf, "documents"))


@query(rf"WITH w AS (SELECT unnest({WORDS.format('text')}) AS term FROM documents) SELECT term, count(*) AS occurrences FROM w WHERE regexp_matches(term, '^\p{{Lu}}') GROUP BY term")
def proper_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return term_counts(_read(spark, sf, "documents")).where(is_proper(F.col("term")))


@query("""WITH g AS (SELECT text[i:i + k - 1] AS term FROM benchmark, range(1, 5) t(k), LATERAL (SELECT unnest(range(1, length(text) - k + 2)) AS i))
SELECT term, count(*) AS occurrences FROM g GROUP BY term""")
def char_ngram_counts(spark: SparkSession, sf: str) -> DataFrame:
    return exploded_counts(_read(spark, sf, "benchmark"), char_ngrams(F.col("text")))


def _part(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "part").select("p_partkey", F.col("p_size").alias("batch"), words(F.col("p_name")).alias("s"), words(F.concat_ws(" ", "p_type", "p_brand")).alias("t"))


def _part_counts(spark: SparkSession, sf: str) -> DataFrame:
    return cooccurrence.verse_counts(_part(spark, sf), ["batch"], "s", "t")


@query(f"WITH {PART} SELECT p_partkey AS verse, source_term, target_term, count(*) AS cnt FROM pairs GROUP BY ALL")
def cooccurrence_verse(spark: SparkSession, sf: str) -> DataFrame:
    return cooccurrence.verse_counts(_part(spark, sf).withColumnRenamed("p_partkey", "verse"), ["verse"], "s", "t")


@query(f"WITH {PART} SELECT batch, source_term, target_term, cnt FROM counts")
def cooccurrence_batch(spark: SparkSession, sf: str) -> DataFrame:
    return cooccurrence.batch_counts(cooccurrence.verse_counts(_part(spark, sf), ["p_partkey", "batch"], "s", "t"), ["batch"])


@query(f"WITH {PART} SELECT source_term, target_term, CAST(sum(cnt) AS BIGINT) AS cnt FROM counts GROUP BY ALL")
def cooccurrence_global(spark: SparkSession, sf: str) -> DataFrame:
    return cooccurrence.batch_counts(_part_counts(spark, sf), [])


@query(f"WITH w AS (SELECT l_orderkey, unnest({WORDS.format('p_name')}) AS source_term, p_type AS target_term, l_quantity FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT source_term, target_term, count(*) AS cnt, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM w GROUP BY ALL")
def cooccurrence_volume(spark: SparkSession, sf: str) -> DataFrame:
    """Co-occurrence weighed by sales: counted by part before the terms are unfolded."""
    sold = _read(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    rows = sold.join(_read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.explode(words(F.col("p_name"))).alias("source_term"), F.col("p_type").alias("target_term"), "n", "q")
    return rows.groupBy("source_term", "target_term").agg(F.sum("n").alias("cnt"), F.sum("q").alias("quantity"))


# Dictionaries


@query(f"WITH {ENTRIES} SELECT term, target, ord FROM entries")
def dictionary_build(spark: SparkSession, sf: str) -> DataFrame:
    return _dictionary(spark, sf)


@query(f"WITH {VERSES}, {SOURCE}, {TARGETS}, {ENTRIES}, {MATCHES} SELECT book, verse, CAST(src_pos AS INTEGER) AS src_pos, source_term, target_term, rank, rank = 1 AS is_primary, CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END AS score FROM matches")
def dictionary_match(spark: SparkSession, sf: str) -> DataFrame:
    v = _verses(spark, sf)
    return dictionary.matches(tokens(v, KEYS, "source_text"), distinct_terms(v, KEYS, "target_text"), _dictionary(spark, sf), KEYS)


@query(f"""WITH {VERSES}, {SOURCE}, {TARGETS}, {ENTRIES}, {MATCHES},
counted AS (SELECT book, verse, term, count(*) AS n FROM source GROUP BY ALL),
held AS (SELECT DISTINCT book, verse, target_term FROM matches WHERE rank = 1)
SELECT book, verse, 'source' AS side, term FROM counted c WHERE n > 1 OR NOT EXISTS (SELECT 1 FROM matches m WHERE m.book = c.book AND m.verse = c.verse AND m.source_term = c.term)
UNION ALL
SELECT book, verse, 'target' AS side, term FROM targets t WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.book = t.book AND h.verse = t.verse AND contains(t.term, h.target_term))""")
def dictionary_residual(spark: SparkSession, sf: str) -> DataFrame:
    v = store.cut(_verses(spark, sf))
    source, targets = store.cut(tokens(v, KEYS, "source_text")), store.cut(distinct_terms(v, KEYS, "target_text"))
    found = store.cut(dictionary.matches(source, targets, _dictionary(spark, sf), KEYS))
    left = dictionary.residual_sources(source, found, KEYS).select(*KEYS, F.lit("source").alias("side"), "term")
    return left.unionByName(dictionary.residual_targets(targets, found.where("is_primary"), KEYS).select(*KEYS, F.lit("target").alias("side"), "term"))


# Similarity


def _word_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _dictionary(spark, sf).select(F.col("term").alias("a"), F.col("target").alias("b"))


@query(f"""WITH {ENTRIES}, p AS (SELECT term AS a, target AS b, length(term) AS n, length(target) AS m FROM entries)
SELECT a, b, round(CASE WHEN n = m AND n > 0 THEN len(list_filter(range(1, n + 1), lambda i: a[i] = b[i])) / n ELSE 0.0::DOUBLE END, 6) AS char_ratio, round(1 - 0.5 * abs(n - m) / greatest(n, m), 6)::DOUBLE AS length_factor FROM p""")
def char_length_similarity(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _word_pairs(spark, sf).select("a", "b", F.round(position_ratio(a, b), 6).alias("char_ratio"), F.round(length_factor(a, b), 6).alias("length_factor"))


@query()
def similarity_match(spark: SparkSession, sf: str) -> DataFrame:
    v = store.cut(_verses(spark, sf))
    source, targets, entries = store.cut(tokens(v, KEYS, "source_text")), store.cut(distinct_terms(v, KEYS, "target_text")), _dictionary(spark, sf).withColumn("pinyin", F.col("target"))
    found = store.cut(dictionary.matches(source, targets, entries, KEYS))
    left = dictionary.residual_targets(targets, found.where("is_primary"), KEYS).withColumn("pinyin", F.col("term"))
    got = similarity.matches(dictionary.residual_sources(source, found, KEYS), left, entries, KEYS)
    return got.withColumn("similarity", F.round("similarity", 6))


@query()
def name_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Each entry's word as a name against its target as a sound, by the rules of four languages in turn."""
    languages = F.array(*[F.lit(x) for x in ("English", "Hebrew", "Greek", "Latin")])
    rows = _dictionary(spark, sf).select(F.initcap("term").alias("source_term"), F.col("target").alias("target_term"), F.element_at(languages, (F.pmod("ord", F.lit(4)) + 1).cast("int")).alias("language"))
    return rows.withColumn("similarity", F.round(name_score("source_term", "target_term", "language"), 6))


# Dominance and proper nouns

DOMINANT = """ranked AS (SELECT *, max(cnt) OVER (PARTITION BY batch, source_term) AS most, count(*) OVER (PARTITION BY batch, source_term) AS n FROM counts),
top AS (SELECT *, CAST(count(*) OVER (PARTITION BY batch, source_term) AS BIGINT) AS ties FROM ranked WHERE n >= 2 AND most >= 4 AND cnt = most),
dominant AS (SELECT batch, source_term, target_term, cnt, ties, CAST(row_number() OVER (PARTITION BY batch, source_term ORDER BY length(target_term) DESC, target_term) AS INTEGER) AS rank FROM top WHERE ties <= 9)"""


@query(f"WITH {PART}, {DOMINANT} SELECT batch, source_term, target_term, cnt, ties, rank FROM dominant")
def dominance_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return dominance.candidates(_part_counts(spark, sf), ["batch"])


CLAIMED = """items AS (SELECT batch, source_term, list({{'t': target_term, 'c': cnt}}) AS items, row_number() OVER (PARTITION BY batch ORDER BY source_term) AS i FROM {0} GROUP BY batch, source_term HAVING max(cnt) >= 4),
claimed AS (
  SELECT batch, 0::BIGINT AS i, []::VARCHAR[] AS taken, '' AS source_term, []::STRUCT(t VARCHAR, c BIGINT)[] AS top, NULL::BIGINT AS most FROM (SELECT DISTINCT batch FROM items)
  UNION ALL
  SELECT batch, i, CASE WHEN ok THEN list_concat(taken, list_transform(top, lambda x: x.t)) ELSE taken END, source_term, CASE WHEN ok THEN top ELSE [] END, most
  FROM (SELECT *, len(free) >= 2 AND most >= 4 AND len(top) <= 9 AS ok
    FROM (SELECT *, list_filter(free, lambda x: x.c = most) AS top
      FROM (SELECT *, list_max(list_transform(free, lambda x: x.c)) AS most
        FROM (SELECT n.batch, n.i, c.taken, n.source_term, list_filter(n.items, lambda x: NOT list_contains(c.taken, x.t)) AS free FROM claimed c JOIN items n ON n.batch = c.batch AND n.i = c.i + 1))))),
tops AS (SELECT batch, source_term, most, unnest(top).t AS target_term FROM claimed WHERE len(top) > 0),
dominated AS (SELECT batch, source_term, target_term, most AS cnt, row_number() OVER (PARTITION BY batch, source_term ORDER BY length(target_term) DESC, target_term) = 1 AS is_primary FROM tops)"""


@query(f"WITH RECURSIVE {PART}, {CLAIMED.format('counts')} SELECT batch, source_term, target_term, CAST(cnt AS BIGINT) AS cnt, is_primary, CASE WHEN is_primary THEN 5.0::DOUBLE ELSE 4.0::DOUBLE END AS score FROM dominated")
def dominance_learn(spark: SparkSession, sf: str) -> DataFrame:
    return dominance.learn(store.cut(_part_counts(spark, sf)), "batch")


@query(rf"""WITH {VERSES}, {SOURCE}, {TARGETS},
names AS (SELECT book, term AS source_term, count(*) AS n FROM source WHERE regexp_matches(term, '^\p{{Lu}}') GROUP BY ALL),
once AS (SELECT DISTINCT book, verse, term AS source_term FROM source),
counts AS (SELECT o.book, o.source_term, t.term AS target_term, count(*) AS cnt FROM once o JOIN targets t USING (book, verse) JOIN names n ON n.book = o.book AND n.source_term = o.source_term GROUP BY ALL)
SELECT c.book, c.source_term, c.target_term, c.cnt FROM counts c JOIN names n ON n.book = c.book AND n.source_term = c.source_term WHERE c.cnt = n.n AND length(c.target_term) >= 2""")
def proper_noun_equal_count(spark: SparkSession, sf: str) -> DataFrame:
    v = _verses(spark, sf)
    source, targets = tokens(v, KEYS, "source_text"), distinct_terms(v, KEYS, "target_text")
    names = proper_nouns.source_counts(source, ["book"])
    once = source.where(is_proper(F.col("term"))).select(*KEYS, F.col("term").alias("source_term")).distinct()
    counts = once.join(targets.select(*KEYS, F.col("term").alias("target_term")), KEYS).groupBy("book", "source_term", "target_term").agg(F.count("*").alias("cnt"))
    return proper_nouns.equal_counts(names, counts, ["book"]).where(F.length("target_term") >= 2)


PIECES = "list_distinct(list_concat(list_transform(range(1, length({0})), lambda i: {0}[i:i + 1]), list_transform(range(1, length({0}) - 1), lambda i: {0}[i:i + 2])))"
SHARED_PIECES = f"coalesce(len(list_intersect({PIECES.format('a')}, {PIECES.format('b')}))::DOUBLE / nullif(len(list_distinct(list_concat({PIECES.format('a')}, {PIECES.format('b')}))), 0), 0)"
#: How alike two terms are: places, pieces and length weighed, and a part for their share of the source's words in the batch.
CLAIMS = f"""spelt AS (SELECT *, lower(source_term) AS a, lower(target_term) AS b FROM counts),
claims AS (SELECT batch, source_term, target_term, round(0.4 * {SHARED_PIECES} + 0.3 * (1 - 0.5 * abs(length(a) - length(b)) / greatest(length(a), length(b))) + 0.4 * cnt / max(cnt) OVER (PARTITION BY batch, source_term), 6)::DOUBLE AS similarity FROM spelt)"""
WON = f"""{CLAIMS}, placed AS (SELECT *, row_number() OVER (PARTITION BY batch, target_term ORDER BY similarity DESC, source_term) AS r FROM claims WHERE similarity >= 0.56), won AS (SELECT batch, source_term, target_term, similarity FROM placed WHERE r = 1)"""


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    a, b = lowered("source_term"), lowered("target_term")
    most = F.max("cnt").over(Window.partitionBy("batch", "source_term"))
    score = 0.4 * shared_pieces(a, b) + 0.3 * length_factor(a, b) + 0.4 * F.col("cnt") / most
    return _part_counts(spark, sf).select("batch", "source_term", "target_term", F.round(score, 6).alias("similarity"))


@query(f"WITH {PART}, {WON} SELECT batch, source_term, target_term, similarity FROM won")
def conflict_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return proper_nouns.resolve(_claims(spark, sf), ["batch"])


@query(f"WITH {PART}, {WON} SELECT DISTINCT batch, source_term AS term FROM counts c WHERE NOT EXISTS (SELECT 1 FROM won w WHERE w.batch = c.batch AND w.source_term = c.source_term)")
def conflict_losers(spark: SparkSession, sf: str) -> DataFrame:
    claims = _claims(spark, sf)
    names = claims.select("batch", F.col("source_term").alias("term")).distinct()
    return proper_nouns.losers(names, proper_nouns.resolve(claims, ["batch"]), ["batch"])


AGAIN = """lost AS (SELECT c.batch, c.source_term, list({'t': c.target_term} ORDER BY c.similarity DESC, c.target_term) AS items, list(c.similarity ORDER BY c.similarity DESC, c.target_term) AS scores, row_number() OVER (PARTITION BY c.batch ORDER BY c.source_term) AS i
  FROM claims c WHERE c.similarity >= 0.5 AND NOT EXISTS (SELECT 1 FROM won w WHERE w.batch = c.batch AND w.source_term = c.source_term) GROUP BY c.batch, c.source_term),
again AS (
  SELECT b.batch, 0::BIGINT AS i, coalesce((SELECT list(target_term) FROM won w WHERE w.batch = b.batch), []) AS taken, '' AS source_term, 0::BIGINT AS hit, NULL::VARCHAR AS target_term, NULL::DOUBLE AS similarity FROM (SELECT DISTINCT batch FROM lost) b
  UNION ALL
  SELECT batch, i, CASE WHEN hit > 0 THEN list_append(taken, items[hit].t) ELSE taken END, source_term, hit, items[hit].t, scores[hit]
  FROM (SELECT *, coalesce(list_position(list_transform(items, lambda x: NOT list_contains(taken, x.t)), true), 0)::BIGINT AS hit
    FROM (SELECT l.batch, l.i, a.taken, l.source_term, l.items, l.scores FROM again a JOIN lost l ON l.batch = a.batch AND l.i = a.i + 1)))"""


@query(f"WITH RECURSIVE {PART}, {WON}, {AGAIN} SELECT batch, source_term, target_term, similarity FROM again WHERE hit > 0")
def loser_reattribution(spark: SparkSession, sf: str) -> DataFrame:
    claims = store.cut(_claims(spark, sf))
    return proper_nouns.reattribute(claims, proper_nouns.resolve(claims, ["batch"]), "batch")


# Events and the learned dictionary

#: Batches of parts come after all books.
AFTER = 10**12


def seq_sql(book: str, stage: int = 0, verse: str = "0", part: int = 0, pos: str = "0", source: str = "''", rank: str = "0", target: str = "''") -> str:
    number = lambda x: f"CAST({x} AS BIGINT)"
    return f"struct_pack(book := {number(book)}, stage := {stage}, verse := {number(verse)}, part := {part}, pos := {number(pos)}, source := {source}, rank := {number(rank)}, target := {target})"


MATCHED = f"SELECT {seq_sql('book', verse='verse', pos='src_pos', rank='rank')} AS seq, 'dictionary' AS method, CAST(book AS VARCHAR) AS batch_reference, book || '_' || verse AS verse_reference, source_term, target_term, CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END AS score, rank = 1 AS is_primary FROM matches"
EVENTS = f"""{VERSES}, {SOURCE}, {TARGETS}, {ENTRIES}, {MATCHES}, {PART}, {DOMINANT}, {WON},
events AS (
  {MATCHED}
  UNION ALL
  SELECT {seq_sql(f'{AFTER} + batch', 1, source='source_term', rank='rank', target='target_term')}, 'dominance', 'p' || batch, 'p' || batch, source_term, target_term, CASE WHEN rank = 1 THEN 5.0::DOUBLE ELSE 4.0::DOUBLE END, rank = 1 FROM dominant
  UNION ALL
  SELECT {seq_sql(f'{AFTER} + batch', 2, source='source_term', target='target_term')}, 'proper_noun', 'p' || batch, 'p' || batch, source_term, target_term, similarity * 6, true FROM won)"""
PAIRS = """ends AS (SELECT source_term, min_by(verse_reference, seq) AS first_learned, max_by(verse_reference, seq) AS last_updated FROM events GROUP BY ALL),
scored AS (SELECT source_term, target_term, round(sum(score), 6) AS confidence_score, bool_or(is_primary) AS is_primary, min(seq) AS s FROM events GROUP BY ALL),
learned AS (SELECT source_term, target_term, confidence_score, is_primary, first_learned, last_updated, CAST(row_number() OVER (PARTITION BY source_term ORDER BY s, target_term) AS INTEGER) AS target_ord FROM scored JOIN ends USING (source_term))"""
ACTED = """firsts AS (SELECT source_term, min(seq) AS first_seq FROM events GROUP BY ALL),
acted AS (SELECT DISTINCT e.seq, batch_reference, method, e.source_term, CASE WHEN seq = first_seq THEN 'learned' ELSE 'updated' END AS action FROM events e JOIN firsts f ON f.source_term = e.source_term WHERE is_primary)"""
SIZES = """sizes AS (SELECT CAST(book AS VARCHAR) AS batch_reference, count(*) AS verse_count FROM verses GROUP BY ALL UNION ALL SELECT 'p' || p_size, count(*) FROM part GROUP BY ALL)"""
STATS = f"""{EVENTS}, {ACTED}, {SIZES},
per AS (SELECT batch_reference, count(*) FILTER (method = 'dictionary') AS d, count(*) FILTER (method = 'dominance') AS m, count(*) FILTER (method = 'proper_noun') AS p FROM acted WHERE action = 'learned' GROUP BY ALL),
stats AS (SELECT s.batch_reference, CAST(verse_count AS BIGINT) AS verse_count, CAST(coalesce(d, 0) AS BIGINT) AS dictionary_learned, 0::BIGINT AS similarity_learned, CAST(coalesce(m, 0) AS BIGINT) AS dominance_learned, CAST(coalesce(p, 0) AS BIGINT) AS proper_noun_learned, 0::BIGINT AS proper_noun_unresolved,
  CAST(coalesce(d, 0) + coalesce(m, 0) + coalesce(p, 0) AS BIGINT) AS total_learned, round((coalesce(d, 0) + coalesce(m, 0) + coalesce(p, 0)) / verse_count, 6)::DOUBLE AS avg_learned_per_verse FROM sizes s LEFT JOIN per USING (batch_reference))"""


def _events(spark: SparkSession, sf: str) -> DataFrame:
    first = learning.dictionary_events(_verses(spark, sf), _dictionary(spark, sf))
    counts = _part_counts(spark, sf).withColumn("reference", F.concat(F.lit("p"), "batch"))
    place = lambda stage, rank=None: learning.sequence(F.col("batch") + AFTER, stage, source=F.col("source_term"), rank=rank, target=F.col("target_term")).alias("seq")
    shared = [F.concat(F.lit("p"), "batch").alias(c) for c in ("batch_reference", "verse_reference")]
    top = dominance.candidates(counts, ["batch"]).withColumn("is_primary", F.col("rank") == 1)
    second = top.select(place(learning.DOMINANCE, F.col("rank")), F.lit("dominance").alias("method"), *shared, "source_term", "target_term", F.when(F.col("is_primary"), 5.0).otherwise(4.0).alias("score"), "is_primary")
    won = proper_nouns.events(proper_nouns.resolve(_claims(spark, sf), ["batch"]))
    third = won.select(place(learning.NAMES), F.lit("proper_noun").alias("method"), *shared, "source_term", "target_term", "score", "is_primary")
    return store.cut(first.unionByName(second).unionByName(third))  # reports read events more than once


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    books = _verses(spark, sf).groupBy(F.col("book").cast("string").alias("batch_reference")).agg(F.count("*").alias("verse_count"))
    return books.unionByName(_read(spark, sf, "part").groupBy(F.concat(F.lit("p"), "p_size").alias("batch_reference")).agg(F.count("*").alias("verse_count")))


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    return learned.batch_stats(learned.actions(_events(spark, sf)), _sizes(spark, sf))


@query(f"WITH {EVENTS}, {PAIRS} SELECT * FROM learned")
def learned_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return learned.learned(_events(spark, sf))


@query(f"WITH {EVENTS}, {PAIRS} SELECT source_term, arg_max(target_term, (confidence_score, target_term)) AS best_target FROM learned GROUP BY ALL")
def best_targets(spark: SparkSession, sf: str) -> DataFrame:
    return learned.best_targets(learned.learned(_events(spark, sf)))


@query(f"WITH {EVENTS}, {ACTED} SELECT batch_reference, method, action, count(*) AS n FROM acted GROUP BY ALL")
def learn_actions(spark: SparkSession, sf: str) -> DataFrame:
    return learned.action_counts(learned.actions(_events(spark, sf)))


@query(f"""WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY batch_reference, method ORDER BY seq, source_term, target_term) AS r FROM events WHERE is_primary)
SELECT batch_reference, method, string_agg(source_term || ' → ' || target_term, '; ' ORDER BY r) AS examples FROM r WHERE r <= 20 GROUP BY ALL""")
def learning_examples(spark: SparkSession, sf: str) -> DataFrame:
    return learned.examples(_events(spark, sf))


@query(f"WITH {STATS} SELECT * FROM stats")
def batch_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _stats(spark, sf)


@query(f"""WITH {STATS} SELECT count(*) AS batches, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('verse_count', 'dictionary_learned', 'similarity_learned', 'dominance_learned', 'proper_noun_learned', 'proper_noun_unresolved', 'total_learned'))}, round(sum(total_learned) / sum(verse_count), 6)::DOUBLE AS avg_learned_per_verse FROM stats""")
def global_totals(spark: SparkSession, sf: str) -> DataFrame:
    return learned.global_totals(_stats(spark, sf))


@query(f"WITH {EVENTS}, {ACTED} SELECT coalesce(method, 'all') AS method, coalesce(action, 'all') AS action, count(*) AS n FROM acted GROUP BY ROLLUP (method, action)")
def method_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return learned.method_rollup(learned.actions(_events(spark, sf)))


@query(f"WITH {EVENTS}, {ACTED}, m AS (SELECT method, count(*) AS n FROM acted WHERE action = 'learned' GROUP BY ALL) SELECT method, n, round(100 * n / sum(n) OVER (), 6)::DOUBLE AS percent FROM m")
def method_share(spark: SparkSession, sf: str) -> DataFrame:
    return learned.method_shares(learned.actions(_events(spark, sf)))


CUMULATIVE = ", ".join(f"CAST(sum({c}) OVER (ORDER BY batch_reference ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative_{c}" for c in ("dictionary_learned", "similarity_learned", "dominance_learned", "proper_noun_learned", "total_learned"))


@query(f"WITH {STATS}, c AS (SELECT batch_reference, {CUMULATIVE} FROM stats) SELECT *, CASE WHEN max(cumulative_total_learned) OVER () > 0 THEN CAST(floor(cumulative_total_learned * 120 / max(cumulative_total_learned) OVER ()) AS BIGINT) ELSE 0 END AS bar FROM c")
def learning_curve(spark: SparkSession, sf: str) -> DataFrame:
    return learned.learning_curve(_stats(spark, sf), "batch_reference")


def _by_method(spark: SparkSession, sf: str) -> DataFrame:
    rows = learned.actions(_events(spark, sf)).groupBy("method").agg(F.count("*").alias("events"), F.count_if(F.col("action") == "learned").alias("learned"), F.count_if(F.col("action") == "updated").alias("updated"))
    return learned.metric_pivot(rows, "method", ["dictionary", "dominance", "proper_noun"], ["events", "learned", "updated"])


@query(f"""WITH {EVENTS}, {ACTED}, l AS (SELECT method, 'events' AS metric, 1.0 AS v FROM acted UNION ALL SELECT method, action, 1.0 FROM acted)
SELECT metric, CASE WHEN (SELECT count(*) FROM acted WHERE method = 'dictionary') > 0 THEN round(coalesce(sum(v) FILTER (method = 'dictionary'), 0), 6)::DOUBLE END AS dictionary, CASE WHEN (SELECT count(*) FROM acted WHERE method = 'dominance') > 0 THEN round(coalesce(sum(v) FILTER (method = 'dominance'), 0), 6)::DOUBLE END AS dominance, CASE WHEN (SELECT count(*) FROM acted WHERE method = 'proper_noun') > 0 THEN round(coalesce(sum(v) FILTER (method = 'proper_noun'), 0), 6)::DOUBLE END AS proper_noun, round(sum(v), 6)::DOUBLE AS total FROM l GROUP BY metric""")
def metric_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return _by_method(spark, sf).select("metric", "dictionary", "dominance", "proper_noun", "total")


@query(f"WITH {EVENTS}, {ACTED}, g AS (SELECT count(*) AS total, count(*) FILTER (method = 'dictionary') AS dictionary FROM acted WHERE action = 'learned') SELECT total, dictionary, CASE WHEN dictionary > 0 THEN round(total / dictionary, 6)::DOUBLE END AS gain FROM g")
def learning_gain(spark: SparkSession, sf: str) -> DataFrame:
    return learned.learning_gain(learned.actions(_events(spark, sf)))


@query(f"WITH {EVENTS}, {PAIRS} SELECT * FROM learned")
def history_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The dictionary exported as JSON documents and read again."""
    return store.from_json(store.dictionary_json(learned.learned(_events(spark, sf))))


#: All stages over conversations, some forty a batch; what languages differ in is left open.
_RUN = f"""verses AS (
  SELECT u.conv_id // 40 AS book, CAST(u.conv_id * 4294967296 + u.turn AS BIGINT) AS verse, {STRIP.format('u.text')} AS source_text, {STRIP.format('a.text')} AS target_text
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant' AND length(u.text) > 0 AND length(a.text) > 0),
{{SOURCES}}, tw AS (SELECT book, verse, {WORDS.format('lower(target_text)')} AS w FROM verses),
targets AS (SELECT book, verse, term, count(*) AS times FROM (SELECT book, verse, unnest(w) AS term FROM tw) GROUP BY ALL), {{DICTIONARY}},
held AS (SELECT DISTINCT book, verse, target_term FROM matches WHERE rank = 1),
left_source AS (SELECT book, verse, term FROM (SELECT book, verse, term, count(*) AS n FROM source GROUP BY ALL) s WHERE n > 1 OR NOT EXISTS (SELECT 1 FROM matches m WHERE m.book = s.book AND m.verse = s.verse AND m.source_term = s.term)),
left_target AS (SELECT book, verse, term, times FROM targets t WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.book = t.book AND h.verse = t.verse AND contains(t.term, h.target_term))),
counts AS (SELECT s.book AS batch, s.term AS source_term, t.term AS target_term, CAST(sum(times) AS BIGINT) AS cnt FROM left_source s JOIN left_target t ON t.book = s.book AND t.verse = s.verse GROUP BY ALL),
{CLAIMED.format('counts')},
rest AS (SELECT * FROM counts c WHERE NOT EXISTS (SELECT 1 FROM dominated d WHERE d.batch = c.batch AND d.source_term = c.source_term) AND NOT EXISTS (SELECT 1 FROM dominated d WHERE d.batch = c.batch AND contains(c.target_term, d.target_term))),
{{NAMES}},
placed AS (SELECT r.batch, r.source_term, r.target_term, row_number() OVER (PARTITION BY r.batch, r.target_term ORDER BY r.source_term) AS r FROM {{POOL}} r JOIN names n ON n.batch = r.batch AND n.source_term = r.source_term AND n.n = r.cnt),
events AS (
  {MATCHED}
  UNION ALL
  SELECT {seq_sql('batch', 1, source='source_term', rank='CASE WHEN is_primary THEN 1 ELSE 2 END', target='target_term')}, 'dominance', CAST(batch AS VARCHAR), CAST(batch AS VARCHAR), source_term, target_term, CASE WHEN is_primary THEN 5.0::DOUBLE ELSE 4.0::DOUBLE END, is_primary FROM dominated
  UNION ALL
  SELECT {seq_sql('batch', 2, source='source_term', target='target_term')}, 'proper_noun', CAST(batch AS VARCHAR), CAST(batch AS VARCHAR), source_term, target_term, 3.6::DOUBLE, true FROM placed WHERE r = 1)"""


NAMES = "names AS (SELECT book AS batch, term AS source_term, count(*) AS n FROM source WHERE regexp_matches(term, '^\\p{Lu}') GROUP BY ALL)"


def run_sql(sources: str = SOURCE, entries: str = f"{ENTRIES}, {MATCHES}", names: str = NAMES, pool: str = "rest") -> str:
    """The SQL of a run, up to its events, for the source terms, dictionary, names and counts of a language."""
    return _RUN.replace("{SOURCES}", sources).replace("{DICTIONARY}", entries).replace("{NAMES}", names).replace("{POOL}", pool)


RUN = run_sql()


def _run_verses(spark: SparkSession, sf: str) -> DataFrame:
    return _verses(spark, sf).select(F.floor(F.col("book") / 40).alias("batch"), (F.col("book") * 2**32 + F.col("verse")).alias("verse"), F.col("book").alias("conversation"), "source_text", "target_text").withColumn("book", F.col("batch"))


def _run(spark: SparkSession, sf: str) -> DataFrame:
    return learning.run(_run_verses(spark, sf), _dictionary(spark, sf).withColumn("pinyin", F.col("target")), batch="batch")


@query(f"WITH RECURSIVE {RUN}, {PAIRS} SELECT * FROM learned")
def learning_run(spark: SparkSession, sf: str) -> DataFrame:
    """The learned dictionary of all stages over the aligned conversations, forty of them a batch."""
    return learned.learned(store.cut(_run(spark, sf)))


@query(f"""WITH RECURSIVE {RUN}, {ACTED}, per AS (SELECT batch_reference, count(*) FILTER (method = 'dictionary') AS d, count(*) FILTER (method = 'dominance') AS m, count(*) FILTER (method = 'proper_noun') AS p FROM acted WHERE action = 'learned' GROUP BY ALL),
open AS (SELECT batch, count(*) AS u FROM names n WHERE NOT EXISTS (SELECT 1 FROM placed w WHERE w.r = 1 AND w.batch = n.batch AND w.source_term = n.source_term) GROUP BY batch)
SELECT CAST(book AS VARCHAR) AS batch_reference, count(*) AS verse_count, CAST(coalesce(max(d), 0) AS BIGINT) AS dictionary_learned, 0::BIGINT AS similarity_learned, CAST(coalesce(max(m), 0) AS BIGINT) AS dominance_learned, CAST(coalesce(max(p), 0) AS BIGINT) AS proper_noun_learned, CAST(coalesce(max(u), 0) AS BIGINT) AS proper_noun_unresolved,
  CAST(coalesce(max(d) + max(m) + max(p), 0) AS BIGINT) AS total_learned, round(coalesce(max(d) + max(m) + max(p), 0) / count(*), 6)::DOUBLE AS avg_learned_per_verse
FROM verses LEFT JOIN per ON batch_reference = CAST(book AS VARCHAR) LEFT JOIN open ON batch = book GROUP BY book""")
def learning_summary(spark: SparkSession, sf: str) -> DataFrame:
    """What each batch of that run learned, and the names it left unresolved."""
    return learning.summary(_run_verses(spark, sf), store.cut(_run(spark, sf)))


@query(f"WITH RECURSIVE {RUN} SELECT CAST(n.batch AS VARCHAR) AS batch_reference, n.source_term AS term FROM names n WHERE NOT EXISTS (SELECT 1 FROM placed w WHERE w.r = 1 AND w.batch = n.batch AND w.source_term = n.source_term)")
def unresolved_names(spark: SparkSession, sf: str) -> DataFrame:
    return learning.unresolved(_run_verses(spark, sf), store.cut(_run(spark, sf)))


@query(f"WITH {VERSES}, {SOURCE}, {TARGETS}, {ENTRIES}, {MATCHES}, events AS ({MATCHED}), {PAIRS} SELECT * FROM learned")
def incremental_learning(spark: SparkSession, sf: str) -> DataFrame:
    """The dictionary stage as a stream over several files, one a micro-batch; turns and their answers lie in different files."""
    at, rows = store.folder(spark, "stream"), _read(spark, sf, "conversations")
    rows.repartition(3, "conv_id", "turn").write.parquet(f"{at}/turns")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/turns")
    entries = store.cut(_dictionary(spark, sf))
    events = learn_stream(spark, corpus.conversation_verses(stream), lambda verses: learning.dictionary_events(verses, entries), f"{at}/events", f"{at}/progress")
    return learned.learned(events)


@query(f"""WITH {VERSES}, {SOURCE}, {TARGETS}, {ENTRIES}, {MATCHES}, events AS ({MATCHED}), told AS (SELECT DISTINCT seq, batch_reference, method, source_term FROM events WHERE is_primary)
SELECT source_term, 1::BIGINT AS learned, count(*) - 1 AS updated FROM told GROUP BY source_term""")
def streamed_actions(spark: SparkSession, sf: str) -> DataFrame:
    """What a stream says of each source term as its events come: turns wait for their answers in keyed state, and a flag tells a term's first event from later ones."""
    at, rows = store.folder(spark, "told"), _read(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    rows.repartition(3, "conv_id", "turn").write.parquet(f"{at}/turns")
    entries = store.cut(_dictionary(spark, sf))
    turns = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/turns")
    stateful.drained(stateful.aligned(turns), f"{at}/verses", f"{at}/pairing")
    verses = spark.readStream.schema(stateful.VERSE).parquet(f"{at}/verses")
    learn_stream(spark, verses, lambda v: learning.dictionary_events(v, entries), f"{at}/events", f"{at}/learning")
    events = spark.readStream.schema(f"{store.EVENTS}, micro_batch LONG").parquet(f"{at}/events")
    stateful.drained(stateful.told(events), f"{at}/told", f"{at}/telling")
    acted = spark.read.schema(stateful.ACTION).parquet(f"{at}/told")
    return acted.groupBy("source_term").agg(F.count_if(F.col("action") == "learned").alias("learned"), F.count_if(F.col("action") == "updated").alias("updated"))


# Segmentation

#: A book is a label's vectors of a range of ids, so that books are of bounded size whatever the table's.
BOOK = "CAST(label AS BIGINT) * 1000000000 + vec_id // 2000"
SIMS = f"""books AS (SELECT {BOOK} AS book, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
placed AS (SELECT book, row_number() OVER (PARTITION BY book ORDER BY vec_id) - 1 AS pos, vec_id, e, lead(e) OVER (PARTITION BY book ORDER BY vec_id) AS f FROM books),
sims AS (SELECT book, CAST(pos AS INTEGER) AS pos, vec_id, CASE WHEN f IS NULL THEN NULL ELSE list_cosine_similarity(e, f) END AS sim FROM placed)"""
LIMITS = """m AS (SELECT avg(sim) AS mean, stddev_pop(sim) AS sd FROM sims WHERE sim IS NOT NULL),
limits AS (SELECT mean, sd, greatest(0.0::DOUBLE, mean - 2 * sd) AS major, greatest(greatest(0.0::DOUBLE, mean - 2 * sd) + 0.01::DOUBLE, mean - sd) AS minor FROM m)"""
BREAKS = """walk AS (
  SELECT book, -1 AS i, 0 AS last, false AS brk FROM (SELECT DISTINCT book FROM sims)
  UNION ALL
  SELECT s.book, s.pos, CASE WHEN s.sim < l.minor AND s.pos + 1 - w.last >= 3 THEN s.pos + 1 ELSE w.last END, s.sim < l.minor AND s.pos + 1 - w.last >= 3
  FROM walk w JOIN sims s ON s.book = w.book AND s.pos = w.i + 1 CROSS JOIN limits l WHERE s.sim IS NOT NULL),
sizes AS (SELECT book, CAST(count(*) AS INTEGER) AS verses FROM sims GROUP BY ALL),
cuts AS (SELECT book, 0 AS place FROM sizes UNION SELECT book, i + 1 FROM walk WHERE brk UNION SELECT book, verses FROM sizes)"""
PERICOPES = """pericopes AS (SELECT book, CAST(row_number() OVER (PARTITION BY book ORDER BY place) AS INTEGER) AS pericope, CAST(place AS INTEGER) AS start, CAST(lead(place) OVER (PARTITION BY book ORDER BY place) - 1 AS INTEGER) AS "end", CAST(lead(place) OVER (PARTITION BY book ORDER BY place) - place AS INTEGER) AS verses FROM cuts),
passages AS (SELECT * FROM pericopes WHERE verses IS NOT NULL)"""


def _books(spark: SparkSession, sf: str) -> DataFrame:
    book = F.col("label").cast("long") * 1_000_000_000 + F.floor(F.col("vec_id") / 2000)
    return _read(spark, sf, "embeddings").select(book.alias("book"), "vec_id", "embedding")


def _sims(spark: SparkSession, sf: str) -> DataFrame:
    return segment.consecutive(_books(spark, sf), "book", "vec_id", "embedding")


def _passages(spark: SparkSession, sf: str) -> DataFrame:
    sims = store.cut(_sims(spark, sf))
    return segment.passages(segment.break_places(sims, segment.thresholds(sims)))


@query(f"WITH {SIMS} SELECT book, pos, vec_id, round(sim, 6) AS sim FROM sims WHERE sim IS NOT NULL")
def consecutive_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return _sims(spark, sf).where("sim IS NOT NULL").select("book", "pos", F.col("ord").alias("vec_id"), F.round("sim", 6).alias("sim"))


@query(f"WITH {SIMS}, {LIMITS} SELECT round(mean, 6) AS mean, round(sd, 6) AS sd, round(major, 6) AS major, round(minor, 6) AS minor FROM limits")
def break_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return segment.thresholds(_sims(spark, sf)).select(*[F.round(c, 6).alias(c) for c in ("mean", "sd", "major", "minor")])


@query(f"WITH RECURSIVE {SIMS}, {LIMITS}, {BREAKS} SELECT book, CAST(place AS INTEGER) AS place FROM cuts")
def narrative_breaks(spark: SparkSession, sf: str) -> DataFrame:
    sims = store.cut(_sims(spark, sf))
    return segment.break_places(sims, segment.thresholds(sims))


@query(f'WITH RECURSIVE {SIMS}, {LIMITS}, {BREAKS}, {PERICOPES} SELECT book, pericope, start, "end", verses FROM passages')
def pericopes(spark: SparkSession, sf: str) -> DataFrame:
    return _passages(spark, sf)


@query(f'WITH RECURSIVE {SIMS}, {LIMITS}, {BREAKS}, {PERICOPES} SELECT s.book, s.pos, s.vec_id, p.pericope FROM sims s JOIN passages p ON p.book = s.book AND s.pos BETWEEN p.start AND p."end"')
def verse_passages(spark: SparkSession, sf: str) -> DataFrame:
    return segment.tag_verses(_sims(spark, sf).select("book", "pos", F.col("ord").alias("vec_id")), _passages(spark, sf)).select("book", "pos", "vec_id", "pericope")


PACKED = """rests AS (SELECT book, pericope, verses, coalesce(sum(verses) OVER (PARTITION BY book ORDER BY pericope ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS rest FROM passages),
pack AS (
  SELECT book, 0 AS pericope, 0::BIGINT AS cur, 0 AS n, 1 AS batch, 0 AS verses FROM (SELECT DISTINCT book FROM passages)
  UNION ALL
  SELECT r.book, r.pericope, CASE WHEN p.cur + r.verses > 95 AND p.n > 0 AND r.rest >= 50 THEN r.verses ELSE p.cur + r.verses END, CASE WHEN p.cur + r.verses > 95 AND p.n > 0 AND r.rest >= 50 THEN 1 ELSE p.n + 1 END, CASE WHEN p.cur + r.verses > 95 AND p.n > 0 AND r.rest >= 50 THEN p.batch + 1 ELSE p.batch END, r.verses
  FROM pack p JOIN rests r ON r.book = p.book AND r.pericope = p.pericope + 1)"""


@query(f"WITH RECURSIVE {SIMS}, {LIMITS}, {BREAKS}, {PERICOPES}, {PACKED} SELECT book, pericope, CAST(verses AS INTEGER) AS verses, CAST(batch AS INTEGER) AS batch FROM pack WHERE pericope > 0")
def batch_packing(spark: SparkSession, sf: str) -> DataFrame:
    return segment.pack(_passages(spark, sf))


@query(f"WITH RECURSIVE {SIMS.replace(BOOK, 'label')}, {LIMITS}, {BREAKS}, {PERICOPES}, {PACKED} SELECT p.book, pericope, p.start, p.\"end\", CAST(k.verses AS INTEGER) AS verses, CAST(k.batch AS INTEGER) AS batch FROM pack k JOIN passages p USING (book, pericope)")
def long_books(spark: SparkSession, sf: str) -> DataFrame:
    """Passages and batches where a book is a whole label, so books grow with the table."""
    rows = _read(spark, sf, "embeddings").select(F.col("label").alias("book"), "vec_id", "embedding")
    sims = store.cut(segment.consecutive(rows, "book", "vec_id", "embedding"))
    found = store.cut(segment.passages(segment.break_places(sims, segment.thresholds(sims))))
    return found.join(segment.pack(found).drop("verses"), ["book", "pericope"])


@query(f"SELECT {BOOK} AS book, vec_id, CAST(floor((row_number() OVER (PARTITION BY {BOOK} ORDER BY vec_id) - 1) / 90) + 1 AS INTEGER) AS batch FROM embeddings")
def fixed_batches(spark: SparkSession, sf: str) -> DataFrame:
    return segment.fixed_batches(_books(spark, sf).drop("embedding"), "book", "vec_id")


@query(f"WITH b AS (SELECT DISTINCT {BOOK} AS book, CAST(floor((row_number() OVER (PARTITION BY {BOOK} ORDER BY vec_id) - 1) / 90) + 1 AS INTEGER) AS batch FROM embeddings) SELECT book, batch, CAST(dense_rank() OVER (ORDER BY book, batch) AS INTEGER) AS batch_number FROM b")
def batch_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    return segment.batch_ordinals(fixed_batches(spark, sf))


# Evaluation


@query(f"WITH {VERSES}, n AS (SELECT book, verse, row_number() OVER (PARTITION BY book ORDER BY verse) - 1 AS i, count(*) OVER (PARTITION BY book) AS n FROM verses) SELECT book, verse, CASE WHEN i < floor(n * 0.85) THEN 'train' ELSE 'eval' END AS part FROM n")
def train_eval_split(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.split(_verses(spark, sf).select(*KEYS), ["book"], ["verse"])


@query(f"WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR)) AS r FROM documents) SELECT lang, doc_id, CAST(r AS INTEGER) AS sample_rank FROM r WHERE r <= 15")
def eval_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "documents").select("lang", "doc_id", F.col("doc_id").cast("string").alias("key"))
    return evaluate.sample(rows, ["lang"], "key").drop("key")


def _paired_sql(c: str, quote: str, opening: str, closing: str) -> str:
    return f"array_to_string(list_transform(string_split({c}, '{quote}'), lambda x, i: CASE WHEN i = 1 THEN x WHEN i % 2 = 0 THEN '{opening}' || x ELSE '{closing}' || x END), '')"


@query(f"WITH a AS (SELECT conv_id, turn, {_paired_sql("translate(text, ',.?!:; ', '，。？！：；')", '"', '「', '」')} AS x FROM conversations) SELECT conv_id, turn, {_paired_sql('x', "''", '『', '』')} AS text FROM a")
def punctuation_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "conversations").select("conv_id", "turn", chinese_punctuation(F.col("text")).alias("text"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return _verses(spark, sf).select(*KEYS, words(lowered("target_text")).alias("h"), words(lowered("source_text")).alias("r"))


TOKS = f"toks AS (SELECT book, verse, {WORDS.format('lower(target_text)')} AS hy, {WORDS.format('lower(source_text)')} AS re FROM verses)"
#: Row by row of the table of longest common subsequences; a row is the running maximum of what it can reach.
ROUGE = """lcs AS (
  SELECT book, verse, hy, re, 0::BIGINT AS i, list_transform(hy, lambda x: 0::BIGINT) AS best FROM toks WHERE len(hy) > 0 AND len(re) > 0
  UNION ALL
  SELECT book, verse, hy, re, i, list_transform(range(1, len(hy) + 1), lambda j: list_max(reach[1:j]))
  FROM (SELECT book, verse, hy, re, i + 1 AS i, list_transform(range(1, len(hy) + 1), lambda j: greatest(best[j], CASE WHEN hy[j] = re[i + 1] THEN coalesce(best[j - 1], 0) + 1 ELSE 0 END)) AS reach FROM lcs WHERE i < len(re))),
rouge AS (SELECT book, verse, 2.0::DOUBLE * best[-1] / (len(hy) + len(re)) AS rouge_l FROM lcs WHERE i = len(re)),
rouges AS (SELECT t.book, t.verse, coalesce(r.rouge_l, 0)::DOUBLE AS rouge_l FROM toks t LEFT JOIN rouge r ON r.book = t.book AND r.verse = t.verse)"""
#: The k-th occurrence of a word matches its k-th occurrence on the other side.
METEOR = """hs AS (SELECT book, verse, i, w, row_number() OVER (PARTITION BY book, verse, w ORDER BY i) AS k FROM (SELECT book, verse, unnest(hy) AS w, generate_subscripts(hy, 1) AS i FROM toks)),
rs AS (SELECT book, verse, i, w, row_number() OVER (PARTITION BY book, verse, w ORDER BY i) AS k FROM (SELECT book, verse, unnest(re) AS w, generate_subscripts(re, 1) AS i FROM toks)),
met AS (SELECT h.book, h.verse, h.i, r.i AS m FROM hs h JOIN rs r ON r.book = h.book AND r.verse = h.verse AND r.w = h.w AND r.k = h.k),
runs AS (SELECT *, coalesce(lag(i) OVER o = i - 1 AND lag(m) OVER o = m - 1, false) AS goes_on FROM met WINDOW o AS (PARTITION BY book, verse ORDER BY i)),
chunked AS (SELECT book, verse, count(*)::DOUBLE AS n, count(*) FILTER (NOT goes_on) AS chunks FROM runs GROUP BY ALL),
meteors AS (SELECT t.book, t.verse, coalesce(10 * (n / len(hy)) * (n / len(re)) / (n / len(re) + 9 * (n / len(hy))) * (1 - 0.5 * (chunks / n) ** 3), 0)::DOUBLE AS meteor FROM toks t LEFT JOIN chunked c ON c.book = t.book AND c.verse = t.verse)"""


def _bleu_sql(end: str) -> str:
    grams = " UNION ALL ".join(f"SELECT book, verse, {n} AS n, array_to_string({c}[i:i + {n - 1}], ' ') AS g, {h} AS h, {1 - h} AS r FROM (SELECT book, verse, {c}, unnest(range(1, len({c}) - {n} + 2)) AS i FROM toks)" for c, h in (("hy", 1), ("re", 0)) for n in range(1, 5))
    clips = ", ".join(f"coalesce(sum(least(h, r)) FILTER (n = {n}), 0) AS m{n}" for n in range(1, 5))
    logs = " + ".join(f"ln(CASE WHEN m{n} > 0 THEN m{n} ELSE 0.1::DOUBLE END / greatest(1, hl - {n - 1}))" for n in range(1, 5))
    return f"""WITH RECURSIVE {VERSES}, {TOKS}, {ROUGE}, {METEOR}, grams AS ({grams}), counted AS (SELECT book, verse, n, g, sum(h) AS h, sum(r) AS r FROM grams GROUP BY ALL), clipped AS (SELECT book, verse, {clips} FROM counted GROUP BY ALL),
rows AS (SELECT t.book, t.verse, len(hy) AS hl, len(re) AS rl, coalesce(m1, 0) AS m1, coalesce(m2, 0) AS m2, coalesce(m3, 0) AS m3, coalesce(m4, 0) AS m4 FROM toks t LEFT JOIN clipped c ON c.book = t.book AND c.verse = t.verse),
bleus AS (SELECT book, verse, CASE WHEN m1 = 0 THEN 0.0::DOUBLE ELSE (CASE WHEN hl > rl THEN 1.0::DOUBLE ELSE exp(1 - rl / greatest(1, hl)) END) * exp(({logs}) / 4) END AS bleu FROM rows)
{end}"""


@query(_bleu_sql("SELECT book, verse, round(bleu, 6) AS bleu FROM bleus"))
def sentence_bleu(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.bleu(_scored(spark, sf), KEYS, "h", "r").withColumn("bleu", F.round("bleu", 6))


@query(f"WITH RECURSIVE {VERSES}, {TOKS}, {ROUGE} SELECT book, verse, round(rouge_l, 6) AS rouge_l FROM rouges")
def rouge_l(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select(*KEYS, F.round(metrics.rouge_l("h", "r"), 6).alias("rouge_l"))


@query(f"WITH {VERSES}, {TOKS}, {METEOR} SELECT book, verse, round(meteor, 6) AS meteor FROM meteors")
def meteor(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select(*KEYS, F.round(metrics.meteor("h", "r"), 6).alias("meteor"))


@query(_bleu_sql("""SELECT b.book, count(*) AS verses_evaluated, round(avg(bleu), 6) AS bleu_score, round(avg(rouge_l), 6) AS rouge_score, round(avg(meteor), 6) AS meteor_score
FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY md5(book || '_' || verse), book || '_' || verse) AS place FROM bleus) b JOIN rouges r ON r.book = b.book AND r.verse = b.verse JOIN meteors m ON m.book = b.book AND m.verse = b.verse WHERE place <= 15 GROUP BY b.book"""))
def translation_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Mean scores of each book over a sample of at most 15 verses; 0 where there is none."""
    rows = evaluate.sample(_scored(spark, sf).withColumn("key", F.concat_ws("_", *KEYS)), ["book"], "key").drop("sample_rank", "key")
    scored = rows.select(*KEYS, metrics.rouge_l("h", "r").alias("rouge"), metrics.meteor("h", "r").alias("meteor")).join(metrics.bleu(rows, KEYS, "h", "r"), KEYS)
    return scored.groupBy("book").agg(F.count("*").alias("verses_evaluated"), *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(f"{c}_score") for c in ("bleu", "rouge", "meteor")])


@query(f"""WITH {VERSES}, {SOURCE}, {TARGETS}, {ENTRIES}, {MATCHES}, events AS ({MATCHED}), {PAIRS}, best AS (SELECT source_term, arg_max(target_term, (confidence_score, target_term)) AS t FROM learned GROUP BY ALL)
SELECT v.book, v.verse, coalesce(g, '') AS translation FROM verses v LEFT JOIN (SELECT s.book, s.verse, string_agg(coalesce(t, term), ' ' ORDER BY pos) AS g FROM source s LEFT JOIN best ON source_term = term GROUP BY ALL) x ON x.book = v.book AND x.verse = v.verse""")
def gloss_translation(spark: SparkSession, sf: str) -> DataFrame:
    best = learned.best_targets(learned.learned(learning.dictionary_events(_verses(spark, sf), _dictionary(spark, sf))))
    return evaluate.gloss(_verses(spark, sf), KEYS, "source_text", best)


def _log(spark: SparkSession, sf: str) -> DataFrame:
    training = F.col("event_type").isin("view", "click")
    return _read(spark, sf, "events").select(F.col("user_id").alias("batch"), F.col("event_id").alias("step"), (F.floor((F.dayofmonth("ts") - 1) / 5) + 1).cast("double").alias("epoch"), F.when(training, F.col("value")).alias("train_loss"), F.when(~training, F.col("value")).alias("eval_loss"))


LOG = """log AS (SELECT user_id AS batch, event_id AS step, CAST(floor((day(ts) - 1) / 5) + 1 AS DOUBLE) AS epoch, CASE WHEN event_type IN ('view', 'click') THEN value END AS train_loss, CASE WHEN event_type NOT IN ('view', 'click') THEN value END AS eval_loss FROM events)"""
TRAINING = f"""{LOG}, t AS (SELECT batch, max_by(train_loss, step) FILTER (train_loss IS NOT NULL) AS final_train_loss, min_by(eval_loss, step) FILTER (eval_loss IS NOT NULL) AS initial_eval_loss, max_by(eval_loss, step) FILTER (eval_loss IS NOT NULL) AS final_eval_loss, min(eval_loss) AS best_eval_loss, min_by(coalesce(epoch, 1), (eval_loss, step)) FILTER (eval_loss IS NOT NULL) AS best_epoch, count(DISTINCT coalesce(epoch, 1)) AS epochs, count(*) AS steps FROM log GROUP BY batch)"""


@query(f"WITH {TRAINING} SELECT batch, final_train_loss, initial_eval_loss, final_eval_loss, best_eval_loss, round(initial_eval_loss - best_eval_loss, 6) AS loss_improvement, best_epoch, epochs, best_epoch < epochs AS early_stopped, steps, steps * 1000 AS estimated_tokens FROM t")
def training_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.training_metrics(_log(spark, sf))


DAILY = "daily AS (SELECT event_type AS metric, CAST(day(ts) AS INTEGER) AS batch, avg(value) AS value, CAST(count(*) AS DOUBLE) AS seconds FROM events GROUP BY ALL)"


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "events").groupBy(F.col("event_type").alias("metric"), F.dayofmonth("ts").alias("batch")).agg(F.avg("value").alias("value"), F.count("*").cast("double").alias("seconds"))


@query(f"""WITH {DAILY}, x AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY batch) - 1 AS i FROM daily),
s AS (SELECT metric, regr_slope(value, i) AS slope, count(*) AS points, min(value) AS low, max(value) AS high, avg(value) AS mean, stddev_pop(value) AS sd FROM x GROUP BY metric)
SELECT metric, round(slope, 6) AS slope, points, CASE WHEN slope > 0.001 THEN 'up' WHEN slope < -0.001 THEN 'down' ELSE 'stable' END AS trend, round(low, 6) AS low, round(high, 6) AS high, round(mean, 6) AS mean, round(sd, 6) AS sd, round(CASE WHEN mean <> 0 THEN 100 * sd / mean ELSE 0 END, 6) AS cv_percent FROM s""")
def trend_analysis(spark: SparkSession, sf: str) -> DataFrame:
    daily = _daily(spark, sf)
    rows = evaluate.trends(daily, ["metric"], "batch", "value").join(evaluate.spread(daily, ["metric"], "value"), "metric")
    return rows.select("metric", F.round("slope", 6).alias("slope"), "points", "trend", *[F.round(c, 6).alias(c) for c in ("low", "high", "mean", "sd", "cv_percent")])


@query(f"WITH {DAILY} SELECT metric, round(avg(value), 6) AS with_first, round(avg(value) FILTER (batch <> 1), 6) AS without_first, round(avg(value) FILTER (batch <> 1) - avg(value), 6) AS difference, coalesce(sum(seconds) FILTER (batch <> 1), 0) AS rest_time FROM daily GROUP BY metric")
def baseline_comparison(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluate.against_baseline(_daily(spark, sf), ["metric"], F.col("batch") == 1, "value", "seconds")
    return rows.select("metric", *[F.round(c, 6).alias(c) for c in ("with_first", "without_first", "difference")], "rest_time")


TUNING = f"""{LOG}, tuning AS (SELECT batch, round(avg(train_loss) / 100, 6) AS bleu_score, round(avg(eval_loss) / 100, 6) AS rouge_score, round(min(eval_loss) / 10 - 0.2, 6) AS comet_score, round(max(train_loss) / 1000, 6) AS meteor_score, round(min(train_loss) / 10, 6) AS loss_improvement, CAST(count(*) AS DOUBLE) AS training_time FROM log GROUP BY batch)"""


def _tuning(spark: SparkSession, sf: str) -> DataFrame:
    r = lambda c: F.round(c, 6)
    return _log(spark, sf).groupBy("batch").agg(r(F.avg("train_loss") / 100).alias("bleu_score"), r(F.avg("eval_loss") / 100).alias("rouge_score"), r(F.min("eval_loss") / 10 - 0.2).alias("comet_score"), r(F.max("train_loss") / 1000).alias("meteor_score"), r(F.min("train_loss") / 10).alias("loss_improvement"), F.count("*").cast("double").alias("training_time"))


@query(f"WITH {TUNING} SELECT batch, CAST(least(100, trunc(round(least(bleu_score * 100, 40) + least(rouge_score * 100, 25) + least(comet_score * 100, 25) + least(loss_improvement * 50, 10), 9))) AS INTEGER) AS quality FROM tuning WHERE bleu_score IS NOT NULL AND rouge_score IS NOT NULL")
def quality_score(spark: SparkSession, sf: str) -> DataFrame:
    rows = _tuning(spark, sf).where("bleu_score IS NOT NULL AND rouge_score IS NOT NULL")
    return rows.select("batch", evaluate.quality_score(*map(F.col, ("bleu_score", "rouge_score", "comet_score", "loss_improvement"))).alias("quality"))


@query(f"WITH {TUNING}, v AS (SELECT batch, CASE WHEN comet_score > 0 THEN comet_score ELSE rouge_score END AS value FROM tuning) SELECT batch, value FROM v WHERE value IS NOT NULL ORDER BY value DESC, batch LIMIT 1")
def best_batch(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.best_batch(_tuning(spark, sf))


@query(f"WITH {TUNING} SELECT count(*) AS batches, round(avg(bleu_score), 6) AS avg_bleu_score, round(avg(rouge_score), 6) AS avg_rouge_score, round(avg(meteor_score), 6) AS avg_meteor_score, round(avg(loss_improvement), 6) AS avg_loss_improvement, round(avg(comet_score) FILTER (comet_score > 0), 6) AS avg_comet_score, sum(training_time) AS total_time, max(rouge_score) AS peak_rouge FROM tuning")
def tuning_summary(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.tuning_averages(_tuning(spark, sf))


@query("WITH p AS (SELECT page_id, string_split(url, '/')[3] AS host, url FROM pages) SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY url DESC, page_id DESC) <= 2 AS keep FROM p")
def retention_policy(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "pages").select("page_id", F.try_element_at(F.split("url", "/"), F.lit(3)).alias("host"), "url", F.struct("url", "page_id").alias("name"))
    return evaluate.keep_newest(rows, "host", "name").select("page_id", "host", "keep")


@query("SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-31' - INTERVAL 7 DAYS")
def expired_logs(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.expired(_read(spark, sf, "events"), "ts", F.expr("TIMESTAMP '2024-01-31'")).select("event_id")


LANGUAGE = "CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' ELSE 'Other' END"


@query(f"WITH l AS (SELECT {LANGUAGE} AS language FROM documents UNION ALL SELECT unnest(['Hebrew', 'Klingon'])) SELECT language, CASE language WHEN 'English' THEN 'en_XX' WHEN 'German' THEN 'de_DE' WHEN 'French' THEN 'fr_XX' WHEN 'Spanish' THEN 'es_XX' WHEN 'Hebrew' THEN 'he_IL' ELSE 'en_XX' END AS mbart, CASE language WHEN 'English' THEN 'en' WHEN 'German' THEN 'de' WHEN 'French' THEN 'fr' WHEN 'Spanish' THEN 'es' WHEN 'Hebrew' THEN 'hbo' END AS stanza, count(*) AS n FROM l GROUP BY ALL")
def language_codes(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "documents").select(F.expr(LANGUAGE).alias("language")).unionByName(spark.createDataFrame([("Hebrew",), ("Klingon",)], "language string"))
    counted = rows.groupBy("language").agg(F.count("*").alias("n"))
    return counted.select("language", mbart_code(F.col("language")).alias("mbart"), stanza_code(F.col("language")).alias("stanza"), "n")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

