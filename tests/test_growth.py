"""Steps whose work must grow with the input: the same results as plain versions, and what is shuffled."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lexiforge.functions import metrics
from lexiforge.functions import similarity as alike
from lexiforge.functions.text import char_ngrams, chinese_words
from lexiforge.operators import dictionary, dominance, lattice, learned, proper_nouns, similarity
from lexiforge.plans import learning
from lexiforge.sources import store

ENTRY = "term string, target string, pinyin string, ord long"
KEYS = ["book", "verse"]


def shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def counted(source, targets):
    pairs = source.withColumnRenamed("term", "source_term").join(targets.withColumnRenamed("term", "target_term"), KEYS)
    return pairs.groupBy("book", "source_term", "target_term").agg(F.sum("times").alias("cnt"))


@pytest.fixture(scope="module")
def verses_of_terms(spark):
    r = random.Random(7)
    source, targets = [], []
    for book in range(12):
        for verse in range(14):
            source += [(book, verse, s) for s in r.sample([f"S{i}" for i in range(9)], r.randint(1, 6))]
            targets += [(book, verse, t, r.choice([1, 1, 1, 2, 5])) for t in r.sample([f"t{i}" for i in range(4 + 2 * book)], r.randint(0, 4))]
    return spark.createDataFrame(source, "book long, verse long, term string").cache(), spark.createDataFrame(targets, "book long, verse long, term string, times long").cache()


def test_dominance_in_verses_is_that_of_all_counts(verses_of_terms):
    source, targets = verses_of_terms
    want = dominance.learn(counted(source, targets), "book")
    got = dominance.learn_in_verses(source, targets, KEYS, "book")
    assert got.count() > 20 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_dominance_in_verses_where_all_targets_are_contested(spark):
    source = spark.createDataFrame([(1, v, s) for v in range(5) for s in ("a", "b")], "book long, verse long, term string")
    targets = spark.createDataFrame([(1, v, t, 1) for v in range(5) for t in ("x", "y") if t == "x" or v < 4], "book long, verse long, term string, times long")
    want = dominance.learn(counted(source, targets), "book").collect()
    assert dominance.learn_in_verses(source, targets, KEYS, "book").collect() == want != []


@pytest.mark.parametrize("chinese", [False, True])
def test_names_in_verses_are_those_of_all_counts(spark, verses_of_terms, chinese):
    source, targets = verses_of_terms
    if chinese:
        targets = targets.withColumn("term", F.translate("term", "t0123456789", "神山水天地光大小中国火")).withColumn("times", F.lit(1).cast("long"))
    names = spark.createDataFrame([(b, f"S{i}", n) for b in range(12) for i, n in enumerate([1, 1, 1, 2, 3, 2, 5, 1, 4])], "book long, term string, occurrences long")
    want = proper_nouns.scored(proper_nouns.equal_counts(names, counted(source, targets), ["book"]).withColumn("sound", F.lower("source_term")).withColumn("target_sound", F.col("target_term")), "English", chinese)
    totals = targets.groupBy("book", "term").agg(F.sum("times").alias("total"))
    found = proper_nouns.equal_counts_in_verses(names, source, targets.join(totals, ["book", "term"]), KEYS, "book", chinese)
    got = proper_nouns.scored(found.withColumn("sound", F.lower("source_term")).withColumn("target_sound", F.col("target_term")), "English", chinese)
    cols = ["book", "source_term", "target_term", "similarity"]
    won = [sorted(tuple(r) for r in proper_nouns.resolve(x.select(cols), ["book"]).collect()) for x in (want, got)]
    assert won[0] == won[1] and (chinese or len(won[0]) > 20)
    if chinese:
        assert sorted(tuple(r) for r in want.select(cols).collect()) == sorted(tuple(r) for r in got.select(cols).collect()) != []


@pytest.mark.parametrize("language", ["English", "Hebrew", "Greek"])
def test_a_run_does_not_shuffle_all_pairs_of_a_long_verse(spark, language):
    letter = {"English": "q", "Hebrew": "א", "Greek": "α"}[language]
    texts = [" ".join(f"{x}{i:04d}z" for i in range(1500)) for x in (letter, "w")]
    verses = spark.createDataFrame([(1, 1, "1_1", *texts)], "book int, verse int, verse_reference string, source_text string, target_text string")
    before = shuffled(spark)
    assert learning.run(verses, spark.createDataFrame([], ENTRY), learning.Languages(source=language)).count() == 0
    assert shuffled(spark) - before < 2_000_000  # 2.25 million pairs


def test_bleu_shuffles_nothing_and_counts_repeats(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a", "b"], ["a", "b", "a", "c"]), (2, [], ["a"]), (3, ["x"], [])], "k int, h array<string>, r array<string>")
    assert metrics.clipped(["a", "b", "a", "b"], ["a", "b", "a", "c"], 4) == [3, 2, 1, 0]
    found = metrics.bleu(rows, ["k"], "h", "r")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r["k"]: r["bleu"] for r in found.collect()}
    assert got[1] == pytest.approx((3 / 4 * 2 / 3 * 1 / 2 * 0.1) ** 0.25) and got[2] == got[3] == 0.0


def test_a_small_dictionary_goes_to_the_edges_of_a_lattice(spark):
    runs = spark.createDataFrame([("".join(chr(0x4E00 + (i * i + j) % 900) for i in range(2000)),) for j in range(40)], "run string")
    before = shuffled(spark)
    assert lattice.cut_runs(runs, spark.createDataFrame([("一丁", 3)], "word string, n long")).count() == 40
    assert shuffled(spark) - before < 2_000_000  # 640,000 edges


def test_probes_of_words_are_made_after_the_words_are_dealt(spark):
    known = spark.createDataFrame([(1, "abcd", "abcd"), (1, None, "x"), (1, "y", None)], "verse int, translation string, sound string")
    targets = spark.createDataFrame([(1, "abce", "abce"), (2, "abcd", "abcd")], "verse int, target_term string, target_sound string")
    found = similarity.candidates(known, targets, ["verse"]).distinct()
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # of the words; not even distinct pairs need another
    assert [tuple(r) for r in found.collect()] == [(1, "abcd", "abcd", "abce", "abce")]


def test_pairs_of_a_verse_are_compared_where_it_lies(spark):
    alike_words = [f"abcdefgh{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    entries = spark.createDataFrame([("run", w, w, i) for i, w in enumerate(alike_words)], ENTRY)
    source = spark.createDataFrame([(1, 1, "run"), (1, 1, "Run")], "book int, verse int, term string")
    targets = spark.createDataFrame([(1, 1, w + "x", w + "x") for w in alike_words], "book int, verse int, term string, pinyin string")
    before = shuffled(spark)
    found = similarity.matches(source, targets, entries, KEYS).collect()
    assert len(found) == 800 and all(r["target_term"] == r["translation"] + "x" for r in found)
    assert shuffled(spark) - before < 250_000  # of 160,000 pairs that pass, which were shuffled and sorted


def test_ngrams_of_a_long_text_take_time_in_proportion(spark):
    text = "".join("神天地光水人山大小中国王子"[(i * i + i // 7) % 13] for i in range(200_000))
    start = time.time()
    got = spark.createDataFrame([(text,)], "t string").repartition(1).select(F.size(char_ngrams(F.col("t"))).alias("n"), F.size(chinese_words(F.col("t"))).alias("w")).first()
    assert got["n"] == 4 * len(text) - 6 and got["w"] == len({text[i : i + k] for k in range(1, 5) for i in range(len(text) - k + 1)})
    assert time.time() - start < 60  # each substring was sought from the text's start


def test_ngrams_are_those_of_slices_in_order(spark):
    rows = ["", None, "a", "12", "1\n", "是天", "天又山", "\U0001f600天\U0001f600\U0001f600地x", "ab cd，天地就在", "的的", "１２天", '"天"', "天地人天地人"]
    for r in spark.createDataFrame([(x,) for x in rows], "t string").select("t", char_ngrams(F.col("t")).alias("g"), chinese_words(F.col("t")).alias("w")).collect():
        t = r["t"] or ""
        grams = [t[i : i + k] for i in range(len(t)) for k in range(1, 5) if i + k <= len(t)]
        assert r["g"] == grams
        bad = lambda g: set(g) & set("，。：；！？「」（）、\"…—·的了是在就也都") or g[0] in "是就的了又" or g[-1] in "是就的了又" or g.rstrip("\n").isdecimal()
        assert r["w"] == [g for g in dict.fromkeys(grams) if not bad(g)]


def test_masks_keep_all_pairs_that_may_pass_and_few_others(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdéfgh神天地光水人") for _ in range(r.randint(0, 6)))
    rows = [(word(), word(), word(), word()) for _ in range(5000)] + [(w, w, w + "x", w[:-1]) for w in (word() for _ in range(500))]
    c = F.col
    pairs = spark.createDataFrame(rows, "w string, s string, t string, u string").withColumn("sn", alike.numbered(c("s"))).withColumn("un", alike.numbered(c("u")))
    bits = [alike.bits(x) for x in (c("un"), c("sn"), alike.places(c("t")), alike.places(c("w")))]
    got = pairs.select(alike.might_pass(c("t"), c("w"), *bits, F.size("un"), F.size("sn")).alias("might"), alike.may_pass(c("t"), c("w"), c("un"), c("sn")).alias("may"))
    n = got.agg(F.count_if("may").alias("may"), F.count_if(c("may") & ~c("might")).alias("lost"), F.count_if("might").alias("might")).first()
    assert n["may"] > 100 and n["lost"] == 0 and n["might"] < 1500


def test_translations_do_not_travel_to_verses(spark):
    entries = spark.createDataFrame([(f"s{i}", f"t{j}", "", i) for i in range(10) for j in range(2000)], ENTRY)
    source = spark.createDataFrame([(v, p, f"S{p}") for v in range(300) for p in range(10)], "verse int, pos int, term string")
    targets = spark.createDataFrame([(v, f"t{v}") for v in range(300)], "verse int, term string")
    before = shuffled(spark)
    found = dictionary.matches(source, targets, entries, ["verse"])
    assert found.count() == 3000 and shuffled(spark) - before < 1_000_000  # 6 million translations


def test_matches_of_words_that_share_a_place(spark):
    entries = spark.createDataFrame([("a", "xx", "", 1), ("to a", "xxx", "", 2), ("to a", "xx", "", 3), ("b", "yyyy", "", 4), ("to ", "z", "", 5)], ENTRY)
    source = spark.createDataFrame([(1, 0, "A"), (1, 0, "A"), (1, 0, "b"), (1, 1, None), (2, 0, "a")], "verse int, pos int, term string")
    targets = spark.createDataFrame([(1, t) for t in ("xx", "xxx", "yyyy", "yyyy", None)], "verse int, term string")
    got = dictionary.matches(source, targets, entries, ["verse"]).orderBy("rank").collect()
    assert [tuple(r)[:5] for r in got] == [(1, 0, "b", "yyyy", 1), (1, 0, "A", "xxx", 2), (1, 0, "A", "xx", 3)]


def test_pairs_are_counted_where_their_batch_lies(spark):
    source = spark.createDataFrame([(b, v, f"s{i}") for b in range(3) for v in range(4) for i in range(250)], "book long, verse long, term string")
    targets = spark.createDataFrame([(b, v, f"t{i}", 1) for b in range(3) for v in range(4) for i in range(250)], "book long, verse long, term string, times long")
    before = shuffled(spark)
    assert dominance.strong_counts(source, targets, KEYS, "book").count() == 3 * 250 * 250
    assert shuffled(spark) - before < 500_000  # 750,000 pairs


def test_a_large_batch_is_counted_in_parts(spark, verses_of_terms, monkeypatch):
    source, targets = verses_of_terms
    monkeypatch.setattr(dominance, "PAIRS", 20)
    got = dominance.strong_counts(source, targets, KEYS, "book")
    want = counted(source, targets).where(F.col("cnt") >= dominance.LEAST)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect())) != []


def largest(rows):
    """The most rows that one task holds."""
    return rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]


def test_matches_of_many_verses_are_dealt_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(store, "ROWS", 100, raising=False)
    source = spark.range(4000).select((F.col("id") % 1000).alias("verse"), F.col("id").alias("pos"), F.lit("A").alias("term"))
    targets = spark.range(1000).select(F.col("id").alias("verse"), F.lit("b").alias("term"))
    found = dictionary.matches(source, targets, spark.createDataFrame([("a", "b", "", 1)], ENTRY), ["verse"])
    assert found.count() == 4000 and largest(found) < 400  # as two words and their target take part in a row each


def test_batches_come_in_the_order_of_their_first_events_dealt_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(store, "ROWS", 100, raising=False)
    verses = spark.range(900).select((F.col("id") % 90).alias("book"), F.col("id").alias("verse"), F.lit("alpha x alpha").alias("source_text"), F.lit("gamma").alias("target_text"))
    events = learning.dictionary_events(verses, spark.createDataFrame([("alpha", "gamma", "", 1)], ENTRY))
    assert largest(events) < 300
    assert [r[0] for r in store.batches_processed(events).collect()] == [str(b) for b in range(90)]


def test_a_task_reads_few_rows_of_a_table_that_one_task_has_cut(spark, monkeypatch):
    monkeypatch.setattr(store, "FILE_ROWS", 100, raising=False)
    rows = spark.range(40_000).coalesce(1).select("id", F.lit("the").alias("term"))
    got = store.cut(rows)
    assert largest(got) <= 32 * 100 and got.exceptAll(rows).isEmpty() and got.count() == 40_000


def test_batches_are_the_same_from_small_files_and_more_parts_than_are_written_without_a_buffer(spark, monkeypatch):
    monkeypatch.setattr(store, "FILE_ROWS", 50, raising=False)
    monkeypatch.setattr(store, "ROWS", 10)
    verses = spark.range(900).select((F.col("id") % 90).alias("book"), F.col("id").alias("verse"), F.lit("alpha x alpha").alias("source_text"), F.lit("gamma").alias("target_text"))
    events = learning.dictionary_events(verses, spark.createDataFrame([("alpha", "gamma", "", 1)], ENTRY))
    assert events.count() == 1800 and largest(events) < 60  # 270 parts
    assert [r[0] for r in store.batches_processed(events).collect()] == [str(b) for b in range(90)]


def test_residuals_are_those_of_plain_sets_dealt_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(store, "ROWS", 100, raising=False)
    r = random.Random(11)
    source = [(v, p, r.choice(["A", "a", "B", "c", "d", None])) for v in range(600) for p in range(r.randint(0, 6))]
    events = [(v, p, s, r.choice(["x", "xy"]), r.random() < 0.5) for v, p, s in source if s and r.random() < 0.4] + [(v, 0, "absent", "z", True) for v in range(0, 600, 7)]
    targets = [(v, t) for v in range(600) for t in r.sample(["x", "axb", "xy", "axyb", "y", "w"], r.randint(0, 6))]
    table = spark.createDataFrame(source, "verse int, pos int, term string")
    found = spark.createDataFrame(events, "verse int, src_pos int, source_term string, target_term string, is_primary boolean")
    times = {}
    for v, _, s in source:
        times[v, s] = times.get((v, s), 0) + 1
    used = {(v, s) for v, _, s, _, _ in events}
    left = dictionary.residual_sources(table, found, ["verse"])
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(str(k) for k, n in times.items() if n > 1 or k not in used)
    held = {}
    for v, _, _, t, primary in events:
        if primary:
            held.setdefault(v, set()).add(t)
    rest = dictionary.residual_targets(spark.createDataFrame(targets, "verse int, term string"), found.where("is_primary"), ["verse"])
    assert sorted(map(tuple, rest.collect())) == sorted((v, t) for v, t in targets if not any(h in t for h in held.get(v, ())))
    assert largest(left) < 300 and largest(rest) < 300


def test_first_events_of_terms_are_found_in_their_first_books(spark, monkeypatch):
    monkeypatch.setattr(store, "ROWS", 100, raising=False)
    r = random.Random(4)
    made = [((r.randint(1, 60), r.choice([0, 1]), r.randint(0, 9), 0, i, None, 1, "t"), "dictionary", f"b{i % 7}", "v", f"s{r.randint(0, 40)}", "t", 1.0, r.random() < 0.7) for i in range(2000)]
    events = spark.createDataFrame(made + made[:50], store.EVENTS)
    first = {}
    for e in made:
        first[e[4]] = min(first.get(e[4], (99,)), e[0][:5])
    got = learned.actions(events)
    want = sorted((e[0][4], e[2], e[4], "learned" if first[e[4]] == e[0][:5] else "updated") for e in made if e[7])
    assert sorted(map(tuple, got.select("seq.pos", "batch_reference", "source_term", "action").collect())) == want
    assert largest(got) < 400
    plan = learned.firsts(events)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan[plan.index("SortAggregate") :]  # what is sorted has been met with first books before


def test_actions_of_events_in_any_order_column(spark):
    rows = [(i, "m", "b", "v", s, "t", 1.0, p) for i, (s, p) in enumerate([("a", False), ("a", True), ("b", True), ("b", True)])]
    got = learned.actions(spark.createDataFrame(rows, store.EVENTS.replace(store.SEQ, "LONG")))
    assert sorted((x["seq"], x["action"]) for x in got.collect()) == [(1, "updated"), (2, "learned"), (3, "updated")]
