import difflib
import os
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexiforge.operators import cooccurrence, dictionary, dominance, evaluate, lattice, learned, lemma_rules, proper_nouns, running, scan, segment, similarity
from lexiforge.operators.tokens import lemmas
from lexiforge.plans import learning
from lexiforge.sources import corpus, counts, dictionaries, store
from lexiforge.streaming import stateful
from lexiforge.streaming.incremental import learn_stream

V = ["verse"]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_dictionary_lines(spark):
    lines = spark.createDataFrame([(0, "賽特 赛特 [Sai4 te4] /Seth (name)/"), (1, "神 神 [shen2] /God (deity), spirit/unusual/3rd/"), (2, "# x"), (3, ""), (4, "bad")], "n long, value string")
    assert rows(dictionaries.parse_entries(lines, "n"), "term", "target", "pinyin") == [("god", "神", "shen2"), ("seth", "赛特", "Sai4 te4"), ("unusual", "神", "shen2")]
    assert dictionaries.read_dictionary(spark, "/nowhere", "German", "Chinese").isEmpty()
    assert dictionaries.read_pivot(spark, "/nowhere") is None


def test_cooccurrence(spark):
    df = spark.createDataFrame([(1, ["God", "create", "God"], ["神", "创造"]), (2, ["God", "create", "God"], ["deus", "deus"])], "verse int, s array<string>, t array<string>")
    got = cooccurrence.verse_counts(df, V, "s", "t")
    assert rows(got, "verse", "source_term", "target_term", "cnt") == [(1, "God", "创造", 1), (1, "God", "神", 1), (1, "create", "创造", 1), (1, "create", "神", 1), (2, "God", "deus", 2), (2, "create", "deus", 2)]


def test_dictionary_and_residual(spark):
    source = spark.createDataFrame([(1, 0, "God"), (1, 1, "create"), (1, 2, "God")], "verse int, pos int, term string")
    targets = spark.createDataFrame([(1, t) for t in ("神", "上帝", "创造", "创造物", "地")], "verse int, term string")
    entries = spark.createDataFrame([("god", "神"), ("god", "上帝"), ("to create", "创造")], "term string, target string")
    found = dictionary.matches(source, targets, entries, V).cache()
    assert rows(found, "src_pos", "target_term", "is_primary", "score") == [(0, "上帝", True, 1.0), (0, "神", False, 0.2), (1, "创造", True, 1.0), (2, "上帝", True, 1.0), (2, "神", False, 0.2)]
    assert rows(dictionary.residual_sources(source, found, V), "term") == [("God",)]
    left = dictionary.residual_targets(targets, found.where("is_primary"), V)
    assert rows(left, "term") == [("地",), ("神",)]
    assert "NestedLoop" not in left._jdf.queryExecution().executedPlan().toString()
    events = found.select((F.col("src_pos") * 10 + F.col("rank")).alias("seq"), F.lit("dictionary").alias("method"), F.lit("b").alias("batch_reference"), F.lit("1_1").alias("verse_reference"), "source_term", "target_term", "score", "is_primary")
    got = learned.learned(events)
    assert rows(got, "source_term", "target_term", "confidence_score", "is_primary") == [("God", "上帝", 2.0, True), ("God", "神", 0.4, False), ("create", "创造", 1.0, True)]
    assert rows(learned.actions(events), "source_term", "action") == [("God", "learned"), ("God", "updated"), ("create", "learned")]
    assert rows(store.from_json(store.dictionary_json(got)), *got.columns) == rows(got, *got.columns)


def test_learned_is_order_free(spark):
    rng = random.Random(2)
    made = [(i, "m", "b", f"v{i}", rng.choice("abc"), rng.choice("xyz"), rng.choice([0.2, 1.0]), rng.random() < 0.5) for i in range(200)]
    schema = "seq long, method string, batch_reference string, verse_reference string, source_term string, target_term string, score double, is_primary boolean"
    a = learned.learned(spark.createDataFrame(made, schema))
    rng.shuffle(made)
    b = learned.learned(spark.createDataFrame(made, schema).repartition(7))
    assert rows(a, *a.columns) == rows(b, *a.columns)


def test_dominance(spark):
    counts = [("h", "天堂", 4), ("h", "天堂门", 4), ("h", "地", 3)]
    assert dominance.claim(counts) == [("h", "天堂门", 4, True), ("h", "天堂", 4, False)]
    assert dominance.claim([("h", "天堂", 3), ("h", "海", 1)]) == []
    assert dominance.claim([("h", "天堂", 4)]) == []
    assert dominance.claim(counts + [("i", "天堂", 5), ("i", "海", 1)]) == dominance.claim(counts)
    df = spark.createDataFrame([(1, *c) for c in counts], "batch int, source_term string, target_term string, cnt long")
    assert rows(dominance.learn(df, "batch"), "target_term", "score") == [("天堂", 4.0), ("天堂门", 5.0)]
    assert rows(dominance.candidates(df, ["batch"]), "target_term", "rank") == [("天堂", 2), ("天堂门", 1)]


def test_deciding_pairs_decide_alike(spark):
    rng = random.Random(11)
    made = sorted({(b, f"s{rng.randint(0, 6)}", f"t{rng.randint(0, 9)}"): rng.randint(1, 6) for b in range(30) for _ in range(rng.randint(2, 25))}.items())
    counts = spark.createDataFrame([(*k, c) for k, c in made], "batch int, source_term string, target_term string, cnt long")
    want = sorted((b, *x) for b in range(30) for x in dominance.claim([(s, t, c) for (own, s, t), c in made if own == b]))
    assert rows(dominance.learn(counts, "batch"), "batch", "source_term", "target_term", "cnt", "is_primary") == want
    assert dominance.deciding(counts, "batch").count() < counts.count()


def test_conflicts(spark):
    claims = spark.createDataFrame([(1, "A", "x", 0.9), (1, "B", "x", 0.8), (1, "A", "y", 0.7), (1, "B", "z", 0.6), (1, "C", "x", 0.58), (1, "C", "w", 0.52)], "batch int, source_term string, target_term string, similarity double")
    won = proper_nouns.resolve(claims, ["batch"]).cache()
    assert rows(won, "source_term", "target_term") == [("A", "x"), ("A", "y"), ("B", "z")]
    assert rows(proper_nouns.reattribute(claims, won, "batch"), "source_term", "target_term") == [("C", "w")]
    assert won.groupBy("batch", "target_term").count().where("count > 1").isEmpty()


def test_segments(spark):
    sims = [0.9, 0.1, 0.8, 0.7, 0.2, 0.9, 0.85, 0.1, 0.9, None]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(sims)] + [(2, 0, None)], "book int, pos int, sim double")
    limits = segment.thresholds(df).first()
    assert (round(limits["mean"], 6), round(limits["sd"], 6), limits["major"], round(limits["minor"], 6)) == (0.605556, 0.340298, 0.0, 0.265258)
    found = segment.breaks(df, segment.thresholds(df))
    assert {r["book"]: r["breaks"] for r in found.collect()} == {1: [0, 5, 8, 10], 2: [0, 1]}
    assert rows(segment.pericopes(segment.merged(found)), "book", "start", "end", "verses") == [(1, 0, 4, 5), (1, 5, 7, 3), (1, 8, 9, 2), (2, 0, 0, 1)]
    short = spark.createDataFrame([(1, 10, [0, 2, 5, 6, 10])], "book int, verses int, breaks array<int>")
    assert segment.merged(short).first()["breaks"] == [0, 6, 10]


def _packed(sizes):
    batches, cur = [], []
    for i, p in enumerate(sizes):
        if sum(cur) + p > 95 and cur and sum(sizes[i + 1 :]) >= 50:
            batches.append(cur)
            cur = []
        cur.append(p)
    return [*batches, cur]


def test_packing(spark):
    rng = random.Random(6)
    books = {1: [60, 30, 20, 40, 15], 2: [60, 30, 20, 29], **{b: [rng.randint(1, 70) for _ in range(rng.randint(1, 15))] for b in range(3, 20)}}
    df = spark.createDataFrame([(b, i + 1, s) for b, x in books.items() for i, s in enumerate(x)], "book int, pericope int, verses int")
    got = {}
    for r in segment.pack(df).orderBy("book", "pericope").collect():
        got.setdefault(r["book"], {}).setdefault(r["batch"], []).append(r["verses"])
    assert {b: list(x.values()) for b, x in got.items()} == {b: _packed(x) for b, x in books.items()}
    assert _packed(books[1]) == [[60, 30], [20, 40, 15]] and len(_packed(books[2])) == 1


def test_similarity_pairs_lose_none_that_passes(spark):
    rng = random.Random(12)
    make = lambda pool, most: "".join(rng.choice(pool) for _ in range(rng.randint(0, most)))
    left = sorted({(make("abz神子", 6), make("abcEz ", 8)) for _ in range(250)} | {("ab", ""), ("abc", "")})
    right = sorted({(make("abz神子", 6), make("abcEz ", 8)) for _ in range(250)} | {("ab", ""), ("abd", "")})
    want = set()
    for u, b in left:
        for t, a in right:
            n, m = len(t), len(u)
            same = sum(x == y for x, y in zip(t, u, strict=True)) / n if n == m and n else 0.0
            even = 1 - 0.5 * abs(n - m) / max(n, m, 1) if n and m else 0.0
            score = 0.4 * same + 0.4 * difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio() + 0.2 * even
            if n >= 2 and score > (0.7 if n == 2 else 0.5) + 1e-9:
                want.add((u, b, t, a))
    known = spark.createDataFrame([(1, *x) for x in left], "verse int, translation string, sound string")
    found = similarity.candidates(known, spark.createDataFrame([(1, *x) for x in right], "verse int, target_term string, target_sound string"), V)
    got = {tuple(r) for r in found.select("translation", "sound", "target_term", "target_sound").collect()}
    assert len(want) > 500 and want <= got and len(got) < len(left) * len(right) / 2
    assert similarity.candidates(known.withColumn("sound", F.lit(None).cast("string")), found.select("verse", "target_term", "target_sound"), V).where("sound IS NOT NULL").isEmpty()


def test_scans_over_long_books(spark, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", 4)  # several levels of blocks
    rng = random.Random(9)
    books = {b: [rng.choice([0.0, 0.2, 0.8, None]) if rng.random() < 0.9 else 0.1 for _ in range(n)] for b, n in ((None, 21), (1, 1), (2, 3), (3, 16), (4, 17), (5, 150), (6, 400))}
    sims = spark.createDataFrame([(b, i, None if i == len(x) - 1 else x[i]) for b, x in books.items() for i in range(len(x))], "book int, pos int, sim double")
    limits = spark.createDataFrame([(0.5,)], "minor double")
    want = set()
    for b, x in books.items():
        places = [0]
        for i, v in enumerate(x[:-1]):
            if v is not None and v < 0.5 and i + 1 - places[-1] >= 3:
                places.append(i + 1)
        want |= {(b, p) for p in [*places, len(x)]}
    places = segment.break_places(sims, limits).cache()
    assert {tuple(r) for r in places.select("book", "place").collect()} == want and places.count() == len(want)
    # Merging, against the fold along one row, also where places lie closer than passages may be.
    merged = segment.merged_places(places.where("book IS NOT NULL"))
    assert rows(merged, "book", "place") == sorted(x for x in want if x[0] is not None)
    loose = {b: sorted({0, *rng.sample(range(1, 10 * b), min(10 * b - 1, 5 * b))}) for b in range(1, 40)}
    arrays = spark.createDataFrame([(b, x[-1], x) for b, x in loose.items()], "book int, verses int, breaks array<int>")
    plain = {(r["book"], p) for r in segment.merged(arrays).collect() for p in r["breaks"]}
    flat = spark.createDataFrame([(b, p) for b, x in loose.items() for p in x], "book int, place int")
    assert {tuple(r) for r in segment.merged_places(flat).collect()} == plain
    assert rows(segment.passages(flat), "book", "pericope", "start", "end", "verses") == sorted((b, i + 1, x[i], x[i + 1] - 1, x[i + 1] - x[i]) for b, x in loose.items() for i in range(len(x) - 1))
    # Packing books of many passages, some larger than a batch.
    sizes = {b: [rng.choice([1, 7, 30, 60, 96, 120]) for _ in range(n)] for b, n in ((1, 1), (2, 5), (3, 64), (4, 300))}
    df = spark.createDataFrame([(b, i + 1, s) for b, x in sizes.items() for i, s in enumerate(x)], "book int, pericope int, verses int")
    got = {}
    for r in segment.pack(df).orderBy("book", "pericope").collect():
        got.setdefault(r["book"], {}).setdefault(r["batch"], []).append(r["verses"])
    assert {b: list(x.values()) for b, x in got.items()} == {b: _packed(x) for b, x in sizes.items()}
    assert segment.pack(df.where("false")).isEmpty() and segment.break_places(sims.where("false"), limits).isEmpty()


def test_places_across_ranges(spark):
    rng = random.Random(4)
    table = [(b, i, rng.choice([None, rng.randint(0, 9)])) for b in (None, 1, 2, 3) for i in rng.sample(range(10_000), 400 if b == 2 else 7)]
    df = spark.createDataFrame(table, "book int, at int, v int").repartition(7)
    want = []
    for b in (None, 1, 2, 3):
        own = sorted((i, v) for g, i, v in table if g == b)
        want += [(b, i, v, k, own[k + 1][1] if k + 1 < len(own) else None, sum(x or 0 for _, x in own[: k + 1])) for k, (i, v) in enumerate(own)]
    got = scan.placed(df, "book", "at", ["v"], ["v"]).select("book", "at", "v", "pos", "next_v", "sum_v").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_fixed_batches_and_split(spark):
    df = spark.range(200).withColumn("book", F.lit(1))
    assert [r["count"] for r in segment.fixed_batches(df, "book", "id").groupBy("batch").count().orderBy("batch").collect()] == [90, 90, 20]
    assert [r["count"] for r in evaluate.split(df.where("id < 7"), ["book"], ["id"]).groupBy("part").count().orderBy("part").collect()] == [2, 5]


def test_training_metrics(spark):
    log = spark.createDataFrame([(1, 1, 1.0, None, 2.0), (1, 2, 2.0, None, 1.5), (1, 3, 3.0, None, 1.7)], "batch int, step int, epoch double, train_loss double, eval_loss double")
    r = evaluate.training_metrics(log).first()
    assert (r["initial_eval_loss"], r["final_eval_loss"], r["best_eval_loss"], r["loss_improvement"], r["best_epoch"], r["epochs"], r["early_stopped"], r["steps"], r["estimated_tokens"]) == (2.0, 1.7, 1.5, 0.5, 2.0, 3, True, 3, 3000)


def test_quality(spark):
    x = [F.lit(v) for v in (0.3, 0.4, 0.1, 0.1)]
    assert spark.range(1).select(evaluate.quality_score(*x).alias("q")).first()["q"] == 70


def test_hebrew(spark):
    pivot = spark.createDataFrame([(None, None, ["V"], ["abcd", "abc"], None, None, None, True), (None, None, ["V"], ["abcde"], None, None, None, True), (None, None, ["V"], ["a"], None, None, None, False)], dictionaries.PIVOT)
    assert rows(dictionaries.hebrew_pure_forms(pivot), "vocalized", "pure") == [("V", "abc")]


def test_xml(spark, tmp_path):
    for name, t in (("a", "In the  beginning"), ("b", "起 初")):
        (tmp_path / f"{name}.xml").write_text(f'<bible><book number="1"><chapter number="1"><verse number="1">{t}</verse><verse number="2"> </verse></chapter></book><book number="2"><chapter number="1"><verse number="1">x</verse></chapter></book></bible>')
    a, b = (corpus.read_verses(spark, str(tmp_path / f"{n}.xml"), "1") for n in "ab")
    got = corpus.align(a, b, "Chinese")
    assert ("1_1_1", "In the  beginning", "起初") in rows(got, "verse_reference", "source_text", "target_text")


def test_lemmas(spark):
    found = spark.createDataFrame([("Gods", 0), ("ran", 1), ("Paul", 2), ("of", 3), ("Unknown", 4)], "term string, pos int")
    lexicon = spark.createDataFrame([("Gods", "god", "NOUN"), ("ran", "run", "VERB"), ("Paul", "Paul", "PROPN"), ("of", "of", "ADP")], "surface string, lemma string, upos string")
    assert rows(lemmas(found, lexicon), "pos", "term") == [(0, "god"), (1, "run"), (2, "Paul"), (4, "unknown")]


def turns(n):
    """Conversations whose words the dictionary below knows, as (conv_id, turn, role, text)."""
    return [(c, t, "user" if t % 2 == 0 else "assistant", f"alpha beta word{c}" if t % 2 == 0 else f"gamma delta{t % 3} end") for c in range(n) for t in range(8)]


def entries(spark):
    return spark.createDataFrame([("alpha", "gamma", 1), ("beta", "delta1", 2), ("beta", "delta0", 3)], "term string, target string, ord long")


@pytest.mark.parametrize("files", [1, 5])
def test_stream_equals_one_batch(spark, tmp_path, files):
    rows = spark.createDataFrame(turns(6), "conv_id long, turn long, role string, text string")
    want = learned.learned(learning.dictionary_events(corpus.conversation_verses(rows), entries(spark)))
    # Turns are dealt over files one by one, so a turn and its answer lie apart.
    parts = [[x for i, x in enumerate(turns(6)) if i % files == f] for f in range(files)]
    at = {name: str(tmp_path / name) for name in ("in", "out", "progress")}
    learn = lambda v: learning.dictionary_events(v, entries(spark))

    def go():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{at['in']}/*")
        return learn_stream(spark, corpus.conversation_verses(stream), learn, at["out"], at["progress"])

    for i, part in enumerate(parts):
        spark.createDataFrame(part, rows.schema).coalesce(1).write.parquet(f"{at['in']}/{i}")
        if i == files // 2:
            go()  # a stop and a restart in the middle
    got = learned.learned(go())
    assert rows_of(got) == rows_of(want) and want.count() == 3
    # A micro-batch that runs again replaces its own events.
    events = store.restore_events(spark, at["out"])
    before = events.count()
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out").glob("micro_batch=*"))
    again = spark.read.schema(store.EVENTS).parquet(f"{at['out']}/micro_batch={last}").collect()
    store.append_events(spark.createDataFrame(again, store.EVENTS), at["out"], last)
    assert store.restore_events(spark, at["out"]).count() == before
    assert store.restore_events(spark, str(tmp_path / "none")) is None


def rows_of(df):
    return rows(df, *df.columns)


def test_events_keep_their_order_in_long_verses(spark):
    verses = spark.createDataFrame([(10**12, 10**11, "x " * 120_000 + "alpha alpha", "gamma")], "book long, verse long, source_text string, target_text string")
    events = learning.dictionary_events(verses, spark.createDataFrame([("alpha", "gamma", 1)], "term string, target string, ord long"))
    assert rows(learned.actions(events), "action") == [("learned",), ("updated",)]
    assert rows(events.select("seq.book", "seq.verse", "seq.pos"), "book", "verse", "pos") == [(10**12, 10**11, 120_000), (10**12, 10**11, 120_001)]


def test_holding(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab") for _ in range(rng.randint(1, n)))
    targets = spark.createDataFrame(sorted({(b, word(9)) for b in (1, 2) for _ in range(60)}), "book int, term string")
    retained = spark.createDataFrame(sorted({(b, word(5)) for b in (1, 2) for _ in range(3)}), "book int, target_term string")
    held = dictionary.holding(targets, retained, ["book"])
    assert rows(targets.join(held, ["book", "term"], "left_anti"), "book", "term") == rows(dictionary.residual_targets(targets, retained, ["book"]), "book", "term")


def test_of_equal_similarities_the_words_own_entry_wins(spark):
    source = spark.createDataFrame([(1, "run")], "verse int, term string")
    targets = spark.createDataFrame([(1, "abcd", "abcd")], "verse int, term string, pinyin string")
    known = spark.createDataFrame([("to run", "abcx", "abcx", 1), ("run", "abcy", "abcy", 2)], "term string, target string, pinyin string, ord long")
    assert rows(similarity.matches(source, targets, known, V), "translation") == [("abcy",)]


def test_similarity_against_all_pairs(spark):
    import difflib

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(2, 5)))
    own, listed = [word() for _ in range(12)], sorted({word() for _ in range(25)})
    known = spark.createDataFrame([(f"s{i % 4}", t, t, i) for i, t in enumerate(own)], "term string, target string, pinyin string, ord long")
    got = similarity.matches(spark.createDataFrame([(1, f"s{i}") for i in range(4)], "verse int, term string"), spark.createDataFrame([(1, t, t) for t in listed], "verse int, term string, pinyin string"), known, V)

    def score(t, d):
        same = sum(x == y for x, y in zip(t, d, strict=False)) / len(t) if len(t) == len(d) else 0
        return 0.4 * same + 0.4 * difflib.SequenceMatcher(None, t, d).ratio() + 0.2 * (1 - 0.5 * abs(len(t) - len(d)) / max(len(t), len(d)))

    want = []
    for s in range(4):
        for t in listed:
            best = None
            for i, d in enumerate(own):
                x = score(t, d)
                if i % 4 == s and x > (0.7 if len(t) == 2 else 0.5) and x != 1.0 and (best is None or x > best[0] + 1e-12):
                    best = (x, d)
            if best:
                want.append((f"s{s}", t, best[1], round(best[0], 9)))
    assert rows(got.withColumn("similarity", F.round("similarity", 9)), "source_term", "target_term", "translation", "similarity") == sorted(want)


def test_gloss_keeps_verses_without_words(spark):
    verses = spark.createDataFrame([(1, "a b"), (2, " .. "), (3, None)], "verse int, text string")
    got = evaluate.gloss(verses, V, "text", spark.createDataFrame([("a", "x")], "source_term string, best_target string"))
    assert rows(got, "verse", "translation") == [(1, "x b"), (2, ""), (3, "")]


def test_chinese_run_learns(spark):
    verses = spark.createDataFrame([(1, i, "God made light", "神造光明") for i in range(3)], "book long, verse long, source_text string, target_text string")
    known = spark.createDataFrame([("god", "神", "shen2", 1), ("light", "光", "guang1", 2)], "term string, target string, pinyin string, ord long")
    got = learned.learned(learning.run(verses, known, learning.Languages(target="Chinese")))
    assert {("God", "神", 3.0), ("light", "光", 3.0)} <= set(rows(got, "source_term", "target_term", "confidence_score"))


def test_ancient_terms_reach_the_dictionary(spark):
    verses = spark.createDataFrame([(1, 1, "θεός Μωυσῆς", "神 摩西")], "book long, verse long, source_text string, target_text string")
    known = spark.createDataFrame([("god", "神", "shen2", 1), ("moses", "摩西", "mo2 xi1", 2)], "term string, target string, pinyin string, ord long")
    pivot = spark.createDataFrame([("θεός", "God"), ("Μωυσῆς", "Moses")], "form string, english string")
    got = learning.run(verses, known, learning.Languages(source="Greek", pivot=pivot))
    assert rows(got.where("method = 'dictionary'"), "source_term", "target_term") == [("Μωυσῆς", "摩西"), ("θεός", "神")]


def test_running_sums(spark):
    made = [(i * 7 % 101, i % 5) for i in range(101)]
    got = running.running_sums(spark.createDataFrame(made, "k int, n long").repartition(6), "k", {"n": "upto"})
    total, want = 0, []
    for k, n in sorted(made):
        total += n
        want.append((k, total))
    assert rows(got, "k", "upto") == want


def test_chained_models():
    assert evaluate.chained([1, 2, 3], lambda model, batch: ((model or 0) + batch, {"batch": batch})) == (6, [{"batch": 1}, {"batch": 2}, {"batch": 3}])


def test_state_is_restored(spark, tmp_path):
    assert store.restore_state(spark, str(tmp_path / "none")) == (None, None, None)


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        store.folder(Session(), "x")


VERSE = "book long, verse long, source_text string, target_text string"
ENTRY = "term string, target string, pinyin string, ord long"


def _events(events, method):
    return sorted((r["source_term"], r["target_term"], r["score"]) for r in events.where(f"method = '{method}'").collect())


def test_a_run_counts_targets_as_often_as_they_occur(spark):
    verses = spark.createDataFrame([(1, i, "God create", "deus deus creavit") for i in range(4)], VERSE)
    events = learning.run(verses, spark.createDataFrame([], ENTRY))
    assert _events(events, "dominance") == [("God", "deus", 5.0)]


def test_a_run_finds_hebrew_names(spark):
    pivot = spark.createDataFrame([(["אַבְרָהָם"], ["אברהמה", "אברהם"], ["abraham"], True), (["דָּבָר"], ["דבר"], ["word"], False)], "hebrew array<string>, hebrew_pure array<string>, english array<string>, proper_name boolean")
    languages = learning.Languages(source="Hebrew", pivot=dictionaries.pivot_forms(pivot, "Hebrew"), vocalised=dictionaries.hebrew_pure_forms(pivot))
    for name in ("אַבְרָהָם", "אברהם"):
        verses = spark.createDataFrame([(1, i, f"{name} דָּבָר", f"abraham w{i}") for i in range(5)], VERSE)
        events = learning.run(verses, spark.createDataFrame([], ENTRY), languages).cache()
        # The one target that occurs as often as the name; dominance, which goes first, needs no second one.
        assert ("אברהם", "abraham") in [x[:2] for x in _events(events, "proper_noun")]
        assert [tuple(r) for r in learning.candidates(verses, languages).collect()] == [(1, "אברהם", 5)]
        assert learning.unresolved(verses, events, languages).count() == 0
    nobody = spark.createDataFrame([(1, 1, "אַבְרָהָם", "a b")], VERSE)
    assert [r["term"] for r in learning.unresolved(nobody, events.limit(0), languages).collect()] == ["אברהם"]


def test_marked_and_bare_forms(spark):
    forms = spark.createDataFrame([("שָׁלוֹם", "שלום"), ("שלום", "שלם")], "vocalized string, pure string")
    got = {r["form"]: r["pure"] for r in dictionaries.name_forms(forms).collect()}
    assert got == {"שָׁלוֹם": "שלום", "שלום": "שלם"}  # a form's own entry goes before what others are without marks


def test_a_run_finds_greek_names_by_the_lexicon(spark):
    lexicon = spark.createDataFrame([("Ἀβραάμ", "Ἀβραάμ", "PROPN"), ("Λόγος", "λόγος", "NOUN"), ("ἐγώ", "ἐγώ", "PRON")], "surface string, lemma string, upos string")
    languages = learning.Languages(source="Greek", lexicon=lexicon)
    verses = spark.createDataFrame([(1, 1, "Ἀβραάμ Λόγος ἐγώ", "abraham"), (1, 2, "Ἀβραάμ", "abraham")], VERSE)
    assert [tuple(r) for r in learning.candidates(verses, languages).collect()] == [(1, "Ἀβραάμ", 2)]
    assert sorted(r["term"] for r in learning.source_tokens(verses, languages).collect()) == ["λόγος", "Ἀβραάμ", "Ἀβραάμ"]


def test_a_run_finds_chinese_names_by_the_lexicon(spark):
    lexicon = spark.createDataFrame([("亚伯", "亚伯", "PROPN"), ("地方", "地方", "NOUN")], "surface string, lemma string, upos string")
    languages = learning.Languages(source="Chinese", lexicon=lexicon)
    verses = spark.createDataFrame([(1, 1, "亚伯地方亚伯", "abel place")], VERSE)
    assert [tuple(r) for r in learning.candidates(verses, languages).collect()] == [(1, "亚伯", 2)]
    assert {"亚伯", "地方"} <= {r["term"] for r in learning.source_tokens(verses, languages).collect()}


def test_target_lemmas(spark):
    lexicon = spark.createDataFrame([("walks", "walk", "VERB"), ("walked", "walk", "VERB"), ("the", "the", "DET")], "surface string, lemma string, upos string")
    verses = spark.createDataFrame([(1, 1, "x", "the walks walked quickly")], VERSE)
    got = learning.target_terms(verses, learning.Languages(target_lexicon=lexicon)).collect()
    assert sorted((r["term"], r["times"]) for r in got) == [("quickly", 1), ("walk", 2)]


def test_pivots_find_verbs_and_own_entries(spark):
    source = spark.createDataFrame([("הלך",), ("אב",), ("none",)], "term string")
    forms = spark.createDataFrame([("הלך", "walk"), ("הלך", "go")], "form string, english string")
    entries = spark.createDataFrame([("to walk", "走", "zou3", 1), ("go", "去", "qu4", 2), ("to go", "走", "zou2", 0), ("אב", "父", "fu4", 3)], ENTRY)
    got = {(r["term"], r["target"], r["pinyin"], r["ord"]) for r in learning.through_pivot(source, entries, forms).collect()}
    assert {("הלך", "走", "zou2", 0), ("הלך", "去", "qu4", 2), ("אב", "父", "fu4", 3)} <= got
    assert {r["target"] for r in dictionaries.pivot_lookup(source, forms, entries).collect()} == {"走", "去"}


def test_executors_get_the_source(tmp_path):
    """A caller's own tables, another working folder, and no PYTHONPATH: what runs in workers comes from the package itself."""
    script = tmp_path / "own.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from pyspark.sql import SparkSession
from lexiforge.functions import metrics, similarity
from lexiforge.operators import evaluate
from lexiforge.plans import learning
from lexiforge.streaming import stateful
from lexiforge.streaming.incremental import learn_stream
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for n, method in ((2, "proper_noun"), (5, "dominance")):
    verses = spark.createDataFrame([(1, i, "God create Adam", "deus deus creavit adam") for i in range(n)], {VERSE!r})
    events = learning.run(verses, spark.createDataFrame([], {ENTRY!r})).collect()
    assert method in {{e["method"] for e in events}}, events
two = spark.createDataFrame([("tide", "diet", ["a", "b"], ["a", "c"])], "a string, b string, h array<string>, r array<string>")
row = two.select(similarity.sequence_ratio("a", "b"), similarity.name_score("a", "b", "a"), metrics.rouge_l("h", "r"), metrics.meteor("h", "r")).first()
assert abs(row[0] - 0.25) < 1e-9 and abs(row[2] - 0.5) < 1e-9
assert evaluate.plugged(two, ["a"], ["b"], lambda b: [x[::-1] for x in b], "t", "string").first()["t"] == "teid"
verses.write.parquet("in")
stream = spark.readStream.schema(verses.schema).parquet("in")
learn = lambda rows: learning.run(rows, spark.createDataFrame([], {ENTRY!r}))
assert learn_stream(spark, stream, learn, "events", "progress").count() == len(events)
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]


def test_lattice_paths_against_all_paths():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(0, 9)
        edges = [(e, k, rng.randint(1, 30)) for e in range(1, n + 1) for k in range(1, e + 1) if rng.random() < 0.4]
        cost = {(e, k): c for e, k, c in edges}

        def paths(left, cost=cost):
            if not left:
                yield 0, []
            for k in range(1, left + 1):
                if (left, k) in cost or k == 1:
                    for c, own in paths(left - k):
                        yield c + cost.get((left, k), 20), [*own, k]

        got = lattice.likeliest(n, edges, 20)
        assert sum(got) == n
        ends = [sum(got[: i + 1]) for i in range(len(got))]
        assert sum(cost.get((e, k), 20) for e, k in zip(ends, got, strict=True)) == min(c for c, _ in paths(n))


def test_chinese_words(spark):
    known = spark.createDataFrame([("北京", 50), ("大学", 40), ("北京大学", 30), ("生", 5), ("大学生", 20), ("活", 1), ("bad", 0)], "word string, n long")
    texts = spark.createDataFrame([(1, "北京大学生活，ABC 12大学", None), (2, "", "  "), (3, None, "京"), (4, "北京" * 30_000, "大学" * 3)], "id long, a string, b string")
    got = {r["id"]: (r["a"], r["b"]) for r in lattice.segmented(texts, ["id"], ["a", "b"], known).collect()}
    assert got[1] == (["北京", "大学生", "活", "，", "ABC", "12", "大学"], [])  # 3,060 against 4,956 for the two words of the other cut
    assert got[2] == ([], []) and got[3] == ([], ["京"]) and got[4] == (["北京"] * 30_000, ["大学"] * 3)
    assert lattice.segmented(texts.limit(0), ["id"], ["a", "b"], known).isEmpty()
    assert lattice.segmented(texts.where("id = 3"), ["id"], ["b"], known.limit(0)).first()["b"] == ["京"]


def test_guessed_lemmas_of_held_out_words(spark):
    rng = random.Random(7)
    ends = [("ing", "", "VERB"), ("ies", "y", "NOUN"), ("ed", "", "VERB"), ("ly", "", "ADV"), ("", "", "NOUN")]
    stems = {"".join(rng.choice("bcdfgklmnprt") + rng.choice("aeou") for _ in range(rng.randint(2, 3))) + rng.choice("bdgkmnpt") for _ in range(400)}
    rows = [(s + e, s + i, u) for s in sorted(stems) for e, i, u in ends]
    learnt, held = rows[::2], rows[1::2]
    lexicon = spark.createDataFrame(learnt, "surface string, lemma string, upos string")
    words = spark.createDataFrame([(w,) for w, _, _ in held] + [("",), (None,), ("x" * 5000,)], "surface string")
    got = {r["surface"]: (r["lemma"], r["upos"]) for r in lemma_rules.guessed(words, lemma_rules.induced(lexicon)).collect()}
    assert sum(got.get(w) == (x, u) for w, x, u in held) / len(held) > 0.97
    whole = lemma_rules.extended(lexicon, words)
    assert whole.groupBy("surface").count().where("count > 1").isEmpty() and whole.where("surface IS NULL OR surface = ''").isEmpty()
    assert lemma_rules.guessed(words, lemma_rules.induced(lexicon.limit(0))).isEmpty()


def test_state_of_turns_ends_with_their_answers(spark, tmp_path):
    listed = [*turns(8), (90, 0, "user", "  "), (91, 1, "assistant", "alone"), (92, 0, "system", "x"), (93, 0, "user", None)]
    rows = spark.createDataFrame(listed, "conv_id long, turn long, role string, text string")
    at = {name: str(tmp_path / name) for name in ("in", "out", "progress")}
    held = []
    for part in range(4):  # a stop and a restart after each file; a turn's answer is in the next one
        spark.createDataFrame([x for x in listed if (x[0] + x[1]) % 4 == part], rows.schema).coalesce(1).write.parquet(f"{at['in']}/{part}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{at['in']}/*")
        held += stateful.state_rows(stateful.drained(stateful.aligned(stream), at["out"], at["progress"]))
    got = spark.read.schema(stateful.VERSE).parquet(at["out"])
    want = corpus.conversation_verses(rows).select("book", "verse", "source_text", "target_text")
    assert rows_of(got) == rows_of(want)
    assert len(held) == 4 and held[-1] == 2  # only the two whose other sides never came still wait


def test_terms_are_told_as_they_come(spark, tmp_path):
    rows = spark.createDataFrame(turns(6), "conv_id long, turn long, role string, text string")
    events = learning.dictionary_events(corpus.conversation_verses(rows), entries(spark)).cache()
    at = {name: str(tmp_path / name) for name in ("in", "out", "progress")}
    for part in (0, 1):
        events.where((F.col("seq.book") >= 3) == bool(part)).write.parquet(f"{at['in']}/{part}")
        stream = spark.readStream.schema(store.EVENTS).parquet(f"{at['in']}/*")
        progress = stateful.drained(stateful.told(stream), at["out"], at["progress"])
    got = spark.read.schema(stateful.ACTION).parquet(at["out"])
    want = learned.actions(events)
    count = lambda df: rows_of(df.groupBy("source_term", "batch_reference", "action").count())
    assert count(got) == count(want)
    assert stateful.state_rows(progress) == [2]  # a flag for each of the two terms


def test_counts_grow_by_deltas(spark, tmp_path):
    at = str(tmp_path / "counts")
    own = lambda *rows: spark.createDataFrame(list(rows), counts.COUNTS)
    assert counts.restored(spark, at).isEmpty() and counts.compacted(spark, at) == 0
    counts.append_delta(own(("b", "s", "t", 2), ("b", "s", "t", 1), ("c", "s", None, 1)), at, 1)
    counts.append_delta(own(("b", "s", "u", 5)), at, 2)
    counts.append_delta(own(("b", "s", "u", 4)), at, 2)  # again
    assert set(map(tuple, counts.restored(spark, at).collect())) == {("b", "s", "t", 3), ("c", "s", None, 1), ("b", "s", "u", 4)}
    assert counts.compacted(spark, at) == 2 and counts.compacted(spark, at) == 2
    assert not list((tmp_path / "counts" / "deltas").glob("number=*"))
    with pytest.raises(ValueError):
        counts.append_delta(own(("b", "s", "u", 4)), at, 2)
    counts.append_delta(own(("b", "s", "t", 10)), at, 3)
    whole = counts.restored(spark, at)
    assert set(map(tuple, whole.collect())) == {("b", "s", "t", 13), ("c", "s", None, 1), ("b", "s", "u", 4)}
    files = {f.split("/counts/")[1].split("/part")[0] for f in whole.inputFiles()}
    assert files == {"snapshots/2", "deltas/number=3"}  # what the snapshot holds isn't read again
    assert counts.compacted(spark, at) == 3 and set(map(tuple, counts.restored(spark, at).collect())) == {("b", "s", "t", 13), ("c", "s", None, 1), ("b", "s", "u", 4)}
    assert [p.name for p in (tmp_path / "counts" / "snapshots").iterdir()] == ["3"]
