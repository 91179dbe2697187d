"""Spelling variants: words one edit apart, found by merging the light subtrees of the vocabulary's trie, and the forms they go back to.

A trie's node is a prefix. At each branching node the child with most words below goes on with the heavy path; the others
are light, and a word passes light edges at most as often as the logarithm of the vocabulary says. Two words one edit
apart part at one node, and at least one of them goes on there by a light edge (or ends). So only light subtrees move, the
small ones into the large: below the node they are merged with one character replaced or skipped, or with the heavy
child's put in before them, and words whose ends coincide with another's after that are near. Light words that coincide
with each other, after the character where they part is left open, are near too. Each near pair meets exactly once.

In Spark the trie is a table of edges (node, next character, words below), its nodes known by a hash of the prefix; a
collision only makes two nodes choose one heavy child, which changes the work and not the result. Merging is equality of
keys: a moved word's new spelling with the words themselves, or with one character open. Nodes near the root, through
which most words pass, are few and dealt over many tasks. Long words stand in edges by two hashes, not whole.

Defined cases: a null or empty text has no words; a null doc_id counts as no digits; rows that share a doc_id each count;
words may be of any length; ties go to the first word in code-point order; an empty table gives no rows; columns other
than doc_id and text aren't read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import mixed
from .work import dealt, pick, removed, shared_dir, ship, tidied, written

#: Code points that a word has at least; how many times as often as a word its form occurs.
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: A run whose checksum this number divides loses a code point.
LOSES = 31
#: Characters whose edges are made at a time; nodes through which so many words pass that they are dealt.
BLOCK_CHARS, HOT_NODES, HOT_LEAST = 1 << 18, 20_000, 500
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 2**64)


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: what runs of letters come to, at least ``LEAST_LENGTH`` code points long and ``LEAST_COUNT`` times in all."""
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    runs = pick(docs, doc_id="string", text="string").select(F.coalesce("doc_id", F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(f"[a-z\\u00C0-\\u00FF]{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % LOSES == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def prefixes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word and place from 0 to its length: the word's place in the list, the place, the prefix's node, the next character's code (0 at the end)."""
    size = np.array([len(w) for w in words], np.int64) + 1
    code = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le"), np.uint32).astype(np.int64)
    one, zero = np.ones(1, np.uint64), np.zeros(1, np.uint64)
    power = lambda base: np.multiply.accumulate(np.concatenate([one, np.full(len(code) - 1, base, np.uint64)]))
    begin = np.repeat(np.cumsum(size) - size, size)
    place = np.arange(len(code)) - begin
    sums = np.concatenate([zero, np.cumsum(mixed(code.astype(np.uint64) + np.uint64(1)) * power(_BASE))])
    node = mixed((sums[:-1] - sums[begin]) * power(_INVERSE)[begin] + place.astype(np.uint64))
    return np.repeat(np.arange(len(words)), size), place, node.view(np.int64), code


def _blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    """A column's words in blocks of bounded size, and where each block begins."""
    words, length, at = [], 0, 0
    for i in range(batch.num_rows):
        words.append(batch.column(column)[i].as_py())
        length += len(words[-1]) + 1
        if length >= BLOCK_CHARS or i + 1 == batch.num_rows:
            yield at, words
            words, length, at = [], 0, i + 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, next character and words below it, of each block of words."""
    for batch in batches:
        for _, words in _blocks(batch, 0):
            _, _, node, code = prefixes(words)
            order = np.lexsort((code, node))
            node, code = node[order], code[order]
            first = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (code[1:] != code[:-1])]))
            yield pa.RecordBatch.from_arrays([pa.array(node[first]), pa.array(code[first]), pa.array(np.diff(np.append(first, len(node))))], names=["node", "code", "below"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word's edges: its two hashes, the place, the node, the next character."""
    for batch in batches:
        for at, words in _blocks(batch, 2):
            of, place, node, code = prefixes(words)
            own = [batch.column(i).slice(at, len(words)).to_numpy()[of] for i in (0, 1)]
            for a in range(0, len(of), BLOCK_CHARS):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + BLOCK_CHARS]) for x in (*own, place, node, code)], names=["one", "two", "place", "node", "code"])


def light_edges(words: DataFrame, out: str) -> DataFrame:
    """word, n, place, heavy: each light edge that a word passes, with the heavy child's character at its node."""
    counts = words.select("word").mapInArrow(tidied(_counted), "node long, code long, below long").groupBy("node", "code").agg(F.sum("below").alias("below"))
    # Of children alike the last character is heavy; a word's end, code 0, never is.
    nodes = counts.groupBy("node").agg(F.max(F.struct("below", "code")).alias("top"), F.sum("below").alias("words"), F.count("*").alias("children"))
    nodes = written(nodes.where("children > 1").select("node", F.col("top.code").alias("heavy"), "words"), f"{out}/nodes")
    # Every place of a word passes one node, so not more than HOT_NODES nodes can have so many.
    places = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    hot = nodes.where(F.col("words") > max(HOT_LEAST, -(-places // HOT_NODES)))
    named = words.select(F.xxhash64("word").alias("one"), F.xxhash64(F.lit(1), "word").alias("two"), "word", "n")
    edges = named.select("one", "two", "word").mapInArrow(tidied(_edges), "one long, two long, place long, node long, code long")
    light = dealt(edges, nodes.drop("words"), hot, "node", "two").where("code <> heavy").select("one", "two", "place", "heavy")
    return light.join(named, ["one", "two"]).select("word", "n", F.col("place").cast("int").alias("place"), F.chr("heavy").alias("heavy"))


def merged(words: DataFrame, out: str) -> DataFrame:
    """word, n_near, best (neg, near): how many near words a word has, and the commonest of them with its count below zero."""
    light = written(light_edges(words, out), f"{out}/light")
    before, own, rest = F.substring("word", F.lit(1), F.col("place")), F.substring("word", F.col("place") + 1, F.lit(1)), F.substring("word", F.col("place") + 2, F.length("word"))
    parts = light.select("word", "n", "heavy", before.alias("p"), own.alias("c"), rest.alias("s"))
    ends = F.col("c") == ""
    # Of a run of one character only the last is skipped, as words part behind the run.
    moved = F.array(F.concat("p", "heavy", "c", "s"), F.when(~ends, F.concat("p", "heavy", "s")), F.when(~ends & ~F.startswith("s", "c"), F.concat("p", "s")))
    probes = parts.select("word", "n", F.explode(moved).alias("near")).where("near IS NOT NULL")
    met = probes.join(words.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    sides = F.explode(F.array(F.struct("word", F.struct((-F.col("m")).alias("neg"), "near").alias("best")), F.struct(F.col("near").alias("word"), F.struct((-F.col("n")).alias("neg"), F.col("word").alias("near")).alias("best"))))
    heavy = met.select(sides.alias("x")).select("x.word", F.lit(1).cast("long").alias("k"), "x.best")
    # Light children of a node: as many at most as there are characters.
    open_ = parts.where(~ends).groupBy(F.concat("p", F.lit("?"), "s").alias("key")).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), F.col("word").alias("near")))).alias("all")).where(F.size("all") > 1)
    each = open_.select("all", F.explode("all").alias("x"))
    alike = each.select(F.col("x.near").alias("word"), (F.size("all") - 1).cast("long").alias("k"), F.when(F.col("all")[0] == F.col("x"), F.col("all")[1]).otherwise(F.col("all")[0]).alias("best"))
    return heavy.unionByName(alike).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, out: str) -> DataFrame:
    """word, root of each word that has a form (``forms``: word, form). A form is ``TIMES`` as common, so chains are short, and each round doubles the steps taken."""
    spark = forms.sparkSession
    now, i = written(forms.select("word", F.col("form").alias("root")), f"{out}/roots-0"), 0
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if now.join(ahead.select("root"), "root", "left_semi").isEmpty():
            return now
        i += 1
        now = written(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), f"{out}/roots-{i}")
        removed(spark, f"{out}/roots-{i - 1}")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of the vocabulary."""
    spark = docs.sparkSession
    ship(spark)
    out = shared_dir(spark)
    words = written(vocabulary(docs), f"{out}/words")
    near = words.join(merged(words, out), "word", "left")
    best = F.when(-F.col("best.neg") >= TIMES * F.col("n"), F.col("best"))
    near = written(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), best["near"].alias("form"), (-best["neg"]).alias("form_n")), f"{out}/near")
    root = roots(near.where("form IS NOT NULL").select("word", "form"), out)
    removed(spark, f"{out}/light", f"{out}/nodes", f"{out}/words")
    return near.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
