"""Near duplicates by min-max hashing: exact Jaccard links on word shingles and their connected components.

A text's set is its distinct k-word shingles. Under each permutation both the smallest and the largest hash are kept, so
``perms`` evaluations give ``2 * perms`` values; bands of ``rows`` values make candidates, and each candidate link is
confirmed on the full sets. Texts of one set are folded into one representative first, so copies cost no pairs.

Within a band's bucket the members are compared with the bucket's smallest member, not with each other. Only buckets
that still hold members of different components afterwards are looked at again, first around the member that shares most
shingles with others, then pair by pair between different components, in blocks; there, the shingles that a text shares
with any other bound its similarity to all. So every candidate link is either confirmed or refuted on full sets, or joins
two texts that are connected anyway. A group of n near copies costs about n comparisons.

Joins by bucket deal the members of hot buckets over several tasks; there are at most ``HOT_KEYS`` such buckets, whose
names are broadcast.

Defined cases: a null, empty or blank text has an empty set and is linked with nothing; a text with fewer than k words
has its whole sequence as its one shingle; rows that share a doc_id are one document for links, so what any of them is
linked with is linked with all; a null doc_id takes no part in links and is its own component (null); an empty table
gives no rows; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shingles import mixed, shingles, words_of
from .work import pick, removed, shared_dir, ship, tidied, written

#: At most so many buckets are hot, each of at least so many members; members of a block that is compared with another.
HOT_KEYS, HOT_LEAST, SALTS, BLOCK_ROWS = 20_000, 500, 64, 512


@dataclass(frozen=True)
class Plan:
    """k-word shingles; a link needs ``100 * common >= percent * union``; bands of ``rows`` of the 2 * perms values."""

    k: int = 5
    percent: int = 80
    rows: int = 4
    perms: int = 48

    @property
    def bands(self) -> int:
        return 2 * self.perms // self.rows

    @property
    def missed(self) -> float:
        """The chance that a link right at the threshold shares no band."""
        return (1 - (self.percent / 100) ** self.rows) ** self.bands


_SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("keys", pa.list_(pa.int64()))])


def _constants(perms: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(7_310_021))
    return rng.integers(0, 2**64, (perms, 1), dtype=np.uint64), rng.integers(0, 2**63, (perms, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minmax(s: np.ndarray, flip: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The smallest hash of a set under each permutation, then the largest under each."""
    low, high = None, None
    for a in range(0, len(s), 4096):
        x = (s[None, a : a + 4096] ^ flip) * scale
        x ^= x >> np.uint64(31)
        lo, hi = x.min(axis=1), x.max(axis=1)
        low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
    return np.concatenate([low, high])


def sketches(docs: DataFrame, plan: Plan) -> DataFrame:
    """For each row: doc_id, n (set size), s1 and s2 (the set's sums), band keys."""
    k, rows, bands, perms = plan.k, plan.rows, plan.bands, plan.perms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flip, scale = _constants(perms)
        weights = mixed(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        band = mixed(np.arange(bands, dtype=np.uint64) + np.uint64(1 << 32))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a in range(0, batch.num_rows, 2000):
                n, s1, s2, keys = [], [], [], []
                part = texts.slice(a, 2000)
                for _, w in words_of(part):
                    s = shingles(w, k)
                    n.append(len(s))
                    s1.append(int(np.sum(s, dtype=np.uint64).astype(np.int64)))
                    s2.append(int(np.sum(mixed(s), dtype=np.uint64).astype(np.int64)))
                    if len(s):
                        v = minmax(s, flip, scale)
                        keys.append(mixed((v.reshape(bands, rows) * weights).sum(axis=1, dtype=np.uint64) + band).view(np.int64))
                    else:
                        keys.append(np.zeros(0, np.int64))
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in keys])]), pa.int32())
                yield pa.RecordBatch.from_arrays([ids.slice(a, 2000), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys)))], schema=_SKETCH)

    return docs.mapInArrow(tidied(run), "doc_id long, n long, s1 long, s2 long, keys array<long>")


def sets(docs: DataFrame, k: int) -> DataFrame:
    """For each row: doc_id, its shingle hashes, and their sum s1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                found = [shingles(w, k) for _, w in words_of(batch.column(1).slice(a, 500))]
                sums = [int(np.sum(x, dtype=np.uint64).astype(np.int64)) for x in found]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 500), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found).view(np.int64))), pa.array(sums, pa.int64())], names=["doc_id", "s", "s1"])

    return docs.mapInArrow(tidied(run), "doc_id long, s array<long>, s1 long")


def components(spark: SparkSession, edges: DataFrame, path: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node reachable.

    Alternates star steps that hang each node's larger, then its smaller neighbours on the smallest; each round is a
    written table, and the one before it goes. It ends when a round changes nothing, which the logarithm's square of the
    longest path bounds.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{path}/0")
    sign = lambda t: tuple(t.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 2**40), F.max("u")).first())
    state, last, i = sign(now), None, 0
    while state != last:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        now = written(small, f"{path}/{i + 1}")
        removed(spark, f"{path}/{i}")
        state, last, i = sign(now), state, i + 1
    tops = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)


def _by_key(rows: DataFrame, table: DataFrame, hot: DataFrame | None, keys: Sequence[str] = ("key",)) -> DataFrame:
    """``rows`` with what ``table`` has for their keys, a row each; rows of hot keys, of which there are few, are dealt over ``SALTS`` tasks."""
    keys = list(keys)
    if hot is None:
        return rows.join(table, keys)
    hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    own = F.when(F.col("_hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(0)
    each = F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    return rows.join(hot, keys, "left").withColumn("_salt", own).drop("_hot").join(table.join(hot, keys, "left").withColumn("_salt", each).drop("_hot"), [*keys, "_salt"]).drop("_salt")


def _confirmed(pairs: DataFrame, members: DataFrame, plan: Plan) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are alike enough."""
    left, right = (members.select(F.col("doc_id").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    joined = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    joined = joined.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("both"))
    return joined.where(_alike(F.col("na"), F.col("nb"), F.col("both"), plan)).select("a", "b").distinct()


def _able(ids: DataFrame, shingled: DataFrame, reps: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, n, shared, keys, s) of those sets that can have a link: ``shared`` of the n shingles occur in another one of ``ids``.

    No two sets have more in common than either shares at all, so one that shares less than the threshold of its own size
    has no link.
    """
    own = shingled.join(ids.hint("merge"), "doc_id", "left_semi")
    single = own.select(F.struct("doc_id", "s1").alias("of"), F.explode("s").alias("x")).groupBy("x").agg(F.count("*").alias("c"), F.min("of").alias("of")).where("c = 1")
    alone = single.groupBy("of.doc_id", "of.s1").agg(F.count("*").alias("alone"))
    known = reps.join(ids, "doc_id", "left_semi").join(alone, ["doc_id", "s1"], "left").select("doc_id", "s1", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared"), "keys")
    return known.where(F.col("shared") * 100 >= F.col("n") * plan.percent).join(own.hint("merge"), ["doc_id", "s1"]).drop("s1")


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    return rows.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("c"))


def _joined(spark: SparkSession, label: DataFrame, found: DataFrame, path: str) -> DataFrame:
    """The components after further links."""
    if found.isEmpty():
        return label
    stars = label.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(spark, stars.unionByName(found), path)


def _alike(na: Column, nb: Column, both: Column, plan: Plan) -> Column:
    return both * 100 >= (na + nb - both) * plan.percent


def _possible(plan: Plan) -> Column:
    """Whether a pair's sizes and shared shingles allow a link."""
    most = F.least("shareda", "sharedb", "na", "nb")
    return most * 100 >= (F.col("na") + F.col("nb") - most) * plan.percent


def near_duplicates(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:  # noqa: B008
    """A row for each row of ``docs``: doc_id, n_shingles, component_id, kept (doc_id = component_id)."""
    spark = docs.sparkSession
    ship(spark)
    out = shared_dir(spark)
    rows = pick(docs, doc_id="long", text="string")
    sketch = written(sketches(rows, plan), f"{out}/sketch")
    known = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    groups = written(sketch.where(known).groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")), f"{out}/groups")
    # Not more than HOT_KEYS groups, and as many buckets, can have so many members.
    total = sketch.count()
    copied = groups.where(F.col("c") > max(HOT_LEAST, -(-total // HOT_KEYS)))
    copied = None if copied.isEmpty() else copied
    member = _by_key(sketch.where(known), groups.drop("c"), copied.select("s1", "s2", "n") if copied else None, ("s1", "s2", "n")).select("doc_id", "n", "s1", "rep", "keys")
    member = member.unionByName(sketch.where(~known).select("doc_id", "n", "s1", F.col("doc_id").alias("rep"), "keys"))
    member = written(member, f"{out}/member")
    reps = member.where("doc_id = rep AND n > 0").select("doc_id", "n", "s1", "keys").dropDuplicates(["doc_id", "s1", "n"])
    # Sets of rows that share a doc_id are one node, whatever group each of them is in.
    ids = member.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("doc_id", "low")
    ties = member.where("n > 0").join(ids, "doc_id").select(F.col("rep").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
    banded = reps.select("doc_id", F.explode("keys").alias("key"))
    counts = banded.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("c")).where("c > 1")
    hubs = written(counts, f"{out}/hubs")
    least = max(HOT_LEAST, -(-plan.bands * total // HOT_KEYS))
    hot = hubs.where(F.col("c") > least).select("key")
    hot = None if hot.isEmpty() else hot
    # A row for each member of a bucket of two or more; the hub's own rows stay for the second look.
    near = written(_by_key(banded, hubs.select("key", "hub"), hot), f"{out}/near")
    pairs = written(near.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct(), f"{out}/pairs")
    involved = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    shingled = written(sets(rows.join(involved.hint("merge"), "doc_id", "left_semi"), plan.k).where(F.size("s") > 0).dropDuplicates(["doc_id", "s1"]), f"{out}/sets")
    links = written(_confirmed(pairs, shingled, plan).unionByName(ties), f"{out}/links")
    label = components(spark, links, f"{out}/stars")

    # Buckets that still hold several components: first their members against the one that shares most with others,
    # which is the middle of a group of near copies, then members of other components against all.
    held = _labelled(near.select("key", "doc_id"), label)
    split = held.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
    held = written(_by_key(held, split, hot).select("key", "doc_id"), f"{out}/open")
    able = written(_able(held.select("doc_id").distinct(), shingled, reps, plan), f"{out}/able")
    held = written(held.join(able.groupBy("doc_id").agg(F.max("shared").alias("shared")), "doc_id"), f"{out}/held")
    hubs = written(held.groupBy("key").agg(F.max_by("doc_id", F.struct("shared", -F.col("doc_id"))).alias("hub")), f"{out}/middles-of")
    around = _by_key(held, hubs, hot).where("doc_id <> hub").select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    found = written(_confirmed(around, able, plan), f"{out}/middle")
    label = _joined(spark, label, found, f"{out}/middles")

    held = _by_key(_labelled(held.select("key", "doc_id"), label), hubs, hot)
    most = F.max(F.when(F.col("doc_id") == F.col("hub"), F.col("c"))).alias("most")
    split = held.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), most, F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts")).where("low < high").select("key", "most", "parts")
    held = _by_key(held.drop("hub"), written(split, f"{out}/split"), hot)
    # A bucket's members outside its middle's component against all of it, block by block; a pair counts in the first bucket that both are in.
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("parts")).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    own, other = held.where("c <> most").withColumn("i", part).withColumn("j", each), held.withColumn("j", part).withColumn("i", each)
    one, two = (x.join(able.hint("merge"), "doc_id").select("key", "i", "j", "most", *[F.col(c).alias(f"{c}{y}") for c in ("doc_id", "c", "n", "shared", "keys", "s")]) for x, y in ((own, "a"), (other, "b")))
    side = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("most")) | (F.col("doc_ida") < F.col("doc_idb")))
    rest = one.join(two.drop("most"), ["key", "i", "j"]).where(side & _possible(plan) & (F.get(F.array_intersect("keysa", "keysb"), F.lit(0)) == F.col("key")) & _alike(F.col("na"), F.col("nb"), F.size(F.array_intersect("sa", "sb")), plan))
    found = written(rest.select(F.col("doc_ida").alias("a"), F.col("doc_idb").alias("b")).distinct(), f"{out}/rest")
    label = _joined(spark, label, found, f"{out}/all")
    removed(spark, *(f"{out}/{x}" for x in ("sketch", "hubs", "near", "pairs", "sets", "links", "open", "able", "held", "middles-of", "middle", "split", "rest")))
    own, label = member.select("doc_id", "n", "rep"), label.withColumnRenamed("node", "rep")
    if copied is None:
        result = own.join(label, "rep", "left")
    else:
        reps = F.broadcast(copied.select("rep").distinct())
        result = own.join(reps, "rep", "left_anti").join(label, "rep", "left").unionByName(own.join(reps, "rep", "left_semi").join(F.broadcast(label.join(reps, "rep", "left_semi")), "rep", "left"))
    return result.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"), (F.col("doc_id") == F.coalesce("component", "rep")).alias("kept"))


def deduplicated(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:  # noqa: B008
    """``docs`` with one document of each group of near duplicates: that of the smallest doc_id. Rows without a doc_id stay.

    Where rows share a doc_id, the one whose text, then whose other columns as JSON sort first stays; only such rows are
    compared for that.
    """
    found = near_duplicates(docs, plan)
    found = written(found.select("doc_id", "kept"), f"{shared_dir(docs.sparkSession)}/kept")
    left = docs.join(found.where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct(), docs["doc_id"] == F.col("_gone"), "left_anti")
    again = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again"))
    if again.isEmpty():
        return left
    same = left["doc_id"] == F.col("_again")
    whole = F.struct(*[left[c].alias(f"_{i}") for i, c in enumerate(left.columns)])
    first = left.join(again, same, "left_semi").groupBy("doc_id").agg(F.min_by(whole, F.struct(F.col("text").cast("string"), F.to_json(whole))).alias("_first"))
    return left.join(again, same, "left_anti").unionByName(first.select(*[F.col(f"_first._{i}").alias(c) for i, c in enumerate(left.columns)]))
