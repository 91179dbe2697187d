"""SimHash near duplicates: 64-bit fingerprints of word shingles, linked at few differing bits, through pivot distance tables.

A fingerprint's bit is 1 where more than half of its shingles' hashes have it. A table holds each fingerprint's Hamming
distances to ``PIVOTS`` reference fingerprints, apart for each segment of the bits; their sums are its distances to the
whole references. By the triangle inequality two fingerprints at d bits differ by at most d in each distance, and the
segments' largest differences add up to at most d. So of ``d + r`` segments at least r have all distances alike: the
distances over each choice of r segments are the keys under which candidates meet. Of these, a pair whose largest
difference in any distance is over d is discarded, and the survivors are verified on their bits. No link is lost, whatever
r is; it only follows the number of different fingerprints, so that few unrelated ones meet.

Documents of one fingerprint are one node. Under a key, members are first compared with the commonest one; only those
that are still outside its component are compared with all members, in blocks, and a block gives a link for each node
that it joins, not for each pair. So a group of n near copies costs about n comparisons where they link to its middle.

Defined cases: a null, empty or blank text has no shingle and the fingerprint 0, linked like any other; a text with fewer
than k words has its whole sequence as its one shingle; rows that share a doc_id are one document for links; a null doc_id
takes no part in links and its component is null; texts of any length are read in pieces; an empty table gives no rows;
columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neardup import components
from .shingles import mixed
from .work import dealt, pick, removed, shared_dir, ship, tidied, written

SEED, PIVOTS = 42, 24
#: Bytes of text read at a time; members of a block; pairs compared at a time.
PIECE, BLOCK_ROWS, PAIRS = 1 << 20, 1024, 1 << 20
#: Unrelated fingerprints that one may meet on average; keys with at least so many members, of which there are few, are dealt over tasks.
MEETINGS, HOT_KEYS, HOT_LEAST = 8, 20_000, 500
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_EDGE = re.compile(rb"[\t-\r ]")
_REFERENCES = np.random.Generator(np.random.PCG64(64_221)).integers(0, 2**64, PIVOTS, dtype=np.uint64)


def _hashes(raw: bytes, k: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's shingles, repeats included, piece by piece."""
    at, words, none = 0, [], True
    while at < len(raw):
        edge = _EDGE.search(raw, at + PIECE)
        end = edge.start() if edge else len(raw)
        words += raw[at:end].translate(_LOWER).split()
        if len(words) >= k:
            shingled = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
            yield np.fromiter(map(xxhash.xxh64_intdigest, shingled, itertools.repeat(SEED)), np.uint64, len(words) - k + 1)
            none, words = False, words[len(words) - k + 1 :]
        at = end
    if none and words:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)


def fingerprint(raw: bytes, k: int = 3) -> np.uint64:
    """The bits that more than half of the shingles' hashes have; 0 without words."""
    ones, n = np.zeros(64, np.int64), 0
    for h in _hashes(raw, k):
        for a in range(0, len(h), 1 << 16):
            part = np.unpackbits(np.ascontiguousarray(h[a : a + (1 << 16)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += part.sum(axis=0, dtype=np.uint32)
        n += len(h)
    return np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            found = np.array([fingerprint(x.as_py() or b"", k) for x in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return pick(docs, doc_id="long", text="string").mapInArrow(tidied(run), "doc_id long, fp long")


def segments(bits: int, agree: int) -> np.ndarray:
    """Masks of ``bits + agree`` segments."""
    cuts = [64 * i // (bits + agree) for i in range(bits + agree + 1)]
    return np.array([(1 << b) - (1 << a) for a, b in itertools.pairwise(cuts)], np.uint64)


def distances(fp: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """The table: for each fingerprint and segment, its distances to the references."""
    return np.bitwise_count((fp[:, None, None] ^ _REFERENCES) & masks[:, None])


def keys(fp: np.ndarray, bits: int, agree: int) -> np.ndarray:
    """For each fingerprint, a key of its distances over each choice of ``agree`` segments."""
    table = distances(fp, segments(bits, agree)).astype(np.uint64)
    own = mixed((mixed(table + np.arange(PIVOTS, dtype=np.uint64) * np.uint64(64))).sum(axis=2, dtype=np.uint64))
    out = []
    for i, chosen in enumerate(itertools.combinations(range(bits + agree), agree)):
        key = np.full(len(fp), np.uint64(i + 1))
        for s in chosen:
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + own[:, s])
        out.append(key)
    return np.stack(out, axis=1)


def survivors(fp: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (places in ``fp``) at ``bits`` bits or fewer: discarded by their largest difference in a distance, then verified."""
    table = distances(fp, np.array([2**64 - 1], np.uint64))[:, 0].astype(np.int8)
    for own in table.T:
        keep = np.abs(own[a] - own[b]) <= bits
        a, b = a[keep], b[keep]
    keep = np.bitwise_count(fp[a] ^ fp[b]) <= bits
    return a[keep], b[keep]


def agreeing(total: int, bits: int) -> int:
    """How many segments, two at least, must agree for a fingerprint to meet few unrelated ones of ``total``: ten keys each up to 40 million, twenty up to 1.7 billion."""
    meets = lambda r: total * comb(bits + r, r) / 2 ** (64 * r / (bits + r))
    return next((r for r in range(2, 6) if meets(r) <= MEETINGS), 6)


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a block as one for each node: to the smallest place that it is connected with."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def _stars(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (hub, fp) those that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            both = np.concatenate([batch.column(i).to_numpy() for i in (0, 1)]).view(np.uint64)
            a, b = survivors(both, np.arange(n), np.arange(n, 2 * n), bits)
            yield pa.RecordBatch.from_arrays([pa.array(both[x].view(np.int64)) for x in (a, b)], names=["a", "b"])

    return run


def _linked(fp: np.ndarray, label: np.ndarray, side: np.ndarray, outside: np.ndarray, cell: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of side 0 and of side 1 in each cell, whose rows lie together, side 0 first."""
    begins = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    ends = np.append(begins[1:], len(cell))
    of = np.repeat(np.arange(len(begins)), ends - begins)
    other = begins + np.bincount(of, weights=side == 0, minlength=len(begins)).astype(np.int64)
    own = np.flatnonzero(side == 0)
    counts = (ends - other)[of[own]]
    found_a, found_b, at = [], [], 0
    upto = np.cumsum(counts)
    while at < len(own):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        n = counts[at:to]
        a = np.repeat(own[at:to], n)
        b = np.repeat(other[of[own[at:to]]] - (np.cumsum(n) - n), n) + np.arange(len(a))
        # Two members outside are compared once.
        keep = (label[a] != label[b]) & (~outside[b] | (fp[a] < fp[b]))
        a, b = survivors(fp, a[keep], b[keep], bits)
        found_a.append(a)
        found_b.append(b)
        at = to
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # A fingerprint stands in many cells of a batch: links are between fingerprints.
    _, first, place = np.unique(fp, return_index=True, return_inverse=True)
    return _roots(first[place[np.concatenate(found_a)]], first[place[np.concatenate(found_b)]])


def _cells(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links within cells (key, i, j); rows come in their order, and a cell may go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
                rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
            if rest is None:
                continue
            key, i, j, side, fp, label, outside = rest
            change = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            cell = np.concatenate([[0], np.cumsum(change)])
            last = int(np.searchsorted(cell, cell[-1])) if batch is not None else len(cell)
            if last:
                bare = fp.view(np.uint64)
                a, b = _linked(bare[:last], label[:last], side[:last], outside[:last], cell[:last], bits)
                yield pa.RecordBatch.from_arrays([pa.array(fp[x]) for x in (a, b)], names=["a", "b"])
            rest = [x[last:] for x in rest] if last < len(cell) else None

    return run


def links(nodes: DataFrame, more: DataFrame, out: str, bits: int = 3) -> DataFrame:
    """(node, component) of fingerprints (``nodes``: fp, c documents) that link with others, or by ``more`` (a, b)."""
    spark = nodes.sparkSession
    total = nodes.count()
    agree = agreeing(total, bits)
    tables = comb(bits + agree, agree)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(a, 4096)
                found = keys(fp.to_numpy().view(np.uint64), bits, agree)
                yield pa.RecordBatch.from_arrays([fp, batch.column(1).slice(a, 4096), pa.ListArray.from_arrays(pa.array(np.arange(len(fp) + 1) * tables, pa.int32()), pa.array(found.ravel().view(np.int64)))], names=["fp", "c", "keys"])

    banded = nodes.select("fp", "c").mapInArrow(tidied(keyed), "fp long, c long, keys array<long>").select("fp", "c", F.explode("keys").alias("key"))
    hubs = banded.groupBy("key").agg(F.max(F.struct("c", "fp")).alias("top"), F.count("*").alias("members")).where("members > 1")
    hubs = written(hubs.select("key", F.col("top.fp").alias("hub"), "members"), f"{out}/hubs")
    # Not more than HOT_KEYS keys can have so many members.
    hot = hubs.where(F.col("members") > max(HOT_LEAST, -(-tables * total // HOT_KEYS)))
    near = written(dealt(banded.select("key", "fp"), hubs, hot, "key", "fp"), f"{out}/near")
    stars = near.where("fp <> hub").select("hub", "fp").distinct().mapInArrow(tidied(_stars(bits)), "a long, b long")
    label = components(spark, stars.unionByName(more), f"{out}/stars")

    # Members outside their hub's component against all members of the key, block by block.
    named = lambda node: label.select(F.col("node").alias(node), F.col("component").alias(f"of_{node}"))
    held = near.join(named("fp"), "fp", "left").join(named("hub"), "hub", "left")
    held = held.select("key", "fp", "members", F.coalesce("of_fp", "fp").alias("label"), (F.coalesce("of_fp", "fp") != F.coalesce("of_hub", "hub")).alias("outside"))
    held = written(held, f"{out}/held")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK_ROWS).cast("int")
    opened = written(held.where("outside").groupBy("key").agg(F.count("*").alias("left")).select("key", blocks("left").alias("rows")), f"{out}/open")
    split = dealt(held, opened, hot, "key", "fp").withColumn("cols", blocks("members"))
    part, each = lambda n: F.pmod(F.xxhash64("fp", F.lit(5)), F.col(n)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = split.where("outside").withColumn("i", part("rows")).withColumn("j", each("cols")).withColumn("side", F.lit(0))
    every = split.withColumn("j", part("cols")).withColumn("i", each("rows")).withColumn("side", F.lit(1))
    columns = ["key", "i", "j", "side", "fp", "label", "outside"]
    cells = own.select(*columns).unionByName(every.select(*columns)).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    found = written(cells.mapInArrow(tidied(_cells(bits)), "a long, b long").distinct(), f"{out}/found")
    if not found.isEmpty():
        joined = label.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        label = components(spark, joined.unionByName(found), f"{out}/all")
    removed(spark, *(f"{out}/{x}" for x in ("hubs", "near", "held", "open", "found")))
    return label


def near_duplicates(docs: DataFrame, k: int = 3, bits: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable) of each row."""
    spark = docs.sparkSession
    ship(spark)
    out = shared_dir(spark)
    prints = written(fingerprints(docs, k), f"{out}/prints")
    known = prints.where("doc_id IS NOT NULL")
    nodes = written(known.groupBy("fp").agg(F.count("*").alias("c"), F.min("doc_id").alias("least")), f"{out}/nodes")
    # Fingerprints of rows that share a doc_id are tied.
    again = known.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("high")).where("a <> high").select("doc_id", "a")
    ties = written(known.join(again, "doc_id").select("a", F.col("fp").alias("b")).where("a <> b").distinct(), f"{out}/ties")
    label = links(nodes, ties, out, bits)
    linked = nodes.join(label, nodes["fp"] == label["node"])
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    own = nodes.join(linked.select("fp", "component").join(least, "component").select("fp", "component_id"), "fp", "left")
    own = written(own.select("fp", "c", F.coalesce("component_id", "least").alias("component_id")), f"{out}/own")
    copied = own.where(F.col("c") > max(HOT_LEAST, -(-prints.count() // HOT_KEYS)))
    removed(spark, *(f"{out}/{x}" for x in ("nodes", "ties")))
    found = dealt(known, own.drop("c"), copied, "fp", "doc_id").unionByName(prints.where("doc_id IS NULL").withColumn("component_id", F.lit(None).cast("long")))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
