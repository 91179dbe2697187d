"""Benchmark decontamination: pigeonhole search for test items within an edit budget, verified bit-parallel.

Texts and items are sequences of words (letters, digits and underscores, in lower case); in scripts that set no blanks
between words each character is a word. An item of n words may differ from a passage in ``floor(rate * n)`` word edits.
It is split into one piece more than its budget, so a passage within the budget holds one piece unchanged; pieces are
found by hash, and the passage around each hit is verified with Myers' bit-parallel edit distance over words, with free
ends in the text.

The items are sent to all executors in slices of at most ``SLICE_BYTES`` of text, in arrays of about twice that size; a
larger benchmark takes several slices.

Defined cases: a null or empty text holds nothing; a null item and one without words isn't looked for; one too short for
a budget, down to a single word, is found where it stands unchanged; items that share an id are looked for one by one
and the best match counts; rows of one doc_id are searched one by one and the best match counts; an empty table on
either side gives no match; columns other than those named aren't read, and ``clean`` keeps them.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import mixed, words_of
from .work import ship, tidied

RATE, SLICE_BYTES, _BITS, _KNOWN = 0.2, 32 << 20, (1 << 20) - 1, 2000
# Letters and marks of scripts without blanks between words: Thai, Lao, Myanmar, Khmer, Tai scripts, Balinese, Javanese, kana, Yi, Han.
_UNSPACED = "\u0e01-\u0e3a\u0e40-\u0e4e\u0e81-\u0ece\u0edc-\u0edf\u1000-\u103f\u1050-\u108f\u109a-\u109d\u1780-\u17d3\u17dc\u17dd\u1950-\u19c9\u1a20-\u1a7c\u1b00-\u1b4c\u3005-\u3007\u3041-\u309f\u30a1-\u30fa\u30fc-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua000-\ua48c\ua980-\ua9c0\ua9e0-\ua9ef\ua9fa-\ua9fe\uaa60-\uaa76\uaa7a-\uaac2\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff"
_GAPS, _ALONE = re.compile(rf"[^\w{_UNSPACED}]+"), re.compile(f"[{_UNSPACED}]")


def words(texts: list[str | None]) -> list[np.ndarray]:
    """Hashes of the words of each text."""
    clean = pa.array([_ALONE.sub(r" \g<0> ", _GAPS.sub(" ", t.lower())) if t else "" for t in texts], pa.string())
    return [w.copy() for _, w in words_of(clean)]


def _runs(w: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(0, len(w) - n + 1), np.uint64)
    for j in range(n):
        out = mixed(out * np.uint64(0xFF51AFD7ED558CCD) + w[j : len(w) - n + 1 + j])
    return out


def myers(masks: dict[int, int], n: int, text: list[int]) -> tuple[int, int]:
    """The least edit distance of a pattern of n symbols to any part of ``text``, and where the first such part ends."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, now, best, end = full, 0, n, n, 0
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | down
        diagonal = (((x & up) + up) ^ up) | x
        rise = down | ~(diagonal | up)
        fall = up & diagonal
        if rise & top:
            now += 1
        elif fall & top:
            now -= 1
        rise = rise << 1  # free start: the first row stays 0
        fall = fall << 1
        down = rise & diagonal & full
        up = (fall | ~(diagonal | rise)) & full
        if now < best:
            best, end = now, i + 1
    return best, end


class Items:
    """A slice of the benchmark in arrays: each item's words and budget, and its pieces sorted by length and hash."""

    def __init__(self, ids: list[int], texts: list[np.ndarray], rate: float = RATE):
        own = [i for i, w in enumerate(texts) if len(w)]
        self.ids = np.array([ids[i] for i in own], np.int64)
        self.words = np.concatenate([np.zeros(0, np.uint64), *(texts[i] for i in own)])
        self.at = np.concatenate([[0], np.cumsum([len(texts[i]) for i in own])]).astype(np.int64)
        self.budgets = np.array([int(rate * len(texts[i])) for i in own], np.int64)
        self.known: dict[int, dict[int, int]] = {}
        sizes = np.diff(self.at) // (self.budgets + 1)
        #: By length of pieces: their hashes in ascending order, the item and the place in it of each, and which low bits occur.
        self.pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in np.unique(sizes).tolist():
            hashes, items, offsets = [], [], []
            for k in np.flatnonzero(sizes == size).tolist():
                starts = np.arange(self.budgets[k] + 1) * size
                hashes.append(_runs(self.words[self.at[k] : self.at[k + 1]], size)[starts])
                items.append(np.full(len(starts), k, np.int32))
                offsets.append(starts.astype(np.int32))
            h = np.concatenate(hashes)
            order = np.argsort(h, kind="stable")
            bits = np.zeros(_BITS + 1, bool)
            bits[h & np.uint64(_BITS)] = True
            self.pieces[size] = (h[order], np.concatenate(items)[order], np.concatenate(offsets)[order], bits)

    def masks(self, item: int) -> dict[int, int]:
        """Where each word of an item stands, as bits; those of the latest items are kept."""
        if item not in self.known:
            if len(self.known) >= _KNOWN:
                self.known.clear()
            out: dict[int, int] = defaultdict(int)
            for i, c in enumerate(self.words[self.at[item] : self.at[item + 1]].tolist()):
                out[c] |= 1 << i
            self.known[item] = dict(out)
        return self.known[item]

    def hits(self, w: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Items of which a piece stands in a text's words, each with the places where it would begin."""
        items, starts = [], []
        for size, (hashes, item, offset, bits) in self.pieces.items():
            runs = _runs(w, size)
            at = np.flatnonzero(bits[runs & np.uint64(_BITS)])
            low, high = np.searchsorted(hashes, runs[at], "left"), np.searchsorted(hashes, runs[at], "right")
            count = high - low
            of = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            items.append(item[of])
            starts.append(np.repeat(at, count) - offset[of])
        items, starts = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (items, starts))
        if len(items):
            order = np.lexsort((starts, items))
            items, starts = items[order], starts[order]
            new = np.concatenate([[True], (items[1:] != items[:-1]) | (starts[1:] != starts[:-1])])
            items, starts = items[new], starts[new]
            for own in np.split(np.arange(len(items)), np.flatnonzero(np.diff(items)) + 1):
                yield int(items[own[0]]), starts[own].tolist()

    def find(self, w: np.ndarray) -> dict[int, tuple[int, int]]:
        """For each item found in a text's words: the least distance, and the word at which that passage ends."""
        found: dict[int, tuple[int, int]] = {}
        for at, starts in self.hits(w):
            item_id, budget, n = int(self.ids[at]), int(self.budgets[at]), int(self.at[at + 1] - self.at[at])
            if not budget:
                own = self.words[self.at[at] : self.at[at + 1]]
                end = next((i + n for i in starts if np.array_equal(w[i : i + n], own)), None)
                if end is not None and (item_id not in found or (0, end) < found[item_id]):
                    found[item_id] = (0, end)
                continue
            k = 0
            while k < len(starts):
                low, high = max(0, starts[k] - budget), min(len(w), starts[k] + n + budget)
                k += 1
                # Starts close together are verified in one stretch.
                while k < len(starts) and starts[k] <= high:
                    high = min(len(w), starts[k] + n + budget)
                    k += 1
                distance, end = myers(self.masks(at), n, w[low:high].tolist())
                if distance <= budget and (item_id not in found or (distance, low + end) < found[item_id]):
                    found[item_id] = (distance, low + end)
        return found


def slices(benchmark: DataFrame, rate: float) -> Iterator[Items]:
    """The benchmark in slices of bounded size."""
    rows = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0))).first()[0]
    count = max(1, -(-size // SLICE_BYTES))
    for i in range(count):
        part = rows if count == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == i)
        got = part.toArrow()
        items = sorted(zip(got.column(0).to_pylist(), words(got.column(1).to_pylist()), strict=True), key=lambda x: (x[0], x[1].tobytes()))
        yield Items([r[0] for r in items], [r[1] for r in items], rate)


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, distance (word edits), end_word: a row for each item that a document holds within the budget."""
    ship(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    out = None
    for items in slices(benchmark, rate):
        shared = docs.sparkSession.sparkContext.broadcast(items)  # at most a slice

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                for a in range(0, batch.num_rows, 500):
                    part = batch.slice(a, 500)
                    got = [(i, item, d, end) for i, w in zip(part.column(0).to_pylist(), words(part.column(1).to_pylist()), strict=True) for item, (d, end) in items.find(w).items()]
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "item_id", "distance", "end_word"])

        found = rows.mapInArrow(tidied(run), "doc_id long, item_id long, distance int, end_word long")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "end_word")).alias("m")).select("doc_id", "item_id", "m.distance", "m.end_word")


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` that hold no item, unchanged; only the texts go to Python, and the decision stays with its row."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs
    for items in slices(benchmark, rate):
        rows = rows.where(_holds_none(spark.sparkContext.broadcast(items))(docs["text"].cast("string")))  # at most a slice
    return rows


def _holds_none(shared: Broadcast) -> Callable[[Column], Column]:
    @F.arrow_udf("boolean")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def searched(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            items = shared.value
            for column in columns:
                yield pa.array([not items.find(w) for a in range(0, len(column), 500) for w in words(column.slice(a, 500).to_pylist())], pa.bool_())

        return tidied(searched)(columns)

    return run
