"""Fill-in-the-middle: texts cut at two code points by a parallel scan with a finite automaton.

The automaton reads UTF-8 bytes. It knows how many bytes of a code point are still to come, how much of a marker it has
just read, and whether a marker has been read at all; a byte that begins a code point gives a unit. A chunk of bytes is
read from every state at once, without what stands before it, and gives the function from entry to end states and the
units for each entry state. These functions compose associatively, so prefix compositions over a text's chunks, in as
many steps as the logarithm of their number, give each chunk's entry state and first unit; then only the chunks that hold
a cut are read again to find its byte.

Texts of up to ``giant`` bytes are scanned where they lie. Longer ones are dealt in pieces over all tasks, each piece gives
its function, a text's functions are composed, and only the pieces with cuts are read again.

Defined cases: a null or empty text is plain and has no units; a null doc_id counts as no digits; a text with a marker is
plain; rows that share a doc_id and a text give the same row each; bytes that aren't UTF-8 are units of their own; texts
may be of any length; an empty table gives no rows; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import pick, shared_dir, ship, tidied, written

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a chunk, of texts that are scanned at a time, of a text that is dealt over tasks, of a piece of it.
CHUNK, BLOCK, GIANT, PIECE = 512, 1 << 21, 1 << 16, 1 << 14
#: Texts of which this percentage is left as they are, and the percentage of the others whose suffix comes first.
PLAIN, SUFFIX_FIRST = 10, 20
CUTS = "struct<n:long,form:string,prefix_chars:long,middle_chars:long,first:long,second:long>"
_PAD = 256  # stands for no byte


def _step(state: tuple[int, int, bool], byte: int) -> tuple[tuple[int, int, bool], int]:
    """The next state and the units that begin with a byte; a state: bytes to come, marker bytes read, whether a marker was read."""
    due, read, found = state
    if due and 0x80 <= byte < 0xC0:
        return (due - 1, 0, found), 0
    if not found:
        if read == 2 and byte == ord(">"):
            read, found = 0, True
        elif byte == ord("<"):
            read = 1
        else:
            read = 2 if read == 1 and byte in b"PSM" else 0
    return (1 if 0xC0 <= byte < 0xE0 else 2 if 0xE0 <= byte < 0xF0 else 3 if 0xF0 <= byte < 0xF8 else 0, read, found), 1


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte (and no byte) and state: the next state, the units; and whether each state has found a marker."""
    states = [(0, 0, False)]
    for s in states:
        states += [x for x in dict.fromkeys(_step(s, b)[0] for b in range(256)) if x not in states]
    at = {s: i for i, s in enumerate(states)}
    both = [[_step(s, b) for s in states] for b in range(256)] + [[(s, 0) for s in states]]
    return np.array([[at[x] for x, _ in row] for row in both]), np.array([[u for _, u in row] for row in both]), np.array([s[2] for s in states])


_NEXT, _UNITS, _FOUND = _tables()
STATES = len(_FOUND)
#: What a byte adds to units << 8 | state.
_ADDS = ((_UNITS << 8) + _NEXT - np.arange(STATES)).astype(np.int32).ravel()


class Scan:
    """A block of texts (or pieces) in chunks: each chunk's function, composed with those before it in its text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.size = np.diff(offsets)
        chunks = np.maximum(1, -(-self.size // CHUNK))
        self.first = np.cumsum(chunks) - chunks
        self.row = np.repeat(np.arange(len(chunks)), chunks)
        self.place = np.arange(len(self.row)) - self.first[self.row]
        left = self.size[self.row] - self.place * CHUNK
        at = np.arange(CHUNK)[:, None]
        bytes_ = np.concatenate([data[offsets[0] : offsets[-1]].astype(np.int32), np.zeros(CHUNK, np.int32)]) * STATES
        self.x = np.where(at < left, bytes_[(offsets[:-1] - offsets[0])[self.row] + self.place * CHUNK + at], np.int32(_PAD * STATES))
        now = np.tile(np.arange(STATES, dtype=np.int32), (len(self.row), 1))
        for x in self.x:
            now += _ADDS.take((now & 255) + x[:, None])
        self.ends, self.units = (now & 255).astype(np.int64), (now >> 8).astype(np.int64)
        self.ends, self.units = composed(self.ends, self.units, self.place)
        self.last = self.first + chunks - 1

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        """For each text and entry state, the state at its end and its units."""
        return self.ends[self.last], self.units[self.last]

    def bytes_at(self, rows: np.ndarray, entry: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """The bytes of a text (by ``rows``) before its ``unit``-th one, counted from 0, where it is entered in the state ``entry[row]``; all if it has no more."""
        own = entry[self.row]
        upto = self.units[np.arange(len(own)), own]
        total = upto[self.last]
        before = np.cumsum(total) - total
        inside = unit < total[rows]
        rows_in, unit_in = rows[inside], unit[inside]
        chunk = np.searchsorted(upto + before[self.row], unit_in + before[rows_in], "right")
        begun = self.place[chunk] > 0
        state = np.where(begun, self.ends[chunk - 1, own[chunk]], own[chunk])
        left = unit_in - np.where(begun, upto[chunk - 1], 0)
        found = np.full(len(chunk), -1)
        for t, x in enumerate(self.x[:, chunk]):
            at = x + state
            begins = _UNITS.ravel()[at]
            found[(begins == 1) & (left == 0) & (found < 0)] = t
            left -= begins
            state = _NEXT.ravel()[at]
        out = self.size[rows].astype(np.int64)
        out[inside] = self.place[chunk] * CHUNK + found
        return out


def composed(ends: np.ndarray, units: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix compositions of the functions of parts that follow one another, ``place`` counting from 0 in each text."""
    ends, units, step = ends.copy(), units.copy(), 1
    while step <= place.max(initial=0):
        at = np.flatnonzero(place >= step)
        e, u = ends[at - step], units[at - step]
        units[at], ends[at] = u + np.take_along_axis(units[at], e, 1), np.take_along_axis(ends[at], e, 1)
        step *= 2
    return ends, units


def _blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A binary array in blocks of bounded size: the first row's place, the data, the offsets."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK, "right")) - 1)
        yield a, data, offsets[a : b + 1]
        a = b


def decided(doc_id: int | None, n: int, marked: bool) -> tuple[str, int, int]:
    """Form, and the units before the first and the second cut."""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    one, two, plain, spm = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    first, second = sorted((one % (n + 1), two % (n + 1)))
    return "plain" if n == 0 or marked or plain % 100 >= 100 - PLAIN else "spm" if spm % 100 < SUFFIX_FIRST else "psm", first, second


def _cut(ids: pa.Array, texts: pa.Array) -> pa.Array:
    """The cuts of whole texts."""
    out = []
    ids = ids.to_pylist()
    for a, data, offsets in _blocks(texts.fill_null(b"")):
        scan = Scan(data, offsets)
        ends, units = scan.functions()
        entry = np.zeros(len(ends), np.int64)
        picked = [decided(i, n, f) for i, n, f in zip(ids[a : a + len(ends)], units[:, 0].tolist(), _FOUND[ends[:, 0]].tolist(), strict=True)]
        rows = np.array([i for i, (form, _, _) in enumerate(picked) if form != "plain"], np.int64)
        cuts = iter(scan.bytes_at(np.repeat(rows, 2), entry, np.array([x for form, *own in picked if form != "plain" for x in own], np.int64)).tolist())
        for n, (form, first, second) in zip(units[:, 0].tolist(), picked, strict=True):
            out.append((n, form, None, None, None, None) if form == "plain" else (n, form, first, second - first, next(cuts), next(cuts)))
    names = [x.split(":")[0] for x in CUTS[7:-1].split(",")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in CUTS[7:-1].split(",")]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)


def _pieces(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_buffer()
                for a in range(0, len(text), 64 * size):
                    own = [text[k : k + size].to_pybytes() for k in range(a, min(a + 64 * size, len(text)), size)]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(own), pa.int64()), pa.array([batch.column(1)[i].as_py()] * len(own)), pa.array(range(a // size, a // size + len(own)), pa.int32()), pa.array(own, pa.binary())], names=["doc_id", "print", "piece", "bytes"])

    return run


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece's end states and units, for every entry state."""
    for batch in batches:
        for a, data, offsets in _blocks(batch.column(3)):
            ends, units = Scan(data, offsets).functions()
            rows = len(ends)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * STATES, pa.int32()), pa.array(x.ravel(), pa.int64())) for x in (ends, units)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, rows) for i in range(3)), *lists], names=["doc_id", "print", "piece", "ends", "units"])


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text's functions (doc_id, print, parts in order): its decision, and for each cut the piece, the state in which that is entered and the unit inside it."""
    for batch in batches:
        rows = []
        for doc, name, parts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            ends, units = composed(np.array([p["ends"] for p in parts]), np.array([p["units"] for p in parts]), np.arange(len(parts)))
            n = int(units[-1, 0])
            form, first, second = decided(doc, n, bool(_FOUND[ends[-1, 0]]))
            cuts = []
            for k in () if form == "plain" else (first, second):
                j = min(int(np.searchsorted(units[:, 0], k, "right")), len(parts) - 1)
                cuts.append({"piece": j, "entry": int(ends[j - 1, 0]) if j else 0, "unit": k - (int(units[j - 1, 0]) if j else 0)})
            plain = form == "plain"
            rows.append({"doc_id": doc, "print": name, "n": n, "form": form, "prefix_chars": None if plain else first, "middle_chars": None if plain else second - first, "cuts": cuts})
        cut = pa.struct([("piece", pa.int32()), ("entry", pa.int64()), ("unit", pa.int64())])
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("print", pa.string()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("cuts", pa.list_(cut))]))


def _selected(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The byte of a text at which each cut lies: rows of doc_id, print, place of the cut, piece, entry, unit, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, data, offsets in _blocks(batch.column(6)):
                rows = len(offsets) - 1
                piece, entry, unit = (batch.column(i).slice(a, rows).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 4, 5))
                at = piece * size + Scan(data, offsets).bytes_at(np.arange(rows), entry, unit)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, rows) for i in range(3)), pa.array(at, pa.int64())], names=["doc_id", "print", "cut", "at"])

    return run


def _dealt(long: DataFrame, out: str, size: int) -> DataFrame:
    """doc_id, print and the cuts (``CUTS``) of texts that are scanned in pieces; ``long``: doc_id, print, text as bytes."""
    key = ["doc_id", "print"]
    pieces = long.mapInArrow(tidied(_pieces(size)), "doc_id long, print string, piece int, bytes binary").repartition(F.xxhash64("print", "piece"))
    pieces = written(pieces, f"{out}/pieces")
    each = pieces.mapInArrow(tidied(_functions), "doc_id long, print string, piece int, ends array<long>, units array<long>").dropDuplicates([*key, "piece"])
    parts = each.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("piece", "ends", "units"))).alias("parts"))
    cut = "array<struct<piece:int,entry:long,unit:long>>"
    texts = written(parts.mapInArrow(_resolved, f"doc_id long, print string, n long, form string, prefix_chars long, middle_chars long, cuts {cut}"), f"{out}/texts")
    wanted = texts.select(*key, F.posexplode("cuts").alias("cut", "c")).select(*key, "cut", "c.*")
    same = wanted["doc_id"].eqNullSafe(pieces["doc_id"]) & (wanted["print"] == pieces["print"]) & (wanted["piece"] == pieces["piece"])
    held = wanted.join(pieces, same).select(wanted["doc_id"], wanted["print"], "cut", wanted["piece"], "entry", "unit", "bytes")
    at = held.mapInArrow(tidied(_selected(size)), "doc_id long, print string, cut int, at long")
    ends = at.groupBy(*key).agg(F.max(F.when(F.col("cut") == 0, F.col("at"))).alias("first"), F.max(F.when(F.col("cut") == 1, F.col("at"))).alias("second"))
    ends = ends.withColumnsRenamed({"doc_id": "_id", "print": "_print"})
    found = texts.join(ends, texts["doc_id"].eqNullSafe(ends["_id"]) & (texts["print"] == ends["_print"]), "left")
    return found.select(*key, F.struct("n", "form", "prefix_chars", "middle_chars", "first", "second").alias("cuts"))


def transformed(docs: DataFrame, giant: int = GIANT, piece: int = PIECE) -> DataFrame:
    """doc_id, n, form (plain, psm, spm), prefix_chars, middle_chars, output: a row for each document."""
    ship(docs.sparkSession)
    rows = pick(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")).cast("binary"))
    cut = F.arrow_udf(_cut, CUTS)
    short = rows.where(F.octet_length("text") <= giant).select("doc_id", "text", cut("doc_id", "text").alias("cuts"))
    long = rows.where(F.octet_length("text") > giant).withColumn("print", F.sha2("text", 256))
    found = _dealt(long.select("doc_id", "print", "text"), shared_dir(docs.sparkSession), piece).withColumnsRenamed({"doc_id": "_id", "print": "_print"})
    long = long.join(found, long["doc_id"].eqNullSafe(found["_id"]) & (long["print"] == found["_print"])).select("doc_id", "text", "cuts")
    both = short.unionByName(long).select("doc_id", "text", "cuts.*")
    first, second = F.col("first").cast("int"), F.col("second").cast("int")
    prefix, middle, suffix = F.substring("text", F.lit(1), first), F.substring("text", first + 1, second - first), F.substring("text", second + 1, F.octet_length("text") - second)
    mark = lambda m: F.lit(m).cast("binary")
    output = F.when(F.col("form") == "psm", F.concat(mark(PREFIX), prefix, mark(SUFFIX), suffix, mark(MIDDLE), middle)).when(F.col("form") == "spm", F.concat(mark(SUFFIX), suffix, mark(PREFIX), prefix, mark(MIDDLE), middle)).otherwise(F.col("text"))
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", output.cast("string").alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text of an output: what stands between its markers, in the order of the text."""
    behind = lambda mark: F.substring_index(output, mark, -1)
    prefix = F.when(form == "psm", F.substring_index(behind(PREFIX), SUFFIX, 1)).otherwise(F.substring_index(behind(PREFIX), MIDDLE, 1))
    suffix = F.when(form == "psm", F.substring_index(behind(SUFFIX), MIDDLE, 1)).otherwise(F.substring_index(behind(SUFFIX), PREFIX, 1))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, behind(MIDDLE), suffix))


def digests(docs: DataFrame) -> DataFrame:
    """``transformed`` with the sha256 of each output and of the text that is rebuilt from it, instead of the output."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    found = transformed(docs)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
