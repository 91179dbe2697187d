"""Token-ID output: shards of raw ids with a minimal perfect hash index from document key to offset.

A shard file holds, in this order: a 16-byte head (magic, version, bytes an id), the payload of little-endian ids of 2
bytes (vocabularies up to 65,536 ids) or 4, the documents' keys (int64) and lengths (uint32) in payload order, the levels
of the hash, a slot for each different key (fingerprint uint32, length uint32, offset uint64 in ids), a directory of the
levels, and a fixed-size tail that says where each part begins. A level is cut into blocks of 512 bits, each after the
count of bits set before it, so a key's slot and with it its offset are found by reading one block a level and one slot.
Documents lie in ascending key order within a shard and from shard to shard, so a shard's first global offset is the sum
of the earlier shards' ids.

Defined cases: a null or empty text has no ids but the end id; rows whose key is null come first and are not indexed;
rows that share a key stay adjacent, in the order of their texts, and the index gives the first; texts of any length are
encoded in pieces; an empty table gives no shards and no rows; columns other than the key and the text are not read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shingles import mixed
from .work import shared_dir, ship, tidied, written

MAGIC, VERSION = b"LXFTOK\x00\x00", 2
TAIL = struct.Struct("<8sQQQQQQQQ")
SLOT = np.dtype([("print", "<u4"), ("length", "<u4"), ("start", "<u8")])
MANIFEST = "shard int, path string, n_docs long, n_tokens long, first_key long, last_key long"
#: Bytes of text encoded at a time; units that workers keep with their ids, beyond which only those of the last block stay.
BLOCK_BYTES, KNOWN_UNITS = 4 << 20, 1_000_000
#: Longer units, and those with a character from U+0600 on, go to the tokenizer whole.
LONGEST_UNIT, PLAIN = 48, "؀"
# Unicode's white space, and the pre-tokenizer's pattern of byte-level vocabularies.
_SPACE = "\t-\r \x85\xa0  -     　"
_PRE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_RUN, _SPACES = re.compile(f"[{_SPACE}]+"), re.compile(f"[{_SPACE}]")
#: Texts whose white space isn't only single blanks and line feeds between other characters, as RE2 has it.
_SPACED = "[\\t\\x{b}\\f\\r\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|[ \\n][ \\n]|[ \\n]$"
#: Words of letters below ``PLAIN``, which are one pre-token with the blank before them.
_LETTERS = "^[A-Za-z\\x{aa}\\x{b5}\\x{ba}\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{2c1}\\x{370}-\\x{373}\\x{386}\\x{388}-\\x{38a}\\x{38e}-\\x{3a1}\\x{3a3}-\\x{3f5}\\x{400}-\\x{481}\\x{48a}-\\x{52f}]{1,48}$"
#: A single blank between other characters begins a pre-token.
_CUT = re.compile(f"(?<=[^{_SPACE}]) (?=[^{_SPACE}])")


def _symbols() -> dict[int, str]:
    """The printable symbol of each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)}


def _respaced(text: str) -> str:
    """Units of a text with any white space, set apart by single blanks.

    Of a run before another character all but the last is a pre-token of its own, as is a whole run at the end; such a
    unit begins with U+0000 and has U+0001 for blanks. What the run's last character stands before begins with it, if it
    isn't a blank.
    """

    def unit(m: re.Match) -> str:
        own, last = (m[0], "") if m.end() == len(text) else (m[0][:-1], m[0][-1])
        return (" \x00" + own.replace(" ", "\x01") if own else "") + ("" if not last else " " if last == " " else f" {last}")

    return _RUN.sub(unit, text)


class Encoder:
    """Encodes texts with a byte-level tokenizer file, each distinct unit of a block once.

    The pre-tokenizer's pattern never lets a token reach from a non-blank character over a following single blank that
    precedes a non-blank one, so a text's ids are those of its units, one after the other. A unit's pre-tokens get their
    ids from the file's merges on byte symbols, many to a call. Tokenizers of other kinds encode whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel, Split

        self.tokenizer = Tokenizer.from_file(path)
        pre = self.tokenizer.pre_tokenizer
        self.by_unit = isinstance(pre, ByteLevel) and not pre.add_prefix_space and pre.use_regex and self.tokenizer.normalizer is None and isinstance(self.tokenizer.model, BPE)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self.by_unit:
            self.merges = Tokenizer(self.tokenizer.model)
            self.merges.pre_tokenizer = Split(chr(266), "isolated")  # the symbol of a line feed
            self.symbols = _symbols()
            (self.line,) = self._ids("\n").tolist()
        self._forget()

    def width(self, *ids: int) -> int:
        """Bytes that hold any id of the vocabulary and the further ones."""
        return 2 if max(self.tokenizer.get_vocab_size(), *(i + 1 for i in ids)) <= 1 << 16 else 4

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of single pre-tokens without line feeds, one after the other, and how many each has."""
        ids, sizes = [], []
        for i in range(0, len(words), 500):
            part = "\n".join(words[i : i + 500]).encode().decode("latin-1").translate(self.symbols)
            x = np.array(self.merges.encode_batch_fast([part], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(x == self.line)
            ids.append(np.delete(x, cuts))
            sizes.append(np.diff(np.concatenate([[-1], cuts, [len(x)]])) - 1)
        return (np.concatenate(ids), np.concatenate(sizes)) if ids else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _learned(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of units: where each begins in a pool, its length, the pool."""
        begins, lengths, pools, size = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64), [], 0
        word = pc.match_substring_regex(units, _LETTERS).to_numpy(zero_copy_only=False)

        def put(at: np.ndarray, counts: np.ndarray, pool: np.ndarray) -> None:
            nonlocal size
            begins[at], lengths[at] = size + np.cumsum(counts) - counts, counts
            pools.append(pool)
            size += len(pool)

        ids, counts = self._merged(pc.binary_join_element_wise(pa.scalar(" "), units.filter(pa.array(word)), "").to_pylist())
        put(np.flatnonzero(word), counts, ids)
        others = np.flatnonzero(~word)
        put(others, *self._composed(units.take(pa.array(others)).to_pylist()))
        return begins, lengths, np.concatenate(pools)

    def _composed(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each unit has, and these one after the other: those of its pre-tokens, or the tokenizer's own."""
        at: dict[str, int] = {}
        whole: list[np.ndarray] = []
        parts: list[int] = []
        counts = np.zeros(len(units), np.int64)
        for i, u in enumerate(units):
            if not u:  # of a text whose ids come from elsewhere
                continue
            if len(u) > LONGEST_UNIT or not u.isascii() and max(u) >= PLAIN or u[0] == "\x00" or u == "\n":
                whole.append(self._ids(u[1:].replace("\x01", " ") if u[0] == "\x00" else u if _SPACES.match(u[0]) else f" {u}"))
                counts[i] = 1
                parts.append(-len(whole))
                continue
            mark = not u[-1].isalnum() and u[-1] not in "'\n"  # no pre-token of letters reaches over it
            found = (f" {u[:-1]}", u[-1]) if mark and u[:-1].isalpha() else _PRE.findall(u if _SPACES.match(u[0]) else f" {u}")
            counts[i] = len(found)
            parts += [at.setdefault(f, len(at)) for f in found]
        words = list(at)
        lines = [j for j, w in enumerate(words) if "\n" in w]  # a unit's own line feed
        for j in lines:
            words[j] = "x"
        pool, sizes = self._merged(words)
        starts = np.cumsum(sizes) - sizes
        starts[lines], sizes[lines] = len(pool), 1
        more = np.array([len(x) for x in whole], np.int64)
        # Whole units count from the list's end.
        starts = np.concatenate([starts, (len(pool) + 1 + np.cumsum(more) - more)[::-1]])
        sizes = np.concatenate([sizes, more[::-1]])
        pool = np.concatenate([pool, np.array([self.line], np.uint32), *whole])
        parts = np.array(parts, np.int64)
        total, places = _gathered(starts[parts], sizes[parts])
        ends = np.concatenate([[0], np.cumsum(sizes[parts])])
        cuts = np.concatenate([[0], np.cumsum(counts)])
        return ends[cuts[1:]] - ends[cuts[:-1]], pool[places[:total]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a string array's texts, one after the other, and how many each has; in blocks of bounded size."""
        texts = texts.cast(pa.large_string())
        sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)) if len(texts) else np.zeros(0, np.int64)
        ids, lengths, a = [], [], 0
        while a < len(texts):
            b = a + max(1, int(np.searchsorted(np.cumsum(sizes[a : a + 100_000]), BLOCK_BYTES, "right")))
            if sizes[a] > BLOCK_BYTES:
                own = [self._block(pa.array([part]), first=k == 0)[0] for k, part in enumerate(self._pieces(texts[a].as_py() or ""))]
                got, count = np.concatenate(own), np.array([sum(map(len, own))])
                b = a + 1
            else:
                got, count = self._block(texts.slice(a, b - a).cast(pa.string()))
            ids.append(got)
            lengths.append(count)
            a = b
        return (np.concatenate(ids), np.concatenate(lengths)) if ids else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _pieces(self, text: str) -> Iterator[str]:
        """A long text in pieces cut at single blanks, which go; where none lies near, a piece is longer."""
        if not self.by_unit or any(x in text for x in self.special):
            yield text
            return
        at, step = 0, BLOCK_BYTES // 4
        while len(text) - at > 2 * step:
            m = _CUT.search(text, at + step)
            if not m:
                break
            yield text[at : m.start()]
            at = m.end()
        yield text[at:]

    def _block(self, texts: pa.Array, first: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of a block. Pieces of a text after its first stand behind a blank."""
        texts = pc.fill_null(texts, "")
        if not self.by_unit:
            own = [self._ids(t) for t in texts.to_pylist()]
            return np.concatenate(own), np.array([len(x) for x in own], np.int64)
        odd: dict[int, np.ndarray] = {}
        strange = np.zeros(len(texts), bool)
        for mark in ["\x00", "\x01", *self.special]:
            strange |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(strange).tolist():
            text = texts[i].as_py()
            odd[i] = self._ids(text if first else f" {text}")
        if odd:
            texts = pc.if_else(pa.array(strange), "", texts)
        spaced = pc.match_substring_regex(texts, _SPACED)
        plain = pc.replace_substring(texts, "\n", " \n")
        if pc.any(spaced).as_py():
            plain = pc.replace_with_mask(plain, spaced, pa.array([_respaced(t) for t in texts.filter(spaced).to_pylist()], pa.string()))
        # A line feed before each text, whose id goes again, makes its first unit one like the others.
        lists = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\n"), plain, "") if first else plain, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
        offsets = offsets - offsets[0]
        of = coded.indices.to_numpy()
        starts, sizes, pool = self._known(coded.dictionary)
        lengths, begins = sizes[of], starts[of]
        if first:
            lengths[offsets[:-1]] -= 1
            begins[offsets[:-1]] += 1
        total, places = _gathered(begins, lengths)
        ids = pool[places[:total]]
        ends = np.concatenate([[0], np.cumsum(lengths)])[offsets]
        counts = np.diff(ends)
        if odd:
            out, last = [], 0
            for i, own in odd.items():
                out += [ids[last : ends[i]], own]
                last, counts[i] = ends[i], len(own)  # the emptied text has no ids
            ids = np.concatenate([*out, ids[last:]])
        return ids, counts

    def _known(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each unit's ids begin and how many it has, in a pool; unknown ones are learned, and short ones kept for the next blocks."""
        names = _names(units)
        at = np.minimum(np.searchsorted(self.names, names), max(0, len(self.names) - 1))
        starts, sizes = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        old = np.zeros(len(units), bool)
        if len(self.names):
            at = self.order[at]
            old = pc.equal(self.units.take(pa.array(at)), units).to_numpy(zero_copy_only=False)
            starts[old], sizes[old] = self.starts[at[old]], self.sizes[at[old]]
        fresh = np.flatnonzero(~old)
        learned = units.take(pa.array(fresh))
        starts[fresh], sizes[fresh], more = self._learned(learned)
        starts[fresh] += len(self.pool)
        pool = np.concatenate([self.pool, more])
        short = fresh[pc.binary_length(learned).to_numpy() <= LONGEST_UNIT]
        keep = short if len(self.units) + len(short) <= KNOWN_UNITS else np.flatnonzero(pc.binary_length(units).to_numpy() <= LONGEST_UNIT)[:KNOWN_UNITS]
        if keep is not short:
            self._forget()
        total, places = _gathered(starts[keep], sizes[keep])
        # Of units whose names collide the first is found, so the others are learned again where they occur.
        order = np.argsort(names[keep], kind="stable")
        own, to = names[keep][order], np.searchsorted(self.names, names[keep][order], "right")
        self.names, self.order = np.insert(self.names, to, own), np.insert(self.order, to, len(self.units) + order)
        self.units = pa.concat_arrays([self.units, units.take(pa.array(keep))])
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes[keep]) - sizes[keep]])
        self.sizes = np.concatenate([self.sizes, sizes[keep]])
        self.pool = np.concatenate([self.pool, pool[places[:total]]])
        return starts, sizes, pool

    def _forget(self) -> None:
        self.units, self.names, self.order = pa.array([], pa.string()), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.starts, self.sizes, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)


def _names(units: pa.Array) -> np.ndarray:
    """A number for each unit, of its first and last eight bytes and its length; different units seldom share one."""
    offsets = np.frombuffer(units.buffers()[1], np.int32, len(units) + 1, units.offset * 4).astype(np.int64) if len(units) else np.zeros(1, np.int64)
    raw = np.concatenate([np.zeros(8, np.uint8), np.frombuffer(units.buffers()[2] or b"", np.uint8), np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    size = np.diff(offsets)
    over = np.uint64(8) * np.clip(8 - size, 0, 7).astype(np.uint64)  # bits of the neighbours of short units; an empty one is told by its length
    first, last = eight[offsets[:-1] + 8] << over, eight[offsets[1:]] >> over
    return mixed(mixed(first) + last * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64))


def _gathered(starts: np.ndarray, lengths: np.ndarray) -> tuple[int, np.ndarray]:
    """How many places ranges have in all, and these places in order."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return total, np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mixed(np.ascontiguousarray(keys, dtype=np.int64), 977) >> np.uint64(32)).astype(np.uint32)


#: A block of a level: the bits set before it on all levels, and 512 bits.
RANKED = np.dtype([("rank", "<u8"), ("bits", "u1", 64)])


class PerfectHash:
    """A minimal perfect hash of distinct int64 keys: levels of bits, where a key sits at the first level on which no other remaining key hashes to its bit; its slot is that bit's rank."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.size = int(levels[-1]["rank"][-1]) + int(np.bitwise_count(levels[-1]["bits"][-1]).sum()) if levels else 0

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left, base = [], keys.astype(np.int64), 0
        while len(left):
            size = -(-2 * len(left) // 512) * 512
            at = (_mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            level = np.zeros(size // 512, RANKED)
            level["bits"] = np.packbits(alone, bitorder="little").reshape(-1, 64)
            upto = np.cumsum(np.bitwise_count(level["bits"]).sum(axis=1, dtype=np.int64))
            level["rank"] = base + np.concatenate([[0], upto[:-1]])
            base += int(upto[-1])
            levels.append(level)
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level has it."""
        keys = np.ascontiguousarray(keys, dtype=np.int64)
        out, todo = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for i, level in enumerate(self.levels):
            if not len(todo):
                break
            at = (_mixed(keys[todo], i) % np.uint64(len(level) * 512)).astype(np.int64)
            block = level[at >> 9]
            hit = (block["bits"][np.arange(len(at)), (at & 511) >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            out[todo[hit]] = _ranks(block[hit], at[hit] & 511)
            todo = todo[~hit]
        return out


def _ranks(blocks: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """The rank of one set bit of each block."""
    before = np.arange(512) < bit[:, None]
    return blocks["rank"].astype(np.int64) + (np.unpackbits(blocks["bits"], axis=1, bitorder="little") & before).sum(axis=1, dtype=np.int64)


class ShardWriter:
    """Streams one shard to its place; only the keys and lengths of its documents stay in memory, as arrays."""

    def __init__(self, filesystem: fs.FileSystem, path: str, width: int = 4):
        self.width, self.out = width, filesystem.open_output_stream(path)
        self.at = 0
        self._write(MAGIC + struct.pack("<II", VERSION, width))
        self.keys: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.nulls = 0

    def _write(self, raw: bytes) -> int:
        """Where the written bytes begin."""
        at = self.at
        self.out.write(raw)
        self.at += len(raw)
        return at

    def add(self, keys: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Documents in key order, null keys first, with their ids one after the other."""
        self.nulls += keys.null_count
        self.keys.append(pc.fill_null(keys, 0).to_numpy(zero_copy_only=False).astype("<i8"))
        self.lengths.append(lengths.astype("<u4"))
        self._write(ids.astype(f"<u{self.width}").tobytes())

    def finish(self) -> dict:
        keys, lengths = np.concatenate([*self.keys, np.zeros(0, "<i8")]), np.concatenate([*self.lengths, np.zeros(0, "<u4")])
        total, own = int(lengths.sum(dtype=np.int64)), keys[self.nulls :]
        distinct, first = np.unique(own, return_index=True)
        table = PerfectHash.build(distinct)
        slots = np.zeros(table.size, SLOT)
        if len(distinct):
            at, first = table.slots(distinct), first + self.nulls
            slots["print"][at], slots["length"][at], slots["start"][at] = fingerprints(distinct), lengths[first], (np.cumsum(lengths, dtype=np.int64) - lengths)[first]
        at_keys, at_lengths = self._write(keys.astype("<i8").tobytes()), self._write(lengths.astype("<u4").tobytes())
        places = [(self._write(level.tobytes()), len(level)) for level in table.levels]
        at_slots = self._write(slots.tobytes())
        at_levels = self._write(b"".join(struct.pack("<QQ", *p) for p in places))
        self._write(TAIL.pack(MAGIC, len(keys), total, self.nulls, at_keys, at_lengths, at_slots, at_levels, len(places)))
        self.out.close()
        return {"n_docs": len(keys), "n_tokens": total, "first_key": int(own[0]) if len(own) else None, "last_key": int(own[-1]) if len(own) else None}


class Shard:
    """Reads a shard. Opening it reads its tail and the directory of levels; a lookup reads a block a level, a slot and the ids."""

    def __init__(self, filesystem: fs.FileSystem, path: str):
        self.file = filesystem.open_input_file(path)
        size = self.file.size()
        self.width = struct.unpack("<8sII", self._read(0, 16))[2]
        magic, self.n_docs, self.n_tokens, self.nulls, self.at_keys, self.at_lengths, self.at_slots, at_levels, n = TAIL.unpack(self._read(size - TAIL.size, TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token shard")
        self.places = [struct.unpack("<QQ", self._read(at_levels + 16 * i, 16)) for i in range(n)]
        self.table: PerfectHash | None = None

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _slots(self, at: int, count: int) -> np.ndarray:
        return np.frombuffer(self._read(self.at_slots + SLOT.itemsize * at, SLOT.itemsize * count), SLOT)

    def find(self, key: int) -> tuple[int, int] | None:
        """Offset and length of the document with this key, by reading one block a level and one slot."""
        one = np.array([key], np.int64)
        for level, (at, blocks) in enumerate(self.places):
            bit = int(_mixed(one, level)[0] % np.uint64(blocks * 512))
            block = np.frombuffer(self._read(at + RANKED.itemsize * (bit >> 9), RANKED.itemsize), RANKED)
            if block["bits"][0, (bit & 511) >> 3] >> (bit & 7) & 1:
                slot = self._slots(int(_ranks(block, np.array([bit & 511]))[0]), 1)[0]
                return (int(slot["start"]), int(slot["length"])) if slot["print"] == fingerprints(one)[0] else None
        return None

    def find_all(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key is here, its offset and its length, with the hash and the slots in memory."""
        if self.table is None:
            self.table = PerfectHash([np.frombuffer(self._read(at, RANKED.itemsize * n), RANKED) for at, n in self.places])
            self.slots = self._slots(0, self.table.size)
        at = self.table.slots(keys)
        if not len(self.slots):
            return np.zeros(len(at), bool), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        slots = self.slots[np.maximum(at, 0)]
        return (at >= 0) & (slots["print"] == fingerprints(keys)), slots["start"].astype(np.int64), slots["length"].astype(np.int64)

    def documents(self, first: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and lengths of documents in payload order."""
        return np.frombuffer(self._read(self.at_keys + 8 * first, 8 * count), "<i8"), np.frombuffer(self._read(self.at_lengths + 4 * first, 4 * count), "<u4").astype(np.int64)

    def ids(self, start: int, count: int) -> np.ndarray:
        return np.frombuffer(self._read(16 + self.width * start, self.width * count), f"<u{self.width}").astype("<u4")

    def get(self, key: int) -> np.ndarray | None:
        """The ids of the document with this key, in constant time."""
        found = self.find(key)
        return None if found is None else self.ids(*found)


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder's URI."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


_ROW = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64())])


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """Encodes every whole text and writes shards under ``out`` (a folder all executors share); returns the manifest.

    One shuffle of key and text, by ranges of the key. A retried task writes a file of another name, and only files
    named in the manifest, itself a written table, count.
    """
    ship(docs.sparkSession)
    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].cast("string").alias("text"))
    rows = (rows.repartitionByRange(shards, "key") if shards else rows.repartitionByRange("key")).sortWithinPartitions("key", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, writer = encoder(tokenizer), None
        for batch in batches:
            for part in _sliced(batch):
                if writer is None:
                    filesystem, folder = store(out)
                    filesystem.create_dir(folder, recursive=True)
                    shard = TaskContext.get().partitionId()
                    path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.ids"
                    writer = ShardWriter(filesystem, path, enc.width(end_id))
                ids, lengths = enc.encode(part.column(1))
                writer.add(part.column(0), np.insert(ids, np.cumsum(lengths), np.uint32(end_id)), lengths + 1)
        if writer:
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path} | writer.finish()], schema=_ROW)

    return written(rows.mapInArrow(tidied(encode), MANIFEST), f"{out}/manifest")


def _sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about a block's bytes of text each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + BLOCK_BYTES, "right")))
        yield batch.slice(a, b - a)
        a = b


def read_tokens(spark: SparkSession, manifest: DataFrame, out: str) -> DataFrame:
    """A row for each document of the manifest's files: doc_id, start, n_tokens, ids_crc32, and the shard.

    Each key's offset and length come from its slot in the shard's index; further rows of a key, and those without one,
    follow by the table of lengths.
    """
    ship(spark)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # As many tasks as shards: by their bytes, the manifest's rows would all be read in one.
    placed = placed.select("shard", "path", "base").repartition(max(1, manifest.count()))
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "shard"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = store(out)
        for batch in batches:
            for row in batch.to_pylist():
                shard, step, last, end = Shard(filesystem, row["path"]), 512, None, 0
                for a in range(0, shard.n_docs, step):
                    count = min(shard.n_docs - a, step)
                    keys, sizes = shard.documents(a, count)
                    null = np.arange(a, a + count) < shard.nulls
                    new = ~null & np.concatenate([[last is None or a <= shard.nulls or keys[0] != last], keys[1:] != keys[:-1]])
                    new[np.flatnonzero(~null)[:1]] |= a <= shard.nulls
                    found, start, length = shard.find_all(keys)
                    if not found[new].all():
                        raise ValueError(f"the index of {row['path']} doesn't find its keys")
                    start, length = np.where(new, start, -1), np.where(new, length, sizes)
                    for i in np.flatnonzero(~new).tolist():
                        start[i] = start[i - 1] + length[i - 1] if i else end
                    last, end = keys[-1], int(start[-1] + length[-1])
                    # Documents lie one after the other, so a block's ids are read at once.
                    ids, cuts = shard.ids(int(start[0]), end - int(start[0])).tobytes(), (start - start[0]) * 4
                    crcs = [zlib.crc32(ids[x:y]) for x, y in zip(cuts.tolist(), (cuts + length * 4).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, mask=null), pa.array(start + row["base"]), pa.array(length), pa.array(crcs, pa.int64()), pa.array([row["shard"]] * count, pa.int32())], names=names)

    return placed.mapInArrow(tidied(read), "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def lookup(manifest: DataFrame, out: str, key: int) -> np.ndarray | None:
    """The ids of one document of a written table, from the one shard whose keys reach over it."""
    row = manifest.where((F.col("first_key") <= key) & (F.col("last_key") >= key)).orderBy("shard").first()
    return None if row is None else Shard(store(out)[0], row["path"]).get(key)


def token_table(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2, out: str | None = None) -> DataFrame:
    """Writes the shards and returns what reading them back gives."""
    out = out or f"{shared_dir(spark)}/tokens"
    return read_tokens(spark, write_tokens(docs, out, tokenizer, end_id), out)
