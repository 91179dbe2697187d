"""Hashes of words and word shingles over whole texts, in NumPy on their UTF-8 bytes.

Words are runs of bytes other than blank and U+0009-U+000D after lower-casing A-Z. A word's hash is a polynomial over
randomly assigned byte values modulo 2^64, mixed at the end; prefix sums give all words of a block at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240229))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True
_VALUES = (_RNG.integers(1, 2**63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_VALUES = _VALUES[_LOWER]
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes hashed at a time; longer texts go in pieces cut at white space.
BLOCK = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(_BASE, BLOCK + 1), _powers(_INVERSE, BLOCK + 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def block_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a block."""
    edge = np.diff(np.concatenate([[True], _BLANK[raw], [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[raw] * _POW[: len(raw)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * _INV[start] + (end - start).astype(np.uint64)), start


def _long_words(raw: np.ndarray) -> np.ndarray:
    """Word hashes of a text of any length; words longer than a block are hashed piece by piece."""
    out, at, carry = [], 0, None
    while at < len(raw):
        end = min(len(raw), at + BLOCK)
        whole = end == len(raw)
        if not whole:
            blanks = np.flatnonzero(_BLANK[raw[at:end]])
            end = at + int(blanks[-1]) + 1 if len(blanks) else end
            whole = len(blanks) > 0
        words, _ = block_words(raw[at:end])
        if carry is not None:
            if len(words) and not _BLANK[raw[at]]:
                words[:1] = mixed(words[:1] + carry * np.uint64(3))
            else:
                words = np.concatenate([carry, words])
            carry = None
        if not whole:
            carry, words = words[-1:], words[:-1]
        out.append(words)
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def words_of(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """For each text of a string array, its place and the hashes of its words in order; nulls have none."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    valid = np.ones(n, bool) if texts.null_count == 0 else texts.is_valid().to_numpy(zero_copy_only=False)
    i = 0
    while i < n:
        if offsets[i + 1] - offsets[i] > BLOCK // 2:
            yield i, _long_words(data[offsets[i] : offsets[i + 1]]) if valid[i] else np.zeros(0, np.uint64)
            i += 1
            continue
        j = i + 1
        while j < n and offsets[j + 1] - offsets[j] <= BLOCK // 2 and offsets[j + 1] - offsets[i] + (j - i) < BLOCK:
            j += 1
        # One blank between neighbours keeps their words apart.
        own = offsets[i : j + 1] - offsets[i] + np.arange(j - i + 1)
        raw = np.full(int(own[-1]), 32, np.uint8)
        keep = np.ones(len(raw), bool)
        keep[own[1:] - 1] = False
        raw[keep] = data[offsets[i] : offsets[j]]
        words, start = block_words(raw)
        cuts = np.searchsorted(start, own)
        for k in range(i, j):
            yield k, words[cuts[k - i] : cuts[k - i + 1]] if valid[k] else words[:0]
        i = j


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The distinct hashes of a text's k-word shingles, sorted; the whole sequence if it is shorter; none without words."""
    n = len(words)
    if n == 0:
        return words
    width = min(n, k)
    out = np.full(n - width + 1, np.uint64(width * 0x9E3779B97F4A7C15 % 2**64), np.uint64)
    for j in range(width):
        out = mixed(out * np.uint64(0xFF51AFD7ED558CCD) + words[j : n - width + 1 + j])
    return np.unique(out)
