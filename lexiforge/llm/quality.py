"""Quality: attention-based multiple-instance learning over the passages of a document.

Every passage of ``WORDS`` words of a text is encoded from its statistics and, through a learned projection, from the
shares of its hashed words and letter trigrams of words; gated attention weighs the passages, and the weighted encoding
gives the document's score. Only documents have labels. The network is small and is trained in NumPy on about ``each``
labelled documents of either label; all passages of all documents are scored.

Defined cases: a null, empty or blank text is one passage of zeros and gets the network's score for that; null labels
are left out, and so are documents whose labels contradict each other; rows that share a doc_id are scored one by one;
texts of any length are encoded whole, a word of more than 512 kB as several; without labels of both values every score
is 0.5 (or the only label's share); an empty table gives no rows; columns other than those named aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .learning import fold, learned_from, marked, sampled, sigmoid
from .shingles import BLOCK, block_words
from .work import ship, tidied

WORDS, EACH, HIDDEN, ROUNDS = 60, 1200, 16, 250
#: Classes of bytes whose shares are features.
_CLASSES = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "\n", ".,", "!?", "|", "#%&$*@^~=+<>{}[]\\/_", "\"'();:-"]
_OF = np.full(256, len(_CLASSES) + 1, np.int64)
for _i, _chars in enumerate(_CLASSES):
    _OF[[ord(x) for x in _chars]] = _i
_OF[[32, 9, 11, 12, 13]] = len(_CLASSES)
_KINDS = len(_CLASSES) + 2
SIZE = _KINDS + 9
#: Places of hashed words and their beginnings; passages that are encoded at a time.
HASHED, _AT_ONCE = 128, 2048


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a text of any length; blocks end at white space where there is any."""
    hashes, starts, at = [], [], 0
    while at < len(raw):
        end = min(len(raw), at + BLOCK)
        if end < len(raw):
            blanks = np.flatnonzero(_OF[raw[at:end]] == len(_CLASSES))
            end = at + int(blanks[-1]) + 1 if len(blanks) else end
        h, start = block_words(raw[at:end])
        hashes.append(h)
        starts.append(start + at)
        at = end
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _repeated(h: np.ndarray) -> np.ndarray:
    """Which values occurred before in the sequence."""
    out = np.ones(len(h), bool)
    out[np.unique(h, return_index=True)[1]] = False
    return out


def passages(text: str | None) -> np.ndarray:
    """A row of features for each passage; one of zeros for a text without words."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    h, start = _words(raw)
    if not len(h):
        return np.zeros((1, SIZE + HASHED), np.float32)
    seen = _repeated(h)
    again = np.concatenate([[False], _repeated(h[:-1] * np.uint64(3) + h[1:])])
    same = np.concatenate([[False], h[1:] == h[:-1]])
    # A passage reaches from its first word to the next one's, the first from the text's begin.
    edge = np.append(start[::WORDS], len(raw))
    edge[0] = 0
    step = WORDS * _AT_ONCE
    parts = []
    for a in range(0, len(h), step):
        b = min(len(h), a + step)
        low, high = int(edge[a // WORDS]), int(edge[-(-b // WORDS)])
        parts.append(_encoded(raw[low:high], edge[a // WORDS : -(-b // WORDS) + 1] - low, h[a:b], start[a:b] - low, seen[a:b], again[a:b], same[a:b]))
    return np.concatenate(parts)


def _encoded(raw: np.ndarray, edge: np.ndarray, h: np.ndarray, start: np.ndarray, seen: np.ndarray, again: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Features of neighbouring passages that begin at ``edge``, with their words' hashes, places and marks."""
    n = len(edge) - 1
    of = np.arange(len(h)) // WORDS
    passage = np.repeat(np.arange(n), np.diff(edge))
    share = np.bincount(passage * _KINDS + _OF[raw], minlength=n * _KINDS).reshape(n, _KINDS).astype(np.float64)
    length = np.diff(edge).astype(np.float64)
    size = np.bincount(of, minlength=n).astype(np.float64)
    count = lambda x: np.bincount(of, x, n) / size
    letters = share[:, 0] + share[:, 1] + share[:, -1]
    first = raw[start]
    last = raw[np.append(start[1:], len(raw)) - 2] if len(start) > 1 else raw[-1:]
    pairs = np.unique(of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ h, return_index=True)[1]
    extra = [
        np.log(length / size) - 1.8,
        count(same),
        np.bincount(of[pairs], minlength=n) / size,
        count(seen),
        count(again),
        share[:, 0] / np.maximum(1, letters),
        count((_OF[first] >= 5) & (_OF[first] <= 8)),
        count((_OF[last] >= 5) & (_OF[last] <= 8)),
        size / WORDS,
    ]
    # Hashed words, and the first three bytes of words, in halves of the table.
    word = of * HASHED + (h & np.uint64(HASHED // 2 - 1)).astype(np.int64)
    place = start[:, None] + np.arange(3)
    b = np.where(place < edge[of + 1][:, None], raw[np.minimum(place, len(raw) - 1)], 0).astype(np.int64)
    begin = of * HASHED + HASHED // 2 + ((b[:, 0] * 961 + b[:, 1] * 31 + b[:, 2]) * 2654435761 >> 8) % (HASHED // 2)
    hashed = np.bincount(np.concatenate([word, begin]), minlength=n * HASHED).reshape(n, HASHED) / np.sqrt(size)[:, None]
    return np.column_stack([share / length[:, None] * 4, *extra, hashed]).astype(np.float32)


def _forward(x: np.ndarray, row: np.ndarray, n: int, p: dict[str, np.ndarray]) -> tuple:
    h = np.tanh(x @ p["w"] + p["wb"])
    t, g = np.tanh(h @ p["v"] + p["vb"]), sigmoid(h @ p["u"] + p["ub"])
    e = (t * g) @ p["a"]
    top = np.full(n, -np.inf)
    np.maximum.at(top, row, e)
    e = np.exp(e - top[row])
    a = e / np.bincount(row, e, n)[row]
    z = np.zeros((n, h.shape[1]))
    np.add.at(z, row, a[:, None] * h)
    return h, t, g, a, z, z @ p["c"] + p["cb"]


def standardised(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.clip((x - mean.astype(np.float32)) / spread.astype(np.float32), -6, 6)


def fit(bags: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters of the network by full-batch Adam on the weighted log loss; features are standardised first."""
    x, row, n = np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), len(bags)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    spread[SIZE:] *= np.sqrt(HASHED / SIZE)  # all hashed places together weigh what the statistics do
    x = standardised(x, mean, spread)
    rng = np.random.Generator(np.random.PCG64(17))
    make = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    d, k = x.shape[1], HIDDEN
    p = {"w": make(d, k), "wb": np.zeros(k), "v": make(k, k), "vb": np.zeros(k), "u": make(k, k), "ub": np.zeros(k), "a": make(k), "c": make(k), "cb": np.zeros(())}
    m, v = ({name: np.zeros_like(q) for name, q in p.items()} for _ in range(2))
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) / n
    for step in range(1, ROUNDS + 1):
        h, t, g, a, z, s = _forward(x, row, n, p)
        ds = weight * (sigmoid(s) - labels)
        dz = ds[:, None] * p["c"]
        da = (dz[row] * h).sum(axis=1)
        de = a * (da - np.bincount(row, a * da, n)[row])
        dt, dg = de[:, None] * p["a"] * g * (1 - t * t), de[:, None] * p["a"] * t * g * (1 - g)
        dh = (a[:, None] * dz[row] + dt @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
        grads = {"w": x.T @ dh, "wb": dh.sum(axis=0), "v": h.T @ dt, "vb": dt.sum(axis=0), "u": h.T @ dg, "ub": dg.sum(axis=0), "a": (t * g).T @ de, "c": z.T @ ds, "cb": ds.sum()}
        for name, q in p.items():
            grad = grads[name] + 1e-4 * q
            m[name] = 0.9 * m[name] + 0.1 * grad
            v[name] = 0.99 * v[name] + 0.01 * grad**2
            p[name] = q - 0.02 * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)
    return p | {"mean": mean, "spread": spread}


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, out: int = 0, each: int = EACH) -> dict[str, np.ndarray] | float:
    """Parameters from about ``each`` labelled documents of either label, none of the fold left out; a constant without both labels."""
    ship(docs.sparkSession)
    texts = learned_from(docs, sampled(marked(labels, "quality", folds, out), "doc_id", "label", each))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                x = [passages(t.as_py()).ravel() for t in part.column(3)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(x, pa.list_(pa.float32()))], names=["doc_id", "label", "hash", "x"])

    got = texts.mapInArrow(tidied(run), "doc_id long, label int, hash long, x array<float>").toArrow().sort_by([("doc_id", "ascending"), ("hash", "ascending")])
    y = np.array(got.column("label").to_pylist(), dtype=np.float64)
    if len(y) == 0 or y.min() == y.max():
        return 0.5 if len(y) == 0 else float(np.clip(y.mean(), 0.01, 0.99))
    return fit([x.values.to_numpy().reshape(-1, SIZE + HASHED) for x in got.column("x")], y)


def chances(texts: list[str | None], p: dict[str, np.ndarray]) -> np.ndarray:
    """The chance of label 1 for each text."""
    bags = [passages(t) for t in texts]
    x = standardised(np.concatenate(bags), p["mean"], p["spread"])
    return sigmoid(_forward(x, np.repeat(np.arange(len(bags)), [len(b) for b in bags]), len(bags), p)[-1]).astype(np.float64)


def score(docs: DataFrame, model: dict[str, np.ndarray] | float, folds: int, out: int, cut: float) -> DataFrame:
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few kilobytes
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (fold(docs["doc_id"], folds) == out).alias("held_out"), docs["text"].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                s = np.full(part.num_rows, p) if isinstance(p, float) else chances([t.as_py() for t in part.column(2)], p)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(tidied(run), "doc_id long, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, folds: int = 5, out: int = 0, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= cut) of every row; learns from the folds other than ``out``."""
    return score(docs, learn(docs, labels, folds, out), folds, out, cut)
