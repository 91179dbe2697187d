"""Toxicity: a linear classifier on words and word beginnings, regularised by counterfactual mentions of groups.

A text's features are the hashed words it contains and their first 3 to 6 bytes, each once, so length doesn't dilute
them. For each training text a counterfactual twin is made: a sentence that mentions a group mentions another one
instead, or, where the text mentions none, a neutral mention is put in. Besides the log loss, squared differences
between the scores of twins are penalised, as are absolute and squared weights. Scores are calibrated by a logistic
curve, fitted with both labels at equal weight on scores of rows that the scoring model hasn't learned from.

Defined cases: a null or empty text has no features and gets the intercept's score; labels that are null are left out,
and so are documents whose labels contradict each other; rows that share a doc_id are scored one by one; without labels
of both values every score is 0.5 (or the only label's share); an empty table gives no rows; columns other than those
named aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .learning import Rows, fold, learned_from, marked, sampled, sigmoid
from .shingles import block_words, mixed
from .work import ship, tidied

SIZE, EACH, ROUNDS = 1 << 17, 1500, 150
L1, L2, TWINS = 2e-4, 1e-5, 1.0
PREFIXES = (3, 4, 5, 6)
#: Terms for groups of people, as plain mentions, by language.
GROUPS = {
    "en": ["women", "men", "muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "black", "white", "asian", "latino", "african", "american", "european", "immigrant", "refugee", "gay", "lesbian", "straight", "transgender", "disabled", "deaf", "blind", "young", "old", "teenage", "poor", "rich"],
    "de": ["frauen", "männer", "muslime", "christen", "juden", "schwarze", "weiße", "asiaten", "einwanderer", "flüchtlinge", "schwule", "lesben", "behinderte"],
    "fr": ["femmes", "hommes", "musulmans", "chrétiens", "juifs", "noirs", "blancs", "asiatiques", "immigrés", "réfugiés", "homosexuels", "lesbiennes", "handicapés"],
    "es": ["mujeres", "hombres", "musulmanes", "cristianos", "judíos", "negros", "blancos", "asiáticos", "inmigrantes", "refugiados", "homosexuales", "lesbianas", "discapacitados"],
}
_TERMS = sorted({t for terms in GROUPS.values() for t in terms})
_MENTION = re.compile(r"\b(?:" + "|".join(map(re.escape, _TERMS)) + r")\b", re.IGNORECASE)


def _strip(text: str) -> bytes:
    """The text's bytes with ASCII marks blanked, so that words stand alone."""
    return text.encode().translate(_MARKS)


_MARKS = bytes(32 if chr(b) in ".,;:!?\"'()[]{}<>|*#%&$/\\=+-_~`^@" else b for b in range(256))


def features(text: str | None) -> np.ndarray:
    """The sorted places of a text's features."""
    if not text:
        return np.zeros(0, np.int64)
    out = []
    raw = _strip(text)
    for a in range(0, len(raw), 1 << 18):
        # A piece begins a little before the last one's end, so that a word at the cut is whole in one of them.
        piece = np.frombuffer(raw[max(0, a - 64) : a + (1 << 18)], np.uint8)
        words, start = block_words(piece)
        out.append(_places(words, 0))
        for n in PREFIXES:
            out.append(_places(_prefix_words(piece, start, n), n))
    return np.unique(np.concatenate(out))


def _places(h: np.ndarray, kind: int) -> np.ndarray:
    h = mixed(np.unique(h) + np.uint64(kind * 0x9E3779B97F4A7C15 % 2**64))
    return (h & np.uint64(SIZE - 1)).astype(np.int64)


def _prefix_words(raw: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the first n bytes of each word of at least n bytes."""
    start = start[start + n <= len(raw)]
    b = raw[start[:, None] + np.arange(n)]
    b = np.where((b >= 65) & (b <= 90), b + 32, b)
    keep = ~((b == 32) | ((b >= 9) & (b <= 13))).any(axis=1)
    h = np.zeros(int(keep.sum()), np.uint64)
    for j in range(n):
        h = mixed(h + b[keep, j].astype(np.uint64) + np.uint64(1))
    return h


def twin(text: str, seed: int) -> str:
    """The text with every mention of a group exchanged, or, without one, with a neutral mention after a sentence."""
    rng = np.random.Generator(np.random.PCG64(seed))
    term = _TERMS[int(rng.integers(len(_TERMS)))]
    if _MENTION.search(text):
        return _MENTION.sub(lambda m: term if m[0].lower() != term else _TERMS[(_TERMS.index(term) + 1) % len(_TERMS)], text)
    ends = [m.end() for m in re.finditer(r"[.!?\n]", text)] or [len(text)]
    at = ends[int(rng.integers(len(ends)))]
    return f"{text[:at]} {term} {text[at:]}"


def contrast(rows: Rows, labels: np.ndarray, size: int = SIZE) -> np.ndarray:
    """How much likelier each feature is under either label, as the logarithm of the smoothed ratio; 0 for features of fewer than 3 texts.

    Scaling features with it keeps words that both labels share from carrying weight.
    """
    yes = np.bincount(rows.places, labels[rows.row], size)
    no = np.bincount(rows.places, 1 - labels[rows.row], size)
    ratio = np.log((yes + 0.5) / (labels.sum() + 1)) - np.log((no + 0.5) / ((1 - labels).sum() + 1))
    return np.where(yes + no >= 3, ratio, 0.0)


def fit(rows: Rows, labels: np.ndarray, more: Rows, less: Rows, size: int = SIZE) -> np.ndarray:
    """Weights, the intercept last, by proximal gradient steps of Adam's scale; ``more`` and ``less``: what twins gain and lose."""
    w, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    for t in range(1, ROUNDS + 1):
        g = weight * (sigmoid(rows.dot(w) + b) - labels) / len(labels)
        d = (more.dot(w) - less.dot(w)) * (2 * TWINS / max(1, more.n))
        grad = rows.back(g, size) + more.back(d, size) - less.back(d, size) + 2 * L2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * g.sum(), 0.99 * vb + 0.01 * g.sum() ** 2
        rate = 0.05
        scale = np.sqrt(v / (1 - 0.99**t)) + 1e-6
        w = w - rate * (m / (1 - 0.9**t)) / scale
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * L1 / np.maximum(scale, 1e-4))
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    return np.append(w, b)


def trained(at: list[np.ndarray], more: list[np.ndarray], less: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Weights of all features, the intercept last, from rows' features, what their twins gain and lose, and labels."""
    ratio = contrast(Rows(at), y)
    # Features without contrast have no weight, so only the others take part.
    used = np.flatnonzero(ratio)
    place = np.full(SIZE, -1, np.int64)
    place[used] = np.arange(len(used))
    kept = [[p[p >= 0] for p in (place[x] for x in rows)] for rows in (at, more, less)]
    w = fit(*_ordered(kept, ratio[used], y), len(used))
    out = np.zeros(SIZE + 1)
    out[used], out[-1] = w[:-1] * ratio[used], w[-1]
    return out


def _ordered(kept: list[list[np.ndarray]], ratio: np.ndarray, y: np.ndarray) -> tuple[Rows, np.ndarray, Rows, Rows]:
    own, more, less = (Rows(rows, [ratio[x] for x in rows]) for rows in kept)
    return own, y, more, less


def calibration(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve that fits labels best, each label's rows weighing the same in all; (1, 0) if it doesn't rise."""
    yes, no = y.sum(), len(y) - y.sum()
    goal = np.where(y == 1, (yes + 1) / (yes + 2), 1 / (no + 2))
    weight = np.where(y == 1, 0.5 / yes, 0.5 / no)
    x, beta = np.column_stack([logits, np.ones(len(y))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ beta)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (weight * (p - goal)))
        beta = beta - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 and np.isfinite(beta).all() else (1.0, 0.0)


def fitted(at: list[np.ndarray], more: list[np.ndarray], less: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Calibrated weights: those of all rows, scaled by the curve that fits the scores of each third by the other two."""
    w, logits, third = trained(at, more, less, y), np.zeros(len(y)), np.arange(len(y)) % 3
    for k in range(3):
        own = np.flatnonzero(third != k)
        if y[own].min() == y[own].max():
            return w
        v = trained([at[i] for i in own], [more[i] for i in own], [less[i] for i in own], y[own])
        for i in np.flatnonzero(third == k):
            logits[i] = v[at[i]].sum() + v[-1]
    slope, shift = calibration(logits, y)
    w = w * slope
    w[-1] += shift
    return w


def learn(docs: DataFrame, labels: DataFrame, folds: int = 3, out: int = 1, each: int = EACH) -> np.ndarray:
    """Weights from about ``each`` labelled documents of either label, none of the fold left out."""
    ship(docs.sparkSession)
    texts = learned_from(docs, sampled(marked(labels, "toxic", folds, out), "doc_id", "label", each))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                sides: tuple[list, list, list] = ([], [], [])
                for i, text in zip(part.column(0).to_pylist(), part.column(3).to_pylist(), strict=True):
                    own, other = features(text), features(twin(text or "", i or 0))
                    for side, x in zip(sides, (own, np.setdiff1d(other, own), np.setdiff1d(own, other)), strict=True):
                        side.append(x)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(x, pa.list_(pa.int32())) for x in sides)], names=["doc_id", "label", "hash", "at", "more", "less"])

    got = texts.mapInArrow(tidied(run), "doc_id long, label int, hash long, at array<int>, more array<int>, less array<int>").toArrow().sort_by([("doc_id", "ascending"), ("hash", "ascending")])
    y = np.array(got.column("label").to_pylist(), dtype=np.float64)
    if len(y) == 0 or y.min() == y.max():
        share = 0.5 if len(y) == 0 else np.clip(y.mean(), 0.01, 0.99)
        return np.append(np.zeros(SIZE), np.log(share / (1 - share)))
    return fitted(*([x.values.to_numpy().astype(np.int64) for x in got.column(c)] for c in ("at", "more", "less")), y)


def score(docs: DataFrame, weights: np.ndarray, folds: int, out: int, cut: float) -> DataFrame:
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # its size is that of the feature table
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (fold(docs["doc_id"], folds) == out).alias("held_out"), docs["text"].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                s = sigmoid(np.array([w[features(t.as_py())].sum() + w[-1] for t in part.column(2)]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(tidied(run), "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, out: int = 1, cut: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= cut) of every row; learns from the folds other than ``out``."""
    return score(docs, learn(docs, labels, folds, out), folds, out, cut)
