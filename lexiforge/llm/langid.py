"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Document frequencies are counted over all learning documents. The weights are fitted with follow-the-regularised-leader
and elastic-net penalties on about ``each`` documents a language, at most ``MOST_ROWS`` in all, and a temperature is
fitted on a fifth of those.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; learning rows need a non-null language and
text; of more than ``LANGUAGES`` values of lang the most frequent ones are learned, and texts of others get the learned
one they look most like; without any learning row every text is ``und``; rows that share a key are classified one by
one; texts of any length are counted whole; an empty table gives no rows; columns other than those named aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .learning import fold, sampled
from .shingles import mixed
from .work import ship, tidied, trim

GRAMS, SIZE, EACH, PASSES = 3, 1 << 14, 700, 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.002, 0.5
UNKNOWN = "und"
#: The most frequent values of lang that are learned, and rows that the weights are fitted on.
LANGUAGES, MOST_ROWS = 200, 20_000
#: Characters that are counted at a time.
_STEP = 1 << 18
_ALPHA = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    if not _ALPHA.any():
        _ALPHA[:] = [chr(c).isalpha() for c in range(0x110000)]
    return _ALPHA


def counts(text: str | None, grams: int = GRAMS, size: int = SIZE) -> np.ndarray | None:
    """How often each hashed n-gram (n from 1 to ``grams``) of letters and word ends occurs; None without a letter."""
    if not text:
        return None
    letters = False
    total, low, before, place = None, text.lower(), np.zeros(0, np.uint64), 0
    while place < len(low):
        x = np.frombuffer(low[place : place + _STEP].encode("utf-32-le", "surrogatepass"), np.uint32)
        x = np.where(_letters()[x], x, 32).astype(np.uint64)
        place += _STEP
        if place >= len(low):
            x = np.append(x, np.uint64(32))
        # Between words stands one mark, also at both ends; pieces share the grams over their seam.
        last = before[-1] if len(before) else np.uint64(0)
        if not len(before):
            x = np.concatenate([[np.uint64(32)], x])
        x = x[~((x == 32) & (np.concatenate([[last], x[:-1]]) == 32))]
        both = np.concatenate([before, x])
        for n in range(1, grams + 1):
            own = both[max(0, len(before) - n + 1) :]
            h = np.full(max(0, len(own) - n + 1), n, np.uint64)
            for j in range(n):
                h = h * np.uint64(0x2545F4914F6CDD1D) + own[j : len(own) - n + 1 + j]
            found = np.bincount((mixed(h) >> np.uint64(40)).astype(np.int64) & (size - 1), minlength=size)
            total = found if total is None else total + found
        before = both[-(grams - 1) :] if grams > 1 else both[-1:]
        letters = letters or bool((x != 32).any())
    return total if letters else None


def frequencies(texts: DataFrame, size: int = SIZE, grams: int = GRAMS) -> tuple[np.ndarray, int]:
    """The number of texts with each n-gram, and of texts with any, over the whole one-column table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(size, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                if (c := counts(text.as_py(), grams, size)) is not None:
                    df += c > 0
                    n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([[n, *df.tolist()]])], names=["df"])

    found = texts.mapInArrow(tidied(run), "df array<long>").select(F.posexplode("df")).groupBy("pos").agg(F.sum("col").alias("n"))
    out = np.zeros(size + 1, np.int64)
    for r in found.collect():  # one row for each of the features
        out[r["pos"]] = r["n"]
    return out[1:], int(out[0])


def weighed(c: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(c)
    v = (1 + np.log(c[at])) * idf[at]
    return at, v / np.sqrt((v * v).sum())


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, k: int, size: int = SIZE) -> np.ndarray:
    """FTRL-proximal weights, one column a language; the last row holds the intercepts."""
    z, n, w = np.zeros((size + 1, k)), np.zeros((size + 1, k)), np.zeros((size + 1, k))
    rng = np.random.Generator(np.random.PCG64(5))
    for _ in range(PASSES):
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            at, v = np.append(at, size), np.append(v, 1.0)
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2 * 1e-3))
            s = v @ wi
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = v[:, None] * p[None, :]
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * wi
            n[at] = ni + g * g
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2 * 1e-3))


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature that gives the least log loss, among a grid of powers."""
    if not len(labels):
        return 1.0
    best = (np.inf, 1.0)
    for t in np.exp(np.linspace(np.log(0.05), np.log(5), 60)):
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        loss = (np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]).mean()
        best = min(best, (loss + 1e-9 * abs(np.log(t)), t))
    return float(best[1])


class Model:
    def __init__(self, names: list[str], idf: np.ndarray, weights: np.ndarray, heat: float):
        self.names, self.idf, self.weights, self.heat = names, idf, weights, heat

    def predict(self, text: str | None) -> tuple[str, float]:
        c = counts(text, size=len(self.idf)) if self.names else None
        if c is None:
            return UNKNOWN, 0.0
        at, v = weighed(c, self.idf)
        s = (v @ self.weights[at] + self.weights[-1]) / self.heat
        p = np.exp(s - s.max())
        best = int(p.argmax())
        return self.names[best], float(p[best] / p.sum())


def learn(rows: DataFrame, each: int = EACH) -> Model:
    """Fits on rows (doc_id, text, lang); all of them give document frequencies, about ``each`` a language the weights."""
    ship(rows.sparkSession)
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    df, n = frequencies(rows.select("text"))
    kinds = rows.select("lang").distinct().limit(LANGUAGES).count()
    chosen = sampled(rows.select("doc_id", "lang"), "doc_id", "lang", min(each, MOST_ROWS // max(1, kinds)), LANGUAGES).distinct()
    picked = rows.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")  # bounded by the sample's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i.as_py(), name.as_py(), key.as_py(), c) for i, text, name, key in zip(*batch.columns, strict=True) if (c := counts(text.as_py())) is not None]
            at = [np.flatnonzero(c) for *_, c in out]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([x[0] for x in out], pa.int64()), "lang": pa.array([x[1] for x in out], pa.string()), "hash": pa.array([x[2] for x in out], pa.int64()), "at": pa.array(at, pa.list_(pa.int32())), "c": pa.array([c[a].astype(np.int32) for (*_, c), a in zip(out, at, strict=True)], pa.list_(pa.int32()))})

    got = picked.select("doc_id", "text", "lang", F.xxhash64("text")).mapInArrow(tidied(run), "doc_id long, lang string, hash long, at array<int>, c array<int>").toArrow()
    if not n or not got.num_rows:
        return Model([], np.zeros(SIZE), np.zeros((SIZE + 1, 0)), 1.0)
    got = got.sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("hash", "ascending")])
    idf = np.log((1 + n) / (1 + df)) + 1
    lang = got.column("lang").to_pylist()
    names = sorted(set(lang))
    labels = np.array([names.index(x) for x in lang])
    made = []
    for at, c in zip(got.column("at"), got.column("c"), strict=True):
        at, c = at.values.to_numpy(), c.values.to_numpy()
        v = (1 + np.log(c)) * idf[at]
        made.append((at, (v / np.sqrt((v * v).sum())).astype(np.float32)))
    order = np.random.Generator(np.random.PCG64(9)).permutation(len(made))
    held, own = order[: len(made) // 5], order[len(made) // 5 :]
    w = fit([made[i] for i in own], labels[own], len(names))
    logits = np.array([made[i][1] @ w[made[i][0]] + w[-1] for i in held]).reshape(len(held), len(names))
    heat = temperature(logits, labels[held])
    del got, made, logits
    trim()
    return Model(names, idf, w, heat)


def identify(texts: Column, model: Model, spark: SparkSession) -> Column:
    """lang_pred and score of each text, as a struct; only the texts go to Python."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # its size is that of the feature table

    @F.arrow_udf("lang_pred string, score double")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            m = shared.value
            for column in columns:
                got = [m.predict(t.as_py()) for t in column]
                yield pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["lang_pred", "score"])

        return tidied(scored)(columns)

    return run(texts)


def learning_rows(docs: DataFrame, folds: int = 4, out: int = 2) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang")).where(fold(F.col("doc_id"), folds) != out)


def languages(docs: DataFrame, folds: int = 4, out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learns from the folds other than ``out``."""
    model = learn(learning_rows(docs, folds, out))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (fold(docs["doc_id"], folds) == out).alias("held_out"), identify(docs["text"].cast("string"), model, docs.sparkSession).alias("found"))
    return rows.select("doc_id", "held_out", "found.lang_pred", "found.score")


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows whose language is known with a probability of ``least`` or more, unchanged.

    Keeps by position, not by key: the decision travels with its row.
    """
    found = identify(docs["text"].cast("string"), learn(learning_rows(docs)), docs.sparkSession)
    rows = docs.select(*[docs[c].alias(f"_{i}") for i, c in enumerate(docs.columns)], found.alias("_found"))
    rows = rows.where((F.col("_found.lang_pred") != UNKNOWN) & (F.col("_found.score") >= least))
    return rows.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])
