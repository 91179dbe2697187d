"""Shared parts of the text classifiers: splits, bounded samples of labelled rows, n-gram hashes, sparse rows."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds


def sampled(rows: DataFrame, key: str, label: str, each: int, most_labels: int = 1000) -> DataFrame:
    """About ``each`` rows of every label value, at most ``2 * each`` for each on average, chosen by a hash of the key.

    Counting the labels is the only aggregate; the rows are then filtered by a share for each label, so no task holds all
    rows of one. Of more than ``most_labels`` values the most frequent ones are sampled, ties by the value's order.
    """
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.desc("count"), label).limit(most_labels).collect()
    if not counts:
        return rows.limit(0)
    shares = rows.sparkSession.createDataFrame([(r[0], min(1.0, each / r["count"])) for r in counts], StructType([rows.schema[label], StructField("_share", DoubleType())]))
    drawn = F.pmod(F.xxhash64(F.col(key), F.lit(1_234_567)), F.lit(1 << 30)) / float(1 << 30)
    own = rows.join(F.broadcast(shares), label).where(drawn < F.col("_share"))  # at most most_labels rows
    return own.select(*rows.columns).orderBy(drawn, key, label).limit(2 * each * len(counts))


def marked(labels: DataFrame, mark: str, folds: int, out: int) -> DataFrame:
    """doc_id, label of the documents that may be learned from: 0 or 1, not in fold ``out``, and the same in all rows of a doc_id."""
    rows = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[mark].cast("int").alias("label")).where(F.col("label").isin(0, 1) & (fold(F.col("doc_id"), folds) != out))
    return rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_other")).where("label = _other").drop("_other")


def learned_from(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, label, text of the documents chosen (doc_id, label), and a hash of the text that orders rows of one doc_id."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # bounded by the sample's size
    return texts.select("doc_id", "label", F.xxhash64("text").alias("hash"), "text")


class Rows:
    """Sparse rows: for each, the places (and values) of its non-zero features."""

    def __init__(self, places: Iterable[np.ndarray], values: Iterable[np.ndarray] | None = None):
        places = list(places)
        self.at = np.concatenate([[0], np.cumsum([len(p) for p in places])]).astype(np.int64)
        self.places = np.concatenate(places).astype(np.int64) if places else np.zeros(0, np.int64)
        self.values = np.concatenate(list(values)).astype(np.float64) if values is not None and places else np.ones(len(self.places))
        self.row = np.repeat(np.arange(len(places)), np.diff(self.at))
        self.n = len(places)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.places] * self.values, self.n) if self.n else np.zeros(0)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.places, g[self.row] * self.values, size) if self.n else np.zeros(size)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(np.asarray(x) * 0.5))
