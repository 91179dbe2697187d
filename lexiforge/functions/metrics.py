"""Text metrics of a translation against a reference."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..shipping import ship


def clipped(h: list, r: list, longest: int) -> list[int]:
    """How many n-grams of each length up to ``longest`` two lists of tokens share, repeats included."""
    grams = lambda t, n: Counter(zip(*[t[i:] for i in range(n)], strict=False))
    return [(grams(h, n) & grams(r, n)).total() for n in range(1, longest + 1)]


def bleu(rows: DataFrame, keys: list[str], hypothesis: str, reference: str, longest: int = 4, smoothing: float = 0.1) -> DataFrame:
    """Sentence BLEU of two columns of token arrays: clipped n-gram precision, a small numerator where nothing matches, 0 without a matching word, brevity penalty.

    N-grams are counted where a row lies, one row at a time: nothing is shuffled and nothing grows with the table.
    """
    ship(rows.sparkSession)

    @F.pandas_udf("array<long>")
    def shared(h: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([clipped(list(x), list(y), longest) if x is not None and y is not None else [0] * longest for x, y in zip(h, r, strict=True)], dtype="object")

    found = rows.select(*keys, F.size(hypothesis).alias("hl"), F.size(reference).alias("rl"), shared(hypothesis, reference).alias("m"))
    m = [F.element_at("m", i) for i in range(1, longest + 1)]
    logs = sum((F.ln(F.when(x > 0, x).otherwise(F.lit(smoothing)) / F.greatest(F.lit(1), F.col("hl") - i)) for i, x in enumerate(m)), F.lit(0.0)) / longest
    brevity = F.when(F.col("hl") > F.col("rl"), 1.0).otherwise(F.exp(1 - F.col("rl") / F.greatest(F.lit(1), F.col("hl"))))
    return found.select(*keys, F.when(m[0] == 0, 0.0).otherwise(brevity * F.exp(logs)).alias("bleu"))


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, a machine word or more of one side at a time."""
    if not len(a) or not len(b):
        return 0
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & at.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _harmonic(p: float, r: float) -> float:
    return 2 * p * r / (p + r) if p + r else 0.0


@F.pandas_udf(DoubleType())
def _rouge_l(hypothesis: pd.Series, reference: pd.Series) -> pd.Series:
    out = []
    for h, r in zip(hypothesis, reference, strict=True):
        if h is None or r is None or not len(h) or not len(r):
            out.append(0.0)
        else:
            n = common_subsequence(list(h), list(r))
            out.append(_harmonic(n / len(h), n / len(r)))
    return pd.Series(out, dtype="float64")


def rouge_l(hypothesis: Column | str, reference: Column | str) -> Column:
    """F-measure of the longest common subsequence of two token arrays; 0 if either is empty."""
    ship()
    return _rouge_l(hypothesis, reference)


def exact_meteor(h: list, r: list) -> float:
    """METEOR with exact matches only: recall-weighed mean, less a penalty for scattered matches."""
    places: dict = {}
    for i, x in enumerate(r):
        places.setdefault(x, []).append(i)
    matched = [places[x].pop(0) if places.get(x) else None for x in h]
    own = [m for m in matched if m is not None]
    if not own:
        return 0.0
    chunks = sum(m is not None and (i == 0 or matched[i - 1] is None or m != matched[i - 1] + 1) for i, m in enumerate(matched))
    p, q = len(own) / len(h), len(own) / len(r)
    return 10 * p * q / (q + 9 * p) * (1 - 0.5 * (chunks / len(own)) ** 3)


@F.pandas_udf(DoubleType())
def _meteor(hypothesis: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([exact_meteor(list(h), list(r)) if h is not None and r is not None else 0.0 for h, r in zip(hypothesis, reference, strict=True)], dtype="float64")


def meteor(hypothesis: Column | str, reference: Column | str) -> Column:
    """``exact_meteor`` of two token arrays; 0 where either is null."""
    ship()
    return _meteor(hypothesis, reference)
