"""Words of unsegmented texts: the likeliest path through a lattice of dictionary words.

A text is cut into runs of Han characters, runs of other letters and digits, and single marks; only the first need a
lattice. Each run of a word's length that the dictionary has is an edge, found by a join on the run, so the dictionary may
be of any size. A word costs the more the rarer it is; a character that no word explains costs as much as a word seen
once. The path of least cost is found in one pass over the run; of paths alike the one with the longer last word is taken.

Each different run is cut once. Edges know their run by two hashes, so long runs aren't copied to each of them.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.store import cut

#: Han runs, other letters and digits, and any other character that isn't white space.
PARTS = r"[一-鿿]+|[A-Za-z0-9À-ɏ]+|[^\s]"
LONGEST, SCALE = 8, 1000


def word_costs(words: DataFrame) -> tuple[DataFrame, int]:
    """word, cost of a dictionary (word, n), and the cost of a character that it lacks: 1,000 times the negative logarithm of a word's share."""
    counted = words.where("n > 0").groupBy("word").agg(F.sum("n").alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 1
    return counted.select("word", F.round(SCALE * F.ln(F.lit(total) / F.col("n"))).cast("long").alias("cost")), round(SCALE * math.log(total))


def likeliest(n: int, edges: list[tuple[int, int, int]], unknown: int) -> list[int]:
    """Lengths of the words on the path of least cost over ``n`` characters; ``edges``: end, length, cost."""
    into: dict[int, list[tuple[int, int]]] = {}
    for end, k, cost in edges:
        into.setdefault(end, []).append((cost, -k))
    best, back = [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        own = into.get(i, [])
        if not any(k == -1 for _, k in own):
            own = [*own, (unknown, -1)]
        best[i], k = min((best[i + k] + cost, k) for cost, k in own)
        back[i] = -k
    out = []
    while n:
        out.append(back[n])
        n -= back[n]
    return out[::-1]


def _cut(unknown: int):
    def run(parts: pa.Array, edges: pa.Array) -> pa.Array:
        out = []
        for part, own in zip(parts.to_pylist(), edges.to_pylist(), strict=True):
            at, tokens = 0, []
            for k in likeliest(len(part), [(e["end"], e["k"], e["cost"]) for e in own or []], unknown):
                tokens.append(part[at : at + k])
                at += k
            out.append(tokens)
        return pa.array(out, pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")


def cut_runs(runs: DataFrame, words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """run, tokens of each different run (``run``) by a dictionary (word, n)."""
    ship(runs.sparkSession)
    costs, unknown = word_costs(words.where(F.length("word").between(1, longest)))
    costs = cut(costs)  # its size is known then: the runs' edges, many times their texts, only travel where it is large
    named = runs.select("run").distinct().select("run", F.xxhash64("run").alias("one"), F.xxhash64(F.lit(1), "run").alias("two"))
    n = F.length("run")
    ends = named.select("one", "two", "run", F.explode(F.sequence(F.lit(1), n)).alias("end"))
    head = ends.select("one", "two", "end", F.substring("run", F.greatest(F.lit(1), F.col("end") - longest + 1), F.least(F.col("end"), F.lit(longest))).alias("head"))
    edges = head.select("one", "two", "end", F.explode(F.sequence(F.lit(1), F.length("head"))).alias("k"), "head").select("one", "two", "end", "k", F.substring("head", F.length("head") - F.col("k") + 1, F.col("k")).alias("word"))
    found = edges.join(costs, "word").groupBy("one", "two").agg(F.collect_list(F.struct("end", "k", "cost")).alias("edges"))
    return named.join(found, ["one", "two"], "left").select("run", _cut(unknown)("run", "edges").alias("tokens"))


def segmented(rows: DataFrame, keys: list[str], texts: list[str], words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """keys and, for each column of ``texts``, its words as an array of the same name; a null or blank text has none.

    Rows that share their keys are one.
    """
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("side"), F.col(t).alias("text")) for t in texts]))
    parts = rows.select(*keys, each.alias("x")).select(*keys, "x.side", F.posexplode(F.regexp_extract_all("x.text", F.lit(PARTS), F.lit(0))).alias("place", "run"))
    han = F.col("run").rlike("^[一-鿿]{2,}$")
    cut = cut_runs(parts.where(han).select("run"), words, longest)
    whole = parts.where(~han).withColumn("tokens", F.array("run")).unionByName(parts.where(han).join(cut, "run"))
    in_order = lambda t: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == t, F.struct("place", "tokens")))), lambda x: x["tokens"])).alias(t)
    found = whole.groupBy(*keys).agg(*[in_order(t) for t in texts])
    none = F.array().cast("array<string>")
    return rows.select(*keys).distinct().join(found, keys, "left").select(*keys, *[F.coalesce(t, none).alias(t) for t in texts])
