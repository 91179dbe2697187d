"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing with exact reranking.

Vectors are scaled by the largest norm and given one more component that makes all norms 1, so that the largest inner
product is the least Euclidean distance. Each of ``tables`` hashes is ``width``-wide cells of ``cells`` Gaussian
projections. A query visits its own bucket and those that perturb single coordinates by one cell, in the order of the
estimated chance of success; all candidates are then ranked by their exact inner product in double precision.

Cell width and number of probes are fitted on a sample of at most ``SAMPLE`` vectors, on queries from as many different
cells as there are, so that a group of copies counts little, to a mean recall and to one that nearly every query reaches;
every vector is indexed. Buckets aren't capped: a full one is cut into blocks of vectors and of queries, and each pair of
blocks is compared by itself. Queries whose buckets hold fewer than k candidates though the table has more are compared
with every vector, in blocks as well.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component take no part, nor do rows
without an id; shorter vectors count as if zeros followed up to the longest one's length; rows that share an id count as
one vector whose product with another is the best among their rows; a product that isn't a number ranks as the least,
one beyond the doubles as infinite; ties go to the smaller id; an empty table gives no rows; columns other than the id
and the vector aren't read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .work import shared_dir, ship, tidied, written

SAMPLE, FIT_QUERIES, BLOCK_ROWS, OPEN_ROWS, TASK_ROWS = 6000, 100, 512, 2048, 60_000


@dataclass
class Index:
    dim: int
    log_norm: float
    width: float
    probes: int
    tables: int = 6
    cells: int = 6
    seed: int = 77

    def __post_init__(self):
        rng = np.random.Generator(np.random.PCG64(self.seed))
        self.axes = rng.normal(size=(self.tables, self.dim + 1, self.cells))
        self.shift = rng.uniform(0, 1, (self.tables, 1, self.cells))
        self.prime = rng.integers(1, 2**62, self.cells, dtype=np.int64) * 2 + 1

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Unit vectors whose distances order inner products; a query's own length doesn't matter."""
        # Scaled by the largest component first, so that no finite vector's length overflows.
        most = np.abs(x).max(axis=1, keepdims=True)
        u = x / most
        n = np.sqrt((u * u).sum(axis=1, keepdims=True))
        if query:
            return np.hstack([u / n, np.zeros_like(n)])
        y = u * np.exp(np.log(most) - self.log_norm)
        return np.hstack([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(axis=1, keepdims=True)))])

    def places(self, x: np.ndarray) -> np.ndarray:
        """Projections in units of cells: table, vector, axis."""
        return np.einsum("nd,tdc->tnc", x, self.axes) / self.width + self.shift

    def names(self, cells: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (cells * self.prime).sum(axis=-1)

    def visits(self, place: np.ndarray) -> np.ndarray:
        """The cells that one query visits in one table, likeliest first."""
        cell = np.floor(place)
        part = place - cell
        k = len(cell)
        moves = sorted([(part[j] ** 2, j, -1) for j in range(k)] + [((1 - part[j]) ** 2, j, 1) for j in range(k)])
        out, heap = [cell], [(moves[0][0], (0,))]
        while heap and len(out) < self.probes:
            cost, chosen = heapq.heappop(heap)
            if len({moves[i][1] for i in chosen}) == len(chosen):
                to = cell.copy()
                for i in chosen:
                    to[moves[i][1]] += moves[i][2]
                out.append(to)
            i = chosen[-1]
            if i + 1 < len(moves):
                heapq.heappush(heap, (cost - moves[i][0] + moves[i + 1][0], (*chosen[:-1], i + 1)))
                heapq.heappush(heap, (cost + moves[i + 1][0], (*chosen, i + 1)))
        return np.array(out).astype(np.int64)


def dealt(cells: np.ndarray) -> np.ndarray:
    """Places in the order of dealing: the first of each cell, then the second of each, and so on."""
    order = np.argsort(cells, kind="stable")
    first = np.concatenate([[True], cells[order][1:] != cells[order][:-1]]) if len(cells) else np.zeros(0, bool)
    turn = np.empty(len(cells), np.int64)
    turn[order] = np.arange(len(cells)) - np.maximum.accumulate(np.where(first, np.arange(len(cells)), 0))
    return np.argsort(turn, kind="stable")


def fit(sample: np.ndarray, log_norm: float, k: int, goal: float = 0.97, each: float = 0.9, share: float = 0.95, widths: tuple[float, ...] = (2.0, 2.5, 3.0, 4.0, 6.0, 12.0, 100.0), most: int = 128) -> Index:
    """The narrowest cells, and for them the fewest probes, whose recall of the k nearest within the sample reaches ``goal`` on average and ``each`` for a ``share`` of the queries.

    The queries are dealt over the narrowest cells of one table, one from each cell, then a second, and so on.
    Widths are in deviations of the sample's projections; probes are powers of two or 1.5 times one, at most ``most``.
    If none reaches the goals, one cell holds everything and all vectors are compared.
    """
    ix = Index(sample.shape[1], log_norm, 1.0, 16)
    base = ix.lifted(sample, False)
    spread = float((ix.places(base) - ix.shift).std(axis=1).mean())
    ix.width = max(spread * widths[0], 1e-9)
    chosen = dealt(ix.names(np.floor(ix.places(base)[0]).astype(np.int64)))[:FIT_QUERIES]
    asked = ix.lifted(sample[chosen], True)
    s = asked[:, :-1] @ base[:, :-1].T
    s[np.arange(len(asked)), chosen] = -np.inf
    top = np.argsort(-s, axis=1)[:, : min(k, len(sample) - 1)]
    for width in widths:
        ix.width, ix.probes = max(spread * width, 1e-9), 16
        if not top.size:
            return ix
        home, ask = ix.names(np.floor(ix.places(base)).astype(np.int64)), ix.places(asked)
        while ix.probes <= most:
            hits = np.zeros(len(asked))
            for i in range(len(asked)):
                found = np.zeros(top.shape[1], bool)
                for t in range(ix.tables):
                    found |= np.isin(home[t][top[i]], ix.names(ix.visits(ask[t, i])))
                hits[i] = found.mean()
            if hits.mean() >= goal and (hits >= each).mean() >= share:
                return ix
            if ix.probes == most:
                break
            ix.probes = ix.probes * 3 // 2 if ix.probes & (ix.probes - 1) == 0 else ix.probes * 4 // 3
    ix.width, ix.probes, ix.shift = 1e9, 1, np.full_like(ix.shift, 0.5)
    return ix


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best distinct ids, best first, ties to the smaller id."""
    order = np.lexsort((ids, -np.where(np.isnan(scores), -np.inf, scores)))
    ids, scores = ids[order], scores[order]
    _, first = np.unique(ids, return_index=True)
    first = np.sort(first)[:k]
    return ids[first], scores[first]


def _compare(found: dict, queries: tuple[np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray], k: int) -> None:
    """Puts the k best rows for each query of a pair of blocks into ``found``."""
    (qid, q), (vid, v) = queries, rows
    own = qid[:, None] == vid[None, :]
    with np.errstate(over="ignore", invalid="ignore"):
        s = q @ v.T
        s[np.isnan(s)] = -np.inf
        # Products in one go differ from those row by row in the last places only.
        slack = 1e-14 * q.shape[1] * np.sqrt((q * q).sum(axis=1)) * np.sqrt((v * v).sum(axis=1).max())
    s[own] = -np.inf
    if s.shape[1] > k:
        cut = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        with np.errstate(invalid="ignore"):
            low = np.where(np.isfinite(cut), cut - slack, cut)
        keep = (s >= low[:, None]) & ~own
    else:
        keep = ~own
    for i in range(len(qid)):
        at = np.flatnonzero(keep[i])
        if len(at):
            with np.errstate(over="ignore", invalid="ignore"):
                ids, exact = vid[at], (v[at] * q[i]).sum(axis=1)
            if (old := found.get(qid[i])) is not None:
                ids, exact = np.concatenate([old[0], ids]), np.concatenate([old[1], exact])
            found[qid[i]] = best(ids, exact, k)


def _matrix(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    raw = column.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
    return np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).astype(np.float64).reshape(-1, dim)


def _numbers(column: pa.Array, dim: int) -> np.ndarray:
    """A list column's values as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest(table: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by ``every``."""
    spark = table.sparkSession
    ship(spark)
    # Single floats travel as such; all products are of doubles.
    single = table.schema[vector].dataType == ArrayType(FloatType(), True) or table.schema[vector].dataType == ArrayType(FloatType(), False)
    kind, element = ("<f4", "float") if single else ("<f8", "double")
    rows = table.select(table[key].cast("long").alias("id"), table[vector].cast(f"array<{element}>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    most = F.array_max(F.transform("v", F.abs)).cast("double")
    # The largest component is bound to a name, as it would be taken anew for every other one.
    length = F.transform(F.array(most), lambda m: F.log(m) + F.log(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / m) * (x / m))) / 2)[0]
    whole = rows.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("d"), F.max(length).alias("length")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not whole["n"]:
        return spark.createDataFrame([], schema)
    dim, n = whole["d"], whole["n"]
    if whole["least"] < dim:
        rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast(element), dim - F.size("v"))))
    sample = rows.orderBy(F.xxhash64("id", F.lit(3)), "id", F.xxhash64("v")).limit(SAMPLE).toArrow()
    index = fit(_numbers(sample.column("v").combine_chunks(), dim), whole["length"], k)
    kept = "side boolean, t int, b long, id long, v binary"

    def hashed(asks: bool, light: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, 1024):
                    part = batch.slice(a, 1024)
                    x = _numbers(part.column(1), dim)
                    ids = part.column(0).to_numpy()
                    place = index.places(index.lifted(x, asks))
                    raw = np.array([r.tobytes() for r in x.astype(kind)], dtype=object)
                    for t in range(index.tables):
                        if asks:
                            names = [index.names(index.visits(place[t, i])) for i in range(len(ids))]
                            of = np.repeat(np.arange(len(ids)), [len(c) for c in names])
                            b = np.concatenate(names)
                        else:
                            of, b = np.arange(len(ids)), index.names(np.floor(place[t]).astype(np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), asks)), pa.array(np.full(len(b), t, np.int32)), pa.array(b), pa.array(ids[of]), pa.nulls(len(b), pa.binary()) if light else pa.array(raw[of], pa.binary())], names=["side", "t", "b", "id", "v"])

        return run

    def packed(asks: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, m = _numbers(batch.column(1), dim), batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, asks)), pa.array(np.zeros(m, np.int32)), pa.array(np.zeros(m, np.int64)), batch.column(0), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())], names=["side", "t", "b", "id", "v"])

        return run

    asked = rows.where(F.col("id") % every == 0)
    counts = rows.mapInArrow(hashed(False, True), kept).unionByName(asked.mapInArrow(hashed(True, True), kept)).groupBy("t", "b").agg(F.count_if(~F.col("side")).alias("vectors"), F.count_if("side").alias("queries"))
    blocks = counts.where("vectors > 0 AND queries > 0").select("t", "b", F.ceil(F.col("vectors") / BLOCK_ROWS).cast("int").alias("vparts"), F.ceil(F.col("queries") / BLOCK_ROWS).cast("int").alias("qparts"))
    own = lambda parts: F.pmod(F.xxhash64("id", F.lit(11)), F.col(parts)).cast("int")
    every_part = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    vectors = rows.mapInArrow(hashed(False, False), kept).join(blocks, ["t", "b"]).withColumn("vp", own("vparts")).withColumn("qp", every_part("qparts"))
    queries = asked.mapInArrow(hashed(True, False), kept).join(blocks, ["t", "b"]).withColumn("qp", own("qparts")).withColumn("vp", every_part("vparts"))
    names = ["t", "b", "vp", "qp"]

    def placed(vectors: DataFrame, queries: DataFrame, copies: int) -> DataFrame:
        both = vectors.select(*names, "side", "id", "v").unionByName(queries.select(*names, "side", "id", "v"))
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * copies // TASK_ROWS))
        return both.repartition(tasks, *names).sortWithinPartitions(*names, "side")

    part_schema = pa.schema([("query_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])

    def listed(found: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([x[0] for x in found.values()], pa.list_(pa.int64())), pa.array([x[1] for x in found.values()], pa.list_(pa.float64()))], schema=part_schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        rest: pa.Table | None = None

        def block(part: pa.Table) -> None:
            side, ids, x = part.column("side").to_numpy(), part.column("id").to_numpy(), _matrix(part.column("v").combine_chunks(), dim, kind)
            if side.any() and not side.all():
                _compare(found, (ids[side], x[side]), (ids[~side], x[~side]), k)

        for batch in batches:
            part = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, part]) if rest is not None else part
            keys = np.column_stack([rest.column(c).to_numpy() for c in names])
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts[:-1]], cuts, strict=False):
                block(rest.slice(a, b - a))
            rest = rest.slice(int(cuts[-1])) if len(cuts) else rest
        if rest is not None:
            block(rest)
        if found:
            yield listed(found)

    parts_of = "query_id long, ids array<long>, scores array<double>"
    # Many small groups, so that no task has most queries.
    groups = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // (every * 200)))

    def merge(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        found: dict = {}
        for q, ids, scores in zip(group.column("query_id").to_pylist(), group.column("ids"), group.column("scores"), strict=True):
            ids, scores = ids.values.to_numpy(), scores.values.to_numpy()
            if q in found:
                ids, scores = np.concatenate([found[q][0], ids]), np.concatenate([found[q][1], scores])
            found[q] = best(ids, scores, k)
        sizes = [len(x[0]) for x in found.values()]
        return pa.table({"query_id": pa.array(np.repeat(list(found), sizes), pa.int64()), "rank": pa.array(np.concatenate([np.arange(1, s + 1) for s in sizes]), pa.int32()), "vec_id": np.concatenate([x[0] for x in found.values()]), "score": np.concatenate([x[1] for x in found.values()])})

    def merged(parts: DataFrame) -> DataFrame:
        return parts.withColumn("g", F.pmod(F.xxhash64("query_id"), F.lit(groups))).groupBy("g").applyInArrow(merge, schema)

    folder = shared_dir(spark)
    got = written(merged(placed(vectors, queries, index.tables).mapInArrow(tidied(search), parts_of)), f"{folder}/neighbours")
    # An id is a candidate once, however many rows share it, and never for itself.
    least = min(k, rows.select("id").distinct().limit(k + 1).count() - 1)
    counts = got.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("found"))
    short = written(asked.select("id").distinct().join(counts, "id", "left").where(F.coalesce("found", F.lit(0)) < least).select("id"), f"{folder}/short")
    open_queries = short.count()
    if not open_queries:
        return got
    # Every open query meets every vector; vectors travel once for each block of queries, so these are larger here.
    qparts, vparts = -(-open_queries // OPEN_ROWS), -(-n // OPEN_ROWS)
    to = lambda parts: F.pmod(F.xxhash64("id", F.lit(11)), F.lit(parts)).cast("int")
    all_of = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    plain = lambda table, asks: table.mapInArrow(packed(asks), kept)
    left = plain(asked.join(short, "id", "left_semi"), True).withColumn("qp", to(qparts)).withColumn("vp", all_of(vparts))
    every_row = plain(rows, False).withColumn("vp", to(vparts)).withColumn("qp", all_of(qparts))
    whole = merged(placed(every_row, left, qparts).mapInArrow(tidied(search), parts_of))
    return got.join(short.withColumnRenamed("id", "query_id"), "query_id", "left_anti").select("query_id", "rank", "vec_id", "score").unionByName(whole)
