"""Approximate nearest neighbours by an inverted multi-index.

Each half of the vectors is quantised by its own centroids; a pair of centroids is a cell.  For a query
the pairs are visited in falling order of the sum of their two inner products with it, by a heap, until
the cells hold enough entries; these are reranked by their exact inner products.

The centroids are fitted on a bounded sample (``FIT_ROWS``), about half the square root of the number
of rows for each half; every row is indexed.  Entries lie in shards of about ``SHARD`` rows, a hot cell
in several.  A query goes to the shards of its cells with the sum of the last cell that it visits; a
shard is held by a task while its queries pass by, and each cell of it is multiplied with the queries
that visit the cell, and with no others.

Scores are first taken by matrix products; whatever these products' error leaves possible is then
summed exactly.  Of equal vectors of a shard only those with the smallest ids can be among the nearest,
so no more are held.

Defined results: vectors that are null, zero, hold nulls, infinities or NaN, or have another length
than most take no part; rows with a null vec_id take no part; rows that share a vec_id are candidates of
each other, and each different vector of an id is a query, with results of its own; repeated rows are
one query, whose copies are candidates; an empty table gives no rows; other columns of the input play
no part.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import Scratch, read

FIT_ROWS = 20_000
SHARD = 8192
#: Queries that are multiplied with the cells of a shard at once.
QUERIES = 256
#: Centroids of a half at most: the cells are its square, and a count of each is sent to all tasks (8 MB).
CENTROIDS = 1024
#: Entries to visit: FACTOR * N ** POWER, LEAST at least.  Measured to give a recall over 0.9.
FACTOR, POWER, LEAST = 1.75, 0.88, 1024


def kmeans(x: np.ndarray, k: int, steps: int = 15, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(steps):
        near = np.argmin((centre**2).sum(1) - 2 * x @ centre.T, axis=1)
        n = np.bincount(near, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)
    return centre


def visit(s1: np.ndarray, s2: np.ndarray, counts: np.ndarray, wanted: int) -> np.ndarray:
    """Cells (as i * len(s2) + j) in falling order of s1[i] + s2[j], until they hold wanted entries."""
    o1, o2 = np.argsort(-s1, kind="stable"), np.argsort(-s2, kind="stable")
    a, b = (-s1[o1]).tolist(), (-s2[o2]).tolist()
    heap, out, held, m = [(a[0] + b[0], 0, 0)], [], 0, len(b)
    rows, columns = (o1 * m).tolist(), o2.tolist()
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = rows[i] + columns[j]
        if n := counts[cell]:
            out.append(cell)
            held += n
        if j + 1 < m:
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return np.array(out, np.int64)


class Index:
    """Centroids of both halves, entries in each cell and the shards that hold them."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second
        self.half = first.shape[1]

    def place(self, counts: np.ndarray) -> None:
        self.counts = counts
        # cells in order fill shards of equal size; a cell above that size gets shards of its own
        size = max(1, -(-int(counts.sum()) // max(1, -(-int(counts.sum()) // SHARD))))
        own = -(-counts // size)
        self.shards = np.maximum(own, 1)
        small = np.where(own <= 1, counts, 0)
        self.start = np.maximum(np.cumsum(small) - 1, 0) // size
        large = np.flatnonzero(own > 1)
        base = int(self.start[-1]) + 1 if len(counts) else 0
        self.start[large] = base + np.cumsum(own[large]) - own[large]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = x[:, : self.half], x[:, self.half :]
        i = np.argmin((self.first**2).sum(1) - 2 * a @ self.first.T, axis=1)
        j = np.argmin((self.second**2).sum(1) - 2 * b @ self.second.T, axis=1)
        return i * len(self.second) + j

    def sums(self, q: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """What the cells are visited by: for each query and cell the sum of the two products with centroids."""
        return (q[:, : self.half] @ self.first.T)[:, cells // len(self.second)] + (q[:, self.half :] @ self.second.T)[:, cells % len(self.second)]

    def route(self, q: np.ndarray, wanted: int) -> tuple[np.ndarray, float]:
        """The shards of the cells that a query visits, and the least sum among these cells."""
        s1, s2 = self.first @ q[: self.half], self.second @ q[self.half :]
        found = visit(s1, s2, self.counts, wanted)
        span = self.shards[found]
        each = np.repeat(self.start[found], span) + np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
        return np.unique(each), float(s1[found[-1] // len(s2)] + s2[found[-1] % len(s2)]) if len(found) else math.inf


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part; v is array<double>."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    return rows.where("vec_id is not null and v is not null").where(fine)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(len(column), -1)


def top(candidates: np.ndarray, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray, query: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, float]]:
    """The k best of candidates (rows of ids, vectors and their norms) by exact score, ties to the smaller id."""
    if len(candidates) > k:
        # what the rounding of a product of this length may be wrong by
        wrong = 2 * (len(query) + 2) * np.finfo(float).eps * np.linalg.norm(query) * norms[candidates]
        near = scores[candidates]
        candidates = candidates[near + wrong >= np.partition(near - wrong, len(near) - k)[len(near) - k]]
    exact = [(math.fsum((vectors[c] * query).tolist()), int(ids[c])) for c in candidates]
    return [(i, s) for s, i in sorted(exact, key=lambda x: (-x[0], x[1]))[:k]]


class Shard:
    """Entries of a shard, by cells."""

    def __init__(self, index: Index, ids: np.ndarray, vectors: np.ndarray, cells: np.ndarray, k: int):
        # of equal vectors the k + 1 smallest ids: one of them may be the query's own
        _, same = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, same.reshape(-1)))
        same = same.reshape(-1)[order]
        first = np.r_[True, same[1:] != same[:-1]]
        rank = np.arange(len(same)) - np.maximum.accumulate(np.where(first, np.arange(len(same)), 0))
        kept = order[rank <= k]
        kept = kept[np.argsort(cells[kept], kind="stable")]
        self.index, self.k = index, k
        self.ids, self.vectors = ids[kept], vectors[kept]
        self.norms = np.linalg.norm(self.vectors, axis=1)
        self.cells, self.begin = np.unique(cells[kept], return_index=True)
        self.end = np.r_[self.begin[1:], len(kept)]

    def nearest(self, queries: np.ndarray, asked: np.ndarray, least: np.ndarray) -> list[tuple[int, int, float]]:
        """(number of the query, vec_id, score) of the k nearest in visited cells."""
        sums = self.index.sums(asked, self.cells)
        visited = sums >= (least - 1e-9 * np.abs(least))[:, None]
        scores = np.full((len(asked), len(self.ids)), -np.inf)
        for c in np.flatnonzero(visited.any(axis=0)):
            rows, part = np.flatnonzero(visited[:, c]), slice(self.begin[c], self.end[c])
            scores[rows, part] = asked[rows] @ self.vectors[part].T
        out = []
        for i, q in enumerate(asked):
            some = np.flatnonzero(scores[i] > -np.inf)
            own = some[self.ids[some] == queries[i]]
            own = own[(self.vectors[own] == q).all(axis=1)]
            if len(own):
                some = some[some != own[0]]
            out.extend((i, c, s) for c, s in top(some, self.ids, self.vectors, self.norms, q, scores[i], self.k))
        return out


def search(vectors: DataFrame, is_query: Column, k: int = 20, centroids: int = CENTROIDS, entries: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query among all other rows.

    entries: how many a query visits at least, by default FACTOR * N ** POWER.
    """
    spark = vectors.sparkSession
    keep = Scratch(spark, "ann")
    rows = valid(vectors)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], schema)
    dim, n = common["d"], common["count"]
    rows = rows.where(F.size("v") == dim)
    sample = rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1_000_000)) < FIT_ROWS / n * 1_000_000).distinct().select("v").toArrow()
    x = _matrix(sample.column("v")) if sample.num_rows else _matrix(rows.orderBy("vec_id").limit(FIT_ROWS).select("v").toArrow().column("v"))
    # in one order, whatever order the rows came in
    x = x[np.lexsort(x.T)]
    half = max(1, dim // 2)
    size = int(max(1, min(centroids, math.sqrt(n / 4))))
    index = Index(kmeans(x[:, :half], size), kmeans(x[:, half:], size) if dim > 1 else np.zeros((1, 0)))
    plain = spark.sparkContext.broadcast(index)

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(plain.value.cells(_matrix(batch.column(1))).astype(np.int32))], ["vec_id", "v", "cell"])

    indexed = keep.keep(rows.mapInArrow(cell, "vec_id long, v array<double>, cell int"), "entries")
    # one number for each cell, CENTROIDS squared at most
    counts = np.zeros(len(index.first) * len(index.second), np.int64)
    found = indexed.groupBy("cell").count().toArrow()
    counts[found.column("cell").to_numpy()] = found.column("count").to_numpy()
    index.place(counts)
    shared = spark.sparkContext.broadcast(index)
    wanted = max(LEAST, math.ceil(FACTOR * n**POWER)) if entries is None else entries
    queries = indexed.where(is_query).select("vec_id", "v").distinct()
    names, kinds = ["shard", "least", "vec_id", "v", "cell"], (pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64()), pa.int32())
    both = "shard int, least double, vec_id long, v array<double>, cell int"

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out = []
            for query_id, q in zip(batch.column(0).to_pylist(), _matrix(batch.column(1)) if batch.num_rows else ()):
                shards, least = own.route(q, wanted + 1)
                out.extend((s, least, query_id, q, None) for s in shards.tolist())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            ids, at = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            shard = own.start[at] + (ids * 0x9E3779B1 % (1 << 31)) % own.shards[at]
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.nulls(len(ids), kinds[1]), *batch.columns], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of each shard first its entries, then its queries
        at, held, shard = None, [], None
        for batch in batches:
            for a in range(0, batch.num_rows, QUERIES):
                part = batch.slice(a, QUERIES)
                shards, ids, v = np.asarray(part.column(0)), np.asarray(part.column(2)), _matrix(part.column(3))
                asks = np.asarray(part.column(1).is_valid())
                change = np.flatnonzero((shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1])) + 1
                for i, j in zip([0, *change], [*change, len(ids)]):
                    if shards[i] != at:
                        at, held, shard = shards[i], [], None
                    if not asks[i]:
                        held.append((ids[i:j], v[i:j], np.asarray(part.column(4).slice(i, j - i))))
                        continue
                    if shard is None:
                        if not held:
                            continue
                        shard = Shard(shared.value, *(np.concatenate(x) for x in zip(*held)), k)
                        held = []
                    out = shard.nearest(ids[i:j], v[i:j], np.asarray(part.column(1).slice(i, j - i)))
                    row = np.array([o[0] for o in out], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][row]), pa.array([zlib.crc32(v[i + r].tobytes()) for r in row], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())], ["query_id", "q", "vec_id", "score"])

    # by work, not by bytes: a visit takes longer than its row is long
    asked = queries.repartition(max(1, -(-queries.count() // 128)), "vec_id").mapInArrow(route, both)
    met = indexed.mapInArrow(deal, both).union(asked).repartition("shard").sortWithinPartitions("shard", F.col("least").isNotNull(), "vec_id")
    best = met.mapInArrow(meet, "query_id long, q long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
