"""Mixing sources to target weights.

Documents are aggregated by membership pattern (the set of sources that a document belongs to).  A
min-cost flow routes the words of each pattern to the quotas of its sources; every further repetition
of a pattern costs more than the one before, so words are repeated only where a quota needs it.  Within
a pattern documents are then selected in the order of a seeded hash: all documents get the whole
repetitions, and one more goes to those before the boundary, where documents that still fit are taken
one by one.  Reruns select the same documents.

The flow is solved on the driver, over a row for each pattern.  Beyond ``MAX_PATTERNS`` patterns only
those that overlap with others reach it; a source whose documents belong to no other is a flow of one
arc, and its share is taken where the table of patterns lies.  More overlapping patterns than that raise
an error.  The boundary of a pattern lies in one of its hash buckets, about the square root of its number
of documents, and only that bucket is ordered.

Defined results: a null text has size 0 and is never taken; a null source is a source of its own, last
in order; rows that share doc_id and text are taken alike; an empty table gives no rows; other columns
of the input play no part.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import SPACE, Scratch, read, text_or_empty

WEIGHTS = (5, 2, 1)
TOTAL = 1.5
MAX_COPIES = 2
#: Overlapping patterns that one flow routes, a row each on the driver: some seconds and some 200 MB.
MAX_PATTERNS = 100_000
SEED = 17


def size_of(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text_or_empty(text), f"[{SPACE}]+"), "")).cast("long")


def order_of(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """The place of a document in the seeded order."""
    return F.xxhash64(F.lit(seed), doc_id, F.xxhash64(text.cast("string")))


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MAX_COPIES) -> dict[str | None, float]:
    """Shares of total x all sizes by weight, none above most x its source's size; what is above goes to the others by weight."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)  # str order is that of code points
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    open_, rest = set(names), total * sum(sizes.values())
    while open_:
        scale = rest / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * scale > most * sizes[s]}
        if not above:
            return out | {s: weight[s] * scale for s in open_}
        for s in above:
            out[s] = float(most * sizes[s])
        rest -= sum(out[s] for s in above)
        open_ -= above
    return out


def flow(capacity: dict[tuple, int], quota: dict[str | None, int], most: int = MAX_COPIES) -> dict[tuple, dict[str | None, int]]:
    """Words that each pattern gives to each of its sources: quotas are met as far as repetitions go,
    at the least cost, where the k-th repetition of a word costs k - 1.

    Each connected group of patterns and sources is solved alone.
    """
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for p in capacity:
        for s in p:
            parent[root(("p", p))] = root(("s", s))
    groups: dict = defaultdict(list)
    for p in capacity:
        if p:
            groups[root(("p", p))].append(p)
    out: dict[tuple, dict] = {p: {} for p in capacity}
    for patterns in groups.values():
        for p, s, n in _solve(patterns, capacity, quota, most):
            out[p][s] = n
    return out


def _solve(patterns: list[tuple], capacity: dict, quota: dict, most: int) -> list[tuple]:
    """Primal-dual: shortest distances by Dijkstra, then a blocking flow over all shortest paths at once, while there are any.

    Costs are numbers of repetitions, so there are few distances, and each is dealt with by a few passes over the edges.
    """
    sources = sorted({s for p in patterns for s in p}, key=lambda s: (s is None, s or ""))
    place = {s: len(patterns) + i for i, s in enumerate(sources)}
    start, end = len(patterns) + len(sources), len(patterns) + len(sources) + 1
    heads, to, room, cost = [[] for _ in range(end + 1)], [], [], []

    def edge(a: int, b: int, n: int, c: int) -> int:
        for x, y, r, k in ((a, b, n, c), (b, a, 0, -c)):
            heads[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(k)
        return len(to) - 2

    routes = []
    for i, p in enumerate(patterns):
        for copy in range(most):
            edge(start, i, capacity[p], copy)
        routes += [(p, s, edge(i, place[s], most * capacity[p], 0)) for s in p]
    for s in sources:
        edge(place[s], end, quota.get(s, 0), 0)
    level, none = [0] * (end + 1), float("inf")
    while True:
        far, heap = [none] * (end + 1), [(0, start)]
        far[start] = 0
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in heads[x]:
                y = to[e]
                if room[e] and (nd := d + cost[e] + level[x] - level[y]) < far[y]:
                    far[y] = nd
                    heapq.heappush(heap, (nd, y))
        if far[end] == none:
            break
        for x, d in enumerate(far):
            level[x] += min(d, far[end])
        while _augment(start, end, heads, to, room, cost, level):
            pass
    return [(p, s, room[e ^ 1]) for p, s, e in routes if room[e ^ 1]]


def _augment(start: int, end: int, heads: list[list[int]], to: list[int], room: list[int], cost: list[int], level: list[int]) -> bool:
    """A blocking flow over the edges of shortest paths; whether there was one."""
    step, queue = {start: 0}, deque([start])
    while queue and end not in step:
        x = queue.popleft()
        for e in heads[x]:
            y = to[e]
            if room[e] and y not in step and cost[e] + level[x] == level[y]:
                step[y] = step[x] + 1
                queue.append(y)
    if end not in step:
        return False
    left = {x: 0 for x in step}  # the edges of a node that have led nowhere are not tried again
    path, x = [], start
    while True:
        if x == end:
            n = min(room[e] for e in path)
            for e in path:
                room[e] -= n
                room[e ^ 1] += n
            # back to the first edge that is full
            k = next(i for i, e in enumerate(path) if not room[e])
            x = to[path[k] ^ 1]
            del path[k:]
            continue
        while left[x] < len(heads[x]):
            e = heads[x][left[x]]
            y = to[e]
            if room[e] and y in step and step[y] == step[x] + 1 and cost[e] + level[x] == level[y]:
                path.append(e)
                x = y
                break
            left[x] += 1
        else:
            if not path:
                return True
            e = path.pop()
            x = to[e ^ 1]
            left[x] += 1


def units_of(docs: DataFrame, members: Column) -> DataFrame:
    """(doc_id, pattern, place, size): what selection needs of ``docs(doc_id, text)``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.array_sort(F.array_distinct(members)).alias("pattern"), order_of(F.col("doc_id").cast("long"), F.col("text")).alias("place"), size_of(F.col("text")).alias("size"))


def _bucket() -> Column:
    # the upper 32 bits of the place, scaled to n_buckets
    return F.shiftright((F.shiftrightunsigned("place", 32)) * F.col("n_buckets"), 32).cast("int")


def select(units: DataFrame, asked: DataFrame, keep: Scratch) -> tuple[DataFrame, DataFrame]:
    """asked: (pattern, size, n, wanted), the words to take of each pattern, its size and number of documents.

    Returns a table (pattern, n_buckets, whole, boundary, left) and, of the boundary buckets alone,
    (pattern, place) of the documents that get one copy more than whole.
    """
    some = F.col("size") > 0
    asked = asked.select("pattern", F.greatest(F.lit(1), F.ceil(F.sqrt("n") / 4)).cast("int").alias("n_buckets"), F.when(some, F.floor(F.col("wanted") / F.col("size"))).otherwise(0).cast("int").alias("whole"), F.when(some, F.expr("wanted % size")).otherwise(0).cast("long").alias("rest"))
    # tables by themselves: a join with them can split the side of a source that holds very many documents
    asked = keep.keep(asked, "asked")
    sums = units.join(asked, "pattern").groupBy("pattern", _bucket().alias("bucket")).agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
    running = sums.withColumn("upto", F.sum("size").over(Window.partitionBy("pattern").orderBy("bucket")))
    first = running.where(F.col("upto") > F.col("rest")).groupBy("pattern").agg(F.min(F.struct("bucket", (F.col("rest") - (F.col("upto") - F.col("size"))).alias("left"))).alias("b"))
    table = keep.keep(asked.join(first, "pattern", "left").select("pattern", "n_buckets", "whole", F.col("b.bucket").alias("boundary"), F.coalesce("b.left", F.lit(0)).alias("left")), "table")
    edge = units.join(table, "pattern").where((_bucket() == F.col("boundary")) & (F.col("left") > 0))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group[group["size"] > 0].groupby("place", sort=True, as_index=False).agg({"pattern": "first", "left": "first", "size": "sum"})
        left, taken, others = int(group["left"].iloc[0]) if len(group) else 0, [], []
        for i, n in enumerate(group["size"]):
            if n <= left:
                left -= n
                taken.append(i)
            else:
                others.append((n, i))
        # one more document if the total then is nearer
        if others and min(others)[0] < 2 * left:
            taken.append(min(others)[1])
        return group.iloc[taken][["pattern", "place"]]

    more = edge.select("pattern", "place", "size", "left").groupBy("pattern").applyInPandas(fill, "pattern array<string>, place long")
    return table, more


def copies(rows: DataFrame, table: DataFrame, more: DataFrame) -> DataFrame:
    """Adds ``copies`` to rows that have pattern and place."""
    names = rows.columns
    placed = rows.join(table, "pattern").withColumn("__bucket", _bucket())
    plain = placed.where(F.col("boundary").isNull() | (F.col("__bucket") != F.col("boundary")))
    plain = plain.select(*names, (F.col("whole") + (F.col("boundary").isNull() | (F.col("__bucket") < F.col("boundary"))).cast("int") * (F.col("boundary").isNotNull()).cast("int")).alias("copies"))
    edge = placed.where(F.col("__bucket") == F.col("boundary")).join(more.withColumn("__more", F.lit(1)), ["pattern", "place"], "left")
    return plain.unionByName(edge.select(*names, (F.col("whole") + F.coalesce("__more", F.lit(0))).alias("copies")))


def _patterns(units: DataFrame) -> DataFrame:
    return units.groupBy("pattern").agg(F.sum("size").alias("size"), F.count("*").alias("n"))


def _by_flow(rows: list, target: dict[str | None, float], most: int) -> list[tuple]:
    """(pattern, size, n, wanted) of the patterns ``rows``."""
    given = flow({tuple(r["pattern"]): r["size"] for r in rows}, {s: round(t) for s, t in target.items()}, most)
    return [(r["pattern"], r["size"], r["n"], sum(given[tuple(r["pattern"])].values())) for r in rows]


def shares_of(found: DataFrame, keep: Scratch, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) of the patterns ``found``: ``targets`` as a table, for any number of sources."""
    sources = found.select(F.explode("pattern").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = keep.keep(sources.orderBy(F.asc_nulls_last("source")).withColumn("at", F.monotonically_increasing_id()), "sources")
    # the place in the whole order: after all rows of the parts before; a row for each part
    part = F.shiftright("at", 33)
    counts = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before, parts = 0, []
    for p in sorted(counts):
        parts.append((p, before))
        before += counts[p]
    offset = found.sparkSession.createDataFrame(parts, "part long, before long")
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int"))
    rows = keep.keep(placed.withColumn("part", part).join(F.broadcast(offset), "part").select("source", "source_size", weight.alias("weight")), "weighed")
    whole = (rows.agg(F.sum("source_size")).first()[0] or 0) * total
    scale, closed = 0.0, -1
    while whole:
        above = F.col("weight") * scale > most * F.col("source_size")
        r = rows.agg(F.count_if(above).alias("n"), F.sum(F.when(above, most * F.col("source_size"))).alias("given"), F.sum(F.when(~above, F.col("weight"))).alias("open")).first()
        if r["n"] == closed or not r["open"]:
            break
        closed, scale = r["n"] if scale else -1, (whole - (r["given"] or 0)) / r["open"]
    return rows.select("source", "source_size", F.when(F.col("weight") * scale > most * F.col("source_size"), (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * scale).alias("target"))


def planned(units: DataFrame, keep: Scratch, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MAX_COPIES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Selection for ``units`` as of ``select``, for any number of sources, and (source, source_size, target) as a table."""
    found = keep.keep(_patterns(units), "patterns")
    shares = keep.keep(shares_of(found, keep, weights, total, most), "shares")
    if found.limit(MAX_PATTERNS + 1).count() <= MAX_PATTERNS:
        alone = found.limit(0).withColumn("wanted", F.lit(0).cast("long"))
        overlapping = found
    else:
        # a source that only one pattern has, which has only that source
        single = found.select(F.explode("pattern").alias("source"), (F.size("pattern") == 1).alias("one")).groupBy("source").agg(F.count("*").alias("patterns"), F.bool_and("one").alias("one")).where((F.col("patterns") == 1) & F.col("one"))
        own = F.col("pattern")[0].eqNullSafe(F.col("source"))
        alone = found.where(F.size("pattern") == 1).join(single.select("source"), own, "left_semi").join(shares, own).select("pattern", "size", "n", F.least(F.bround("target").cast("long"), most * F.col("size")).alias("wanted"))
        overlapping = found.join(single, (F.size("pattern") == 1) & own, "left_anti")
    rows = overlapping.limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} overlapping membership patterns")
    mine = {s for r in rows for s in r["pattern"]}
    target = {r["source"]: r["target"] for r in shares.where(F.col("source").isin([s for s in mine if s is not None]) | (F.col("source").isNull() if None in mine else F.lit(False))).collect()} if mine else {}
    flows = units.sparkSession.createDataFrame(_by_flow(rows, target, most), "pattern array<string>, size long, n long, wanted long")
    table, more = select(units, flows.unionByName(alone), keep)
    return table, keep.keep(more, "more"), shares


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = Scratch(spark, "mixing")
    docs = read(spark, sf_dir, "documents")
    units = keep.keep(units_of(docs, F.array(F.col("source").cast("string"))), "units")
    table, more, shares = planned(units, keep)
    out = copies(units, table, more).withColumn("source", F.col("pattern")[0])
    of = shares.withColumnRenamed("source", "of")
    out = out.join(of, F.col("source").eqNullSafe(F.col("of")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source")
