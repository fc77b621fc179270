"""N-gram Jaccard join: documents whose sets of 5-word shingles overlap by 80 % or more, and groups of them.

Texts with equal sets form a class and are joined once.  Shingles are ordered by an estimate of how
many texts hold them (a table of counts by hash, of fixed size), rarest first; two sets that overlap
enough share one among the first few, their prefix.  Classes that share a prefix shingle are dealt
into blocks.  Of a block's documents and n-grams the incidence matrix is multiplied with its transpose
in sparse form: sorted by n-gram, the entries of each column block are paired and the overlaps
accumulated; pairs below the bound that follows from their sizes are discarded.  Before texts are moved
into blocks, a bitmap of the parities of hashed shingles bounds the overlap of a pair from above: where
two bitmaps differ, the sets do.

No group is paired with itself as a whole.  First every class meets only the smallest one of each
prefix shingle: stars.  Then, once what is linked forms components, only classes of different components
that still share a prefix shingle meet.  A shingle that few classes share gives its pairs.  Of one that
many share, each part gives as many candidates as join what its bitmaps allow to be joined; where one of
these turns out to be no link, or the shingle has several parts, every two parts meet in a block.  What
its bitmaps still allow between components is given as pairs where it is little for its members, so that
blocks with the same members decide each pair once; else the product is taken over those members.  So the
rows that a block gives grow with its members, and as links within a component add nothing to it, none
is lost.

Defined results: texts without words have an empty set and link with nothing; rows with a null doc_id
link with nothing and have a null component; rows that share a doc_id are joined each by its own text;
an empty table gives no rows; other columns of the input play no part.

``join_links`` gives the links themselves: there every two classes that share a prefix shingle meet,
within components too, so its work and its result grow with the square of a group of near copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import Scratch, read
from quarrylight.llm.components import components
from quarrylight.llm.textnum import mix, shingle_set, word_hashes

WORDS = 5
#: Two sets link when DENOMINATOR * intersection >= NUMERATOR * union.
NUMERATOR, DENOMINATOR = 80, 100
#: The table of counts has 2 ** bits entries of a byte: about one for each 128 bytes of input, within these bounds.
SKETCH_BITS = (20, 26)
SKETCH_CHUNK = 1 << 16
#: Counts are kept as this times their logarithm to base 2; nothing but an order is read from them.
LEVELS = 8
#: Shingles estimated to be in more texts than this (or 8 times the mean estimate) are dealt by a salt too.
HOT = 200_000
#: Shingles of all sets of one block, about; larger stars are split.
BLOCK = 400_000
#: Bits of the table of wanted ids that goes to all tasks (8 MB at most); what it lets through is joined exactly.
WANTED_BITS = 26
#: Longs of a parity bitmap.
BITMAP = 16
#: A shingle that more open classes share than this gives blocks instead of pairs.
FEW = 16
#: Classes of one part of such a block, at most about; a block joins two parts.
PART = 512
#: A block gives its candidates as pairs, which many blocks may share, up to so many a member; more are decided in it.
SHARED = 16
#: Pairs of entries of one column block of a product.
PAIRS = 1 << 20


def required(a, b):
    """The smallest overlap of sets of sizes a and b that makes a link."""
    return -(-NUMERATOR * (a + b) // (NUMERATOR + DENOMINATOR))


def prefix_size(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def _class_key(shingles: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(np.sum(mix(shingles ^ np.uint64(0x5851F42D4C957F2D))).astype(np.int64)), int(np.bitwise_xor.reduce(mix(shingles + np.uint64(0x14057B7EF767814F))).astype(np.int64))


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def _ids_and_text(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def sketch_bits(docs: DataFrame) -> int:
    """Bits of the table of counts, by the size of the input as the optimizer knows it."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 50:  # not known
        size = 1 << 29
    return min(max(int(np.ceil(np.log2(size / 128 + 1))), SKETCH_BITS[0]), SKETCH_BITS[1])


def signatures(docs: DataFrame, bits: int) -> DataFrame:
    """Rows (doc_id, text_hash, n, k1, k2, bits) of all documents, and rows (chunk, counts) that sum to the table of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_hash", "n", "k1", "k2", "bits", "chunk", "counts"]
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.int32(), pa.binary()]
        # a task's own counts stop at 255: common shingles stay far above rare ones
        counts = np.zeros(1 << bits, np.uint8)

        def add(held: list[np.ndarray]) -> None:
            places, more = np.unique(np.concatenate(held), return_counts=True)
            counts[places] = np.minimum(counts[places] + more, 255)

        for part in _parts(batches):
            out, held, odd, size = [], [], [], 0
            for words in word_hashes(part.column(1)):
                s = shingle_set(words, WORDS)
                out.append((len(s), *(_class_key(s) if len(s) else (0, 0))))
                odd.append(parities(s))
                held.append((s >> np.uint64(64 - bits)).astype(np.int32))
                size += len(s)
                if size > 1 << 20:
                    add(held)
                    held, size = [], 0
            if held:
                add(held)
            n = len(out)
            maps = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BITMAP), pa.array(np.concatenate(odd) if n else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array([o[i] for o in out], pa.int64()) for i in range(3)), maps, pa.nulls(n, kinds[6]), pa.nulls(n, kinds[7])], names)
        for i, c in enumerate(counts.reshape(-1, SKETCH_CHUNK)):
            if c.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, k) for k in kinds[:6]] + [pa.array([i], kinds[6]), pa.array([c.tobytes()], kinds[7])], names)

    return _ids_and_text(docs).mapInArrow(run, "doc_id long, text_hash long, n long, k1 long, k2 long, bits array<long>, chunk int, counts binary")


def sketch_table(signed: DataFrame, bits: int) -> np.ndarray:
    """The summed counts as levels, a byte each; at most 2 ** 26 bytes reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                more = np.frombuffer(counts.as_buffer(), np.uint8).astype(np.int64)
                sums[chunk] = sums[chunk] + more if chunk in sums else more
        for chunk, total in sums.items():
            level = np.minimum(np.round(LEVELS * np.log2(total + 1.0)), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["chunk", "counts"])

    rows = signed.where(F.col("chunk").isNotNull()).select("chunk", "counts").repartition(F.col("chunk")).mapInArrow(add, "chunk int, counts binary")
    table = np.zeros(1 << bits, np.uint8)
    for r in rows.toLocalIterator():
        table[r["chunk"] * SKETCH_CHUNK : (r["chunk"] + 1) * SKETCH_CHUNK] = np.frombuffer(bytes(r["counts"]), np.uint8)
    return table


def prefixes(docs: DataFrame, table: np.ndarray, hot: int = HOT) -> DataFrame:
    """(token, salt, k1, k2, n): the rarest shingles of each class, once a task."""
    shared, bits = docs.sparkSession.sparkContext.broadcast(table), len(table).bit_length() - 1
    hot = max(hot, 8 * 2 ** (float(table.mean()) / LEVELS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shared.value, set()
        for part in _parts(batches):
            tokens, salts, k1s, k2s, ns, sizes = [], [], [], [], [], []
            for doc_id, words in zip(part.column(0), word_hashes(part.column(1))):
                s = shingle_set(words, WORDS)
                if not len(s) or not doc_id.is_valid:
                    continue
                key = _class_key(s)
                if key in seen:
                    continue
                if len(seen) < 50_000:
                    seen.add(key)
                often = counts[(s >> np.uint64(64 - bits)).astype(np.int64)]
                # s is sorted, so a stable order by count is one order of all shingles for all texts
                first = np.argsort(often, kind="stable")[: prefix_size(len(s))]
                tokens.append(s[first].view(np.int64))
                # 0: one group for all of the token; else one of so many as its count asks for
                count = 2 ** (often[first] / LEVELS) - 1
                salts.append(np.where(count < hot, 0, np.int64(key[0]) % (count // hot + 1).astype(np.int64) + 1).astype(np.int32))
                k1s.append(key[0])
                k2s.append(key[1])
                ns.append(len(s))
                sizes.append(len(first))
            if tokens:
                each = lambda x: pa.array(np.repeat(np.array(x, np.int64), sizes))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(salts)), each(k1s), each(k2s), pa.array(np.repeat(np.array(ns, np.int32), sizes))], ["token", "salt", "k1", "k2", "n"])

    return _ids_and_text(docs).mapInArrow(run, "token long, salt int, k1 long, k2 long, n int")


def shared_prefixes(rows: DataFrame) -> DataFrame:
    """Of ``prefixes`` those rows whose token another class has too, each class once.

    One shuffle: the rows of a token are sorted by class and read in that order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "k1", "k2", "n"]
        last = held = None  # last row read: its token, salt and class; first row of the token if not yet given out
        for batch in batches:
            token, salt, k1, k2, n = (c.to_numpy() for c in batch.columns)
            if not len(token):
                continue
            before = np.array([last] if last else [(token[0] ^ 1, 0, 0, 0)], np.int64)[0]
            new = np.r_[(token[0] != before[0]) | (salt[0] != before[1]), (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])]
            other = ~new & ~np.r_[(k1[0] == before[2]) & (k2[0] == before[3]), (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])]
            # where each row's group begins; rows before the first beginning belong to the row held
            begin = np.maximum.accumulate(np.where(new, np.arange(len(token)), -1))
            carried = begin < 0
            # a salted token's groups may hold a class each, so their first ones are given out in any case
            lead = new & ((salt > 0) | np.isin(np.arange(len(token)), begin[other & ~carried]))
            out = [x[lead | other] for x in (token, k1, k2, n)]
            if held is not None and (other & carried).any():
                out = [np.r_[np.array([h], o.dtype), o] for h, o in zip(held, out)]
                held = None
            if new.any():
                i = int(np.flatnonzero(new)[-1])
                held = None if lead[i] else (token[i], k1[i], k2[i], n[i])
            last = (token[-1], salt[-1], k1[-1], k2[-1])
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names)

    dealt = rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "k1", "k2")
    return dealt.mapInArrow(run, "token long, k1 long, k2 long, n int")


def _fits(a: str | Column, b: str | Column) -> Column:
    """Sizes that can link at all: 100 * smaller >= 80 * larger."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return DENOMINATOR * F.least(a, b) >= NUMERATOR * F.greatest(a, b)


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls on each bit; bits in which two sets differ are at most their differing shingles."""
    odd = np.bincount((shingles & np.uint64(64 * BITMAP - 1)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def with_texts(docs: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` with (k1, k2, text) of their class rep: the text of its first document (first).

    Rows may share a doc_id, so the key tells which of their texts is meant.
    """
    place = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(1 << WANTED_BITS))
    # joins with tables that grow with the corpus are merged, at every size
    wanted = members.join(classes.select("rep", "first", "k1", "k2").hint("merge"), "rep")
    table = wanted.select(place("first").alias("at")).distinct().groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))
    rows = docs.where(F.col("doc_id").isNotNull()).withColumn("at", place("doc_id")).withColumn("bucket", F.bitmap_bucket_number("at"))
    # bit b of a bucket is bit b % 8 of its byte b / 8; a bucket has 4 KB, and there are 2 ** WANTED_BITS / 32768 of them
    here = F.expr("conv(hex(substring(bitmap, int(bitmap_bit_position(at) div 8) + 1, 1)), 16, 10)").cast("int")
    some = rows.join(F.broadcast(table), "bucket").where(here.bitwiseAND(F.expr("shiftleft(1, int(bitmap_bit_position(at) % 8))")) != 0)
    return wanted.join(some.select(F.col("doc_id").alias("first"), "text").hint("merge"), "first")


def alike(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """Of the candidates ``pairs(hub, rep)`` those that their bitmaps do not rule out, with the size n of rep."""
    side = lambda name, p: bits.select(F.col("rep").alias(name), F.col("n").alias(f"{p}n"), F.col("bits").alias(f"{p}bits"))
    both = pairs.join(side("hub", "h").hint("merge"), "hub").join(side("rep", "r").hint("merge"), "rep")
    apart = F.aggregate(F.zip_with("hbits", "rbits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    total = (F.col("hn") + F.col("rn")).cast("long")
    least = F.floor((NUMERATOR * total + (NUMERATOR + DENOMINATOR - 1)) / (NUMERATOR + DENOMINATOR))
    return both.where(apart <= total - 2 * least).select("hub", "rep", F.col("rn").alias("n"))


def product(sets: list[np.ndarray], block: np.ndarray, left: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, overlap) of the sets that share a shingle within a block: the sparse product of incidence and transpose.

    block: the block of each set.  left: the sets whose rows of the product are wanted, with all other
    sets of their block as columns; without it, each two sets once.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    with np.errstate(over="ignore"):
        # sets of different blocks share no column
        columns = np.concatenate(sets) ^ np.repeat(mix(block.astype(np.uint64) + np.uint64(1)), sizes)
    docs = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(columns, kind="stable")
    columns, docs = columns[order], docs[order]
    n = len(columns)
    first = np.flatnonzero(np.r_[True, columns[1:] != columns[:-1]]) if n else np.zeros(0, np.int64)
    ends = np.r_[first[1:], n] if n else first
    run = np.repeat(np.arange(len(first)), ends - first)
    # each entry meets the later ones of its column, or all of them if its row is wanted
    if left is None:
        from_, upto, entries = np.arange(n) + 1, ends[run], np.arange(n)
    else:
        entries = np.flatnonzero(left[docs])
        from_, upto = first[run[entries]], ends[run[entries]]
    many = upto - from_
    entries, from_, many = entries[many > 0], from_[many > 0], many[many > 0]
    cut = np.cumsum(many)
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = 0
    while begin < len(entries):
        stop = max(begin + 1, int(np.searchsorted(cut, (cut[begin - 1] if begin else 0) + PAIRS, "right")))
        m = many[begin:stop]
        other = np.repeat(from_[begin:stop] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        i, j = np.repeat(docs[entries[begin:stop]], m), docs[other]
        found, n_found = np.unique((np.minimum(i, j) if left is None else i) * len(sets) + (np.maximum(i, j) if left is None else j), return_counts=True)
        keys, back = np.unique(np.r_[keys, found], return_inverse=True)
        counts = np.bincount(back, np.r_[counts, n_found], len(keys)).astype(np.int64)
        begin = stop
    i, j = keys // len(sets), keys % len(sets)
    return i[i != j], j[i != j], counts[i != j]


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of all sets with each other."""
    i, j, n = product(sets, np.zeros(len(sets), np.int64))
    total = np.diag([len(s) for s in sets])
    total[i, j] = total[j, i] = n
    return total


def _spanning(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[int]:
    """Which of the links (i, j) of ``ids`` tell their components."""
    parent = {int(x): int(x) for x in ids}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for k, (u, v) in enumerate(zip(ids[i].tolist(), ids[j].tolist())):
        a, b = root(u), root(v)
        if a != b:
            parent[b] = a
            out.append(k)
    return out


def star_blocks(pairs: DataFrame, keep: Scratch, name: str) -> DataFrame:
    """(block, part, rep) of the stars ``pairs(hub, rep, n)``: each hub with its members, or with some of them at a time."""
    # written, so that the join's skewed sides can be split
    load = keep.keep(pairs.groupBy("hub").agg(F.sum("n").alias("load")).where(F.col("load") > BLOCK).select("hub", (F.floor(F.col("load") / BLOCK) + 1).cast("int").alias("salts")), f"{name}load")
    placed = pairs.join(load, "hub", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    members = placed.select(F.col("hub").alias("block"), F.pmod(F.xxhash64("rep"), F.col("salts")).alias("part"), "rep")
    hubs = members.select("block", "part").distinct().select("block", "part", F.col("block").alias("rep"))
    return members.union(hubs)


def token_blocks(rows: DataFrame) -> DataFrame:
    """(block, part, rep) of the open shingles in ``rows(token, rep, n, component)``.

    The classes of a shingle's largest component and the others are dealt into parts; every two parts of
    the others are a block, and every part of the largest with every part of the others.
    """
    by = rows.groupBy("token", "component").agg(F.count("*").alias("m"), F.sum("n").alias("load"))
    size = lambda m, load: F.greatest(F.ceil(m / PART), F.ceil(load / BLOCK)).cast("int")
    per = by.groupBy("token").agg(F.max_by("component", F.struct("m", "component")).alias("major"), F.max(F.struct("m", "component", "load")).alias("top"), F.sum("m").alias("m"), F.sum("load").alias("load"))
    per = per.select("token", "major", size(F.col("top.m"), F.col("top.load")).alias("l"), size(F.col("m") - F.col("top.m"), F.col("load") - F.col("top.load")).alias("k"))
    placed = rows.join(per, "token").withColumn("h", F.xxhash64("rep"))
    key = lambda kind, a, b: (F.lit(kind << 40) + a.cast("long") * (1 << 20) + b.cast("long"))
    s, a = F.pmod(F.col("h"), F.col("k")), F.pmod(F.col("h"), F.col("l"))
    others = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda t: key(1, F.least(s, t.cast("long")), F.greatest(s, t.cast("long")))), F.transform(F.sequence(F.lit(0), F.col("l") - 1), lambda t: key(2, t, s))
    )
    largest = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda t: key(2, a, t))
    return placed.select(F.col("token").alias("block"), F.explode(F.when(F.col("component") == F.col("major"), largest).otherwise(others)).alias("part"), "rep")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Sorted batches as columns of whole groups by their first ``keys`` columns, and where each group begins and ends."""
    held: list[np.ndarray] | None = None

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [np.asarray(c.flatten()).reshape(-1, BITMAP) if pa.types.is_list(c.type) else c.to_numpy() for c in batch.columns]

    def bounds(held: list[np.ndarray]) -> np.ndarray:
        new = np.zeros(len(held[0]), bool)
        new[:1] = True
        for k in held[:keys]:
            new[1:] |= k[1:] != k[:-1]
        return np.r_[np.flatnonzero(new), len(new)]

    for batch in batches:
        if batch.num_rows:
            more = columns(batch)
            held = more if held is None else [np.concatenate(x) for x in zip(held, more)]
            at = bounds(held)
            if len(at) > 2:
                last = int(at[-2])
                yield [x[:last] for x in held], at[:-1]
                held = [x[last:] for x in held]
    if held is not None:
        yield held, bounds(held)


def _allowed(rep: np.ndarray, n: np.ndarray, comp: np.ndarray, bits: np.ndarray, i: int) -> np.ndarray:
    """Members after i of a block that their components and bitmaps allow it to be joined with."""
    others = i + 1 + np.flatnonzero((comp[i + 1 :] != comp[i]) & (rep[i + 1 :] != rep[i]))
    most = n[i] + n[others] - 2 * required(n[i], n[others])
    return others[np.bitwise_count(bits[i] ^ bits[others]).sum(1) <= most]


def forest(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """(token, hub, rep, n) for ``rows(token, rep, n, component, m)``: of each part of a shingle's classes, as many
    candidates as join all that bitmaps allow to be joined; fewer than the part has classes."""
    part = F.pmod(F.xxhash64("rep", F.lit("part")), F.ceil(F.col("m") / PART))
    full = rows.withColumn("part", part).join(bits.select("rep", "bits").hint("merge"), "rep").select("token", "part", "rep", F.col("n").cast("long").alias("n"), "component", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (token, _, rep, n, component, words), at in _groups(batches, 2):
            out: list[tuple] = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                # signed counts would be of absolute values
                own, size, label, odd = rep[a:b], n[a:b], component[a:b].copy(), words[a:b].view(np.uint64)
                for i in range(b - a - 1):
                    others = _allowed(own, size, label, odd, i)
                    while len(others):
                        j = others[0]
                        u, v = (i, j) if own[i] < own[j] else (j, i)
                        out.append((token[a], own[u], own[v], size[v]))
                        label[label == label[j]] = label[i]
                        others = others[label[others] != label[i]]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(4)], ["token", "hub", "rep", "n"])

    dealt = full.repartition("token", "part").sortWithinPartitions("token", "part", "rep")
    return dealt.mapInArrow(run, "token long, hub long, rep long, n long")


def possible(members: DataFrame, rows: DataFrame, bits: DataFrame) -> DataFrame:
    """What the bitmaps of the blocks ``members(block, part, rep)`` allow between components: of a block either pairs
    (rep, other, n), n the size of other, or, where those are many, its members (block, part, rep, component)."""
    component = rows.select("rep", "component").distinct()
    full = members.join(bits.select("rep", F.col("n").cast("long").alias("n"), "bits").hint("merge"), "rep").join(component, "rep").select("block", "part", "rep", "n", "component", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (block, part, rep, n, component, words), at in _groups(batches, 2):
            some, first, second = np.zeros(len(rep), bool), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                odd = words[a:b].view(np.uint64)
                found = [_allowed(rep[a:b], n[a:b], component[a:b], odd, i) for i in range(b - a - 1)]
                if (pairs := sum(map(len, found))) <= SHARED * (b - a):
                    if pairs:
                        first.append(a + np.repeat(np.arange(b - a - 1), [len(x) for x in found]))
                        second.append(a + np.concatenate(found))
                else:
                    for i, x in enumerate(found):
                        some[a + i] |= len(x) > 0
                        some[a + x] = True
            i, j = np.concatenate(first), np.concatenate(second)
            swap = rep[i] > rep[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            none = pa.nulls(len(i), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(rep[i]), none, pa.array(rep[j]), pa.array(n[j])], names)
            none = pa.nulls(int(some.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(x[some]) for x in (block, part, rep, component)), none, none], names)

    names = ["block", "part", "rep", "component", "other", "n"]
    dealt = full.repartition("block", "part").sortWithinPartitions("block", "part", "rep")
    return dealt.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def decided(found: DataFrame, docs: DataFrame, classes: DataFrame, keep: Scratch, name: str, spanning: bool) -> DataFrame:
    """(u, v, n_both) of what ``possible`` gave: links of its pairs, and of the blocks of its members."""
    found = keep.keep(found, f"{name}possible")
    pairs = keep.keep(found.where(F.col("other").isNotNull()).select(F.col("rep").alias("hub"), F.col("other").alias("rep"), "n").distinct(), f"{name}pairs")
    links = star_links(pairs, docs, classes, keep, name)
    members = found.where(F.col("other").isNull()).select("block", "part", "rep", "component")
    more = keep.keep(linked(with_texts(docs, classes, members), stars=False, spanning=spanning), f"{name}more")
    keep.drop(f"{name}possible")
    keep.drop(f"{name}pairs")
    return links.union(more)


def linked(members: DataFrame, stars: bool, spanning: bool) -> DataFrame:
    """Links (u, v, n_both), u < v, within the blocks ``members(block, part, rep, component, k1, k2, text)``, by the product of each block.

    stars: only those of the block's hub.  spanning: only between components, as many as tell what they join.
    """
    rows = members.select("block", "part", "rep", "component", "k1", "k2", "text")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number, size = None, 0, 0
        held: list[tuple] = []  # (number of the block, whether it is the hub, rep, component)
        sets: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal held, sets, number, size
            block, hub, rep, comp = (np.array([h[i] for h in held], np.int64) for i in range(4))
            i, j, n = product(sets, block, hub > 0 if stars else None)
            sizes = np.array([len(s) for s in sets], np.int64)
            fine = (n >= required(sizes[i], sizes[j])) & (rep[i] != rep[j])
            if spanning and not stars:
                fine &= comp[i] != comp[j]
            i, j, n = i[fine], j[fine], n[fine]
            if spanning and len(i):
                some = _spanning(rep, i, j) if stars else _spanning(comp, i, j)
                i, j, n = i[some], j[some], n[some]
            held, sets, number, size = [], [], 0, 0
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[i], rep[j])), pa.array(np.maximum(rep[i], rep[j])), pa.array(n)], ["u", "v", "n_both"])

        for batch in batches:
            block, part, rep, comp, k1, k2 = (batch.column(i).to_numpy() for i in range(6))
            for i, words in enumerate(word_hashes(batch.column(6))):
                s = shingle_set(words, WORDS)
                if not len(s) or _class_key(s) != (k1[i], k2[i]):  # rows may share a doc_id
                    continue
                if (block[i], part[i]) != key:
                    if size > BLOCK:
                        yield close()
                    key = (block[i], part[i])
                    number += 1
                held.append((number, block[i] == rep[i], rep[i], comp[i]))
                sets.append(s)
                size += len(s)
        if held:
            yield close()

    dealt = rows.repartition("block", "part").sortWithinPartitions("block", "part")
    return dealt.mapInArrow(blocks, "u long, v long, n_both long")


def star_links(pairs: DataFrame, docs: DataFrame, classes: DataFrame, keep: Scratch, name: str) -> DataFrame:
    """(u, v, n_both) of the candidates ``pairs(hub, rep, n)`` that link."""
    members = keep.keep(star_blocks(pairs, keep, name), f"{name}members")
    out = keep.keep(linked(with_texts(docs, classes, members.withColumn("component", F.col("rep"))), stars=True, spanning=False).groupBy("u", "v").agg(F.max("n_both").alias("n_both")), f"{name}links")
    keep.drop(f"{name}members")
    keep.drop(f"{name}load")
    return out


def _opened(found: DataFrame, groups: DataFrame, keep: Scratch, name: str) -> DataFrame:
    """(token, rep, n, component, m) of the shingles in ``found(token, rep, n)`` that classes of two components share."""
    placed = found.join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_ = placed.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("m")).where("a <> b")
    # written, so that the join's skewed side can be split
    return keep.keep(placed.join(keep.keep(open_.select("token", "m"), f"{name}-tokens"), "token"), name)


def _few_pairs(rows: DataFrame, few: int) -> DataFrame:
    """(hub, rep) of different components that share a shingle of at most ``few`` classes."""
    small = rows.where(F.col("m") <= few)
    a, b = small.select("token", F.col("rep").alias("hub"), F.col("n").alias("hn"), F.col("component").alias("hc")), small.select("token", "rep", "n", "component")
    return a.join(b, "token").where((F.col("hub") < F.col("rep")) & (F.col("hc") != F.col("component")) & _fits("hn", "n")).select("hub", "rep").distinct()


def _prepared(docs: DataFrame, keep: Scratch, hot: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows (doc_id, text_hash, n, k1, k2), the classes (k1, k2, n, first, bits, rep), and the prefix shingles that classes share.

    first is the smallest doc_id of a class, rep a number of its own: rows of several classes may share a doc_id.
    """
    bits = sketch_bits(docs)
    signed = keep.keep(signatures(docs, bits), "signed")
    table = sketch_table(signed, bits)
    signed = signed.where(F.col("chunk").isNull()).select("doc_id", "text_hash", "n", "k1", "k2", "bits")
    classes = keep.keep(signed.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("first"), F.any_value("bits").alias("bits")).withColumn("rep", F.monotonically_increasing_id()), "classes")
    found = shared_prefixes(prefixes(docs, table, hot)).join(classes.select("k1", "k2", F.col("n").cast("int").alias("n"), "rep"), ["k1", "k2", "n"])
    return signed, classes, keep.keep(found.select("token", "rep", "n"), "found")


def join_links(docs: DataFrame, hot: int = HOT, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """All links (u, v, n_both) between representatives of classes, and (doc_id, n_shingles, class_id, n_links) for each row.

    ``class_id`` is the smallest doc_id with the same set, which stands for it in the links; ``n_links``
    counts the links of that class, so copies with equal sets are not among them.
    """
    keep = Scratch(docs.sparkSession, "links")
    docs = _ids_and_text(docs)
    signed, classes, found = _prepared(docs, keep, hot)
    # each class is a component of its own: all of them meet
    rows = _opened(found.distinct(), classes.select(F.col("rep").alias("node"), F.col("rep").alias("component")).limit(0), keep, "open")
    links = star_links(keep.keep(alike(_few_pairs(rows, few), classes), "pairs"), docs, classes, keep, "few-")
    large = rows.where(F.col("m") > few)
    links = links.union(decided(possible(token_blocks(large), large, classes), docs, classes, keep, "many-", spanning=False))
    links = keep.keep(links.groupBy("u", "v").agg(F.max("n_both").alias("n_both")), "links")
    for name in ("found", "open", "open-tokens", "pairs", "few-links", "many-links", "many-more"):
        keep.drop(name)
    degree = links.select(F.explode(F.array("u", "v")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    members = signed.join(classes.select("k1", "k2", "n", "first", "rep").join(degree, "rep", "left"), ["k1", "k2", "n"], "left")
    for end in ("u", "v"):
        links = links.join(classes.select(F.col("rep").alias(end), F.col("first").alias(f"{end}_first")), end)
    links = links.select(F.least("u_first", "v_first").alias("u"), F.greatest("u_first", "v_first").alias("v"), "n_both")
    own = F.col("doc_id").isNotNull()
    return links, members.select("doc_id", F.col("n").alias("n_shingles"), F.when(own, F.coalesce("first", "doc_id")).alias("class_id"), F.when(own, F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"))


def join_components(docs: DataFrame, hot: int = HOT, few: int = FEW) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs(doc_id, text)``."""
    return join_rows(docs, hot, few).drop("text_hash")


def join_rows(docs: DataFrame, hot: int = HOT, few: int = FEW) -> DataFrame:
    """``join_components`` with the hash of each row's text, which tells rows apart that share a doc_id."""
    keep = Scratch(docs.sparkSession, "jaccard")
    docs = _ids_and_text(docs)
    signed, classes, found = _prepared(docs, keep, hot)
    # written, so that the join's skewed side can be split
    hubs = keep.keep(found.groupBy("token").agg(F.min(F.struct("n", "rep")).alias("hub")).select("token", F.col("hub.n").alias("pn"), F.col("hub.rep").alias("hub")), "hubs")
    tried = found.join(hubs, "token").where((F.col("rep") != F.col("hub")) & _fits("n", "pn")).select("hub", "rep").distinct()
    links = star_links(keep.keep(alike(tried, classes), "stars"), docs, classes, keep, "star-")
    keep.drop("hubs")
    keep.drop("stars")
    groups = components(links, keep, "groups-")

    rows = _opened(found, groups, keep, "open")
    keep.drop("found")
    large = rows.where(F.col("m") > few)
    trees = keep.keep(forest(large, classes), "trees")
    pairs = keep.keep(alike(_few_pairs(rows, few), classes).union(trees.select("hub", "rep", F.col("n").cast("int"))).distinct(), "pairs")
    more = star_links(pairs, docs, classes, keep, "open-")
    links = links.union(more)
    if more.limit(1).count():
        groups = components(links, keep, "more-groups-")

    # shingles that are not yet settled: of several parts, or with a candidate that is no link
    failed = trees.join(more.select(F.col("u").alias("hub"), F.col("v").alias("rep")), ["hub", "rep"], "left_anti").select("token")
    unsettled = large.where(F.col("m") > PART).select("token").union(failed).distinct()
    rest = _opened(large.join(unsettled, "token", "left_semi").select("token", "rep", "n"), groups, keep, "rest")
    last = decided(possible(token_blocks(rest), rest, classes), docs, classes, keep, "rest-", spanning=True)
    if last.limit(1).count():
        groups = components(links.union(last), keep, "all-groups-")
    for name in ("open", "open-tokens", "trees", "pairs", "rest", "rest-tokens"):
        keep.drop(name)
    placed = classes.select("k1", "k2", "n", "first", "rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = keep.keep(placed.groupBy("component").agg(F.min("first").alias("component_id")), "least")
    out = signed.join(placed.join(least, "component").select("k1", "k2", "n", "component_id"), ["k1", "k2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), "text_hash")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(read(spark, sf_dir, "documents"))


OP5_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) END) AS g FROM d
), h AS (SELECT doc_id, md5_number(g) AS g FROM s), n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
o AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS o FROM h a JOIN h b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT u, v FROM o JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * o >= 80 * (a.n + b.n - o)),
edge AS (SELECT u, v FROM link UNION SELECT v, u FROM link),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, edge.v FROM reach JOIN edge ON edge.u = reach.r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach ON reach.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""
