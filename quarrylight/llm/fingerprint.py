"""Fingerprints of documents: a digest of byte triplets by quartiles, compared by a bounded difference.

Every byte of a text begins six triplets within five bytes (four zero bytes follow the text); each is hashed
to one of 128 buckets.  A bucket's code says how many quartiles of all buckets its count exceeds, 0 to 3.  The
fingerprint is the length in bytes on a logarithmic scale (two hex digits), then the codes (64 hex digits).
The difference of two fingerprints sums the squares of code differences and the difference of the lengths,
both bounded; ``likeness`` is 1 less its share of the bound.

``edited_documents`` pairs each document with the next one by id.  Documents are sorted over range partitions,
so a document's next is the row below; only the last row of a partition needs the first of the next one, and
these rows alone are written with their texts and joined.

Defined results: null texts count as empty; an empty text has the fingerprint of no triplet; texts are read
whole, in slices; null ids come after all others; rows that share an id follow each other in an order given by
their texts, so each is the next of the one before; a single row is its own next; an empty table gives no
rows; other columns of the input play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import Scratch, read, text_or_empty

BUCKETS = 128
#: Places of a triplet's second and third byte after its first.
SHAPES = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
PAD = 4
#: Lengths on the scale of the fingerprint differ by 1 for a factor of STEP; beyond LENGTH_MOST they differ no more.
STEP = 1.1
LENGTH_MOST = 24
MOST = 9 * BUCKETS + LENGTH_MOST
#: Bytes that are hashed at once.
SLICE = 1 << 21

_TABLES = np.random.default_rng(1212).integers(0, BUCKETS, (PAD + 1, 256), np.uint8)
_SALTS = np.arange(len(SHAPES), dtype=np.uint8) * 21


def bucket_counts(texts: list[bytes]) -> np.ndarray:
    """How many triplets of each text fall into each bucket."""
    n = len(texts)
    counts = np.zeros((n + 1) * BUCKETS, np.int64)
    data = np.frombuffer(b"".join(x for t in texts for x in (t, bytes(PAD))), np.uint8)
    # each text, then its padding, where no triplet begins
    ends = np.cumsum(np.ravel([(len(t), PAD) for t in texts])) if n else np.zeros(0, np.int64)
    owner = np.ravel([(i, n) for i in range(n)]) if n else ends
    for at in range(0, len(data), SLICE):
        size = min(SLICE, len(data) - at)
        part = data[at : at + size + PAD]
        part = np.r_[part, np.zeros(size + PAD - len(part), np.uint8)]
        row = np.repeat(owner, np.diff(np.clip(ends, at, at + size), prepend=at)) * BUCKETS
        values = [table[part] for table in _TABLES]
        for salt, (j, k) in zip(_SALTS, SHAPES):
            bucket = values[0][:size] ^ values[j][j : j + size] ^ values[k][k : k + size] ^ salt
            counts += np.bincount(row + bucket, minlength=len(counts))
    return counts.reshape(n + 1, BUCKETS)[:n]


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of each text, as hex digits."""
    body = [t.encode() for t in texts]
    counts = bucket_counts(body)
    ordered = np.sort(counts, axis=1)
    codes = sum((counts > ordered[:, q * BUCKETS // 4 - 1 : q * BUCKETS // 4]).astype(np.uint8) for q in (1, 2, 3))
    packed = codes[:, 0::4] << 6 | codes[:, 1::4] << 4 | codes[:, 2::4] << 2 | codes[:, 3::4]
    sizes = np.array([len(x) for x in body], np.int64)
    scale = np.where(sizes > 0, np.minimum(1 + np.log(np.maximum(sizes, 1)) / np.log(STEP), 255), 0).astype(np.uint8)
    return [x.tobytes().hex() for x in np.column_stack([scale, packed])]


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """1 for equal fingerprints, less by the bounded difference of the others; 0 at least."""
    x, y = (np.frombuffer(bytes.fromhex("".join(f)), np.uint8).reshape(len(f), -1).astype(np.int64) for f in (a, b))
    lengths = np.minimum(np.abs(x[:, 0] - y[:, 0]), LENGTH_MOST)
    codes = sum(((x[:, 1:] >> s & 3) - (y[:, 1:] >> s & 3)) ** 2 for s in (0, 2, 4, 6)).sum(axis=1)
    return 1 - (codes + lengths) / MOST


COLUMNS = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The last quarter of the characters is replaced by the first as many of the following text, or all."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _columns(ids: list, texts: list[str], prints: list[str], next_texts: list[str], next_prints: list[str]) -> list[pa.Array]:
    changed = [edited(a, b) for a, b in zip(texts, next_texts)]
    changed_prints = fingerprints(changed) if changed else []
    values = [ids, [len(t) for t in texts], [hashlib.sha256(t.encode()).hexdigest() for t in changed], prints, changed_prints]
    values += [likeness(prints, changed_prints), likeness(prints, next_prints)] if prints else [[], []]
    return [pa.array(v, t) for v, t in zip(values, COLUMNS.values())]


def edited_documents(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: its fingerprint, that of its edited text, and how like they and the next document are."""
    spark = docs.sparkSession
    keep = Scratch(spark, "fingerprint")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text"))
    # equal rows are dealt out by their place, so that copies under one id fill several partitions
    order = [F.col("doc_id").asc_nulls_last(), F.col("hash"), F.col("place")]
    ranged = docs.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order)
    names = [*COLUMNS, "part", "edge", "text"]

    def rows(columns: list[pa.Array], edge: str | None, texts: list) -> pa.RecordBatch:
        n = len(texts)
        part = TaskContext.get().partitionId()
        return pa.RecordBatch.from_arrays([*columns, pa.array([part] * n, pa.int32()), pa.array([edge] * n, pa.string()), pa.array(texts, pa.string())], names)

    def alone(doc_id: int | None, text: str, mark: str) -> list[pa.Array]:
        return [pa.array([v], t) for v, t in zip((doc_id, len(text), None, mark, None, None, None), COLUMNS.values())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            prints = fingerprints(texts)
            if held is None:
                yield rows(alone(ids[0], texts[0], prints[0]), "first", texts[:1])
            else:
                ids, texts, prints = ([x, *y] for x, y in zip(held, (ids, texts, prints)))
            held = ids[-1], texts[-1], prints[-1]
            yield rows(_columns(ids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:]), None, [None] * (len(ids) - 1))
        if held:
            yield rows(alone(*held), "last", [held[1]])

    table = keep.keep(ranged.select("doc_id", "text").mapInArrow(run, SCHEMA + ", part int, edge string, text string"), "sorted")
    first = table.where(F.col("edge") == "first").select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    last = table.where(F.col("edge") == "last").select("part", "doc_id", "text", "fingerprint")
    # a row for each partition; the last one goes on with the first
    parts = first.select("part", F.lead("part").over(Window.orderBy("part")).alias("after"), F.min("part").over(Window.partitionBy()).alias("least"))
    after = parts.select("part", F.coalesce("after", "least").alias("after"))
    edges = last.join(after, "part").join(first.withColumnRenamed("part", "after"), "after").select("doc_id", "text", "fingerprint", "next_text", "next_print")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, prints, next_texts, next_prints = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays(_columns(ids, texts, prints, next_texts, next_prints), [*COLUMNS])

    return table.where(F.col("edge").isNull()).select(*COLUMNS).unionByName(edges.mapInArrow(close, SCHEMA))


def op12_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_documents(read(spark, sf_dir, "documents"))


#: What SQL can say of the result.
EDITS_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS f, CAST(length(t) // 4 AS BIGINT) AS q FROM d)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(left(t, CAST(length(t) AS BIGINT) - q) || left(f, q)) AS edited_sha256 FROM n
"""
