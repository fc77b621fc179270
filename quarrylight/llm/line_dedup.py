"""Line dedup by winnowing over line hashes.

A line is known by its words (white space apart); lines without words play no part and stay.  The
shortest stretches of lines of at least ``min_words`` words, from each line onwards and from each line
backwards, are the windows; every run of that many words or more is a union of them.  Of each window the
smallest line hash, the last of equal ones, is its fingerprint: equal windows have equal fingerprints at
equal places.  The positions of fingerprints, each once, are the rows; those whose fingerprint is nowhere
else are left out, the others are joined by it and their matches extended both ways, as far as a window
they were taken from reaches.  How far two positions agree is decided by hashes of the lines before and
after, not line by line: a position agrees with another one than the first of its fingerprint where a
common line stands in several contexts, and to extend all pairs takes the square of their number.  The
first position that agrees stands for its match; where there is an earlier one, by (doc_id, line), the
window's lines go.  The first occurrence stays, and so does what overlaps it in the same document.

Only whole equal lines are matched: what a repeated passage holds of a line that is equal in part stays,
and so does a passage whose whole lines hold fewer words than ``min_words`` (figures in the README).

Positions are reduced to the first of each match before they are joined, so no pairs within a group
arise; both tables of such firsts are written, so that a join splits the side of a very common line.

Defined results: null and empty texts stay as they are, with 0 lines; a null doc_id comes after all
others; rows that share doc_id and text are one document and get the same result; rows that share only
doc_id are ordered by a hash of the text; texts of any length are read whole; an empty table gives no
rows; other columns of the input, whatever their names, pass through ``dedup_documents``, but for
n_lines and n_removed, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import Scratch, read

MIN_WORDS = 50
#: Places of the bitmap of texts that have cuts.
CUT_BITS = 23


def lines_of(text: str) -> list[tuple[int, bytes, int]]:
    """(index among all lines, words joined by spaces, number of words) of the lines with words."""
    out = []
    for i, line in enumerate(text.encode().split(b"\n")):
        words = line.split()
        if words:
            out.append((i, b" ".join(words), len(words)))
    return out


def windows(counts: list[int], min_words: int) -> set[tuple[int, int]]:
    """(first, last) of the shortest stretches of min_words words, onwards and backwards."""
    out, last, total = set(), -1, 0
    for first in range(len(counts)):
        while total < min_words and last + 1 < len(counts):
            last += 1
            total += counts[last]
        if total < min_words:
            break
        out.add((first, last))
        total -= counts[first]
    first, total = len(counts), 0
    for last in range(len(counts) - 1, -1, -1):
        while total < min_words and first > 0:
            first -= 1
            total += counts[first]
        if total < min_words:
            break
        out.add((first, last))
        total -= counts[last]
    return out


_WINDOW = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("back", pa.int64()), ("on", pa.int64())])


def _positions(rows: DataFrame, min_words: int) -> DataFrame:
    """The winnowed positions of all documents, each once: its fingerprint, its line, and the windows that it was taken from.

    A window says how far it reaches on either side of the position, and hashes of the lines there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_hash", "fp", "fp_at", "windows"]
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                out: list[tuple] = []
                for doc_id, text_hash, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                    lines = lines_of(text.as_py() or "")
                    hashes = [xxhash.xxh3_64_intdigest(w) - (1 << 63) for _, w, _ in lines]
                    taken: dict[int, list[tuple]] = {}
                    for first, last in windows([n for _, _, n in lines], min_words):
                        at = min(range(first, last + 1), key=lambda i: (hashes[i], -i))
                        # the number of lines on a side is the seed of its hash
                        back = xxhash.xxh3_64_intdigest(b"\n".join(w for _, w, _ in lines[first:at]), 1 + at - first) - (1 << 63)
                        on = xxhash.xxh3_64_intdigest(b"\n".join(w for _, w, _ in lines[at + 1 : last + 1]), 1 + last - at) - (1 << 63)
                        taken.setdefault(at, []).append((first, last, back, on))
                    out += [(doc_id, text_hash, hashes[at], at, own) for at, own in taken.items()]
                kinds = [pa.int64()] * 3 + [pa.int32()]
                columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]
                sizes = np.cumsum([0, *(len(r[4]) for r in out)])
                flat = [w for r in out for w in r[4]]
                each = pa.StructArray.from_arrays([pa.array([w[i] for w in flat], f.type) for i, f in enumerate(_WINDOW)], fields=list(_WINDOW))
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), each)], names)

    return rows.select("doc_id", "text_hash", "text").mapInArrow(run, "doc_id long, text_hash long, fp long, fp_at int, windows array<struct<first:int,last:int,back:long,on:long>>")


def _order(position: str) -> F.Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text_hash", F.col(position).alias("at"))


def repeated_runs(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_hash, cuts): the line ranges to delete, each packed as first * 2^32 + last."""
    keep = Scratch(rows.sparkSession, "runs")
    # both are read twice: written, so that texts are read once
    found = keep.keep(_positions(rows, min_words), "positions")
    # fingerprints at two positions or more: only these are joined, and only their windows become rows
    shared = found.groupBy("fp").agg(F.min(_order("fp_at")).alias("a"), F.max(_order("fp_at")).alias("b")).where(F.col("a") != F.col("b")).select("fp")
    near = found.join(keep.keep(shared, "shared"), "fp", "left_semi").select("doc_id", "text_hash", "fp", F.explode("windows").alias("w")).select("doc_id", "text_hash", "fp", "w.*")
    near = keep.keep(near, "near")
    keep.drop("positions")
    keep.drop("shared")
    match = ["fp", "back", "on"]
    firsts = near.groupBy(*match).agg(F.min(_order("first")).alias("a"), F.max(_order("first")).alias("b")).where(F.col("a") != F.col("b")).drop("b")
    later = near.withColumn("own", _order("first")).join(keep.keep(firsts, "firsts"), match)
    same = (F.col("own.none") == F.col("a.none")) & (F.col("own.doc_id") == F.col("a.doc_id")) & (F.col("own.text_hash") == F.col("a.text_hash"))
    later = later.where((F.col("own") != F.col("a")) & ~(same & (F.col("first") - F.col("a.at") <= F.col("last") - F.col("first"))))
    cut = F.col("first").cast("long") * F.lit(1 << 32) + F.col("last").cast("long")
    cuts = keep.keep(later.groupBy("doc_id", "text_hash").agg(F.collect_set(cut).alias("cuts")), "cuts")
    keep.drop("near")
    keep.drop("firsts")
    return cuts


def without(text: str, cuts: list[int]) -> tuple[str, int]:
    """The text without the lines of the cuts, and how many went."""
    gone = set()
    for cut in cuts:
        gone.update(range(cut >> 32, (cut & 0xFFFFFFFF) + 1))
    drop = {i for k, (i, _, _) in enumerate(lines_of(text)) if k in gone}
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in drop), len(drop)


def dedup_documents(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the later repeated runs gone from text; adds n_lines and n_removed (long)."""
    names = [n for n in docs.columns if n not in ("n_lines", "n_removed")]
    # by place, so that no name of the input is taken for one of these
    rows = docs.select(*(docs[n].cast("long") if n == "doc_id" else docs[n].cast("string") if n == "text" else docs[n] for n in names)).toDF(*(f"c{i}" for i in range(len(names))))
    at, by = names.index("text"), F.col(f"c{names.index('doc_id')}")
    rows = rows.withColumn("hash", F.xxhash64(f"c{at}"))
    runs = repeated_runs(rows.select(by.alias("doc_id"), F.col("hash").alias("text_hash"), F.col(f"c{at}").alias("text")), min_words)
    runs = runs.select(F.col("doc_id").alias("of"), F.col("text_hash").alias("hash"), "cuts")
    runs = runs.withColumn("none", F.col("of").isNull()).withColumn("of", F.coalesce("of", F.lit(0)))
    # a bitmap of 2 ** CUT_BITS places says which texts may have cuts: only these are moved to meet them
    place = lambda none, of, h: F.pmod(F.xxhash64(of, none, h), F.lit(1 << CUT_BITS))
    table = runs.select(place(F.col("none"), F.col("of"), F.col("hash")).alias("at")).distinct().groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))
    some = rows.withColumn("at", place(by.isNull(), F.coalesce(by, F.lit(0)), F.col("hash"))).withColumn("bucket", F.bitmap_bucket_number("at"))
    # bit b of a bucket is bit b % 8 of its byte b / 8; a bucket has 4 KB, so 2 ** CUT_BITS / 8 bytes are sent at most
    held = F.expr("conv(hex(substring(bitmap, int(bitmap_bit_position(at) div 8) + 1, 1)), 16, 10)").cast("int").bitwiseAND(F.expr("shiftleft(1, int(bitmap_bit_position(at) % 8))")) != 0
    some = some.join(F.broadcast(table), "bucket", "left").withColumn("held", F.coalesce(held, F.lit(False))).select(*rows.columns, "held")
    moved = some.where("held").drop("held")
    joined = moved.join(runs, (F.coalesce(by, F.lit(0)) == F.col("of")) & (by.isNull() == F.col("none")) & (moved["hash"] == runs["hash"]), "left").select(*(moved[c] for c in rows.columns), "cuts")
    joined = joined.unionByName(some.where(~F.col("held")).drop("held").withColumn("cuts", F.lit(None).cast("array<long>")))
    joined = joined.select(*rows.columns[:-1], "cuts")
    kept = joined.drop("cuts").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                texts, n_lines, n_removed = [], [], []
                for text, cuts in zip(part.column(at), part.column(part.num_columns - 1).to_pylist()):
                    text, gone = text.as_py(), 0
                    n_lines.append(len(lines_of(text or "")))
                    if cuts:
                        text, gone = without(text, cuts)
                    texts.append(text)
                    n_removed.append(gone)
                columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(part.columns[:-1])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], [*kept.names, "n_lines", "n_removed"])

    schema = kept.simpleString()[7:-1] + ",n_lines:long,n_removed:long"
    return joined.mapInArrow(run, schema).toDF(*names, "n_lines", "n_removed")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))


OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS idx FROM d),
w AS (SELECT *, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS ws FROM l),
nb AS (
  SELECT doc_id, idx, array_to_string(ws, ' ') AS norm, len(ws) AS n,
    row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS k,
    sum(len(ws)) OVER (PARTITION BY doc_id ORDER BY idx) AS cum
  FROM w WHERE len(ws) > 0
),
pairs AS (SELECT a.doc_id, a.k AS s, b.k AS e FROM nb a JOIN nb b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.cum - a.cum + a.n >= {MIN_WORDS}),
win AS (
  SELECT doc_id, s, min(e) AS e FROM pairs GROUP BY doc_id, s
  UNION SELECT doc_id, max(s) AS s, e FROM pairs GROUP BY doc_id, e
),
txt AS (
  SELECT win.doc_id, s, e, string_agg(norm, chr(10) ORDER BY k) AS body
  FROM win JOIN nb ON nb.doc_id = win.doc_id AND nb.k BETWEEN s AND e GROUP BY win.doc_id, s, e
),
f AS (
  SELECT *, first_value(doc_id) OVER g AS fd, first_value(s) OVER g AS fs
  FROM txt WINDOW g AS (PARTITION BY body ORDER BY doc_id, s)
),
gone AS (
  SELECT DISTINCT nb.doc_id, nb.idx FROM f JOIN nb ON nb.doc_id = f.doc_id AND nb.k BETWEEN f.s AND f.e
  WHERE NOT (f.doc_id = fd AND f.s <= fs + (f.e - f.s))
)
SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.idx) FILTER (WHERE gone.idx IS NULL), '') AS text,
  count(*) FILTER (WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')) AS n_lines, count(gone.idx) AS n_removed
FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.idx = l.idx GROUP BY l.doc_id
"""
