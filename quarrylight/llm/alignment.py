"""Alignment of two tokenizers: which tokens of one cover the same bytes as which tokens of the other.

A text is encoded by a byte-level vocabulary (A) and by a piece vocabulary (B).  Sums of token lengths give
the ends of all tokens of a batch of texts, their intersection the common cuts, and a binary search the group
of tokens between two cuts that each token lies in.  Repeats by group sizes expand groups to links.  Each
document's distinct linked pairs of ids are written once; how many documents hold a pair is summed in two
steps, the first over a salt, so that no pair is summed in one place from all tasks.  Pairs held by many
documents, at most ``FREQUENT`` by count, are looked up in a table that every task gets; the rest are joined.

Both tokenizers treat a text piecewise between single spaces and line ends, so pieces are encoded once and
remembered in the worker; a worker that forgets them encodes them again.

Defined results: texts that are null, empty or changed by a tokenizer have no tokens, so zeros and an empty
digest; texts are read whole, long ones in pieces; a row is a document, so repeated rows count once each and
get equal results; an empty table gives no rows; other columns of the input play no part.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import Scratch, read
from quarrylight.llm.pieces import MODEL

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
#: Pairs that every task gets, at most: 17 bytes each.
FREQUENT = 1 << 19
#: Tasks are dealt over so many salts in the first step of counting.
SALTS = 16
#: Pieces of text that a worker remembers.
MEMORY = 300_000
#: Characters of texts that are aligned at once; a longer text is by itself.
TOGETHER_CHARS = 1 << 19
#: Pieces that are encoded in one call.
TOGETHER = 512
#: Fixed: how byte-level vocabularies of this kind split a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Links that are expanded at once.
SLICE = 1 << 22
#: Groups with more links than this are first reduced to their distinct ids.
WIDE = 1 << 12


def _byte_of() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: themselves where printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Places(dict):
    """Numbers of pieces in the order in which they are first asked for."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        place = self[piece] = len(self)
        return place


class Tokenizers:
    """Both vocabularies, and what they make of pieces of text met before."""

    def __init__(self, byte_bpe: str, model: str):
        import sentencepiece
        import tiktoken

        stored = json.loads(open(byte_bpe, encoding="utf-8").read())
        special = {t["content"] for t in stored.get("added_tokens", ())}
        of = _byte_of()
        words = sorted(stored["model"]["vocab"], key=stored["model"]["vocab"].get)
        bytes_a = [w.encode() if w in special else bytes(of[c] for c in w) for w in words]
        # ids are given in the order of merges, so they are the ranks; special tokens take no part in a text
        ranks = {x: i for i, (w, x) in enumerate(zip(words, bytes_a)) if w not in special}
        self.a = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.bytes = bytes_a, bytes_b
        self.length = [np.array([len(x) for x in t], np.int64) for t in self.bytes]
        self.n_b = len(pieces)
        # the decimal form of each id after a comma, then after the separator that begins a group
        self.said_a = np.array([f",{i}" for i in range(len(words))] + [f";{i}" for i in range(len(words))], "S")
        self.said_b = np.array([f",{i}" for i in range(len(pieces))] + [f"|{i}" for i in range(len(pieces))], "S")
        self.width_a, self.width_b = np.char.str_len(self.said_a), np.char.str_len(self.said_b)
        self.forget()

    def forget(self) -> None:
        self.known = Places()
        self.same: np.ndarray = np.zeros(0, bool)
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.starts, self.counts = ([np.zeros(0, np.int64), np.zeros(0, np.int64)] for _ in range(2))  # of a piece's ids

    def learn(self) -> None:
        """Encode the pieces that ``known`` has met since the last call."""
        new, self.known.new = self.known.new, []
        if not new:
            return
        # pieces that follow each other in a text may as well do so here, many in one call
        alone = np.array(["▁" in p or p[-1].isspace() for p in new])
        plain = np.flatnonzero(~alone)
        order, found, counts = [], ([], []), ([], [])
        for part in np.array_split(plain, -(-len(plain) // TOGETHER)) if len(plain) else []:
            pieces = [new[i] for i in part.tolist()]
            both = [self._together(k, ids, pieces) for k, ids in enumerate(self.encode("".join(pieces)))]
            if None in both:
                alone[part] = True
                continue
            order.append(part)
            for k, (ids, n) in enumerate(both):
                found[k].append(ids)
                counts[k].append(n)
        same = np.ones(len(new), bool)
        for i in np.flatnonzero(alone).tolist():
            order.append([i])
            for k, ids in enumerate(self.encode(new[i])):
                found[k].append(np.array(ids, np.int32))
                counts[k].append([len(ids)])
                same[i] &= b"".join(map(self.bytes[k].__getitem__, ids)) == new[i].encode()
        self.same = np.concatenate([self.same, same])
        order = np.concatenate(order)
        for k in (0, 1):
            n, start = np.concatenate(counts[k]), np.zeros((2, len(new)), np.int64)
            start[0, order], start[1, order] = len(self.ids[k]) + np.cumsum(n) - n, n
            self.ids[k] = np.concatenate([self.ids[k], *found[k]])
            self.starts[k], self.counts[k] = (np.concatenate(x) for x in ((self.starts[k], start[0]), (self.counts[k], start[1])))

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of a text that begins with the space that B adds, or with a line end, before which the added space goes."""
        return self.a.encode_ordinary(text), self.b.encode(text[1:]) if text[0] == " " else self.b.encode(text)[1:]

    def _together(self, k: int, ids: list[int], pieces: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of joined pieces and how many each piece has; None if a token reaches over an end or bytes differ."""
        body = [p.encode() for p in pieces]
        if b"".join(map(self.bytes[k].__getitem__, ids)) != b"".join(body):
            return None
        own, ends = np.array(ids, np.int32), np.cumsum([len(x) for x in body])
        sums = np.cumsum(self.length[k][own])
        at = np.searchsorted(sums, ends)
        return (own, np.diff(at, prepend=-1)) if np.array_equal(sums[at], ends) else None

    def tokens(self, k: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of tokenizer ``k`` for remembered pieces in a row, and how many each has."""
        counts = self.counts[k][places]
        at = np.repeat(self.starts[k][places] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
        return self.ids[k][at], counts


@lru_cache(maxsize=1)
def load(byte_bpe: str = BYTE_BPE, model: str = MODEL) -> Tokenizers:
    return Tokenizers(byte_bpe, model)


def cut(text: str) -> list[str]:
    """Space and text in pieces that both tokenizers treat alone: each begins with the space or line end between two characters that are no white space."""
    parts = text.replace("\n", " \n").split(" ")
    pieces = [p if p[:1] == "\n" else " " + p for p in parts]
    words = text.split()
    if " ".join(words) == text.replace("\n", " "):
        return pieces
    out: list[list[str]] = []
    for p in pieces:
        if out and (len(p) == 1 or p[1].isspace() or out[-1][-1][-1].isspace()):
            out[-1].append(p)
        else:
            out.append([p])
    return ["".join(x) for x in out]


def links(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, group_doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, a * width + b) of all links with their numbers of occurrences.

    Tokens come in the order of their groups; group g holds the next ``n_a[g]`` and ``n_b[g]`` of them.
    """
    start_a, start_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    wide = n_a * n_b > WIDE
    keys, times = [], []

    def reduced(key: np.ndarray, count: np.ndarray | None) -> None:
        order = np.argsort(key, kind="stable") if count is not None else None
        key = np.sort(key) if order is None else key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        keys.append(key[first])
        times.append(np.diff(np.r_[first, len(key)]) if order is None else np.add.reduceat(count[order], first) if len(first) else count)

    group = np.repeat(np.arange(len(n_a)), n_a)
    each = np.where(wide, 0, n_b)[group]
    ends = np.cumsum(each)
    at = 0
    while at < len(group):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        rep = each[at:to]
        g = np.repeat(group[at:to], rep)
        inside = np.arange(len(g)) - np.repeat(np.cumsum(rep) - rep, rep)
        reduced((group_doc[g] << 32) + np.repeat(a[at:to], rep).astype(np.int64) * width + b[start_b[g] + inside], None)
        at = to
    for g in np.flatnonzero(wide):
        ids_a, times_a = np.unique(a[start_a[g] : start_a[g] + n_a[g]], return_counts=True)
        ids_b, times_b = np.unique(b[start_b[g] : start_b[g] + n_b[g]], return_counts=True)
        step = max(1, SLICE // len(ids_b))
        for i in range(0, len(ids_a), step):
            key = (group_doc[g] << 32) + ids_a[i : i + step, None].astype(np.int64) * width + ids_b
            reduced(key.ravel(), (times_a[i : i + step, None] * times_b).ravel())
    if len(keys) > 1:
        whole, count = np.concatenate(keys), np.concatenate(times)
        keys.clear()
        times.clear()
        reduced(whole, count)
    key, count = (keys[0], times[0]) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return key >> 32, key & 0xFFFFFFFF, count


def align(texts: list[str | None], t: Tokenizers) -> dict[str, list | np.ndarray]:
    """Counts, digest and distinct linked pairs (a * n_b + b, with offsets by document) of each text."""
    if len(t.known) > MEMORY:
        t.forget()
    pieces = [cut(x) if x else [] for x in texts]
    n = len(texts)
    doc = np.repeat(np.arange(n), [len(own) for own in pieces])
    places = np.fromiter(map(t.known.__getitem__, chain.from_iterable(pieces)), np.int64, len(doc))
    t.learn()
    # A never changes a text and B never makes it longer, so bytes of the whole differ if those of a piece do
    whole = np.ones(n, bool)
    whole[doc[~t.same[places]]] = False
    kept = whole[doc]
    places, doc = places[kept], doc[kept]
    (a, per_a), (b, per_b) = t.tokens(0, places), t.tokens(1, places)
    doc_a, doc_b = np.repeat(doc, per_a), np.repeat(doc, per_b)
    ends_a, ends_b = np.cumsum(t.length[0][a]), np.cumsum(t.length[1][b])
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    n_a, n_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
    after_a, after_b = np.cumsum(n_a), np.cumsum(n_b)
    group_doc = doc_a[after_a - 1] if len(cuts) else np.zeros(0, np.int64)

    # ids in the order of the digest: a group's tokens of A, then of B
    first_a, first_b = (np.r_[True, g[1:] != g[:-1]][: len(g)] for g in (group_a, group_b))
    said = np.zeros(len(a) + len(b), max(t.said_a.dtype, t.said_b.dtype))
    form_a, form_b = a + first_a * (len(t.said_a) // 2), b + first_b * (len(t.said_b) // 2)
    said[np.arange(len(a)) + (after_b - n_b)[group_a]] = t.said_a[form_a]
    said[np.arange(len(b)) + after_a[group_b]] = t.said_b[form_b]
    sizes = np.r_[0, np.cumsum(np.bincount(doc_a, t.width_a[form_a], n) + np.bincount(doc_b, t.width_b[form_b], n))].astype(np.int64)
    body = said.tobytes().replace(b"\0", b"")
    digests = [hashlib.sha256(body[x + 1 : y]).hexdigest() if y > x else "" for x, y in zip(sizes[:-1].tolist(), sizes[1:].tolist())]

    of, pair, times = links(a, b, n_a, n_b, group_doc, t.n_b)
    count = lambda x, w=None: np.bincount(x, w, minlength=n).astype(np.int64)
    return {"n_a": count(doc_a), "n_b": count(doc_b), "n_groups": count(group_doc), "n_links": _sums(times, np.r_[0, np.cumsum(count(of))]), "groups_sha256": digests, "offsets": np.r_[0, np.cumsum(count(of))], "pairs": pair, "times": times}


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(values)].astype(np.int64)[offsets])


DIGEST = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def aligned(docs: DataFrame, byte_bpe: str = BYTE_BPE, model: str = MODEL) -> DataFrame:
    """For each row of ``docs(doc_id, text)`` its alignment and its distinct linked pairs with their occurrences; ``row`` is unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(byte_bpe, model)
        row = TaskContext.get().partitionId() << 40
        for batch in small(batches):
            found = align(batch.column(1).to_pylist(), t)
            offsets = pa.array(found["offsets"], pa.int32())
            arrays = [pa.array(np.arange(row, row + len(batch)), pa.int64()), batch.column(0), *(pa.array(found[k], pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")), pa.array(found["groups_sha256"], pa.string())]
            arrays += [pa.ListArray.from_arrays(offsets, pa.array(found[k], v)) for k, v in (("pairs", pa.int32()), ("times", pa.int64()))]
            row += len(batch)
            yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", *(x.split()[0] for x in DIGEST.split(", ")), "pairs", "times"])

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(batch):
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TOGETHER_CHARS, "right")))
                yield batch.slice(at, to - at)
                at = to

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, f"row long, doc_id long, {DIGEST}, pairs array<int>, times array<long>")


def pair_counts(table: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): how many documents hold a pair, and whether no pair of its A id is held by more."""
    part = table.select(F.explode("pairs").alias("pair"), (F.spark_partition_id() % SALTS).alias("salt")).groupBy("pair", "salt").agg(F.count(F.lit(1)).alias("n"))
    whole = part.groupBy("pair").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(F.floor(F.col("pair") / n_b))  # at most one row for each id of B
    return whole.select("pair", "n", (F.col("n") == F.max("n").over(own)).alias("best"))


def _frequent_from(counts: DataFrame, most: int) -> int:
    """The least count with at most ``most`` pairs at or above it, to an eighth of a power of two."""
    step = F.floor(F.log2("n") * 8).cast("int")
    left, least = most, 1 << 62
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("pairs"), F.min("n").alias("least")).collect(), key=lambda r: -r.step):
        left -= r.pairs
        if left < 0:
            break
        least = r.least
    return least


def align_documents(docs: DataFrame, byte_bpe: str = BYTE_BPE, model: str = MODEL, frequent: int = FREQUENT) -> DataFrame:
    """One row for each row of ``docs``: sizes, digest, and its links weighed by how many documents hold their pairs."""
    spark = docs.sparkSession
    keep = Scratch(spark, "alignment")
    n_b = load(byte_bpe, model).n_b
    table = keep.keep(aligned(docs, byte_bpe, model), "pairs")
    counts = keep.keep(pair_counts(table, n_b), "counts")
    least = _frequent_from(counts, frequent)
    often = counts.where(F.col("n") >= least).toArrow()  # a row for each frequent pair
    order = np.argsort(often["pair"].to_numpy())
    sent = spark.sparkContext.broadcast(tuple(often[c].to_numpy(zero_copy_only=False)[order] for c in ("pair", "n", "best")))
    names = ["row", "pair", "times", "digest"]
    digest = [x.split()[0] for x in f"doc_id long, {DIGEST}, n_best long, count_sum long".split(", ")]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row with what is known for each document, then one for each of its pairs that is not frequent."""
        pairs, n, best = sent.value
        for batch in batches:
            own, times, offsets = (x.to_numpy() for x in (batch.column("pairs").flatten(), batch.column("times").flatten(), batch.column("pairs").offsets))
            offsets = offsets.astype(np.int64) - int(offsets[0]) if len(offsets) else np.zeros(1, np.int64)
            at = np.minimum(np.searchsorted(pairs, own), max(len(pairs) - 1, 0))
            hit = pairs[at] == own if len(pairs) else np.zeros(len(own), bool)
            known = np.where(hit, n[at], 0) if len(pairs) else np.zeros(len(own), np.int64)
            top = hit & best[at] if len(pairs) else hit
            rows = batch.column("row").to_numpy()
            values = [batch.column(c) for c in digest[:-2]] + [pa.array(_sums(x, offsets)) for x in (times * top, times * known)]
            whole = pa.StructArray.from_arrays(values, digest)
            # no pair has a negative number, so these rows meet nothing and lie evenly
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(-1 - rows), pa.nulls(len(rows), pa.int64()), whole], names)
            rest = ~hit
            of = np.repeat(rows, np.diff(offsets))[rest]
            yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(own[rest].astype(np.int64)), pa.array(times[rest]), pa.nulls(len(of), whole.type)], names)

    rows = table.mapInArrow(look_up, f"row long, pair long, times long, digest struct<{', '.join(f'{x.split()[0]}:{x.split()[1]}' for x in f'doc_id long, {DIGEST}, n_best long, count_sum long'.split(', '))}>")
    rare = counts.where(F.col("n") < least).select(F.col("pair").cast("long").alias("pair"), "n", "best")
    joined = rows.join(rare, "pair", "left")
    out = joined.groupBy("row").agg(F.max("digest").alias("d"), F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    added = {c: (F.col(f"d.{c}") + F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("n_best", "count_sum")}
    return out.select(*(f"d.{c}" for c in digest[:-3]), *added.values(), "d.groups_sha256")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(read(spark, sf_dir, "documents"))
