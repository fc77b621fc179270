"""SentencePiece encoding and decoding by a batched Viterbi over a fixed public vocabulary.

A text gets a space in front, spaces count as the vocabulary's space mark, and the segmentation with
the largest sum of the stored piece scores is taken (of equal ones, that whose last piece is longest).
Characters without a piece go by the pieces of their UTF-8 bytes.  No piece holds a space after
another character or a line feed, so texts are cut there without loss and each distinct cut is encoded
once.  Cuts of equal length advance together; longer ones are cut into windows of equal length, which
advance together too: from each place where the last piece before a window may end, all maxima within it
are taken at once, and then linked from window to window.  Decoding gives the text back exactly.

Defined results: a null text encodes as no pieces and decodes as the empty text; repeated rows give
repeated results; an empty table gives no rows; texts are read whole, and words of any length in memory
of some bytes a character; other columns of the input play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import read, small_batches
from quarrylight.llm.pieces import MODEL, Pieces, by_length, load

#: Longer cuts advance in windows of this length.
MATRIX_LENGTH = 64
#: Windows whose maxima are taken at once.
WINDOWS = 1024
#: Encoded cuts that a worker remembers.
MEMORY = 100_000
_CUTS = re.compile(r"\n| *[^ \n]+| +")
_LOW = np.int64(-(10**15))


def _tokens(pieces: Pieces, points: np.ndarray, chosen: np.ndarray, ids: np.ndarray, count: int) -> bytes:
    # ids are right-aligned; -1 stands for a character without a piece
    if (ids[-count:] >= 0).all():
        return ids[-count:].tobytes()
    out: list[int] = []
    for i, at in zip(ids[-count:], chosen[-count:]):
        if i >= 0:
            out.append(int(i))
        else:
            point = int(points[at])
            out.extend(pieces.byte_id[b] for b in chr(0x2581 if point == 0x110000 else point).encode("utf-8", "surrogatepass"))
    return np.array(out, np.int32).tobytes()


def _together(pieces: Pieces, points: np.ndarray) -> list[bytes]:
    n, length = points.shape
    at = pieces.at(points)
    gain = [np.where(p >= 0, pieces.scores[p], _LOW) for p in at]
    gain[0] = np.where(at[0] >= 0, gain[0], pieces.unknown)
    best = np.zeros((length + 1, n), np.int64)
    back = np.zeros((length + 1, n), np.int32)
    for end in range(1, length + 1):
        top, take = np.full(n, 2 * _LOW), np.zeros(n, np.int32)
        for k in range(min(end, len(at)), 0, -1):
            total = best[end - k] + gain[k - 1][:, end - k]
            better = total > top
            top = np.where(better, total, top)
            take[better] = k
        best[end], back[end] = top, take
    ids = np.zeros((n, length), np.int32)
    start = np.zeros((n, length), np.int32)
    here, count, rows = np.full(n, length), np.zeros(n, np.int64), np.arange(n)
    while len(rows):
        step = back[here[rows], rows]
        begin = here[rows] - step
        count[rows] += 1
        for k in np.unique(step):
            own = rows[step == k]
            found = at[k - 1][own, begin[step == k]]
            ids[own, length - count[own]] = np.where(found >= 0, pieces.ids[found], -1)
        start[rows, length - count[rows]] = begin
        here[rows] = begin
        rows = rows[begin > 0]
    data, width = ids.tobytes(), 4 * length
    out = [data[width * (i + 1) - 4 * c : width * (i + 1)] for i, c in enumerate(count.tolist())]
    for i in np.flatnonzero((ids == -1).any(axis=1)):
        out[i] = _tokens(pieces, points[i], start[i], ids[i], int(count[i]))
    return out


def _windows(pieces: Pieces, words: list[str]) -> Iterator[bytes]:
    """The pieces of long cuts: the maxima of ``_together``, in windows of MATRIX_LENGTH characters."""
    reach, size, points = pieces.longest, MATRIX_LENGTH, []
    for word in words:
        ((_, own),) = by_length([word])
        points.append(own[0])
    counts = [-(-len(x) // size) for x in points]
    # each window with the characters before it in which a piece that ends in it may begin
    rows = np.full((sum(counts), reach + size), 0x110001, np.uint32)
    row = 0
    for own, n in zip(points, counts):
        spread = np.full(reach + n * size, 0x110001, np.uint32)
        spread[reach : reach + len(own)] = own
        rows[row : row + n] = np.lib.stride_tricks.sliding_window_view(spread, reach + size)[::size]
        row += n
    starts = np.zeros(len(rows), bool)
    starts[np.cumsum([0, *counts[:-1]])] = True
    taken, found = np.zeros((len(rows), size), np.int8), np.zeros((len(rows), size), np.int32)
    held = np.full(reach, _LOW)
    for a in range(0, len(rows), WINDOWS):
        part = rows[a : a + WINDOWS]
        n, at = len(part), pieces.at(part)
        gain = [np.where(p >= 0, pieces.scores[p], _LOW) for p in at]
        gain[0] = np.where(at[0] >= 0, gain[0], pieces.unknown)
        # best[e][:, s]: from s characters before the window to character e of the row
        best = np.full((reach + size + 1, n, reach), 4 * _LOW)
        for s in range(reach):
            best[reach - s, :, s] = 0
        for end in range(reach + 1, reach + size + 1):
            for k in range(1, len(at) + 1):
                np.maximum(best[end], best[end - k] + gain[k - 1][:, end - k, None], out=best[end])
        # the maxima of whole cuts at the last places before each window, from window to window
        into = np.zeros((n, reach), np.int64)
        for i in range(n):
            if starts[a + i]:
                held = np.r_[np.int64(0), np.full(reach - 1, _LOW)]
            into[i] = held
            held = (best[reach + size : size : -1, i] + held).max(axis=1)
        total = np.full((reach + size + 1, n), 4 * _LOW)
        total[reach:0:-1] = into.T
        for end in range(reach + 1, reach + size + 1):
            top, take, piece = np.full(n, 8 * _LOW), np.zeros(n, np.int8), np.zeros(n, np.int32)
            for k in range(len(at), 0, -1):
                score = total[end - k] + gain[k - 1][:, end - k]
                better = score > top
                top = np.where(better, score, top)
                take[better] = k
                piece[better] = at[k - 1][better, end - k]
            total[end], taken[a : a + n, end - reach - 1], found[a : a + n, end - reach - 1] = top, take, piece
    row = 0
    for own, n in zip(points, counts):
        back = taken[row : row + n].reshape(-1)
        ends, end = [], len(own)
        while end:
            ends.append(end)
            end -= int(back[end - 1])
        ends = np.array(ends[::-1])
        piece = found[row : row + n].reshape(-1)[ends - 1]
        yield _tokens(pieces, own, ends - back[ends - 1], np.where(piece >= 0, pieces.ids[piece], -1).astype(np.int32), len(ends))
        row += n


class Codec:
    """Encodes and decodes texts; remembers up to MEMORY distinct cuts."""

    def __init__(self, path: str = MODEL):
        self.pieces = load(path)
        self.known: dict[str, bytes] = {}

    def encode_cuts(self, cuts: set[str]) -> dict[str, bytes]:
        """Encodes what is not known; short cuts are remembered, long ones returned."""
        new = [w for w in cuts if w not in self.known]
        for rows, points in by_length(new, MATRIX_LENGTH):
            for row, ids in zip(rows, _together(self.pieces, points)):
                self.known[new[row]] = ids
        long = [w for w in new if len(w) > MATRIX_LENGTH]
        out, held, size = {}, [], 0
        for w in long:
            held.append(w)
            size += len(w)
            if size > WINDOWS * MATRIX_LENGTH or w is long[-1]:
                out |= zip(held, _windows(self.pieces, held))
                held, size = [], 0
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The piece ids of each text."""
        out: list[np.ndarray] = []
        held: list[list[str]] = []
        size = 0

        def flush() -> None:
            nonlocal held, size
            if len(self.known) > MEMORY:
                self.known.clear()
            long = self.encode_cuts({w for cuts in held for w in cuts})
            get = (lambda w: self.known[w] if len(w) <= MATRIX_LENGTH else long[w]) if long else self.known.__getitem__
            out.extend(np.frombuffer(b"".join(map(get, cuts)), np.int32) for cuts in held)
            held, size = [], 0

        for text in texts:
            held.append(_CUTS.findall(" " + text) if text else [])
            size += len(held[-1])
            if size > 100_000:
                flush()
        flush()
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece ids, without the space in front."""
        data = b"".join(map(self.pieces.bytes_of.__getitem__, ids.tolist()))
        return data[1 if data[:1] == b" " else 0 :].decode("utf-8", "replace")


def encode(docs: DataFrame, path: str = MODEL, check: bool = True) -> DataFrame:
    """``docs(doc_id, text)`` to (doc_id, n_tokens, token_ids, round_trip).

    round_trip tells whether decoding the ids gives the text; null unless ``check``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                texts = part.column(1).to_pylist()
                ids = codec.encode(texts)
                same = [codec.decode(x) == (t or "") for x, t in zip(ids, texts)] if check else [None] * len(ids)
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), lists, pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "token_ids", "round_trip"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, token_ids) to (doc_id, text); null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            texts = [codec.decode(np.array(x or [], np.int32)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("token_ids").cast("array<int>").alias("token_ids")).mapInArrow(run, "doc_id long, text string")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"))
