"""Pieces of a fixed public vocabulary, found in many words at once.

Words of equal length advance together as a matrix of code points.  Rolling hashes of all substrings
of one length are one array operation; a bitmap rules most of them out, and the rest probe the sorted
piece keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: SentencePiece writes spaces as this; a literal one in a text is no piece and goes by its bytes.
SPACE_MARK = "▁"
_FOREIGN_MARK = 0x110000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STIR = np.uint64(0xBF58476D1CE4E5B9)
_BITS = 21
#: Cells of work (words x positions x lengths) that one matrix may need.
_CELLS = 3_000_000


def _keyed(points: np.ndarray) -> np.ndarray:
    k = (points.astype(np.uint64) + np.uint64(1)) * _STIR
    return k ^ (k >> np.uint64(31))


class Pieces:
    """Sorted keys, ids and stored scores of the ordinary pieces, and the ids of the byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(self.size)]
        self.text = [sp.id_to_piece(i) for i in range(self.size)]
        self.byte_id = np.zeros(256, np.int32)
        for i in range(self.size):
            if sp.is_byte(i):
                self.byte_id[int(self.text[i][3:-1], 16)] = i
        plain = [i for i in range(self.size) if not special[i] and self.text[i]]
        self.longest = max(len(self.text[i]) for i in plain)
        keys = np.array([self._key(self.text[i]) for i in plain], np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one key")
        self.ids = np.array(plain, np.int32)[order]
        scores = np.array([round(sp.get_score(i)) for i in range(self.size)], np.int64)
        self.scores = scores[self.ids]
        #: What a character without a piece costs: more than any ordinary piece.
        self.unknown = int(scores[scores > -(10**8)].min()) - 10
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.bytes_of = [b"" if special[i] else t.replace(SPACE_MARK, " ").encode() for i, t in enumerate(self.text)]
        for b, i in enumerate(self.byte_id):
            self.bytes_of[i] = bytes([b])

    def _key(self, piece: str) -> int:
        h = np.zeros(1, np.uint64)
        for k in _keyed(np.array([ord(c) for c in piece], np.uint32)):
            h = h * _BASE + k
        return int((h ^ (h >> np.uint64(29)))[0])

    def at(self, points: np.ndarray) -> list[np.ndarray]:
        """For each length from 1: which piece begins where, as indexes into keys; -1 for none."""
        keyed = _keyed(points)
        out, h = [], np.zeros_like(keyed)
        length = points.shape[1]
        for n in range(1, min(length, self.longest) + 1):
            h = h[:, : length - n + 1] * _BASE + keyed[:, n - 1 :]
            mixed = h ^ (h >> np.uint64(29))
            found = np.full(h.shape, -1, np.int32)
            maybe = self.bitmap[(mixed >> np.uint64(64 - _BITS)).astype(np.int64)]
            probes = mixed[maybe]
            where = np.searchsorted(self.keys, probes)
            where[where == len(self.keys)] = 0
            found[maybe] = np.where(self.keys[where] == probes, where, -1)
            out.append(found)
        return out


@lru_cache(maxsize=2)
def load(path: str = MODEL) -> Pieces:
    """The vocabulary, read once in each process."""
    return Pieces(path)


def by_length(words: list[str], longest: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in words, code points) for groups of words of equal length; spaces become the mark."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    points[points == ord(SPACE_MARK)] = _FOREIGN_MARK
    points[points == 32] = ord(SPACE_MARK)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(lengths, kind="stable")
    ends = np.flatnonzero(np.r_[lengths[order][1:] != lengths[order][:-1], True]) + 1 if len(words) else []
    begin = 0
    for end in ends:
        length = int(lengths[order[begin]])
        if length and (longest is None or length <= longest):
            step = max(1, _CELLS // (length * min(length, 16)))
            for a in range(begin, end, step):
                rows = order[a : min(a + step, end)]
                yield rows, points[starts[rows][:, None] + np.arange(length)]
        begin = end
