"""Word and shingle hashes of Arrow string columns, computed on their bytes as arrays.

A word is a run of bytes other than ASCII white space, A-Z lowered.  Words of a whole chunk of texts
are hashed at once: prefix sums of a polynomial over the bytes give the hash of every stretch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer text is cut at white space and put together again.
CHUNK = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values = np.random.default_rng(20240607).integers(1, 2**63, 256, np.int64).astype(_U) | _U(1)
    values[65:91] = values[97:123]
    inverse = pow(_BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(CHUNK + 1, _BASE, _U)) * _U(inverse)
        down = np.cumprod(np.full(CHUNK + 1, inverse, _U)) * _U(_BASE)
    return values, up, down


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _words(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words; a word never reaches over a break (start of a text)."""
    values, up, down = _tables()
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[breaks] = inside[breaks]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = breaks[breaks > 0] - 1
    last[before] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends + 1] - sums[starts]) * down[starts] + (ends - starts).astype(_U)), starts


def word_hashes(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text of a string column its word hashes, in order; nulls have none."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    row, n = 0, len(column)
    while row < n:
        begin = offsets[row]
        end_row = int(np.searchsorted(offsets, begin + CHUNK, "right")) - 1
        end_row = min(max(end_row, row + 1), n)
        if offsets[end_row] - begin > CHUNK:
            yield _long(data[begin : offsets[end_row]])
        else:
            part = data[begin : offsets[end_row]]
            bounds = offsets[row : end_row + 1] - begin
            if len(part):
                hashes, starts = _words(part, bounds[:-1][bounds[:-1] < len(part)])
                cuts = np.searchsorted(starts, bounds)
            else:
                hashes, cuts = np.zeros(0, _U), np.zeros(len(bounds), np.int64)
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield hashes[a:b]
        row = end_row


def _long(data: np.ndarray) -> np.ndarray:
    out, begin = [], 0
    while begin < len(data):
        end = min(begin + CHUNK, len(data))
        if end < len(data):
            spaces = np.flatnonzero(_SPACE[data[begin:end]])
            if not len(spaces):
                return np.concatenate([*out, _huge_word(data, begin)])
            end = begin + int(spaces[-1]) + 1
        out.append(_words(data[begin:end], np.zeros(1, np.int64))[0])
        begin = end
    return np.concatenate(out)


def _huge_word(data: np.ndarray, begin: int) -> np.ndarray:
    # a single word longer than a chunk: the same sum, continued from chunk to chunk
    spaces = np.flatnonzero(_SPACE[data[begin:]])
    end = begin + int(spaces[0]) if len(spaces) else len(data)
    values, up, _ = _tables()
    total, scale = 0, 1
    for a in range(begin, end, CHUNK):
        part = data[a : min(a + CHUNK, end)]
        total = (total + int(np.sum(values[part] * up[: len(part)], dtype=_U)) * scale) % (1 << 64)
        scale = scale * pow(_BASE, CHUNK, 1 << 64) % (1 << 64)
    word = mix(np.array([(total + end - 1 - begin) % (1 << 64)], _U))
    return np.concatenate([word, _long(data[end:])]) if end < len(data) else word


def shingle_set(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of fewer words, the whole sequence as one."""
    if not len(words):
        return words
    size = min(n, len(words))
    total = np.full(len(words) - size + 1, size, _U)
    for k in range(size):
        total = total * _U(_BASE) + words[k : len(words) - size + 1 + k]
    return np.unique(mix(total))
