"""Periodic stretches of words: all runs from Lyndon arrays on an ordered alphabet, in linear time.

A run is a stretch of words with a smallest period that no neighbour extends.  Every run shows in the
Lyndon array of the text under the order of its words or under the reversed order: from some position on,
the longest Lyndon word is the period, so the position and its next smaller suffix are one period apart.
``lyndon_roots`` finds the previous and next smaller suffix of every position from left to right with a
stack, comparing words by order alone.  What it compares is never compared again: the match that reaches
furthest right is kept, positions within it take the lengths found one shift earlier, positions below on
the stack take the smaller of two known lengths, and only a match that reaches the furthest end goes on
from there.  No suffix structure and no hash is used.

Defined results: a null text has no words; an empty text neither; texts of any length are read whole,
with a list of words and one of numbers as the state; equal rows give equal rows; a null doc_id leaves
its text as it is; an empty table gives no rows; other columns of the input play no part.  Of runs with
equal exponent the first is reported, then the one with the shorter period.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator, Sequence
from operator import gt, lt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import SPACE, read

#: A run counts from so many words on, and from so many periods.
MIN_WORDS = 24
MIN_PERIODS = 3

_WORD = re.compile(f"[^{SPACE}]+")


def lyndon_roots(words: Sequence, above=gt) -> Iterator[tuple[int, int, int]]:
    """(start, next, length): ``next`` is the next smaller suffix of ``start`` and both begin with ``length`` equal words.

    Given are those with ``length`` of a period or more, which every run of three periods has.  ``above`` is the
    order of words: ``gt``, or ``lt`` for the reversed one.  The last word must differ from all others, so that every
    comparison ends; the text ends before it.
    """
    n = len(words) - 1
    before = [-1] * n  # previous smaller suffix
    same: dict[int, int] = {}  # words that a position shares with its previous smaller suffix, where there are any
    popped: dict[int, int] = {}  # words that a position shares with its next smaller suffix, likewise
    low, shift, end = 0, 0, 0  # the match that reaches furthest: words from low to end equal those one shift earlier
    for i in range(1, n):
        word, j = words[i], i - 1
        inside = low < i < end
        if not inside:  # most positions of a text: the first words decide
            if above is gt:
                while j >= 0 and words[j] > word:
                    j = before[j]
            else:
                while j >= 0 and above(words[j], word):
                    j = before[j]
            if j < 0 or words[j] != word:
                before[i] = j
                continue
        m = -1  # words shared by the last position compared and i; -1: none compared yet
        while j >= 0:
            if m < 0 or inside and j >= low and i + m < end:
                if inside:
                    # one shift earlier the same pair was compared, up to the end of the match
                    at = j - shift
                    m = same.get(i - shift, 0) if before[i - shift] == at else popped.get(at, 0)
                    if i + m >= end:
                        m = end - i
                        grow = True
                    else:
                        grow = False
                else:
                    m, grow = 0, True
            else:
                known = same.get(last, 0)  # j is the previous smaller suffix of the position compared last
                grow = known == m
                m = min(m, known)
            if grow:
                while words[j + m] == words[i + m]:
                    m += 1
                if i + m > end:
                    low, shift, end = i, i - j, i + m
            if not above(words[j + m], words[i + m]):
                break
            if m:
                popped[j] = m
                if m >= i - j:
                    yield j, i, m
            last, j = j, before[j]
        before[i] = j
        if j >= 0 and m:
            same[i] = m


def runs_of(words: list[str], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs with ``min_words`` words and ``min_periods`` periods (3 at least), by start, then period."""
    text = [*words, ""]
    found = set()
    for above in (gt, lt):
        roots = {}
        for j, i, m in lyndon_roots(text, above):
            roots[j] = (i, m)
        for j, (i, m) in roots.items():
            period = i - j
            if roots.get(j - period, (-1, 0))[0] == j:
                continue  # the root before shows the same run
            back = 0
            while back < j and text[j - 1 - back] == text[i - 1 - back]:
                back += 1
            length = back + period + m
            if length >= max(min_words, min_periods * period):
                found.add((j - back, length, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """Every tenth document, by the checksum of its id, repeats some of its words up to its end."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact exponent; ties go to the smallest start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    out, at = [], 0
    for a, b in sorted((s + p, s + n) for s, n, p in runs):
        out += words[at:a] if a > at else []
        at = max(at, b)
    return out + words[at:]


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_kept long"
_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
_TYPES = [pa.string() if f.endswith("string") else pa.int64() for f in SCHEMA.split(", ")]


def _row(doc_id: int | None, text: str | None) -> tuple:
    words = planted(_WORD.findall(text or ""), doc_id)
    runs = runs_of(words)
    start, length, period = greatest(runs) or (None,) * 3
    kept = collapsed(words, runs)
    digests = (hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{p}\n" for s, n, p in runs), " ".join(kept)))
    return doc_id, len(runs), start, length, period, 1000 * length // period if runs else None, *digests, len(words), len(kept)


def find_runs(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs(doc_id, text)``: its runs in numbers and digests, and the digest of the text without repeats.

    Documents are independent, so no row moves.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_row(doc_id, text.as_py()) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)], _NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, SCHEMA)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_runs(read(spark, sf_dir, "documents"))
