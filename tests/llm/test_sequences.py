"""Runs, fingerprints and alignment of tokenizers, against brute force and on odd tables."""

import hashlib
import random
import zlib
from collections import Counter
from operator import gt, lt

import numpy as np
import pytest

from quarrylight.llm import alignment, fingerprint, runs

ODD = [(1, None), (2, ""), (None, "no id here"), (3, " \n\t "), (4, "x " * 90), (4, "x " * 90), (5, "a b c " * 30 + "end"), (6, "日本 é ſ\n\ntwo  spaces ▁ <|endoftext|>"), (7, "one")]


def table(spark, rows):
    """Rows of documents with further columns, one of which has the name of a result."""
    return spark.createDataFrame([(*r, "x", 1.5) for r in rows], "doc_id long, text string, fingerprint string, period double")


# -- runs


def brute_runs(words, min_words, min_periods):
    n, out = len(words), set()
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            size = i + p - start
            if i > start and size >= max(min_words, min_periods * p):
                own = words[start : start + size]
                if not any(own[q:] == own[: size - q] for q in range(1, p)):
                    out.add((start, size, p))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng):
    letters = "abcd"[: rng.choice([1, 2, 2, 3, 4])]
    if rng.random() < 0.4:
        return [rng.choice(letters) for _ in range(rng.randrange(60))]
    out = []
    while len(out) < rng.randrange(120):
        block = [rng.choice(letters) for _ in range(rng.randrange(1, 8))]
        out += (block * rng.randrange(1, 7))[: rng.randrange(1, 30)]
        if rng.random() < 0.3:
            out += out[-rng.randrange(1, 20) :] * rng.randrange(1, 5)
    return out[:200]


def test_runs_equal_brute_force():
    rng = random.Random(11)
    for _ in range(500):
        words = some_words(rng)
        for least in (1, 24):
            assert runs.runs_of(words, least) == brute_runs(words, least, 3), words


class Counted:
    """A word that counts its comparisons."""

    made = 0

    def __init__(self, value):
        self.value = value

    def __eq__(self, other):
        Counted.made += 1
        return self.value == other.value

    def __gt__(self, other):
        Counted.made += 1
        return self.value > other.value

    def __lt__(self, other):
        Counted.made += 1
        return self.value < other.value


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("above", [gt, lt])
@pytest.mark.parametrize("text", ["a" * 30_000, fibonacci(30_000), ("abcabdabcabe" * 3000)[:30_000], fibonacci(10_000) * 3, "".join("a" * k + "b" for k in range(1, 240)), "".join(random.Random(3).choices("ab", k=30_000))])
def test_comparisons_are_linear(text, above):
    Counted.made = 0
    for _ in runs.lyndon_roots([*map(Counted, text), Counted("")], above):
        pass
    assert Counted.made < 7 * len(text)


def brute_row(doc_id, text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w]
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words, 24, 3)
    dropped = {i for s, n, p in found for i in range(s + p, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(found, key=lambda r: (-__import__("fractions").Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def key(r):
    return tuple((x is None, x) for x in r)


def test_runs_of_documents(spark):
    rng = random.Random(5)
    rows = ODD + [(i, " ".join(some_words(rng)) + rng.choice(["", "\n"])) for i in range(100, 180)]
    got = [tuple(r)[:8] for r in runs.find_runs(table(spark, rows)).collect()]
    assert sorted(got, key=key) == sorted((brute_row(*r) for r in rows), key=key)
    assert runs.find_runs(table(spark, rows[:0])).count() == 0


def test_runs_of_a_long_text(spark):
    (row,) = runs.find_runs(table(spark, [(1, "w " * 10 + "a b c " * 100_000)])).collect()
    assert (row.n_runs, row.start, row.length, row.period, row.n_kept) == (1, 10, 300_000, 3, 13)


# -- fingerprints


def brute_print(text):
    body = text.encode()
    counts = [0] * fingerprint.BUCKETS
    padded, t = body + bytes(4), fingerprint._TABLES
    for i in range(len(body)):
        for salt, (j, k) in enumerate(fingerprint.SHAPES):
            counts[int(t[0][padded[i]]) ^ int(t[j][padded[i + j]]) ^ int(t[k][padded[i + k]]) ^ (21 * salt)] += 1
    ordered = sorted(counts)
    codes = [sum(c > ordered[q * 32 - 1] for q in (1, 2, 3)) for c in counts]
    size = 1 + int(np.log(len(body)) / np.log(1.1)) if body else 0
    return bytes([min(size, 255), *(codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3] for i in range(0, 128, 4))]).hex()


def brute_likeness(a, b):
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    far = sum(((p >> s & 3) - (q >> s & 3)) ** 2 for p, q in zip(x[1:], y[1:]) for s in (0, 2, 4, 6))
    return 1 - (far + min(abs(x[0] - y[0]), 24)) / (9 * 128 + 24)


def test_fingerprints_equal_brute_force(monkeypatch):
    rng = random.Random(7)
    texts = ["", "a", "ab", "\0" * 5, "é" * 9] + ["".join(rng.choices("abc déß\n", k=rng.randrange(300))) for _ in range(60)]
    expected = [brute_print(t) for t in texts]
    for size in (1 << 21, 37):
        monkeypatch.setattr(fingerprint, "SLICE", size)
        assert fingerprint.fingerprints(texts) == expected
    assert fingerprint.likeness(expected, expected[::-1]).tolist() == [brute_likeness(a, b) for a, b in zip(expected, expected[::-1])]
    assert fingerprint.fingerprints([]) == []


def brute_edits(rows):
    """Rows with distinct ids, each edited by the next."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0]))
    out = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        n = len(t) // 4
        changed = t[: len(t) - n] + after[:n]
        a, b = brute_print(t), brute_print(changed)
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), a, b, brute_likeness(a, b), brute_likeness(a, brute_print(after))))
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_edited_documents(spark, parts):
    rng = random.Random(parts)
    rows = [(1, None), (2, ""), (None, "no id here"), (7, "one")] + [(i, "".join(rng.choices("abcdé \n", k=rng.randrange(200)))) for i in rng.sample(range(10, 9999), 60)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = fingerprint.edited_documents(table(spark, rows).repartition(parts)).collect()
        assert sorted(map(tuple, got), key=key) == sorted(brute_edits(rows), key=key)
        copies = fingerprint.edited_documents(table(spark, [(9, "same text")] * 500 + ODD)).collect()
        assert len(copies) == 500 + len(ODD) and sum(r.near_next == 1 for r in copies) >= 499
        (single,) = fingerprint.edited_documents(table(spark, [(3, "all by itself")])).collect()
        assert single.near_next == 1 and single.n_chars == 13
        assert fingerprint.edited_documents(table(spark, ODD[:0])).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_likeness_tells_edits_from_other_texts():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(500)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(80, 400))) for _ in range(80)]
    prints = fingerprint.fingerprints(texts)
    near = fingerprint.likeness(prints, fingerprint.fingerprints([fingerprint.edited(a, b) for a, b in zip(texts, texts[1:] + texts[:1])]))
    other = fingerprint.likeness(prints, prints[1:] + prints[:1])
    assert (near > other).mean() > 0.95


# -- alignment


@pytest.fixture(scope="module")
def whole():
    """The library's own encoding of a whole text by the stored vocabulary."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(alignment.BYTE_BPE)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def brute_align(text, whole):
    t = alignment.load()
    if not text:
        return 0, 0, 0, "", Counter()
    a, b = whole(" " + text), t.b.encode(text)
    said = [[t.bytes[k][i] for i in ids] for k, ids in enumerate((a, b))]
    if any(b"".join(x) != (" " + text).encode() for x in said):
        return 0, 0, 0, "", Counter()
    ends = [np.cumsum([len(y) for y in x]).tolist() for x in said]
    groups, found, i, j = [], Counter(), 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        i0, j0, i, j = i, j, ends[0].index(cut) + 1, ends[1].index(cut) + 1
        groups.append(",".join(map(str, a[i0:i])) + "|" + ",".join(map(str, b[j0:j])))
        found.update((x, y) for x in a[i0:i] for y in b[j0:j])
    return len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), found


BITS = [" ", "\n", "\t", "  ", "\n\n", "word", "ing", "12345", "é", "ß", "日本", "😀", "▁", "　", "\x85", "\x1c", " ", "<s>", "<|endoftext|>", "...", "'s", "a" * 15, "-" * 17, "́", "\r\n", "​", "\0", "Straße"]


@pytest.mark.parametrize(("wide", "size"), [(1 << 12, 1 << 22), (1, 5), (4, 7)])
def test_groups_and_links_equal_brute_force(whole, monkeypatch, wide, size):
    monkeypatch.setattr(alignment, "WIDE", wide)
    monkeypatch.setattr(alignment, "SLICE", size)
    rng, t = random.Random(size), alignment.load()
    for step in range(120):
        monkeypatch.setattr(alignment, "MEMORY", rng.choice([3, 10_000]))
        texts = [rng.choice([None, ""] + 4 * ["".join(rng.choices(BITS, k=rng.randrange(14)))]) for _ in range(rng.randrange(9))]
        got = alignment.align(texts, t)
        for i, text in enumerate(texts):
            n_a, n_b, n_groups, digest, found = brute_align(text, whole)
            a, b = got["offsets"][i : i + 2]
            assert (got["n_a"][i], got["n_b"][i], got["n_groups"][i], got["groups_sha256"][i], got["n_links"][i]) == (n_a, n_b, n_groups, digest, found.total()), text
            assert dict(zip(got["pairs"][a:b].tolist(), got["times"][a:b].tolist())) == {x * t.n_b + y: n for (x, y), n in found.items()}


def brute_documents(rows, whole):
    each = [brute_align(t, whole) for _, t in rows]
    held = Counter(p for x in each for p in x[4])
    top = {}
    for (a, _), n in held.items():
        top[a] = max(n, top.get(a, 0))
    return [(i, *x[:3], x[4].total(), sum(n for p, n in x[4].items() if held[p] == top[p[0]]), sum(n * held[p] for p, n in x[4].items()), x[3]) for (i, _), x in zip(rows, each)]


@pytest.mark.parametrize("frequent", [0, 20, 1 << 19])
def test_aligned_documents(spark, whole, frequent):
    rng = random.Random(frequent)
    rows = ODD + [(i, " ".join(rng.choices(["the", "word", "aligned", "Straße", "tokens,", "日本", "x\ny"], k=rng.randrange(40)))) for i in range(100, 160)]
    got = alignment.align_documents(table(spark, rows), frequent=frequent)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_documents(rows, whole), key=key)
    assert alignment.align_documents(table(spark, rows[:0]), frequent=frequent).count() == 0


def test_alignment_of_a_long_text(spark, whole):
    text = "some words in a row\n" * 1500 + "x" * 3000
    (row,) = alignment.align_documents(table(spark, [(1, text)])).collect()
    assert tuple(row) == brute_documents([(1, text)], whole)[0]
