"""Each operator against brute force, an exact round trip or held-out accuracy, and on odd rows."""

import hashlib
import itertools
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import ann, html_extract, jaccard, langid, line_dedup, mixing, pii, quality, sp_codec, warc
from quarrylight.llm.common import Scratch
from quarrylight.llm.components import components
from quarrylight.llm.pieces import load

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, extra int, size int, n int, text_hash long, pattern string"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "p") for r in rows], DOCS)


def corpus(n=60, seed=3):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(300)]
    line = lambda k: " ".join(r.choice(words) for _ in range(k))
    shared = [line(60), line(30) + "\n" + line(30), line(8)]
    out = []
    for i in range(n):
        parts = [line(r.randint(1, 40)) for _ in range(r.randint(1, 8))]
        if r.random() < 0.5:
            parts.insert(r.randrange(len(parts) + 1), r.choice(shared))
        if out and r.random() < 0.3:
            text = r.choice(out)[1] or ""
            words_ = text.split(" ")
            if words_ and r.random() < 0.6:
                words_[r.randrange(len(words_))] = "edited"
            parts = [" ".join(words_)]
        out.append((i, "\n".join(parts), r.choice(["en", "de"]), r.choice(["a", "b", None])))
    out += [(900, None, "en", "a"), (901, "", None, "b"), (902, " \n\t", "en", None), (None, "null id text here", "en", "a"), (903, "ÉÀ x" * 3, "de", "a"), (904, "same row", "en", "a"), (904, "same row", "en", "a")]
    return out


# --- 1 ------------------------------------------------------------------------------------------


def brute_lines(rows, least=line_dedup.MIN_WORDS):
    """Every run of lines of so many words that occurs before goes, but not where it overlaps its first occurrence."""
    seen, gone, split = {}, {}, {}
    unique = sorted({(d, t) for d, t, *_ in rows}, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
    windows = []
    for d, t in unique:
        ls = [(i, " ".join(w)) for i, x in enumerate((t or "").split("\n")) if (w := WORD.findall(x))]
        split[(d, t)] = ls
        n = [len(x.split(" ")) for _, x in ls]
        for a in range(len(ls)):
            for b in range(a, len(ls)):
                if sum(n[a : b + 1]) >= least and (sum(n[a:b]) < least or sum(n[a + 1 : b + 1]) < least):
                    windows.append(((d is None, d or 0, t or "", a), tuple(x for _, x in ls[a : b + 1]), (d, t), a, b))
    for place, body, doc, a, b in sorted(windows):
        first = seen.setdefault(body, (place, doc, a))
        if first[0] != place and not (first[1] == doc and a <= first[2] + b - a):
            gone.setdefault(doc, set()).update(split[doc][i][0] for i in range(a, b + 1))
    return {k: "\n".join(x for i, x in enumerate((k[1] or "").split("\n")) if i not in gone.get(k, ())) for k in split}


def test_line_dedup_brute_force(spark):
    data = corpus()
    expected = brute_lines(data)
    got = line_dedup.dedup_documents(docs_of(spark, data)).collect()
    assert len(got) == len(data)
    byid = {(d, t): None for d, t, *_ in data}
    for r in got:
        options = {expected[k] for k in byid if k[0] == r["doc_id"]}
        assert (r["text"] or "") in options
        assert r["extra"] == 1 and r["text_hash" if "text_hash" in r else "n"] is not None
    assert sum(r["n_removed"] for r in got) > 0


def test_line_dedup_self_overlap_and_empty(spark):
    line = " ".join(["x"] * 25)
    docs = docs_of(spark, [(1, "\n".join([line] * 6), "en", "a")])
    assert line_dedup.dedup_documents(docs).first()["text"].split("\n") == [line] * 2
    assert line_dedup.dedup_documents(docs.limit(0)).count() == 0


def test_windows_cover_runs():
    for counts in ([10] * 9, [60], [49], [1, 60, 1], [25, 25, 25], []):
        found = line_dedup.windows(counts, 50)
        covered = {i for a, b in found for i in range(a, b + 1)}
        assert covered == (set(range(len(counts))) if sum(counts) >= 50 else set())


# --- 2 ------------------------------------------------------------------------------------------


def brute_viterbi(text):
    p = load()
    score = {p.text[i].replace("▁", " "): int(s) for i, s in zip(p.ids, p.scores)}
    text = " " + text
    best = [(0, None)]
    for end in range(1, len(text) + 1):
        options = [(best[end - k][0] + score[text[end - k : end]], k) for k in range(min(end, p.longest), 0, -1) if text[end - k : end] in score]
        if text[end - 1] not in score:
            options.append((best[end - 1][0] + p.unknown, 1))
        best.append(max(options, key=lambda o: (o[0], o[1])))
    return best[-1][0]


TEXTS = ["hello world", "  two  spaces ", "line\nfeed\n\n", "tab\tx", "日本語 😀 ▁ mark", "a", " ", "\n", "é" * 300, "The quick brown fox", "x" * 70 + "the" * 40 + "☃", "　wide nbsp"]


def test_encode_is_the_best_path_and_round_trips():
    p, codec = load(), sp_codec.Codec()
    score = {int(i): int(s) for i, s in zip(p.ids, p.scores)}
    for text, ids in zip(TEXTS, codec.encode(TEXTS)):
        assert codec.decode(ids) == text
        if "▁" in text:
            continue
        total, run = 0, 0
        chars = 0
        for i in ids.tolist():
            if i in score:
                total += score[i]
            else:
                run += 1
                chars += 1 if len(p.bytes_of[i]) == 1 and (p.bytes_of[i][0] & 0xC0) != 0x80 else 0
        assert total + chars * p.unknown == brute_viterbi(text), text


def test_encode_rows(spark):
    docs = docs_of(spark, [(i, t, "en", "a") for i, t in enumerate(TEXTS)] + [(99, None, "en", "a"), (98, "", "en", "a"), (None, "x", "en", "a")])
    out = sp_codec.encode(docs)
    assert all(r["round_trip"] for r in out.collect()) and out.count() == len(TEXTS) + 3
    back = {r["doc_id"]: r["text"] for r in sp_codec.decode(out).collect()}
    assert back[99] == "" and all(back[i] == t for i, t in enumerate(TEXTS))
    assert sp_codec.encode(docs.limit(0)).count() == 0


# --- 3 ------------------------------------------------------------------------------------------


def test_targets_are_shared_out_anew():
    got = mixing.targets({"b": 10, "a": 100, None: 50})
    assert got["a"] == pytest.approx(min(200, got["a"])) and sum(got.values()) == pytest.approx(240)
    assert got["b"] <= 20 and got[None] <= 100
    assert mixing.targets({"a": 0}) == {"a": 0.0} and mixing.targets({}) == {}


def test_flow_against_enumeration():
    r = random.Random(5)
    for _ in range(60):
        names = ["a", "b", "c"]
        patterns = {tuple(sorted(r.sample(names, r.randint(1, 3)))): r.randint(0, 4) for _ in range(3)}
        quota = {s: r.randint(0, 5) for s in names}
        got = mixing.flow(patterns, quota)
        cost = lambda used: sum(max(0, sum(x.values()) - patterns[p]) for p, x in used.items())
        routes = [(p, s) for p in patterns for s in p]
        best = None
        for amounts in itertools.product(*(range(min(quota[s], 2 * patterns[p]) + 1) for p, s in routes)):
            used = {p: {} for p in patterns}
            for (p, s), n in zip(routes, amounts):
                used[p][s] = n
            if all(sum(x.values()) <= 2 * patterns[p] for p, x in used.items()) and all(sum(x.get(s, 0) for x in used.values()) <= quota[s] for s in names):
                rank = (sum(amounts), -cost(used))
                best = rank if best is None or rank > best else best
        assert (sum(sum(x.values()) for x in got.values()), -cost(got)) == best


def test_mixing_meets_targets(spark):
    data = [(i, " ".join(["w"] * (1 + i * 7 % 40)), "en", "abc"[i % 3]) for i in range(600)] + corpus(30)
    docs = docs_of(spark, data)
    units = mixing.units_of(docs, F.array("source"))
    table, more, shares = mixing.planned(units, Scratch(spark, "m"))
    sizes, target = ({r["source"]: r[c] for r in shares.collect()} for c in ("source_size", "target"))
    out = mixing.copies(units, table, more).collect()
    assert len(out) == len(data)
    expected = Counter()
    for _, t, _, s in data:
        expected[s] += len(WORD.findall(t or ""))
    assert dict(sizes) == dict(expected)
    taken = Counter()
    for r in out:
        assert 0 <= r["copies"] <= 2
        taken[r["pattern"][0]] += r["copies"] * r["size"]
    for s in expected:
        assert abs(taken[s] - target[s]) <= 25
    again = mixing.copies(units, *mixing.planned(units, Scratch(spark, "m"))[:2]).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert mixing.copies(units.limit(0), *mixing.planned(units.limit(0), Scratch(spark, "m"))[:2]).count() == 0


# --- 4 ------------------------------------------------------------------------------------------


def test_html_held_out_pages():
    model, pages = html_extract.trained(), html_extract.training_pages(120, seed=77)
    right = 0
    for p in pages:
        t, keep = html_extract.labels_of(p)
        right += html_extract.extract([p.replace(" data-keep", "")], model)[0] == html_extract.text_of(t, [bool(k) for k in keep])
    assert right >= 0.9 * len(pages)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/b">More</a></li></ul></nav>
<div class="ad">Buy this now, it is a very good thing to buy today.</div><article><h1>Title &amp; more</h1><p>First   one,
with a <a href="#">link</a> inside.</p><script>var a = "<p>no</p>";</script><p><b>Second.<br><p>Third &lt;x&gt; one here.</p></article>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I like this very much, said a reader.</p></div></section><footer>&copy; 2024 Us. All rights reserved.</footer></body></html>"""


def test_html_page(spark):
    expected = "Title & more\nFirst one, with a link inside.\nSecond.\nThird <x> one here."
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain text  only"), (None, "u", "<p>one<p>two"), (6, "u", "<" * 50 + "a" * 1000), (7, "u", "<div>" * 3000 + "x")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_extract.extract_pages(df).collect()}
    assert got[1]["text"] == expected and got[1]["n_chars"] == len(expected)
    assert got[2]["text"] == "" and got[2]["n_chars"] == 0 and got[3]["text"] == ""
    assert len(got) == len(rows)
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_html_choice_is_consistent():
    t = html_extract.parse("<div><p>a</p><p>b</p></div>")
    for odds in itertools.product((-3.0, -0.5, 1.0, 2.5), repeat=len(t.parent)):
        keep = html_extract.decode(t, list(odds))
        valid = [k for k in itertools.product((False, True), repeat=len(odds)) if k[0] and all(not k[i] or k[t.parent[i]] for i in range(1, len(k)))]
        total = lambda k: sum(o for o, x in zip(odds, k) if x)
        assert tuple(keep) in valid and total(keep) == pytest.approx(max(map(total, valid)))


# --- 5 ------------------------------------------------------------------------------------------


def brute_groups(rows):
    sets = []
    for d, t, *_ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    ids = [d for d, _ in sets]
    group = {i: i for i in range(len(sets))}
    for i, j in itertools.combinations(range(len(sets)), 2):
        (a, x), (b, y) = sets[i], sets[j]
        if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
            old, new = max(group[i], group[j]), min(group[i], group[j])
            group = {k: new if v == old else v for k, v in group.items()}
    return [(d, len(s), None if d is None else min(ids[k] for k in group if group[k] == group[i])) for i, (d, s) in enumerate(sets)]


@pytest.mark.parametrize("hot, few", [(jaccard.HOT, jaccard.FEW), (1, 1)])
def test_jaccard_brute_force(spark, monkeypatch, hot, few):
    base = [f"t{i}" for i in range(120)]
    data = corpus(50)
    r = random.Random(9)
    for i in range(40):  # a chain of near copies: neighbours are close, the ends are not
        base[r.randrange(len(base))] = f"new{i}"
        data.append((1000 + i, " ".join(base), "en", "a"))
    data += [(2000, "Short Text", "en", "a"), (2001, "short  text", "en", "a"), (2002, "short text x", "en", "a")]
    monkeypatch.setattr(jaccard, "SKETCH_BITS", (16, 16))
    monkeypatch.setattr(jaccard, "PART", 4 if few == 1 else jaccard.PART)
    got = jaccard.join_components(docs_of(spark, data), hot=hot, few=few)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_groups(data)))


@pytest.mark.parametrize("hot, few", [(jaccard.HOT, jaccard.FEW), (1, 1)])
def test_jaccard_links_brute_force(spark, monkeypatch, hot, few):
    r = random.Random(14)
    base = [f"t{i}" for i in range(120)]
    data = [x for x in corpus(50) if x[0] != 904]
    for i in range(25):  # one group of near copies, most of them linked with each other
        near = list(base)
        near[r.randrange(len(near))] = f"new{i}"
        data.append((1000 + i, " ".join(near), "en", "a"))
    data.append((1100, data[-1][1].upper(), "en", "a"))
    monkeypatch.setattr(jaccard, "SKETCH_BITS", (16, 16))
    monkeypatch.setattr(jaccard, "PART", 4 if few == 1 else jaccard.PART)
    links, members = jaccard.join_links(docs_of(spark, data), hot=hot, few=few)
    sets, first = {}, {}
    for d, t, *_ in data:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        if d is not None:
            first[sets[d]] = min(d, first.get(sets[d], d))
    reps = {d: s for s, d in first.items() if s}
    expected = {(u, v, len(reps[u] & reps[v])) for u, v in itertools.combinations(sorted(reps), 2) if 100 * len(reps[u] & reps[v]) >= 80 * len(reps[u] | reps[v])}
    got = [tuple(x) for x in links.collect()]
    assert len(got) == len(set(got)) and set(got) == expected and len(expected) > 250
    degree = Counter(x for u, v, _ in expected for x in (u, v))
    own = {d: None if d is None else first[s] if s else d for d, s in sets.items()}
    assert sorted(map(str, map(tuple, members.collect()))) == sorted(str((d, len(s), own[d], degree[own[d]])) for d, s in sets.items())


def test_jaccard_no_rows(spark):
    assert jaccard.join_components(docs_of(spark, [(1, "x", "en", "a")]).limit(0)).count() == 0


def test_overlaps():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, 40).astype(np.uint64)) for _ in range(7)]
    assert jaccard.overlaps(sets).tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101)] + [(500, 500 + i) for i in range(1, 50)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "u long, v long"), Scratch(spark, "t"), "c").collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 103: 100} | {500 + i: 500 for i in range(1, 50)}


# --- 6 ------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é</p>" * 400
    rows = [(1, "http://a/ b\n", big), (2, "u", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (7, "u", "x\r\n\r\nWARC/1.1\r\n" * 100), (7, "u", big), (7, "u", big)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload_digest string")
    base = "file://" + str(tmp_path)
    index = warc.normalise(warc.write_archives(warc.with_revisits(df).repartition(2), base + "/a"), base + "/b").cache()
    got = sorted(map(str, map(tuple, warc.read_archives(index).collect())))
    expected = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        revisit = len(data) >= 1000 and same and page != max(same)
        expected.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    assert got == sorted(map(str, expected))
    import gzip

    for name in os.listdir(tmp_path / "b"):
        if name.endswith(".idx"):
            lines = [tuple(map(int, x.split())) for x in (tmp_path / "b" / name).read_text().splitlines()]
            data = (tmp_path / "b" / name.removesuffix(".idx")).read_bytes()
            assert sum(n for _, n in lines) == len(data)
            assert all(gzip.decompress(data[a : a + n]).startswith(b"WARC/1.1\r\n") for a, n in lines)
            assert list(warc.inflated_records("file://" + str(tmp_path / "b" / name.removesuffix(".idx")), 50)) == [gzip.decompress(data[a : a + n]) for a, n in lines]
    assert warc.with_revisits(df.limit(0)).count() == 0


# --- 7 ------------------------------------------------------------------------------------------


def brute_counts(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if twice[x] > 1 for k in range(3)}
    ls = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(covered)


def test_quality_counts(spark):
    data = corpus() + [(3000, "a b c a b c a b c", "en", "a"), (3001, "x x x x x x", "en", "a"), (3002, "#* é\n#* é\n\n \n", "en", "a")]
    got = quality.base_counts(docs_of(spark, data)).collect()
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted([(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got], key=key) == sorted([(d, *brute_counts(t)) for d, t, *_ in data], key=key)


def test_quality_verdicts(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    clean = [(i, " ".join(word() for _ in range(r.randint(60, 200))), "en", r.choice("ab")) for i in range(300)]
    junk = [(1000 + i, " ".join(word() + "$$$" for _ in range(100)), "en", "a") for i in range(15)]
    docs = docs_of(spark, clean + junk + [(2000, "too short", "en", "a"), (2001, None, None, None)])
    keep = Scratch(spark, "q")
    out = {x["doc_id"]: x for x in quality.judged(keep.keep(quality.base_counts(docs), "c"), keep).collect()}
    assert all(out[d]["kept"] for d, *_ in clean) and not any(out[d]["kept"] for d, *_ in junk)
    assert out[2000]["base_failed"] and not out[2001]["kept"] and len(out) == len(clean) + len(junk) + 2
    x = np.array([[out[d][s] for s in quality.STATS] for d, _, _, s in clean + junk if s == "a"])
    assert quality.judged(quality.base_counts(docs.limit(0)), Scratch(spark, "q0")).count() == 0
    assert len(x) >= quality.MIN_GROUP


def test_quality_rejects_menus_between_clean_texts(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    clean = [(i, " ".join(word() for _ in range(r.randint(60, 200))), "en", "a") for i in range(300)]
    menus = [(1000 + i, " | ".join(word() + " " + word() for _ in range(40)), "en", "a") for i in range(15)]
    price = [(2000, clean[0][1] + " $5 & more", "en", "a")]  # a symbol or two are no menu
    keep = Scratch(spark, "q")
    out = {x["doc_id"]: x for x in quality.judged(keep.keep(quality.base_counts(docs_of(spark, clean + menus + price)), "c"), keep).collect()}
    assert not any(out[d]["base_failed"] or out[d]["kept"] for d, *_ in menus)
    assert all(out[d]["kept"] for d, *_ in clean + price)


def test_quality_fit_has_the_least_determinant(spark):
    rng = np.random.default_rng(4)
    mix = np.array([[1, 0.6, 0, 0], [0, 1, 0.5, 0], [0, 0, 1, 0.3], [0, 0, 0, 1]])
    x = np.r_[rng.normal(size=(200, 4)) @ mix, rng.normal(size=(45, 4)) * 0.2 + [4, -4, 4, 4]]
    df = spark.createDataFrame([(i, *map(float, v), "en", "a") for i, v in enumerate(x)], "doc_id long, x0 double, x1 double, x2 double, x3 double, lang string, source string")
    fits = quality.fit_groups(df, Scratch(spark, "q")).collect()
    assert len(fits) == 1  # no small group needs an estimate of its language or of all
    fit, floor = fits[0], np.diag(np.square(quality.FLOOR))

    def steps(own):
        last, n = np.inf, 0
        while True:
            centre, k = x[own].mean(0), quality.CONSISTENCY * np.cov(x[own].T, bias=True) + floor
            d = np.log1p(np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(k), x - centre))
            if (det := np.linalg.slogdet(k)[1]) > last - 1e-9:
                return last
            # the determinant of the few rows of the start is none of a share of the rows
            last, n, own = det if n else np.inf, n + 1, d <= np.percentile(np.ceil(d * quality.LEVELS) / quality.LEVELS, 100 * quality.SUPPORT)

    least = min(steps(rng.choice(len(x), 5, replace=False)) for _ in range(300))
    factor = np.array([[fit[f"l{i}{j}"] if j <= i else 0 for j in range(4)] for i in range(4)])
    assert fit["log_det"] == pytest.approx(np.linalg.slogdet(factor @ factor.T)[1]) and fit["log_det"] <= least + 0.02
    assert np.abs(np.array([fit[f"m{i}"] for i in range(4)]) - x[:200].mean(0)).max() < 0.25
    # the clean rows' scatter, not that of the rows with the outliers
    assert np.linalg.slogdet(factor @ factor.T)[1] < np.linalg.slogdet(np.cov(x.T))[1] - 1


def test_quality_small_groups_use_larger_ones(spark):
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, rng.normal(size=4)), g, s) for i, (g, s) in enumerate([("en", "a")] * 70 + [("en", "b")] * 10 + [("de", "a")] * 20 + [("fr", None)] * 64)]
    df = spark.createDataFrame(rows, "doc_id long, x0 double, x1 double, x2 double, x3 double, lang string, source string")
    got = {r["key"]: r["n"] for r in quality.fit_groups(df, Scratch(spark, "q")).collect()}
    assert got == {'{"level":1,"lang":"en","source":"a"}': 70, '{"level":1,"lang":"fr"}': 64, '{"level":2,"lang":"en"}': 80, '{"level":3}': 164}


# --- 8 ------------------------------------------------------------------------------------------


def test_ann_recall_and_odd_rows(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(1500, 16)).astype(np.float32)
    v[700:720] = v[700]
    rows = [(i, [float(x) for x in v[i]], 1) for i in range(1500)] + [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] * 16, 1), (2060, [None] * 16, 1), (2080, [1.0], 1), (None, [1.0] * 16, 1), (20, [float(x) for x in v[20]], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got: dict = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        s = v.astype(np.float64) @ v[q].astype(np.float64)
        best = sorted((-x, i) for i, x in enumerate(s) if i != q)[:20]
        assert sorted(found) == list(range(1, 21))
        order = [(-found[k][1], found[k][0]) for k in range(1, 21)]
        assert order == sorted(order)
        assert all(abs(found[k][1] - s[found[k][0]]) < 1e-9 for k in found)
        hits += len({i for _, i in best} & {i for i, _ in found.values()})
    assert hits >= 0.9 * 20 * len(got)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.search(few, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 0.5)]
    assert ann.search(few.limit(0), F.lit(True)).count() == 0


def test_visit_order():
    s1, s2 = np.array([3.0, 1.0, 2.0]), np.array([0.5, 2.5])
    counts = np.arange(1, 7)
    got = ann.visit(s1, s2, counts, 10**9)
    assert [s1[c // 2] + s2[c % 2] for c in got] == sorted([a + b for a in s1 for b in s2], reverse=True)


# --- 9 ------------------------------------------------------------------------------------------


def test_langid(spark):
    r = random.Random(8)
    parts = {"aa": ["lo", "mi", "ra", "ten"], "bb": ["sch", "ung", "zu", "ein"], "cc": ["ción", "que", "os", "par"]}
    text = lambda g, n: " ".join("".join(r.choice(parts[g]) for _ in range(r.randint(1, 3))) for _ in range(n))
    data = [(i, text(g := "abc"[i % 3] * 2, 30), g, "s") for i in range(240)]
    odd = [(900, None, "aa", "s"), (901, "", "aa", "s"), (902, "123 --- $$", "aa", "s"), (903, "lomi" * 5000, None, "s"), (None, "miralo", "aa", "s")]
    got = langid.identify(docs_of(spark, data + odd)).collect()
    assert len(got) == len(data) + len(odd)
    by = {x["doc_id"]: x for x in got}
    import zlib

    assert all(by[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, *_ in data)
    assert all(by[d]["lang_pred"] == g for d, _, g, _ in data if by[d]["held_out"])
    assert all(by[d]["lang_pred"] == "und" and by[d]["score"] == 0 for d in (900, 901, 902)) and by[903]["lang_pred"] == "aa"
    assert all(0 <= x["score"] <= 1 for x in got)
    none = langid.identify(docs_of(spark, [(1, "text", None, "s")])).collect()
    assert none[0]["lang_pred"] == "und"
    assert langid.identify(docs_of(spark, data).limit(0)).count() == 0


def test_forward_sums_all_segmentations():
    p = load()
    rng = np.random.default_rng(2)
    prob = np.r_[rng.random(len(p.keys)), 0.0][:, None]
    model = langid.Model(["x"], prob=prob.copy())
    place = {p.text[i].replace("▁", " "): k for k, i in enumerate(p.ids)}

    def total(w):
        return 1.0 if not w else sum((prob[place[w[:k]], 0] if w[:k] in place else langid.NO_PIECE if k == 1 else 0.0) * total(w[k:]) for k in range(1, len(w) + 1))

    for w in (" the", " ☃a", " entión"):
        assert model.log_words([w])[0, 0] == pytest.approx(np.log(total(w)))


def test_long_runs_are_summed_whole(monkeypatch):
    p = load()
    rng = np.random.default_rng(5)
    prob = np.c_[rng.random(len(p.keys) + 1), rng.random(len(p.keys) + 1)] ** 4
    prob[-1] = 0
    model = langid.Model(["x", "y"], prob=prob.copy())
    place = {p.text[i].replace("▁", " "): k for k, i in enumerate(p.ids)}

    def log_total(w, g):
        alpha = [1.0]
        for end in range(1, len(w) + 1):
            weigh = lambda k: prob[place[w[end - k : end]], g] if w[end - k : end] in place else langid.NO_PIECE if k == 1 else 0.0
            alpha.append(sum(alpha[end - k] * weigh(k) for k in range(1, min(end, p.longest) + 1)))
        return np.log(alpha[-1])

    for run in ("internationalisation" * 2, "thequick☃brownfoxções".replace("☃", "") * 2, "a" * 25, "日本語の文章" * 5):
        logs = [log_total(" " + run, g) for g in (0, 1)]
        share = 1 / (1 + np.exp(-abs(logs[0] - logs[1])))
        for block in (7, 8, 512):
            monkeypatch.setattr(langid, "BLOCK", block, raising=False)
            assert langid.Scorer(model).score([run])[1][0] == pytest.approx(share, rel=1e-9)
            assert model.log_run(" " + run) == pytest.approx(logs, rel=1e-9)


# --- 10 -----------------------------------------------------------------------------------------

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute_private(text):
    out = {}
    for kind, pattern in BASE.items():
        spans = []
        for m in pattern.finditer(text or ""):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                double = sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits)))
                if not 16 <= len(digits) <= 19 or double % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            spans.append(m.span())
        out[kind] = spans
    return out


def test_private_base_spans_brute_force():
    r = random.Random(4)
    bits = ["a@b.c", "x.y+z@mail.example.com", "@", "a@b", "a@b.c@d.e", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "4012888888881881", "+1 (555) 010-9999", "+1", "++49 30 1234567", "12", " ", ".", "-", "é", "\n", "9" * 30, "0.0.0.0.", "%"]
    for _ in range(800):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 9)))
        assert pii.base_spans(text) == brute_private(text), text


def test_private_rows(spark):
    iban = "GB82 WEST 1234 5698 7654 32"
    rows = [(1, f"pay to account {iban} now", "en", "a"), (2, f"code {iban[:-1]}9 x", "en", "a"), (3, None, "en", "a"), (4, "", "en", "a"), (5, "my ssn is 123-45-6789", "en", "a"), (6, "item 123-45-6789", "en", "a"), (7, "call 555 010 9999", "en", "a"), (8, "a" * 200_000 + "@x", "en", "a"), (None, "a@b.c", "en", "a")]
    got = {r["doc_id"]: r for r in pii.find_private(docs_of(spark, rows)).collect()}
    assert got[1]["spans"] == f"iban:15:{15 + len(iban)}" and got[2]["spans"] == ""
    assert got[5]["spans"] == "ssn:10:21" and got[6]["spans"] == "" and got[7]["spans"].startswith("phone_local:5:")
    assert got[3]["base_sha256"] == got[4]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[None]["n_email"] == 1 and got[None]["base_sha256"] == hashlib.sha256(b"email:0:5").hexdigest()
    assert pii.find_private(docs_of(spark, rows).limit(0)).count() == 0


def test_parities_bound_the_difference():
    r = np.random.default_rng(3)
    for _ in range(50):
        a, b = (np.unique(r.integers(0, 2**63, 300).astype(np.uint64) * np.uint64(2)) for _ in range(2))
        b = np.unique(np.r_[a[: r.integers(0, 300)], b])
        apart = np.bitwise_count(jaccard.parities(a).view(np.uint64) ^ jaccard.parities(b).view(np.uint64)).sum()
        assert apart <= len(np.setxor1d(a, b))
