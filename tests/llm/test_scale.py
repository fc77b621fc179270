"""Long inputs, many groups, clashing names, hot groups: results whole, in bounded time and memory."""

import random
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import ann, html_extract, jaccard, langid, line_dedup, mixing, pii, quality, sp_codec, warc
from quarrylight.llm.common import Scratch
from quarrylight.llm.pieces import load

from .test_operators import WORD, brute_viterbi, docs_of


def took(f, *args):
    began = time.time()
    f(*args)
    return time.time() - began


# --- long inputs --------------------------------------------------------------------------------


@pytest.mark.parametrize("piece", ['<a "b" ', '<a "b>" ', "<div>", "<p>x", "<head>x", "<ul><li>", "<!-- ", "</div><b>", "<td", "&amp;<b a='"])
def test_html_long_pages(piece):
    long = piece * (5_000_000 // len(piece))
    assert took(lambda: html_extract.features([html_extract.parse(long)])) < 60


def test_html_tags():
    page = "<p class='a>b'>x</p><!-- <p> --><br/><q \"u>v</q><I"
    found = [page[a:b] for a, b, *_ in html_extract.tags(page)]
    assert found == ["<p class='a>b'>", "</p>", "<!-- <p> -->", "<br/>", '<q "u>', "</q>"]


def test_pii_long_texts():
    text = "iban DE89 3704 0044 0532 0130 00, tel 030 123 4567 " * 100_000
    base = pii.base_spans(text)
    assert took(pii.added_spans, text, base) < 60
    assert len(pii.added_spans(text, base)["iban"]) == 100_000
    for odd in ("a" * 5_000_000, "@" * 2_000_000, "1." * 2_000_000, "+1 " * 1_000_000, "a@b" * 1_000_000, "0" * 5_000_000):
        assert took(pii.base_spans, odd) < 30


def test_pii_secrets():
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    for text, n in ((f'token = "{key}"', 1), (f"api_key: {key}", 1), (f"commit {key}", 0), ("password = correcthorsebatterystaple", 0)):
        assert len(pii.added_spans(text, pii.base_spans(text))["secret"]) == n


def test_long_words_take_the_best_path():
    p, codec, r = load(), sp_codec.Codec(), random.Random(2)
    score = {int(i): int(s) for i, s in zip(p.ids, p.scores)}
    for n in (65, 80, 128, 129, 200, 64 * 5 + 1):
        word = "".join(r.choice(["the", "in", "ation", "x", "日本", "é", "er", "q"]) for _ in range(n))[:n]
        ids = codec.encode([word])[0].tolist()
        assert codec.decode(np.array(ids)) == word
        if all(i in score for i in ids):
            assert sum(score[i] for i in ids) == brute_viterbi(word)


def test_long_word_memory():
    word = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=3_000_000))
    codec = sp_codec.Codec()
    codec.encode(["warm" * 40])
    tracemalloc.start()
    ids = codec.encode([word])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert codec.decode(ids) == word and peak < 600e6


def test_quality_and_warc_long_rows(spark):
    text = ("word " * 400_000 + "\n") * 2
    got = quality.base_counts(docs_of(spark, [(1, text, "en", "a")])).first()
    assert got["n_words"] == 800_000 and got["n_dup_lines"] == 1
    page = spark.createDataFrame([(1, "u", text)], "page_id long, url string, html string")
    keep = Scratch(spark, "w")
    index = warc.normalise(keep.keep(warc.write_archives(warc.with_revisits(page, keep), keep.path("a")), "p"), keep.path("b"))
    assert warc.read_archives(keep.keep(index, "i").select("path", "offset", "length")).first()["payload_bytes"] == len(text)


def test_archive_cut_short(spark, tmp_path):
    import zlib

    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = warc.record(1, "u", b"x" * 2000, "0" * 40, None)
    whole = deflate.compress(data) + deflate.flush()
    for name, content in (("whole", whole), ("two", whole * 2), ("tail", whole[:-8]), ("half", whole[: len(whole) // 2])):
        (tmp_path / name).write_bytes(content)
    assert len(list(warc.inflated_records(f"file://{tmp_path}/whole"))) == 1 and len(list(warc.inflated_records(f"file://{tmp_path}/two"))) == 2
    for name in ("tail", "half"):
        with pytest.raises(ValueError):
            list(warc.inflated_records(f"file://{tmp_path}/{name}"))


# --- many groups, names --------------------------------------------------------------------------


def test_letters_only():
    assert langid.runs_of("² ½ ① ⅷ 12 --") == [] and langid.runs_of("a²b Ünï") == [" a", " b", " ünï"]


def test_languages_in_blocks(spark, monkeypatch):
    r = random.Random(3)
    parts = {g: ["".join(r.choices("abcdefghijklmnopqrst", k=3)) for _ in range(5)] for g in ("aa", "bb", "cc", "dd", "ee")}
    text = lambda g: " ".join("".join(r.choices(parts[g], k=2)) for _ in range(30))
    docs = docs_of(spark, [(i, text(g := "abcde"[i % 5] * 2), g, "s") for i in range(150)] + [(900, "½", "aa", "s")])
    whole = {x["doc_id"]: x for x in langid.identify(docs).collect()}
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    for x in langid.identify(docs).collect():
        assert x["lang_pred"] == whole[x["doc_id"]]["lang_pred"] and x["score"] == pytest.approx(whole[x["doc_id"]]["score"])


def test_many_sources(spark, monkeypatch):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "en", None if i % 61 == 0 else f"s{i % 61:02d}") for i in range(900)]
    docs = docs_of(spark, rows)
    units = mixing.units_of(docs, F.array("source"))
    sizes = {}
    for i, _, _, source in rows:
        sizes[source] = sizes.get(source, 0) + 1 + i % 7
    target = mixing.targets(sizes)
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 3)
    overlapping = units.withColumn("pattern", F.array(F.lit("x"), F.col("pattern")[0]))
    with pytest.raises(ValueError):
        mixing.planned(overlapping, Scratch(spark, "m"))
    table, more, shares = mixing.planned(units, Scratch(spark, "m"))
    got = {r["source"]: (r["source_size"], r["target"]) for r in shares.collect()}
    assert got == {s: (sizes[s], pytest.approx(target[s])) for s in sizes}
    taken: dict = {}
    for r in mixing.copies(units, table, more).collect():
        assert 0 <= r["copies"] <= 2
        taken[r["pattern"][0]] = taken.get(r["pattern"][0], 0) + r["copies"] * r["size"]
    assert all(abs(taken[s] - target[s]) <= 7 for s in sizes)
    pair = docs.withColumn("both", F.when(F.col("doc_id") % 61 == 1, F.array(F.lit("s01"), F.lit("s02"))).otherwise(F.array("source")))
    table, more, _ = mixing.planned(mixing.units_of(pair, F.col("both")), Scratch(spark, "m"))
    assert table.count() == 62 - 1


def test_clashing_names(spark):
    line = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{line}\nown{i}", 1, 2, 3, 4, 5, 6, 7) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_hash int, __id int, cuts int, n_lines int, n_removed int, hash int, c0 int")
    got = sorted(line_dedup.dedup_documents(docs).collect(), key=lambda r: r["doc_id"])
    assert [r["n_removed"] for r in got] == [0, 1, 1] and [r["text"] for r in got][1:] == ["own1", "own2"]
    assert all((r["text_hash"], r["__id"], r["cuts"], r["hash"], r["c0"], r["n_lines"]) == (1, 2, 3, 6, 7, 2) for r in got)
    out = quality.judged(quality.base_counts(docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")).withColumn("x0", F.lit(1)).withColumn("key", F.lit(2))), Scratch(spark, "q"))
    assert out.count() == 3
    vectors = spark.createDataFrame([(i, [float(i), 1.0], 0, 0, 0) for i in range(30)], "vec_id long, embedding array<float>, cell int, shard int, v int")
    assert ann.search(vectors, F.col("vec_id") % 20 == 0).count() == 40


# --- neighbours ----------------------------------------------------------------------------------


def test_pruned_search_finds_the_neighbours(spark):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(80, 16)) * 3
    v = (centre[rng.integers(0, 80, 4000)] + rng.normal(size=(4000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    found: dict = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k=10, entries=400).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    x = v.astype(float)
    hits = 0
    for q in range(0, 4000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-s)[:10].tolist()))
    assert hits / 2000 >= 0.9  # a tenth of the entries is visited


def test_scores_that_differ_in_last_bits(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=8) * 1e6
    v = np.tile(base, (400, 1)) + rng.integers(0, 2, (400, 8)) * np.spacing(base)
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = [r["vec_id"] for r in sorted(ann.search(df, F.col("vec_id") == 0).collect(), key=lambda r: r["rank"])]
    import math

    exact = {i: math.fsum((v[i] * v[0]).tolist()) for i in range(1, 400)}
    assert got == sorted(exact, key=lambda i: (-exact[i], i))[:20]


def test_rows_that_share_an_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in ann.search(df, F.col("vec_id") == 0).collect())
    assert got == [(1, 1, 1.0)] * 2 + [(2, 1, 1.0)] * 2 + [(3, 0, 0.0)] * 2


# --- joins with hot groups ------------------------------------------------------------------------


def test_large_groups_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SKETCH_BITS", (16, 16))
    r = random.Random(5)
    base = [f"t{i}" for i in range(60)]
    near = []
    for i in range(3000):
        words = list(base)
        words[r.randrange(60)] = f"n{i}"
        near.append((i, " ".join(words), "en", "a"))
    passage = " ".join(f"p{i}" for i in range(30))
    unlike = [(10_000 + i, " ".join(f"u{i}x{k}" for k in range(40)) + " " + passage, "en", "a") for i in range(3000)]
    got = {x["doc_id"]: x["component_id"] for x in jaccard.join_components(docs_of(spark, near + unlike)).collect()}
    assert all(got[i] == i for i, *_ in unlike)
    sets = [{tuple(w[i : i + 5]) for i in range(56)} for _, t, *_ in near for w in [t.split(" ")]]
    group = list(range(len(near)))

    def root(i):
        while group[i] != i:
            group[i] = i = group[group[i]]
        return i

    # edits at one place share all but the five shingles around it: 51 of 61; the graph by places is small
    place = [next(i for i, w in enumerate(t.split(" ")) if w[0] == "n") for _, t, *_ in near]
    first: dict = {}
    for i, p in enumerate(place):
        first.setdefault(p, []).append(i)
    some = [m[:2] for m in first.values()]
    for a in some:
        for b in some:
            for i in a:
                for j in b:
                    if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                        for x in first[place[i]]:
                            for y in first[place[j]][:1]:
                                u, w = root(x), root(y)
                                group[max(u, w)] = min(u, w)
    assert [got[i] for i in range(len(near))] == [root(i) for i in range(len(near))]


@pytest.mark.parametrize("shared", [0, 16])
def test_blocks_of_many_members(spark, monkeypatch, shared):
    from .test_operators import brute_groups

    monkeypatch.setattr(jaccard, "SKETCH_BITS", (16, 16))
    monkeypatch.setattr(jaccard, "PART", 8)
    monkeypatch.setattr(jaccard, "SHARED", shared)
    r = random.Random(6)
    rows = []
    for g in range(6):
        base = [f"g{g}t{i}" for i in range(50)]
        for i in range(40):
            for _ in range(r.choice((1, 1, 2))):
                base[r.randrange(50)] = f"g{g}n{i}"
            rows.append((g * 100 + i, " ".join(base if r.random() < 0.5 else base[: r.randint(35, 50)]), "en", "a"))
    got = sorted(tuple(x) for x in jaccard.join_components(docs_of(spark, rows), few=2).collect())
    assert got == sorted(brute_groups(rows))


def test_other_pages():
    """Pages of another make than those the trees learn from: other layouts, names without meaning, other words."""
    words = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor invidunt ut labore et dolore magna aliquyam erat".split()
    model, right = html_extract.trained(), 0
    for seed in range(120):
        r = random.Random(seed)
        line = lambda a, b: " ".join(r.choice(words) for _ in range(r.randint(a, b)))
        name = lambda: r.choice(["", f' class="x{r.randint(1, 999)}"', f' id="c-{r.randint(1, 99)}"', f' class="zq{r.randint(1, 9)} kk"'])
        links = lambda n: "".join(f'<li><a href="/{i}">{line(1, 2)}</a></li>' for i in range(n))
        title, text = line(3, 8), [line(15, 60) + "." for _ in range(r.randint(2, 9))]
        body = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in text)
        wrap = r.choice(["<article{}>{}</article>", "<main{}>{}</main>", "<div{}>{}</div>", "<section{}>{}</section>"]).format(name(), body)
        top = r.choice([f"<header><a href='/'>{line(1, 2)}</a></header>", ""]) + f"<nav{name()}><ul>{links(r.randint(3, 9))}</ul></nav>"
        side = r.choice([f"<aside{name()}><h3>{line(1, 2)}</h3><ul>{links(5)}</ul></aside>", ""])
        form = r.choice([f"<form{name()}><label>{line(1, 2)}</label><input><button>{line(1, 1)}</button></form>", ""])
        page = f"<html><head><title>{title}</title><script>x('<p>')</script></head><body{name()}>{top}{form}<div{name()}>{wrap}{side}</div><footer{name()}>&copy; {line(2, 6)}</footer></body></html>"
        right += html_extract.extract([page], model)[0] == "\n".join([title, *text])
    assert right >= 0.9 * 120


def test_empty_tables(spark):
    docs = docs_of(spark, [(1, "x", "en", "a")]).limit(0)
    keep = Scratch(spark, "e")
    assert sp_codec.encode(docs).count() == 0 and pii.find_private(docs).count() == 0
    units = mixing.units_of(docs, F.array("source"))
    table, more, shares = mixing.planned(units, keep)
    assert mixing.copies(units, table, more).count() == 0 and shares.count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    paths = keep.keep(warc.write_archives(warc.with_revisits(pages, keep), keep.path("a")), "p")
    assert warc.read_archives(warc.normalise(paths, keep.path("b")).select("path", "offset", "length")).count() == 0
    assert len(WORD.findall("")) == 0


def test_overlapping_sources_meet_quotas_at_least_cost(spark):
    """Documents of one word each, so every flow can be taken exactly: totals and repetitions are those of the best of all flows."""
    import itertools

    counts = {("a",): 3, ("a", "b"): 4, ("b", "c"): 2, ("c",): 1}
    docs = [(i, p) for i, p in enumerate(p for p, n in counts.items() for _ in range(n))]
    rows = spark.createDataFrame([(i, "w", list(p)) for i, p in docs], "doc_id long, text string, own array<string>")
    units = mixing.units_of(rows, F.col("own"))
    table, more, shares = mixing.planned(units, Scratch(spark, "m"), weights=(1, 3, 2), total=0.9)
    sizes = {s: sum(n for p, n in counts.items() if s in p) for s in "abc"}
    target = mixing.targets(sizes, (1, 3, 2), 0.9)
    assert {r["source"]: r["target"] for r in shares.collect()} == pytest.approx(target)
    taken = {p: 0 for p in counts}
    for r in mixing.copies(units, table, more).collect():
        taken[tuple(r["pattern"])] += r["copies"]
    routes = [(p, s) for p in counts for s in p]
    cost = lambda used: sum(max(0, used[p] - counts[p]) for p in counts)
    best = max(
        (sum(amounts), -cost(used))
        for amounts in itertools.product(*(range(min(round(target[s]), 2 * counts[p]) + 1) for p, s in routes))
        if (used := {p: sum(n for (q, _), n in zip(routes, amounts) if q == p) for p in counts})
        and all(used[p] <= 2 * counts[p] for p in counts)
        and all(sum(n for (_, t), n in zip(routes, amounts) if t == s) <= round(target[s]) for s in "abc")
    )
    assert (sum(taken.values()), -cost(taken)) == best


def test_many_overlapping_patterns_take_seconds():
    import random
    import time

    rng = random.Random(6)
    names = [f"s{i}" for i in range(400)]
    patterns = list({tuple(sorted(rng.sample(names, rng.randrange(1, 5)))) for _ in range(8000)})
    capacity = {p: rng.randrange(1, 10**6) for p in patterns}
    quota = {s: rng.randrange(10**6, 3 * 10**7) for s in names}
    began = time.process_time()
    got = mixing.flow(capacity, quota)
    assert time.process_time() - began < 20
    assert all(sum(got[p].values()) <= 2 * capacity[p] for p in patterns)
    given = {s: sum(got[p].get(s, 0) for p in patterns) for s in names}
    # what is not met is out of reach: every pattern of the source is used up
    assert all(given[s] == quota[s] or all(sum(got[p].values()) == 2 * capacity[p] for p in patterns if s in p) for s in names)
