"""Pages with unclosed elements, memory of extraction and inflation, context words as words."""

import gzip
import random
import tracemalloc

import pytest

from quarrylight.llm import html_extract, pii, warc

FIRST, LAST = "First paragraph with some words in it, enough of them.", "Second paragraph with more words in it, and a stop."


def page(inside):
    return f"<html><body><nav><a href=/>a</a></nav><article><h1>The title of it</h1><p>{FIRST}</p>{inside}<p>{LAST}</p></article><footer>copy</footer></body></html>"


@pytest.mark.parametrize(
    ("inside", "between"),
    [
        ("<svg><path d=1>", []),
        ("<svg><g><text>drawn</text></g></svg>", []),
        ("<svg><svg/><svg><text>a</text></svg><text>b</text></svg>", []),
        ("<svg><title>t</title><foreignObject><div>in</div></foreignObject></svg>", []),
        ("<svg><foreignObject><p>Open text is here for all to read.", ["Open text is here for all to read."]),
        ("<select><option>one<option>two", []),
        ("<select><option>one</select>", []),
        ("<p>Value <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds here in this paragraph.</p>", ["Value x=2 holds here in this paragraph."]),
        ("<object data=x><p>Fallback text that is to be read here.</p></object>", ["Fallback text that is to be read here."]),
        ("<object data=x>", []),
    ],
)
def test_nothing_swallows_the_page(inside, between):
    assert html_extract.extract([page(inside)], html_extract.trained()) == ["\n".join(["The title of it", FIRST, *between, LAST])]


def test_long_rows_of_unclosed_drawings_take_linear_time():
    import time

    began = time.process_time()
    for n in (20_000, 40_000):
        html_extract.parse(page("<svg><g>" * n))
        html_extract.parse(page("<select><option>" * n))
    assert time.process_time() - began < 20


def test_features_by_blocks_are_the_same():
    trees = [html_extract.parse(p) for p in html_extract.training_pages(40, 5)]
    whole = html_extract.features(trees)
    for size in (1, 7, 100):
        blocks = list(html_extract.feature_blocks(trees, size))
        assert max(map(len, blocks)) <= size and sum(map(len, blocks)) == len(whole)
        assert all((a == b).all() for a, b in zip([r for b in blocks for r in b], whole))


def test_memory_of_extraction_follows_the_largest_page():
    model = html_extract.trained()
    one = page("".join(f"<p>Words in a paragraph number {i}, some of them.</p><div><a href=x>l</a></div>" for i in range(2500)))
    pages = (one for _ in range(6_000_000 // len(one)))
    tracemalloc.start()
    texts = html_extract.extract(pages, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(texts) > 20 and peak - sum(map(len, texts)) < 120e6


def test_inflation_is_bounded(tmp_path):
    payload = b"a" * (64 << 20)
    data = b"".join(warc.record(i, "u", x, "00" * 20, None) for i, x in enumerate((b"first", payload, b"last")))
    (tmp_path / "x.gz").write_bytes(gzip.compress(data) + gzip.compress(b""))
    tracemalloc.start()
    sizes = [len(r) for r in warc.inflated_records(f"file://{tmp_path}/x.gz")]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(sizes) == 3 and sum(sizes) == len(data) and peak < 3.5 * len(payload)
    # many records that expand much: none of them waits for the others
    many = b"".join(warc.record(i, "u", b"b" * 100_000, "00" * 20, None) for i in range(500))
    (tmp_path / "y.gz").write_bytes(gzip.compress(many))
    tracemalloc.start()
    assert sum(1 for _ in warc.inflated_records(f"file://{tmp_path}/y.gz")) == 500
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8e6


def test_records_in_any_pieces(tmp_path):
    rng = random.Random(1)
    records = [warc.record(i, "u", rng.randbytes(rng.randrange(3000)), "00" * 20, None) for i in range(60)]
    for k, piece in enumerate((1, 7, 100, 1 << 20)):
        path = tmp_path / f"{k}.gz"
        path.write_bytes(b"".join(gzip.compress(b"".join(records[i : i + 9])) for i in range(0, 60, 9)))
        assert list(warc.inflated_records(f"file://{path}", piece)) == records
        path.write_bytes(path.read_bytes()[:-20])
        with pytest.raises(ValueError):
            list(warc.inflated_records(f"file://{path}", piece))


def found(text):
    return {(k, text[a:b]) for k, spans in pii.added_spans(text, pii.base_spans(text)).items() for a, b in spans}


@pytest.mark.parametrize("text", ["hotel 123 456 7890", "automobile part 123 456 7890", "recall 123 456 7890", "telescope 123 456 7890", "wildcard 3782 822463 10005 bankable", "order 123 456 7890", "order 123 456 7890 by phone", "123-45-6789 in version", "phone" + " x" * 40 + " 123 456 7890", "123 456 7890" + " " * 44 + "phones2"])
def test_context_must_be_whole_words_nearby(text):
    assert found(text) <= {("card_short", "3782 822463 10005")} and ("phone_local" not in {k for k, _ in found(text)})


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Call 123 456 7890 now", ("phone_local", "123 456 7890")),
        ("tel: (030) 123 4567", ("phone_local", "(030) 123 4567")),
        ("mobile 123 456 7890 and, very much later in this longer text, an order", ("phone_local", "123 456 7890")),
        ("my SSN is 123-45-6789", ("ssn", "123-45-6789")),
        ("card 3782 822463 10005", ("card_short", "3782 822463 10005")),
        ("IBAN DE89 3704 0044 0532 0130 00", ("iban", "DE89 3704 0044 0532 0130 00")),
        ("my_api_key = 'a1b2c3d4e5f6a7b8c9d0'", ("secret", "a1b2c3d4e5f6a7b8c9d0")),
    ],
)
def test_context_words_that_count(text, expected):
    assert expected in found(text)


def test_added_spans_over_planted_texts():
    """Spans planted with a word of their kind are found, the same numbers beside other words are not."""
    rng = random.Random(3)
    filler = "the quick report about hotel recall automobile bankable telescope data and some more text".split()
    hits = wrong = planted = 0
    for _ in range(400):
        number = f"{rng.randrange(200, 999)} {rng.randrange(100, 999)} {rng.randrange(1000, 9999)}"
        near = rng.random() < 0.5
        word = rng.choice(["phone", "call", "tel", "fax"]) if near else rng.choice(filler)
        text = " ".join(rng.choices(filler, k=9)) + f" {word} {number} " + " ".join(rng.choices(filler, k=9))
        got = ("phone_local", number) in found(text)
        planted += near
        hits += near and got
        wrong += got and not near
    assert hits == planted and wrong == 0


def test_rows_of_line_dedup_are_winnowed_positions(spark):
    """One row for each line that is the least of some window, not one for each window; a shared line has one fingerprint in every context."""
    from pyspark.sql import functions as F

    from quarrylight.llm import line_dedup

    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    texts = [(i, "\n".join(" ".join(rng.choices(words, k=rng.randrange(3, 12))) for _ in range(80))) for i in range(30)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("text_hash", F.xxhash64("text"))
    found = line_dedup._positions(docs, 50).select("doc_id", "fp", "fp_at", F.size("windows").alias("n")).collect()
    windows = sum(len(line_dedup.windows([n for _, _, n in line_dedup.lines_of(t)], 50)) for _, t in texts)
    assert len({(r.doc_id, r.fp_at) for r in found}) == len(found) and sum(r.n for r in found) == windows and len(found) * 2 < windows
    # the line that is least everywhere has the same fingerprint among other lines
    line = min((line for _, t in texts for line in t.split("\n")), key=lambda x: line_dedup.xxhash.xxh3_64_intdigest(x))
    around = [(i, "\n".join([*(f"a{i} b{k} c d e f g h" for k in range(6)), line, *(f"z{i} y{k} x d e f g h" for k in range(6))])) for i in range(5)]
    docs = spark.createDataFrame(around, "doc_id long, text string").withColumn("text_hash", F.xxhash64("text"))
    own = line_dedup.xxhash.xxh3_64_intdigest(" ".join(line.split()).encode()) - (1 << 63)
    assert {r.doc_id for r in line_dedup._positions(docs, 50).where(F.col("fp") == own).collect()} <= set(range(5))
    # positions in other contexts are joined and do not agree, so nothing goes
    assert all(r.n_removed == 0 for r in line_dedup.dedup_documents(docs.select("doc_id", "text")).collect())


def test_long_texts_in_line_dedup_and_clashing_names(spark):
    from quarrylight.llm import line_dedup

    block = "\n".join(f"line {i} of a passage that is long enough" for i in range(20))
    rows = [(1, block + "\n" + "x" * 3_000_000, "a"), (2, "\n".join(f"{i} only here" for i in range(200_000)) + "\n" + block, "b"), (None, block, "c"), (3, None, None)]
    got = {r.doc_id: (r.n_removed, r.held, r.cuts) for r in line_dedup.dedup_documents(spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, held string, cuts int")).collect()}
    assert got == {1: (0, "a", 7), 2: (20, "b", 7), None: (20, "c", 7), 3: (0, None, 7)}


def test_private_data_beside_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "mail a@b.co", "s", 3), (None, None, None, None)], "doc_id long, text string, spans string, n_email int")
    assert {(r.doc_id, r.n_email, r.spans) for r in pii.find_private(rows).collect()} == {(1, 1, "email:5:11"), (None, 0, "")}
