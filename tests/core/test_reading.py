"""Pages of sources against a reader that goes character by character."""

import random

import pytest
from pyspark.sql import functions as F

from quarrylight.model import QueryError
from quarrylight.operators import reading


def walk(text, windows, offset, max_lines, max_bytes, max_segments):
    """(segments, stop, next): windows are (kind, first, last) in order."""
    lines = text.splitlines(keepends=True) if text else []
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x.encode()))
    out, used, counted, stop = [], 0, set(), None
    for kind, first, last in windows:
        a, b = starts[first - 1], starts[last]
        if offset >= b:
            continue
        offset = max(offset, a)
        if len(out) == max_segments:
            return out, "SEGMENT_BUDGET", offset
        if kind == "ELISION":
            out.append(("ELISION", a, b, first, last, None, False, False))
            offset = b
            continue
        begin, content = offset, ""
        mid = begin > a and text.encode()[begin - 1 : begin] != b"\n"
        for n in range(first, last + 1):
            rest = lines[n - 1].encode()[max(0, offset - starts[n - 1]) :].decode() if offset < starts[n] else ""
            for c in rest:
                size = len(c.encode())
                if used + size > max_bytes:
                    stop = "CONTENT_BUDGET"
                elif n not in counted and len(counted) == max_lines:
                    stop = "LINE_BUDGET"
                if stop:
                    break
                counted.add(n)
                used, offset, content = used + size, offset + size, content + c
            if stop:
                break
        if content:
            at = lambda place: sum(1 for s in starts[1:] if s <= place) + 1
            out.append(("SOURCE", begin, offset, at(begin), at(offset - 1), content, mid, offset < b and content[-1] != "\n"))
        if stop:
            return out, stop, offset
    return out, "COMPLETE", None


@pytest.mark.parametrize("limits", [(3, 40, 500), (500, 17, 2), (2, 1000, 1)])
def test_pages_are_those_of_a_reader(spark, limits):
    r = random.Random(4)
    texts = {f"f{i}": "".join(r.choice(["a", "é", "😀", "\n", "bc ", "\n"]) for _ in range(r.randint(0, 90))) for i in range(25)}
    texts["long"] = "x" * 200 + "\n" + "日" * 50
    # LF alone ends a line
    n_lines = {p: t.count("\n") + (not t.endswith("\n")) if t else 0 for p, t in texts.items()}
    files = spark.createDataFrame(sorted(texts.items()), "path string, text string")
    bodies = [(p, 2, 9) for p in texts] + [(p, 3, 8) for p in texts]
    for windows, plain in (
        (reading.windows_of(files), lambda n: [("SOURCE", 1, n)]),
        (reading.windows_of(files, [(2, 3), (5, 20)]), lambda n: [("SOURCE", a, min(b, n)) for a, b in ((2, 3), (5, 20)) if a <= n]),
        (reading.windows_of(files, bodies=spark.createDataFrame(bodies, "path string, open_line int, close_line int")), lambda n: [("SOURCE", 1, 2), ("ELISION", 3, 8), ("SOURCE", 9, n)] if n >= 9 else [("SOURCE", 1, 2), ("ELISION", 3, 8)] if n == 8 else [("SOURCE", 1, n)]),
    ):
        offsets, places = None, {p: 0 for p, n in n_lines.items() if plain(n) and n}
        for _ in range(2):
            got: dict = {}
            page = reading.read_pages(files, windows, offsets, *limits).cache()
            for x in page.collect():
                own = got.setdefault(x["path"], ([], x["stop_reason"], x["next_byte"]))
                own[0].append(tuple(x[c] for c in reading._SEGMENT))
            expected = {p: walk(texts[p], plain(n_lines[p]), at, *limits) for p, at in places.items()}
            assert {p: (sorted(s, key=lambda y: y[1]), a, b) for p, (s, a, b) in got.items()} == expected
            offsets, places = page.select("path", F.col("next_byte").alias("offset")).distinct(), {p: e[2] for p, e in expected.items() if e[2] is not None}


def test_a_page_fits_its_envelope(spark):
    files = spark.createDataFrame([("f", "line\n" * 400), ("g", "\x01" * 4000)], "path string, text string")
    windows = reading.windows_of(files, [(i, i) for i in range(1, 400, 2)])
    whole = reading.read_source(files, "f", windows)
    assert len(whole) == 200 and whole[0]["stop_reason"] == "COMPLETE"
    small = reading.read_source(files, "f", windows, envelope=5000)
    assert 10 < len(small) < 30 and small[0]["stop_reason"] == "WIRE_BUDGET"
    rest = reading.read_source(files, "f", windows, small[0]["next_byte"], envelope=5000)
    assert rest[0]["start_byte"] == small[0]["next_byte"]
    one = reading.read_source(files, "g", reading.windows_of(files), envelope=3000)
    assert len(one) == 1 and one[0]["stop_reason"] == "WIRE_BUDGET" and 0 < len(one[0]["content"]) < 4000
    with pytest.raises(QueryError):
        reading.read_source(files, "g", reading.windows_of(files), envelope=10)


def test_summary_outcomes(spark):
    rows = [("a.md", 10, 500, "PARSED", 1), ("a.java", 2**21, 500, "PARSED", 1), ("a.java", 10, 99, "PARSED", 1), ("a.java", 10, 100, None, 0), ("a.java", 10, 100, "PARSE_FAILED", 0), ("a.java", 10, 100, "PARSED", 1), ("a.java", 10, 100, "PARSED", 0)]
    df = spark.createDataFrame(rows, "path string, byte_length long, lines int, status string, n int")
    outcome = lambda view, selector=False: [r[0] for r in df.select(reading.summary_outcome(view, selector, *(F.col(c) for c in df.columns))).collect()]
    assert outcome("AUTO") == ["UNSUPPORTED_LANGUAGE", "FILE_TOO_LARGE", "BELOW_SUMMARY_THRESHOLD", "INDEX_NOT_READY", "FILE_PARSE_FAILED", "ELIDED", "NO_ELISION"]
    assert outcome("SUMMARY")[2] == "ELIDED" and set(outcome("RAW")) == {"NOT_REQUESTED"} == set(outcome("AUTO", True))


def test_envelopes_of_many_files_and_all_of_them_in_the_end(spark):
    import json

    texts = {"a": 'quote " and back\\slash\n' * 40, "b": "\x01\x02é😀\n" * 60, "c": "", "d": "short", "e": "\n" * 500, "f": "x" * 3000}
    files = spark.createDataFrame(list(texts.items()), "path string, text string")
    for c in ('"\\\n\r\t\b\f', "\x00\x1f\x0b\x7fé😀", "plain"):
        size = spark.createDataFrame([(c,)], "c string").select(reading.wire_size(F.col("c"))).first()[0]
        assert size == len(json.dumps(c, ensure_ascii=False).encode()) - 2 + reading.SEGMENT_FRAME
    windows, places, got = reading.windows_of(files).cache(), None, {p: "" for p in texts}
    for _ in range(60):
        page = reading.fit_envelope(reading.read_pages(files, windows, places, max_lines=500), 700).collect()
        for r in page:
            assert r["segment"] and sum(len(json.dumps(x["content"], ensure_ascii=False).encode()) + reading.SEGMENT_FRAME - 2 for x in page if x["path"] == r["path"]) <= 700
            got[r["path"]] += r["content"]
        left = [(r["path"], r["next_byte"]) for r in page if r["next_byte"] is not None]
        if not left:
            break
        places = spark.createDataFrame(left, "path string, offset long")
    assert got == texts
    windows.unpersist()


def test_views(spark):
    body = "class A {\n" + "  int x;\n" * 120 + "}\n"
    files = spark.createDataFrame([("A.java", body), ("B.java", body), ("C.java", "class C {}\n"), ("n.md", body), ("D.java", body)], "path string, text string")
    statuses = spark.createDataFrame([("A.java", "PARSED"), ("B.java", "PARSE_FAILED"), ("C.java", "PARSED")], "path string, status string")
    bodies = spark.createDataFrame([("A.java", 1, 122), ("C.java", 1, 1), ("D.java", 1, 122)], "path string, open_line int, close_line int")
    seen = lambda *a, **k: [{tuple(r) for r in df.collect()} for df in reading.viewed(files, *a, **k)]
    outcomes, windows = seen("AUTO", statuses, bodies)
    assert outcomes == {("A.java", "ELIDED"), ("B.java", "FILE_PARSE_FAILED"), ("C.java", "BELOW_SUMMARY_THRESHOLD"), ("n.md", "UNSUPPORTED_LANGUAGE"), ("D.java", "INDEX_NOT_READY")}
    assert {w for w in windows if w[0] == "A.java"} == {("A.java", "SOURCE", 1, 1), ("A.java", "ELISION", 2, 121), ("A.java", "SOURCE", 122, 122)} and len(windows) == 7
    assert dict(seen("SUMMARY", statuses, bodies)[0])["C.java"] == "NO_ELISION"
    assert dict(seen("SUMMARY", statuses)[0])["A.java"] == "FOLD_METADATA_UNAVAILABLE"
    assert dict(seen("SUMMARY")[0])["A.java"] == "INDEX_UNAVAILABLE"
    outcomes, windows = seen("AUTO", statuses, bodies, [(1, 5)])
    assert {o for _, o in outcomes} == {"NOT_REQUESTED"} and ("A.java", "SOURCE", 1, 5) in windows


def test_a_page_is_made_from_its_rows_once(spark):
    """Why pages stop and what they hold come from one pass; before, two joined passes read every line twice."""
    one = spark.createDataFrame([("a", "x\ny\nz\n"), ("b", "\U0001f600" * 3)], "path string, text string")
    pages = reading.read_pages(one, reading.windows_of(one), max_lines=2, max_bytes=5)
    got = sorted((r["path"], r["content"], r["stop_reason"], r["next_byte"], r["next_line"]) for r in pages.collect())
    assert got == [("a", "x\ny\n", "LINE_BUDGET", 4, 3), ("b", "\U0001f600", "CONTENT_BUDGET", 4, 1)]
    places = spark.createDataFrame([("a", 4), ("b", 4)], "path string, offset long")
    more = reading.read_pages(one, reading.windows_of(one), places, max_lines=2, max_bytes=5)
    assert more._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode") == 1
