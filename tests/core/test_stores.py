"""Stored order, counters of writes, the document sink, catalogues and capacity."""

import random

import pytest
from pyspark.sql import functions as F

from quarrylight.model import QueryError
from quarrylight.operators import checks, documents, lifecycle
from quarrylight.sources import catalogues
from quarrylight.sources.trees import Generations
from quarrylight.streaming.sink import DocumentSink


def stored(spark, parts, folder):
    """A table whose files hold the given keys."""
    for i, keys in enumerate(parts):
        spark.createDataFrame([(k,) for k in keys], "key string").coalesce(1).write.mode("append").parquet(str(folder / "raw"))
        (made,) = [f for f in (folder / "raw").glob("part-*.parquet")]
        folder.joinpath("table").mkdir(exist_ok=True)
        made.rename(folder / "table" / f"part-{i:05d}-x.parquet")
    return str(folder / "table")


@pytest.mark.parametrize("parts", [[["a", "b"], ["c"], ["d", "e"]], [["a", "c", "b"], ["d"]], [["b"], ["a"]], [["a", "b"], [], ["b", "c"]], [["a", "a"], ["é", "z", "😀"]], [[f"{i:04d}" for i in range(3000)] + ["0000"], ["0001", "1"]]])
def test_order_of_a_stored_table(spark, tmp_path, parts):
    keys = [k for p in parts for k in p]
    expected = sorted((a, b) for a, b in zip(keys, keys[1:]) if a.encode() >= b.encode())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        segments = checks.stored_segments(spark, stored(spark, parts, tmp_path), "key")
        assert sorted(map(tuple, checks.stored_order_faults(segments).collect())) == expected
        assert segments.where("kind = 'SEGMENT'").agg(F.sum("n")).first()[0] == len(keys)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_counted_writes_and_refusal(spark, tmp_path):
    store = Generations(spark, str(tmp_path))
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("k"))
    counters = {"rows": {"n": F.count(F.lit(1)), "sum": F.sum("k")}, "keys": {"n": F.count(F.lit(1))}}
    tables = {"rows": rows, "keys": rows.select("k").distinct()}
    found = store.write_counted(tables, "g1", counters, {"rows.n": 1000, "keys.n": 7})
    assert found == {"rows.n": 1000, "rows.sum": sum(i % 7 for i in range(1000)), "keys.n": 7}
    assert store.publish("r", "g1", 0) == 1
    with pytest.raises(QueryError, match="CAPACITY_EXCEEDED"):
        store.write_counted(tables, "g2", counters, {"keys.n": 6})
    assert store.state() == {"version": 1, "selected": {"r": "g1"}} and store.read("r", "rows").count() == 1000
    assert not (tmp_path / "g2").exists()
    assert store.write_counted({"rows": rows.limit(0), "keys": rows.limit(0)}, "g3", counters, {"rows.n": 0}) == {"rows.n": 0, "rows.sum": 0, "keys.n": 0}


OPS = "operation_id string, seq long, owner string, path string, change string, content string"


def test_sink_in_a_stream(spark, tmp_path):
    sink = DocumentSink(spark, str(tmp_path / "sink"))
    source = tmp_path / "in"
    batches = [
        [("a", 1, "o1", "x", "UPSERT", "one"), ("a", 2, "o1", "x", "UPSERT", "two"), ("b", 3, "o2", "y", "UPSERT", "why")],
        [("c", 4, "o1", "x", "REMOVE", None), ("c", 5, "o1", "z", "UPSERT", None)],
        [("a", 1, "o1", "x", "UPSERT", "one"), ("a", 2, "o1", "x", "UPSERT", "two"), ("b", 3, "o2", "y", "UPSERT", "other"), ("d", 6, "o2", "w", "UPSERT", "new")],
    ]
    stream = lambda: spark.readStream.schema(OPS).parquet(str(source)).writeStream.option("checkpointLocation", str(tmp_path / "at")).foreachBatch(sink.apply).trigger(availableNow=True).start()
    for rows in batches:
        spark.createDataFrame(rows, OPS).coalesce(1).write.mode("append").parquet(str(source))
        stream().awaitTermination()
    assert {tuple(r) for r in sink.documents().select("owner", "path", "content", "operation_id").collect()} == {("o1", "z", "", "c"), ("o2", "y", "why", "b"), ("o2", "w", "new", "d")}
    assert sorted((r.operation_id, r.outcome, r.batch) for r in sink.ledger().collect()) == [("a", "APPLIED", 0), ("a", "REPLAYED", 2), ("b", "APPLIED", 0), ("b", "CONFLICT", 2), ("c", "APPLIED", 1), ("d", "APPLIED", 2)]


def test_sink_writes_each_text_once(spark, tmp_path, monkeypatch):
    """Intermediate tables hold no texts; of equal places in a batch the last change counts, and a replay writes nothing."""
    from quarrylight.streaming import sink as module

    sink, seen, written = DocumentSink(spark, str(tmp_path)), [], module.written
    monkeypatch.setattr(module, "written", lambda df, name: seen.extend(df.columns) or written(df, name))
    first = spark.createDataFrame([("a", 1, "o", "x", "UPSERT", "one"), ("a", 1, "o", "x", "UPSERT", "one"), ("a", 2, "o", "y", "UPSERT", "kept"), ("b", 2, "o", "x", "UPSERT", "two")], OPS)
    sink.apply(first, 0)
    sink.apply(spark.createDataFrame([("c", 0, "o", "x", "UPSERT", "three"), ("c", 9, "p", "x", "REMOVE", None)], OPS), 1)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "documents").rglob("*.parquet")}
    sink.apply(first, 2)
    assert {tuple(r) for r in sink.documents().select("owner", "path", "content", "operation_id").collect()} == {("o", "x", "three", "c"), ("o", "y", "kept", "a")}
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "documents").rglob("*.parquet")} == files
    assert "fingerprint" in seen and "content" not in seen


def test_sink_after_a_crash_before_the_ledger(spark, tmp_path, monkeypatch):
    sink = DocumentSink(spark, str(tmp_path))
    rows = lambda *r: spark.createDataFrame(list(r), OPS)
    sink.apply(rows(("a", 1, "o1", "x", "UPSERT", "one"), ("a", 2, "o3", "q", "UPSERT", "kept")), 0)
    later = rows(("b", 3, "o1", "x", "UPSERT", "two"), ("b", 4, "o1", "y", "REMOVE", None))
    real = DocumentSink.ledger
    from quarrylight.streaming import sink as module

    written = module.written
    monkeypatch.setattr(module, "written", lambda df, name: 1 / 0 if name == "ledger" else written(df, name))
    with pytest.raises(ZeroDivisionError):
        sink.apply(later, 1)
    monkeypatch.setattr(module, "written", written)
    for _ in range(2):
        sink.apply(later, 1)
        assert {tuple(r) for r in sink.documents().select("owner", "path", "content").collect()} == {("o1", "x", "two"), ("o3", "q", "kept")}
        assert sorted((r.operation_id, r.outcome, r.batch) for r in real(sink).collect()) == [("a", "APPLIED", 0), ("b", "APPLIED", 1)]
    sink.apply(rows(("a", 1, "o1", "x", "UPSERT", "one"), ("a", 2, "o3", "q", "UPSERT", "kept")).limit(0), 2)
    assert sink.documents().count() == 2


def test_catalogues(spark):
    import hashlib
    import json

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rev = "0" * 40
    row = lambda path, text, **more: {"path": path, "contentDigest": sha(text), "primaryContext": {"repositoryId": "r1", "revision": rev}, "relatedContexts": [], "reviewStatus": "DRAFT"} | more
    p = "repositories/r1/"
    rows = [
        row(p + "a.md", "A"), row(p + "b.md", "B", reviewStatus="APPROVED"), row(p + "c.md", "C", reviewStatus="APPROVED", reviewReference=" "), row(p + "d.md", "D", extra=1), row("repositories/r2/e.md", "E"), row(p + "sub/f.md", "F"),
        row(p + "g.md", "wrong"), row(p + "none.md", ""), row(p + "empty.md", ""), row(p + "big.md", "x" * 65537), row(p + "twice.md", "T"), row(p + "twice.md", "T"), row(p + "h.md", "H", relatedContexts=[{"repositoryId": "r1", "revision": rev}]),
        row(p + "i.md", "I", relatedContexts=[{"repositoryId": "r2", "revision": rev}] * 2), row(p + "j.md", "J", relatedContexts=[{"repositoryId": f"s{k}", "revision": rev} for k in range(9)]), row(p + "k.md", "K", relatedContexts=[{"repositoryId": "r2", "revision": "main"}]),
        row(p + "l.md", "L", contentDigest=5), row(p + "m.md", "M", primaryContext=None), row(p + "n.md", "N", relatedContexts=[{"repositoryId": "r2", "revision": rev}], reviewStatus="APPROVED", reviewReference="ok"), 7, None,
    ]
    whole = {"formatVersion": 1, "documentRepositoryId": "main", "documents": rows}
    raw = [("ok", json.dumps(whole)), ("none", json.dumps(whole | {"documents": []})), ("version", json.dumps(whole | {"formatVersion": 2})), ("typed", json.dumps(whole | {"formatVersion": "x"})), ("extra", json.dumps(whole | {"more": 1})), ("other", json.dumps(whole | {"documentRepositoryId": "x"})), ("cut", json.dumps(whole)[:-2]), ("big", " " * (1 << 18) + json.dumps(whole)), ("list", "[]"), ("null", None)]
    blobs = [(p + "a.md", "A"), (p + "b.md", "B"), (p + "c.md", "C"), (p + "g.md", "G"), (p + "empty.md", ""), (p + "big.md", "x" * 65537), (p + "twice.md", "T"), (p + "n.md", "N")]
    got = catalogues.load(spark.createDataFrame(raw, "catalogue string, body string"), spark.createDataFrame(blobs, "path string, content string"), "main").collect()
    by_place = {r.place: (r.fault, r.content) for r in got if r.catalogue == "ok"}
    assert [by_place[i][0] for i in range(len(rows))] == [None, "REVIEW", "REVIEW", "FIELDS", "PATH", "PATH", "DIGEST", "MISSING", "EMPTY", "CAPACITY", "DUPLICATE", "DUPLICATE", "RELATED", "RELATED", "RELATED", "RELATED", "DIGEST_FORM", "CONTEXT", None, "MALFORMED", "MALFORMED"]
    assert [by_place[i][1] for i in (0, 18, 6)] == ["A", "N", None]
    assert {r.catalogue: r.fault for r in got if r.place is None} == {"version": "VERSION", "typed": "MALFORMED", "extra": "FIELDS", "other": "REPOSITORY", "cut": "MALFORMED", "big": "CAPACITY", "list": "MALFORMED", "null": "MALFORMED"}


def test_capacity_is_judged_by_what_was_admitted(spark):
    rng = random.Random(4)
    rows = [("r", 1, 100, None), ("r", 2, 900, None), ("r", 3, 10, None), ("r", 4, 140, None), ("r", 5, 1, None), ("s", 1, 5, 25), ("s", 2, 6, 25)] + [(f"q{rng.randrange(5)}", i, rng.randrange(120), rng.randrange(400)) for i in range(300)]
    got = {(r.repository_id, r.seq): (r.used, r.admitted) for r in lifecycle.capacity_refusals(spark.createDataFrame(rows, "repository_id string, seq long, bytes long, free long"), 250, 20).collect()}
    assert [got["r", i] for i in range(1, 6)] == [(100, True), (100, False), (110, True), (250, True), (250, False)]
    assert got["s", 1] == (5, True) and got["s", 2] == (5, False)
    used = {}
    for own, seq, size, free in sorted(rows, key=lambda r: r[:2]):
        fits = used.get(own, 0) + size <= 250 and (free is None or free - size >= 20)
        used[own] = used.get(own, 0) + size * fits
        assert got[own, seq] == (used[own], fits)


def test_a_document_with_too_many_sections_is_a_fault(spark):
    docs = spark.createDataFrame([("a", "# x\n" * 256), ("b", "# x\n" * 257), ("c", None)], "path string, content string")
    assert {(r.path, r["count"]) for r in documents.sections(docs).groupBy("path").count().collect()} == {("a", 256), ("c", 1)}
    assert [tuple(r) for r in documents.section_faults(docs).collect()] == [("b", "SECTIONS")]


def test_frozen_inputs(spark, tmp_path):
    from quarrylight.sources import frozen

    root = f"file://{tmp_path}"
    rows = spark.createDataFrame([("a", b"one"), ("b", b"one"), ("c", b""), ("d", None), ("e", b"x" * 11)], "name string, content binary")
    for _ in range(2):  # a second time nothing is written
        got = {r.name: (r.digest and r.digest[:4], r.byte_length, r.fault) for r in frozen.freeze(rows.repartition(3), root, 10).collect()}
        assert got == {"a": ("7692", 3, None), "b": ("7692", 3, None), "c": ("e3b0", 0, None), "d": (None, None, "MISSING"), "e": (None, 11, "CAPACITY")}
        assert all(r.digest == r.actual for r in frozen.stored(spark, root).collect()) and frozen.stored(spark, root).count() == 1 and (tmp_path / frozen.place_of(frozen.hashlib.sha256(b'').hexdigest())).is_file()
    (held,) = tmp_path.glob("76/*")
    held.write_bytes(b"two")
    assert {r.name for r in frozen.freeze(rows, root, 10).where("fault = 'IDENTITY'").collect()} == {"a", "b"}
    plan = spark.createDataFrame([(2, "y", "d2", 5), (1, "x", "d1", 3)], "ordinal int, id string, digest string, byte_length int")
    import hashlib

    text = '{"dependencies":[{"byte_length":3,"digest":"d1","id":"x","ordinal":1},{"byte_length":5,"digest":"d2","id":"y","ordinal":2}],"level":"21"}'
    assert frozen.checked_plan(plan).agg(frozen.plan_digest(plan, level="21")).first()[0] == hashlib.sha256(text.encode()).hexdigest()
    with pytest.raises(QueryError):
        frozen.checked_plan(plan.withColumn("ordinal", F.lit(1)))
    with pytest.raises(QueryError):
        frozen.checked_plan(plan, 1)


def test_spans_and_names(spark):
    text = "class Caf\\u00e9 {\n  é x;\n}"
    files = spark.createDataFrame([("f", text), ("g", ""), ("n", None)], "path string, text string")
    size = len(text.encode())
    rows = [
        ("ok", "f", 0, size, 1, "Café", 6, 15), ("far", "f", 0, size + 1, 1, "Café", 6, 15), ("back", "f", 5, 4, 1, "", 5, 5), ("cut", "f", 21, 23, 2, "x", 21, 21), ("line", "f", 18, 22, 1, "é", 20, 22), ("second", "f", 18, 24, 2, "é", 20, 22),
        ("raw", "f", 0, size, 1, "Caf\\u00e9", 6, 15), ("out", "f", 0, 10, 1, "Café", 6, 15), ("none", "h", 0, 0, 1, "", 0, 0), ("null", "n", 0, 0, 1, "", 0, 0), ("empty", "g", 0, 0, 1, "", 0, 0), ("unset", "f", None, 3, 1, "", 0, 0),
    ]
    spans = spark.createDataFrame(rows, "span_id string, path string, start_byte long, end_byte long, start_line int, name string, name_start_byte long, name_end_byte long")
    assert {tuple(r) for r in checks.span_faults(files, spans).collect()} == {("far", "RANGE"), ("back", "RANGE"), ("cut", "BOUNDARY"), ("line", "LINE"), ("raw", "NAME"), ("out", "NAME"), ("none", "FILE"), ("null", "FILE"), ("unset", "RANGE")}
    assert checks.unescaped(r"\\u0041 A \uu0042 😀") == r"\\u0041 A B 😀"


def test_nesting_and_revisions(spark):
    rows = [("a", None, "p", 0, 100), ("b", "a", "p", 0, 99), ("c", "a", "p", 0, 100), ("d", "a", "q", 1, 2), ("e", "x", "p", 1, 2), ("f", "b", "p", 50, 100)]
    d = spark.createDataFrame(rows, "symbol_id string, parent_id string, path string, start_byte long, end_byte long")
    assert {tuple(r) for r in checks.nesting_faults(d).collect()} == {("c", "PARENT_RANGE"), ("d", "PARENT_PATH"), ("e", "PARENT"), ("f", "PARENT_RANGE")}
    inventory = spark.createDataFrame([("a", "FILE", "TEXT", 1, "x"), ("b", "FILE", "TEXT", 1, "x"), ("c", "FILE", "BINARY", 1, None), ("d", "DIRECTORY", None, 0, None), ("e", "FILE", "TEXT", 2, "y")], "path string, kind string, status string, byte_length long, content_digest string")
    blobs = spark.createDataFrame([("a", 1, "x"), ("c", 1, "x"), ("z", 1, "x"), ("e", 3, "y")], "path string, byte_length long, content_digest string")
    indexed = spark.createDataFrame([("a", "w"), ("y", "x"), ("e", "y")], "path string, content_digest string")
    assert {tuple(r) for r in checks.revision_faults(inventory, blobs, indexed).collect()} == {("a", "STALE_INDEX"), ("b", "MISSING_BLOB"), ("c", "EXTRA_BLOB"), ("z", "EXTRA_BLOB"), ("y", "EXTRA_INDEX"), ("e", "LENGTH")}
    assert {tuple(r) for r in checks.manifest_faults(inventory, spark.createDataFrame([("TEXT", 3), ("SYMLINK", 1)], "status string, n long")).collect()} == {("BINARY", 0, 1), ("SYMLINK", 1, 0)}
