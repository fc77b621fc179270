"""Operators on small tables; paging invariants; generations; streams; the registered queries against their SQL."""

import math
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quarrylight.functions.text import displayed, lines, utf16_length
from quarrylight.model import QueryError
from quarrylight.operators import checks, extract, files, index, lifecycle
from quarrylight.plans.paging import after, byte_budget, page
from quarrylight.sources import trees
from quarrylight.streaming import jobs

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_line_model(spark):
    df = spark.createDataFrame([("",), ("a",), ("a\n",), ("a\n\nb\n",), ("\n",)], "t string")
    assert [r[0] for r in df.select(lines(F.col("t"))).collect()] == [[], ["a"], ["a"], ["a", "", "b"], [""]]


def test_units_and_display(spark):
    df = spark.createDataFrame([("a😀b",), ("x\\\r\0\t",)], "t string")
    assert [tuple(r) for r in df.select(utf16_length(F.col("t")), displayed(F.col("t"))).collect()] == [(4, "a😀b"), (5, "x\\\\\\r\\u0000\t")]


def test_pages_add_up_to_one_sort(spark):
    df = spark.range(57).select((F.col("id") % 5).alias("a"), F.col("id").alias("b"))
    whole, seen, position = rows(df.orderBy("a", "b")), [], None
    while True:
        got = page(df, ["a", "b"], 10, position).orderBy("a", "b").collect()
        seen += [(r["a"], r["b"]) for r in got]
        if not got[0]["has_more"]:
            break
        position = [got[-1]["a"], got[-1]["b"]]
    assert seen == whole


def test_keyset_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).select(F.col("id").alias("a"), (F.col("id") * 2).alias("b")).write.parquet(path)
    plan = spark.read.parquet(path).where(after(["a", "b"], [3, 5]))._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(GreaterThan(a,3),And(EqualTo(a,3),GreaterThan(b,5)))" in plan.replace("IsNotNull(a), ", "")


def test_byte_budget_keeps_whole_rows(spark):
    df = spark.createDataFrame([(i, 10) for i in range(5)], "k int, n long")
    assert [r["k"] for r in byte_budget(df, ["k"], F.col("n"), 35).collect()] == [0, 1, 2]


def test_search_text(spark):
    df = spark.createDataFrame([("a.java", "FILE", "TEXT", "xx\n😀aaa aa\n"), ("a/z.java", "FILE", "TEXT", "aa.*aa"), ("b", "FILE", "BINARY", "aa")], "path string, kind string, status string, text string")
    got = [(r["path"], r["line"], r["column"], r["truncated"]) for r in files.search_text(df, "aa").orderBy(F.split("path", "/"), "line", "column").collect()]
    assert got == [("a/z.java", 1, 1, False), ("a/z.java", 1, 5, False), ("a.java", 2, 3, False), ("a.java", 2, 7, False)]
    assert files.search_text(df, ".*", pattern="a/*.java").collect()[0]["column"] == 3
    with pytest.raises(QueryError):
        files.search_text(df, "a\nb")
    with pytest.raises(QueryError):
        files.match_budget(files.search_text(df, "aa"), 7)


def test_list_files_previews(spark):
    paths = [f"d/f{i:02}" for i in range(13)] + ["e/g", "top"]
    inv = trees.with_directories(spark.createDataFrame([(p, "FILE", "TEXT", 1) for p in paths], "path string, kind string, status string, byte_length long"))
    got = rows(files.list_files(inv, "", 2, 100).select("path", "depth", "child_preview"))
    assert ("d", 1, "ELIDED") in got and ("e", 1, "COMPLETE") in got and ("top", 1, "NOT_EXPANDED") in got
    assert sum(p.startswith("d/") for p, _, _ in got) == 12
    assert checks.inventory_faults(inv).count() == 0


def test_merge_and_elide(spark):
    df = spark.createDataFrame([("p", 1, 5), ("p", 3, 9), ("p", 11, 12), ("p", 10, 10), ("q", 4, 4)], "path string, start_line int, end_line int")
    assert sorted(rows(files.merge_ranges(df))) == [("p", 1, 12), ("q", 4, 4)]
    whole = spark.createDataFrame([("p", 1, 40)], "path string, start_line int, end_line int")
    bodies = spark.createDataFrame([("p", 3, 20), ("p", 5, 12), ("p", 25, 28), ("p", 30, 39)], "path string, open_line int, close_line int")
    got = sorted(rows(files.elided_segments(whole, bodies).select("start_line", "end_line", "segment")))
    assert got == [(1, 3, "SOURCE"), (4, 19, "ELISION"), (20, 30, "SOURCE"), (31, 38, "ELISION"), (39, 40, "SOURCE")]


def test_merged_ranges_with_nulls_and_ties_equal_their_sql(spark):
    import duckdb

    from quarrylight.queries import SQL

    lines_ = [(1, 2, 60.0), (1, 2, None), (1, 2, 16.0), (1, 5, 8.0), (1, 5, 8.0), (1, None, 8.0), (2, 1, None), (2, 1, 40.0), (None, 3, 8.0), (None, 3, 8.0)]
    con = duckdb.connect()
    con.execute("set threads = 1")  # with more of them DuckDB sorts equal rows anew for each window, and its result varies
    con.execute("create table lineitem (l_orderkey bigint, l_linenumber int, l_quantity double)")
    con.executemany("insert into lineitem values (?, ?, ?)", lines_)
    theirs = con.execute(f"select path, start_line, end_line from ({SQL['q_merge_ranges']})").fetchall()
    li = spark.createDataFrame(lines_, "l_orderkey long, l_linenumber int, l_quantity double")
    start = F.col("l_linenumber") * 4
    ours = rows(files.merge_ranges(li.select(F.col("l_orderkey").cast("string").alias("path"), start.alias("start_line"), (start + F.floor(F.col("l_quantity") / 8)).cast("int").alias("end_line"))))
    assert sorted(map(repr, ours)) == sorted(map(repr, theirs))


def test_classify_and_publish(spark, tmp_path):
    root = tmp_path / "tree"
    for name, data in {"a.txt": b"hi\n", "sub/b.bin": b"x\0y", "c.bad": b"\xff\0", "d.ptr": trees.LFS_PREFIX.encode() + b"\n", "target/x.txt": b"no", "é.md": "# é\n".encode()}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    tree = trees.read_tree(spark, "file://" + str(root), "repo", "0" * 40)
    assert dict(rows(tree.select("path", "status"))) == {"a.txt": "TEXT", "sub/b.bin": "BINARY", "c.bad": "UNSUPPORTED_ENCODING", "d.ptr": "LFS_POINTER", "é.md": "TEXT"}
    assert checks.digest_faults(tree.where("status = 'TEXT'")).count() == 0
    store = trees.Generations(spark, "file://" + str(tmp_path / "store"))
    store.write({"files": tree.drop("text")}, "g1", {"files": ["path"]})
    with pytest.raises(QueryError):
        store.read("repo", "files")
    assert store.publish("repo", "g1", 0) == 1
    assert store.read("repo", "files").count() == 5
    with pytest.raises(QueryError):
        store.publish("repo", "g2", 0)


def test_registry(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"repositoryId": "b", "displayName": "B"}, {"repositoryId": "a", "displayName": "A"}]')
    assert [r[0] for r in trees.registry_rows(spark, str(tmp_path / "r.json"), ["a", "b"]).select("repositoryId").collect()] == ["a", "b"]


def test_retention(spark):
    at = lambda d: datetime(2024, 1, d)
    pubs = spark.createDataFrame([("r", "x", 1, at(1), True), ("r", "y", 2, at(2), True), ("r", "x", 3, at(3), True), ("r", "z", 4, at(4), False)], "repository_id string, revision string, seq long, published_at timestamp, is_default boolean")
    retired = lifecycle.retirements(pubs)
    assert sorted(rows(retired)) == [("r", "y", at(3)), ("r", "z", at(4))]
    assert rows(lifecycle.current_pointer(pubs).select("revision")) == [("x",)]
    assert [r["revision"] for r in lifecycle.collectable(retired, "2024-02-02 00:00:00").collect()] == ["y"]


def test_jobs_stream_equals_batch(spark, tmp_path):
    reports = spark.createDataFrame([("r", 1, "ACCEPTED", 1), ("r", 1, "COMPLETE", 3), ("r", 1, "RUNNING", 2), ("s", 2, "RUNNING", 5), ("s", 1, "COMPLETE", 6), ("s", 2, "ACCEPTED", 7)], "repository_id string, job_seq long, phase string, event_id long")
    for i in range(3):
        reports.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(reports.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.job_states(stream).writeStream.outputMode("update").format("memory").queryName("job_states").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    last = {}
    for r in spark.sql("select * from job_states").collect():
        key = (r["job_seq"], {"ACCEPTED": 0, "RUNNING": 1}.get(r["phase"], 2))
        last[r["repository_id"]] = max(last.get(r["repository_id"], ((-1, -1), "")), (key, r["phase"]))
    assert {k: (v[0][0], v[1]) for k, v in last.items()} == {r[0]: (r[1], r[2]) for r in lifecycle.latest_jobs(reports).collect()} == {"r": (1, "COMPLETE"), "s": (2, "RUNNING")}


def test_extraction_joins(spark):
    sources = [
        ("a/Base.java", "package a; public class Base { public void go(int n) { } void once() { } }"),
        ("b/Child.java", "package b; import a.Base; public class Child extends Base { public void go(int n) { once(); helper(); this.helper(); new Base(); new Gone(); } void helper() { } void twice(int a) { } }"),
        ("b/Bad.java", "class {"),
    ]
    parsed = extract.parse_files(spark.createDataFrame(sources, "path string, text string"), "g").cache()
    assert dict(rows(parsed.select("path", "status"))) == {"a/Base.java": "PARSED", "b/Child.java": "PARSED", "b/Bad.java": "PARSE_FAILED"}
    decl = extract.facts(parsed, "declarations")
    ids = {(r["owner"], r["name"]): r["symbol_id"] for r in decl.collect()}
    types = {(r["kind"], r["written_target"]): (r["target_symbol_id"], r["unresolved_reason"]) for r in extract.resolved_types(parsed).collect()}
    assert types[("EXTENDS", "Base")] == (ids[("a", "Base")], None) == types[("CONSTRUCT", "Base")]
    assert types[("CONSTRUCT", "Gone")] == (None, "MISSING_TYPE")
    calls = [(r["written_target"], r["resolution_state"]) for r in extract.resolved_calls(parsed).collect()]
    assert sorted(calls) == [("helper", "STATIC_RESOLVED"), ("helper", "STATIC_RESOLVED"), ("once", "UNRESOLVED")]
    assert rows(extract.overrides(parsed)) == [(ids[("b.Child", "go")], ids[("a.Base", "go")])]
    assert checks.dangling(decl.select("parent_id"), "parent_id", decl, "symbol_id").count() == 0
    assert index.folds_of(extract.facts(parsed, "folds"), decl.drop("kind").withColumn("kind", F.lit("x")), F.lit(True)).count() == 5


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
def test_registered_queries_equal_their_sql(spark):
    import duckdb

    import quarrylight.queries_contract
    import quarrylight.queries_java
    import quarrylight.queries_stores
    import quarrylight.queries_types  # noqa: F401
    from quarrylight.queries import QUERIES, SQL

    assert set(SQL) <= set(QUERIES)
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SMALL}/{name}'")

    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 9)
        return tuple(map(plain, v)) if isinstance(v, list) else v

    wrong = []
    for name, f in QUERIES.items():
        if name not in SQL:
            continue
        mine = f(spark, SMALL)
        cur = con.execute(SQL[name])
        names = [d[0] for d in cur.description]
        theirs = sorted((repr([plain(v) for _, v in sorted(zip(names, r))]) for r in cur.fetchall()))
        ours = sorted(repr([plain(v) for _, v in sorted(zip(mine.columns, r))]) for r in mine.collect())
        if sorted(names) != sorted(mine.columns) or ours != theirs:
            wrong.append(name)
    assert not wrong


def test_views_and_pages_that_must_be_checked(spark):
    from quarrylight.operators import documents, lifecycle
    from quarrylight.plans.paging import checked_page, cursor_budget

    selection = spark.createDataFrame([("a", "r1"), ("b", "r2")], "owner string, revision string")
    documents.checked_view(selection, "a", "r1")
    documents.checked_view(selection, "none", "")
    with pytest.raises(QueryError):
        documents.checked_view(selection, None, "old")
    rows = spark.createDataFrame([(1, 10), (2, 10), (3, 10)], "k int, n int")
    sizes = lambda budget: [(r["k"], r["has_more"]) for r in cursor_budget(rows, ["k"], F.col("n"), budget, 5).collect()]
    assert sizes(30) == [(1, False), (2, False), (3, False)] and sizes(29) == [(1, True), (2, True)] and sizes(24) == [(1, True)]
    with pytest.raises(QueryError):
        checked_page(rows, cursor_budget(rows, ["k"], F.col("n"), 14, 5))
    with pytest.raises(QueryError):
        lifecycle.get_job(rows, "r", 1, 2)


def test_spans_within_spans_equal_all_pairs(spark):
    import random

    from quarrylight.operators.spans import within

    rng = random.Random(9)
    rows = lambda n: [(rng.choice("pqr"), i, a, a + rng.randrange(0, 30)) for i in range(n) for a in [rng.randrange(60)]]
    inner, outer = rows(150), rows(120)
    schema = "path string, id int, a long, b long"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        span = F.col("a"), F.col("b")
        got = within(spark.createDataFrame(inner, schema), spark.createDataFrame(outer, schema), span, span).select("path", "inner.id", "outer.id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == sorted((p, i, k) for p, i, a, b in inner for q, k, x, y in outer if p == q and x <= a and b <= y)
    assert within(spark.createDataFrame(inner, schema), spark.createDataFrame([], schema), span, span).count() == 0


def test_sorted_passes_keep_their_rows_together_after_joins(spark):
    """Both sides come from joins by path that adaptive execution turns into broadcasts: their partitions then no longer hold whole paths."""
    from quarrylight.operators.spans import within

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10485760")
    try:
        paths_ = spark.range(3000).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.col("id"))
        few = paths_.where(F.pmod(F.xxhash64("path"), F.lit(10)) == 0)
        some = few.groupBy("path").agg(F.max("id").alias("m")).where("m >= 0").select("path")
        inner = paths_.select("path", F.lit(3).alias("a"), F.lit(5).alias("b")).join(some, "path", "left_semi")
        outer = paths_.select(F.concat(F.lit("p"), (2999 - F.col("id")).cast("string")).alias("path"), F.lit(1).alias("a"), F.lit(9).alias("b")).join(some, "path", "left_semi")
        span = F.col("a"), F.col("b")
        met = within(inner, outer, span, span)
        assert len(met.collect()) == some.count() > 200
        # the exchange in front of the pass is still there after adaptive execution
        assert "Exchange hashpartitioning(xxhash64(path" in met._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
