import time

import pytest
from pyspark.sql import functions as F

from quarrylight.model import QueryError
from quarrylight.operators.lifecycle import published_registry
from quarrylight.plans.admission import Gate


def test_gate(spark):
    gate = Gate(spark, 1)
    assert gate.run(lambda: spark.range(3).count(), seconds=60) == 3

    def nested():
        with pytest.raises(QueryError) as e:
            gate.run(lambda: 1)
        return e.value.code

    assert gate.run(nested, seconds=60) == "INDEX_BUSY"
    slow = lambda: spark.range(1 << 42).agg(F.max(F.xxhash64("id"))).collect()
    began = time.time()
    with pytest.raises(QueryError) as e:
        gate.run(slow, seconds=0.5)
    assert e.value.code == "INDEX_TIMEOUT" and time.time() - began < 30
    assert gate.run(lambda: 5) == 5


def test_published_registry(spark):
    rows = [("b", "B", "APPROVED", ["x", "y", "x"]), ("a", "A", "DRAFT", ["z"]), ("c", "C", None, None)]
    df = spark.createDataFrame(rows, "repository_id string, display_name string, review_status string, keywords array<string>")
    assert [tuple(r) for r in published_registry(df).collect()] == [("a", "A", None), ("b", "B", ["x", "y"]), ("c", "C", None)]


def test_cursors_of_documents_expire_with_their_view(spark):
    from quarrylight.operators import documents

    docs = spark.createDataFrame([(f"repositories/{o}/{i}.md", o, f"# one\nword {i}\n# two\nword\n") for o in ("a", "b") for i in range(3)], "path string, owner string, content string")
    selection = lambda a, b="r2": spark.createDataFrame([("a", a), ("b", b)], "owner string, revision string")
    for operation, query, total in (("list", None, 3), ("search", "word", 6)):
        got, token = [], None
        while True:
            rows, token = documents.document_page(operation, docs, selection("r1"), b"key", "a", query, 2, token)
            got += [(r["path"], r["start_line"] if query else 0) for r in rows]
            if token is None:
                break
        assert len(got) == len(set(got)) == total and got == sorted(got)
    ask = lambda chosen, owner, token=None, limit=2, key=b"key", query=None: documents.document_page("search" if query else "list", docs, chosen, key, owner, query, limit, token)
    _, token = ask(selection("r1"), "a")
    assert ask(selection("r1", "r9"), "a", token)[0]  # another owner has moved on
    for bad in (lambda: ask(selection("r8"), "a", token), lambda: ask(selection("r1"), "b", token), lambda: ask(selection("r1"), "a", token, 1), lambda: ask(selection("r1"), "a", token, key=b"other"), lambda: ask(selection("r1"), "a", token, query="word")):
        with pytest.raises(QueryError) as e:
            bad()
        assert e.value.code == "INVALID_ARGUMENT"
    _, all_ = ask(selection("r1"), None)
    with pytest.raises(QueryError):  # the view of all owners is another one as soon as one owner's is
        ask(selection("r1", "r9"), None, all_)
    assert ask(selection("r1"), "nobody") == ([], None)


def test_the_entry_of_a_cursor_must_still_be_there(spark):
    from quarrylight.operators import files

    inventory = spark.createDataFrame([(f"d/{c}.md", "FILE", "TEXT", 1, f"d/{c}.md") for c in "abc"] + [("d", "DIRECTORY", None, 0, "d/")], "path string, kind string, status string, byte_length long, key string")
    assert [r["path"] for r in files.find_files(inventory, "*.md", position=["d/a.md"], replay=True).collect()] == ["d/b.md", "d/c.md"]
    assert [r["path"] for r in files.list_files(inventory, "d", position=["d/b.md"], replay=True).collect()] == ["d/c.md"]
    for f in (lambda: files.find_files(inventory, "*.md", position=["d/aa.md"], replay=True), lambda: files.find_files(inventory, "b*", position=["d/a.md"], replay=True), lambda: files.list_files(inventory, "d", position=["d/x"], replay=True)):
        with pytest.raises(QueryError):
            f()
