"""Registered queries whose result SQL can express, over the driver's smallest tables."""

import os

import pytest

from quarrylight.llm.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_registry():
    assert set(ORACLE_SQL) <= set(QUERIES) and all(isinstance(x, str) for x in ORACLE_SQL.values())
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    cur = con.execute(ORACLE_SQL[name])
    names = sorted(d[0] for d in cur.description)
    order = [[d[0] for d in cur.description].index(n) for n in names]
    mine = QUERIES[name](spark, SMALL)
    assert sorted(mine.columns) == names
    assert sorted(str(tuple(r)) for r in mine.select(*names).collect()) == sorted(str(tuple(r[i] for i in order)) for r in cur.fetchall())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
def test_companions_equal_sql(spark):
    import duckdb

    from quarrylight.llm import companions

    assert set(companions.QUERIES) == set(companions.ORACLE_SQL) and not set(companions.QUERIES) & set(QUERIES)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    for name, query in companions.QUERIES.items():
        cur = con.execute(companions.ORACLE_SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(map(str, map(tuple, query(spark, SMALL).select(*names).collect()))) == sorted(map(str, cur.fetchall())), name


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
def test_html_of_the_tables(spark):
    """The driver's pages have one layout, so what an article holds can be cut out by patterns."""
    import html
    import re

    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    got = {r["page_id"]: r for r in QUERIES["op4_html"](spark, SMALL).collect()}
    assert len(got) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*)</article>", p["html"] or "", re.S)
        blocks = re.split(r"</?(?:p|h1)>", article[1]) if article else []
        texts = (" ".join(html.unescape(re.sub(r"<br>|</?b>", " ", b)).split()) for b in blocks)
        expected = "\n".join(t for t in texts if t)
        assert got[p["page_id"]]["text"] == expected and got[p["page_id"]]["n_chars"] == len(expected)
