"""Registered queries of the engine over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import paths
from quarrylight.functions.identity import framed_sha256
from quarrylight.functions.text import utf8_prefix, utf16_length
from quarrylight.operators import checks, documents, files, index, lifecycle, reading
from quarrylight.plans.paging import after, byte_budget, page
from quarrylight.sources import logical as L

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *tables: str, recursive: bool = False) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = L.sql(sql, *tables, recursive=recursive)
        return f

    return add


def _has_more(order: str, limit: int, body: str, columns: str, desc: bool = False) -> str:
    return f"""WITH body AS ({body}), ahead AS (SELECT * FROM body ORDER BY {order} LIMIT {limit + 1}),
    numbered AS (SELECT *, row_number() OVER (ORDER BY {order}) AS n__, count(*) OVER () > {limit} AS has_more FROM ahead)
    SELECT {columns}, has_more FROM numbered WHERE n__ <= {limit}"""


# --- catalogue --------------------------------------------------------------------------------------

_CURRENT = "SELECT repository_id, arg_max(revision, seq) AS revision, max(seq) AS seq, arg_max(published_at, seq) AS published_at FROM publications WHERE is_default GROUP BY repository_id"


@query("q_list_repositories", f"""WITH c AS ({_CURRENT}), body AS (SELECT repository_id, display_name FROM registry WHERE contains(display_name, '1') AND repository_id > 'r10'),
    ahead AS (SELECT * FROM body ORDER BY repository_id LIMIT 41), n AS (SELECT *, row_number() OVER (ORDER BY repository_id) AS k, count(*) OVER () > 40 AS has_more FROM ahead),
    idx AS (SELECT repository_id, revision, 'READY' AS index_state FROM c WHERE seq % 2 = 0)
    SELECT n.repository_id, display_name, c.revision, CASE WHEN c.revision IS NULL THEN 'UNAVAILABLE' ELSE coalesce(index_state, 'NOT_READY') END AS index_state, has_more
    FROM n LEFT JOIN c ON c.repository_id = n.repository_id LEFT JOIN idx ON idx.repository_id = n.repository_id AND idx.revision = c.revision WHERE k <= 40""", "publications", "registry")  # fmt: skip
def _(s, d):
    current = lifecycle.current_pointer(L.publications(s, d))
    ready = current.where(F.col("seq") % 2 == 0).withColumn("index_state", F.lit("READY"))
    return lifecycle.list_repositories(L.registry(s, d), current, ready, name="1", limit=40, position="r10")


@query("q_get_context_current", "SELECT repository_id, arg_max(revision, seq) AS revision, arg_max(published_at, seq) AS published_at FROM publications WHERE is_default AND repository_id = 'r7' GROUP BY repository_id", "publications")
def _(s, d):
    return lifecycle.get_context(L.publications(s, d), "r7")


@query("q_get_context_revision", "SELECT repository_id, revision, arg_min(published_at, seq) AS published_at FROM publications WHERE repository_id = 'r7' AND revision = sha1('11') GROUP BY repository_id, revision", "publications")
def _(s, d):
    import hashlib

    return lifecycle.get_context(L.publications(s, d), "r7", hashlib.sha1(b"11").hexdigest())


# --- files ------------------------------------------------------------------------------------------

_UP = "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END"


@query("q_list_files_d1", _has_more("key", 50, f"SELECT path, kind, byte_length, 1 AS depth, 'NOT_EXPANDED' AS child_preview, key FROM inventory WHERE path LIKE 'en/src1/%' AND {_UP} = 'en/src1'", "path, kind, byte_length, depth, child_preview"), "inventory")
def _(s, d):
    return files.list_files(L.inventory(s, d), "en/src1", 1, 50)


@query("q_list_files_d2", _has_more("key", 100, f"""WITH i AS (SELECT *, {_UP} AS up FROM inventory WHERE path LIKE 'en/%'),
    g AS (SELECT *, row_number() OVER (PARTITION BY up ORDER BY key) AS n FROM i WHERE len(string_split(path, '/')) = 3)
    SELECT path, kind, byte_length, 1 AS depth, CASE WHEN kind <> 'DIRECTORY' THEN 'NOT_EXPANDED' WHEN EXISTS (SELECT 1 FROM g WHERE g.up = i.path AND g.n > 12) THEN 'ELIDED' ELSE 'COMPLETE' END AS child_preview, key FROM i WHERE up = 'en'
    UNION ALL SELECT path, kind, byte_length, 2, 'NOT_EXPANDED', key FROM g WHERE n <= 12""", "path, kind, byte_length, depth, child_preview"), "inventory")  # fmt: skip
def _(s, d):
    return files.list_files(L.inventory(s, d), "en", 2, 100)


def _find(name: str, pattern: str, regex: str, directory: str = "", position: str | None = None) -> None:
    where = f"regexp_full_match(path, '{regex}')" + (f" AND starts_with(path, '{directory}/')" if directory else "") + (f" AND path > '{position}'" if position else "")

    @query(name, _has_more("path", 60, f"SELECT path, status, byte_length FROM file_rows WHERE {where}", "path, status, byte_length"), "file_rows")
    def _(s, d):
        return files.find_files(L.inventory(s, d), pattern, directory, 60, None if position is None else [position])


_find("q_find_files_literal", "en/src1/000000001.md", "en/src1/000000001\\.md")
_find("q_find_files_star", "*7.md", "(?:[^/]+/)*[^/]*7\\.md")
_find("q_find_files_globstar", "en/**/*5.md", "en/(?:[^/]+/)*[^/]*5\\.md")
_find("q_find_files_brace", "{en,de}/src{1,2,13}/*.md", "(?:en|de)/src(?:1|2|13)/[^/]*\\.md")
_find("q_find_files_class", "fr/src[!2-9]/0000*[0-4].md", "fr/src[^2-9/]/0000[^/]*[0-4]\\.md")
_find("q_find_files_scoped_page", "?????????.md", "(?:[^/]+/)*[^/]{9}\\.md", "es", "es/src1")


def _search(name: str, text: str, limit: int, where: str = "", **scope) -> None:
    sql = f"""WITH hits AS (SELECT path, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS t FROM (SELECT path, string_split(text, chr(10)) AS ls FROM file_rows WHERE contains(text, '{text}') {where})),
    o AS (SELECT path, line, p, unnest(range(1, len(p))) AS k FROM (SELECT path, line, string_split(t, '{text}') AS p FROM hits WHERE contains(t, '{text}'))),
    c AS (SELECT path, line, array_to_string(p[1:k], '{text}') AS before FROM o),
    q AS (SELECT path, line, length(before) + len(regexp_extract_all(before, '[\\x{{10000}}-\\x{{10FFFF}}]')) + 1 AS col, string_split(path, '/') AS comp FROM c),
    ahead AS (SELECT * FROM q ORDER BY comp, line, col LIMIT {limit + 1}),
    n AS (SELECT *, row_number() OVER (ORDER BY comp, line, col) AS k, count(*) OVER () > {limit} AS truncated FROM ahead)
    SELECT path, CAST(line AS INTEGER) AS line, CAST(col AS INTEGER) AS "column", '{text}' AS matched_text, truncated FROM n WHERE k <= {limit}"""

    @query(name, sql, "file_rows")
    def _(s, d):
        return files.search_text(L.file_rows(s, d, text=True), text, limit=limit, **scope)


_search("q_search_text", "onthe", 100)
_search("q_search_text_scoped", "in", 80, "AND starts_with(path, 'de/src1/') AND regexp_full_match(path, '(?:[^/]+/)*[^/]*[0-5]\\.md')", directory="de/src1", pattern="*[0-5].md")
_search("q_search_text_accents", "ción", 100)


def _lines(name: str, body: str, **selector) -> None:
    @query(name, f"SELECT path, CAST(line AS INTEGER) AS line, text FROM all_lines l WHERE {body}", "all_lines")
    def _(s, d):
        return files.read_lines(L.file_rows(s, d, text=True), F.lit(True), **selector)


_lines("q_read_lines_range", "line BETWEEN 2 AND 4", ranges=[(2, 4)])
_lines("q_read_lines_merge", "line BETWEEN 1 AND 5 OR line BETWEEN 9 AND 11", ranges=[(3, 5), (1, 2), (9, 10), (10, 11)])
_lines("q_read_lines_context", "line BETWEEN 1 AND 6 OR line BETWEEN 18 AND 24", ranges=[(2, 4), (20, 22)], before=2, after=2)
_lines("q_read_lines_from", "line >= 7", start_line=7)
_lines("q_read_lines_tail", "line > (SELECT max(m.line) FROM all_lines m WHERE m.path = l.path) - 3", tail=3)


@query("q_read_budget_page", """WITH l AS (SELECT path, line, text, row_number() OVER (PARTITION BY path ORDER BY line) AS n, sum(octet_length(encode(text)) + 1) OVER (PARTITION BY path ORDER BY line) AS b FROM all_lines),
    o AS (SELECT *, CASE WHEN n > 6 THEN 'LINE_BUDGET' WHEN b > 900 THEN 'CONTENT_BUDGET' END AS over_ FROM l), w AS (SELECT *, min(over_) OVER (PARTITION BY path) AS stop FROM o)
    SELECT path, CAST(line AS INTEGER) AS line, text, coalesce(stop, 'COMPLETE') AS stop_reason FROM w WHERE over_ IS NULL""", "all_lines")  # fmt: skip
def _(s, d):
    rows = files.line_table(L.file_rows(s, d, text=True))
    return files.budget_page(rows, max_lines=6, max_bytes=900)


@query("q_read_clipped_lines", """SELECT path, CAST(line AS INTEGER) AS line, substr(text, 1, (SELECT max(k) FROM range(0, 91) r(k) WHERE octet_length(encode(substr(text, 1, CAST(k AS BIGINT)))) <= 90)) AS clipped FROM all_lines""", "all_lines")
def _(s, d):
    rows = files.line_table(L.file_rows(s, d, text=True))
    return rows.select("path", "line", utf8_prefix(F.col("text"), 90).alias("clipped"))


# Pages of whole files: lines with their line feeds, running sums, and the cut within the line that does not fit.
_LB = """lb AS (SELECT a.path, a.line, a.text || CASE WHEN a.line = max(a.line) OVER (PARTITION BY a.path) AND NOT f.text LIKE '%' || chr(10) THEN '' ELSE chr(10) END AS t FROM all_lines a JOIN file_rows f ON f.path = a.path),
    b AS (SELECT path, line, t, octet_length(encode(t)) AS sz, coalesce(sum(octet_length(encode(t))) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM lb)"""


def _chars(text: str, most: str, bound: int) -> str:
    return f"(SELECT max(k) FROM range(0, {bound + 1}) r(k) WHERE k <= {most} AND octet_length(encode(substr({text}, 1, CAST(k AS BIGINT)))) <= {most})"


def _page_sql(n: int, rows: str, most_lines: int, most_bytes: int) -> str:
    return f"""x{n} AS (SELECT *, row_number() OVER w AS k, sum(sz) OVER w AS used, {most_bytes} - (sum(sz) OVER w - sz) AS rest FROM ({rows}) WINDOW w AS (PARTITION BY path ORDER BY line)),
    o{n} AS (SELECT *, CASE WHEN k > {most_lines} AND rest >= octet_length(encode(substr(t, 1, 1))) THEN 'LINE_BUDGET' WHEN k > {most_lines} OR used > {most_bytes} THEN 'CONTENT_BUDGET' END AS over_ FROM x{n}),
    f{n} AS (SELECT path, min(line) AS fl FROM o{n} WHERE over_ IS NOT NULL GROUP BY path),
    p{n} AS (SELECT o.*, CASE WHEN over_ IS NULL THEN t WHEN over_ = 'CONTENT_BUDGET' AND k <= {most_lines} AND rest > 0 THEN substr(t, 1, CAST({_chars('t', 'rest', most_bytes)} AS BIGINT)) ELSE '' END AS part FROM o{n} o LEFT JOIN f{n} f ON f.path = o.path WHERE fl IS NULL OR line <= fl),
    s{n} AS (SELECT path, max(over_) AS over_, max(CASE WHEN over_ IS NOT NULL THEN st + octet_length(encode(part)) END) AS nb, max(CASE WHEN over_ IS NOT NULL THEN line END) AS nl FROM p{n} GROUP BY path),
    g{n} AS (SELECT path, min(st) AS sb, max(st + octet_length(encode(part))) AS eb, min(line) AS sl, max(line) AS el, string_agg(part, '' ORDER BY line) AS content, bool_or(mid) AS sm, bool_or(over_ IS NOT NULL) AS em FROM p{n} WHERE octet_length(encode(part)) > 0 GROUP BY path),
    page{n} AS (SELECT s.path, CASE WHEN g.path IS NOT NULL THEN 'SOURCE' END AS segment, CAST(sb AS BIGINT) AS start_byte, CAST(eb AS BIGINT) AS end_byte, CAST(sl AS INTEGER) AS start_line, CAST(el AS INTEGER) AS end_line, content, sm AS starts_mid_line, em AS ends_mid_line, coalesce(over_, 'COMPLETE') AS stop_reason, CAST(nb AS BIGINT) AS next_byte, CAST(nl AS INTEGER) AS next_line FROM s{n} s LEFT JOIN g{n} g ON g.path = s.path)"""


_PAGE1 = _page_sql(1, "SELECT *, false AS mid FROM b", 6, 900)
_PAGE2 = _page_sql(2, f"SELECT path, line, CASE WHEN off > st THEN substr(t, 1 + CAST({_chars('t', 'off - st', 900)} AS BIGINT)) ELSE t END AS t, sz - greatest(off - st, 0) AS sz, greatest(st, off) AS st, off > st AS mid FROM (SELECT b.*, page1.next_byte AS off FROM b JOIN page1 ON page1.path = b.path WHERE next_byte IS NOT NULL AND st + sz > next_byte)", 6, 900)


@query("q_read_source_page", f"WITH {_LB}, {_PAGE1} SELECT * FROM page1", "all_lines")
def _(s, d):
    f = L.file_rows(s, d, text=True).select("path", "text")
    return reading.read_pages(f, reading.windows_of(f), max_lines=6, max_bytes=900)


@query("q_read_source_next_page", f"WITH {_LB}, {_PAGE1}, {_PAGE2} SELECT * FROM page2", "all_lines")
def _(s, d):
    f = L.file_rows(s, d, text=True).select("path", "text")
    first = reading.read_pages(f, reading.windows_of(f), max_lines=6, max_bytes=900)
    places = first.where(F.col("next_byte").isNotNull()).select("path", F.col("next_byte").alias("offset"))
    return reading.read_pages(f, reading.windows_of(f), places, max_lines=6, max_bytes=900)


@query("q_read_source_summary", """WITH n AS (SELECT path, max(line) AS total FROM all_lines GROUP BY path), body AS (SELECT path, 3 AS a, 7 AS z FROM n WHERE total >= 8),
    seg AS (SELECT path, 'ELISION' AS segment, a AS f, z AS l FROM body UNION ALL SELECT n.path, 'SOURCE', 1, coalesce(a - 1, total) FROM n LEFT JOIN body ON body.path = n.path UNION ALL SELECT n.path, 'SOURCE', z + 1, total FROM n JOIN body ON body.path = n.path),
    t AS (SELECT seg.path, segment, f, string_agg(text || chr(10), '' ORDER BY line) AS content, sum(octet_length(encode(text)) + 1) AS n FROM seg JOIN all_lines a ON a.path = seg.path AND line BETWEEN f AND l GROUP BY seg.path, segment, f)
    SELECT seg.path, seg.segment, CAST(seg.f AS INTEGER) AS start_line, CAST(seg.l AS INTEGER) AS end_line, CASE WHEN seg.segment = 'SOURCE' THEN rtrim(content, chr(10)) END AS content FROM seg JOIN t ON t.path = seg.path AND t.segment = seg.segment AND t.f = seg.f""", "all_lines")  # fmt: skip
def _(s, d):
    f = L.file_rows(s, d, text=True).select("path", "text")
    bodies = files.line_table(f).groupBy("path").agg(F.max("line").alias("total")).where("total >= 8").select("path", F.lit(2).alias("open_line"), F.lit(8).alias("close_line"))
    page = reading.read_pages(f, reading.windows_of(f, bodies=bodies), max_lines=500)
    return page.select("path", "segment", "start_line", "end_line", F.regexp_replace("content", "\n+$", "").alias("content"))


_RANGES = "SELECT CAST(l_orderkey AS VARCHAR) AS path, CAST(l_linenumber * 4 AS INTEGER) AS start_line, CAST(l_linenumber * 4 + floor(l_quantity / 8) AS INTEGER) AS end_line FROM lineitem"


def _ranges(s, d):
    li = L.table(s, d, "lineitem")
    return li.select(F.col("l_orderkey").cast("string").alias("path"), (F.col("l_linenumber") * 4).cast("int").alias("start_line"), (F.col("l_linenumber") * 4 + F.floor(F.col("l_quantity") / 8)).cast("int").alias("end_line"))


@query("q_merge_ranges", f"""WITH r AS ({_RANGES}), m AS (SELECT *, max(end_line) OVER (PARTITION BY path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
    g AS (SELECT *, sum(CASE WHEN start_line <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT path, min(start_line) AS start_line, max(end_line) AS end_line FROM g GROUP BY path, island""")  # fmt: skip
def _(s, d):
    return files.merge_ranges(_ranges(s, d))


@query("q_elided_segments", f"""WITH b AS ({_RANGES}), r AS (SELECT path, 1 AS start_line, CAST(max(end_line) + 2 AS INTEGER) AS end_line FROM b GROUP BY path),
    body AS (SELECT path, start_line + 1 AS a, end_line - 1 AS z FROM b WHERE end_line - 1 - (start_line + 1) + 1 >= 4),
    ins AS (SELECT r.path, r.start_line, r.end_line, a, z, max(z) OVER (PARTITION BY r.path ORDER BY a, z DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r JOIN body ON body.path = r.path AND a >= r.start_line AND z <= r.end_line),
    o AS (SELECT *, coalesce(lead(a) OVER (PARTITION BY path ORDER BY a, z DESC) - 1, end_line) AS until FROM ins WHERE reach IS NULL OR a > reach),
    seg AS (SELECT path, 'ELISION' AS segment, a AS f, z AS t FROM o UNION ALL SELECT path, 'SOURCE', z + 1, until FROM o
      UNION ALL SELECT r.path, 'SOURCE', r.start_line, coalesce((SELECT min(a) FROM o WHERE o.path = r.path) - 1, r.end_line) FROM r)
    SELECT path, segment, CAST(f AS INTEGER) AS start_line, CAST(t AS INTEGER) AS end_line FROM seg WHERE segment = 'ELISION' OR f <= t""")  # fmt: skip
def _(s, d):
    b = _ranges(s, d)
    whole = b.groupBy("path").agg(F.lit(1).alias("start_line"), (F.max("end_line") + 2).alias("end_line"))
    return files.elided_segments(whole, b.select("path", F.col("start_line").alias("open_line"), F.col("end_line").alias("close_line")))


# --- index ------------------------------------------------------------------------------------------

_DECL = "symbol_id, name, kind, owner, path, start_byte, name_start_byte"
_SO = "name, path, name_start_byte, kind, symbol_id"


def _code(name: str, where: str, **request) -> None:
    limit = request.get("limit", 20)

    @query(name, _has_more(_SO, limit, f"SELECT {_DECL} FROM declarations WHERE {where}", _DECL), "declarations")
    def _(s, d):
        return index.search_code(L.declarations(s, d), **request)


_code("q_search_code_prefix", "starts_with(name, 'blue')", query="blue", match="prefix", limit=50)


@query("q_search_code_exact", _has_more(_SO, 20, f"SELECT {_DECL} FROM declarations WHERE name = (SELECT p_name FROM part WHERE p_partkey = 17)", _DECL), "declarations")
def _(s, d):
    decl = L.declarations(s, d)
    return page(decl.join(F.broadcast(decl.where(F.col("symbol_id") == "17").select("name").limit(1)), "name").select(*_DECL.split(", ")), index.SEARCH_ORDER, 20)


@query("q_search_code_kinds", _has_more(_SO, 60, f"SELECT {_DECL} FROM declarations WHERE starts_with(name, 'r') AND kind IN ('ECONOMY', 'STANDARD', 'SMALL') AND owner <> ''", _DECL), "declarations")
def _(s, d):
    return index.search_code(L.declarations(s, d).where(F.col("owner") != ""), "r", "prefix", ["STANDARD", "ECONOMY", "SMALL"], limit=60)


@query("q_search_code_owner", _has_more(_SO, 30, f"SELECT {_DECL} FROM declarations WHERE starts_with(name, 's') AND owner = 'Brand#12'", _DECL), "declarations")
def _(s, d):
    return index.search_code(L.declarations(s, d), "s", "prefix", owner="Brand#12", limit=30)


@query("q_page_after", _has_more(_SO, 40, f"SELECT {_DECL} FROM declarations WHERE (name > 'p' OR (name = 'p' AND path > 'Brand#3') OR (name = 'p' AND path = 'Brand#3' AND name_start_byte > 7))", _DECL), "declarations")
def _(s, d):
    return page(L.declarations(s, d).where(after(index.SEARCH_ORDER[:3], ["p", "Brand#3", 7])).select(*_DECL.split(", ")), index.SEARCH_ORDER, 40)


@query("q_outline", _has_more("path, start_byte, symbol_id", 20, f"SELECT {_DECL}, 'PARSED' AS file_status FROM (SELECT * REPLACE (owner AS path) FROM declarations) WHERE path = 'Brand#12'", _DECL + ", file_status"), "declarations")
def _(s, d):
    decl = L.declarations(s, d).withColumn("path", F.col("owner"))
    outcomes = decl.select("path").distinct().withColumn("status", F.lit("PARSED"))
    return index.get_outline(decl, outcomes, "Brand#12").select(*_DECL.split(", "), "file_status", "has_more")


@query("q_entry_points", _has_more("path, start_byte, kind, candidate_id", 50, "SELECT symbol_id AS candidate_id, path, kind, start_byte FROM declarations WHERE kind IN ('PROMO', 'STANDARD') AND starts_with(path, 'Brand#12/')", "candidate_id, path, kind, start_byte"), "declarations")
def _(s, d):
    c = L.declarations(s, d).select(F.col("symbol_id").alias("candidate_id"), "path", "kind", "start_byte")
    return index.list_entry_points(c, ["STANDARD", "PROMO"], "Brand#12", 50)


_REL = "relation_id, path, kind, resolution_state, start_byte, container_symbol_id, target_symbol_id, external_target_id, unresolved_reason"


def _relation(name: str, where: str, anchor: tuple[str, str], direction: str, limit: int = 40, **more) -> None:
    @query(name, _has_more("path, start_byte, kind, relation_id", limit, f"SELECT {_REL} FROM relations WHERE {where}", _REL), "relations")
    def _(s, d):
        return index.find_relations(L.relations(s, d).select(*_REL.split(", ")), anchor, direction, limit=limit, **more)


_relation("q_relations_outgoing", "container_symbol_id = '7'", ("symbol", "7"), "OUTGOING")
_relation("q_relations_incoming", "target_symbol_id = '11' AND kind IN ('N', 'R')", ("symbol", "11"), "INCOMING", kinds=["R", "N"])
_relation("q_relations_external", "external_target_id = '5' AND resolution_state = 'F'", ("external", "5"), "INCOMING", states=["F"])
_relation("q_relations_file", "path = '35'", ("file", "35"), "OUTGOING")


@query("q_relations_file_status", _has_more("path, start_byte, kind, relation_id", 40, f"SELECT {_REL} FROM relations WHERE target_symbol_id = '12'", _REL).replace("SELECT " + _REL + ", has_more FROM numbered WHERE", "SELECT " + _REL + ", has_more, (SELECT o_orderstatus FROM orders WHERE CAST(o_orderkey AS VARCHAR) = numbered.path) AS file_status FROM numbered WHERE"), "relations")
def _(s, d):
    f = L.table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderstatus").alias("status"))
    return index.find_relations(L.relations(s, d).select(*_REL.split(", ")), ("symbol", "12"), "INCOMING", limit=40, files=f)


@query("q_folds", """WITH f AS (SELECT symbol_id, start_byte FROM declarations WHERE owner = 'Brand#12' ORDER BY start_byte, symbol_id LIMIT 100)
    SELECT f.symbol_id, f.start_byte, x.name, x.kind FROM f LEFT JOIN (SELECT symbol_id, name, kind FROM declarations WHERE kind <> 'PROMO') x ON x.symbol_id = f.symbol_id""", "declarations")  # fmt: skip
def _(s, d):
    decl = L.declarations(s, d)
    return index.folds_of(decl.select("symbol_id", "start_byte", "owner"), decl.where(F.col("kind") != "PROMO"), F.col("owner") == "Brand#12").drop("owner")


@query("q_bounded_payload", "SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 600 THEN text END AS text, CAST(octet_length(encode(text)) AS INTEGER) AS text_bytes FROM documents")
def _(s, d):
    return L.table(s, d, "documents").select("doc_id", *index.bounded("text", 600))


@query("q_nearest_enclosing", f"""WITH b AS ({_RANGES}), sp AS (SELECT path, path || ':' || start_line || ':' || end_line AS symbol_id, start_line AS s, end_line AS e FROM b),
    pt AS (SELECT path, path || '@' || start_line AS point_id, start_line + 1 AS pos FROM b)
    SELECT pt.path, point_id, pos, arg_min(symbol_id, {{'w': e - s, 'i': symbol_id}}) AS container_symbol_id FROM (SELECT DISTINCT * FROM pt) pt LEFT JOIN sp ON sp.path = pt.path AND s <= pos AND pos < e GROUP BY pt.path, point_id, pos""")  # fmt: skip
def _(s, d):
    b = _ranges(s, d)
    spans = b.select("path", F.concat_ws(":", "path", "start_line", "end_line").alias("symbol_id"), F.col("start_line").alias("start_byte"), F.col("end_line").alias("end_byte"))
    points = b.select("path", F.concat_ws("@", "path", "start_line").alias("point_id"), (F.col("start_line") + 1).alias("at")).distinct()
    return index.nearest_enclosing(spans, points).withColumnRenamed("at", "pos")


# --- coverage ---------------------------------------------------------------------------------------


@query("q_cov_groups", "SELECT kind, resolution_state, unresolved_reason, count(*) AS n FROM relations GROUP BY ALL", "relations")
def _(s, d):
    return index.coverage_groups(L.relations(s, d))


@query("q_cov_grouping_sets", """SELECT 'kind' AS dimension, kind AS value, count(*) AS n FROM relations GROUP BY 2 UNION ALL SELECT 'state', resolution_state, count(*) FROM relations GROUP BY 2
    UNION ALL SELECT 'reason', unresolved_reason, count(*) FROM relations WHERE unresolved_reason IS NOT NULL GROUP BY 2""", "relations")  # fmt: skip
def _(s, d):
    return index.coverage_marginals(L.relations(s, d))


@query("q_cov_calls", "SELECT count(*) AS occurrences, CAST(coalesce(sum(open), 0) AS BIGINT) AS unresolved FROM (SELECT path, start_byte, end_byte, max(CASE WHEN unresolved_reason IS NOT NULL THEN 1 ELSE 0 END) AS open FROM relations WHERE kind IN ('R', 'A') GROUP BY 1, 2, 3)", "relations")
def _(s, d):
    return index.call_occurrences(L.relations(s, d), ["R", "A"])


_RF = "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS path, 'ANALYZED' AS status FROM lineitem WHERE l_quantity > 30 UNION SELECT 'orphan-' || l_suppkey, 'ANALYZED' FROM lineitem WHERE l_quantity > 49"


@query("q_cov_files_full_outer", f"""WITH rf AS ({_RF}), f AS (SELECT CAST(o_orderkey AS VARCHAR) AS path FROM orders)
    SELECT CASE WHEN f.path IS NULL THEN 'ORPHAN' WHEN rf.path IS NULL THEN 'MISSING' ELSE rf.status END AS status, count(*) AS n FROM f FULL OUTER JOIN rf ON f.path = rf.path GROUP BY 1""")  # fmt: skip
def _(s, d):
    return index.file_coverage(_order_files(s, d), _relation_files(s, d))


def _order_files(s, d):
    return L.table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"))


def _relation_files(s, d):
    li = L.table(s, d, "lineitem")
    own = li.where("l_quantity > 30").select(F.col("l_orderkey").cast("string").alias("path"))
    lost = li.where("l_quantity > 49").select(F.concat(F.lit("orphan-"), "l_suppkey").alias("path"))
    return own.union(lost).distinct().withColumn("status", F.lit("ANALYZED"))


@query("q_cov_inventory", "SELECT count(*) FILTER (WHERE status = 'TEXT') AS readable, CAST(0 AS BIGINT) AS excluded, CAST(0 AS BIGINT) AS unsupported, CAST(sum(byte_length) AS BIGINT) AS bytes FROM file_rows", "file_rows")
def _(s, d):
    return index.inventory_coverage(L.inventory(s, d))


@query("q_external_targets", "SELECT external_target_id AS target_id, count(*) AS uses, count(DISTINCT path) AS files FROM relations WHERE external_target_id IS NOT NULL GROUP BY 1", "relations")
def _(s, d):
    return index.distinct_targets(L.relations(s, d))


@query("q_first_artifact", "SELECT p_name AS binary_name, p_partkey AS artifact_order, p_size AS version FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey, p_size DESC) AS r FROM part) WHERE r = 1")
def _(s, d):
    return index.first_by_artifact(L.table(s, d, "part").select(F.col("p_name").alias("binary_name"), F.col("p_partkey").alias("artifact_order"), F.col("p_size").alias("version")))


# --- documents --------------------------------------------------------------------------------------

_SECT = """WITH RECURSIVE dl AS (SELECT path, owner, content, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS no FROM document_files),
    pos AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY path ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place, max(no) OVER (PARTITION BY path) AS nmax FROM dl),
    hd AS (SELECT path, owner, content, nmax, no, place, regexp_replace(trim(regexp_replace(line, '^ {0,3}#{1,6}', ''), ' ' || chr(9)), '(^|[ ' || chr(9) || ']+)#+$', '') AS title FROM pos WHERE regexp_matches(line, '^ {0,3}#{1,6}([ \\t]|$)')),
    h2 AS (SELECT * FROM hd UNION ALL SELECT path, owner, content, max(nmax), 1, 0, '' FROM pos p WHERE NOT EXISTS (SELECT 1 FROM hd WHERE hd.path = p.path AND hd.no = 1) GROUP BY path, owner, content),
    sec AS (SELECT path, owner, content, title, CAST(no AS INTEGER) AS start_line, CAST(coalesce(lead(no) OVER w - 1, CASE WHEN content LIKE '%' || chr(10) THEN nmax - 1 ELSE nmax END) AS INTEGER) AS end_line, CAST(place AS INTEGER) AS start_char, CAST(coalesce(lead(place) OVER w, length(content)) AS INTEGER) AS end_char FROM h2 WINDOW w AS (PARTITION BY path ORDER BY no))
    """


@query("q_sections", _SECT.replace("WITH RECURSIVE ", "WITH ") + "SELECT path, start_line, end_line, start_char, end_char, title FROM sec", "document_files")
def _(s, d):
    return documents.sections(L.document_files(s, d)).select("path", "start_line", "end_line", "start_char", "end_char", "title")


def _docsearch(name: str, text: str, owner: str | None = None, limit: int = 20) -> None:
    sql = (
        _SECT.replace("WITH RECURSIVE ", "WITH ")
        + f""", hit AS (SELECT *, strpos(substr(content, start_char + 1), '{text}') + start_char AS m FROM sec WHERE contains(content, '{text}') {f"AND owner = '{owner}'" if owner else ''}),
    ok AS (SELECT *, greatest(end_char, m - 1 + {len(text)}) - m + 1 AS n FROM hit WHERE m > start_char AND m <= end_char),
    ahead AS (SELECT path, start_line, substr(title, 1, 160) AS title, substr(content, m, least(n, 240)) AS snippet, n > 240 AS snippet_clipped FROM ok ORDER BY path, start_line LIMIT {limit + 1}),
    z AS (SELECT *, row_number() OVER (ORDER BY path, start_line) AS k, count(*) OVER () > {limit} AS has_more FROM ahead) SELECT path, start_line, title, snippet, snippet_clipped, has_more FROM z WHERE k <= {limit}"""
    )

    @query(name, sql, "document_files")
    def _(s, d):
        return documents.search_documents(L.document_files(s, d), text, owner, limit)


_docsearch("q_search_documents", "the")
_docsearch("q_search_documents_owner", "or", "owner3", 15)


@query("q_list_documents", _has_more("path", 20, "SELECT path, owner, CAST(octet_length(encode(content)) AS BIGINT) AS byte_length FROM document_files WHERE owner = 'owner2' AND path >= 'repositories/owner2/000000007.md'", "path, owner, byte_length"), "document_files")
def _(s, d):
    return documents.list_documents(L.document_files(s, d), "owner2", 20, "repositories/owner2/000000007.md")


@query("q_read_document", _SECT.replace("WITH RECURSIVE ", "WITH ") + "SELECT path, content, start_line, end_line, title, substr(content, start_char + 1, end_char - start_char) AS section_text, CAST(length(substr(content, start_char + 1, end_char - start_char)) + len(regexp_extract_all(substr(content, start_char + 1, end_char - start_char), '[\\x{10000}-\\x{10FFFF}]')) AS INTEGER) AS section_units FROM sec WHERE path = 'repositories/owner3/000000003.md' AND start_line = 1", "document_files")
def _(s, d):
    return documents.read_document(L.document_files(s, d), "repositories/owner3/000000003.md", 1)


@query("q_owner_totals", "SELECT owner, count(*) AS documents, CAST(sum(octet_length(encode(content))) AS BIGINT) AS bytes, arg_max(path, {'n': octet_length(encode(content)), 'p': path}) AS largest FROM document_files GROUP BY owner", "document_files")
def _(s, d):
    return documents.owner_totals(L.document_files(s, d))


@query("q_global_version", "SELECT sha256(string_agg(repository_id || '=' || revision || chr(10), '' ORDER BY repository_id)) AS global_version FROM (" + _CURRENT + ")", "publications")
def _(s, d):
    return documents.global_version(lifecycle.current_pointer(L.publications(s, d)).select(F.col("repository_id").alias("owner"), "revision"))


@query("q_document_changes", """WITH o AS (SELECT path, sha256(content) AS g FROM document_files WHERE owner <> 'owner1'), n AS (SELECT path, sha256(CASE WHEN contains(content, 'then') THEN content || '!' ELSE content END) AS g FROM document_files WHERE owner <> 'owner4')
    SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'ADDED' WHEN n.path IS NULL THEN 'REMOVED' ELSE 'UPDATED' END AS change FROM o FULL OUTER JOIN n ON o.path = n.path WHERE o.g IS DISTINCT FROM n.g""", "document_files")  # fmt: skip
def _(s, d):
    f = L.document_files(s, d)
    old = f.where("owner <> 'owner1'").select("path", F.sha2("content", 256).alias("content_digest"))
    new = f.where("owner <> 'owner4'").select("path", F.sha2(F.when(F.col("content").contains("then"), F.concat("content", F.lit("!"))).otherwise(F.col("content")), 256).alias("content_digest"))
    return documents.changes(old, new)


@query("q_last_good", """WITH a AS (SELECT repository_id AS owner, seq, revision, is_default AS accepted FROM publications), g AS (SELECT owner, arg_max(revision, seq) FILTER (WHERE accepted) AS served, max(seq) FILTER (WHERE accepted) AS ss, max(seq) AS ls FROM a GROUP BY owner)
    SELECT owner, served, CASE WHEN ss IS NULL THEN 'UNAVAILABLE' WHEN ss < ls THEN 'UPDATE_REJECTED' ELSE 'CURRENT' END AS state FROM g""", "publications")  # fmt: skip
def _(s, d):
    return documents.last_good(L.publications(s, d).select(F.col("repository_id").alias("owner"), "seq", "revision", F.col("is_default").alias("accepted")))


@query("q_selection_misses", f"WITH c AS ({_CURRENT}), x AS (SELECT repository_id, revision FROM c WHERE seq % 3 <> 0) SELECT revision, list_sort(list(repository_id)) AS owners FROM x GROUP BY revision", "publications")
def _(s, d):
    current = lifecycle.current_pointer(L.publications(s, d)).withColumnRenamed("repository_id", "owner")
    return documents.selection_misses(current.select("owner", "revision"), current.where(F.col("seq") % 3 == 0).select("owner", "revision"))


# --- budgets and lifecycle --------------------------------------------------------------------------


@query("q_byte_budget_page", """WITH t AS (SELECT path, byte_length, sum(byte_length) OVER (ORDER BY path) AS used_bytes FROM (SELECT path, byte_length FROM file_rows WHERE starts_with(path, 'en/') ORDER BY path LIMIT 100)) SELECT path, byte_length, CAST(used_bytes AS BIGINT) AS used_bytes FROM t WHERE used_bytes <= 60000""", "file_rows")
def _(s, d):
    rows = L.file_rows(s, d).where(F.col("path").startswith("en/")).orderBy("path").limit(100).select("path", "byte_length")
    return byte_budget(rows, ["path"], F.col("byte_length"), 60_000)


@query("q_current_pointer", _CURRENT, "publications")
def _(s, d):
    return lifecycle.current_pointer(L.publications(s, d))


_RETIRED = """WITH def AS (SELECT *, lead(published_at) OVER (PARTITION BY repository_id ORDER BY seq) AS until FROM publications WHERE is_default),
    was AS (SELECT repository_id, revision, max(seq) AS ms FROM def GROUP BY 1, 2), wl AS (SELECT was.repository_id, was.revision, def.until FROM was JOIN def ON def.repository_id = was.repository_id AND def.seq = was.ms),
    nv AS (SELECT repository_id, revision, arg_min(published_at, seq) AS first FROM publications GROUP BY 1, 2),
    ret AS (SELECT nv.repository_id, nv.revision, CASE WHEN wl.repository_id IS NULL THEN first ELSE until END AS retired_at FROM nv LEFT JOIN wl ON wl.repository_id = nv.repository_id AND wl.revision = nv.revision) """


@query("q_retirement", _RETIRED + "SELECT * FROM ret WHERE retired_at IS NOT NULL", "publications")
def _(s, d):
    return lifecycle.retirements(L.publications(s, d))


@query("q_gc_eligible", _RETIRED + "SELECT * FROM ret WHERE retired_at IS NOT NULL AND TIMESTAMP '2024-02-10 00:00:00' >= retired_at + INTERVAL 30 DAY", "publications")
def _(s, d):
    return lifecycle.collectable(lifecycle.retirements(L.publications(s, d)), "2024-02-10 00:00:00")


@query("q_obsolete_generations", f"""WITH g AS (SELECT DISTINCT repository_id, revision, 'g' || CAST(seq % 4 AS VARCHAR) AS generation FROM publications), s AS (SELECT repository_id, revision, 'g' || CAST(max(seq) % 4 AS VARCHAR) AS generation FROM publications GROUP BY 1, 2)
    SELECT * FROM g EXCEPT SELECT * FROM s""", "publications")  # fmt: skip
def _(s, d):
    p = L.publications(s, d)
    name = lambda c: F.concat(F.lit("g"), (c % 4).cast("string"))
    generations = p.select("repository_id", "revision", name(F.col("seq")).alias("generation")).distinct()
    selected = p.groupBy("repository_id", "revision").agg(name(F.max("seq")).alias("generation"))
    return lifecycle.obsolete_generations(generations, selected, p.select("repository_id", "revision").distinct())


_PH = "CASE phase WHEN 'ACCEPTED' THEN 0 WHEN 'RUNNING' THEN 1 ELSE 2 END"


@query("q_job_latest", f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY job_seq DESC, {_PH} DESC, event_id) AS k FROM job_events) SELECT repository_id, job_seq, phase FROM r WHERE k = 1", "job_events")
def _(s, d):
    return lifecycle.latest_jobs(L.job_events(s, d))


@query("q_job_admission", "SELECT CAST(user_id % 40 AS BIGINT) AS request_id, CAST(event_id AS BIGINT) AS seq, CAST(event_id AS BIGINT) * 7 AS job_id, first_value(CAST(event_id AS BIGINT) * 7) OVER w AS admitted_job, row_number() OVER w = 1 AS is_new FROM events WINDOW w AS (PARTITION BY user_id % 40 ORDER BY event_id)")
def _(s, d):
    e = L.table(s, d, "events").select((F.col("user_id") % 40).cast("long").alias("request_id"), F.col("event_id").cast("long").alias("seq"), (F.col("event_id").cast("long") * 7).alias("job_id"))
    return lifecycle.admitted(e)


@query("q_job_recovery", f"""WITH r AS (SELECT repository_id AS job_id, CASE WHEN job_seq % 2 = 0 THEN 'RUNNING' ELSE phase END AS phase FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY job_seq DESC, {_PH} DESC, event_id) AS k FROM job_events) WHERE k = 1)
    SELECT job_id, CASE WHEN phase <> 'RUNNING' THEN phase WHEN job_id IN (SELECT repository_id FROM publications WHERE is_default) THEN 'COMPLETE' ELSE 'FAILED' END AS phase FROM r""", "job_events", "publications")  # fmt: skip
def _(s, d):
    jobs = lifecycle.latest_jobs(L.job_events(s, d)).select(F.col("repository_id").alias("job_id"), F.when(F.col("job_seq") % 2 == 0, "RUNNING").otherwise(F.col("phase")).alias("phase"))
    return lifecycle.recovered(jobs, L.publications(s, d).where("is_default").select(F.col("repository_id").alias("job_id")))


@query("q_managed_bytes", "SELECT CAST(sum(CASE WHEN contains(path, '/') THEN 0 ELSE byte_length + 10 END) AS BIGINT) AS managed_bytes FROM inventory WHERE kind = 'DIRECTORY'", "inventory")
def _(s, d):
    return lifecycle.managed_bytes(L.inventory(s, d).where("kind = 'DIRECTORY'").select("path", (F.col("byte_length") + 10).alias("bytes")))


@query("q_origin_conflicts", "SELECT repository_id, count(DISTINCT origin) AS n FROM (SELECT repository_id, origin FROM registry UNION ALL SELECT repository_id, '7' FROM registry) GROUP BY 1 HAVING count(DISTINCT origin) > 1", "registry")
def _(s, d):
    r = L.registry(s, d).select("repository_id", "origin")
    return lifecycle.origin_conflicts(r.union(r.select("repository_id", F.lit("7"))))


# --- identity and integrity -------------------------------------------------------------------------


@query("q_identity_hash", """SELECT p_partkey, sha256(unhex(lpad(printf('%X', octet_length(encode(p_name))), 8, '0')) || encode(p_name) || unhex(lpad(printf('%X', octet_length(encode(CAST(p_partkey AS VARCHAR)))), 8, '0')) || encode(CAST(p_partkey AS VARCHAR))) AS symbol_id FROM part""")
def _(s, d):
    return L.table(s, d, "part").select("p_partkey", framed_sha256(F.col("p_name"), F.col("p_partkey")).alias("symbol_id"))


@query("q_length_units", "SELECT doc_id, CAST(octet_length(encode(text)) AS INTEGER) AS utf8_bytes, CAST(length(text) AS INTEGER) AS code_points, CAST(length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) AS INTEGER) AS utf16_units FROM documents")
def _(s, d):
    t = F.col("text")
    return L.table(s, d, "documents").select("doc_id", F.octet_length(t).alias("utf8_bytes"), F.char_length(t).alias("code_points"), utf16_length(t).alias("utf16_units"))


@query("q_path_policy", """SELECT page_id, regexp_replace(url, '^https?://', '') AS path, NOT (list_contains(string_split(regexp_replace(url, '^https?://', ''), '/'), '') OR list_contains(string_split(regexp_replace(url, '^https?://', ''), '/'), '..')) AS canonical,
    len(list_filter(string_split(regexp_replace(url, '^https?://', ''), '/'), lambda x: x IN ('target', 'build') OR ends_with(x, '.class'))) > 0 AS excluded FROM pages""")  # fmt: skip
def _(s, d):
    path = F.regexp_replace("url", "^https?://", "")
    return L.table(s, d, "pages").select("page_id", path.alias("path"), paths.is_canonical(path).alias("canonical"), paths.is_excluded(path).alias("excluded"))


@query("q_check_inventory", "SELECT path, 'X' AS fault FROM inventory WHERE false", "inventory")
def _(s, d):
    return checks.inventory_faults(L.inventory(s, d))


@query("q_check_dangling", "SELECT target_symbol_id, relation_id FROM relations r WHERE target_symbol_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM declarations x WHERE x.symbol_id = r.target_symbol_id AND x.kind <> 'PROMO')", "relations", "declarations")
def _(s, d):
    return checks.dangling(L.relations(s, d).select("relation_id", "target_symbol_id"), "target_symbol_id", L.declarations(s, d).where("kind <> 'PROMO'"), "symbol_id")


@query("q_check_relations", "SELECT relation_id, 'REASON' AS fault FROM relations WHERE unresolved_reason IS NOT NULL AND target_symbol_id IS NOT NULL", "relations")
def _(s, d):
    return checks.relation_faults(L.relations(s, d))


@query("q_check_order", "SELECT user_id, event_id, ts FROM (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b >= ts")
def _(s, d):
    return checks.order_faults(L.table(s, d, "events").select("user_id", "event_id", "ts"), "user_id", "event_id", "ts")


@query("q_check_cross_foot", "SELECT CAST(1 AS BIGINT) AS parts, CAST(1 AS BIGINT) AS total WHERE false", "relations")
def _(s, d):
    r = L.relations(s, d)
    return checks.cross_foot(index.coverage_groups(r), r.agg(F.count("*").alias("n")))


@query("q_check_targets", "SELECT external_target_id AS target_id, count(DISTINCT kind) AS n FROM relations WHERE external_target_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT kind) > 1", "relations")
def _(s, d):
    r = L.relations(s, d).where(F.col("external_target_id").isNotNull())
    return checks.target_conflicts(r.select(F.col("external_target_id").alias("target_id"), "kind"))



@query("q_registry_publication", "SELECT 'r' || c_custkey AS repository_id, c_name AS display_name, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN string_split(c_name, '#') END AS keywords FROM customer")
def _(s, d):
    r = L.registry(s, d)
    status = F.when(F.col("review_status").isin("BUILDING", "MACHINERY"), "APPROVED").otherwise("DRAFT")
    return lifecycle.published_registry(r.select("repository_id", "display_name", status.alias("review_status"), F.split("display_name", "#").alias("keywords")))


@query("q_check_identity", "SELECT p_partkey, p_name, sha256(p_name) AS stored FROM part WHERE p_partkey % 50 = 0")
def _(s, d):
    p = L.table(s, d, "part").select("p_partkey", "p_name")
    stored = p.withColumn("stored", F.when(F.col("p_partkey") % 50 == 0, F.sha2("p_name", 256)).otherwise(framed_sha256(F.col("p_name"), F.col("p_partkey"))))
    return checks.identity_faults(stored, "stored", "p_name", "p_partkey")


@query("q_check_digest", "SELECT path FROM file_rows WHERE byte_length % 17 = 3", "file_rows")
def _(s, d):
    f = L.file_rows(s, d, text=True)
    digest = F.sha2(F.when(F.col("byte_length") % 17 == 3, F.concat("text", F.lit("?"))).otherwise(F.col("text")), 256)
    return checks.digest_faults(f.withColumn("content_digest", digest))


# --- rendering -------------------------------------------------------------------------------------


@query("q_render_numbered", """SELECT path, string_agg(CAST(line AS VARCHAR) || chr(9) || replace(text, chr(92), chr(92) || chr(92)), chr(10) ORDER BY line) AS rendered FROM all_lines GROUP BY path""", "all_lines")
def _(s, d):
    return files.numbered_text(L.file_rows(s, d, text=True))
