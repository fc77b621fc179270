"""More registered queries: payloads, scopes, lookups, validation with seeded faults, budgets, jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import paths, payload
from quarrylight.functions.identity import ordered_digest
from quarrylight.functions.text import utf8_prefix
from quarrylight.operators import checks, documents, files, index, lifecycle
from quarrylight.plans.paging import cursor_budget, trimmed
from quarrylight.queries import _CURRENT, _RETIRED, _SECT, query
from quarrylight.sources import logical as L

# --- payloads, scopes, lookups ------------------------------------------------------------------------


@query("q_json_field", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS none FROM events")
def _(s, d):
    return L.table(s, d, "events").select("event_id", payload.field(F.col("props"), "$.k").alias("k"), payload.field(F.col("props"), "$.none").alias("none"))


@query("q_json_without", "SELECT p_partkey, '{\"name\":\"' || p_name || '\",\"kind\":\"' || p_type || '\"}' AS payload FROM part")
def _(s, d):
    p = L.table(s, d, "part").select("p_partkey", F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("signature"), F.col("p_type").alias("kind"))).alias("payload"))
    return p.select("p_partkey", payload.without(F.col("payload"), "name string, signature string, kind string", "signature").alias("payload"))


@query("q_source_roots", "SELECT path, starts_with(path, 'en/src1/') OR starts_with(path, 'de/') AS in_roots, true AS in_all FROM file_rows", "file_rows")
def _(s, d):
    return L.file_rows(s, d).select("path", paths.within_roots(F.col("path"), ["en/src1", "de"]).alias("in_roots"), paths.within_roots(F.col("path"), ["en", ""]).alias("in_all"))


@query("q_guide_hint", "WITH g AS (SELECT split_part(path, '/', 1) AS lang, min(path) AS guide FROM file_rows GROUP BY 1) SELECT path, path = guide AND lang <> 'de' AS guide_hint FROM file_rows JOIN g ON lang = split_part(path, '/', 1)", "file_rows")
def _(s, d):
    f = L.file_rows(s, d).withColumn("lang", F.substring_index("path", "/", 1))
    guides = f.groupBy("lang").agg(F.min("path").alias("guide")).withColumn("state", F.when(F.col("lang") == "de", "MISSING").otherwise("AVAILABLE"))
    return f.join(guides, "lang").select("path", paths.is_guide(F.col("path"), F.col("status"), F.col("guide"), F.col("state")).alias("guide_hint"))


@query("q_inventory_lookup", """WITH w AS (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN lang || '/' || source || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.md' ELSE 'gone/' || doc_id END AS path FROM documents)
    SELECT w.path, byte_length, i.path IS NOT NULL AS found FROM w LEFT JOIN inventory i ON i.path = w.path""", "inventory")  # fmt: skip
def _(s, d):
    docs = L.table(s, d, "documents")
    path = F.concat("lang", F.lit("/"), "source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".md"))
    wanted = docs.select(F.when(F.col("doc_id") % 3 == 0, path).otherwise(F.concat(F.lit("gone/"), F.col("doc_id").cast("string"))).alias("path"))
    return index.lookup(L.inventory(s, d).select("path", "byte_length"), "path", wanted)


@query("q_tracked_matches", """WITH m AS (SELECT path, byte_length FROM file_rows UNION ALL SELECT 'untracked/' || path, byte_length FROM file_rows) SELECT path, byte_length FROM m WHERE path IN (SELECT path FROM inventory WHERE kind = 'FILE' AND status = 'TEXT')""", "inventory")
def _(s, d):
    f = L.file_rows(s, d).select("path", "byte_length")
    return index.tracked(f.unionByName(f.withColumn("path", F.concat(F.lit("untracked/"), "path"))), L.inventory(s, d))


_SPANS = "SELECT CAST(l_orderkey AS VARCHAR) AS path, l_orderkey || ':' || l_linenumber AS id, l_linenumber * 10 AS sb, l_linenumber * 10 + CAST(floor(l_quantity) AS BIGINT) AS eb, l_linenumber AS sl, l_linenumber + CAST(floor(l_quantity / 10) AS BIGINT) AS el FROM lineitem"


@query("q_span_containment", f"WITH x AS ({_SPANS}) SELECT i.id AS inner_id, o.id AS outer_id FROM x i JOIN x o ON i.path = o.path AND o.sb <= i.sb AND i.eb <= o.eb AND o.sl <= i.sl AND i.el <= o.el AND i.id <> o.id")
def _(s, d):
    li = L.table(s, d, "lineitem")
    n, q = F.col("l_linenumber").cast("long"), F.col("l_quantity")
    spans = li.select(F.col("l_orderkey").cast("string").alias("path"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"), (n * 10).alias("start_byte"), (n * 10 + F.floor(q)).alias("end_byte"), n.alias("start_line"), (n + F.floor(q / 10)).alias("end_line"))
    return index.contained(spans.withColumnRenamed("id", "inner_id"), spans.withColumnRenamed("id", "outer_id")).where("inner_id <> outer_id")


@query("q_class_catalogue", "SELECT p_name AS binary_name, p_partkey AS artifact_order, p_size AS version FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey, p_size DESC) AS r FROM part WHERE p_size <= 21) WHERE r = 1")
def _(s, d):
    return index.class_catalogue(L.table(s, d, "part").select(F.col("p_name").alias("binary_name"), F.col("p_partkey").alias("artifact_order"), F.col("p_size").alias("version")))


@query("q_platform_identity", "SELECT sha256(string_agg(p_brand || '=' || n || chr(10), '' ORDER BY p_brand)) AS platform_digest FROM (SELECT p_brand, CAST(count(*) AS VARCHAR) AS n FROM part GROUP BY 1)")
def _(s, d):
    modules = L.table(s, d, "part").groupBy(F.col("p_brand").alias("key")).agg(F.count("*").cast("string").alias("value"))
    return modules.agg(ordered_digest(F.collect_list(F.struct("key", "value"))).alias("platform_digest"))


# --- coverage -----------------------------------------------------------------------------------------


@query("q_cov_status", "SELECT CASE WHEN CAST(right(path, 4)[1] AS INTEGER) % 4 = 0 THEN 'BINARY' ELSE status END AS status, count(*) AS n FROM file_rows GROUP BY 1", "file_rows")
def _(s, d):
    inv = L.inventory(s, d)
    digit = F.substring(F.expr("right(path, 4)"), 1, 1)
    return index.status_counts(inv.withColumn("status", F.when((F.col("kind") == "FILE") & (digit.try_cast("int") % 4 == 0), "BINARY").otherwise(F.col("status"))))


@query("q_cov_syntax", """SELECT count(*) AS files, count(*) FILTER (WHERE o_orderpriority <> '5-LOW') AS java_files, count(*) FILTER (WHERE o_orderpriority <> '5-LOW' AND o_orderstatus = 'F') AS parsed, count(*) FILTER (WHERE o_orderpriority <> '5-LOW' AND o_orderstatus = 'O') AS failed,
    count(*) FILTER (WHERE o_orderpriority <> '5-LOW' AND o_orderstatus = 'P') AS unsupported, CAST(0 AS BIGINT) AS too_large, CAST(sum(o_custkey % 3) AS BIGINT) AS diagnostics FROM orders""")  # fmt: skip
def _(s, d):
    status = F.when(F.col("o_orderstatus") == "F", "PARSED").when(F.col("o_orderstatus") == "O", "PARSE_FAILED").otherwise("UNSUPPORTED")
    return index.syntax_coverage(L.table(s, d, "orders").select((F.col("o_orderpriority") != "5-LOW").alias("java_file"), status.alias("status"), (F.col("o_custkey") % 3).alias("diagnostics")))


@query("q_cov_equality", """WITH c AS (SELECT kind, resolution_state, unresolved_reason, count(*) AS n FROM relations GROUP BY ALL), st AS (SELECT kind, resolution_state, unresolved_reason, n + CASE WHEN kind = 'A' THEN 1 ELSE 0 END AS n FROM c WHERE kind <> 'N')
    SELECT c.kind, c.resolution_state, c.unresolved_reason, coalesce(st.n, 0) AS stored, c.n AS computed FROM c LEFT JOIN st ON st.kind IS NOT DISTINCT FROM c.kind AND st.resolution_state IS NOT DISTINCT FROM c.resolution_state AND st.unresolved_reason IS NOT DISTINCT FROM c.unresolved_reason WHERE coalesce(st.n, 0) <> c.n""", "relations")  # fmt: skip
def _(s, d):
    now = index.coverage_groups(L.relations(s, d))
    stored = now.where("kind <> 'N'").withColumn("n", F.col("n") + F.when(F.col("kind") == "A", 1).otherwise(0))
    return checks.coverage_faults(stored, now, ["kind", "resolution_state", "unresolved_reason"])


@query("q_section_totals", _SECT.replace("WITH RECURSIVE ", "WITH ") + """, z AS (SELECT path, owner, start_line, octet_length(encode(substr(content, start_char + 1, end_char - start_char))) AS bytes FROM sec)
    SELECT owner, path, count(*) AS sections, CAST(sum(bytes) AS BIGINT) AS bytes, arg_max(start_line, {'b': bytes, 'l': -start_line}) AS largest FROM z GROUP BY owner, path""", "document_files")  # fmt: skip
def _(s, d):
    return documents.section_totals(_sections(s, d))


@query("q_owner_budgets", _SECT.replace("WITH RECURSIVE ", "WITH ") + """, z AS (SELECT owner, path, count(*) AS sections, sum(octet_length(encode(substr(content, start_char + 1, end_char - start_char)))) AS bytes FROM sec GROUP BY 1, 2),
    o AS (SELECT owner, count(*) AS documents, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(sections) AS BIGINT) AS sections FROM z GROUP BY 1) SELECT *, CASE WHEN documents > 1000 THEN 'DOCUMENTS' WHEN bytes > 60000 THEN 'BYTES' WHEN sections > 100 THEN 'SECTIONS' END AS over FROM o""", "document_files")  # fmt: skip
def _(s, d):
    return documents.over_budget(documents.section_totals(_sections(s, d)), 1000, 60_000, 100)


def _sections(s, d):
    f = L.document_files(s, d)
    found = documents.sections(f).join(f, "path")
    return found.select("path", "owner", "start_line", F.octet_length(F.expr("substring(content, start_char + 1, end_char - start_char)")).alias("bytes"))


# --- validation with seeded faults --------------------------------------------------------------------


@query("q_check_inventory_seeded", """WITH i AS (SELECT path, kind, key, doc FROM (SELECT path, kind, key, CASE WHEN kind = 'FILE' THEN CAST(left(right(path, 12), 9) AS BIGINT) END AS doc FROM inventory)),
    x AS (SELECT CASE WHEN doc % 50 = 1 THEN 'build/' || path WHEN doc % 50 = 2 THEN path || '/../x' WHEN doc % 50 = 3 THEN 'lost/' || doc ELSE path END AS path, kind, doc FROM i UNION ALL SELECT path, kind, -1 FROM i WHERE doc % 50 = 4)
    SELECT path, 'DUPLICATE' AS fault FROM x WHERE kind = 'FILE' GROUP BY path HAVING count(*) > 1 UNION ALL SELECT path, 'EXCLUDED' FROM x WHERE doc % 50 = 1 UNION ALL SELECT path, 'PATH' FROM x WHERE doc % 50 = 2
    UNION ALL SELECT path, 'ORPHAN' FROM x WHERE doc % 50 IN (1, 2, 3)""", "inventory")  # fmt: skip
def _(s, d):
    inv = L.inventory(s, d).withColumn("doc", F.when(F.col("kind") == "FILE", F.expr("left(right(path, 12), 9)").cast("long")))
    m = F.col("doc") % 50
    path = F.when(m == 1, F.concat(F.lit("build/"), "path")).when(m == 2, F.concat("path", F.lit("/../x"))).when(m == 3, F.concat(F.lit("lost/"), F.col("doc").cast("string"))).otherwise(F.col("path"))
    seeded = inv.where(F.coalesce(m == 4, F.lit(False))).unionByName(inv.withColumn("path", path))
    return checks.inventory_faults(seeded.withColumn("key", paths.inventory_key(F.col("path"), F.col("kind"))))


@query("q_check_cross_foot_seeded", "SELECT CAST((SELECT count(*) FROM relations) + 3 AS BIGINT) AS parts, (SELECT count(*) FROM relations) AS total", "relations")
def _(s, d):
    r = L.relations(s, d)
    groups = index.coverage_groups(r)
    seeded = groups.withColumn("n", F.col("n") + F.when((F.col("kind") == "A") & (F.col("resolution_state") == "F") & F.col("unresolved_reason").isNull(), 3).otherwise(0))
    return checks.cross_foot(seeded, r.agg(F.count("*").alias("n")))


@query("q_check_payload", "SELECT p_partkey, 'name' AS \"column\" FROM part WHERE p_partkey % 37 = 0 UNION ALL SELECT p_partkey, 'size' FROM part WHERE p_partkey % 41 = 0")
def _(s, d):
    p = L.table(s, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.to_json(F.struct(F.col("p_name").alias("name"), F.struct(F.col("p_size").alias("size")).alias("range"))).alias("payload"))
    seeded = p.withColumn("name", F.when(F.col("p_partkey") % 37 == 0, "other").otherwise(F.col("name"))).withColumn("size", F.when(F.col("p_partkey") % 41 == 0, -1).otherwise(F.col("size")))
    return checks.payload_faults(seeded, "p_partkey", "payload", {"name": "$.name", "size": "$.range.size"})


@query("q_check_spans", """WITH f AS (SELECT *, octet_length(encode(text)) AS n, CAST(left(right(path, 12), 9) AS BIGINT) AS doc FROM file_rows),
    b AS (SELECT *, list_contains(list_transform(range(0, 41), lambda k: octet_length(encode(substr(text, 1, CAST(k AS BIGINT))))), 12) AND list_contains(list_transform(range(0, 41), lambda k: octet_length(encode(substr(text, 1, CAST(k AS BIGINT))))), 30) AS fine,
      1 + len(string_split(substr(text, 1, (SELECT max(k) FROM range(0, 13) r(k) WHERE octet_length(encode(substr(text, 1, CAST(k AS BIGINT)))) <= 12)), chr(10))) - 1 AS line FROM f)
    SELECT path AS span_id, CASE WHEN doc % 11 = 0 OR n < 30 THEN 'RANGE' WHEN NOT fine THEN 'BOUNDARY' WHEN line + CASE WHEN doc % 7 = 0 THEN 1 ELSE 0 END <> line THEN 'LINE' END AS fault FROM b WHERE doc % 11 = 0 OR n < 30 OR NOT fine OR doc % 7 = 0""", "file_rows")  # fmt: skip
def _(s, d):
    f = L.file_rows(s, d, text=True)
    doc = F.expr("left(right(path, 12), 9)").cast("long")
    prefix = utf8_prefix(F.col("text"), 12)
    line = F.size(F.split(prefix, "\n", -1)) + F.when(doc % 7 == 0, 1).otherwise(0)
    spans = f.select(F.col("path").alias("span_id"), "path", F.lit(12).alias("start_byte"), F.when(doc % 11 == 0, 10_000_000).otherwise(30).alias("end_byte"), line.alias("start_line"))
    return checks.span_faults(f, spans)


@query("q_check_provenance", """SELECT CAST(p_partkey AS VARCHAR) AS target_id, CASE WHEN p_size < 10 THEN 'PLATFORM' ELSE 'ARTIFACT' END AS fault FROM part
    WHERE CASE WHEN p_size < 10 THEN p_brand <> 'Brand#12' ELSE p_brand = 'Brand#13' END""")  # fmt: skip
def _(s, d):
    p = L.table(s, d, "part")
    targets = p.select(F.col("p_partkey").cast("string").alias("target_id"), F.when(F.col("p_size") < 10, F.col("p_type")).alias("module"), F.col("p_brand").alias("artifact_id"), F.sha2("p_brand", 256).alias("artifact_digest"))
    approved = p.where("p_brand <> 'Brand#13'").select(F.col("p_brand").alias("artifact_id"), F.sha2("p_brand", 256).alias("artifact_digest"))
    import hashlib

    return checks.provenance_faults(targets, approved, "Brand#12", hashlib.sha256(b"Brand#12").hexdigest())


@query("q_admission_faults", """WITH f AS (SELECT *, CAST(left(right(path, 12), 9) AS BIGINT) AS c FROM document_files)
    SELECT CASE WHEN c % 5 = 1 THEN 'other/' || path ELSE path END AS path, CASE c % 5 WHEN 1 THEN 'PATH' WHEN 2 THEN 'DIGEST' WHEN 3 THEN 'CONTROL' ELSE 'REVIEW' END AS fault FROM f WHERE c % 5 IN (1, 2, 3, 4)""", "document_files")  # fmt: skip
def _(s, d):
    f = L.document_files(s, d).withColumn("c", F.expr("left(right(path, 12), 9)").cast("long") % 5)
    f = f.withColumn("content", F.when(F.col("c") == 3, F.concat("content", F.lit("\x07"))).otherwise(F.col("content")))
    digest = F.when(F.col("c") == 2, F.sha2(F.lit("?"), 256)).otherwise(F.sha2("content", 256))
    rows = f.withColumn("content_digest", digest).withColumn("path", F.when(F.col("c") == 1, F.concat(F.lit("other/"), "path")).otherwise(F.col("path")))
    return documents.admission_faults(rows.withColumns({"review_status": F.when(F.col("c") == 4, "APPROVED").otherwise("DRAFT"), "review_reference": F.lit(None).cast("string")}))


@query("q_origin_credentials", "SELECT page_id, page_id % 3 = 0 AS refused FROM pages")
def _(s, d):
    p = L.table(s, d, "pages")
    url = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "^(https?://)", "$1user:word@")).otherwise(F.concat("url", F.lit("?mail=a@b")))
    return p.select("page_id", paths.has_credentials(url).alias("refused"))


# --- views, budgets, jobs -----------------------------------------------------------------------------


@query("q_view_versions", f"WITH c AS ({_CURRENT}) SELECT repository_id AS owner, revision AS version FROM c UNION ALL SELECT NULL, sha256(string_agg(repository_id || '=' || revision || chr(10), '' ORDER BY repository_id)) FROM c", "publications")
def _(s, d):
    return documents.view_versions(lifecycle.current_pointer(L.publications(s, d)).select(F.col("repository_id").alias("owner"), "revision"))


@query("q_operation_fingerprint", "SELECT owner AS operation_id, sha256(string_agg(path || '=UPDATED:' || sha256(content) || chr(10), '' ORDER BY path)) AS fingerprint FROM document_files GROUP BY owner", "document_files")
def _(s, d):
    f = L.document_files(s, d)
    return documents.operation_fingerprint(f.select(F.col("owner").alias("operation_id"), "path", F.lit("UPDATED").alias("change"), F.sha2("content", 256).alias("content_digest")))


_PAGE = "SELECT path, byte_length, sum(byte_length) OVER (ORDER BY path) AS used_bytes, lead(1) OVER (ORDER BY path) IS NULL AS is_last FROM (SELECT path, byte_length FROM file_rows WHERE starts_with(path, 'en/') ORDER BY path LIMIT 100)"


def _first_files(s, d):
    return L.file_rows(s, d).where(F.col("path").startswith("en/")).orderBy("path").limit(100).select("path", "byte_length")


@query("q_cursor_budget", f"""WITH t AS ({_PAGE}), o AS (SELECT *, max(CASE WHEN used_bytes + CASE WHEN is_last THEN 0 ELSE 500 END > 60000 THEN 1 ELSE 0 END) OVER (ORDER BY path) AS out_ FROM t)
    SELECT path, byte_length, CAST(used_bytes AS BIGINT) AS used_bytes, NOT bool_or(is_last) OVER () AS has_more FROM o WHERE out_ = 0""", "file_rows")  # fmt: skip
def _(s, d):
    return cursor_budget(_first_files(s, d), ["path"], F.col("byte_length"), 60_000, 500)


@query("q_trimmed_page", f"WITH t AS ({_PAGE}) SELECT path, byte_length, CAST(used_bytes AS BIGINT) AS used_bytes FROM t WHERE used_bytes <= 58976", "file_rows")
def _(s, d):
    return trimmed(_first_files(s, d), ["path"], F.col("byte_length"), 1024, 60_000)


@query("q_one_active_job", """WITH e AS (SELECT 'r' || user_id AS repository_id, CAST(event_id AS BIGINT) AS seq, event_type <> 'error' AS req FROM events), x AS (SELECT *, count(*) FILTER (WHERE NOT req) OVER (PARTITION BY repository_id ORDER BY seq) AS ended FROM e),
    n AS (SELECT *, row_number() OVER (PARTITION BY repository_id, ended, req ORDER BY seq) AS k FROM x) SELECT repository_id, seq, k = 1 AS admitted FROM n WHERE req""")  # fmt: skip
def _(s, d):
    e = L.table(s, d, "events")
    return lifecycle.one_active(e.select(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("repository_id"), F.col("event_id").cast("long").alias("seq"), (F.col("event_type") != "error").alias("is_request")))


@query("q_dispatch_order", "SELECT CAST(event_id AS BIGINT) AS job_id, kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY ts, event_id) AS INTEGER) AS turn FROM (SELECT *, CASE WHEN event_type = 'view' THEN 'SOURCE' ELSE 'INDEX' END AS kind FROM events)")
def _(s, d):
    e = L.table(s, d, "events")
    return lifecycle.dispatch_order(e.select(F.col("event_id").cast("long").alias("job_id"), F.when(F.col("event_type") == "view", "SOURCE").otherwise("INDEX").alias("kind"), F.col("ts").alias("seq")))


@query("q_index_requests", f"""WITH c AS ({_CURRENT}), r AS (SELECT seq AS request_id, repository_id, revision FROM publications)
    SELECT r.*, CASE WHEN c.revision IS NULL THEN 'SOURCE_NOT_READY' WHEN c.revision <> r.revision THEN 'REVISION_NOT_CURRENT' ELSE 'ACCEPTED' END AS outcome FROM r LEFT JOIN c ON c.repository_id = r.repository_id""", "publications")  # fmt: skip
def _(s, d):
    p = L.publications(s, d)
    return lifecycle.index_requests(p.select(F.col("seq").alias("request_id"), "repository_id", "revision"), lifecycle.current_pointer(p))


@query("q_get_job", "SELECT repository_id, CAST(event_id AS BIGINT) AS job_id, CAST(event_id % 40 AS BIGINT) AS request_id, phase FROM job_events WHERE repository_id = (SELECT repository_id FROM job_events WHERE event_id = 77) AND event_id = 77", "job_events")
def _(s, d):
    jobs = L.job_events(s, d).select("repository_id", F.col("event_id").alias("job_id"), (F.col("event_id") % 40).alias("request_id"), "phase")
    return lifecycle.get_job(jobs, jobs.where("job_id = 77").first()["repository_id"], job_id=77)


@query("q_gc_unleased", _RETIRED + """, ok AS (SELECT * FROM ret WHERE retired_at IS NOT NULL AND TIMESTAMP '2024-02-10 00:00:00' >= retired_at + INTERVAL 30 DAY), held AS (SELECT DISTINCT repository_id, revision FROM publications WHERE seq % 3 = 0)
    SELECT ok.* FROM ok WHERE NOT EXISTS (SELECT 1 FROM held WHERE held.repository_id = ok.repository_id AND held.revision = ok.revision)""", "publications")  # fmt: skip
def _(s, d):
    p = L.publications(s, d)
    leases = p.select("repository_id", "revision", F.when(F.col("seq") % 3 == 0, F.lit("2024-03-01 00:00:00")).otherwise("2024-01-01 00:00:00").cast("timestamp").alias("until"))
    return lifecycle.unleased(lifecycle.collectable(lifecycle.retirements(p), "2024-02-10 00:00:00"), leases, "2024-02-10 00:00:00")


@query("q_capacity", """WITH RECURSIVE e AS (SELECT 'r' || user_id AS repository_id, CAST(event_id AS BIGINT) AS seq, event_id % 100 AS bytes, event_id * 7 % 1000 AS free, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    f AS (SELECT repository_id, seq, n, CASE WHEN bytes <= 250 AND free - bytes >= 20 THEN bytes ELSE 0 END AS used, bytes <= 250 AND free - bytes >= 20 AS admitted FROM e WHERE n = 1
      UNION ALL SELECT e.repository_id, e.seq, e.n, f.used + CASE WHEN f.used + e.bytes <= 250 AND e.free - e.bytes >= 20 THEN e.bytes ELSE 0 END, f.used + e.bytes <= 250 AND e.free - e.bytes >= 20 FROM f JOIN e ON e.repository_id = f.repository_id AND e.n = f.n + 1)
    SELECT repository_id, seq, CAST(used AS BIGINT) AS used, admitted FROM f""")  # fmt: skip
def _(s, d):
    e = L.table(s, d, "events")
    return lifecycle.capacity_refusals(e.select(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("repository_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 100).alias("bytes"), (F.col("event_id") * 7 % 1000).alias("free")), 250, 20)


@query("q_registry_faults", """WITH r AS (SELECT 'r' || c_custkey AS repository_id, octet_length(encode('{"repository_id":"r' || c_custkey || '","display_name":"' || c_name || CASE WHEN c_custkey % 100 = 0 THEN repeat('x', 2048) ELSE '' END || '"}')) AS bytes FROM customer)
    SELECT repository_id, CAST(bytes AS BIGINT) AS bytes, CASE WHEN bytes > 2048 THEN 'DESCRIPTOR' WHEN (SELECT sum(bytes) FROM r) > 100000 THEN 'REGISTRY' END AS fault FROM r""")  # fmt: skip
def _(s, d):
    c = L.table(s, d, "customer")
    name = F.concat("c_name", F.when(F.col("c_custkey") % 100 == 0, F.repeat(F.lit("x"), 2048)).otherwise(""))
    return lifecycle.registry_faults(c.select(F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("repository_id"), name.alias("display_name")), total=100_000)


@query("q_check_facts", """WITH x AS (SELECT l_orderkey || '-' || l_linenumber AS relation_id, l_returnflag = 'R' AS ev, l_returnflag = 'R' AND l_linenumber <> 2 OR l_returnflag <> 'R' AND l_suppkey % 50 = 0 AS fw, CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_linenumber = 3 THEN 'UNRESOLVED' ELSE 'CANDIDATE' END WHEN l_linestatus = 'O' THEN 'UNRESOLVED' ELSE 'STATIC_RESOLVED' END AS st,
    l_linestatus = 'O' AND l_returnflag <> 'R' AND l_linenumber <> 4 AS re FROM lineitem), f AS (SELECT relation_id, CASE WHEN ev <> fw THEN 'FRAMEWORK' WHEN fw <> (st = 'CANDIDATE') THEN 'CANDIDATE' WHEN (st = 'UNRESOLVED') <> re THEN 'REASON' END AS fault FROM x) SELECT * FROM f WHERE fault IS NOT NULL""")  # fmt: skip
def _(s, d):
    li = L.table(s, d, "lineitem")
    ev, n, open_ = F.col("l_returnflag") == "R", F.col("l_linenumber"), F.col("l_linestatus") == "O"
    rows = li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("relation_id"), F.when(ev, "HTTP_EVIDENCE").otherwise("CALL").alias("kind"), F.when(ev & (n != 2) | ~ev & (F.col("l_suppkey") % 50 == 0), F.lit("rule")).alias("framework"),
        F.when(ev, F.when(n == 3, "UNRESOLVED").otherwise("CANDIDATE")).when(open_, "UNRESOLVED").otherwise("STATIC_RESOLVED").alias("resolution_state"), F.when(open_ & ~ev & (n != 4), F.lit("MISSING_TYPE")).alias("unresolved_reason"))
    return checks.fact_faults(rows, ("HTTP_EVIDENCE", "EVENT_EVIDENCE", "DB_EVIDENCE"))


@query("q_lines_all", "SELECT path, CAST(line AS INTEGER) AS line, text FROM all_lines", "all_lines")
def _(s, d):
    return files.line_table(L.file_rows(s, d, text=True))
