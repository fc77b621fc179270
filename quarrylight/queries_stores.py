"""Stored order, counters of writes, the document sink and catalogues, over tables derived from the driver's."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.model import QueryError
from quarrylight.operators import checks, documents, reading
from quarrylight.queries import _LB, _PAGE1, query
from quarrylight.sources import catalogues, frozen
from quarrylight.sources import logical as L
from quarrylight.sources.tables import shared_dir, written
from quarrylight.sources.trees import Generations
from quarrylight.streaming.sink import DocumentSink


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- the order of a stored inventory ----------------------------------------------------------------------

_STORED = "CASE WHEN key LIKE '%7.md' THEN 'zz/' || key WHEN key LIKE '%33.md' THEN '!' || key ELSE key END"


def stored_inventory(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the inventory in key order, in which some keys were changed."""
    inv, folder = L.inventory(spark, sf_dir), _folder(spark, "inventory")
    stored = F.when(F.col("key").endswith("7.md"), F.concat(F.lit("zz/"), "key")).when(F.col("key").endswith("33.md"), F.concat(F.lit("!"), "key")).otherwise(F.col("key"))
    inv.orderBy("key").select(stored.alias("key"), "kind", "byte_length").write.parquet(folder)
    return folder


@query("q_check_order_stored", f"WITH s AS (SELECT {_STORED} AS k, lag({_STORED}) OVER (ORDER BY key) AS before FROM inventory) SELECT before, k AS key FROM s WHERE before >= k", "inventory")
def _(s, d):
    return checks.stored_order_faults(written(checks.stored_segments(s, stored_inventory(s, d), "key"), "segments"))


@query("q_check_order_to_end", "SELECT count(*) AS n, min(key) AS first, max(key) AS last FROM inventory", "inventory")
def _(s, d):
    folder = _folder(s, "inventory")
    L.inventory(s, d).orderBy("key").write.parquet(folder)
    ends = checks.stored_segments(s, folder, "key").where(F.col("kind") == "SEGMENT")
    return ends.agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


# --- counters while writing ---------------------------------------------------------------------------------


def written_counters(spark: SparkSession, sf_dir: str, most: dict[str, int] | None = None) -> tuple[Generations, dict[str, int]]:
    """Relations, their external targets and call sites, written as a generation with running counters."""
    store = Generations(spark, _folder(spark, "generations"))
    rows = L.relations(spark, sf_dir)
    targets = rows.where(F.col("external_target_id").isNotNull()).select(F.col("external_target_id").alias("target_id")).distinct()
    sites = rows.where(F.col("kind") == "A").groupBy("path", "start_byte", "end_byte").agg(F.max(F.col("unresolved_reason").isNotNull().cast("int")).alias("open"))
    one = F.count(F.lit(1))
    counters = {
        "relations": {"facts": one, "resolved": F.count_if(F.col("target_symbol_id").isNotNull()), "unresolved": F.count_if(F.col("unresolved_reason").isNotNull()), "bytes": F.sum(F.col("end_byte") - F.col("start_byte"))},
        "targets": {"distinct": one},
        "sites": {"distinct": one, "open": F.sum("open").cast("long")},
    }
    found = store.write_counted({"relations": rows, "targets": targets, "sites": sites}, "g1", counters, most, {"relations": ["path", "start_byte"]})
    store.publish("r1", "g1", 0)
    return store, found


_COUNTERS = """r AS (SELECT 'relations.facts' AS counter, count(*) AS n FROM relations UNION ALL SELECT 'relations.resolved', count(target_symbol_id) FROM relations UNION ALL SELECT 'relations.unresolved', count(unresolved_reason) FROM relations
    UNION ALL SELECT 'relations.bytes', CAST(sum(end_byte - start_byte) AS BIGINT) FROM relations UNION ALL SELECT 'targets.distinct', count(DISTINCT external_target_id) FROM relations
    UNION ALL SELECT 'sites.distinct', count(DISTINCT (path, start_byte, end_byte)) FROM relations WHERE kind = 'A' UNION ALL SELECT 'sites.open', count(DISTINCT (path, start_byte, end_byte)) FROM relations WHERE kind = 'A' AND unresolved_reason IS NOT NULL)"""


@query("q_write_counters", f"WITH {_COUNTERS} SELECT counter, n, n AS stored FROM r", "relations")
def _(s, d):
    store, found = written_counters(s, d)
    rows = store.read("r1", "relations")
    stored = {
        "relations.facts": F.count(F.lit(1)), "relations.resolved": F.count("target_symbol_id"), "relations.unresolved": F.count("unresolved_reason"), "relations.bytes": F.sum(F.col("end_byte") - F.col("start_byte"))}
    again = rows.agg(*(c.alias(k) for k, c in stored.items()))
    again = again.select(F.explode(F.map_from_arrays(F.array(*(F.lit(k) for k in stored)), F.array(*(F.col(f"`{k}`") for k in stored)))).alias("counter", "stored"))
    for name, open_ in (("targets", None), ("sites", "open")):
        t = store.read("r1", name)
        again = again.unionByName(t.agg(F.count(F.lit(1)).alias("stored")).select(F.lit(f"{name}.distinct").alias("counter"), "stored"))
        if open_:
            again = again.unionByName(t.agg(F.sum(open_).alias("stored")).select(F.lit(f"{name}.open").alias("counter"), "stored"))
    told = s.createDataFrame(sorted(found.items()), "counter string, n long")
    return told.join(again, "counter").select("counter", "n", "stored")


@query("q_write_refused", f"WITH {_COUNTERS} SELECT n > 100 AS refused, CASE WHEN n > 100 THEN 0 ELSE 1 END AS version FROM r WHERE counter = 'targets.distinct'", "relations")
def _(s, d):
    store, version, refused = Generations(s, _folder(s, "refused")), 0, False
    targets = L.relations(s, d).where(F.col("external_target_id").isNotNull()).select("external_target_id").distinct()
    try:
        store.write_counted({"targets": targets}, "g1", {"targets": {"distinct": F.count(F.lit(1))}}, {"targets.distinct": 100})
        version = store.publish("r1", "g1", 0)
    except QueryError:
        refused = True
    return L.table(s, d, "region").limit(1).select(F.lit(refused).alias("refused"), F.lit(version).alias("version"))


# --- the document sink --------------------------------------------------------------------------------------


def operations(spark: SparkSession, sf_dir: str, part: int) -> DataFrame:
    """Changes of one batch: the documents of a third of the ids by source, and in the second batch removals of the first."""
    d = L.table(spark, sf_dir, "documents")
    path = F.concat(F.lit("repositories/"), "source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".md"))
    change = F.when(F.lit(part == 1) & (F.col("doc_id") % 3 == 0), "REMOVE").otherwise("UPSERT")
    own = d.where((F.col("doc_id") % 3 == part) | (F.lit(part == 1) & (F.col("doc_id") % 6 == 0)))
    return own.select(F.concat(F.lit(f"b{part}-"), "source").alias("operation_id"), F.col("doc_id").alias("seq"), F.col("source").alias("owner"), path.alias("path"), change.alias("change"), F.when(change == "UPSERT", F.coalesce("text", F.lit(""))).alias("content"))


def filled_sink(spark: SparkSession, sf_dir: str) -> DocumentSink:
    """Three batches, a batch that is run again, a replay under a new number and one that says something else under an old name."""
    sink = DocumentSink(spark, _folder(spark, "documents"))
    for batch, part in enumerate((0, 1, 2)):
        sink.apply(operations(spark, sf_dir, part), batch)
    sink.apply(operations(spark, sf_dir, 2), 2)
    sink.apply(operations(spark, sf_dir, 0), 3)
    sink.apply(operations(spark, sf_dir, 2).withColumn("content", F.lit("changed")), 4)
    return sink


_PATH = "'repositories/' || source || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.md'"


@query("q_sink_documents", f"SELECT source AS owner, {_PATH} AS path, sha256(coalesce(text, '')) AS content_digest, 'b' || (doc_id % 3) || '-' || source AS operation_id FROM documents WHERE doc_id % 6 <> 0")
def _(s, d):
    return filled_sink(s, d).documents().select("owner", "path", "content_digest", "operation_id")


@query("q_sink_ledger", """WITH o AS (SELECT DISTINCT 'b' || (doc_id % 3) || '-' || source AS operation_id, doc_id % 3 AS part FROM documents UNION SELECT 'b1-' || source, 1 FROM documents WHERE doc_id % 6 = 0)
    SELECT operation_id, 'APPLIED' AS outcome, CAST(part AS BIGINT) AS batch FROM o UNION ALL SELECT operation_id, 'REPLAYED', 3 FROM o WHERE part = 0 UNION ALL SELECT operation_id, 'CONFLICT', 4 FROM o WHERE part = 2""")
def _(s, d):
    return filled_sink(s, d).ledger().select("operation_id", "outcome", "batch")


# --- catalogues ---------------------------------------------------------------------------------------------

_OWNER = "lower(source)"
_ROWS = f"""d AS (SELECT doc_id, doc_id // 100 AS c, coalesce(text, '') AS text, 'repositories/' || {_OWNER} || '/' || CASE WHEN doc_id % 100 IN (11, 12) THEN 'twin' ELSE lpad(CAST(doc_id AS VARCHAR), 9, '0') END || '.md' AS path FROM documents),
  n AS (SELECT c, path, count(*) AS n FROM d WHERE doc_id % 100 NOT IN (21, 22, 23, 24, 25, 26, 27, 28) GROUP BY ALL)"""


def raw_catalogues(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(catalogue, body) of a hundred documents each, with seeded faults, and (path, content)."""
    k = F.col("doc_id") % 100
    d = L.table(spark, sf_dir, "documents").select("doc_id", F.lower("source").alias("owner"), F.coalesce("text", F.lit("")).alias("content"))
    file = F.when(k.isin(11, 12), "twin").otherwise(F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    d = d.withColumn("path", F.concat(F.lit("repositories/"), "owner", F.lit("/"), file, F.lit(".md")))
    digest = F.when(k == 21, F.lit("ABC")).when(k == 31, F.sha2(F.lit("another text"), 256)).otherwise(F.sha2("content", 256))
    sha = F.sha1(F.col("doc_id").cast("string"))
    context = lambda name, revision: F.struct(name.alias("repositoryId"), revision.alias("revision"))
    other = F.when(k == 22, F.col("owner")).otherwise(F.lit("other"))
    row = F.struct(
        F.when(k == 23, F.lit("elsewhere/x.md")).otherwise(F.col("path")).alias("path"), digest.alias("contentDigest"),
        context(F.col("owner"), F.when(k == 24, F.lit("main")).otherwise(sha)).alias("primaryContext"), F.array(context(other, sha)).alias("relatedContexts"),
        F.when(k == 25, F.lit("MAYBE")).when(k % 2 == 0, F.lit("APPROVED")).otherwise(F.lit("DRAFT")).alias("reviewStatus"), F.when((k % 2 == 0) & (k != 26), F.lit("ticket")).alias("reviewReference"))
    text = F.to_json(row)
    text = F.when(k == 27, F.replace(text, F.lit('{"path"'), F.lit('{"extra":1,"path"'))).when(k == 28, F.lit("7")).otherwise(text)
    each = d.select(F.floor(F.col("doc_id") / 100).cast("long").alias("catalogue"), "doc_id", text.alias("text"))
    # a hundred rows at most each: ids fall into catalogues by their hundreds
    body = each.groupBy("catalogue").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), ",").alias("rows"))
    c = F.col("catalogue")
    version = F.when(c % 9 == 4, F.lit("2")).otherwise(F.lit("1"))
    head = F.concat(F.lit('{"formatVersion":'), version, F.lit(',"documentRepositoryId":"'), F.when(c % 9 == 5, F.lit("foreign")).otherwise(F.lit("main")), F.lit('","documents":['), "rows", F.when(c % 9 == 6, F.lit("")).when(c % 9 == 7, F.lit('],"more":0}')).otherwise(F.lit("]}")))
    return body.select("catalogue", head.alias("body")), d.where(k != 32).select("path", "content").where(~k.isin(11, 12))


@query("q_catalogue_rows", f"""WITH {_ROWS}, f AS (SELECT d.*, CASE doc_id % 100 WHEN 28 THEN 'MALFORMED' WHEN 27 THEN 'FIELDS' WHEN 24 THEN 'CONTEXT' WHEN 23 THEN 'PATH' WHEN 21 THEN 'DIGEST_FORM' WHEN 22 THEN 'RELATED' WHEN 25 THEN 'REVIEW' WHEN 26 THEN 'REVIEW' ELSE
      CASE WHEN n.n > 1 THEN 'DUPLICATE' WHEN doc_id % 100 IN (11, 12, 32) THEN 'MISSING' WHEN strlen(text) > 65536 THEN 'CAPACITY' WHEN text = '' THEN 'EMPTY' WHEN doc_id % 100 = 31 THEN 'DIGEST' WHEN contains(text, chr(0)) THEN 'CONTROL' END END AS fault
      FROM d LEFT JOIN n ON n.c = d.c AND n.path = d.path WHERE d.c % 9 NOT IN (4, 5, 6, 7))
    SELECT CAST(c AS BIGINT) AS catalogue, coalesce(fault, 'SERVED') AS outcome, count(*) AS n, CAST(coalesce(sum(CASE WHEN fault IS NULL THEN strlen(text) END), 0) AS BIGINT) AS bytes FROM f GROUP BY ALL
    UNION ALL SELECT DISTINCT CAST(c AS BIGINT), CASE c % 9 WHEN 4 THEN 'VERSION' WHEN 5 THEN 'REPOSITORY' WHEN 6 THEN 'MALFORMED' ELSE 'FIELDS' END, 1, 0 FROM d WHERE c % 9 IN (4, 5, 6, 7)""")  # fmt: skip
def _(s, d):
    raw, blobs = raw_catalogues(s, d)
    rows = catalogues.load(written(raw, "catalogues"), blobs, "main")
    return rows.groupBy("catalogue", F.coalesce("fault", F.lit("SERVED")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("long").alias("bytes"))


@query("q_catalogue_documents", f"""WITH {_ROWS} SELECT d.path, CAST(strlen(text) AS BIGINT) AS byte_length, sha1(CAST(doc_id AS VARCHAR)) AS revision, doc_id % 2 = 0 AS approved FROM d JOIN n ON n.c = d.c AND n.path = d.path
    WHERE d.c % 9 NOT IN (4, 5, 6, 7) AND n.n = 1 AND doc_id % 100 NOT IN (11, 12, 21, 22, 23, 24, 25, 26, 27, 28, 31, 32) AND strlen(text) BETWEEN 1 AND 65536 AND NOT contains(text, chr(0))""")
def _(s, d):
    raw, blobs = raw_catalogues(s, d)
    rows = catalogues.load(written(raw, "catalogues"), blobs, "main").where(F.col("content").isNotNull())
    return rows.select("path", F.octet_length("content").cast("long").alias("byte_length"), "revision", (F.col("review_status") == "APPROVED").alias("approved"))


@query("q_section_faults", "SELECT path, 'SECTIONS' AS fault FROM (SELECT path, coalesce(text, '') AS text FROM file_rows) WHERE len(string_split(text, chr(10))) > 256", "file_rows")
def _(s, d):
    lined = L.file_rows(s, d, text=True).select("path", F.regexp_replace(F.coalesce("text", F.lit("")), "(?m)^.*$", "## x").alias("content"))
    return documents.section_faults(lined)


# --- names, nesting and whole revisions ---------------------------------------------------------------------

_FILES = "f AS (SELECT doc_id, 'f' || doc_id AS path, coalesce(text, '') AS text FROM documents)"


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, text): each document behind a line that names it with an escape."""
    d = L.table(spark, sf_dir, "documents")
    text = F.concat(F.lit("class \\u0044oc"), F.col("doc_id").cast("string"), F.lit("é {\n"), F.coalesce("text", F.lit("")), F.lit("\n}\n"))
    return d.select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), text.alias("text"))


@query("q_check_names", f"WITH {_FILES} SELECT path AS span_id, CASE WHEN doc_id % 19 = 2 THEN 'RANGE' WHEN doc_id % 19 = 3 THEN 'BOUNDARY' WHEN doc_id % 19 = 4 THEN 'LINE' ELSE 'NAME' END AS fault FROM f WHERE doc_id % 19 IN (2, 3, 4, 5, 6)")
def _(s, d):
    f, k = source_files(s, d), F.col("doc_id") % 19
    digits = F.length(F.col("doc_id").cast("string"))
    name = F.concat(F.when(k == 5, F.lit("doc")).otherwise(F.lit("Doc")), F.col("doc_id").cast("string"), F.lit("é"))
    spans = f.select(
        F.col("path").alias("span_id"), "path", F.lit(0).alias("start_byte"), F.when(k == 2, 1 << 40).when(k == 3, 15 + digits).otherwise(F.octet_length("text")).alias("end_byte"), F.when(k == 4, 2).otherwise(1).alias("start_line"),
        name.alias("name"), F.lit(6).alias("name_start_byte"), (16 + digits - F.when(k == 6, 2).otherwise(0)).alias("name_end_byte"))
    return checks.span_faults(f, spans)


@query("q_check_nesting", """WITH p AS (SELECT p_partkey AS k FROM part), d AS (SELECT k, CASE WHEN k % 29 = 3 THEN -1 ELSE k // 3 END AS up FROM p WHERE k > 0),
    f AS (SELECT 's' || k AS symbol_id, CASE WHEN up NOT IN (SELECT k FROM p) THEN 'PARENT' WHEN (k % 31 = 4) <> (up % 31 = 4) THEN 'PARENT_PATH' WHEN up % 37 = 5 AND k % 37 <> 5 THEN 'PARENT_RANGE' END AS fault FROM d) SELECT * FROM f WHERE fault IS NOT NULL""")
def _(s, d):
    k = F.col("p_partkey")
    parent = F.when(k > 0, F.concat(F.lit("s"), F.when(k % 29 == 3, F.lit(-1)).otherwise(F.floor(k / 3)).cast("string")))
    # a level deeper (a ternary digit more) is a byte further in on both sides; some begin behind their children
    depth = F.length(F.conv(k.cast("string"), 10, 3)) - F.when(k == 0, 1).otherwise(0)
    rows = L.table(s, d, "part").select(F.concat(F.lit("s"), k.cast("string")).alias("symbol_id"), parent.alias("parent_id"), F.when(k % 31 == 4, "away").otherwise("home").alias("path"), F.when(k % 37 == 5, 5000 + depth).otherwise(depth).alias("start_byte"), (10_000 - depth).alias("end_byte"))
    return checks.nesting_faults(rows)


@query("q_check_revision", f"""WITH {_FILES}, g AS (SELECT path, doc_id % 23 AS k FROM f) SELECT path, CASE k WHEN 1 THEN 'MISSING_BLOB' WHEN 2 THEN 'LENGTH' WHEN 3 THEN 'DIGEST' WHEN 4 THEN 'NOT_INDEXED' WHEN 5 THEN 'STALE_INDEX' WHEN 6 THEN 'EXTRA_BLOB' WHEN 7 THEN 'EXTRA_INDEX' WHEN 8 THEN 'DUPLICATE' END AS fault FROM g WHERE k BETWEEN 1 AND 8
    UNION ALL SELECT 'more' || path, 'EXTRA_BLOB' FROM g WHERE k = 9 UNION ALL SELECT 'more' || path, 'EXTRA_INDEX' FROM g WHERE k = 10""")  # fmt: skip
def _(s, d):
    f = L.table(s, d, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("text")).withColumns({"k": F.col("doc_id") % 23, "digest": F.sha2("text", 256), "size": F.octet_length("text").cast("long")})
    k, other = F.col("k"), F.sha2(F.lit("other"), 256)
    inventory = f.select("path", F.lit("FILE").alias("kind"), F.when(k.isin(6, 7), "BINARY").otherwise("TEXT").alias("status"), (F.col("size") + F.when(k == 2, 1).otherwise(0)).alias("byte_length"), F.when(k == 3, other).otherwise(F.col("digest")).alias("content_digest"))
    inventory = inventory.unionByName(inventory.join(f.where("k = 8").select("path"), "path", "left_semi"))
    more = F.concat(F.lit("more"), "path")
    blobs = f.where(~k.isin(1, 7)).select("path", F.col("size").alias("byte_length"), F.col("digest").alias("content_digest")).unionByName(f.where("k = 9").select(more.alias("path"), F.col("size").alias("byte_length"), F.col("digest").alias("content_digest")))
    indexed = f.where(~k.isin(4, 6)).select("path", F.when(k == 5, other).otherwise(F.col("digest")).alias("content_digest")).unionByName(f.where("k = 10").select(more.alias("path"), F.col("digest").alias("content_digest")))
    return checks.revision_faults(inventory, blobs, indexed)


@query("q_check_manifest", "WITH c AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'BINARY' WHEN doc_id % 7 = 0 THEN 'SYMLINK' ELSE 'TEXT' END AS status, count(*) AS n FROM documents GROUP BY 1) SELECT status, CASE status WHEN 'BINARY' THEN n + 1 ELSE 0 END AS stored, n AS counted FROM c WHERE status <> 'TEXT' UNION ALL SELECT 'LFS_POINTER', 3, 0")
def _(s, d):
    k = F.col("doc_id")
    inventory = L.table(s, d, "documents").select(F.lit("FILE").alias("kind"), F.when(k % 5 == 0, "BINARY").when(k % 7 == 0, "SYMLINK").otherwise("TEXT").alias("status"))
    counts = inventory.groupBy("status").agg(F.count(F.lit(1)).alias("n")).where("status <> 'SYMLINK'").withColumn("n", F.col("n") + F.when(F.col("status") == "BINARY", 1).otherwise(0))
    return checks.manifest_faults(inventory, counts.unionByName(s.range(1).select(F.lit("LFS_POINTER").alias("status"), F.lit(3).cast("long").alias("n"))))


# --- frozen inputs ------------------------------------------------------------------------------------------


def frozen_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """What was frozen of the table ``benchmark``, each item twice, and where."""
    root = _folder(spark, "frozen")
    items = L.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("name"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return written(frozen.freeze(items.unionByName(items.withColumn("name", F.concat(F.lit("again-"), "name"))), root, 200), "frozen"), root


@query("q_frozen_inputs", "SELECT item_id || '' AS name, CASE WHEN octet_length(encode(text)) <= 200 THEN sha256(text) END AS digest, CAST(octet_length(encode(text)) AS BIGINT) AS byte_length, CASE WHEN octet_length(encode(text)) > 200 THEN 'CAPACITY' END AS fault FROM benchmark UNION ALL SELECT 'again-' || item_id, CASE WHEN octet_length(encode(text)) <= 200 THEN sha256(text) END, octet_length(encode(text)), CASE WHEN octet_length(encode(text)) > 200 THEN 'CAPACITY' END FROM benchmark")
def _(s, d):
    return frozen_items(s, d)[0]


@query("q_frozen_store", "SELECT DISTINCT sha256(text) AS digest, CAST(octet_length(encode(text)) AS BIGINT) AS byte_length, true AS sound FROM benchmark WHERE octet_length(encode(text)) <= 200")
def _(s, d):
    _, root = frozen_items(s, d)
    return frozen.stored(s, root).select("digest", "byte_length", (F.col("digest") == F.col("actual")).alias("sound"))


@query("q_plan_digest", """SELECT p_brand, sha256('{"dependencies":[' || string_agg('{"byte_length":' || p_size || ',"digest":"' || sha256(p_name) || '","id":"' || p_partkey || '","ordinal":' || p_partkey || '}', ',' ORDER BY p_partkey) || '],"language":"21","policy":2}') AS plan_digest FROM part WHERE p_partkey % 16 = 0 GROUP BY p_brand""")
def _(s, d):
    p = L.table(s, d, "part").where(F.col("p_partkey") % 16 == 0).select("p_brand", F.col("p_partkey").alias("ordinal"), F.col("p_partkey").cast("string").alias("id"), F.sha2("p_name", 256).alias("digest"), F.col("p_size").alias("byte_length"))
    return p.groupBy("p_brand").agg(frozen.plan_digest(p, policy=2, language="21").alias("plan_digest"))


# --- views and envelopes ------------------------------------------------------------------------------------

_SIZE = "octet_length(encode({0})) + length(regexp_replace({0}, '[^\"\\\\\n\r\t\x08\f]', '', 'g')) + 5 * length(regexp_replace({0}, '[^\x00-\x07\x0b\x0e-\x1f]', '', 'g'))"


@query("q_read_source_envelope", f"""WITH {_LB}, {_PAGE1}, c AS (SELECT path, unnest(string_split(content, '')) AS ch, unnest(range(1, length(content) + 1)) AS i FROM page1 WHERE content IS NOT NULL),
    z AS (SELECT path, i, ch, sum({_SIZE.format('ch')}) OVER (PARTITION BY path ORDER BY i) AS used FROM c), k AS (SELECT path, max(i) AS n, max(CASE WHEN used <= 308 THEN i END) AS fit FROM z GROUP BY path)
    SELECT p.path, start_byte, substr(content, 1, CAST(fit AS BIGINT)) AS content, CASE WHEN fit < n THEN 'WIRE_BUDGET' ELSE stop_reason END AS stop_reason, CASE WHEN fit < n THEN start_byte + octet_length(encode(substr(content, 1, CAST(fit AS BIGINT)))) ELSE next_byte END AS next_byte FROM page1 p LEFT JOIN k ON k.path = p.path""", "all_lines")  # fmt: skip
def _(s, d):
    f = L.file_rows(s, d, text=True).select("path", "text")
    page = reading.read_pages(f, reading.windows_of(f), max_lines=6, max_bytes=900)
    return reading.fit_envelope(page, 500).select("path", "start_byte", "content", "stop_reason", "next_byte")


@query("q_view_outcomes", """WITH n AS (SELECT path, len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) OR text = '' THEN 1 ELSE 0 END AS total, CAST(left(right(path, 12), 9) AS BIGINT) AS k, octet_length(encode(text)) AS size FROM file_rows),
    o AS (SELECT CASE WHEN k % 2 = 0 THEN replace(path, '.md', '.java') ELSE path END AS path, total, CASE WHEN k % 2 = 1 THEN 'UNSUPPORTED_LANGUAGE' WHEN size > 1048576 THEN 'FILE_TOO_LARGE' WHEN k % 10 = 2 THEN 'FILE_PARSE_FAILED' WHEN k % 10 = 4 THEN 'INDEX_NOT_READY' WHEN total >= 8 THEN 'ELIDED' ELSE 'NO_ELISION' END AS outcome FROM n)
    SELECT path, outcome, CASE WHEN total = 0 THEN 0 WHEN outcome = 'ELIDED' THEN 2 + CASE WHEN total > 7 THEN 1 ELSE 0 END ELSE 1 END AS n_windows FROM o""", "file_rows")  # fmt: skip
def _(s, d):
    k = F.expr("left(right(path, 12), 9)").cast("long")
    f = L.file_rows(s, d, text=True).select(F.when(k % 2 == 0, F.replace("path", F.lit(".md"), F.lit(".java"))).otherwise(F.col("path")).alias("path"), "text", k.alias("k"))
    statuses = f.where("k % 10 <> 4").select("path", F.when(F.col("k") % 10 == 2, "PARSE_FAILED").otherwise("PARSED").alias("status"))
    f = f.select("path", "text")
    bodies = f.where(F.size(F.split(F.regexp_replace("text", "\n$", ""), "\n", -1)) >= 8).select("path", F.lit(2).alias("open_line"), F.lit(8).alias("close_line"))
    outcomes, windows = reading.viewed(f, "SUMMARY", statuses, bodies)
    n = windows.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return outcomes.join(n, "path", "left").select("path", "outcome", F.coalesce("n", F.lit(0)).cast("int").alias("n_windows"))
