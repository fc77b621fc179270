"""Logical tables of the engine over the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions.paths import inventory_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_rows(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    """Files of the inventory: path, text and what identifies it."""
    d = table(spark, sf_dir, "documents")
    body = F.coalesce("text", F.lit(""))
    path = F.concat("lang", F.lit("/"), "source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".md"))
    out = d.select(path.alias("path"), F.lit("FILE").alias("kind"), F.lit("TEXT").alias("status"), F.octet_length(body).cast("long").alias("byte_length"), *([body.alias("text")] if text else []))
    return out


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, kind, status, byte_length, key): files and the directories above them."""
    files = file_rows(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select("lang", "source").distinct()
    dirs = d.select(F.explode(F.array(F.col("lang"), F.concat("lang", F.lit("/"), "source"))).alias("path")).distinct()
    dirs = dirs.select("path", F.lit("DIRECTORY").alias("kind"), F.lit(None).cast("string").alias("status"), F.lit(0).cast("long").alias("byte_length"))
    return files.unionByName(dirs).withColumn("key", inventory_key(F.col("path"), F.col("kind")))


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("symbol_id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("owner"),
        F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_size").cast("long").alias("start_byte"), (F.col("p_size") + 4).cast("long").alias("name_start_byte"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("relation_id"), F.col("l_orderkey").cast("string").alias("path"), F.col("l_returnflag").alias("kind"),
        F.col("l_linestatus").alias("resolution_state"), F.col("l_linenumber").cast("long").alias("start_byte"), (F.col("l_linenumber") + F.col("l_quantity").cast("long")).cast("long").alias("end_byte"),
        F.col("l_orderkey").cast("string").alias("container_symbol_id"), F.when(F.col("l_linestatus") == "O", F.col("l_partkey").cast("string")).alias("target_symbol_id"),
        F.when(F.col("l_linestatus") != "O", F.col("l_suppkey").cast("string")).alias("external_target_id"),
        F.when((F.col("l_linestatus") != "O") & (F.col("l_returnflag") == "R"), F.lit("TYPE_NOT_FOUND")).alias("unresolved_reason"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per conversation; each turn is a section with a heading."""
    c = table(spark, sf_dir, "conversations")
    turn = F.concat(F.lit("## "), F.coalesce("role", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    joined = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("body")))).alias("turns"))
    owner = F.concat(F.lit("owner"), (F.col("conv_id") % 5).cast("string"))
    path = F.concat(F.lit("repositories/"), owner, F.lit("/"), F.lpad(F.col("conv_id").cast("string"), 9, "0"), F.lit(".md"))
    return joined.select(path.alias("path"), owner.alias("owner"), F.array_join(F.transform("turns", lambda t: t["body"]), "").alias("content"))


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publication events: a signup is one of the default branch, a purchase one of an explicit revision."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "purchase"))
    return e.select(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("repository_id"), F.sha1(F.encode((F.col("event_id") % 97).cast("string"), "UTF-8")).alias("revision"), F.col("event_id").cast("long").alias("seq"),
                    F.col("ts").alias("published_at"), (F.col("event_type") == "signup").alias("is_default"))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase reports of jobs, late ones included: (repository_id, job_seq, phase, reported_at)."""
    e = table(spark, sf_dir, "events")
    phase = F.when(F.col("event_type") == "view", "ACCEPTED").when(F.col("event_type") == "click", "RUNNING").when(F.col("event_type") == "error", "FAILED").otherwise("COMPLETE")
    return e.select(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("repository_id"), F.floor(F.col("event_id") / 500).cast("long").alias("job_seq"), phase.alias("phase"), F.col("ts").alias("reported_at"), F.col("event_id").cast("long").alias("event_id"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("repository_id"), F.col("c_name").alias("display_name"), F.col("c_mktsegment").alias("review_status"), F.col("c_nationkey").cast("string").alias("origin"))


#: The same tables for DuckDB, as common table expressions.
SQL = {
    "file_rows": "SELECT lang || '/' || source || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.md' AS path, 'FILE' AS kind, 'TEXT' AS status, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS byte_length, coalesce(text, '') AS text FROM documents",
    "inventory": "SELECT path, kind, status, byte_length, path AS key FROM file_rows UNION ALL SELECT path, 'DIRECTORY', NULL, 0, path || '/' FROM (SELECT lang AS path FROM documents UNION SELECT lang || '/' || source FROM documents)",
    "declarations": "SELECT CAST(p_partkey AS VARCHAR) AS symbol_id, p_name AS name, p_type AS kind, p_brand AS owner, p_brand || '/' || CAST(p_partkey AS VARCHAR) AS path, CAST(p_size AS BIGINT) AS start_byte, CAST(p_size + 4 AS BIGINT) AS name_start_byte FROM part",
    "relations": """SELECT l_orderkey || '-' || l_linenumber AS relation_id, CAST(l_orderkey AS VARCHAR) AS path, l_returnflag AS kind, l_linestatus AS resolution_state, CAST(l_linenumber AS BIGINT) AS start_byte,
      CAST(l_linenumber + CAST(floor(l_quantity) AS BIGINT) AS BIGINT) AS end_byte, CAST(l_orderkey AS VARCHAR) AS container_symbol_id, CASE WHEN l_linestatus = 'O' THEN CAST(l_partkey AS VARCHAR) END AS target_symbol_id,
      CASE WHEN l_linestatus <> 'O' THEN CAST(l_suppkey AS VARCHAR) END AS external_target_id, CASE WHEN l_linestatus <> 'O' AND l_returnflag = 'R' THEN 'TYPE_NOT_FOUND' END AS unresolved_reason FROM lineitem""",
    "document_files": """SELECT 'repositories/owner' || CAST(conv_id % 5 AS VARCHAR) || '/' || lpad(CAST(conv_id AS VARCHAR), 9, '0') || '.md' AS path, 'owner' || CAST(conv_id % 5 AS VARCHAR) AS owner,
      string_agg('## ' || coalesce(role, '') || chr(10) || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn) AS content FROM conversations GROUP BY conv_id""",
    "publications": "SELECT 'r' || CAST(user_id AS VARCHAR) AS repository_id, sha1(CAST(event_id % 97 AS VARCHAR)) AS revision, CAST(event_id AS BIGINT) AS seq, ts AS published_at, event_type = 'signup' AS is_default FROM events WHERE event_type IN ('signup', 'purchase')",
    "job_events": "SELECT 'r' || CAST(user_id AS VARCHAR) AS repository_id, CAST(event_id // 500 AS BIGINT) AS job_seq, CASE event_type WHEN 'view' THEN 'ACCEPTED' WHEN 'click' THEN 'RUNNING' WHEN 'error' THEN 'FAILED' ELSE 'COMPLETE' END AS phase, ts AS reported_at, CAST(event_id AS BIGINT) AS event_id FROM events",
    "registry": "SELECT 'r' || CAST(c_custkey AS VARCHAR) AS repository_id, c_name AS display_name, c_mktsegment AS review_status, CAST(c_nationkey AS VARCHAR) AS origin FROM customer",
    "all_lines": "SELECT path, unnest(ls) AS text, unnest(range(1, len(ls) + 1)) AS line FROM (SELECT path, CASE WHEN text = '' THEN [] WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS ls FROM file_rows)",
}
_NEEDS = {"inventory": ("file_rows",), "all_lines": ("file_rows",)}


def sql(body: str, *tables: str, recursive: bool = False) -> str:
    """``body`` with the logical tables it names in front."""
    names: list[str] = []
    for t in tables:
        for need in (*_NEEDS.get(t, ()), t):
            if need not in names:
                names.append(need)
    ctes = [f"{n} AS ({SQL[n]})" for n in names]
    head = "WITH " + ("RECURSIVE " if recursive else "")
    if not ctes:
        return body
    return head + ", ".join(ctes) + (", " + body[5:] if body.startswith("WITH ") else " " + body)
