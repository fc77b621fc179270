"""Extraction over a source tree with a file for each row of ``part``, whose facts SQL knows from the columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import extract
from quarrylight.operators.javasource import ENTRY_ANNOTATIONS, FRAMEWORK_ANNOTATIONS
from quarrylight.queries import query
from quarrylight.sources import logical as L
from quarrylight.sources.tables import written

_NAMES = list(FRAMEWORK_ANNOTATIONS)
_PACKAGE = "lower(replace(p_brand, '#', ''))"
_FILE = f"{_PACKAGE} || '/P' || (p_partkey + 1) || '.java'"


#: Files that a task parses: rows of ``part`` are few bytes, so partitions made by size would be few and long.
_PER_TASK = 10_000


def java_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): a class that extends the one before it, with a field, an annotated method that calls JDBC and a method of its own."""
    p = L.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    p = p.repartition(max(spark.sparkContext.defaultParallelism, -(-p.count() // _PER_TASK)), "p_partkey")  # a number is kept by adaptive execution
    package, key = F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), (F.col("p_partkey") + 1).cast("string")
    qualified = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % len(_NAMES) + 1).cast("int"))
    text = F.concat(
        F.lit("package "), package, F.lit(";\n\nimport "), qualified, F.lit(";\nimport java.sql.Connection;\n\npublic class P"), key, F.lit(" extends P"), F.col("p_partkey").cast("string"),
        F.lit(" {\n    private int size = "), F.col("p_size").cast("string"), F.lit(";\n    @"), F.substring_index(qualified, ".", -1), F.lit('("/p/'), key, F.lit('")\n    public String name(int n, Connection c) { c.prepareStatement("select '), key,
        F.lit('"); return text(n); }\n    String text(int n) { return "x"; }\n}\n'))
    return p.select(F.concat(package, F.lit("/P"), key, F.lit(".java")).alias("path"), text.alias("text"))


_PARSED: dict[tuple, str] = {}


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parsed tree, once for each session and version of the table: its files with their lengths and times."""
    p = L.table(spark, sf_dir, "part")
    version = p.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().orderBy("file_path").collect()
    key = spark.sparkContext.applicationId, *map(tuple, version)
    if key not in _PARSED:
        _PARSED[key] = written(extract.parse_files(java_files(spark, sf_dir), "g"), "java").inputFiles()[0].rpartition("/")[0]
    return spark.read.parquet(_PARSED[key])


def _values(rows: list[tuple[str, ...]]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in rows)


_RULES = f"rules(n, kind, rule) AS (SELECT CAST(n AS BIGINT), kind, rule FROM (VALUES {_values([(str(i), *FRAMEWORK_ANNOTATIONS[q]) for i, q in enumerate(_NAMES)])}) v(n, kind, rule))"
_ENTRIES = f"entries(n, kind) AS (SELECT CAST(n AS BIGINT), kind FROM (VALUES {_values([(str(i), ENTRY_ANNOTATIONS[q]) for i, q in enumerate(_NAMES) if q in ENTRY_ANNOTATIONS])}) v(n, kind))"


@query("q_java_declarations", f"""SELECT {_FILE} AS path, kind, CASE WHEN name = 'P' THEN 'P' || (p_partkey + 1) ELSE name END AS name, owner_tail, line, arity FROM part, (VALUES ('CLASS', 'P', '', 6, 0), ('FIELD', 'size', 'P', 7, 0), ('METHOD', 'name', 'P', 9, 2), ('METHOD', 'text', 'P', 10, 1)) v(kind, name, owner_tail, line, arity)""")
def _(s, d):
    f = extract.facts(_parsed(s, d), "declarations")
    tail = F.when(F.col("kind") == "CLASS", "").otherwise("P")
    arity = F.when(F.col("kind") == "METHOD", F.col("arity")).otherwise(0)
    return f.select("path", "kind", "name", tail.alias("owner_tail"), F.col("name_range.start_line").alias("line"), arity.cast("int").alias("arity"))


@query("q_java_evidence", f"WITH {_RULES} SELECT {_FILE} AS path, kind, rule FROM part JOIN rules ON n = p_partkey % {len(_NAMES)} UNION ALL SELECT {_FILE}, 'DB_EVIDENCE', 'jdbc-connection-sql' FROM part")
def _(s, d):
    return extract.facts(_parsed(s, d), "relations").where(F.col("rule").isNotNull()).select("path", "kind", "rule")


@query("q_java_candidates", f"WITH {_ENTRIES} SELECT {_FILE} AS path, kind, 'DIRECT_IMPORT' AS evidence, '/p/' || (p_partkey + 1) AS literal FROM part JOIN entries ON n = p_partkey % {len(_NAMES)}")
def _(s, d):
    c = extract.facts(_parsed(s, d), "candidates")
    return c.select("path", "kind", F.col("evidence.kind").alias("evidence"), F.try_element_at("evidence.literal_values", F.lit("value"))[0].alias("literal"))


@query("q_java_folds", f"SELECT {_FILE} AS path, name, 1 AS n FROM part, (VALUES ('name'), ('text')) v(name)")
def _(s, d):
    parsed = _parsed(s, d)
    own = extract.facts(parsed, "folds").join(extract.facts(parsed, "declarations").select("symbol_id", "name"), "symbol_id")
    return own.groupBy("path", "name").agg(F.count("*").cast("int").alias("n"))


@query("q_java_calls", f"SELECT {_FILE} AS path, written_target, resolution_state FROM part, (VALUES ('text', 'STATIC_RESOLVED'), ('prepareStatement', 'UNRESOLVED')) v(written_target, resolution_state)")
def _(s, d):
    return extract.resolved_calls(_parsed(s, d)).select("path", "written_target", "resolution_state")


@query("q_java_types", f"""SELECT {_FILE} AS path, 'P' || p.p_partkey AS written_target, CASE WHEN o.p_partkey IS NULL THEN 'MISSING_TYPE' END AS unresolved_reason FROM part p LEFT JOIN (SELECT p_partkey AS k, p_brand AS b, p_partkey FROM part) o ON o.k = p.p_partkey - 1 AND o.b = p.p_brand""".replace(_FILE, _FILE.replace("p_brand", "p.p_brand").replace("p_partkey", "p.p_partkey")))
def _(s, d):
    return extract.resolved_types(_parsed(s, d), ("EXTENDS",)).select("path", "written_target", "unresolved_reason")


@query("q_java_overrides", f"""WITH r AS (SELECT *, p_partkey - row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS island FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY p_brand, island ORDER BY p_partkey) - 1 AS n FROM r)
    SELECT {_FILE} AS path, name, n AS overridden FROM k, (VALUES ('name'), ('text')) v(name) WHERE n > 0""")  # fmt: skip
def _(s, d):
    parsed = _parsed(s, d)
    own = extract.overrides(parsed).join(extract.facts(parsed, "declarations"), "symbol_id")
    return own.groupBy("path", "name").agg(F.count("*").alias("overridden"))
