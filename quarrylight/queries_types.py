"""Classes of archives, precedence of types, ancestors and overrides over tables derived from ``part``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import types
from quarrylight.queries import query
from quarrylight.sources import archives
from quarrylight.sources import logical as L
from quarrylight.sources.tables import shared_dir

# --- archives -------------------------------------------------------------------------------------------

_PER_ARCHIVE = 400
_ENTRIES = f"""p AS (SELECT p_partkey, CAST(p_partkey // {_PER_ARCHIVE} AS INTEGER) AS artifact_order, lower(replace(p_brand, '#', '')) || '.C' || p_size || CASE WHEN p_partkey % 7 = 0 THEN '$I' ELSE '' END AS binary_name,
    CAST(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 9 + p_partkey % 17 END AS INTEGER) AS version FROM part),
  e AS (SELECT artifact_order, binary_name, version, min(p_partkey) AS k FROM p GROUP BY ALL),
  fits AS (SELECT *, CAST(49 + k % 17 AS INTEGER) AS major FROM e WHERE version = 0 OR version <= 21 AND artifact_order % 3 <> 0)"""


def class_rows(spark: SparkSession, sf_dir: str, seeded: bool = False) -> DataFrame:
    """Rows for archives of 400 parts each; seeded ones hold entries that break rules."""
    p = L.table(spark, sf_dir, "part")
    order = F.floor(F.col("p_partkey") / _PER_ARCHIVE).cast("int")
    name = F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit(".C"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 7 == 0, "$I").otherwise(""))
    version = F.when(F.col("p_partkey") % 3 == 0, 0).otherwise(9 + F.col("p_partkey") % 17).cast("int")
    rows = p.select("p_partkey", order.alias("artifact_order"), name.alias("binary_name"), version.alias("version"))
    rows = rows.groupBy("artifact_order", "binary_name", "version").agg(F.min("p_partkey").alias("k"))
    inner = F.concat(F.replace("binary_name", F.lit("."), F.lit("/")), F.lit(".class"))
    entry = F.when(F.col("version") == 0, inner).otherwise(F.concat(F.lit("META-INF/versions/"), F.col("version").cast("string"), F.lit("/"), inner))
    major = 49 + F.col("k") % 17
    own = F.col("binary_name")
    if seeded:
        entry = F.when(F.col("k") % 31 == 3, F.concat(F.lit("BOOT-INF/classes/"), inner)).when(F.col("k") % 31 == 4, F.concat(F.lit("META-INF/versions/8/"), inner)).when(F.col("k") % 31 == 5, F.concat(F.lit("a/../"), inner)).otherwise(entry)
        major, own = F.when(F.col("k") % 31 == 6, 66).otherwise(major), F.when(F.col("k") % 31 == 7, "other.Name").otherwise(own)
    artifact = F.concat(F.lit("lib-"), F.lpad(F.col("artifact_order").cast("string"), 6, "0"), F.lit(".jar"))
    return rows.select(artifact.alias("artifact"), (F.col("artifact_order") % 3 != 0).alias("multi_release"), entry.alias("entry"), own.alias("class_name"), major.cast("int").alias("major"))


def archive_folder(spark: SparkSession, sf_dir: str, seeded: bool = False) -> str:
    folder = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    archives.write_archives(class_rows(spark, sf_dir, seeded), folder)
    return folder


@query("q_archive_entries", f"WITH {_ENTRIES} SELECT artifact_order, binary_name, version, major, CAST(52 + strlen(binary_name) AS BIGINT) AS byte_length FROM fits")
def _(s, d):
    found = archives.archive_entries(s, archive_folder(s, d))
    return found.where(F.col("fault").isNull()).select("artifact_order", "binary_name", "version", "major", "byte_length")


_CATALOGUE = """best AS (SELECT artifact_order, binary_name, max(version) AS version, arg_max(major, version) AS major FROM fits GROUP BY ALL),
  named AS (SELECT binary_name AS name, false AS alias, * FROM best UNION ALL SELECT replace(binary_name, '$', '.'), true, * FROM best WHERE contains(binary_name, '$')),
  cat AS (SELECT name, arg_min({'b': binary_name, 'a': artifact_order, 'v': version, 'm': major}, {'a': artifact_order, 'x': alias}) AS c FROM named GROUP BY name)"""


@query("q_archive_catalogue", f"WITH {_ENTRIES}, {_CATALOGUE} SELECT name, c.b AS binary_name, c.a AS artifact_order, c.v AS version, c.m AS major FROM cat")
def _(s, d):
    return archives.catalogue(archives.archive_entries(s, archive_folder(s, d))).select("name", "binary_name", "artifact_order", "version", "major")


@query("q_archive_lookup", f"WITH {_ENTRIES} SELECT artifact_order, version, major FROM fits WHERE binary_name IN ('brand11.C1', 'brand23.C7') AND artifact_order >= 1")
def _(s, d):
    found = archives.archive_entries(s, archive_folder(s, d))  # both conditions are taken by the reader
    return found.where(F.col("binary_name").isin("brand11.C1", "brand23.C7") & (F.col("artifact_order") >= 1)).select("artifact_order", "version", "major")


@query("q_archive_faults", f"""WITH {_ENTRIES}, f AS (SELECT artifact_order, k, CASE k % 31 WHEN 3 THEN 'NESTED_LAYOUT' WHEN 4 THEN 'INVALID_VERSION' WHEN 5 THEN 'UNSAFE_ENTRY' WHEN 6 THEN 'CLASS_LEVEL' WHEN 7 THEN 'CLASS_IDENTITY' END AS fault, version FROM e)
    SELECT artifact_order, fault, count(*) AS n FROM (SELECT DISTINCT artifact_order, fault, CASE WHEN k % 31 < 6 THEN CAST(k % 31 AS VARCHAR) || name ELSE CAST(k AS VARCHAR) END FROM (SELECT f.*, e.binary_name AS name FROM f JOIN e USING (artifact_order, k)) WHERE fault IS NOT NULL
      AND (k % 31 < 6 OR version = 0 OR version <= 21 AND artifact_order % 3 <> 0)) GROUP BY ALL""")  # fmt: skip
def _(s, d):
    found = archives.archive_entries(s, archive_folder(s, d, seeded=True)).where(F.col("fault").isNotNull() & (F.col("fault") != "DUPLICATE_ENTRY"))
    return found.groupBy("artifact_order", "fault").agg(F.count(F.lit(1)).alias("n"))


_DOTTED = "lower(replace(p_brand, '#', '')) || '.C' || p_size"


@query("q_type_precedence", f"""WITH {_ENTRIES}, {_CATALOGUE}, w AS (SELECT DISTINCT {_DOTTED} || x AS name FROM part, (VALUES (''), ('.I'), ('.None')) v(x)),
    pl AS (SELECT DISTINCT {_DOTTED} AS name FROM part WHERE p_size % 10 = 0), so AS (SELECT {_DOTTED} AS name, count(*) AS copies, min(p_partkey) AS k FROM part WHERE p_partkey % 50 = 1 GROUP BY 1)
    SELECT w.name, CASE WHEN pl.name IS NOT NULL THEN 'PLATFORM' WHEN copies = 1 THEN 'SOURCE' WHEN copies > 1 THEN NULL WHEN cat.name IS NOT NULL THEN 'ARCHIVE' END AS origin,
      CASE WHEN pl.name IS NOT NULL THEN 'jdk:' || w.name WHEN copies = 1 THEN 'src:' || so.k WHEN copies > 1 THEN NULL ELSE 'lib:' || c.a END AS target,
      CASE WHEN pl.name IS NULL AND copies > 1 THEN 'DUPLICATE_SOURCE_TYPE' WHEN pl.name IS NULL AND copies IS NULL AND cat.name IS NULL THEN 'MISSING_TYPE' END AS reason
    FROM w LEFT JOIN pl ON pl.name = w.name LEFT JOIN so ON so.name = w.name LEFT JOIN cat ON cat.name = w.name""")  # fmt: skip
def _(s, d):
    p = L.table(s, d, "part").select("p_partkey", "p_size", F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit(".C"), F.col("p_size").cast("string")).alias("name"))
    wanted = p.select(F.explode(F.array(*(F.concat("name", F.lit(x)) for x in ("", ".I", ".None")))).alias("name"))
    platform = p.where(F.col("p_size") % 10 == 0).select("name", F.concat(F.lit("jdk:"), "name").alias("target")).distinct()
    sources = p.where(F.col("p_partkey") % 50 == 1).select("name", F.concat(F.lit("src:"), F.col("p_partkey").cast("string")).alias("target"))
    loaded = archives.catalogue(archives.archive_entries(s, archive_folder(s, d)))
    return types.resolved_names(wanted, platform, sources, loaded.select("name", "artifact_order", F.concat(F.lit("lib:"), F.col("artifact_order").cast("string")).alias("target")))


# --- a hierarchy of generic types: part k extends part k // 2 ---------------------------------------------

_TYPE, _ABOVE = "'P' || k", "'P' || (k // 2)"
_HIERARCHY = f"""t AS (SELECT p_partkey + 1 AS k, p_size, p_brand FROM part),
  edge AS (SELECT {_TYPE} AS type, {_ABOVE} AS above, CASE k % 4 WHEN 0 THEN [['A'], ['B']] WHEN 1 THEN [['B'], ['A']] WHEN 2 THEN [['List', '<', 'A', '>'], ['B']] ELSE [['String']] END AS arguments FROM t WHERE k // 2 IN (SELECT k FROM t)),
  up AS (SELECT type, above, 1 AS distance, arguments FROM edge
    UNION ALL SELECT u.type, e.above, u.distance + 1, list_transform(e.arguments, lambda x: flatten(list_transform(x, lambda y: CASE y WHEN 'A' THEN u.arguments[1] WHEN 'B' THEN coalesce(u.arguments[2], ['Object']) ELSE [y] END))) FROM up u JOIN edge e ON e.type = u.above),
  m AS (SELECT {_TYPE} || '.m' AS method, {_TYPE} AS type, p_brand AS package, 'm' || p_size % 5 AS name, CASE k % 6 WHEN 0 THEN [] WHEN 1 THEN ['static'] WHEN 2 THEN ['private'] WHEN 3 THEN ['protected'] ELSE ['public'] END AS modifiers,
    CASE k % 3 WHEN 0 THEN [['A']] WHEN 1 THEN [['String']] ELSE [['List', '<', 'A', '>']] END AS parameters, CASE WHEN k % 5 = 0 THEN ['void'] WHEN k % 5 = 1 THEN [{_TYPE}] WHEN k % 5 = 2 THEN ['P1'] ELSE ['Object'] END AS returns FROM t)"""


def hierarchy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(types, supertypes, methods) of a generic type for each part."""
    t = L.table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("k"), "p_size", "p_brand")
    name = F.concat(F.lit("P"), F.col("k").cast("string"))
    lists = lambda *e: F.array(*(F.array(*map(F.lit, x)) for x in e))
    k = F.col("k")
    kinds = t.select(name.alias("type"), F.array(F.lit("A"), F.lit("B")).alias("parameters"))
    arguments = F.when(k % 4 == 0, lists("A", "B")).when(k % 4 == 1, lists("B", "A")).when(k % 4 == 2, lists(("List", "<", "A", ">"), "B")).otherwise(lists(("String",)))
    edges = t.select(name.alias("type"), F.concat(F.lit("P"), F.floor(k / 2).cast("string")).alias("above"), arguments.alias("arguments")).join(kinds.select(F.col("type").alias("above")), "above", "left_semi")
    modifiers = F.when(k % 6 == 0, F.array().cast("array<string>")).when(k % 6 == 1, F.array(F.lit("static"))).when(k % 6 == 2, F.array(F.lit("private"))).when(k % 6 == 3, F.array(F.lit("protected"))).otherwise(F.array(F.lit("public")))
    takes = F.when(k % 3 == 0, lists("A")).when(k % 3 == 1, lists(("String",))).otherwise(lists(("List", "<", "A", ">")))
    returns = F.when(k % 5 == 0, F.array(F.lit("void"))).when(k % 5 == 1, F.array(name)).when(k % 5 == 2, F.array(F.lit("P1"))).otherwise(F.array(F.lit("Object")))
    methods = t.select(F.concat(name, F.lit(".m")).alias("method"), name.alias("type"), F.col("p_brand").alias("package"), F.concat(F.lit("m"), (F.col("p_size") % 5).cast("string")).alias("name"), modifiers.alias("modifiers"), takes.alias("parameters"), returns.alias("returns"))
    return kinds, edges, methods


@query("q_type_ancestors", f"WITH RECURSIVE {_HIERARCHY} SELECT type, above, CAST(distance AS INTEGER) AS distance, array_to_string(list_transform(arguments, lambda x: array_to_string(x, ' ')), ';') AS arguments FROM up")
def _(s, d):
    kinds, edges, _ = hierarchy(s, d)
    return types.ancestors(kinds, edges).select("type", "above", "distance", F.array_join(F.transform("arguments", lambda x: F.array_join(x, " ")), ";").alias("arguments"))


_BIND = "list_transform({0}, lambda y: CASE y WHEN 'A' THEN u.arguments[1] WHEN 'B' THEN coalesce(u.arguments[2], ['Object']) ELSE [y] END)"


@query("q_type_overrides", f"""WITH RECURSIVE {_HIERARCHY}, live AS (SELECT * FROM m WHERE NOT list_has_any(modifiers, ['static', 'private'])),
    met AS (SELECT o.method, i.method AS overridden, u.distance, o.parameters AS own, o.returns AS own_returns, list_transform(i.parameters, lambda x: flatten({_BIND.format('x')})) AS takes, flatten({_BIND.format('i.returns')}) AS returns
      FROM live o JOIN up u ON u.type = o.type JOIN live i ON i.type = u.above AND i.name = o.name WHERE len(i.modifiers) > 0 OR i.package = o.package)
    SELECT method, overridden, CAST(distance AS INTEGER) AS distance FROM met WHERE own = takes AND (own_returns = returns OR own_returns[1] <> 'void' AND returns[1] <> 'void' AND (returns[1] = 'Object' OR EXISTS (SELECT 1 FROM up u WHERE u.type = own_returns[1] AND u.above = returns[1])))""")  # fmt: skip
def _(s, d):
    kinds, edges, methods = hierarchy(s, d)
    return types.overriding(methods, types.ancestors(kinds, edges))


@query("q_type_members", f"""WITH RECURSIVE {_HIERARCHY}, c AS (SELECT {_TYPE} AS call, {_TYPE} AS type, 'm' || k % 5 AS name FROM t),
    reach AS (SELECT call, name, type AS above, 0 AS distance FROM c UNION ALL SELECT call, name, u.above, u.distance FROM c JOIN up u ON u.type = c.type),
    hit AS (SELECT call, distance, method FROM reach JOIN m ON m.type = reach.above AND m.name = reach.name UNION ALL SELECT call, distance, method || '2' FROM reach JOIN m ON m.type = reach.above AND m.name = reach.name AND ascii(right(m.type, 1)) % 10 = 7),
    each AS (SELECT call, distance, min(method) AS method, count(*) AS n FROM hit GROUP BY ALL), near AS (SELECT * FROM each QUALIFY distance = min(distance) OVER (PARTITION BY call))
    SELECT c.call, CASE WHEN n = 1 THEN method END AS target, CAST(CASE WHEN n = 1 THEN distance END AS INTEGER) AS distance, CASE WHEN n = 1 THEN 'STATIC_RESOLVED' ELSE 'UNRESOLVED' END AS state, CASE WHEN n > 1 THEN 'AMBIGUOUS_TARGET' WHEN n IS NULL THEN 'MISSING_TYPE' END AS reason
    FROM c LEFT JOIN near ON near.call = c.call""")  # fmt: skip
def _(s, d):
    kinds, edges, methods = hierarchy(s, d)
    t = kinds.select("type", F.col("type").alias("call"), F.concat(F.lit("m"), (F.substring("type", 2, 20).cast("long") % 5).cast("string")).alias("name"), F.lit(1).alias("n"))
    have = methods.select("method", "type", "name", F.lit(1).alias("n"))
    twice = have.where(F.ascii(F.right("type", F.lit(1))) % 10 == 7).withColumn("method", F.concat("method", F.lit("2")))
    return types.members(t, have.unionByName(twice), types.ancestors(kinds, edges, bind=False))
