"""Extraction as table functions over files, and resolution of what they wrote as joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.operators import types
from quarrylight.operators.javasource import Extractor, extract
from quarrylight.sources.tables import written

_SPAN = "struct<start_byte:bigint,end_byte:bigint,start_line:int,end_line:int>"
PARTS = {
    "declarations": f"struct<symbol_id:string,path:string,name:string,kind:string,owner:string,parent_id:string,start_byte:bigint,name_start_byte:bigint,range:{_SPAN},name_range:{_SPAN},signature:string,arity:int>",
    "candidates": f"struct<candidate_id:string,symbol_id:string,kind:string,path:string,start_byte:bigint,evidence:struct<kind:string,annotation:string,literal_values:map<string,array<string>>,unresolved_members:array<string>,range:{_SPAN}>>",
    "folds": f"struct<symbol_id:string,path:string,kind:string,start_byte:bigint,interior:{_SPAN}>",
    "relations": "struct<relation_id:string,path:string,kind:string,start_byte:bigint,end_byte:bigint,container_symbol_id:string,written_target:string,receiver:string,receiver_type:string,arity:int,rule:string>",
}
SCHEMA = "path string, package string, imports array<string>, status string, diagnostics array<struct<code:string,line:int>>, " + ", ".join(f"{k} array<{v}>" for k, v in PARTS.items())


#: A task gives its outcomes on after so many files or characters: what it holds does not grow with the table.
FILES_AT_ONCE, CHARACTERS_AT_ONCE = 256, 1 << 20


def parsed_batches(batches: Iterator[pa.RecordBatch], generation: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Outcomes of batches of (path, text), given on as soon as they are many or large."""
    rows, held = [], 0
    for batch in batches:
        for path, text in zip(batch.column("path"), batch.column("text")):
            e = Extractor(generation, path.as_py(), text.as_py() or "")
            p = e.run()
            for c in p.candidates:
                c["evidence"]["literal_values"] = list(c["evidence"]["literal_values"].items())
            relations = list({r["relation_id"]: r for r in p.relations}.values())
            parts = {"declarations": p.declarations, "candidates": p.candidates, "folds": p.folds, "relations": relations}
            rows.append({"path": e.path, "package": e.package, "imports": [n for n, static in e.imports if not static], "status": p.status, "diagnostics": p.diagnostics, **parts})
            held += len(e.source)
            if len(rows) >= FILES_AT_ONCE or held >= CHARACTERS_AT_ONCE:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def parse_files(files: DataFrame, generation: str) -> DataFrame:
    """One row per (path, text): its outcome and all facts, nested.  Files are independent, so any partitioning does."""
    schema = files.sparkSession.createDataFrame([], SCHEMA).toArrow().schema
    return files.select("path", "text").mapInArrow(lambda batches: parsed_batches(batches, generation, schema), SCHEMA)


def facts(parsed: DataFrame, part: str) -> DataFrame:
    """One of PARTS as rows."""
    return parsed.select(F.explode(part).alias("f")).select("f.*")


def type_names(parsed: DataFrame) -> DataFrame:
    """Source-declared types by qualified name; names declared more than once are marked."""
    d = facts(parsed, "declarations").where(F.col("kind").isin("CLASS", "INTERFACE", "RECORD", "ENUM", "ANNOTATION_TYPE") & ~F.col("owner").contains("#"))
    name = F.when(F.col("owner") == "", F.col("name")).otherwise(F.concat_ws(".", "owner", "name"))
    return d.groupBy(name.alias("qualified")).agg(F.min("symbol_id").alias("target"), F.count("*").alias("copies"))


def resolved_types(parsed: DataFrame, kinds: tuple[str, ...] = ("EXTENDS", "IMPLEMENTS", "CONSTRUCT")) -> DataFrame:
    """Written types against the source catalogue: as written, in the enclosing types from the innermost, by direct
    import, in the own package, by wildcard import.

    The first of these that names a source type decides; a name declared twice or in two wildcards stays unresolved.
    """
    own = parsed.select("path", "package", "imports", F.explode("relations").alias("r")).where(F.col("r.kind").isin(*kinds))
    return _resolved(parsed, own)


def _resolved(parsed: DataFrame, own: DataFrame) -> DataFrame:
    """``resolved_types`` for relations r whose written_target is a type."""
    scope = facts(parsed, "declarations").select(F.col("symbol_id").alias("__container"), F.substring_index("owner", "#", 1).alias("scope"))
    own = own.join(scope, F.col("r.container_symbol_id") == F.col("__container"), "left")
    w = F.col("r.written_target")
    package = F.when(F.col("package") == "", w).otherwise(F.concat_ws(".", "package", w))
    parts = F.split(F.coalesce("scope", F.lit("")), r"\.")
    around = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct((1 + F.size(parts) - k).alias("rank"), F.concat_ws(".", F.array_join(F.slice(parts, F.lit(1), k), "."), w).alias("qualified")))
    direct = F.filter("imports", lambda i: F.endswith(i, F.concat(F.lit("."), w)))
    wild = F.transform(F.filter("imports", lambda i: F.endswith(i, F.lit(".*"))), lambda i: F.concat(F.replace(i, F.lit("*"), F.lit("")), w))
    choice = lambda rank, names: F.transform(names, lambda n: F.struct(F.lit(rank).alias("rank"), n.alias("qualified")))
    options = F.concat(choice(0, F.array(w)), around, choice(1 << 20, direct), choice((1 << 20) + 1, F.array(package)), choice((1 << 20) + 2, wild))
    # only names that are types go on, by the id of what wrote them: the options are read once and carry no facts
    tried = own.select(F.col("r.relation_id").alias("relation_id"), F.explode(options).alias("o")).select("relation_id", "o.*")
    found = tried.join(type_names(parsed), "qualified").groupBy("relation_id", "rank").agg(F.min("target").alias("target"), F.max("target").alias("last"), F.max("copies").alias("copies"))
    best = F.min_by(F.struct("target", F.when(F.col("target") == F.col("last"), 1).otherwise(2).alias("names"), "copies"), "rank").alias("b")
    chosen = found.groupBy("relation_id").agg(best).select("relation_id", "b.*")
    rows = own.select("r.*").join(chosen, "relation_id", "left")
    sure = (F.col("names") == 1) & (F.col("copies") == 1)
    reason = F.when(sure, None).when(F.col("copies") > 1, "DUPLICATE_SOURCE_TYPE").when(F.col("names") > 1, "AMBIGUOUS_TARGET").otherwise("MISSING_TYPE")
    return rows.select("relation_id", "path", "kind", "start_byte", "end_byte", "container_symbol_id", "written_target", F.when(sure, F.col("target")).alias("target_symbol_id"), F.when(sure, "STATIC_RESOLVED").otherwise("UNRESOLVED").alias("resolution_state"), reason.alias("unresolved_reason"))


_MODIFIERS = "public protected private static final abstract native synchronized strictfp default sealed".split()


def _last(token: Column) -> Column:
    """A name without its qualifier."""
    return F.regexp_replace(token, r"^.*\.(?=[^.]+$)", "")


def _parts(expression: Column) -> Column:
    """A token array cut at its commas outside brackets; none for no tokens."""
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<array<string>>").alias("parts"), F.array().cast("array<string>").alias("part"))

    def step(acc: Column, token: Column) -> Column:
        depth = acc["depth"] + F.when(token == "<", 1).when(token == ">", -1).otherwise(0)
        cut = (token == ",") & (acc["depth"] == 0)
        return F.struct(depth.alias("depth"), F.when(cut, F.concat(acc["parts"], F.array(acc["part"]))).otherwise(acc["parts"]).alias("parts"), F.when(cut, F.array().cast("array<string>")).otherwise(F.concat(acc["part"], F.array(token))).alias("part"))

    return F.when(F.size(expression) > 0, F.aggregate(expression, start, step, lambda acc: F.concat(acc["parts"], F.array(acc["part"])))).otherwise(F.array().cast("array<array<string>>"))


def _bracketed(expression: Column) -> Column:
    """How many tokens the brackets at the start of a token array take, both included; 0 if there are none."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(acc: Column, token: Column) -> Column:
        depth = acc["depth"] + F.when(token == "<", 1).when(token == ">", -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.when(acc["done"], acc["n"]).otherwise(acc["n"] + 1).alias("n"), (acc["done"] | (depth == 0)).alias("done"))

    return F.aggregate(expression, start, step, lambda acc: F.when(F.get(expression, F.lit(0)) == "<", acc["n"]).otherwise(0))


def _inside(expression: Column) -> Column:
    """The parts between the brackets at the start of a token array."""
    return _parts(F.slice(expression, F.lit(2), F.greatest(_bracketed(expression) - 2, F.lit(0))))


def _from(expression: Column, at: Column) -> Column:
    """The tokens from place ``at`` on, counted from 1."""
    return F.slice(expression, at, F.greatest(F.size(expression) - at + 1, F.lit(0)))


def _simple(expression: Column) -> Column:
    return F.transform(types.tokens(F.regexp_replace(F.regexp_replace(expression, r"@[\w.]+(\([^()]*\))?", " "), r"\.\.\.", "[] ")), _last)


def hierarchy(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(types, supertypes) for ``types.ancestors``: type variables and arguments are read from the headers of declarations."""
    d = facts(parsed, "declarations").where(F.col("kind").isin("CLASS", "INTERFACE", "RECORD", "ENUM", "ANNOTATION_TYPE"))
    header = _simple(F.regexp_extract("signature", r"\b(?:class|interface|record|enum)\s+[^\s<({]+(.*)", 1))
    t = d.select(F.col("symbol_id").alias("type"), "name", header.alias("h"))
    t = t.withColumns({"parameters": F.transform(_inside(F.col("h")), lambda p: p[0]), "rest": _from(F.col("h"), _bracketed(F.col("h")) + 1)})
    # a clause begins with its word; what follows is cut at commas, and the words themselves act as commas
    clauses = _parts(F.transform("rest", lambda x: F.when(x.isin("extends", "implements", "permits"), F.lit(",")).otherwise(x)))
    written_ = t.select("type", F.explode(F.filter(clauses, lambda p: F.size(p) > 0)).alias("p")).select("type", F.col("p")[0].alias("head"), _inside(_from(F.col("p"), F.lit(2))).alias("arguments"))
    up = resolved_types(parsed, ("EXTENDS", "IMPLEMENTS")).where(F.col("target_symbol_id").isNotNull())
    up = up.select(F.col("container_symbol_id").alias("type"), F.col("target_symbol_id").alias("above"), _last(F.col("written_target")).alias("head"))
    return t.select("type", "parameters"), up.join(written_, ["type", "head"], "left").select("type", "above", F.coalesce("arguments", F.array().cast("array<array<string>>")).alias("arguments")).dropDuplicates(["type", "above"])


def _methods(parsed: DataFrame) -> DataFrame:
    """Methods for ``types.overriding``; their own type variables are numbered, so that equal ones are equal."""
    in_interface = facts(parsed, "declarations").where(F.col("kind").isin("INTERFACE", "ANNOTATION_TYPE")).select(F.col("symbol_id").alias("type"), F.lit(True).alias("open"))
    d = parsed.select("package", F.explode("declarations").alias("d")).select("package", "d.*").where(F.col("kind") == "METHOD")
    # the signature ends its head with the name and an opening parenthesis
    head, takes = F.regexp_extract("signature", r"^(.*?)[\w$]+\s*\(", 1), F.regexp_extract("signature", r"^[^(]*\((.*)\)", 1)
    m = d.select(F.col("symbol_id").alias("method"), F.col("parent_id").alias("type"), "package", "name", _simple(head).alias("h"), _parts(_simple(takes)).alias("takes"))
    m = m.withColumn("modifiers", F.filter("h", lambda x: x.isin(*_MODIFIERS))).withColumn("h", F.filter("h", lambda x: ~x.isin(*_MODIFIERS)))
    m = m.withColumns({"own": F.transform(_inside(F.col("h")), lambda p: p[0]), "returns": _from(F.col("h"), _bracketed(F.col("h")) + 1)})
    numbered = F.transform(F.sequence(F.lit(1), F.size("own")), lambda k: F.array(F.concat(F.lit("#"), k.cast("string"))))
    numbered = F.when(F.size("own") > 0, numbered).otherwise(F.array().cast("array<array<string>>"))
    plain = lambda e: types.bound(e, F.col("own"), numbered)
    kept = F.transform("takes", lambda p: F.filter(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda x: x != "final"))
    said = F.arrays_overlap("modifiers", F.array(*(F.lit(x) for x in ("public", "protected", "private"))))
    m = m.join(in_interface, "type", "left").withColumn("modifiers", F.when(F.col("open") & ~said, F.concat("modifiers", F.array(F.lit("public")))).otherwise(F.col("modifiers")))
    return m.select("method", "type", "package", "name", "modifiers", F.transform(kept, plain).alias("parameters"), plain(F.col("returns")).alias("returns"))


def overrides(parsed: DataFrame) -> DataFrame:
    """(symbol_id, overridden_id): methods that override one of an ancestor in the sources, with type variables bound.

    Types are compared by their names without qualifiers.
    """
    parsed = written(parsed, "parsed")
    above = types.ancestors(*hierarchy(parsed))
    names = facts(parsed, "declarations").select("symbol_id", "name")
    lower = above.select("type", "above").join(names.select(F.col("symbol_id").alias("type"), F.col("name").alias("head")), "type").join(names.select(F.col("symbol_id").alias("above"), F.col("name").alias("result_head")), "above")
    return types.overriding(_methods(parsed), above, lower.select("head", "result_head").distinct()).select(F.col("method").alias("symbol_id"), F.col("overridden").alias("overridden_id")).distinct()


def resolved_calls(parsed: DataFrame) -> DataFrame:
    """Calls against the methods, by name and arity, of a type in the sources or of its nearest ancestor: the enclosing type for
    calls without a receiver or on ``this``, else the type of the receiver, where it is a variable of one type in its file or a
    type itself."""
    parsed = written(parsed, "parsed")
    d = facts(parsed, "declarations")
    calls = facts(parsed, "relations").where(F.col("kind") == "CALL")
    by_name = type_names(parsed).where(F.col("copies") == 1).select("qualified", F.col("target").alias("type"))
    container = d.select(F.col("symbol_id").alias("container_symbol_id"), F.col("owner").alias("enclosing"))
    typed = parsed.select("path", "package", "imports", F.explode("relations").alias("r")).where((F.col("r.kind") == "CALL") & F.col("r.receiver_type").isNotNull())
    typed = _resolved(parsed, typed.withColumn("r", F.col("r").withField("written_target", F.col("r.receiver_type")))).where(F.col("target_symbol_id").isNotNull())
    plain = F.col("receiver").isNull() | (F.col("receiver") == "this")
    own = calls.join(container, "container_symbol_id", "left").join(typed.select("relation_id", F.col("target_symbol_id").alias("of_receiver")), "relation_id", "left")
    own = own.join(by_name, F.col("enclosing") == F.col("qualified"), "left").withColumn("type", F.when(plain, F.col("type")).otherwise(F.col("of_receiver")))
    own = own.join(parsed.select("path", "package"), "path")
    methods = _methods(parsed).withColumn("n", F.size("parameters"))
    found = types.members(own.where(F.col("type").isNotNull()).select(F.col("relation_id").alias("call"), "type", "package", F.col("written_target").alias("name"), F.col("arity").alias("n")), methods, types.ancestors(*hierarchy(parsed), bind=False))
    rows = calls.join(found.withColumnRenamed("call", "relation_id"), "relation_id", "left")
    return rows.select("relation_id", "path", "kind", "start_byte", "end_byte", "container_symbol_id", "written_target", F.col("target").alias("target_symbol_id"), F.coalesce("state", F.lit("UNRESOLVED")).alias("resolution_state"), F.when(F.col("state").isNull(), "MISSING_TYPE").otherwise(F.col("reason")).alias("unresolved_reason"))


__all__ = ["extract", "facts", "overrides", "parse_files", "resolved_calls", "resolved_types", "type_names"]
