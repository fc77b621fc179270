"""Index operations: declarations, outlines, entry points, relations, folds; joins and coverage."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import paths
from quarrylight.model import checked_query, invalid
from quarrylight.operators.spans import within
from quarrylight.plans.paging import page
from quarrylight.sources.tables import by_key

SEARCH_ORDER = ["name", "path", "name_start_byte", "kind", "symbol_id"]
OUTLINE_ORDER = ["path", "start_byte", "symbol_id"]
ENTRY_ORDER = ["path", "start_byte", "kind", "candidate_id"]
RELATION_ORDER = ["path", "start_byte", "kind", "relation_id"]
FOLD_ORDER = ["start_byte", "symbol_id"]


def _of_kinds(df: DataFrame, column: str, kinds: list[str] | None) -> DataFrame:
    """An empty list is no filter."""
    if kinds is None:
        raise invalid("kinds")
    return df.where(F.col(column).isin(*sorted(set(kinds)))) if kinds else df


def search_code(declarations: DataFrame, query: str, match: str = "exact", kinds: list[str] = [], owner: str | None = None, directory: str = "", limit: int = 20, position: list | None = None) -> DataFrame:  # noqa: B006
    """Declarations by exact name or literal prefix; both tests reach the scan."""
    checked_query(query)
    if match not in ("exact", "prefix"):
        raise invalid("match")
    rows = declarations.where(F.col("name") == query if match == "exact" else F.col("name").startswith(query))
    rows = _of_kinds(rows, "kind", kinds)
    if owner is not None:
        rows = rows.where(F.col("owner") == owner)
    return page(rows.where(paths.below(F.col("path"), directory)), SEARCH_ORDER, limit, position)


def get_outline(declarations: DataFrame, files: DataFrame, path: str, limit: int = 20, position: list | None = None) -> DataFrame:
    """Declarations of a file with the file's parse outcome."""
    rows = page(declarations.where(F.col("path") == path), OUTLINE_ORDER, limit, position)
    return rows.join(files.where(F.col("path") == path).select("path", F.col("status").alias("file_status")), "path", "left")


def list_entry_points(candidates: DataFrame, kinds: list[str] = [], directory: str = "", limit: int = 20, position: list | None = None) -> DataFrame:  # noqa: B006
    return page(_of_kinds(candidates, "kind", kinds).where(paths.below(F.col("path"), directory)), ENTRY_ORDER, limit, position)


def find_relations(relations: DataFrame, anchor: tuple[str, str], direction: str, kinds: list[str] = [], states: list[str] = [], directory: str = "", limit: int = 20, position: list | None = None, files: DataFrame | None = None) -> DataFrame:  # noqa: B006
    """One hop from an anchor: ("symbol" | "external" | "file", id).

    Outgoing edges of a symbol leave its container; a file has only outgoing, an external target only incoming edges.
    ``files`` adds the status of each edge's file.
    """
    what, value = anchor
    column = {("symbol", "OUTGOING"): "container_symbol_id", ("symbol", "INCOMING"): "target_symbol_id", ("external", "INCOMING"): "external_target_id", ("file", "OUTGOING"): "path"}.get((what, direction))
    if column is None:
        raise invalid("direction")
    rows = _of_kinds(_of_kinds(relations.where(F.col(column) == value), "kind", kinds), "resolution_state", states)
    out = page(rows.where(paths.below(F.col("path"), directory)), RELATION_ORDER, limit, position)
    return out if files is None else out.join(files.select("path", F.col("status").alias("file_status")), "path", "left")


def folds_of(folds: DataFrame, declarations: DataFrame, condition: Column, limit: int = 100) -> DataFrame:
    """Folds with the declarations they belong to, those without one included."""
    own = declarations.select("symbol_id", "name", "kind")
    return folds.where(condition).orderBy(*FOLD_ORDER).limit(limit).join(own, "symbol_id", "left")


def bounded(payload: str, most: int) -> list[Column]:
    """A payload if it has at most so many bytes, and its size: what is too large never leaves the scan."""
    size = F.octet_length(payload)
    return [F.when(size <= most, F.col(payload)).alias(payload), size.alias(f"{payload}_bytes")]


def nearest_enclosing(spans: DataFrame, points: DataFrame) -> DataFrame:
    """For each point (path, point_id, at) the smallest span (path, symbol_id, start_byte, end_byte) around it, of equal ones the smallest id.

    Starts of spans and points of a path pass by in order of their place; the spans begun are held by size,
    and those that have ended are dropped when they come up.  So a file costs the sorting of its rows, not
    the product of its points and spans.
    """
    carried = [c for c in points.columns if c != "path"]
    nothing = F.lit(None).cast(points.select(F.struct(*carried).alias("p")).schema["p"].dataType)
    begun = spans.select("path", F.col("start_byte").cast("long").alias("place"), F.col("end_byte").cast("long").alias("end"), F.col("symbol_id").cast("string").alias("symbol_id"), nothing.alias("p"))
    asked = points.select("path", F.col("at").cast("long").alias("place"), F.lit(None).cast("long").alias("end"), F.lit(None).cast("string").alias("symbol_id"), F.struct(*carried).alias("p"))
    # a span holds the point at its start
    events = by_key(begun.union(asked), "path", "place", F.col("end").isNull())

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, open_ = None, []
        for batch in batches:
            ends = batch.column(2)
            at_points = np.asarray(ends.is_null())
            found: list[str | None] = []
            for p, place, end, symbol in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if p != path:
                    path, open_ = p, []
                if end is not None:
                    heapq.heappush(open_, (end - place, symbol, end))
                    continue
                while open_ and open_[0][2] <= place:
                    heapq.heappop(open_)
                found.append(open_[0][1] if open_ else None)
            # the points' own columns go through as they are
            kept = batch.filter(pa.array(at_points))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(4), pa.array(found, pa.string())], ["path", "p", "container_symbol_id"])

    kind = events.schema["p"].dataType.simpleString()
    near = events.mapInArrow(sweep, f"path string, p {kind}, container_symbol_id string")
    return near.select("path", *(F.col("p")[c].alias(c) for c in carried), "container_symbol_id")


# --- coverage -------------------------------------------------------------------------------------


def coverage_groups(relations: DataFrame) -> DataFrame:
    return relations.groupBy("kind", "resolution_state", "unresolved_reason").agg(F.count("*").alias("n"))


def coverage_marginals(relations: DataFrame) -> DataFrame:
    """Three independent roll-ups in one pass: by kind, by state, by reason."""
    sets = relations.groupingSets([[F.col("kind")], [F.col("resolution_state")], [F.col("unresolved_reason")]], "kind", "resolution_state", "unresolved_reason").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    named = F.when(F.col("g") == 3, "kind").when(F.col("g") == 5, "state").otherwise("reason")
    value = F.when(F.col("g") == 3, F.col("kind")).when(F.col("g") == 5, F.col("resolution_state")).otherwise(F.col("unresolved_reason"))
    return sets.select(named.alias("dimension"), value.alias("value"), "n").where(F.col("value").isNotNull())


def call_occurrences(relations: DataFrame, call_kinds: list[str]) -> DataFrame:
    """Distinct call sites, and those of them with an unresolved fact: two levels of grouping."""
    calls = relations.where(F.col("kind").isin(*call_kinds))
    sites = calls.groupBy("path", "start_byte", "end_byte").agg(F.max(F.when(F.col("unresolved_reason").isNotNull(), 1).otherwise(0)).alias("open"))
    return sites.agg(F.count("*").alias("occurrences"), F.coalesce(F.sum("open"), F.lit(0)).cast("long").alias("unresolved"))


def file_coverage(files: DataFrame, relation_files: DataFrame) -> DataFrame:
    """Files against analysed files, both sides kept: counts by status, missing and orphaned ones included."""
    own = files.select(F.col("path").alias("file_path"))
    both = own.join(relation_files, own["file_path"] == relation_files["path"], "full_outer")
    state = F.when(F.col("file_path").isNull(), "ORPHAN").when(F.col("path").isNull(), "MISSING").otherwise(F.col("status"))
    return both.groupBy(state.alias("status")).agg(F.count("*").alias("n"))


def inventory_coverage(inventory: DataFrame) -> DataFrame:
    """Readable and excluded files, and counts of the unsupported statuses."""
    files = inventory.where(F.col("kind") == "FILE")
    excluded = paths.is_excluded(F.col("path"))
    return files.agg(F.count_if((F.col("status") == "TEXT") & ~excluded).alias("readable"), F.count_if(excluded).alias("excluded"), F.count_if((F.col("status") != "TEXT") & ~excluded).alias("unsupported"), F.sum("byte_length").alias("bytes"))


def status_counts(inventory: DataFrame) -> DataFrame:
    """Files by status, excluded ones apart."""
    status = F.when(paths.is_excluded(F.col("path")), "EXCLUDED").otherwise(F.col("status"))
    return inventory.where(F.col("kind") == "FILE").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def syntax_coverage(files: DataFrame) -> DataFrame:
    """One row: how many files (java_file, status, diagnostics) were parsed, failed, were not supported or too large."""
    by = lambda s: F.count_if(F.col("java_file") & (F.col("status") == s))
    return files.agg(F.count("*").alias("files"), F.count_if("java_file").alias("java_files"), by("PARSED").alias("parsed"), by("PARSE_FAILED").alias("failed"), by("UNSUPPORTED").alias("unsupported"), by("TOO_LARGE").alias("too_large"), F.coalesce(F.sum("diagnostics"), F.lit(0)).cast("long").alias("diagnostics"))


def lookup(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Many point lookups at once: a row for each wanted key, found or not."""
    return wanted.select(key).distinct().join(rows.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def tracked(matches: DataFrame, inventory: DataFrame) -> DataFrame:
    """Matches in files that the inventory has as readable ones; others do not count towards a limit."""
    return matches.join(inventory.where((F.col("kind") == "FILE") & (F.col("status") == "TEXT")).select("path"), "path", "left_semi")


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner_id, outer_id) of spans of one path where the outer one holds all bytes and lines of the inner one."""
    span = F.col("start_byte"), F.col("end_byte")
    met = within(inner.select("path", "inner_id", "start_byte", "end_byte", "start_line", "end_line"), outer.select("path", "outer_id", "start_byte", "end_byte", "start_line", "end_line"), span, span)
    return met.where((F.col("outer.start_line") <= F.col("inner.start_line")) & (F.col("inner.end_line") <= F.col("outer.end_line"))).select("inner.inner_id", "outer.outer_id")


def class_catalogue(classes: DataFrame, most: int = 21) -> DataFrame:
    """Of (binary_name, artifact_order, version, ...) the class that is loaded: the first artifact's entry of the highest
    version that the language level ``most`` allows; version 0 is the plain entry."""
    return first_by_artifact(classes.where(F.col("version") <= most))


def distinct_targets(relations: DataFrame) -> DataFrame:
    """External targets once each, with how often they are used."""
    return relations.where(F.col("external_target_id").isNotNull()).groupBy(F.col("external_target_id").alias("target_id")).agg(F.count("*").alias("uses"), F.countDistinct("path").alias("files"))


def first_by_artifact(classes: DataFrame) -> DataFrame:
    """Of (binary_name, artifact_order, version, ...) the first artifact's highest version of each class."""
    w = Window.partitionBy("binary_name").orderBy("artifact_order", F.desc("version"))
    return classes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") == 1).drop("rank")
