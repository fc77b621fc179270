"""Inventory operations: listing directories, finding files, searching text, reading lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import paths
from quarrylight.functions.glob import compile_glob
from quarrylight.functions.text import displayed, lines, literal_pattern, utf16_length
from quarrylight.model import PREVIEW_CHILDREN, RANGES_MOST, QueryError, checked_limit, checked_query, invalid
from quarrylight.operators.spans import within
from quarrylight.plans.paging import page, replayed


def list_files(inventory: DataFrame, directory: str = "", depth: int = 1, limit: int = 20, position: list | None = None, replay: bool = False) -> DataFrame:
    """Children of a directory in inventory order; at depth 2 each child directory shows up to 12 of its own.

    A child directory is COMPLETE or, with more than 12 children, ELIDED; what is not looked into is NOT_EXPANDED.
    ``replay``: the entry at ``position`` must still be listed.
    """
    if depth not in (1, 2):
        raise invalid("depth")
    up = paths.parent(F.col("path"))
    inside = inventory.where(paths.below(F.col("path"), directory))
    first = inside.where(up == directory).select("path", "kind", "byte_length", "key", F.lit(1).alias("depth"))
    if depth == 1:
        out = first.withColumn("child_preview", F.lit("NOT_EXPANDED"))
    else:
        base = len(directory.split("/")) if directory else 0
        grand = inside.where(F.size(F.split("path", "/")) == base + 2).withColumn("up", up)
        ranked = grand.withColumn("n", F.row_number().over(Window.partitionBy("up").orderBy("key"))).where(F.col("n") <= PREVIEW_CHILDREN + 1)
        elided = ranked.where(F.col("n") > PREVIEW_CHILDREN).select(F.col("up").alias("path"), F.lit(True).alias("more"))
        first = first.join(elided, "path", "left")
        preview = F.when(F.col("kind") != "DIRECTORY", "NOT_EXPANDED").when(F.col("more"), "ELIDED").otherwise("COMPLETE")
        second = ranked.where(F.col("n") <= PREVIEW_CHILDREN).select("path", "kind", "byte_length", "key", F.lit(2).alias("depth"), F.lit("NOT_EXPANDED").alias("child_preview"))
        out = first.withColumn("child_preview", preview).drop("more").unionByName(second)
    return page(replayed(out, ["key"], position) if replay else out, ["key"], limit, position).drop("key")


def find_files(inventory: DataFrame, pattern: str, directory: str = "", limit: int = 20, position: list | None = None, replay: bool = False) -> DataFrame:
    """Files of all statuses at any depth that match; the directory narrows but never rebases.  ``replay``: as in ``list_files``."""
    glob = compile_glob(pattern)
    rows = inventory.where((F.col("kind") == "FILE") & paths.below(F.col("path"), directory)).where(glob.matches(F.col("path")))
    return page(replayed(rows, ["path"], position).select("path", "status", "byte_length") if replay else rows.select("path", "status", "byte_length"), ["path"], limit, position)


def search_text(files: DataFrame, query: str, directory: str = "", pattern: str | None = None, limit: int = 20) -> DataFrame:
    """Every non-overlapping occurrence of a literal within a line, left to right.

    Columns count UTF-16 units from 1.  The order is by path components, then line and column.
    """
    checked_query(query)
    checked_limit(limit)
    rows = files.where((F.col("status") == "TEXT") & paths.below(F.col("path"), directory))
    if pattern is not None:
        rows = rows.where(compile_glob(pattern).matches(F.col("path")))
    rows = rows.where(F.col("text").contains(query))
    at = rows.select("path", F.posexplode(F.split("text", "\n", -1)).alias("i", "line_text")).where(F.col("line_text").contains(query))
    parts = at.select("path", (F.col("i") + 1).alias("line"), F.posexplode(F.split("line_text", literal_pattern(query), -1)).alias("k", "part"))
    # a hit begins where the parts before it and the hits between them end: a running sum, however many a line holds
    to_here = Window.partitionBy("path", "line").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    begins = F.sum(utf16_length(F.col("part")).cast("long")).over(to_here) + F.col("k") * F.lit(len(query.encode("utf-16-le")) // 2) + 1
    last = F.lead("k").over(Window.partitionBy("path", "line").orderBy("k")).isNull()
    hits = parts.withColumn("column", begins.cast("int")).withColumn("last", last).where(~F.col("last"))
    hits = hits.select("path", "line", "column", F.lit(query).alias("matched_text"), F.split("path", "/").alias("components"))
    ahead = hits.orderBy("components", "line", "column").limit(limit + 1)
    n = F.row_number().over(Window.orderBy("components", "line", "column"))
    return ahead.withColumn("n", n).withColumn("truncated", F.count("*").over(Window.partitionBy()) > limit).where(F.col("n") <= limit).drop("n", "components")


def match_budget(hits: DataFrame, budget: int) -> None:
    """Fails, rather than truncates, when the matched text of a result exceeds a budget of bytes."""
    total = hits.agg(F.coalesce(F.sum(F.octet_length("matched_text")), F.lit(0))).first()[0]
    if total > budget:
        raise QueryError("SOURCE_UNAVAILABLE", "match budget")


def line_table(files: DataFrame) -> DataFrame:
    """(path, line, text): the line model of every file."""
    return files.select("path", F.posexplode(lines(F.col("text"))).alias("i", "text")).select("path", (F.col("i") + 1).alias("line"), "text")


def merge_ranges(ranges: DataFrame, key: str = "path") -> DataFrame:
    """Overlapping or adjacent (start_line, end_line) ranges of a key become one; open ends (null) come last, as in the SQL."""
    w = Window.partitionBy(key).orderBy(F.asc_nulls_last("start_line"), F.asc_nulls_last("end_line"))
    reach = F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start_line") <= reach + 1, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return ranges.withColumn("island", island).groupBy(key, "island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")).drop("island")


def normal_ranges(ranges: list[tuple[int, int]], before: int = 0, after: int = 0) -> list[tuple[int, int]]:
    """Ranges of a request, widened by context, clamped at line 1 and merged."""
    if not 1 <= len(ranges) <= RANGES_MOST or any(a < 1 or b < a for a, b in ranges) or before < 0 or after < 0:
        raise invalid("ranges")
    out: list[tuple[int, int]] = []
    for a, b in sorted((max(1, a - before), b + after) for a, b in ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def read_lines(files: DataFrame, condition: Column, ranges: list[tuple[int, int]] | None = None, before: int = 0, after: int = 0, start_line: int | None = None, tail: int | None = None) -> DataFrame:
    """Lines of the files that meet a condition: by ranges, from a line on, or the last ones; beyond the end there are none."""
    if sum(x is not None for x in (ranges, start_line, tail)) > 1:
        raise invalid("one selector")
    chosen = files.where(condition)
    if tail is not None:
        # the end is known from the array of lines, before it becomes rows
        all_ = lines(F.col("text"))
        rows = chosen.select("path", F.size(all_).alias("total"), F.posexplode(all_).alias("i", "text"))
        return rows.where(F.col("i") >= F.col("total") - tail).select("path", (F.col("i") + 1).alias("line"), "text")
    rows = line_table(chosen)
    if start_line is not None:
        return rows.where(F.col("line") >= start_line)
    if ranges is not None:
        test = F.lit(False)
        for a, b in normal_ranges(ranges, before, after):
            test = test | F.col("line").between(a, b)
        return rows.where(test)
    return rows


def elided_segments(ranges: DataFrame, bodies: DataFrame, least: int = 4) -> DataFrame:
    """SOURCE and ELISION segments of ranges (path, start_line, end_line) around foldable bodies.

    A body (path, open_line, close_line: the lines of its braces) is elided where it lies within a range
    and has at least ``least`` lines between its braces; of nested bodies only the outermost is.
    Ranges and bodies of a path meet by a sweep over both.
    """
    interior = bodies.select("path", (F.col("open_line") + 1).alias("a"), (F.col("close_line") - 1).alias("b")).where(F.col("b") - F.col("a") + 1 >= least)
    met = within(interior, ranges.select("path", "start_line", "end_line"), (F.col("a"), F.col("b")), (F.col("start_line"), F.col("end_line")))
    inside = met.select("path", "outer.start_line", "outer.end_line", "inner.a", "inner.b")
    w = Window.partitionBy("path", "start_line", "end_line").orderBy("a", F.desc("b"))
    outer = inside.withColumn("reach", F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))).where(F.col("reach").isNull() | (F.col("a") > F.col("reach"))).drop("reach")
    following = F.coalesce(F.lead("a").over(w) - 1, F.col("end_line"))
    rest = outer.select("path", (F.col("b") + 1).alias("from"), following.alias("to"))
    # what comes before the first body, or all of a range without one; ranges and bodies as one union instead of a join
    every = ranges.select("path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.lit(None).cast("long").alias("a"))
    firsts = outer.select("path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.col("a").cast("long").alias("a"))
    head = every.unionByName(firsts).groupBy("path", "start_line", "end_line").agg(F.min("a").alias("a"))
    head = head.select("path", F.col("start_line").cast("int").alias("from"), F.coalesce(F.col("a") - 1, F.col("end_line")).cast("int").alias("to"))
    source = rest.unionByName(head).where(F.col("from") <= F.col("to")).select("path", F.lit("SOURCE").alias("segment"), F.col("from").alias("start_line"), F.col("to").alias("end_line"))
    return source.unionByName(outer.select("path", F.lit("ELISION").alias("segment"), F.col("a").alias("start_line"), F.col("b").alias("end_line")))


def budget_page(lines_: DataFrame, max_lines: int = 200, max_bytes: int = 65_536) -> DataFrame:
    """Of (path, line, text) the leading lines of each path within both budgets, and why the page stops."""
    w = Window.partitionBy("path").orderBy("line")
    to_here = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = lines_.withColumn("n", F.row_number().over(w)).withColumn("bytes", F.sum((F.octet_length("text") + 1).cast("bigint")).over(to_here))
    over = F.when(F.col("n") > max_lines, "LINE_BUDGET").when(F.col("bytes") > max_bytes, "CONTENT_BUDGET")
    rows = rows.withColumn("stop", F.min(over).over(Window.partitionBy("path"))).where(over.isNull())
    return rows.select("path", "line", "text", F.coalesce("stop", F.lit("COMPLETE")).alias("stop_reason"))


def numbered_text(files: DataFrame) -> DataFrame:
    """Each file as one text of numbered lines, control characters shown as escapes."""
    shown = F.transform(lines(F.col("text")), lambda t, i: F.concat((i + 1).cast("string"), F.lit("\t"), displayed(t)))
    return files.where(F.col("text") != "").select("path", F.array_join(shown, "\n").alias("rendered"))
