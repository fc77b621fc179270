"""Document operations: sections, section search, listing, reading, admission and publication."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from quarrylight.functions.identity import ordered_digest
from quarrylight.functions.paths import utf16_order
from quarrylight.functions.text import clip, utf16_length
from quarrylight.model import DOCUMENT_PAGE_MOST, SECTIONS_MOST, SHA256, SNIPPET_MOST, TITLE_MOST, QueryError, checked_limit, checked_query, invalid
from quarrylight.plans import cursor
from quarrylight.plans.paging import after

SECTION_SCHEMA = "path string, start_line int, end_line int, start_char int, end_char int, start_offset int, end_offset int, title string"


# A fenced block as a whole (to its closing fence or the end of the text), or a heading; lines may end in CR LF.
_BLOCK = re.compile(
    r"""^[ ]{0,3}(?:
      (?P<ticks>`{3,}+)(?![^\n]*`)[^\n]*+(?:\n(?![ ]{0,3}(?P=ticks)`*[ \t]*\r?$)[^\n]*+)*+(?:\n[^\n]*+)?
    | (?P<waves>~{3,}+)[^\n]*+(?:\n(?![ ]{0,3}(?P=waves)~*[ \t]*\r?$)[^\n]*+)*+(?:\n[^\n]*+)?
    | \#{1,6}+(?P<title>(?:[ \t][^\n]*+)?)\r?$
    )""",
    re.M | re.X,
)
_CLOSING_MARKS = re.compile(r"(?:^|(?<=[ \t]))#+$")


def parse_sections(content: str, most: int = SECTIONS_MOST) -> list[tuple[int, int, int, int, str]]:
    """(start_line, end_line, start, end, title) of a Markdown text; places are code points, end exclusive.

    Headings are one to six ``#`` after at most three spaces, then white space or the line's end; lines
    within fences are no headings.  Text before the first heading is a section without a title.
    """
    found = [(m.start(), _CLOSING_MARKS.sub("", m["title"].removesuffix("\r").strip(" \t")).rstrip(" \t")) for m in _BLOCK.finditer(content) if m["title"] is not None]
    if not found or found[0][0]:
        found.insert(0, (0, ""))
    if len(found) > most:
        raise QueryError("DOCUMENT_CAPACITY_EXCEEDED")
    starts = [start for start, _ in found]
    ends = [*starts[1:], len(content)]
    # a section begins on the line after the line feeds before it
    lines = list(accumulate((content.count("\n", a, b) for a, b in zip(starts, ends)), initial=1))
    lines[-1] += not content.endswith("\n")
    return [(line, after_ - 1, a, b, title) for line, after_, a, b, (_, title) in zip(lines, lines[1:], starts, ends, found)]


def sections(documents: DataFrame) -> DataFrame:
    """Sections of (path, content): fences carry state from line to line, so texts are read in Python, whole, in Arrow batches.

    A document with more sections than a document may have gives none here and a row of ``section_faults``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                units = (lambda a, b: b - a) if content.isascii() else (lambda a, b, c=content: len(c[a:b].encode("utf-16-le")) // 2)
                offset = 0
                try:
                    found = parse_sections(content)
                except QueryError:
                    continue
                for line, end_line, start, end, title in found:
                    begin, offset = offset, offset + units(start, end)
                    rows.append((path, line, end_line, start, end, begin, offset, title))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SECTION_SCHEMA.split(", ")])

    return documents.select("path", F.coalesce("content", F.lit("")).alias("content")).mapInPandas(run, SECTION_SCHEMA)


def section_faults(documents: DataFrame) -> DataFrame:
    """(path, fault) of documents that ``sections`` leaves out."""
    some = documents.select("path").join(sections(documents).select("path").distinct(), "path", "left_anti")
    return some.select("path", F.lit("SECTIONS").alias("fault"))


def _owned(documents: DataFrame, owner: str | None) -> DataFrame:
    return documents if owner is None else documents.where(F.col("owner") == owner)


def search_documents(documents: DataFrame, query: str, owner: str | None = None, limit: int = 10, position: list | None = None) -> DataFrame:
    """One hit per section: the first occurrence that begins in it; it may run on past its end.

    The cursor is inclusive: it names the next item.  Documents are in UTF-16 order.
    """
    checked_limit(limit, DOCUMENT_PAGE_MOST)
    ahead = _searched(documents, query, owner, limit + 1, position)
    n = F.row_number().over(Window.orderBy("o", "start_line"))
    return ahead.withColumn("k", n).withColumn("has_more", F.count("*").over(Window.partitionBy()) > limit).where(F.col("k") <= limit).drop("k", "o")


def _searched(documents: DataFrame, query: str, owner: str | None, n: int, position: list | None) -> DataFrame:
    """The first ``n`` hits from a position on, with their order ``o``."""
    checked_query(query)
    hits = _owned(documents, owner).where(F.col("content").contains(query))
    found = sections(hits).join(hits.select("path", "content"), "path")
    at = F.expr(f"locate({_sql_text(query)}, content, start_char + 1)")
    found = found.withColumn("at", at).where((F.col("at") > F.col("start_char")) & (F.col("at") <= F.col("end_char")))
    end = F.greatest(F.col("end_char"), F.col("at") - 1 + len(query))
    found = found.select(
        "path", "start_line", clip(F.col("title"), TITLE_MOST).alias("title"), F.expr("substring(content, at, 1000000000)").alias("rest"), (end - F.col("at") + 1).alias("n"), utf16_order(F.col("path")).alias("o"))
    rows = found.select("path", "start_line", "title", F.expr(f"substring(rest, 1, least(n, {SNIPPET_MOST}))").alias("snippet"), (F.col("n") > SNIPPET_MOST).alias("snippet_clipped"), "o")
    if position is not None:
        rows = rows.where(after(["path", "start_line"], position, inclusive=True))
    return rows.orderBy("o", "start_line").limit(n)


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def list_documents(documents: DataFrame, owner: str | None = None, limit: int = 10, position: str | None = None) -> DataFrame:
    """One row per document in UTF-16 path order, from the cursor's document on."""
    checked_limit(limit, DOCUMENT_PAGE_MOST)
    ahead = _listed(documents, owner, limit + 1, position)
    n = F.row_number().over(Window.orderBy("o"))
    return ahead.withColumn("k", n).withColumn("has_more", F.count("*").over(Window.partitionBy()) > limit).where(F.col("k") <= limit).drop("k", "o")


def _listed(documents: DataFrame, owner: str | None, n: int, position: str | None) -> DataFrame:
    """The first ``n`` documents from a position on, with their order ``o``."""
    rows = _owned(documents, owner).select("path", "owner", F.octet_length("content").cast("long").alias("byte_length"), utf16_order(F.col("path")).alias("o"))
    if position is not None:
        rows = rows.where(F.col("o") >= utf16_order(F.lit(position)))
    return rows.orderBy("o").limit(n)


def read_document(documents: DataFrame, path: str, section_line: int) -> DataFrame:
    """The whole document and the section that begins at a line."""
    one = documents.where(F.col("path") == path)
    own = sections(one).where(F.col("start_line") == section_line)
    text = F.expr("substring(content, start_char + 1, end_char - start_char)")
    return one.join(own, "path").select("path", "content", "start_line", "end_line", "title", text.alias("section_text"), utf16_length(text).alias("section_units"))


def admission_faults(catalog: DataFrame) -> DataFrame:
    """Catalogue rows (path, content, content_digest, review_status, review_reference) that may not be served, with the rule broken."""
    copies = F.count("*").over(Window.partitionBy("path"))
    fault = (
        F.when(~F.col("path").rlike(r"^repositories/[a-z0-9][a-z0-9._-]{0,63}/[^/]+\.md$"), "PATH")
        .when(copies > 1, "DUPLICATE")
        .when(~F.col("content_digest").rlike(SHA256) | (F.sha2(F.col("content"), 256) != F.col("content_digest")), "DIGEST")
        .when(F.col("content").rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), "CONTROL")
        .when((F.col("review_status") == "APPROVED") & F.col("review_reference").isNull(), "REVIEW")
    )
    return catalog.select("path", fault.alias("fault")).where(F.col("fault").isNotNull())


def owner_totals(documents: DataFrame) -> DataFrame:
    """Documents, bytes and the largest document of each owner."""
    size = F.octet_length("content")
    return documents.groupBy("owner").agg(F.count("*").alias("documents"), F.sum(size).alias("bytes"), F.max_by("path", F.struct(size, "path")).alias("largest"))


def global_version(selection: DataFrame) -> DataFrame:
    """One digest over owner=revision lines in owner order; the selection is one row per owner."""
    return selection.agg(ordered_digest(F.collect_list(F.struct(F.col("owner").alias("key"), F.col("revision").alias("value")))).alias("global_version"))


def view_versions(selection: DataFrame) -> DataFrame:
    """(owner, version) of each owner's view, and of the global one under a null owner; who is not selected has version ""."""
    return selection.select("owner", F.col("revision").alias("version")).unionByName(global_version(selection).select(F.lit(None).cast("string").alias("owner"), F.col("global_version").alias("version")))


def checked_view(selection: DataFrame, owner: str | None, version: str) -> None:
    """A cursor's view must still be the present one."""
    rows = view_versions(selection).where(F.col("owner").eqNullSafe(F.lit(owner).cast("string"))).select("version").collect()
    if (rows[0][0] if rows else "") != version:
        raise invalid("the view has changed since the cursor")


def document_page(operation: str, documents: DataFrame, selection: DataFrame, key: bytes, owner: str | None = None, query: str | None = None, limit: int = 10, token: str | None = None) -> tuple[list[Row], str | None]:
    """Rows of a page of ``list`` or ``search``, and the cursor of the next one, if there is one.

    The cursor is authenticated and bound to the request and to the version of the view that it was made from: once the
    owner's revision, or for all owners the global version, is another one, it has expired.  It names the next row.
    """
    if operation not in ("list", "search") or (operation == "search") == (query is None):
        raise invalid("operation")
    found = view_versions(selection).where(F.col("owner").eqNullSafe(F.lit(owner).cast("string"))).select("version").collect()
    bound = cursor.binding(f"documents.{operation}", owner=owner, query=query, limit=limit, version=found[0][0] if found else "")
    position = None if token is None else cursor.decode(token, bound, key)
    checked_limit(limit, DOCUMENT_PAGE_MOST)
    # a row more than the page has: the place of the next page
    if operation == "list":
        rows = _listed(documents, owner, limit + 1, position and position[0]).collect()
    else:
        rows = _searched(documents, query, owner, limit + 1, position).collect()
    after_ = rows[limit] if len(rows) > limit else None
    return rows[:limit], None if after_ is None else cursor.encode(bound, [after_["path"]] if operation == "list" else [after_["path"], after_["start_line"]], key)


def operation_fingerprint(operations: DataFrame) -> DataFrame:
    """(operation_id, fingerprint) of (operation_id, path, change, content_digest): a retry of the same changes has the same one."""
    lines_ = F.collect_list(F.struct(F.col("path").alias("key"), F.concat_ws(":", "change", "content_digest").alias("value")))
    return operations.groupBy("operation_id").agg(ordered_digest(lines_).alias("fingerprint"))


def section_totals(found: DataFrame) -> DataFrame:
    """Of sections (path, owner, start_line, bytes): sections and the largest one of each document, first of equal ones."""
    return found.groupBy("owner", "path").agg(F.count("*").alias("sections"), F.sum("bytes").alias("bytes"), F.max_by("start_line", F.struct("bytes", -F.col("start_line"))).alias("largest"))


def over_budget(totals: DataFrame, documents: int, size: int, sections_: int) -> DataFrame:
    """Owners with more documents, bytes or sections than their budget."""
    by = totals.groupBy("owner").agg(F.count("*").alias("documents"), F.sum("bytes").alias("bytes"), F.sum("sections").alias("sections"))
    reason = F.when(F.col("documents") > documents, "DOCUMENTS").when(F.col("bytes") > size, "BYTES").when(F.col("sections") > sections_, "SECTIONS")
    return by.withColumn("over", reason)


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """ADDED, REMOVED and UPDATED paths between two versions of (path, content_digest)."""
    o = old.select("path", F.col("content_digest").alias("old"))
    n = new.select("path", F.col("content_digest").alias("new"))
    both = o.join(n, "path", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select("path", F.when(F.col("old").isNull(), "ADDED").when(F.col("new").isNull(), "REMOVED").otherwise("UPDATED").alias("change"))


def last_good(attempts: DataFrame) -> DataFrame:
    """Of (owner, seq, revision, accepted) the revision that each owner serves: the last accepted one; later rejections are told."""
    return attempts.groupBy("owner").agg(
        F.max_by("revision", F.when(F.col("accepted"), F.col("seq"))).alias("served"), F.max(F.when(F.col("accepted"), F.col("seq"))).alias("served_seq"), F.max("seq").alias("last_seq")
    ).select("owner", "served", F.when(F.col("served_seq").isNull(), "UNAVAILABLE").when(F.col("served_seq") < F.col("last_seq"), "UPDATE_REJECTED").otherwise("CURRENT").alias("state"))


def selection_misses(selection: DataFrame, cached: DataFrame) -> DataFrame:
    """Owners whose selected revision is not cached, grouped by revision."""
    return selection.join(cached, ["owner", "revision"], "left_anti").groupBy("revision").agg(F.array_sort(F.collect_list("owner")).alias("owners"))

