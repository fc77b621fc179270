"""Reading sources: views, windows and pages that may end within a line, for any number of files at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.text import lines
from quarrylight.model import ELIDE_LEAST, FILE_MOST, READ_BYTES_MOST, READ_LINES_DEFAULT, READ_LINES_MOST, READ_SEGMENTS_MOST, RESPONSE_BYTES_MOST, SUMMARY_LINES, VIEWS, QueryError, invalid
from quarrylight.operators.files import elided_segments

#: Bytes of a segment's fields in a response beside its text, at most.
SEGMENT_FRAME = 192
_SEGMENT = ["segment", "start_byte", "end_byte", "start_line", "end_line", "content", "starts_mid_line", "ends_mid_line"]


def summary_outcome(view: str, selector: bool, path: Column, byte_length: Column, total_lines: Column, file_status: Column, elisions: Column) -> Column:
    """Why a file is shown in summary or not; ``file_status`` is the parser's, null without an index."""
    if view not in VIEWS:
        raise invalid("view")
    if view == "RAW" or selector and view == "AUTO":
        return F.lit("NOT_REQUESTED")
    out = F.when(~path.endswith(".java"), "UNSUPPORTED_LANGUAGE").when(byte_length > FILE_MOST, "FILE_TOO_LARGE")
    if view == "AUTO":
        out = out.when(total_lines < SUMMARY_LINES, "BELOW_SUMMARY_THRESHOLD")
    for status, outcome in (("PARSE_FAILED", "FILE_PARSE_FAILED"), ("UNSUPPORTED", "FILE_UNSUPPORTED"), ("TOO_LARGE", "FILE_TOO_LARGE")):
        out = out.when(file_status == status, outcome)
    return out.when(file_status.isNull(), "INDEX_NOT_READY").when(elisions > 0, "ELIDED").otherwise("NO_ELISION")


def line_bytes(files: DataFrame) -> DataFrame:
    """(path, line, text, start_byte): each line with its line feed, and where it begins."""
    text = F.col("text")
    each = F.transform(lines(text), lambda t: F.concat(t, F.lit("\n")))
    rows = files.select("path", (~text.endswith("\n")).alias("open"), F.size(each).alias("total"), F.posexplode(each).alias("i", "text"))
    rows = rows.select("path", (F.col("i") + 1).alias("line"), F.when(F.col("open") & (F.col("i") + 1 == F.col("total")), F.expr("left(text, char_length(text) - 1)")).otherwise(F.col("text")).alias("text"))
    before = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start_byte", F.coalesce(F.sum(F.octet_length("text").cast("long")).over(before), F.lit(0)))


def windows_of(files: DataFrame, ranges: list[tuple[int, int]] | None = None, bodies: DataFrame | None = None) -> DataFrame:
    """(path, segment, first_line, last_line): what is to be read of each file, bodies left out if there are any."""
    total = files.select("path", F.size(lines(F.col("text"))).alias("total")).where("total > 0")
    chosen = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ranges)) if ranges is not None else F.array(F.struct(F.lit(1).alias("a"), F.col("total").alias("b")))
    own = total.select("path", "total", F.explode(chosen).alias("r")).where(F.col("r.a") <= F.col("total"))
    own = own.select("path", F.col("r.a").alias("start_line"), F.least("r.b", "total").alias("end_line"))
    if bodies is None:
        return own.select("path", F.lit("SOURCE").alias("segment"), F.col("start_line").alias("first_line"), F.col("end_line").alias("last_line"))
    return elided_segments(own, bodies, ELIDE_LEAST).select("path", "segment", F.col("start_line").alias("first_line"), F.col("end_line").alias("last_line"))


def utf8_cut(s: Column, most: Column) -> Column:
    """The longest prefix of at most ``most`` bytes that splits no character."""
    data = F.encode(s, "UTF-8")
    # a byte of the form 10xxxxxx goes on with a character that began before; at most three of them follow each other
    goes_on = lambda n: F.hex(F.substring(data, (n + 1).cast("int"), F.lit(1))).rlike("^[89AB]")
    n = F.when(~goes_on(most), most)
    for back in (1, 2, 3):
        n = n.when(~goes_on(most - back), most - back)
    return F.when(F.octet_length(s) <= most, s).when(most <= 0, "").otherwise(F.decode(F.substring(data, F.lit(1), F.greatest(n, F.lit(0)).cast("int")), "UTF-8"))


def read_pages(files: DataFrame, windows: DataFrame, offsets: DataFrame | None = None, max_lines: int = READ_LINES_DEFAULT, max_bytes: int = READ_BYTES_MOST, max_segments: int = READ_SEGMENTS_MOST) -> DataFrame:
    """One page of each file: its segments, why it stops, and where the next one begins (null after the last).

    ``offsets(path, offset)`` are the places that earlier pages gave.  A page holds whole characters; a line
    that does not fit is cut, and the next page goes on within it.  Lines, bytes and segments are counted by
    running sums over the lines of a file, so files are read independently of each other.
    """
    if not 1 <= max_lines <= READ_LINES_MOST or max_bytes < 4 or max_segments < 1:
        raise invalid("limit")
    own = line_bytes(files).join(windows.where("segment = 'SOURCE'").select("path", "first_line", "last_line"), "path").where(F.col("line").between(F.col("first_line"), F.col("last_line")))
    own = own.select("path", "first_line", F.lit("SOURCE").alias("segment"), "line", "text", "start_byte", (F.col("start_byte") + F.octet_length("text")).alias("end_byte"))
    hidden = windows.where("segment = 'ELISION'").select("path", "first_line", "last_line")
    # all lines of a body are one row: nothing of it is read
    skipped = line_bytes(files).join(hidden, "path").where(F.col("line").between(F.col("first_line"), F.col("last_line")))
    skipped = skipped.groupBy("path", "first_line").agg(F.max("line").alias("line"), F.min("start_byte").alias("start_byte"), F.max(F.col("start_byte") + F.octet_length("text")).alias("end_byte"))
    own = own.unionByName(skipped.select("path", "first_line", F.lit("ELISION").alias("segment"), "line", F.lit("").alias("text"), "start_byte", "end_byte"))
    if offsets is not None:
        own = own.join(offsets.where(F.col("offset").isNotNull()), "path").where(F.col("end_byte") > F.col("offset"))
        cut = F.greatest(F.col("offset") - F.col("start_byte"), F.lit(0)).cast("int")
        within = (cut > 0) & (F.col("segment") == "SOURCE")
        own = own.withColumn("mid", within).withColumn("text", F.when(within, F.decode(F.expr("substring(encode(text, 'UTF-8'), int(offset - start_byte) + 1)"), "UTF-8")).otherwise(F.col("text"))).withColumn("start_byte", F.when(within, F.col("offset")).otherwise(F.col("start_byte"))).drop("offset")
    else:
        own = own.withColumn("mid", F.lit(False))
    by = Window.partitionBy("path").orderBy("first_line", "line")
    to = by.rowsBetween(Window.unboundedPreceding, 0)
    source = (F.col("segment") == "SOURCE").cast("int")
    rows = own.withColumn("size", F.octet_length("text").cast("long")).withColumn("used", F.sum("size").over(to)).withColumn("n_lines", F.sum(source).over(to))
    rows = rows.withColumn("new", F.coalesce(F.lag("first_line").over(by) != F.col("first_line"), F.lit(True)).cast("int")).withColumn("n_segments", F.sum("new").over(to))
    left = F.lit(max_bytes) - (F.col("used") - F.col("size"))
    part = F.when(F.col("n_lines") <= max_lines, utf8_cut(F.col("text"), left)).otherwise("")
    width = F.octet_length(F.substring("text", 1, 1))
    over = F.when(F.col("n_segments") > max_segments, "SEGMENT_BUDGET").when(F.col("segment") == "ELISION", None)
    over = over.when((F.col("n_lines") > max_lines) & (left >= width), "LINE_BUDGET").when((F.col("n_lines") > max_lines) | (F.col("used") > max_bytes), "CONTENT_BUDGET")
    rows = rows.withColumn("over", over).withColumn("part", F.when(F.col("over") == "CONTENT_BUDGET", part).otherwise(F.when(F.col("over").isNull(), F.col("text")).otherwise("")))
    # everything after the first row that does not fit belongs to later pages
    rows = rows.withColumn("stops", F.sum(F.col("over").isNotNull().cast("int")).over(to)).where((F.col("stops") == 0) | ((F.col("stops") == 1) & F.col("over").isNotNull()))
    last = F.max(F.when(F.col("over").isNotNull(), F.struct("over", (F.col("start_byte") + F.octet_length("part")).alias("next"), F.when(F.col("segment") == "ELISION", F.col("first_line")).otherwise(F.col("line")).alias("next_line"))))
    # why it stops and what it holds from the same sorted rows, so that they are made once; without a segment a page is one row
    whole = Window.partitionBy("path")
    rows = rows.withColumn("stop", last.over(whole)).withColumn("held", ((F.col("segment") == "ELISION") & F.col("over").isNull()) | (F.octet_length("part") > 0))
    rows = rows.withColumn("any", F.max("held").over(whole)).where(F.col("held") | ~F.col("any"))
    of = lambda value: F.when(F.col("any"), value)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "part"))), lambda x: x["part"]), "")
    found = rows.groupBy("path", of(F.col("first_line")).alias("first_line"), of(F.col("segment")).alias("segment")).agg(
        F.max("stop").alias("stop"), F.min(of(F.col("start_byte"))).alias("start_byte"), F.max(of(F.when(F.col("segment") == "ELISION", F.col("end_byte")).otherwise(F.col("start_byte") + F.octet_length("part")))).alias("end_byte"),
        F.min(of(F.when(F.col("segment") == "ELISION", F.col("first_line")).otherwise(F.col("line")))).alias("start_line"), F.max(of(F.col("line"))).alias("end_line"), text.alias("content"),
        F.bool_or(of(F.col("mid"))).alias("starts_mid_line"), F.bool_or(of(F.col("over").isNotNull())).alias("ends_mid_line"))
    found = found.withColumn("content", F.when(F.col("segment") == "SOURCE", F.col("content")))
    return found.select("path", *_SEGMENT, F.coalesce("stop.over", F.lit("COMPLETE")).alias("stop_reason"), F.col("stop.next").alias("next_byte"), F.col("stop.next_line").alias("next_line"))


def wire_size(content: Column) -> Column:
    """Bytes of a segment in a JSON response: its text with escapes, and SEGMENT_FRAME for everything else."""
    text = F.coalesce(content, F.lit(""))
    two = F.length(F.regexp_replace(text, r"[^\"\\\\\n\r\t\x08\f]", ""))
    six = F.length(F.regexp_replace(text, r"[^\x00-\x07\x0b\x0e-\x1f]", ""))
    return (F.octet_length(text) + two + 5 * six + SEGMENT_FRAME).cast("long")


def fitting_prefix(content: Column, room: Column) -> Column:
    """The longest prefix whose JSON form takes at most ``room`` bytes: a running sum over its characters."""
    size = lambda c: F.octet_length(c) + F.when(c.rlike(r"[\"\\\\\n\r\t\x08\f]"), 1).when(c.rlike(r"[\x00-\x07\x0b\x0e-\x1f]"), 5).otherwise(0)
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(acc: Column, c: Column) -> Column:
        used = acc["used"] + size(c)
        fits = acc["open"] & (used <= room)
        return F.struct(used.alias("used"), (acc["n"] + fits.cast("int")).alias("n"), fits.alias("open"))

    n = F.aggregate(F.split(content, ""), start, step, lambda acc: acc["n"])
    return F.substring(content, F.lit(1), n)


def fit_envelope(pages: DataFrame, envelope: int) -> DataFrame:
    """Of ``read_pages`` for any number of files the largest pages whose responses fit ``envelope`` bytes.

    Running sums of encoded sizes say how many whole segments fit.  Where not even the first does, it is cut within; where
    nothing of it fits, the page has no segment and no place to go on.  A page made smaller stops with WIRE_BUDGET.
    """
    by = Window.partitionBy("path").orderBy("start_byte")
    rows = pages.withColumn("size", wire_size(F.col("content")))
    rows = rows.withColumn("used", F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("k", F.row_number().over(by))
    whole = F.max("used").over(Window.partitionBy("path")) <= envelope
    fits = F.col("used") <= envelope
    beyond = F.min(F.when(~fits, F.struct("start_byte", "start_line"))).over(Window.partitionBy("path"))  # the first that does not fit
    rows = rows.withColumn("beyond", beyond)
    cut = ~fits & (F.col("k") == 1) & (F.col("segment") == "SOURCE")
    rows = rows.withColumns({"whole": whole, "cut": F.coalesce(cut, F.lit(False))}).where(fits | F.col("cut") | F.col("segment").isNull() | (F.col("k") == 1))
    short = F.when(F.col("cut"), fitting_prefix(F.col("content"), F.lit(envelope - SEGMENT_FRAME)))
    rows = rows.withColumn("short", short)
    rows = rows.withColumn("content", F.when(F.col("cut"), F.col("short")).otherwise(F.col("content"))).withColumn("end_byte", F.when(F.col("cut"), F.col("start_byte") + F.octet_length("short")).otherwise(F.col("end_byte")))
    # the line on which a cut segment ends, and whether it ends within that line
    feeds = F.length(F.regexp_replace("content", "[^\n]", "")) - F.endswith("content", F.lit("\n")).cast("int")
    rows = rows.withColumn("ends_mid_line", F.when(F.col("cut"), ~F.endswith("content", F.lit("\n"))).otherwise(F.col("ends_mid_line"))).withColumn("end_line", F.when(F.col("cut"), (F.col("start_line") + feeds).cast("int")).otherwise(F.col("end_line")))
    none = (F.col("cut") & (F.col("content") == "")) | (~fits & ~F.col("cut"))
    for c in ("segment", "start_byte", "end_byte", "start_line", "end_line", "content", "starts_mid_line", "ends_mid_line"):
        rows = rows.withColumn(c, F.when(F.coalesce(none, F.lit(False)), None).otherwise(F.col(c)))
    smaller = ~F.col("whole")
    after = F.when(F.col("cut"), F.col("end_line") + F.when(F.col("ends_mid_line"), 0).otherwise(1)).otherwise(F.col("beyond.start_line"))
    return rows.select(
        "path", *_SEGMENT, F.when(smaller, "WIRE_BUDGET").otherwise(F.col("stop_reason")).alias("stop_reason"), F.when(smaller & F.col("segment").isNotNull(), F.when(F.col("cut"), F.col("end_byte")).otherwise(F.col("beyond.start_byte"))).otherwise(F.when(~smaller | F.col("whole").isNull(), F.col("next_byte"))).alias("next_byte"),
        F.when(smaller & F.col("segment").isNotNull(), after).otherwise(F.when(~smaller | F.col("whole").isNull(), F.col("next_line"))).alias("next_line"))


def viewed(files: DataFrame, view: str, statuses: DataFrame | None = None, bodies: DataFrame | None = None, ranges: list[tuple[int, int]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(outcomes, windows) of files for a view: what ``read_pages`` is to read, and why a file is shown in summary or not.

    statuses: (path, status) of an index, none if no index was asked for; bodies: (path, open_line, close_line), none if it has no
    folds.  Bodies are left out only of files whose outcome is ELIDED; all others are read as they are.
    """
    rows = files.select("path", F.octet_length("text").cast("long").alias("byte_length"), F.size(lines(F.col("text"))).alias("total"))
    status = F.lit(None).cast("string")
    if statuses is not None:
        rows = rows.join(statuses.select("path", F.col("status").alias("file_status")), "path", "left")
        status = F.col("file_status")
    n = F.lit(0)
    if bodies is not None:
        long_ones = bodies.where(F.col("close_line") - F.col("open_line") - 1 >= ELIDE_LEAST).groupBy("path").agg(F.count(F.lit(1)).alias("elisions"))
        rows = rows.join(long_ones, "path", "left")
        n = F.coalesce("elisions", F.lit(0))
    outcome = summary_outcome(view, ranges is not None, F.col("path"), F.col("byte_length"), F.col("total"), status, n)
    if statuses is None:
        outcome = F.when(outcome == "INDEX_NOT_READY", "INDEX_UNAVAILABLE").otherwise(outcome)
    elif bodies is None:
        outcome = F.when(outcome == "NO_ELISION", "FOLD_METADATA_UNAVAILABLE").otherwise(outcome)
    found = rows.select("path", outcome.alias("outcome"))
    plain = windows_of(files, ranges)
    if bodies is None:
        return found, plain
    shown = found.where("outcome = 'ELIDED'").select("path")
    short = windows_of(files.join(shown, "path", "left_semi"), ranges, bodies.join(shown, "path", "left_semi"))
    return found, plain.join(shown, "path", "left_anti").unionByName(short)


def read_source(files: DataFrame, path: str, windows: DataFrame, offset: int | None = None, max_lines: int = READ_LINES_DEFAULT, envelope: int = RESPONSE_BYTES_MOST) -> list[dict]:
    """The page of one file, as segments: the largest that fits the envelope, in one job."""
    one, own = files.where(F.col("path") == path), windows.where(F.col("path") == path)
    places = None if offset is None else one.select("path", F.lit(offset).cast("long").alias("offset"))
    rows = [r.asDict() for r in fit_envelope(read_pages(one, own, places, max_lines), envelope).orderBy("start_byte").collect()]
    if any(r["segment"] is None for r in rows):
        raise QueryError("SOURCE_RESULT_TOO_LARGE")
    return rows
