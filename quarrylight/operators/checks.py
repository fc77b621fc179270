"""Integrity as queries: each returns the rows that break a rule."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.functions import paths
from quarrylight.functions.identity import framed_sha256
from quarrylight.functions.payload import field
from quarrylight.sources.tables import by_key


def inventory_faults(inventory: DataFrame) -> DataFrame:
    """Duplicate keys, excluded or non-canonical paths, files below no directory; ``stored_order_faults`` judges the order."""
    copies = inventory.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("path"), F.lit("DUPLICATE").alias("fault"))
    form = inventory.select("path", F.when(paths.is_excluded(F.col("path")), "EXCLUDED").when(~paths.is_canonical(F.col("path")), "PATH").alias("fault")).where(F.col("fault").isNotNull())
    up = inventory.withColumn("up", paths.parent(F.col("path"))).where(F.col("up") != "")
    dirs = inventory.where(F.col("kind") == "DIRECTORY").select(F.col("path").alias("up"))
    orphans = up.join(dirs, "up", "left_anti").select("path", F.lit("ORPHAN").alias("fault"))
    return copies.unionByName(form).unionByName(orphans)


def stored_segments(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """What each stretch of a stored table's files says of its order: rows FAULT (before, key) and one SEGMENT (first, last, n).

    A task reads its stretches in the order in which they lie in the files, to their end, and compares neighbours; only the
    ends of a stretch are left to be compared with those of the next one.
    """
    rows = spark.read.parquet(folder).select(F.col(key).cast("string").alias("key"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    names = ["kind", "file", "block", "first", "last", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list | None = None  # file, block, first, last, n

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names)

        for batch in batches:
            if not len(batch):
                continue
            keys, files, blocks = batch.columns
            same = pc.and_(pc.equal(files[1:], files[:-1]), pc.equal(blocks[1:], blocks[:-1])) if len(batch) > 1 else pa.array([], pa.bool_())
            begins = [0, *(np.flatnonzero(~np.asarray(same)) + 1).tolist()]
            made = []
            for a, b in zip(begins, [*begins[1:], len(batch)]):
                where, own = (files[a].as_py(), blocks[a].as_py()), keys[a:b]
                if open_ and tuple(open_[:2]) == where:
                    if own[0].as_py() <= open_[3]:
                        made.append(("FAULT", *where, open_[3], own[0].as_py(), None))
                else:
                    if open_:
                        made.append(("SEGMENT", *open_))
                    open_ = [*where, own[0].as_py(), None, 0]
                wrong = pc.indices_nonzero(pc.less_equal(own[1:], own[:-1])).to_pylist() if b - a > 1 else []
                made += [("FAULT", *where, own[i].as_py(), own[i + 1].as_py(), None) for i in wrong]
                open_[3], open_[4] = own[-1].as_py(), open_[4] + b - a
            if made:
                yield out(made)
        if open_:
            yield out([("SEGMENT", *open_)])

    return rows.mapInArrow(run, "kind string, file string, block long, first string, last string, n long")


def stored_order_faults(segments: DataFrame) -> DataFrame:
    """(before, key) of neighbours in a stored table that do not strictly increase, from ``stored_segments`` of it.

    Files follow each other by the number in their names; a row for each stretch is sorted, not the table.
    """
    inside = segments.where(F.col("kind") == "FAULT").select(F.col("first").alias("before"), F.col("last").alias("key"))
    order = Window.orderBy(F.regexp_extract("file", r"part-(\d+)", 1).cast("long"), "file", "block")
    ends = segments.where(F.col("kind") == "SEGMENT").withColumn("before", F.lag("last").over(order))
    return inside.unionByName(ends.where(F.col("first") <= F.col("before")).select("before", F.col("first").alias("key")))


def digest_faults(files: DataFrame) -> DataFrame:
    """Files whose bytes differ from their recorded digest or length."""
    return files.where((F.sha2(F.col("text"), 256) != F.col("content_digest")) | (F.octet_length("text") != F.col("byte_length"))).select("path")


def dangling(children: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Foreign keys without a row on the other side."""
    return children.where(F.col(column).isNotNull()).join(parents.select(F.col(key).alias(column)), column, "left_anti")


def relation_faults(relations: DataFrame) -> DataFrame:
    """Exactly one target; a reason if and only if unresolved; a proper span."""
    both = F.col("target_symbol_id").isNotNull() & F.col("external_target_id").isNotNull()
    neither = F.col("target_symbol_id").isNull() & F.col("external_target_id").isNull()
    fault = F.when(both | neither, "TARGET").when(F.col("unresolved_reason").isNotNull() & F.col("target_symbol_id").isNotNull(), "REASON").when(F.col("end_byte") < F.col("start_byte"), "SPAN")
    return relations.select("relation_id", fault.alias("fault")).where(F.col("fault").isNotNull())


def fact_faults(relations: DataFrame, evidence_kinds: tuple[str, ...]) -> DataFrame:
    """(relation_id, fault): evidence has a framework and nothing else has, it is only ever a candidate, and what is unresolved has a reason."""
    evidence, framework, state = F.col("kind").isin(*evidence_kinds), F.col("framework").isNotNull(), F.col("resolution_state")
    fault = F.when(evidence != framework, "FRAMEWORK").when(framework & (state != "CANDIDATE") | ~framework & (state == "CANDIDATE"), "CANDIDATE").when((state == "UNRESOLVED") != F.col("unresolved_reason").isNotNull(), "REASON")
    return relations.select("relation_id", fault.alias("fault")).where(F.col("fault").isNotNull())


def identity_faults(rows: DataFrame, id_column: str, *fields: str) -> DataFrame:
    """Rows whose stored id is not the digest of its fields."""
    return rows.where(F.col(id_column) != framed_sha256(*(F.col(f) for f in fields)))


def order_faults(rows: DataFrame, partition: str, position: str, key: str) -> DataFrame:
    """Stored sequences that do not strictly increase."""
    w = Window.partitionBy(partition).orderBy(position)
    return rows.withColumn("before", F.lag(key).over(w)).where(F.col("before") >= F.col(key)).drop("before")


def payload_faults(rows: DataFrame, key: str, payload: str, columns: dict[str, str]) -> DataFrame:
    """(key, column) where a column differs from the payload it was taken from; columns: name to JSON path."""
    wrong = F.array(*(F.when(~F.col(c).cast("string").eqNullSafe(field(F.col(payload), path)), F.lit(c)) for c, path in sorted(columns.items())))
    return rows.select(key, F.explode(F.array_compact(wrong)).alias("column"))


_ESCAPE = re.compile(r"(?<!\\)((?:\\\\)*)\\u+([0-9a-fA-F]{4})")


def unescaped(text: str) -> str:
    """A source text with its Unicode escapes as the characters they stand for; an escaped backslash begins none."""
    plain = _ESCAPE.sub(lambda m: m[1] + chr(int(m[2], 16)), text)
    return plain.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def span_faults(files: DataFrame, spans: DataFrame) -> DataFrame:
    """(span_id, fault) of spans (span_id, path, start_byte, end_byte, start_line) that are no part of their file's text.

    Where spans have (name, name_start_byte, name_end_byte), the bytes there must spell the name, with escapes read.  Files and
    spans pass by sorted by path, each file before its spans, so a text is sent and measured once however many spans it has.
    """
    named = "name" in spans.columns
    plain = lambda c, t: (F.col(c) if c in spans.columns else F.lit(None)).cast(t)
    places = {"start_byte": "long", "end_byte": "long", "start_line": "long", "name_start_byte": "long", "name_end_byte": "long", "name": "string"}
    key = spans.schema["span_id"].dataType.simpleString()
    own = files.select("path", F.col("text").cast("string").alias("text"), F.lit(None).cast(key).alias("span_id"), *(F.lit(None).cast(t).alias(c) for c, t in places.items()), F.lit(0).alias("turn"))
    asked = spans.select("path", F.lit(None).cast("string").alias("text"), "span_id", *(plain(c, t).alias(c) for c, t in places.items()), F.lit(1).alias("turn"))
    events = by_key(own.unionByName(asked), "path", "turn")

    def judge(data: np.ndarray | None, feeds: np.ndarray, start: int, end: int, line: int, name: tuple) -> str | None:
        if data is None:
            return "FILE"
        if start is None or end is None or start < 0 or end < start or end > len(data):
            return "RANGE"
        inside = lambda at: at < len(data) and data[at] & 0xC0 == 0x80
        if inside(start) or inside(end):
            return "BOUNDARY"
        if int(np.searchsorted(feeds, start)) + 1 != line:
            return "LINE"
        if named:
            said, a, b = name
            if a is None or b is None or not start <= a <= b <= end or inside(a) or inside(b) or unescaped(data[a:b].tobytes().decode("utf-8", "replace")) != said:
                return "NAME"
        return None

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, data, feeds = None, None, np.zeros(0, np.int64)
        for batch in batches:
            ids, found = [], []
            for row in zip(*(batch.column(c).to_pylist() for c in ("path", "span_id", "turn", "start_byte", "end_byte", "start_line", "name", "name_start_byte", "name_end_byte")), batch.column("text")):
                if row[0] != path:
                    path, data = row[0], None
                if row[2] == 0:
                    text = row[9].as_py()
                    data = None if text is None else np.frombuffer(text.encode(), np.uint8)
                    feeds = np.zeros(0, np.int64) if data is None else np.flatnonzero(data == 10)
                elif (fault := judge(data, feeds, *row[3:6], row[6:9])) is not None:
                    ids.append(row[1])
                    found.append(fault)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("span_id").type), pa.array(found, pa.string())], ["span_id", "fault"])

    return events.mapInArrow(sweep, f"span_id {key}, fault string")


def nesting_faults(declarations: DataFrame) -> DataFrame:
    """(symbol_id, fault) of declarations (symbol_id, parent_id, path, start_byte, end_byte) whose parent is none, elsewhere, or not strictly larger."""
    up = declarations.select(F.col("symbol_id").alias("parent_id"), F.col("path").alias("home"), F.col("start_byte").alias("a"), F.col("end_byte").alias("b"), F.lit(True).alias("known"))
    own = declarations.where(F.col("parent_id").isNotNull()).join(up, "parent_id", "left")
    around = (F.col("a") <= F.col("start_byte")) & (F.col("end_byte") <= F.col("b")) & (F.col("b") - F.col("a") > F.col("end_byte") - F.col("start_byte"))
    fault = F.when(F.col("known").isNull(), "PARENT").when(F.col("home") != F.col("path"), "PARENT_PATH").when(~around, "PARENT_RANGE")
    return own.select("symbol_id", fault.alias("fault")).where(F.col("fault").isNotNull())


def revision_faults(inventory: DataFrame, blobs: DataFrame, indexed: DataFrame) -> DataFrame:
    """(path, fault) of a whole revision: all its tables as one tagged union, judged by one aggregate over each path.

    inventory: (path, kind, status, byte_length, content_digest); blobs: (path, byte_length, content_digest), as measured;
    indexed: (path, content_digest), the files that an index covers.
    """
    tagged = lambda df, tag, *c: df.select("path", F.lit(tag).alias("tag"), *((F.col(x) if x in c else F.lit(None)).cast(t).alias(x) for x, t in (("status", "string"), ("byte_length", "long"), ("content_digest", "string"))))
    rows = tagged(inventory.where("kind = 'FILE'"), "INVENTORY", "status", "byte_length", "content_digest").unionByName(tagged(blobs, "BLOB", "byte_length", "content_digest")).unionByName(tagged(indexed, "INDEX", "content_digest"))
    of = lambda tag, c: F.max(F.when(F.col("tag") == tag, F.col(c)))
    n = lambda tag: F.count_if(F.col("tag") == tag)
    each = rows.groupBy("path").agg(
        n("INVENTORY").alias("i"), n("BLOB").alias("b"), n("INDEX").alias("x"), of("INVENTORY", "status").alias("status"), of("INVENTORY", "byte_length").alias("size"), of("INVENTORY", "content_digest").alias("digest"),
        of("BLOB", "byte_length").alias("actual_size"), of("BLOB", "content_digest").alias("actual"), of("INDEX", "content_digest").alias("seen"))
    readable = F.col("status") == "TEXT"
    fault = (
        F.when((F.col("i") > 1) | (F.col("b") > 1) | (F.col("x") > 1), "DUPLICATE").when(F.col("i") == 0, F.when(F.col("b") > 0, "EXTRA_BLOB").otherwise("EXTRA_INDEX"))
        .when(readable & (F.col("b") == 0), "MISSING_BLOB").when(~readable & (F.col("b") > 0), "EXTRA_BLOB").when(readable & ~F.col("size").eqNullSafe(F.col("actual_size")), "LENGTH")
        .when(readable & ~F.col("digest").eqNullSafe(F.col("actual")), "DIGEST").when(readable & (F.col("x") == 0), "NOT_INDEXED").when(~readable & (F.col("x") > 0), "EXTRA_INDEX").when(readable & ~F.col("seen").eqNullSafe(F.col("digest")), "STALE_INDEX")
    )
    return each.select("path", fault.alias("fault")).where(F.col("fault").isNotNull())


def manifest_faults(inventory: DataFrame, manifest: DataFrame) -> DataFrame:
    """(status, stored, counted) where a manifest's counts of files by status (status, n) are not those of its inventory."""
    counted = inventory.where("kind = 'FILE'").groupBy("status").agg(F.count(F.lit(1)).alias("counted"))
    both = manifest.select("status", F.col("n").alias("stored")).join(counted, "status", "full_outer")
    return both.select("status", F.coalesce("stored", F.lit(0)).cast("long").alias("stored"), F.coalesce("counted", F.lit(0)).alias("counted")).where(F.col("stored") != F.col("counted"))


def coverage_faults(stored: DataFrame, computed: DataFrame, dimensions: list[str]) -> DataFrame:
    """Groups whose stored count is not the computed one; missing ones count as 0."""
    s, c = (df.select(*(F.col(d).alias(f"{p}_{d}") for d in dimensions), F.col("n").alias(f"{p}_n")) for df, p in ((stored, "s"), (computed, "c")))
    same = F.lit(True)
    for d in dimensions:
        same = same & F.col(f"s_{d}").eqNullSafe(F.col(f"c_{d}"))
    both = s.join(c, same, "full_outer").withColumns({"stored": F.coalesce("s_n", F.lit(0)), "computed": F.coalesce("c_n", F.lit(0))})
    return both.where(F.col("stored") != F.col("computed")).select(*(F.coalesce(f"s_{d}", f"c_{d}").alias(d) for d in dimensions), "stored", "computed")


def provenance_faults(targets: DataFrame, artifacts: DataFrame, platform: str, platform_digest: str) -> DataFrame:
    """Targets of a module must come from the platform, all others from an approved artifact with that digest."""
    known = artifacts.select("artifact_id", "artifact_digest", F.lit(True).alias("known")).distinct()
    rows = targets.join(known, ["artifact_id", "artifact_digest"], "left")
    fine = F.when(F.col("module").isNotNull(), (F.col("artifact_id") == platform) & (F.col("artifact_digest") == platform_digest)).otherwise(F.coalesce("known", F.lit(False)))
    return rows.where(~fine).select("target_id", F.when(F.col("module").isNotNull(), "PLATFORM").otherwise("ARTIFACT").alias("fault"))


def cross_foot(parts: DataFrame, total: DataFrame) -> DataFrame:
    """One row if a sum of parts (n) differs from a total (n)."""
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("parts")).crossJoin(total.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))).where("parts <> total")  # one row by one row


def target_conflicts(targets: DataFrame) -> DataFrame:
    """External targets with one id and more than one content."""
    payload = F.xxhash64(*[c for c in targets.columns if c != "target_id"])
    return targets.groupBy("target_id").agg(F.count_distinct(payload).alias("n")).where("n > 1")
