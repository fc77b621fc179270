"""Catalogues of documents: JSON texts, typed and checked row by row, joined to the documents they name.

A catalogue that is no object of the given fields, version and repository gives one fault and no rows.  Its rows are
kept as texts until each is typed by itself, so a bad row is a fault of its own and the others stay.  Faults are rows of a
table, never an error of the job: a strict reader refuses a catalogue that has any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.model import REPOSITORY_ID, SHA256

# Fields, version and bounds of catalogues.
VERSION = 1
CATALOGUE_FIELDS = ("formatVersion", "documentRepositoryId", "documents")
ROW_FIELDS = ("path", "contentDigest", "primaryContext", "relatedContexts", "reviewStatus", "reviewReference")
REVIEW_STATES = ("APPROVED", "DRAFT")
CATALOGUE_BYTES_MOST = 1 << 18
DOCUMENT_BYTES_MOST = 1 << 16
RELATED_MOST = 8

_CONTEXT = "struct<repositoryId:string,revision:string>"
_HEAD = "formatVersion int, documentRepositoryId string, documents array<string>, bad string"
_ROW = f"path string, contentDigest string, primaryContext {_CONTEXT}, relatedContexts array<{_CONTEXT}>, reviewStatus string, reviewReference string, bad string"
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}


def _unknown(text: Column, fields: tuple[str, ...]) -> Column:
    """Whether an object has other fields; what is no object has none."""
    return F.size(F.array_except(F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")), F.array(*map(F.lit, fields)))) > 0


def heads(raw: DataFrame, repository: str) -> DataFrame:
    """(catalogue, rows, fault) of (catalogue, body)."""
    h = F.from_json("body", _HEAD, _OPTIONS)
    rows = raw.select("catalogue", "body", h.alias("h"))
    fault = (
        F.when(F.octet_length("body") > CATALOGUE_BYTES_MOST, "CAPACITY")
        .when(F.col("h").isNull() | F.col("h.bad").isNotNull(), "MALFORMED")
        .when(_unknown(F.col("body"), CATALOGUE_FIELDS), "FIELDS")
        .when(~F.col("h.formatVersion").eqNullSafe(VERSION), "VERSION")
        .when(~F.col("h.documentRepositoryId").eqNullSafe(repository), "REPOSITORY")
        .when(F.col("h.documents").isNull(), "MALFORMED")
    )
    return rows.select("catalogue", F.col("h.documents").alias("rows"), fault.alias("fault"))


def typed_rows(found: DataFrame) -> DataFrame:
    """(catalogue, place, path, content_digest, owner, revision, related, review_status, review_reference, fault) of sound catalogues."""
    each = found.where(F.col("fault").isNull()).select("catalogue", F.posexplode("rows").alias("place", "body"))
    each = each.select("catalogue", "place", "body", F.from_json("body", _ROW, _OPTIONS).alias("r"))
    context = lambda c: c["repositoryId"].rlike(REPOSITORY_ID) & c["revision"].rlike("^[0-9a-f]{40}$")
    others = F.transform("r.relatedContexts", lambda c: c["repositoryId"])
    related = (
        F.col("r.relatedContexts").isNull() | (F.size("r.relatedContexts") > RELATED_MOST) | (F.size(F.array_distinct(others)) < F.size(others)) | F.array_contains(others, F.col("r.primaryContext.repositoryId"))
        | ~F.forall("r.relatedContexts", lambda c: F.coalesce(context(c), F.lit(False)))
    )
    owner = F.col("r.primaryContext.repositoryId")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    fault = (
        F.when(F.col("r").isNull() | F.col("r.bad").isNotNull(), "MALFORMED")
        .when(_unknown(F.col("body"), ROW_FIELDS), "FIELDS")
        .when(no(context(F.col("r.primaryContext"))), "CONTEXT")
        .when(no(F.startswith("r.path", F.concat(F.lit("repositories/"), owner, F.lit("/"))) & F.col("r.path").rlike(r"^repositories/[^/]+/[^/\x00-\x1f]+\.md$")), "PATH")
        .when(no(F.col("r.contentDigest").rlike(SHA256)), "DIGEST_FORM")
        .when(related, "RELATED")
        .when(no(F.col("r.reviewStatus").isin(*REVIEW_STATES)), "REVIEW")
        .when((F.col("r.reviewStatus") == "APPROVED") & no(F.trim("r.reviewReference") != ""), "REVIEW")
    )
    return each.select("catalogue", "place", F.col("r.path").alias("path"), F.col("r.contentDigest").alias("content_digest"), owner.alias("owner"), F.col("r.primaryContext.revision").alias("revision"), F.col("r.relatedContexts").alias("related"),
                       F.col("r.reviewStatus").alias("review_status"), F.col("r.reviewReference").alias("review_reference"), fault.alias("fault"))


def load(raw: DataFrame, blobs: DataFrame, repository: str) -> DataFrame:
    """Every catalogue row and every refused catalogue (place null): its fields, the document's text and the first rule broken.

    raw: (catalogue, body); blobs: (path, content).  A path that a catalogue names twice is a fault of both rows.  Texts are
    joined after all rules that need none, so only rows that may be served meet their texts.
    """
    found = heads(raw, repository)
    rows = typed_rows(found)
    copies = rows.groupBy("catalogue", "path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("catalogue", "path", F.lit(True).alias("twice"))
    rows = rows.join(copies, ["catalogue", "path"], "left").withColumn("fault", F.coalesce("fault", F.when(F.col("twice"), "DUPLICATE"))).drop("twice")
    sound, bad = rows.where(F.col("fault").isNull()), rows.where(F.col("fault").isNotNull())
    data = blobs.select("path", "content", F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("actual"))
    fault = (
        F.when(F.col("actual").isNull(), "MISSING").when(F.col("bytes") > DOCUMENT_BYTES_MOST, "CAPACITY").when(F.col("bytes") == 0, "EMPTY")
        .when(F.col("actual") != F.col("content_digest"), "DIGEST").when(F.contains("content", F.lit("\0")), "CONTROL")
    )
    served = sound.drop("fault").join(data, "path", "left").withColumn("fault", fault)
    served = served.withColumn("content", F.when(F.col("fault").isNull(), F.col("content"))).drop("bytes", "actual")
    refused = found.where(F.col("fault").isNotNull()).select("catalogue", "fault")
    return served.unionByName(bad, allowMissingColumns=True).unionByName(refused, allowMissingColumns=True)
