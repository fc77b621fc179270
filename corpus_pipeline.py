"""A corpus pipeline of five stages over ``documents``; counted as part of the llm subpackage.

Language ID drops texts without letters, line dedup deletes later copies of long runs
of lines, the n-gram join leaves the first document of each group of near copies, mixing takes
documents once, twice or not at all so that sources meet their targets, and SentencePiece encodes what
was taken.  Rows with a null doc_id are never dropped as copies.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and tables
with further columns, which it leaves out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import jaccard, langid, line_dedup, mixing, sp_codec
from quarrylight.llm.common import Scratch, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text's best language must have at least this share among the learned ones; with a dozen words or so nearly every text has it.
MIN_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null, hold no letter or are even between learned languages; the rest are as they were.

    The score is a share among the learned languages, so texts in other languages and random letters pass.
    """
    docs = docs.select(*COLUMNS)
    model = langid.learn(docs.where(~langid.held_out(F.col("doc_id")) | F.col("doc_id").isNull()))
    found = langid.predict(docs, model, "doc_id", "text", "lang", "source", "n_chars")
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SHARE)).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated runs from the texts and counts their characters anew.

    Null and empty texts stay as they are; the first of repeated runs by doc_id stays, null ids come last;
    repeated rows are one document and get the same text; an empty table gives no rows.
    """
    out = line_dedup.dedup_documents(docs.select(*COLUMNS))
    return out.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies; of rows that share a doc_id each by its text."""
    groups = jaccard.join_rows(docs)
    copies = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id", "text_hash").distinct()
    keyed = docs.select(*COLUMNS).withColumn("text_hash", F.xxhash64("text"))
    return keyed.join(copies, ["doc_id", "text_hash"], "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes.

    Texts without words are never taken; null sources are a source of their own; rows that share doc_id and
    text are taken alike; an empty table gives no rows.
    """
    docs = docs.select(*COLUMNS)
    keep = Scratch(spark, "mix-stage")
    pattern = F.array(F.col("source").cast("string"))
    units = keep.keep(mixing.units_of(docs, pattern), "units")
    table, more, _ = mixing.planned(units, keep)
    rows = docs.withColumn("pattern", pattern).withColumn("place", mixing.order_of(F.col("doc_id").cast("long"), F.col("text"))).withColumn("has_words", mixing.size_of(F.col("text")) > 0)
    taken = mixing.copies(rows, table, more).where(F.col("has_words") & (F.col("copies") > 0))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, checked by decoding them; null and empty texts have none, repeated rows repeated ones."""
    return sp_codec.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    keep = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = keep.keep(stage(spark, docs, sf_dir), name)
        if i:
            keep.drop(STAGES[i - 1][0])
    return docs
