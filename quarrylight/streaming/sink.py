"""A sink of documents for micro-batches: each operation takes effect once, owner by owner.

``DocumentSink.apply`` is a function for ``foreachBatch``.  An operation is the set of its rows; its fingerprint is
kept in a ledger.  An operation that the ledger has with the same fingerprint is a replay and changes nothing; with
another fingerprint it is refused.  What remains is merged into the documents of the owners it touches, and only
their partitions are overwritten.  The ledger is written last: a batch that ends before that is applied again and
gives the same documents, since a change says what a path holds, not how it differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.operators.documents import operation_fingerprint
from quarrylight.sources.tables import written

DOCUMENTS = "path string, content string, content_digest string, removed boolean, operation_id string, owner string"
LEDGER = "operation_id string, fingerprint string, outcome string, batch long"


class DocumentSink:
    """Tables ``documents`` (by owner) and ``ledger`` (by batch) below a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def documents(self) -> DataFrame:
        """(owner, path, content, content_digest, operation_id) of what is published."""
        return self._table("documents", DOCUMENTS).where(~F.col("removed")).select("owner", "path", "content", "content_digest", "operation_id")

    def ledger(self) -> DataFrame:
        return self._table("ledger", LEDGER)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """batch: (operation_id, seq, owner, path, change, content); change is UPSERT or REMOVE, the last change of a path by seq counts."""
        rows = batch.select("operation_id", "seq", "owner", "path", "change", F.when(F.col("change") == "UPSERT", F.coalesce("content", F.lit(""))).alias("content"))
        rows = rows.withColumn("content_digest", F.coalesce(F.sha2("content", 256), F.lit("")))
        prints = operation_fingerprint(rows.drop("content").distinct())  # a digest stands for its content: no text is moved to judge a batch
        past = self.ledger().where(F.col("outcome") == "APPLIED").select("operation_id", F.col("fingerprint").alias("before"), F.col("batch").alias("applied_in"))
        # a batch that is run again after its ledger was written finds its own entries: all of it is a replay
        outcome = F.when(F.col("before").isNull(), "APPLIED").when(F.col("before") == F.col("fingerprint"), "REPLAYED").otherwise("CONFLICT")
        judged = written(prints.join(past, "operation_id", "left").select("operation_id", "fingerprint", outcome.alias("outcome"), "applied_in"), "operations")
        if not judged.where(F.col("outcome") == "APPLIED").isEmpty():
            self._merge(rows.join(judged.where(F.col("outcome") == "APPLIED").select("operation_id"), "operation_id", "left_semi"))
        own = judged.where(~F.col("applied_in").eqNullSafe(batch_id)).select("operation_id", "fingerprint", "outcome", F.lit(batch_id).cast("long").alias("batch"))
        again = judged.where(F.col("applied_in").eqNullSafe(batch_id) & (F.col("outcome") == "REPLAYED")).select("operation_id", "fingerprint", F.lit("APPLIED").alias("outcome"), F.lit(batch_id).cast("long").alias("batch"))
        ledger = written(own.unionByName(again), "ledger")
        ledger.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.root}/ledger")

    def _merge(self, fresh: DataFrame) -> None:
        """The documents of the owners of ``fresh`` with its last changes: each text is moved once and written once."""
        owners = written(fresh.select("owner").distinct(), "owners")  # a table of known size: what it selects is not moved for it
        current = self._table("documents", DOCUMENTS).join(owners, "owner", "left_semi").withColumns({"change": F.lit(None).cast("string"), "seq": F.lit(None).cast(fresh.schema["seq"].dataType), "new": F.lit(False)})
        changes = fresh.withColumns({"removed": F.col("change").eqNullSafe("REMOVE"), "new": F.lit(True)})
        last = Window.partitionBy("owner", "path").orderBy(F.desc("new"), F.desc("seq"), F.desc("operation_id"), F.desc("content_digest"))
        merged = current.unionByName(changes).withColumn("later", F.lag("new").over(last)).where(F.col("later").isNull())
        # tasks write beside the table, and its partitions are replaced when all have ended: they may be read until then
        order = [c.split()[0] for c in DOCUMENTS.split(", ")]
        writer = merged.select(*order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("owner").parquet(f"{self.root}/documents")
