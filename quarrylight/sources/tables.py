"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    A folder of our own is used only where the setting is missing and everything runs in one JVM.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quarrylight-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def by_key(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """Rows of a key together in one partition, keys one after the other, each in the given order: what a pass over sorted rows needs.

    They are dealt out by a hash of the key.  By the key itself the exchange may be left out where the input seems to lie so
    already; adaptive execution, which does not see what the pass relies on, may then read that input in another way.
    """
    return df.repartition(F.xxhash64(key)).sortWithinPartitions(key, *order)


class InBuckets(NamedTuple):
    """Rows that lie in ``buckets`` partitions by ``key``, to be written as a bucketed table: joins and windows on ``key`` read it where it lies.

    So do those on a union of such tables, if the key takes a new name in front of them: a filter for its nulls, pushed below the
    union, would hide from the planner that the tables lie alike.
    """

    rows: DataFrame
    key: str
    buckets: int


def written(df: DataFrame | InBuckets, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, whatever becomes of an executor."""
    rows = df.rows if isinstance(df, InBuckets) else df
    spark = rows.sparkSession
    table = f"{name}-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    if isinstance(df, InBuckets):
        table = table.replace("-", "_")
        rows.write.format("parquet").bucketBy(df.buckets, df.key).option("path", path).saveAsTable(table)
        return spark.table(table)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
