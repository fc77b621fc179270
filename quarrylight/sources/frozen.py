"""Inputs frozen by content: each stored once under its digest, and a digest of the plan that names them."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.model import invalid


def place_of(digest: str) -> str:
    return f"{digest[:2]}/{digest}"


def freeze(inputs: DataFrame, root: str, most: int | None = None) -> DataFrame:
    """(name, digest, byte_length, fault) of inputs (name, content), each stored below ``root`` under its digest.

    Tasks store what they read: under a name of their own, then by a move to that of the digest.  Equal contents meet under one
    name; what is stored already is compared, not overwritten.  Inputs over ``most`` bytes are faults and are not stored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pyarrow.fs.FileSystem.from_uri(root)
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py()
                if data is None or most is not None and len(data) > most:
                    rows.append((name, None, None if data is None else len(data), "MISSING" if data is None else "CAPACITY"))
                    continue
                digest = hashlib.sha256(data).hexdigest()
                to = f"{base}/{place_of(digest)}"
                info = system.get_file_info(to)
                if info.is_file and info.size == len(data):
                    with system.open_input_stream(to) as held:
                        same = held.read() == data
                else:
                    system.create_dir(f"{base}/{digest[:2]}", recursive=True)
                    own = f"{base}/.{uuid.uuid4().hex}.part"
                    with system.open_output_stream(own) as out:
                        out.write(data)
                    system.move(own, to)
                    same = True
                rows.append((name, digest, len(data), None if same else "IDENTITY"))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.string()))], ["name", "digest", "byte_length", "fault"]) if rows else pa.RecordBatch.from_pylist([], pa.schema([("name", pa.string()), ("digest", pa.string()), ("byte_length", pa.int64()), ("fault", pa.string())]))

    return inputs.select(F.col("name").cast("string").alias("name"), F.col("content").cast("binary").alias("content")).mapInArrow(run, "name string, digest string, byte_length long, fault string")


def stored(spark: SparkSession, root: str) -> DataFrame:
    """(digest, byte_length, actual) of all that is stored: ``actual`` is measured anew; an empty content has no bytes to read and no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.substring_index("path", "/", -1).alias("digest"), F.octet_length("content").cast("long").alias("byte_length"), F.sha2("content", 256).alias("actual")).where(~F.startswith("digest", F.lit(".")))


def plan_digest(inputs: DataFrame, **settings: str | int) -> Column:
    """Aggregate over (ordinal, id, digest, byte_length): SHA-256 of the plan as JSON with sorted keys, whatever order rows come in."""
    row = F.struct(F.col("ordinal").cast("long").alias("ordinal"), F.to_json(F.struct("byte_length", "digest", "id", F.col("ordinal").cast("long").alias("ordinal"))).alias("json"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["json"]), ",")
    head = F.concat(F.lit('{"dependencies":['), rows, F.lit("]"), *(F.concat(F.lit(f',"{k}":'), F.lit(str(v) if isinstance(v, int) else '"' + v + '"')) for k, v in sorted(settings.items())), F.lit("}"))
    return F.sha2(head, 256)


def checked_plan(inputs: DataFrame, most: int = 128) -> DataFrame:
    """The inputs of a plan, at most ``most`` of them with distinct ordinals and ids."""
    found = inputs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ordinal").alias("o"), F.count_distinct("id").alias("i")).first()
    if found.n > most or found.o < found.n or found.i < found.n:
        raise invalid("inputs")
    return inputs
