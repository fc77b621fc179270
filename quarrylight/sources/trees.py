"""Trees of files: reading, classifying and publishing generations."""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions.paths import inventory_key, is_excluded
from quarrylight.model import QueryError

# Fixed value: how pointers to large files begin.
LFS_PREFIX = "version https://git-lfs.github.com/spec/v1"


def blob_status(content: Column) -> Column:
    """Status of a regular file's bytes: encoding is tested first, then NUL bytes, then the pointer form."""
    text = content.cast("string")
    return (
        F.when(~F.is_valid_utf8(text), "UNSUPPORTED_ENCODING")
        .when(F.contains(content, F.lit(bytearray(b"\0"))), "BINARY")
        .when(text.startswith(LFS_PREFIX), "LFS_POINTER")
        .otherwise("TEXT")
    )


def read_tree(spark: SparkSession, root: str, repository_id: str, revision: str) -> DataFrame:
    """(repository_id, revision, path, kind, status, byte_length, content_digest, text) of the files below ``root``.

    Excluded paths are left out; ``root`` is any folder that Spark can read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^[a-z0-9]+:/*", "/", root.rstrip("/"))
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), "^" + re.escape(base) + "/", "")
    rows = files.select(path.alias("path"), "content").where(~is_excluded(F.col("path")))
    status = blob_status(F.col("content"))
    return rows.select(F.lit(repository_id).alias("repository_id"), F.lit(revision).alias("revision"), "path", F.lit("FILE").alias("kind"), status.alias("status"), F.octet_length("content").cast("long").alias("byte_length"),
                       F.when(status == "TEXT", F.sha2("content", 256)).alias("content_digest"), F.when(status == "TEXT", F.col("content").cast("string")).alias("text"))


def with_directories(files: DataFrame) -> DataFrame:
    """An inventory: the files and every directory above one, with keys."""
    plain = files.select("path", "kind", "status", "byte_length")
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    dirs = plain.where(F.size(parts) > 1).select(F.explode(ups).alias("path")).distinct()
    dirs = dirs.select("path", F.lit("DIRECTORY").alias("kind"), F.lit(None).cast("string").alias("status"), F.lit(0).cast("long").alias("byte_length"))
    return plain.unionByName(dirs).withColumn("key", inventory_key(F.col("path"), F.col("kind")))


class Generations:
    """Immutable tables below a root, and small state files, one for each version.

    A generation is written to a folder of its own and becomes visible when a state names it.  A state is
    written under a name that no one else has and then renamed to that of its version, which must not exist
    yet: whoever comes second fails.  The state is that of the highest version, so a crash at any point
    leaves the one before.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        conf = spark._jsc.hadoopConfiguration()
        self._path = hadoop.Path
        self._fs = self._path(self.root).getFileSystem(conf)
        self._names = hadoop.FileContext.getFileContext(self._path(self.root).toUri(), conf)
        self._no_options = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def _versions(self) -> list[int]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.root))]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"state-([0-9]{12})\.json", n)))

    def _bytes(self, name: str) -> bytes:
        source = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source))
        finally:
            source.close()

    def state(self) -> dict:
        versions = self._versions()
        return json.loads(self._bytes(f"state-{versions[-1]:012d}.json")) if versions else {"version": 0, "selected": {}}

    def write(self, tables: dict[str, DataFrame], generation: str, sort: dict[str, list[str]] | None = None) -> None:
        """Tables sorted by the leading columns of their reads, so that row groups can be skipped."""
        for name, df in tables.items():
            order = (sort or {}).get(name)
            (df.sortWithinPartitions(*order) if order else df).write.mode("errorifexists").parquet(f"{self.root}/{generation}/{name}")

    def write_counted(self, tables: dict[str, DataFrame], generation: str, counters: dict[str, dict[str, Column]], most: dict[str, int] | None = None, sort: dict[str, list[str]] | None = None) -> dict[str, int]:
        """Tables as ``write`` makes them, counted while they are written; {"table.counter": value}.

        counters: for each table, aggregates by name; most: the largest values allowed.  The table that goes beyond one is the
        last to be written: the generation is deleted and nothing names it, so the state stays as it was.
        """
        found: dict[str, int] = {}
        for name, df in tables.items():
            seen = Observation(f"{generation}-{name}")
            self.write({name: df.observe(seen, *(c.alias(k) for k, c in counters[name].items()))}, generation, sort)
            found |= {f"{name}.{k}": v or 0 for k, v in seen.get.items()}
            over = sorted(k for k, v in (most or {}).items() if found.get(k, 0) > v)
            if over:
                self._fs.delete(self._path(f"{self.root}/{generation}"), True)
                raise QueryError("CAPACITY_EXCEEDED", ", ".join(f"{k}={found[k]}" for k in over))
        return found

    def _written(self, state: dict) -> object:
        """A state under a name of its own, complete on disk."""
        own = self._path(f"{self.root}/.state-{uuid.uuid4().hex}.tmp")
        out = self._fs.create(own, False)
        out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        out.hsync()
        out.close()
        return own

    def publish(self, key: str, generation: str, expected: int) -> int:
        """Selects a generation; fails if the state has moved on since version ``expected``."""
        state = self.state()
        if state["version"] != expected:
            raise QueryError("CONFLICT", f"state is at version {state['version']}")
        own = self._written({"version": expected + 1, "selected": {**state["selected"], key: generation}})
        try:
            self._names.rename(own, self._path(f"{self.root}/state-{expected + 1:012d}.json"), self._no_options)
        except Py4JJavaError as e:
            self._fs.delete(own, False)
            raise QueryError("CONFLICT", f"version {expected + 1} exists") from e
        return expected + 1

    def prune(self, keep: int = 10) -> None:
        """Deletes the states before the last few; readers hold a state only while they plan."""
        for v in self._versions()[:-keep]:
            self._fs.delete(self._path(f"{self.root}/state-{v:012d}.json"), False)

    def read(self, key: str, table: str) -> DataFrame:
        generation = self.state()["selected"].get(key)
        if generation is None:
            raise QueryError("INDEX_NOT_PREPARED", key)
        return self.spark.read.parquet(f"{self.root}/{generation}/{table}")


def registry_rows(spark: SparkSession, path: str, allowed: list[str] | None = None) -> DataFrame:
    """A JSON array of descriptors: allow-listed, in id order; duplicate ids are an error."""
    schema = "repositoryId string, displayName string, defaultBranch string, projectGuidePath string"
    rows = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    if allowed is not None:
        rows = rows.where(F.col("repositoryId").isin(*allowed))
    if rows.groupBy("repositoryId").count().where("count > 1").limit(1).count():
        raise QueryError("REGISTRY_INVALID", "duplicate repository")
    return rows.orderBy("repositoryId")
