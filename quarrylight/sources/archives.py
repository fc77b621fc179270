"""Archives of classes as a data source: a partition for each archive, entries found by the central directory.

``spark.read.format("archive_classes").load(folder)`` lists ``*.jar`` in name order, which is the order in which
artifacts are searched.  A reader seeks to the directory at the end of its archive and inflates the classes it
returns, nothing else; conditions on artifacts leave out whole archives, conditions on names all other entries.
Folders are URIs that Arrow's file systems open (local, HDFS, object stores), with random access.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from quarrylight.sources.tables import by_key

# Bytes of a class, class file versions and releases that are read.
CLASS_BYTES_MOST = 1 << 20
MAJOR_MOST = 65
RELEASE_MOST = 21
RELEASE_LEAST = 9
#: Rows of a batch that a reader returns.
BATCH = 4096
#: Bytes after the tag of a constant; a string says its own length.
_CONSTANT_BYTES = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}

SCHEMA = "artifact string, artifact_order int, entry string, binary_name string, version int, multi_release boolean, byte_length long, major int, fault string"
_ARROW = pa.schema([("artifact", pa.string()), ("artifact_order", pa.int32()), ("entry", pa.string()), ("binary_name", pa.string()), ("version", pa.int32()), ("multi_release", pa.bool_()), ("byte_length", pa.int64()), ("major", pa.int32()), ("fault", pa.string())])


class ClassFormat(ValueError):
    """The bytes are no class file."""


def class_identity(data: bytes) -> tuple[str, int, int]:
    """(binary name, major, minor) of a class file, read up to its own name."""
    try:
        magic, minor, major, count = struct.unpack_from(">IHHH", data)
        if magic != 0xCAFEBABE:
            raise ClassFormat("magic")
        at, index, texts, classes = 10, 1, {}, {}
        while index < count:
            tag = data[at]
            if tag == 1:
                (size,) = struct.unpack_from(">H", data, at + 1)
                texts[index] = data[at + 3 : at + 3 + size]
                at += 3 + size
            elif tag in _CONSTANT_BYTES:
                if tag == 7:
                    (classes[index],) = struct.unpack_from(">H", data, at + 1)
                at += 1 + _CONSTANT_BYTES[tag]
            else:
                raise ClassFormat(f"constant {tag}")
            index += 2 if tag in (5, 6) else 1
        (own,) = struct.unpack_from(">H", data, at + 2)
        return texts[classes[own]].decode().replace("/", "."), major, minor
    except (struct.error, IndexError, KeyError, UnicodeDecodeError) as e:
        raise ClassFormat(str(e)) from e


def empty_class(binary_name: str, major: int, minor: int = 0) -> bytes:
    """The smallest class file of that name: no members, below the root of all classes."""
    text = lambda s: struct.pack(">BH", 1, len(s.encode())) + s.encode()
    pool = text(binary_name.replace(".", "/")) + struct.pack(">BH", 7, 1) + text("java/lang/Object") + struct.pack(">BH", 7, 3)
    return struct.pack(">IHHH", 0xCAFEBABE, minor, major, 5) + pool + struct.pack(">7H", 0x21, 2, 4, 0, 0, 0, 0)


def place(name: str) -> tuple[str | None, int, str | None]:
    """(binary name, version, fault) of an entry; no name for what is no class and breaks no rule."""
    parts = name.split("/")
    if name.startswith("/") or any(c in name for c in "\\:") or "//" in name or any(ord(c) < 32 or 127 <= ord(c) < 160 for c in name) or {".", ".."} & set(parts):
        return None, 0, "UNSAFE_ENTRY"
    if parts[0] in ("BOOT-INF", "WEB-INF") and len(parts) > 1 or name.endswith(".jar"):
        return None, 0, "NESTED_LAYOUT"
    if not name.endswith(".class"):
        return None, 0, None
    version = 0
    if name.startswith("META-INF/versions/"):
        release, _, rest = name[len("META-INF/versions/") :].partition("/")
        if not rest or not release.isascii() or not release.isdigit() or int(release) < RELEASE_LEAST:
            return None, 0, "INVALID_VERSION"
        version, name = int(release), rest
    elif name.startswith("META-INF/"):
        return None, 0, "CLASS_LAYOUT"
    return (None if name == "module-info.class" else name[: -len(".class")].replace("/", ".")), version, None


def _is_multi_release(archive: zipfile.ZipFile) -> bool:
    try:
        info = archive.getinfo("META-INF/MANIFEST.MF")
    except KeyError:
        return False
    if info.file_size > CLASS_BYTES_MOST:
        return False
    main = archive.read(info).decode(errors="replace").replace("\r\n", "\n").split("\n\n")[0].replace("\n ", "")
    return any(k.strip().lower() == "multi-release" and v.strip().lower() == "true" for k, _, v in (x.partition(":") for x in main.split("\n")))


class _Archive(InputPartition):
    def __init__(self, order: int, path: str, name: str):
        super().__init__(order)
        self.order, self.path, self.name = order, path, name


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder
        self.names: set[str] | None = None
        self.orders: list[tuple[type, int]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Names and orders are taken here; whatever else is left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("binary_name",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = wanted if self.names is None else self.names & wanted
            elif isinstance(f, (EqualTo, LessThan, LessThanOrEqual, GreaterThan, GreaterThanOrEqual)) and f.attribute == ("artifact_order",):
                self.orders.append((type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, path = pyarrow.fs.FileSystem.from_uri(self.folder)
        found = system.get_file_info(pyarrow.fs.FileSelector(path))
        jars = sorted((f.path, f.base_name) for f in found if f.is_file and f.base_name.endswith(".jar"))
        tests = {EqualTo: int.__eq__, LessThan: int.__lt__, LessThanOrEqual: int.__le__, GreaterThan: int.__gt__, GreaterThanOrEqual: int.__ge__}
        return [_Archive(i, p, n) for i, (p, n) in enumerate(jars) if all(tests[t](i, v) for t, v in self.orders)] or [_Archive(-1, "", "")]

    def read(self, partition: _Archive) -> Iterator[pa.RecordBatch]:
        if partition.order < 0:
            return
        system, _ = pyarrow.fs.FileSystem.from_uri(self.folder)
        rows: list[tuple] = []
        with system.open_input_file(partition.path) as file, zipfile.ZipFile(file) as archive:
            multi, seen = _is_multi_release(archive), set()
            for info in archive.infolist():
                name, version, fault = place(info.filename)
                if info.filename in seen:
                    fault = "DUPLICATE_ENTRY"
                seen.add(info.filename)
                if name is None and fault is None or self.names is not None and name not in self.names:
                    continue
                major = None
                if fault is None and version and (not multi or version > RELEASE_MOST):
                    continue
                if fault is None:
                    fault, major = self._class(archive, info, name)
                rows.append((partition.name, partition.order, info.filename, name, version, multi, info.file_size, major, fault))
                if len(rows) == BATCH:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    @staticmethod
    def _class(archive: zipfile.ZipFile, info: zipfile.ZipInfo, name: str) -> tuple[str | None, int | None]:
        if info.file_size > CLASS_BYTES_MOST:
            return "CLASS_TOO_LARGE", None
        with archive.open(info) as stream:  # what is inflated is bounded, whatever the directory says
            data = stream.read(CLASS_BYTES_MOST + 1)
        if len(data) != info.file_size:
            return "SIZE_MISMATCH", None
        try:
            own, major, minor = class_identity(data)
        except ClassFormat:
            return "CLASS_FORMAT", None
        return ("CLASS_IDENTITY" if own != name else "CLASS_LEVEL" if major > MAJOR_MOST or minor == 65535 else None), major


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


class ArchiveClasses(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_classes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options["path"])


def archive_entries(spark: SparkSession, folder: str) -> DataFrame:
    """All class entries that may be read and all faulty ones, of the archives of a folder."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveClasses)
    return spark.read.format("archive_classes").load(folder)


def write_archives(classes: DataFrame, folder: str) -> None:
    """Archives from rows (artifact, multi_release, entry, class_name, major): stored classes of that name, one archive at a time in each task.

    Rows come sorted by artifact, so a task holds one open archive; an archive gets its name when it is complete.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pyarrow.fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        own, body, archive, n = None, None, None, 0

        def close() -> pa.RecordBatch:
            archive.close()
            with system.open_output_stream(f"{base}/.{own}.part") as out:
                out.write(body.getvalue())
            system.move(f"{base}/.{own}.part", f"{base}/{own}")
            return pa.RecordBatch.from_pydict({"artifact": [own], "entries": [n]})

        for batch in batches:
            for row in batch.to_pylist():
                if row["artifact"] != own:
                    if own is not None:
                        yield close()
                    own, body, n = row["artifact"], io.BytesIO(), 0
                    archive = zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED)
                    archive.writestr(zipfile.ZipInfo("META-INF/MANIFEST.MF"), f"Manifest-Version: 1.0\nMulti-Release: {str(row['multi_release']).lower()}\n\n")
                archive.writestr(zipfile.ZipInfo(row["entry"]), empty_class(row["class_name"], row["major"]))
                n += 1
        if own is not None:
            yield close()

    by_key(classes, "artifact", "entry").mapInArrow(run, "artifact string, entries long").write.format("noop").mode("overwrite").save()


def catalogue(entries: DataFrame) -> DataFrame:
    """(name, binary_name, artifact, artifact_order, version, ...): for each name, binary or with dots, the class that is loaded.

    An archive gives its entry of the highest release, and the first archive that has the name decides.  Both steps are
    one aggregate with a partial step: the least (order, alias, minus release).
    """
    name = F.explode(F.array_distinct(F.array(F.col("binary_name"), F.translate("binary_name", "$", "."))))
    rows = entries.where(F.col("fault").isNull()).select(name.alias("name"), *entries.columns)
    rank = F.struct("artifact_order", F.col("name") != F.col("binary_name"), -F.col("version"), F.col("entry"))
    keep = [c for c in entries.columns if c not in ("fault", "multi_release")]
    return rows.groupBy("name").agg(F.min_by(F.struct(*keep), rank).alias("c")).select("name", "c.*")
