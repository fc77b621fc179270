"""Web archives: write, normalise, read back.

``write_archives`` writes monolithic files: one gzip stream over all records of a file.
``normalise`` inflates each such stream once, rewrites every record as a gzip member of its own and
writes a sidecar index of offsets next to the archive.  ``read_archives`` reads members by the index.
Archives live in the shared folder; a task writes under a name of its own attempt, and only the names
that committed tasks returned are read, so lost executors and repeated tasks leave no trace in results.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes, those with the largest page_id are
responses, the others revisits that refer to it.  Defined results: null html is an empty payload; rows
that share the largest page_id are responses all; a null page_id never is the largest, and a group of
null page_ids has only responses; null urls leave the target header out; payloads of any length are one
record; an empty table gives no rows; other columns play no part.  An archive that ends within a record
or within a gzip stream is an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import Scratch, read, text_or_empty

MIN_REVISIT = 1000
#: A file is closed once it holds so many bytes of records.
FILE_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_CONTROL = re.compile(rb"[\x00-\x20\x7f]")


def with_revisits(pages: DataFrame, keep: Scratch | None = None) -> DataFrame:
    """(page_id, url, html) to (page_id, url, html, payload_digest, refers_to)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty(F.col("html")).alias("html"))
    rows = rows.withColumn("payload_digest", F.sha1(F.encode("html", "UTF-8")))
    # the groups of copies are found on digests alone
    groups = rows.where(F.octet_length("html") >= MIN_REVISIT).groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    groups = groups.where((F.col("n") > 1) & F.col("first").isNotNull()).drop("n")
    if keep:
        # a table by itself: where very many pages are equal, their side of the join can be split
        groups = keep.keep(groups, "groups")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(groups, "payload_digest", "left").select("page_id", "url", "html", "payload_digest", refers.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC 1.1 record; a revisit holds the HTTP header and no payload."""
    b32 = base64.b32encode(bytes.fromhex(digest))
    block = _HTTP % len(payload)
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Date: " + DATE.encode(), b"WARC-Record-ID: <urn:page:%s>" % (b"" if page_id is None else str(page_id).encode())]
    if url is not None:
        head.append(b"WARC-Target-URI: " + _CONTROL.sub(lambda m: b"%%%02X" % m[0][0], url.encode()))
    head.append(b"WARC-Payload-Digest: sha1:" + b32)
    if refers_to is None:
        block += payload
    else:
        head += [b"WARC-Refers-To: <urn:page:%d>" % refers_to, b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


class Archive:
    """Writes one archive file and counts its bytes."""

    def __init__(self, uri: str):
        self.uri, self.size = uri, 0
        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = store.open_output_stream(path, compression=None)

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()


def _own_name(base: str, ending: str) -> str:
    task = TaskContext.get()
    return f"{base}/{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}{ending}"


def write_archives(rows: DataFrame, base: str) -> DataFrame:
    """Records as monolithic gzip files below ``base``; returns their addresses (path)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, deflate, raw = None, None, 0
        for batch in batches:
            done = []
            for page_id, url, html, digest, refers_to in zip(*(batch.column(i) for i in range(5))):
                data = record(page_id.as_py(), url.as_py(), html.as_buffer().to_pybytes(), digest.as_py(), refers_to.as_py())
                if out is None:
                    out, deflate, raw = Archive(_own_name(base, ".warc.gz")), zlib.compressobj(6, zlib.DEFLATED, 31), 0
                out.write(deflate.compress(data))
                raw += len(data)
                if raw >= FILE_BYTES:
                    out.write(deflate.flush())
                    out.close()
                    done.append(out.uri)
                    out = None
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["path"])
        if out is not None:
            out.write(deflate.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([out.uri], pa.string())], ["path"])

    return rows.select("page_id", "url", "html", "payload_digest", "refers_to").mapInArrow(write, "path string")


def inflated_records(uri: str, piece: int = 1 << 20) -> Iterator[bytes]:
    """The records of a gzip file of one or more members, read once from front to back.

    At most ``piece`` bytes are inflated before records are given out, so memory holds a record and two pieces.
    """
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path, compression=None) as source:
        inflate, held, within = zlib.decompressobj(31), bytearray(), False
        while True:
            data = source.read(piece)
            if not data:
                break
            full = False
            while data or full:  # ``piece`` bytes of output at once, however far the input expands
                out = inflate.decompress(data, piece)
                held += out
                data, full, within = inflate.unconsumed_tail, len(out) == piece, not inflate.eof
                if inflate.eof:
                    data, full, inflate = inflate.unused_data, False, zlib.decompressobj(31)
                at = 0
                while (end := _record_end(held, at)) is not None:
                    yield bytes(held[at:end])
                    at = end
                del held[:at]
        if held or within:
            raise ValueError(f"{uri} ends within a {'record' if held else 'stream'}")


def _record_end(data: bytearray, at: int) -> int | None:
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        return None
    length = re.search(rb"\r\ncontent-length:\s*(\d+)", data[at:head].lower())
    if not length:
        raise ValueError("a record without Content-Length")
    end = head + 8 + int(length[1])
    return end if end <= len(data) else None


def normalise(paths: DataFrame, base: str) -> DataFrame:
    """One member for each record, and a sidecar ``.idx`` of "offset length" lines beside each archive.

    Returns the index of all archives: path, first, last (offsets), in file order.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                out, offsets, lengths = Archive(_own_name(base, ".warc.gz")), [], []
                for data in inflated_records(uri):
                    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = deflate.compress(data) + deflate.flush()
                    offsets.append(out.size)
                    lengths.append(len(member))
                    out.write(member)
                out.close()
                index = Archive(out.uri + ".idx")
                index.write("".join(f"{a} {n}\n" for a, n in zip(offsets, lengths)).encode())
                index.close()
                yield pa.RecordBatch.from_arrays([pa.array([out.uri] * len(offsets), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["path", "offset", "length"])

    # a task for each file: by bytes of their addresses they would all go to one
    return paths.repartition(max(1, paths.count()), "path").mapInArrow(rewrite, "path string, offset long, length long")


def parsed(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a record; checks its digest."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    block = block[: int(fields[b"Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields[b"WARC-Payload-Digest"].removeprefix(b"sha1:")).hex()
    page = fields[b"WARC-Record-ID"][len(b"<urn:page:") : -1]
    kind = fields[b"WARC-Type"].decode()
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of page {page.decode()} differs from its digest")
    to = fields.get(b"WARC-Refers-To")
    return int(page) if page else None, size, digest, kind, int(to[len(b"<urn:page:") : -1]) if to else None


def read_archives(index: DataFrame) -> DataFrame:
    """The records that an index names, each inflated from its own member."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_uri, source = None, None
        for batch in batches:
            rows = []
            for uri, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if uri != open_uri:
                    if source:
                        source.close()
                    store, path = fs.FileSystem.from_uri(uri)
                    open_uri, source = uri, store.open_input_file(path)
                source.seek(offset)
                rows.append(parsed(zlib.decompress(source.read(length), 31)))
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if source:
            source.close()

    return index.mapInArrow(scan, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = Scratch(spark, "warc")
    paths = keep.keep(write_archives(with_revisits(read(spark, sf_dir, "pages"), keep), keep.path("monolithic")), "paths")
    index = keep.keep(normalise(paths, keep.path("members")), "index")
    keep.drop("monolithic")
    return read_archives(index.select("path", "offset", "length"))


OP6_SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, CASE WHEN payload_bytes >= {MIN_REVISIT} THEN max(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM g
"""
