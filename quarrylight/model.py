"""Closed vocabularies, identifiers, limits and errors of the query surface."""

from __future__ import annotations

from pyspark.sql import types as T

# Formats of identifiers.
REPOSITORY_ID = r"^[a-z0-9][a-z0-9._-]{0,63}$"
REVISION = r"^[0-9a-f]{40}$"
SHA256 = r"^[0-9a-f]{64}$"
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"

# Closed vocabularies.
FILE_STATUSES = ("TEXT", "BINARY", "UNSUPPORTED_ENCODING", "UNSUPPORTED_PATH", "SYMLINK", "SUBMODULE", "LFS_POINTER")
RELATION_FILE_STATUSES = ("ANALYZED", "OUT_OF_SCOPE", "PARSE_FAILED", "UNSUPPORTED", "TOO_LARGE")
JOB_PHASES = ("ACCEPTED", "RUNNING", "COMPLETE", "FAILED")
VIEWS = ("AUTO", "RAW", "SUMMARY")
STOP_REASONS = ("COMPLETE", "LINE_BUDGET", "CONTENT_BUDGET", "SEGMENT_BUDGET", "WIRE_BUDGET")

# Limits of the contract.
PAGE_DEFAULT, PAGE_MOST = 20, 100
DOCUMENT_PAGE_DEFAULT, DOCUMENT_PAGE_MOST = 10, 20
QUERY_MOST = 256
SNIPPET_MOST, TITLE_MOST = 240, 160
READ_LINES_DEFAULT, READ_LINES_MOST, READ_BYTES_MOST, READ_SEGMENTS_MOST = 200, 500, 65_536, 500
RESPONSE_BYTES_MOST = 524_288
FILE_MOST, SUMMARY_LINES = 1_048_576, 100
RANGES_MOST = 20
PREVIEW_CHILDREN = 12
PAGE_BYTES = 163_840
SECTIONS_MOST = 256
RETENTION_DAYS = 30
ELIDE_LEAST = 4
KEYWORDS_MOST = 12

SPAN = T.StructType([T.StructField("start_byte", T.LongType()), T.StructField("end_byte", T.LongType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType())])


# Why a request cannot be answered, by family of operations.
SOURCE_CODES = ("INVALID_ARGUMENT", "REPOSITORY_NOT_FOUND", "SOURCE_NOT_PREPARED", "REVISION_NOT_PREPARED", "SOURCE_NOT_FOUND", "SOURCE_UNSUPPORTED", "SOURCE_SUMMARY_UNAVAILABLE", "SOURCE_RESULT_TOO_LARGE", "SOURCE_BUSY", "SOURCE_UNAVAILABLE", "SOURCE_TIMEOUT")
INDEX_CODES = ("INDEX_NOT_CURRENT", "INDEX_NOT_PREPARED", "INDEX_UNAVAILABLE", "INDEX_INCOMPATIBLE", "INDEX_GENERATION_EXPIRED", "INDEX_CAPABILITY_UNAVAILABLE", "INDEX_SYMBOL_NOT_FOUND", "INDEX_RESULT_TOO_LARGE", "INDEX_BUSY", "INDEX_TIMEOUT")
DOCUMENT_CODES = ("INVALID_ARGUMENT", "DOCUMENT_REPOSITORY_NOT_FOUND", "DOCUMENT_REVISION_NOT_AVAILABLE", "DOCUMENT_NOT_FOUND", "DOCUMENT_SECTION_NOT_FOUND", "DOCUMENT_CATALOG_INVALID", "DOCUMENT_CAPACITY_EXCEEDED", "DOCUMENT_RESULT_TOO_LARGE", "DOCUMENT_BUSY", "DOCUMENT_TIMEOUT", "DOCUMENT_UNAVAILABLE")
#: Why a publication or an admission fails.
WRITE_CODES = ("CONFLICT", "CAPACITY_EXCEEDED", "REGISTRY_INVALID")
CODES = frozenset((*SOURCE_CODES, *INDEX_CODES, *DOCUMENT_CODES, *WRITE_CODES))


class QueryError(ValueError):
    """A request that cannot be answered; ``code``, one of CODES, names the reason."""

    def __init__(self, code: str, detail: str = ""):
        if code not in CODES:
            raise AssertionError(code)
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def invalid(detail: str = "") -> QueryError:
    return QueryError("INVALID_ARGUMENT", detail)


def checked_limit(limit: int, most: int = PAGE_MOST) -> int:
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= most:
        raise invalid(f"limit must be an integer from 1 to {most}")
    return limit


def checked_query(query: str) -> str:
    """A literal query: one line, 1 to QUERY_MOST code points, no control characters."""
    if not isinstance(query, str) or not query.strip() or len(query) > QUERY_MOST or any(ord(c) < 32 or ord(c) == 127 or 0xD800 <= ord(c) < 0xE000 for c in query):
        raise invalid("query")
    return query


def closed_fields(request: dict, allowed: dict[str, type | tuple[type, ...]], required: tuple[str, ...] = ()) -> dict:
    """Strict binding: unknown fields and explicit nulls are errors, integers are never read from strings."""
    for name, value in request.items():
        if name not in allowed:
            raise invalid(f"unknown field {name}")
        if value is None or isinstance(value, bool) and allowed[name] is int or not isinstance(value, allowed[name]):
            raise invalid(name)
    for name in required:
        if name not in request:
            raise invalid(f"missing field {name}")
    return request
