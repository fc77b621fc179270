"""Identities: SHA-256 over fields that are each framed by their 4-byte big-endian byte length."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def framed_sha256(*fields: Column) -> Column:
    parts = []
    for f in fields:
        s = f.cast("string")
        parts += [F.unhex(F.lpad(F.hex(F.octet_length(s)), 8, "0")), F.encode(s, "UTF-8")]
    return F.sha2(F.concat(*parts), 256)


def framed_digest(*fields: str) -> str:
    """The same on the driver."""
    h = hashlib.sha256()
    for f in fields:
        data = f.encode()
        h.update(len(data).to_bytes(4, "big") + data)
    return h.hexdigest()


def ordered_digest(pairs: Column) -> Column:
    """SHA-256 of ``key=value`` lines in key order; pairs: array of (key, value) structs."""
    joined = F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(p["key"], F.lit("="), p["value"], F.lit("\n"))), "")
    return F.sha2(joined, 256)
