"""Payload columns that hold JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(payload: Column, path: str) -> Column:
    """A scalar of a payload as text, null where there is none."""
    return F.get_json_object(payload, path)


def without(payload: Column, schema: str, *names: str) -> Column:
    """The payload without top-level fields."""
    return F.to_json(F.from_json(payload, schema).dropFields(*names))
