"""Admission of read operations on the driver: few at a time, each with a deadline."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

from quarrylight.model import QueryError

T = TypeVar("T")
# Seconds that an operation may take.
DEADLINES = {"list": 2.0, "read": 2.0, "context": 2.0, "search": 5.0, "index": 5.0, "document": 5.0}
_FAMILY = {"index": "INDEX", "document": "DOCUMENT"}


class Gate:
    """At most ``permits`` operations at once; one more is refused at once, not queued."""

    def __init__(self, spark: SparkSession, permits: int = 2):
        self.spark, self._permits = spark, threading.BoundedSemaphore(permits)

    def run(self, action: Callable[[], T], kind: str = "index", seconds: float | None = None) -> T:
        """The action's result; its Spark jobs are interrupted when the deadline passes."""
        if not self._permits.acquire(blocking=False):
            raise QueryError(f"{_FAMILY.get(kind, 'SOURCE')}_BUSY")
        tag, late = f"quarrylight-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            self.spark.sparkContext.cancelJobsWithTag(tag)

        timer = threading.Timer(DEADLINES[kind] if seconds is None else seconds, stop)
        self.spark.sparkContext.addJobTag(tag)
        timer.start()
        try:
            out = action()
        except Exception as e:
            if late.is_set():
                raise QueryError(f"{_FAMILY.get(kind, 'SOURCE')}_TIMEOUT") from e
            raise
        finally:
            timer.cancel()
            self.spark.sparkContext.removeJobTag(tag)
            self._permits.release()
        if late.is_set():
            raise QueryError(f"{_FAMILY.get(kind, 'SOURCE')}_TIMEOUT")
        return out
