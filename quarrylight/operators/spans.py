"""Spans of one path met by a sweep over their sorted places, instead of by the product of both sides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.sources.tables import by_key


def within(inner: DataFrame, outer: DataFrame, inner_span: tuple[Column, Column], outer_span: tuple[Column, Column]) -> DataFrame:
    """(path, inner, outer): the rows of each pair, as structs, where the outer span holds the inner one, ends included.

    Both sides pass sorted by path and start, outer ones first where they start alike.  Outer spans begun are held, and dropped
    once an inner one starts behind their end; so a file costs the sorting of its rows and, for each inner span, as many
    steps as outer spans are open there: its depth where spans are nested.
    """
    nothing = lambda df: F.lit(None).cast(df.select(F.struct(*df.columns).alias("r")).schema["r"].dataType)
    begun = outer.select("path", outer_span[0].cast("long").alias("a"), outer_span[1].cast("long").alias("b"), F.lit(0).alias("turn"), nothing(inner).alias("inner"), F.struct(*outer.columns).alias("outer"))
    asked = inner.select("path", inner_span[0].cast("long").alias("a"), inner_span[1].cast("long").alias("b"), F.lit(1).alias("turn"), F.struct(*inner.columns).alias("inner"), nothing(outer).alias("outer"))
    events = by_key(begun.unionByName(asked).where(F.col("a").isNotNull() & F.col("b").isNotNull()), "path", "a", "turn")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, open_ = None, []  # ends of open spans, and where their rows lie in ``held``
        held = None  # outer rows still open from batches before, then those of this batch
        for batch in batches:
            outers = batch.column("outer")
            base = 0 if held is None else len(held)
            rows = outers if held is None else pa.concat_arrays([held, outers])
            pairs_in, pairs_out = [], []
            for i, (p, a, b, turn) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("path", "a", "b", "turn")))):
                if p != path:
                    path, open_ = p, []
                if turn == 0:
                    open_.append((b, base + i))
                    continue
                open_ = [x for x in open_ if x[0] >= a]
                for end, at in open_:
                    if end >= b:
                        pairs_in.append(i)
                        pairs_out.append(at)
            take = pa.array(np.array(pairs_in, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("path").take(take), batch.column("inner").take(take), rows.take(pa.array(np.array(pairs_out, np.int64)))], ["path", "inner", "outer"])
            held = rows.take(pa.array(np.array([at for _, at in open_], np.int64)))
            open_ = [(end, k) for k, (end, _) in enumerate(open_)]

    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    return events.mapInArrow(sweep, f"path string, inner {kinds['inner']}, outer {kinds['outer']}")
