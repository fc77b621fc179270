"""Total orders, keysets, look-ahead and whole-row byte budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.model import QueryError, checked_limit, invalid


def after(columns: list[str], values: list, inclusive: bool = False) -> Column:
    """Rows beyond a keyset position, as an OR of ANDs: that form reaches the Parquet scan."""
    if len(columns) != len(values):
        raise invalid("cursor")
    out, equal = F.lit(False), F.lit(True)
    for i, (name, value) in enumerate(zip(columns, values)):
        last = inclusive and i == len(columns) - 1
        step = F.col(name) >= F.lit(value) if last else F.col(name) > F.lit(value)
        out = step if i == 0 else out | (equal & step)
        equal = F.col(name) == F.lit(value) if i == 0 else equal & (F.col(name) == F.lit(value))
    return out


def page(df: DataFrame, order: list[str], limit: int, position: list | None = None, inclusive: bool = False, most: int = 100) -> DataFrame:
    """The first ``limit`` rows after a position, with ``has_more``; plans as a top-k of limit + 1 rows."""
    checked_limit(limit, most)
    if position is not None:
        df = df.where(after(order, position, inclusive))
    ahead = df.orderBy(*order).limit(limit + 1)
    # at most limit + 1 rows are left here
    n = F.row_number().over(Window.orderBy(*order))
    total = F.count("*").over(Window.partitionBy())
    return ahead.withColumn("__n", n).withColumn("has_more", total > limit).where(F.col("__n") <= limit).drop("__n")


def byte_budget(rows: DataFrame, order: list[str], size: Column, budget: int) -> DataFrame:
    """Whole rows of one page while their sizes sum to at most ``budget``; the page stops before the first that does not fit."""
    running = F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used_bytes", running).where(F.col("used_bytes") <= budget)


def cursor_budget(rows: DataFrame, order: list[str], size: Column, budget: int, cursor_bytes: int) -> DataFrame:
    """``byte_budget`` for a page that ends with a cursor unless its last row is the last one of all.

    The last row may fill the page where no cursor follows; one that fits only without the cursor it would need does not.
    A page whose first row is too large is empty, which ``checked_page`` makes an error.
    """
    w = Window.orderBy(*order)
    running = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("used_bytes", running).withColumn("__last", F.lead(F.lit(1)).over(w).isNull())
    need = F.col("used_bytes") + F.when(F.col("__last"), 0).otherwise(cursor_bytes)
    fits = rows.withColumn("__out", F.max((need > budget).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = fits.where("__out = 0")
    return kept.withColumn("has_more", F.max(F.col("__last").cast("int")).over(Window.partitionBy()) == 0).drop("__last", "__out")


def trimmed(rows: DataFrame, order: list[str], size: Column, envelope: int, budget: int) -> DataFrame:
    """A page without the rows at its end that do not fit beside an envelope of so many bytes."""
    return byte_budget(rows, order, size, budget - envelope)


def checked_page(rows: DataFrame, page_: DataFrame, family: str = "INDEX") -> DataFrame:
    """An empty page of rows that exist is an error: its first row is too large."""
    if page_.limit(1).count() == 0 and rows.limit(1).count():
        raise QueryError(f"{family}_RESULT_TOO_LARGE")
    return page_


def json_size(df: DataFrame) -> Column:
    """Encoded size of a row and its separator."""
    return (F.octet_length(F.to_json(F.struct(*df.columns))) + 1).cast("bigint")


def replayed(df: DataFrame, order: list[str], position: list | None) -> DataFrame:
    """``df``, once the row that a cursor names is seen to be still there: a look-up of one row, pushed to the scan."""
    if position is not None:
        anchor = F.lit(True)
        for name, value in zip(order, position, strict=True):
            anchor = anchor & (F.col(name) == F.lit(value))
        exists_or_invalid(df, anchor)
    return df


def exists_or_invalid(df: DataFrame, condition: Column) -> None:
    """A cursor's anchor row must still match; an action on one row."""
    if df.where(condition).limit(1).count() == 0:
        raise invalid("the cursor's row is gone")
