"""The five aggregates, with their types and their values for no rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count(column: Column | None = None) -> Column:
    """Rows, or rows in which the column isn't NULL; LONG."""
    return F.count(F.lit(1) if column is None else column)


def total(column: Column) -> Column:
    """DOUBLE; 0.0 for no rows."""
    return F.coalesce(F.sum(column.cast("double")), F.lit(0.0))


def mean(column: Column) -> Column:
    """DOUBLE; 0.0 for no rows."""
    return F.coalesce(F.avg(column.cast("double")), F.lit(0.0))


def least(column: Column) -> Column:
    """The column's type; NULL for no rows."""
    return F.min(column)


def greatest(column: Column) -> Column:
    """The column's type; NULL for no rows."""
    return F.max(column)
