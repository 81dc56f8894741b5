"""Predicates that are never NULL.

NULL equals NULL and differs from all else; an ordering, BETWEEN or LIKE with a NULL operand is false, negated or
not; NULL is in no list, so NOT IN is true for it. In a filter a NULL counts as false, so there, ``bare`` leaves out
the guard where the answer is the same, which lets the predicate reach the parquet scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def guarded(predicate: Column, bare: bool) -> Column:
    return predicate if bare else F.coalesce(predicate, F.lit(False))


def equal(a: Column, b: Column, bare: bool = False, never_null: bool = False) -> Column:
    """``never_null``: one side can't be NULL, so in a filter plain equality is the same and a better join key."""
    return a == b if bare and never_null else a.eqNullSafe(b)


def different(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def ordered(operator: str, a: Column, b: Column, bare: bool = False) -> Column:
    found = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[operator]
    return guarded(found, bare)


def between(a: Column, low: Column, high: Column, negated: bool = False, bare: bool = False) -> Column:
    inside = a.between(low, high)
    return guarded(~inside if negated else inside, bare)


def member(a: Column, values: Sequence[Any], negated: bool = False, bare: bool = False) -> Column:
    """A NULL in the list matches NULL."""
    given = [v for v in values if v is not None]
    inside = a.isin(*given) if given else F.lit(False)
    if len(given) < len(values):
        inside = F.coalesce(inside, F.lit(False)) | a.isNull()
    return ~F.coalesce(inside, F.lit(False)) if negated else guarded(inside, bare)


def like(a: Column, pattern: str, ignore_case: bool = False, negated: bool = False, bare: bool = False) -> Column:
    """``%`` and ``_`` are the only wildcards; a backslash is a backslash; other types are compared as text."""
    escape = next(c for c in "\\\x01\x02\x03|~^!#" if c not in pattern)
    text = a.cast("string")
    found = (F.ilike if ignore_case else F.like)(text, F.lit(pattern), F.lit(escape))
    return guarded(~found if negated else found, bare)
