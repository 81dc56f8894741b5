"""Expressions to Columns, with the type checks that Spark would make too late or not at all."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ParseError, TypeError_
from ..functions import predicates as p
from ..types import category, literal_type
from . import tree as t


@dataclass
class Value:
    """A bound operand."""

    column: Column
    type: T.DataType
    null: bool = True  # can be NULL
    literal: Any = None
    is_literal: bool = False


Resolver = Callable[[t.Expression], Value]


def literal(value: Any) -> Value:
    return Value(F.lit(value), literal_type(value), value is None, value, True)


def _timed(value: Value, other: Value) -> Value:
    """A text literal beside a date or timestamp is read as one."""
    if value.is_literal and isinstance(value.literal, str) and category(other.type) == "time":
        try:
            moment = datetime.datetime.fromisoformat(value.literal)
        except ValueError:
            raise TypeError_(f"{value.literal!r} is no {other.type.simpleString()}") from None
        return Value(F.lit(moment.isoformat(sep=" ")).cast(other.type), other.type, False, moment, True)
    return value


class Compiler:
    """Compiles predicates over what ``resolve`` gives for a column or an aggregate."""

    def __init__(self, resolve: Resolver):
        self.resolve = resolve

    def operand(self, e: t.Expression) -> Value:
        if isinstance(e, t.Literal):
            return literal(e.value)
        if isinstance(e, (t.ColumnRef, t.AggregateCall)):
            return self.resolve(e)
        raise ParseError("a predicate can't be an operand")

    def predicate(self, e: t.Expression, bare: bool = True) -> Column:
        """``bare``: NULL may stand for false, as in a filter that nothing negates."""
        if isinstance(e, t.And):
            return self.predicate(e.left, bare) & self.predicate(e.right, bare)
        if isinstance(e, t.Or):
            return self.predicate(e.left, bare) | self.predicate(e.right, bare)
        if isinstance(e, t.Not):
            return ~self.predicate(e.operand, False)
        if isinstance(e, t.Comparison):
            return self.comparison(e, bare)
        if isinstance(e, t.Between):
            value = self.operand(e.operand)
            low, high = (_timed(self.operand(x), value) for x in (e.low, e.high))
            if None in (low.literal, high.literal) and (low.is_literal and low.literal is None or high.is_literal and high.literal is None):
                return F.lit(False)
            self._orderable(value, low)
            self._orderable(value, high)
            return p.between(value.column, low.column, high.column, e.negated, bare)
        if isinstance(e, t.In):
            return self.member(e, bare)
        if isinstance(e, t.Like):
            value = self.operand(e.operand)
            if category(value.type) not in ("string", "numeric", "boolean", "time", "void"):
                raise TypeError_(f"LIKE can't read {value.type.simpleString()}")
            return p.like(value.column, e.pattern, e.ignore_case, e.negated, bare)
        raise ParseError(f"{type(e).__name__} is no predicate")

    def _orderable(self, a: Value, b: Value) -> None:
        one, two = category(a.type), category(b.type)
        if "void" not in (one, two) and (one != two or one not in ("numeric", "string", "boolean", "time")):
            raise TypeError_(f"{a.type.simpleString()} and {b.type.simpleString()} have no order")

    def comparison(self, e: t.Comparison, bare: bool) -> Column:
        a, b = self.operand(e.left), self.operand(e.right)
        a, b = _timed(a, b), _timed(b, a)
        if e.operator in ("=", "!="):
            kinds = {category(a.type), category(b.type)} - {"void"}
            if len(kinds) > 1:  # values of different kinds are never equal
                return F.lit(e.operator == "!=")
            if e.operator == "!=":
                return p.different(a.column, b.column)
            return p.equal(a.column, b.column, bare, not (a.null and b.null))
        if e.operator not in ("<", "<=", ">", ">="):
            raise ParseError(f"unknown operator {e.operator}")
        if any(v.is_literal and v.literal is None for v in (a, b)):
            return F.lit(False)
        self._orderable(a, b)
        return p.ordered(e.operator, a.column, b.column, bare)

    def member(self, e: t.In, bare: bool) -> Column:
        if not e.values:
            raise ParseError("IN needs a list")
        value = self.operand(e.operand)
        kept = []
        for v in e.values:
            one = _timed(literal(v), value)
            if v is None:
                kept.append(None)
            elif category(one.type) == category(value.type):  # others equal nothing
                kept.append(one.literal)
        return p.member(value.column, kept, e.negated, bare)
