"""A SELECT statement as one lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DuplicateColumn, ParseError
from ..plans import tree as t
from ..plans.compiler import Compiler
from ..plans.parser import LARGEST_COUNT
from ..plans.scope import Scope
from .aggregation import Aggregation, is_aggregation
from .joins import column_value, joined


def run_select(select: t.Select, table_of: Callable[[str], DataFrame]) -> DataFrame:
    """FROM, WHERE, GROUP BY, HAVING, ORDER BY, LIMIT or FETCH, projection.

    The sort stands below the projection, so it can use columns that aren't output, and together with the limit
    becomes one top-k operator.
    """
    _checked(select)
    rows, scope = joined(select, table_of)
    if select.where is not None:
        rows = rows.where(Compiler(lambda e: column_value(scope, e)).predicate(select.where))
    if is_aggregation(select):
        groups = Aggregation(select, rows, scope)
        rows = groups.having(select.having)
        outputs = [(internal, name) for internal, _, name in groups.outputs.values()]
        find = lambda e: groups.find(e)[0]
    else:
        outputs, find = _projection(select, scope)
    if select.order_by:
        rows = rows.orderBy(*(_ordered(o, find) for o in select.order_by))
    most = select.limit if select.limit is not None else select.fetch
    if most is not None:
        rows = rows.limit(most)
    return rows.select(*(F.col(f"`{internal}`").alias(name) for internal, name in outputs))


def _checked(select: t.Select) -> None:
    if select.limit is not None and select.fetch is not None:
        raise ParseError("LIMIT and FETCH can't stand together")
    for n in (select.limit, select.fetch):
        if n is not None and (isinstance(n, bool) or not isinstance(n, int) or not 0 <= n <= LARGEST_COUNT):
            raise ParseError("a row count is from 0 to 2147483647")
    if select.having is not None and not select.group_by:
        raise ParseError("HAVING needs GROUP BY")
    if select.items is not None and not select.items:
        raise ParseError("nothing is selected")


def _projection(select: t.Select, scope: Scope):
    if select.items is None:
        outputs = [(f.internal, scope.output_name(f)) for f in scope.fields]
    else:
        outputs = []
        for item in select.items:
            field = scope.resolve(item.expression)
            outputs.append((field.internal, item.alias or item.expression.name))
    seen: dict[str, str] = {}
    for internal, name in outputs:
        if name.lower() in seen:
            raise DuplicateColumn(f"two outputs are named {name}")
        seen[name.lower()] = internal

    def find(e: t.Expression) -> str:
        if isinstance(e, t.AggregateCall):
            raise ParseError("ORDER BY an aggregate needs GROUP BY or aggregates")
        if e.qualifier is None and e.name.lower() in seen:
            return seen[e.name.lower()]
        return scope.resolve(e).internal

    return outputs, find


def _ordered(item: t.OrderItem, find: Callable[[t.Expression], str]) -> Column:
    """NULL is the greatest value."""
    column = F.col(f"`{find(item.expression)}`")
    return column.desc_nulls_first() if item.descending else column.asc_nulls_last()
