"""FROM and JOIN: a left-deep chain; the physical strategy is Catalyst's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..errors import ParseError
from ..plans import tree as t
from ..plans.compiler import Compiler, Value
from ..plans.scope import Scope


def column_value(scope: Scope, e: t.Expression) -> Value:
    """Base rows hold no NULL in this data model; only an outer join makes a column nullable."""
    if isinstance(e, t.AggregateCall):
        raise ParseError("an aggregate can't stand here")
    f = scope.resolve(e)
    return Value(f.column, f.type, f.padded)


def joined(select: t.Select, table_of: Callable[[str], DataFrame]) -> tuple[DataFrame, Scope]:
    """The FROM clause's rows under internal names, and the scope that knows them.

    A join needs a comparison of columns of both sides: a condition without one would be a cross join.
    """
    scope = Scope()
    out = scope.enter(select.table, table_of(select.table.name))
    for join in select.joins:
        k = len(scope.tables)
        right = scope.enter(join.table, table_of(join.table.name))
        if not _connects(join.on, scope, k):
            raise ParseError(f"the condition doesn't connect {join.table.effective} with the tables before it")
        condition = Compiler(lambda e: column_value(scope, e)).predicate(join.on)
        out = out.join(right, condition, join.kind.value)
        if join.kind in (t.JoinKind.RIGHT, t.JoinKind.FULL):
            scope.pad(range(k))
        if join.kind in (t.JoinKind.LEFT, t.JoinKind.FULL):
            scope.pad(range(k, k + 1))
    return out, scope


def _connects(e: t.Expression, scope: Scope, k: int) -> bool:
    if isinstance(e, (t.And, t.Or)):
        return _connects(e.left, scope, k) or _connects(e.right, scope, k)
    if isinstance(e, t.Not):
        return _connects(e.operand, scope, k)
    if isinstance(e, t.Comparison) and isinstance(e.left, t.ColumnRef) and isinstance(e.right, t.ColumnRef):
        sides = {scope.resolve(e.left).table == k, scope.resolve(e.right).table == k}
        return len(sides) == 2
    return False
