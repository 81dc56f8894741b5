"""GROUP BY, the aggregates and HAVING."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AggregationError, DuplicateColumn, ParseError, TypeError_
from ..functions import aggregates as f
from ..plans import tree as t
from ..plans.compiler import Compiler, Value
from ..plans.scope import Scope
from ..types import category


def is_aggregation(select: t.Select) -> bool:
    return bool(select.group_by) or any(isinstance(i.expression, t.AggregateCall) for i in select.items or ())


def aggregate_column(call: t.AggregateCall, scope: Scope) -> tuple[Column, T.DataType]:
    if call.column is None:
        if call.function != "COUNT":
            raise ParseError(f"{call.function}(*) isn't allowed")
        return f.count(), T.LongType()
    field = scope.resolve(call.column)
    if call.function == "COUNT":
        return f.count(field.column), T.LongType()
    if call.function in ("SUM", "AVG"):
        if category(field.type) != "numeric":
            raise TypeError_(f"{call.function} of {field.type.simpleString()} column {call.column}")
        return (f.total if call.function == "SUM" else f.mean)(field.column), T.DoubleType()
    if call.function in ("MIN", "MAX"):
        if category(field.type) not in ("numeric", "string", "boolean", "time"):
            raise TypeError_(f"{call.function} of {field.type.simpleString()} column {call.column}")
        return (f.least if call.function == "MIN" else f.greatest)(field.column), field.type
    raise ParseError(f"unknown aggregate {call.function}")


class Aggregation:
    """The grouped rows of a statement under internal names, and what its output names stand for."""

    def __init__(self, select: t.Select, rows: DataFrame, scope: Scope):
        if select.items is None:
            raise AggregationError("* can't stand with GROUP BY or aggregates")
        self.scope = scope
        self.keys = {scope.resolve(c).internal: scope.resolve(c) for c in select.group_by}
        self.calls: dict[str, tuple[str, T.DataType]] = {}
        columns: list[Column] = []
        wanted = [i.expression for i in select.items] + t.aggregates(select.having) + [o.expression for o in select.order_by]
        for e in wanted:
            if isinstance(e, t.AggregateCall) and self._key(e) not in self.calls:
                column, kind = aggregate_column(e, scope)
                name = f"a{len(self.calls)}"
                self.calls[self._key(e)] = name, kind
                columns.append(column.alias(name))
        groups = [v.column for v in self.keys.values()]
        if columns:
            self.rows = rows.groupBy(*groups).agg(*columns)
        else:
            self.rows = rows.select(*groups).distinct()
        self.outputs: dict[str, tuple[str, T.DataType, str]] = {}  # lower-case name: internal, type, name
        for item in select.items:
            e = item.expression
            if isinstance(e, t.ColumnRef):
                field = scope.resolve(e)
                if field.internal not in self.keys:
                    raise AggregationError(f"{e} must be grouped or aggregated")
            internal, kind = self._internal(e)
            name = item.alias or (e.name if isinstance(e, t.ColumnRef) else e.default_name)
            if name.lower() in self.outputs:
                raise DuplicateColumn(f"two outputs are named {name}")
            self.outputs[name.lower()] = internal, kind, name

    def _key(self, e: t.AggregateCall) -> str:
        return f"{e.function}:{self.scope.resolve(e.column).internal if e.column else '*'}"

    def _internal(self, e: t.ColumnRef | t.AggregateCall) -> tuple[str, T.DataType]:
        if isinstance(e, t.AggregateCall):
            return self.calls[self._key(e)]
        field = self.scope.resolve(e)
        return field.internal, field.type

    def find(self, e: t.Expression) -> tuple[str, T.DataType]:
        """An output name, a grouped column or an aggregate, as HAVING and ORDER BY name them."""
        if isinstance(e, t.ColumnRef):
            if e.qualifier is None and e.name.lower() in self.outputs:
                return self.outputs[e.name.lower()][:2]
            field = self.scope.resolve(e)
            if field.internal not in self.keys:
                raise AggregationError(f"{e} is neither grouped nor an output")
            return field.internal, field.type
        return self._internal(e)

    def value(self, e: t.Expression) -> Value:
        internal, kind = self.find(e)
        return Value(F.col(f"`{internal}`"), kind)

    def having(self, e: t.Expression | None) -> DataFrame:
        return self.rows if e is None else self.rows.where(Compiler(self.value).predicate(e))
