"""INSERT, UPDATE and DELETE on stored tables."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InsertError, UnknownColumn, UpdateError
from ..plans import tree as t
from ..plans.compiler import Compiler, Value
from ..sources.store import StoredTable
from ..types import DataType, fits


def _stored(value: Any, name: str, kind, error: type[Exception]) -> Any:
    if value is None:
        raise error(f"{name} can't be NULL")
    try:
        return fits(value, DataType(kind))
    except TypeError as e:
        raise error(f"{name}: {e}") from None


def insert(table: StoredTable, statement: t.Insert) -> int:
    """One row; every column must be named once, in any order. Returns the row's id."""
    fields = {f.name.lower(): f for f in table.manifest().schema.fields}
    if len(statement.columns) != len(statement.values):
        raise InsertError(f"{len(statement.columns)} columns, but {len(statement.values)} values")
    given: dict[str, Any] = {}
    for name, value in zip(statement.columns, statement.values):
        if name.lower() not in fields:
            raise InsertError(f"no column {name}")
        if name.lower() in given:
            raise InsertError(f"{name} is named twice")
        given[name.lower()] = _stored(value, name, fields[name.lower()].dataType, InsertError)
    if missing := [f.name for k, f in fields.items() if k not in given]:
        raise InsertError(f"no value for {', '.join(missing)}")
    return table.insert(tuple(given[k] for k in fields))


def matching(table: StoredTable, name: str, where: t.Expression | None) -> Column:
    """The rows a WHERE means; columns may carry the table's own name. Never NULL."""
    if where is None:
        return F.lit(True)
    fields = {f.name.lower(): f for f in table.manifest().schema.fields}

    def value(e: t.Expression) -> Value:
        if not isinstance(e, t.ColumnRef):
            raise UnknownColumn("an aggregate can't stand here")
        if e.name.lower() not in fields or e.qualifier is not None and e.qualifier.lower() != name.lower():
            raise UnknownColumn(f"no column {e}")
        f = fields[e.name.lower()]
        return Value(F.col(f"`{f.name}`"), f.dataType, False)

    return Compiler(value).predicate(where, bare=False)


def update(table: StoredTable, statement: t.Update) -> int:
    fields = {f.name.lower(): f for f in table.manifest().schema.fields}
    changes: dict[str, Column] = {}
    if not statement.assignments:
        raise UpdateError("nothing is set")
    for name, value in statement.assignments:
        f = fields.get(name.lower())
        if f is None:
            raise UnknownColumn(f"no column {name}")
        if f.name in changes:
            raise UpdateError(f"{name} is set twice")
        changes[f.name] = F.lit(_stored(value, name, f.dataType, UpdateError)).cast(f.dataType)
    return table.update(changes, matching(table, statement.table, statement.where))


def delete(table: StoredTable, statement: t.Delete) -> int:
    return table.delete(matching(table, statement.table, statement.where))
