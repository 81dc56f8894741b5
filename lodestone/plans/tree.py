"""Statements and expressions. Programs may build these themselves instead of writing SQL."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum
from typing import Any


class Expression:
    pass


@dataclass(frozen=True)
class ColumnRef(Expression):
    name: str
    qualifier: str | None = None

    def __str__(self) -> str:
        return f"{self.qualifier}.{self.name}" if self.qualifier else self.name


@dataclass(frozen=True)
class Literal(Expression):
    value: Any


@dataclass(frozen=True)
class AggregateCall(Expression):
    function: str  # COUNT SUM AVG MIN MAX
    column: ColumnRef | None = None  # None: *

    @property
    def default_name(self) -> str:
        return f"{self.function.lower()}_{self.column.name if self.column else 'all'}"


@dataclass(frozen=True)
class Comparison(Expression):
    operator: str  # = != < <= > >=
    left: Expression
    right: Expression


@dataclass(frozen=True)
class Between(Expression):
    operand: Expression
    low: Expression
    high: Expression
    negated: bool = False


@dataclass(frozen=True)
class In(Expression):
    operand: Expression
    values: tuple[Any, ...]
    negated: bool = False


@dataclass(frozen=True)
class Like(Expression):
    operand: Expression
    pattern: str
    ignore_case: bool = False
    negated: bool = False


@dataclass(frozen=True)
class And(Expression):
    left: Expression
    right: Expression


@dataclass(frozen=True)
class Or(Expression):
    left: Expression
    right: Expression


@dataclass(frozen=True)
class Not(Expression):
    operand: Expression


class JoinKind(Enum):
    INNER = "inner"
    LEFT = "left"
    RIGHT = "right"
    FULL = "full"


@dataclass(frozen=True)
class TableRef:
    name: str
    alias: str | None = None

    @property
    def effective(self) -> str:
        return self.alias or self.name


@dataclass(frozen=True)
class Join:
    kind: JoinKind
    table: TableRef
    on: Expression


@dataclass(frozen=True)
class SelectItem:
    expression: ColumnRef | AggregateCall
    alias: str | None = None


@dataclass(frozen=True)
class OrderItem:
    expression: ColumnRef | AggregateCall
    descending: bool = False


class Statement:
    pass


@dataclass(frozen=True)
class Select(Statement):
    table: TableRef
    items: tuple[SelectItem, ...] | None = None  # None: *
    joins: tuple[Join, ...] = ()
    where: Expression | None = None
    group_by: tuple[ColumnRef, ...] = ()
    having: Expression | None = None
    order_by: tuple[OrderItem, ...] = ()
    limit: int | None = None
    fetch: int | None = None


@dataclass(frozen=True)
class Insert(Statement):
    table: str
    columns: tuple[str, ...]
    values: tuple[Any, ...]


@dataclass(frozen=True)
class Update(Statement):
    table: str
    assignments: tuple[tuple[str, Any], ...]
    where: Expression | None = None


@dataclass(frozen=True)
class Delete(Statement):
    table: str
    where: Expression | None = None


@dataclass(frozen=True)
class CreateDatabase(Statement):
    name: str


@dataclass(frozen=True)
class UseDatabase(Statement):
    name: str


@dataclass(frozen=True)
class DropDatabase(Statement):
    name: str


@dataclass(frozen=True)
class CreateTable(Statement):
    name: str
    columns: tuple[tuple[str, str], ...] = field(default=())  # (name, type name)


@dataclass(frozen=True)
class DropTable(Statement):
    name: str


def select_all(table: str, where: Expression | None = None) -> Select:
    return Select(TableRef(table), where=where)


def select_columns(table: str, *columns: str, where: Expression | None = None) -> Select:
    """Columns by name, which may be qualified."""
    return Select(TableRef(table), tuple(SelectItem(ColumnRef(*reversed(c.split(".", 1)))) for c in columns), where=where)


def aggregates(expression: Expression | None) -> list[AggregateCall]:
    """The aggregate calls inside an expression, in order."""
    if isinstance(expression, AggregateCall):
        return [expression]
    if isinstance(expression, (And, Or, Comparison)):
        return aggregates(expression.left) + aggregates(expression.right)
    if isinstance(expression, (Not, In, Like)):
        return aggregates(expression.operand)
    if isinstance(expression, Between):
        return aggregates(expression.operand) + aggregates(expression.low) + aggregates(expression.high)
    return []
