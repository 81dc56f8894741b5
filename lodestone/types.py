"""The five column types, their names in DDL, and the categories that decide what can be compared."""

from __future__ import annotations

from enum import Enum
from typing import Any

from pyspark.sql import types as T

from .errors import InvalidSchema


class DataType(Enum):
    INT = T.IntegerType()
    LONG = T.LongType()
    DOUBLE = T.DoubleType()
    BOOLEAN = T.BooleanType()
    STRING = T.StringType()


#: Names that DDL accepts.
ALIASES = {
    "INT": DataType.INT,
    "INTEGER": DataType.INT,
    "LONG": DataType.LONG,
    "BIGINT": DataType.LONG,
    "DOUBLE": DataType.DOUBLE,
    "FLOAT": DataType.DOUBLE,
    "REAL": DataType.DOUBLE,
    "BOOLEAN": DataType.BOOLEAN,
    "BOOL": DataType.BOOLEAN,
    "STRING": DataType.STRING,
    "TEXT": DataType.STRING,
    "VARCHAR": DataType.STRING,
}


def named(name: str) -> DataType:
    try:
        return ALIASES[name.upper()]
    except KeyError:
        raise InvalidSchema(f"unknown type {name}") from None


def category(kind: T.DataType) -> str:
    """numeric, string, boolean, time, or the type's own name."""
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return kind.typeName()


def literal_type(value: Any) -> T.DataType:
    """32-bit integers are INT, larger ones LONG."""
    if value is None:
        return T.NullType()
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        if -(2**31) <= value < 2**31:
            return T.IntegerType()
        return T.LongType() if -(2**63) <= value < 2**63 else T.DecimalType(38, 0)
    if isinstance(value, float):
        return T.DoubleType()
    return T.StringType()


def fits(value: Any, wanted: DataType) -> Any:
    """The value as it is stored in a column of this type; raises TypeError unless the widening loses nothing."""
    given = literal_type(value)
    if given == wanted.value:
        return value
    if wanted is DataType.LONG and given == T.IntegerType():
        return value
    if wanted is DataType.DOUBLE and isinstance(value, int) and not isinstance(value, bool) and int(float(value)) == value:
        return float(value)
    raise TypeError(f"{value!r} is no {wanted.name}")
