"""Read-only tables by name."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import DuplicateColumn, InvalidSchema, TableNotFound
from ..types import named


def schema_of(columns: Sequence[tuple[str, str]]) -> T.StructType:
    """A schema from (name, type name) pairs; columns can't be NULL."""
    if not columns:
        raise InvalidSchema("a table needs a column")
    seen = set()
    for name, _ in columns:
        if not name or not name.strip():
            raise InvalidSchema("a column needs a name")
        if name.lower() in seen:
            raise DuplicateColumn(f"two columns are named {name}")
        seen.add(name.lower())
    return T.StructType([T.StructField(name, named(kind).value, False) for name, kind in columns])


class Tables:
    """A registry whose names are case-insensitive."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._frames: dict[str, Callable[[], DataFrame]] = {}
        self._fallback: list[Callable[[str], DataFrame | None]] = []

    def register(self, name: str, frame: DataFrame | Callable[[], DataFrame]) -> None:
        """A frame, or a function that makes it on first use."""
        self._frames[name.lower()] = (lambda: frame) if isinstance(frame, DataFrame) else frame

    def register_rows(self, name: str, columns: Sequence[tuple[str, str]], rows: Iterable[Sequence[Any]]) -> None:
        """Rows in memory; each must have a value of the right type for every column."""
        schema = schema_of(columns)
        given = [tuple(r) for r in rows]
        if any(len(r) != len(schema) for r in given):
            raise InvalidSchema(f"a row of {name} hasn't {len(schema)} values")
        if any(v is None for r in given for v in r):
            raise InvalidSchema(f"a row of {name} holds NULL")
        self.register(name, self.spark.createDataFrame(given, schema))

    def register_parquet(self, folder: str, names: Iterable[str]) -> None:
        """``folder``/name.parquet for each name; read lazily, with pushdown."""
        for name in names:
            self.register(name, lambda path=f"{folder}/{name}.parquet": self.spark.read.parquet(path))

    def register_source(self, find: Callable[[str], DataFrame | None]) -> None:
        """A callback from name to frame, or None if it has no such table."""
        self._fallback.append(find)

    def names(self) -> list[str]:
        return sorted(self._frames)

    def drop(self, name: str) -> None:
        if self._frames.pop(name.lower(), None) is None:
            raise TableNotFound(f"no table {name}")

    def get(self, name: str) -> DataFrame | None:
        found = self._frames.get(name.lower())
        if found is not None:
            return found()
        for find in self._fallback:
            if (frame := find(name)) is not None:
                return frame
        return None
