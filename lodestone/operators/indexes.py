"""Secondary indexes: key to row ids, kept as tables of the store."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import IndexError_, UnknownColumn
from ..sources.store import INDEXES, RID, Manifest, Store, StoredTable

#: Entries of a key that are fetched to read their rows directly.
FEW = 1000


class IndexKind(Enum):
    PRIMARY = "primary"
    UNIQUE = "unique"
    NON_UNIQUE = "non_unique"

    @property
    def unique(self) -> bool:
        return self is not IndexKind.NON_UNIQUE


@dataclass(frozen=True)
class Index:
    name: str
    database: str
    table: str
    column: str
    kind: IndexKind
    kept_up: bool = True


class Indexes:
    """Index names are unique over all databases. Entries are (key, rid, file) rows, sorted by key within their files, so
    that a lookup skips row groups by their statistics. Definitions are kept beside the entries, so a later session
    finds its indexes again.

    An index never answers from what its table was: data files aren't changed, so each use first enters the files that
    the table has gained, and entries of files that it has lost don't count. Entries made by hand have no file and
    always count.
    """

    def __init__(self, store: Store):
        self.store, self.known = store, {}
        if not store.has_database(INDEXES):
            store.create_database(INDEXES)
        self.folder = f"{store.root}/{INDEXES}/_definitions"
        store.fs.make(self.folder)
        for name in store.fs.names(self.folder):
            if name.endswith(".json"):
                found = json.loads(store.fs.read(f"{self.folder}/{name}"))
                self.known[found["name"].lower()] = Index(**found | {"kind": IndexKind(found["kind"])})

    def create(self, name: str, database: str, table: str, column: str, kind: IndexKind = IndexKind.NON_UNIQUE, build: bool = True) -> Index:
        """A new index, filled from the table and kept up with it unless ``build`` is off."""
        if name.lower() in self.known:
            raise IndexError_(f"index {name} exists")
        m = self.store.table(database, table).manifest()
        field = next((c for c in m.columns if c[0].lower() == column.lower()), None)
        if field is None:
            raise UnknownColumn(f"no column {column} in {table}")
        self.store.create_table(INDEXES, name, [("key", field[1]), ("rid", "LONG"), ("file", "STRING")])
        self.known[name.lower()] = out = Index(name, database, table, field[0], kind, build)
        try:
            self._fresh(name)
        except IndexError_:
            del self.known[name.lower()]
            self.store.drop_table(INDEXES, name)
            raise
        self.store.fs.create(f"{self.folder}/{name.lower()}.json", json.dumps(asdict(out) | {"kind": kind.value}))
        return out

    def get(self, name: str) -> Index:
        if name.lower() not in self.known:
            raise IndexError_(f"no index {name}")
        return self.known[name.lower()]

    def _entries(self, name: str) -> StoredTable:
        self.get(name)
        return self.store.table(INDEXES, name)

    def _fresh(self, name: str) -> tuple[DataFrame, StoredTable | None, Manifest | None]:
        """The entries that count now, with the table and the manifest that they were brought up to."""
        index, entries = self.get(name), self._entries(name)
        if not index.kept_up:
            return entries.rows(), None, None
        at, fs = f"{entries.path}/_covered", self.store.fs
        covered = set(json.loads(fs.read(at))) if fs.exists(at) else set()
        table = self.store.table(index.database, index.table)
        m = table.manifest()
        files = {f.rsplit("/", 1)[1]: f for f in m.files}
        live = entries.rows()
        if dead := sorted(covered - files.keys()):
            if 2 * len(dead) > len(covered):
                entries.delete(F.col("file").isin(dead))
                live = entries.rows()
                covered, dead = covered & files.keys(), []
            else:
                gone = self.store.spark.createDataFrame([(f,) for f in dead], "file string")
                live = live.join(F.broadcast(gone), "file", "left_anti").select("key", "rid", "file")
        if new := sorted(files.keys() - covered):
            file = F.element_at(F.split(F.input_file_name(), "/"), -1)
            rows = table._read(m, [files[f] for f in new]).select(F.col(f"`{index.column}`").alias("key"), F.col(RID).alias("rid"), file.alias("file"))
            if index.kind.unique and live.select("key").union(rows.select("key")).groupBy("key").count().where("count > 1").take(1):
                raise IndexError_(f"{index.table}.{index.column} isn't unique")
            entries.append(rows.sort("key"))
            fs.create(at, json.dumps(sorted(covered | set(new))), replace=True)
            return self._fresh(name)
        return live, table, m

    def insert(self, name: str, key: Any, rid: int) -> None:
        live, _, _ = self._fresh(name)
        if key is None:
            raise IndexError_("a key can't be NULL")
        if self.get(name).kind.unique and live.where(F.col("key") == F.lit(key)).take(1):
            raise IndexError_(f"{key!r} is already in {name}")
        self._entries(name).insert((key, rid, None))

    def search(self, name: str, key: Any) -> DataFrame:
        """(rid): the ids under a key."""
        return self._fresh(name)[0].where(F.col("key") == F.lit(key)).select("rid").distinct()

    def entries(self, name: str) -> DataFrame:
        """(key, rid) in the order of the keys."""
        return self._fresh(name)[0].select("key", "rid").distinct().orderBy("key", "rid")

    def delete(self, name: str, key: Any, rid: int | None = None) -> int:
        where = F.col("key") == F.lit(key)
        return self._entries(name).delete(where if rid is None else where & (F.col("rid") == rid))

    def update(self, name: str, old: Any, new: Any, rid: int) -> None:
        """Moves an id from one key to another."""
        live, _, _ = self._fresh(name)
        where = (F.col("key") == F.lit(old)) & (F.col("rid") == rid)
        if not live.where(where).take(1):
            raise IndexError_(f"no entry {old!r} with {rid} in {name}")
        if self.get(name).kind.unique and old != new and live.where(F.col("key") == F.lit(new)).take(1):
            raise IndexError_(f"{new!r} is already in {name}")
        self._entries(name).update({"key": F.lit(new)}, where)

    def resolve(self, name: str, key: Any) -> DataFrame:
        """The indexed table's rows under a key.

        Up to FEW entries are fetched, and only their files are read, by row id; beyond that the ids are joined.
        """
        index = self.get(name)
        live, table, m = self._fresh(name)
        if table is None:
            table = self.store.table(index.database, index.table)
            m = table.manifest()
        found = live.where(F.col("key") == F.lit(key)).select("rid", "file")
        few = found.take(FEW + 1)
        if len(few) > FEW:
            return table._read(m, m.files).join(found.select(F.col("rid").alias(RID)), RID, "left_semi").drop(RID)
        names = {r.file for r in few}
        files = [f for f in m.files if None in names or f.rsplit("/", 1)[1] in names] if few else []
        return table._read(m, files).where(F.col(RID).isin([r.rid for r in few])).drop(RID)

    def of_table(self, database: str, table: str) -> list[Index]:
        return [i for i in self.known.values() if (i.database, i.table.lower()) == (database, table.lower())]

    def of_column(self, database: str, table: str, column: str) -> list[Index]:
        return [i for i in self.of_table(database, table) if i.column.lower() == column.lower()]

    def drop(self, name: str) -> None:
        self.get(name)
        self.store.drop_table(INDEXES, name)
        self.store.fs.remove(f"{self.folder}/{name.lower()}.json")
        del self.known[name.lower()]

    def drop_of_table(self, database: str, table: str) -> int:
        found = self.of_table(database, table)
        for i in found:
            self.drop(i.name)
        return len(found)

    def drop_of_database(self, database: str) -> int:
        return sum(self.drop_of_table(database, table) for table in {i.table for i in self.known.values() if i.database == database})

    def clear(self) -> None:
        for name in list(self.known):
            self.drop(name)
