"""Databases and tables as versioned parquet files.

A table is a folder. ``_manifest/<n>.json`` says what version n holds: the columns, the data files, the files of
deleted rows, the next row id. A statement writes new files and then puts the next manifest in place: it is written
aside and renamed (on local disks linked) without overwriting, so readers see whole versions, and of two writers one
wins and the other gets an error. That holds on local disks, HDFS and stores with an atomic rename; on plain object
stores, where a rename is a copy, only one writer at a time is safe. Files are reached through Hadoop's file systems,
so the warehouse can be any store that Spark reads. ``vacuum`` removes what old versions alone need.

Every row has an id, ``_rid``, that is never used again. Changes copy only the files that hold changed rows.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..errors import AlreadyExists, CorruptManifest, DatabaseNotFound, EngineError, InvalidSchema, RecordNotFound, TableNotFound
from .tables import schema_of

RID = "_rid"
#: Holds the entries of indexes; not listed.
INDEXES = "lodestone_indexes"
_TABLE = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_DATABASE = re.compile(r"[A-Za-z][A-Za-z0-9_]*")
#: Appends beyond this many small files are merged by the next one.
MERGE_AT = 64


class Files:
    """A file system by URI, on the driver."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm, self.conf = spark, spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def make(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        """What a folder holds, without what is being written aside."""
        fs, p = self._at(path)
        found = (s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else ()
        return sorted(n for n in found if not n.startswith("."))

    def older(self, path: str, seconds: float) -> bool:
        fs, p = self._at(path)
        return fs.getFileStatus(p).getModificationTime() / 1000 < time.time() - seconds

    def size(self, paths: list[str]) -> int:
        """Bytes of files."""
        return sum(fs.getFileStatus(p).getLen() for fs, p in map(self._at, paths))

    def uris(self, path: str, ending: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().endswith(ending) and s.getLen() > 0)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def create(self, path: str, text: str, replace: bool = False) -> bool:
        """Puts a whole new file in place; False if there is one already, unless it is to be replaced."""
        folder, _, name = path.rpartition("/")
        aside = f"{folder}/.{name}-{uuid.uuid4().hex}"
        self._write(aside, text)
        fs, p = self._at(path)
        hadoop, nio = self.jvm.org.apache.hadoop.fs, self.jvm.java.nio.file
        try:
            if fs.getScheme() == "file" and not replace:  # a link fails if the name is taken; a local rename doesn't
                nio.Files.createLink(nio.Path.of(fs.makeQualified(p).toUri()), nio.Path.of(fs.makeQualified(hadoop.Path(aside)).toUri()))
            else:
                rename = getattr(hadoop, "Options$Rename")
                how = self.spark._sc._gateway.new_array(rename, 1)
                how[0] = rename.OVERWRITE if replace else rename.NONE
                hadoop.FileContext.getFileContext(fs.makeQualified(p).toUri(), self.conf).rename(hadoop.Path(aside), p, how)
        except Exception as e:
            if fs.exists(p) and not replace:
                return False
            raise EngineError(f"can't write {path}") from e
        finally:
            self.remove(aside)
        return True


@dataclass(frozen=True)
class Manifest:
    table: str
    table_id: str
    version: int
    columns: list[list[str]]
    files: list[str] = field(default_factory=list)
    deleted: list[str] = field(default_factory=list)
    next_rid: int = 0
    row_count: int = 0
    changed_at: float = 0.0

    @property
    def schema(self) -> T.StructType:
        return schema_of([(n, k) for n, k in self.columns])

    @property
    def stored(self) -> T.StructType:
        return T.StructType([T.StructField(RID, T.LongType()), *(T.StructField(f.name, f.dataType) for f in self.schema.fields)])


def _manifest(text: str) -> Manifest:
    try:
        found = Manifest(**json.loads(text))
        found.schema  # noqa: B018  checks the types
    except (ValueError, TypeError, InvalidSchema) as e:
        raise CorruptManifest(f"a manifest can't be read: {e}") from e
    if found.version < 0 or found.next_rid < 0 or found.row_count < 0 or found.row_count > found.next_rid:
        raise CorruptManifest(f"the manifest of {found.table} has impossible numbers")
    return found


class Store:
    """All databases under one folder."""

    def __init__(self, spark: SparkSession, warehouse: str):
        self.spark, self.root, self.fs = spark, warehouse.rstrip("/"), Files(spark)
        self.fs.make(self.root)

    # databases

    def create_database(self, name: str) -> None:
        if not _DATABASE.fullmatch(name or ""):
            raise InvalidSchema(f"{name!r} can't name a database")
        if self.has_database(name):
            raise AlreadyExists(f"database {name} exists")
        self.fs.make(f"{self.root}/{name}")
        self.fs.create(f"{self.root}/{name}/database.json", json.dumps({"name": name, "created_at": time.time()}))

    def has_database(self, name: str) -> bool:
        return self.fs.exists(f"{self.root}/{name}/database.json")

    def need_database(self, name: str) -> None:
        if not self.has_database(name):
            raise DatabaseNotFound(f"no database {name}")

    def drop_database(self, name: str) -> None:
        self.need_database(name)
        self.fs.remove(f"{self.root}/{name}")

    def databases(self) -> list[str]:
        return [n for n in self.fs.names(self.root) if n != INDEXES and self.has_database(n)]

    # tables

    def table(self, database: str, name: str) -> StoredTable:
        self.need_database(database)
        path = self._path(database, name)
        if not self.fs.exists(f"{path}/_manifest"):
            raise TableNotFound(f"no table {name} in {database}")
        return StoredTable(self, path)

    def has_table(self, database: str, name: str) -> bool:
        return self.has_database(database) and self.fs.exists(f"{self._path(database, name)}/_manifest")

    def create_table(self, database: str, name: str, columns: list[tuple[str, str]]) -> StoredTable:
        self.need_database(database)
        if not _TABLE.fullmatch(name or ""):
            raise InvalidSchema(f"{name!r} can't name a table")
        if any(n.lower() == RID for n, _ in columns):
            raise InvalidSchema(f"{RID} is the engine's own column")
        schema = schema_of(columns)
        kinds = {f.name: k for f, (_, k) in zip(schema.fields, columns)}
        first = Manifest(name.lower(), uuid.uuid4().hex, 0, [[n, kinds[n].upper()] for n in schema.names], changed_at=time.time())
        path = self._path(database, name)
        self.fs.make(f"{path}/_manifest")
        if not self.fs.create(f"{path}/_manifest/{0:010d}.json", json.dumps(asdict(first))):
            raise AlreadyExists(f"table {name} exists in {database}")
        return StoredTable(self, path)

    def drop_table(self, database: str, name: str) -> None:
        self.table(database, name)
        self.fs.remove(self._path(database, name))

    def tables(self, database: str) -> list[str]:
        self.need_database(database)
        return [n for n in self.fs.names(f"{self.root}/{database}") if self.fs.exists(f"{self.root}/{database}/{n}/_manifest")]

    def _path(self, database: str, name: str) -> str:
        return f"{self.root}/{database}/{name.lower()}"


class StoredTable:
    """One table; every read and change starts from its latest manifest."""

    def __init__(self, store: Store, path: str):
        self.store, self.spark, self.fs, self.path = store, store.spark, store.fs, path

    def _versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.fs.names(f"{self.path}/_manifest") if n.endswith(".json"))

    def _at(self, version: int) -> str:
        return f"{self.path}/_manifest/{version:010d}.json"

    def _latest(self) -> int:
        """The newest version: on from a hint, so that long histories needn't be listed."""
        hint = f"{self.path}/_latest"
        try:
            now = int(self.fs.read(hint)) if self.fs.exists(hint) else None
        except ValueError:
            now = None
        if now is None or not self.fs.exists(self._at(now)):
            found = self._versions()
            if not found:
                raise CorruptManifest(f"{self.path} has no manifest")
            now = found[-1]
        while self.fs.exists(self._at(now + 1)):
            now += 1
        return now

    def manifest(self, version: int | None = None) -> Manifest:
        at = self._at(self._latest() if version is None else version)
        if version is not None and not self.fs.exists(at):
            raise CorruptManifest(f"{self.path} has no manifest {version}")
        return _manifest(self.fs.read(at))

    def _read(self, m: Manifest, files: list[str]) -> DataFrame:
        return self.spark.read.schema(m.stored).parquet(*files) if files else self.spark.createDataFrame([], m.stored)

    def _write(self, frame: DataFrame) -> list[str]:
        folder = f"{self.path}/data-{uuid.uuid4().hex}"
        frame.write.parquet(folder)
        return self.fs.uris(folder, ".parquet")

    def _commit(self, before: Manifest, **changes: Any) -> Manifest:
        after = replace(before, version=before.version + 1, changed_at=time.time(), **changes)
        if not self.fs.create(self._at(after.version), json.dumps(asdict(after))):
            raise EngineError(f"{before.table} was changed by someone else")
        self.fs.create(f"{self.path}/_latest", str(after.version), replace=True)
        return after

    # reading

    def rows(self, with_rid: bool = False, version: int | None = None) -> DataFrame:
        """The active rows, of the latest or an earlier version."""
        m = self.manifest(version)
        frame = self._read(m, m.files)
        return frame if with_rid else frame.drop(RID)

    def all_rows(self) -> DataFrame:
        """Active and deleted rows with ``_rid`` and ``_deleted``."""
        m = self.manifest()
        return self._read(m, m.files).withColumn("_deleted", F.lit(False)).union(self._read(m, m.deleted).withColumn("_deleted", F.lit(True)))

    def record(self, rid: int) -> DataFrame:
        """The row of an id. Row ids ascend within files, so the scan skips most row groups."""
        return self.rows(with_rid=True).where(F.col(RID) == rid)

    def need_record(self, rid: int) -> Any:
        found = self.record(rid).take(1)
        if not found:
            raise RecordNotFound(f"no active record {rid}")
        return found[0]

    def located(self) -> DataFrame:
        """Rows with ``_rid`` and their place: ``_file`` and ``_position`` in it."""
        return self.rows(with_rid=True).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_position")) if self.manifest().files else self.rows(with_rid=True).withColumns({"_file": F.lit(None).cast("string"), "_position": F.lit(None).cast("long")})

    def at(self, file: str, position: int) -> Any:
        """The row at a place."""
        found = self.located().where((F.col("_file") == file) & (F.col("_position") == position)).take(1)
        if not found:
            raise RecordNotFound(f"no record at {position} of {file}")
        return found[0]

    def place_of(self, rid: int) -> tuple[str, int]:
        found = self.located().where(F.col(RID) == rid).select("_file", "_position").take(1)
        if not found:
            raise RecordNotFound(f"no active record {rid}")
        return found[0][0], found[0][1]

    def contains(self, rid: int) -> bool:
        """Whether the id is or was a record's."""
        return bool(self.all_rows().where(F.col(RID) == rid).take(1))

    def is_active(self, rid: int) -> bool:
        return bool(self.record(rid).take(1))

    def active_count(self) -> int:
        return self.manifest().row_count

    def total_count(self) -> int:
        return self.manifest().next_rid

    # changing

    def append(self, frame: DataFrame) -> int:
        """Adds a frame's rows, whose columns are the table's, and returns their number.

        The rows are written, counted per file, and numbered on; no row goes through the driver.
        """
        m = self.manifest()
        typed = frame.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in m.schema.fields))
        numbered = typed.withColumn("_part", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        folder = f"{self.path}/staged-{uuid.uuid4().hex}"
        numbered.write.parquet(folder)
        staged = self.spark.read.schema(numbered.schema).parquet(folder)
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
        sizes = staged.groupBy("_part").agg((F.max("_n") + 1).alias("_size"))
        starts = sizes.select("_part", (F.coalesce(F.sum("_size").over(before), F.lit(0)) + m.next_rid).alias("_start"))
        total = m.next_rid + (sizes.agg(F.sum("_size")).first()[0] or 0)
        if total == m.next_rid:
            self.fs.remove(folder)
            return 0
        files = self._write(staged.join(F.broadcast(starts), "_part").select((F.col("_start") + F.col("_n")).alias(RID), *m.schema.names))
        self.fs.remove(folder)
        self._commit(m, files=m.files + files, next_rid=total, row_count=m.row_count + total - m.next_rid)
        if len(m.files) >= MERGE_AT:
            self.merge()
        return total - m.next_rid

    def insert(self, values: tuple[Any, ...]) -> int:
        """Adds one row and returns its id."""
        m = self.manifest()
        row = self.spark.createDataFrame([(m.next_rid, *values)], m.stored).coalesce(1)
        self._commit(m, files=m.files + self._write(row), next_rid=m.next_rid + 1, row_count=m.row_count + 1)
        if len(m.files) >= MERGE_AT:
            self.merge()
        return m.next_rid

    def merge(self) -> None:
        """Rewrites the data files as few."""
        m = self.manifest()
        if len(m.files) > 1:
            frame = self._read(m, m.files)
            parts = max(1, -(-len(m.files) // MERGE_AT))
            self._commit(m, files=self._write(frame.repartitionByRange(parts, RID).sortWithinPartitions(RID)))

    def _touched(self, m: Manifest, where: Column) -> tuple[dict[str, int], int]:
        """Files with matching rows, and how many rows match; a row a file reaches the driver."""
        if not m.files:
            return {}, 0
        hits = self._read(m, m.files).where(where).groupBy(F.input_file_name().alias("f")).count().collect()
        by_name = {f.rsplit("/", 1)[1]: f for f in m.files}
        return {by_name[r.f.rsplit("/", 1)[1]]: r["count"] for r in hits}, sum(r["count"] for r in hits)

    def update(self, changes: dict[str, Column], where: Column) -> int:
        """Sets columns in the rows that match; returns their number. Other rows, and files without one, stay."""
        m = self.manifest()
        touched, n = self._touched(m, where)
        if n:
            frame = self._read(m, list(touched))
            new = frame.select(*(F.when(where, changes[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in changes else F.col(f"`{c}`") for c in frame.columns))
            self._commit(m, files=[f for f in m.files if f not in touched] + self._write(new))
        return n

    def delete(self, where: Column) -> int:
        """Removes the rows that match; returns their number. They stay readable through ``all_rows``."""
        m = self.manifest()
        touched, n = self._touched(m, where)
        if n:
            frame = self._read(m, list(touched))
            kept = self._write(frame.where(~where))
            gone = self._write(frame.where(where))
            self._commit(m, files=[f for f in m.files if f not in touched] + kept, deleted=m.deleted + gone, row_count=m.row_count - n)
        return n

    def insert_with_place(self, values: tuple[Any, ...]) -> tuple[int, str, int]:
        """Adds one row and returns its id and place. A place holds until the next change of its file."""
        rid = self.insert(values)
        return rid, *self.place_of(rid)

    def update_at(self, file: str, position: int, values: tuple[Any, ...]) -> tuple[str, int]:
        """Changes the row at a place; returns its new place."""
        rid = self.at(file, position)[RID]
        self.update_record(rid, values)
        return self.place_of(rid)

    def delete_at(self, file: str, position: int) -> None:
        self.delete_record(self.at(file, position)[RID])

    def update_record(self, rid: int, values: tuple[Any, ...]) -> None:
        self.need_record(rid)
        m = self.manifest()
        self.update({f.name: F.lit(v).cast(f.dataType) for f, v in zip(m.schema.fields, values)}, F.col(RID) == rid)

    def delete_record(self, rid: int) -> None:
        self.need_record(rid)
        self.delete(F.col(RID) == rid)

    # upkeep

    def statistics(self) -> dict[str, Any]:
        """What the manifest and the files tell, without reading rows."""
        m = self.manifest()
        return {"table": m.table, "table_id": m.table_id, "version": m.version, "row_count": m.row_count, "deleted_count": m.next_rid - m.row_count, "next_rid": m.next_rid, "files": len(m.files), "bytes": self.fs.size(m.files), "changed_at": m.changed_at}

    def vacuum(self, keep: int = 10, older_than: float = 86_400.0) -> int:
        """Removes all but the newest ``keep`` versions, and data files that none of those names; returns how many files.

        Files younger than ``older_than`` seconds stay, since a writer may be about to name them.
        """
        versions = self._versions()
        gone, kept = versions[:-keep], versions[-keep:]
        named = {f.rsplit("/", 1)[1] for v in kept for m in [self.manifest(v)] for f in (*m.files, *m.deleted)}
        for v in gone:
            self.fs.remove(self._at(v))
        removed = 0
        for folder in (n for n in self.fs.names(self.path) if n.startswith(("data-", "staged-"))):
            at = f"{self.path}/{folder}"
            left = 0
            for name in (n for n in self.fs.names(at) if n.endswith(".parquet")):
                if name in named or not self.fs.older(f"{at}/{name}", older_than):
                    left += 1
                else:
                    self.fs.remove(f"{at}/{name}")
                    removed += 1
            if not left and self.fs.older(at, older_than):
                self.fs.remove(at)
        return removed
