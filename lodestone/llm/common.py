"""Helpers shared by the corpus operators: scratch tables, size-checked joins, let-bindings.

Column names that begin with ``__ls_`` are reserved for the operators' own use.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space that separates words, as a regular expression class.
WHITE = r"\x20\x09-\x0D"
#: A side is broadcast only when it was counted and takes at most so many bytes, by its rows and columns.
BROADCAST_BYTES = 16 << 20
_ROW, _FIXED, _VARIABLE = 16, 8, 64
#: Paths written inside ``kept_only``, innermost last.
_open: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none (tests on one machine), a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it back, so lost executors recompute nothing before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept_only(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Materialize what ``make`` gives; the tables that were written on the way are removed then."""
    _open.append([])
    kept = None
    try:
        out = materialize(make(), name)
        kept = _open[-1].pop()
        return out
    finally:
        hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        for path in _open.pop():
            at = hadoop.Path(path)
            at.getFileSystem(conf).delete(at, True)
        if kept and _open:
            _open[-1].append(kept)


def checkpoint(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def broadcast_rows(df: DataFrame) -> int:
    """How many rows of these columns fit in BROADCAST_BYTES; texts and nested values count as _VARIABLE bytes."""
    fixed = (T.NumericType, T.BooleanType, T.DatetimeType)
    return BROADCAST_BYTES // (_ROW + sum(_FIXED if isinstance(f.dataType, fixed) else _VARIABLE for f in df.schema.fields))


def small(df: DataFrame) -> bool:
    """Whether a written narrow table is small enough to broadcast; reads no more rows than that takes."""
    rows = broadcast_rows(df)
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows


def hinted(df: DataFrame) -> DataFrame:
    """A broadcast hint behind a check of the size; beyond it the join shuffles as usual."""
    return F.broadcast(df) if small(df) else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def added(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with new columns; an input column of the same name, in any case, gives way."""
    names = {c.lower() for c in columns}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    return df.select(*kept, *(v.alias(k) for k, v in columns.items()))


def python_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lower the rows that go to Python at once, since texts can be long; never raises the session's own value."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
