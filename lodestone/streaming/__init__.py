"""SELECT statements over streams: the same compiler, with a streaming table registered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..errors import QueryError
from ..plans import tree as t
from ..plans.parser import parse
from ..session import Engine


def streaming_select(engine: Engine, sql: str) -> DataFrame:
    """A SELECT whose tables may be streams. Order and limits need the end of the input, so they aren't allowed."""
    parsed = parse(sql)
    if not isinstance(parsed, t.Select):
        raise QueryError("a stream can only be selected from")
    if parsed.order_by or parsed.limit is not None or parsed.fetch is not None:
        raise QueryError("a stream has no order and no limit")
    return engine.execute(parsed).dataframe


def start(engine: Engine, sql: str, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs a SELECT over streams into parquet files, over what there is now."""
    out = streaming_select(engine, sql)
    return out.writeStream.format("parquet").outputMode(mode).option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
