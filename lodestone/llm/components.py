"""Connected components by alternating large-star and small-star steps, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _joined(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with the least neighbour of their u. The minima are written first: a plain scan on either side lets
    adaptive execution split the edges of a hub."""
    return edges.join(materialize(least, "least"), "u")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _joined(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _joined(down, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) of any orderable type to (node, root): every node with an edge, and its component's least node.

    Self-links and nulls are ignored; repeated edges count once. Each half round is written to the shared folder;
    the rounds grow with the logarithm of the longest chain. A hub's neighbours are never gathered in one row: each
    step is a partial minimum and a join back, which adaptive execution can split.
    """
    now = materialize(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct(), "edges")
    state = _state(now)
    while state[0]:
        large = materialize(_large(now).where("u <> v").distinct(), "large-star")
        now = materialize(_small(large).where("u <> v").distinct(), "small-star")
        after = _state(now)
        if after == state:
            break
        state = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
