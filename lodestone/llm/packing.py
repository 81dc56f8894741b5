"""Packing token pieces into sequences by a configuration linear program.

The program runs on the histogram of piece lengths, whose size doesn't depend on the corpus: lengths are put
into classes, a configuration says how many pieces of each class share a sequence, and the fewest configurations
that cover all pieces are found by multiplicative weights, priced by a knapsack dynamic program. The fractional
solution is rounded down to whole sequences. Real lengths are shorter than their class's, so the smallest place of a
configuration, and any room left, goes to the longest pieces that fit; what the rounding left over is packed
best-fit as well.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, materialize, partitions, python_batches, table
from .tokens import batches, tokenizer

CAPACITY = 4096
END = 1
CLASSES, UNITS = 128, 256
EPSILON, ROUNDS = 0.3, 2.0
#: Up to so many classes, lengths count by the token, not in units.
EXACT = 16


# ---- the linear program


def classes_of(lengths: np.ndarray, counts: np.ndarray, most: int = CLASSES) -> list[np.ndarray]:
    """Ascending lengths cut into at most ``most`` runs of about equal token mass, as index arrays."""
    if len(lengths) <= most:
        return [np.array([k]) for k in range(len(lengths))]
    mass = np.cumsum(lengths * counts.astype(float))
    part = np.minimum((mass / mass[-1] * most).astype(int), most - 1)
    return [np.flatnonzero(part == k) for k in np.unique(part)]


def price(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items within ``room`` units: its value and the count of each item."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    order = np.argsort(sizes, kind="stable")
    sized, valued = sizes[order], values[order]
    upto = np.searchsorted(sized, np.arange(room + 1), side="right")
    for w in range(1, room + 1):
        best[w] = best[w - 1]
        if n := upto[w]:
            gain = best[w - sized[:n]] + valued[:n]
            k = int(gain.argmax())
            if gain[k] > best[w]:
                best[w], pick[w] = gain[k], k
    counts, w = np.zeros(len(sizes), np.int64), room
    while w > 0:
        if pick[w] < 0:
            w -= 1
        else:
            counts[order[pick[w]]] += 1
            w -= sized[pick[w]]
    return float(best[room]), counts


def configuration_lp(sizes: np.ndarray, demand: np.ndarray, room: int = UNITS, epsilon: float = EPSILON, rounds: float = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used, covering ``demand`` fractionally with few uses.

    Multiplicative weights for the covering program: the class that is covered least weighs most; each step
    uses the best-paying configuration as often as covers one of its classes once over, and lowers the weights
    of what it covers. Steps count once the weights have settled, that is when every class has been covered log(n) /
    epsilon times; then until each is covered ``rounds`` / epsilon times more. The uses are at last scaled so that the
    least covered class is covered just once.
    """
    n = len(sizes)
    weight = -np.log(demand)
    covered, goal, settled = np.zeros(n), np.log(n) / epsilon, False
    uses: dict[bytes, float] = {}
    while True:
        if covered.min() >= goal:
            if settled:
                break
            covered, goal, settled, uses = np.zeros(n), rounds / epsilon, True, {}
        _, config = price(np.exp(weight - weight.max()), sizes, room)
        share = config / demand
        step = 1.0 / share.max()
        uses[config.tobytes()] = uses.get(config.tobytes(), 0.0) + step
        covered += share * step
        weight -= epsilon * share * step
    return [(np.frombuffer(k, np.int64), x / covered.min()) for k, x in uses.items()]


# ---- from the program to sequences


@dataclass
class _Run:
    """``times`` sequences with the same lengths, each length with its count."""

    times: int
    lengths: dict[int, int] = field(default_factory=dict)


class _Left:
    """Pieces that have no place yet, by length."""

    def __init__(self, histogram: dict[int, int]):
        self.n = dict(histogram)
        self.lengths = sorted(self.n)

    def take(self, length: int, n: int) -> None:
        self.n[length] -= n
        if not self.n[length]:
            del self.n[length]
            self.lengths.pop(bisect_right(self.lengths, length) - 1)

    def fitting(self, room: int, used: dict[int, int]) -> int:
        """The longest length up to ``room`` of which more are left than ``used``; 0 if there is none."""
        k = bisect_right(self.lengths, room) - 1
        while k >= 0 and self.n[self.lengths[k]] <= used.get(self.lengths[k], 0):
            k -= 1
        return self.lengths[k] if k >= 0 else 0

    def place(self, slots: dict[int, int], times: int, capacity: int, out: list[_Run]) -> int:
        """Makes as many sequences of these pieces as there are pieces for, ``times`` at most, and returns their
        number. The room left in them is first filled with the longest pieces that fit."""
        room = capacity - sum(length * k for length, k in slots.items())
        while length := self.fitting(room, slots):
            slots[length] = slots.get(length, 0) + 1
            room -= length
        now = min(times, *(self.n[length] // k for length, k in slots.items()))
        for length, k in slots.items():
            self.take(length, k * now)
        out.append(_Run(now, slots))
        return now


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[_Run]:
    """Runs of sequences that place every piece of a histogram of lengths in 1..capacity."""
    runs = [_Run(n, {capacity: 1}) for length, n in histogram.items() if length == capacity]
    rest = {int(k): int(n) for k, n in histogram.items() if 0 < k < capacity and n > 0}
    if any(k <= 0 or k > capacity for k in histogram):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    if not rest:
        return runs
    left = _Left(rest)
    lengths = np.array(sorted(rest))
    counts = np.array([rest[int(k)] for k in lengths])
    groups = classes_of(lengths, counts)
    unit = 1 if len(groups) <= EXACT else -(-capacity // UNITS)
    sizes = np.minimum([-(-int(lengths[g[-1]]) // unit) for g in groups], capacity // unit)
    demand = np.array([counts[g].sum() for g in groups], float)
    members = [[int(x) for x in lengths[g]] for g in groups]
    for config, use in sorted(configuration_lp(sizes, demand, capacity // unit, EPSILON), key=lambda x: -x[1]):
        times, config = int(use), config.copy()
        last = np.flatnonzero(config)[0]
        if config.sum() > 1 and len(members[last]) > 1:  # the smallest place goes to whatever real length fits best
            config[last] -= 1
        while times:
            slots: dict[int, int] = {}
            for k in np.flatnonzero(config):
                need = int(config[k])
                pool = members[k]
                while pool and pool[-1] not in left.n:
                    pool.pop()
                for length in reversed(pool):
                    if not need:
                        break
                    took = min(need, left.n.get(length, 0))
                    if took:
                        slots[length] = slots.get(length, 0) + took
                        need -= took
            if not slots:
                break
            times -= left.place(slots, times, capacity, runs)
    while left.lengths:
        length = left.lengths[-1]
        left.place({length: 1}, left.n[length], capacity, runs)
    return runs


def layout(runs: list[_Run]) -> tuple[np.ndarray, ...]:
    """Where the r-th piece of each length goes: sorted (length, first rank), and per sequence count, first sequence, offset."""
    seen: dict[int, int] = {}
    rows, first = [], 0
    for run in runs:
        offset = 0
        for length, each in sorted(run.lengths.items(), reverse=True):
            rank = seen.get(length, 0)
            rows.append((length, rank, each, first, offset))
            seen[length] = rank + each * run.times
            offset += each * length
        first += run.times
    found = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return tuple(np.ascontiguousarray(found[:, k]) for k in range(5))


# ---- on DataFrames

_LAYOUT = ("size", "start", "each", "first", "at")


def _div(a: Column, b: Column) -> Column:
    """Whole division of numbers that aren't negative, exact for all longs."""
    return F.call_function("div", a, b)


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` of 1..capacity, in few sequences without gaps.

    Only the histogram of lengths, at most ``capacity`` rows, goes to the driver, and only the plan's layout,
    bounded by the number of lengths and configurations, goes to the executors. Each piece gets its rank among
    those of its length: pieces of a length are dealt by a hash of all their columns and ranked within each share, so
    neither a length nor a key that a third of all pieces have is a hot task. Pieces equal in all columns are
    interchangeable. The pieces are read several times and should be a written table. An empty table gives an empty
    result; input columns named sequence_id or offset give way; a length that is null or outside 1..capacity is an error.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    shares = partitions(spark)
    dealt = pieces.withColumn("__ls_share", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in pieces.columns)), F.lit(shares)).cast("int"))
    n = materialize(dealt.groupBy(length, "__ls_share").agg(F.count(F.lit(1)).alias("__ls_n")), "lengths")
    histogram = {int(r[0]): int(r[1]) for r in n.groupBy(length).agg(F.sum("__ls_n")).collect()}
    segments = layout(plan(histogram, capacity))
    before = Window.partitionBy(length).orderBy("__ls_share").rowsBetween(Window.unboundedPreceding, -1)
    bases = n.select(length, "__ls_share", F.coalesce(F.sum("__ls_n").over(before), F.lit(0)).alias("__ls_base"))
    within = Window.partitionBy(length, "__ls_share").orderBy(*(c for c in dealt.columns if c not in (length, "__ls_share")))
    ranked = dealt.withColumn("__ls_rank", F.row_number().over(within) - 1).join(bases, [length, "__ls_share"])
    ranked = ranked.withColumn("__ls_rank", (F.col("__ls_base") + F.col("__ls_rank")).cast("long"))
    places = spark.createDataFrame(pd.DataFrame(dict(zip(_LAYOUT, segments))), ", ".join(f"{c} long" for c in _LAYOUT))
    lists = places.groupBy("size").agg(F.sort_array(F.collect_list(F.struct("start", "each", "first", "at"))).alias("__ls_runs"))
    steps = F.array(*(F.lit(1 << k) for k in range(max(len(segments[0]), 1).bit_length() - 1, -1, -1)))

    def run_of(runs: Column, rank: Column) -> Column:
        """The last run that begins at or before the rank, by halving."""
        last = F.aggregate(steps, F.lit(0), lambda k, step: F.when((k + step < F.size(runs)) & (F.get(runs, k + step)["start"] <= rank), k + step).otherwise(k))
        return let(F.get(runs, last), lambda x: F.struct((x["first"] + _div(rank - x["start"], x["each"])).alias("s"), (x["at"] + F.pmod(rank - x["start"], x["each"]) * F.col("size")).alias("o")))

    # the layout is bounded by the lengths and configurations, whatever the corpus
    placed = ranked.join(F.broadcast(lists), F.col(length) == F.col("size")).withColumn("__ls_at", run_of(F.col("__ls_runs"), F.col("__ls_rank")))
    return placed.select(*pieces.columns, F.col("__ls_at.s").cast("long").alias("sequence_id"), F.col("__ls_at.o").cast("long").alias("offset"))


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents to pieces (key, piece, start, length, ids_crc32[, ids]) of at most ``capacity`` token ids.

    A document's ids are the tokenizer's, then ``end``; a null text is empty. Only longer ones are cut, into
    whole pieces and a last one. ids: little-endian unsigned 32-bit. Each row gives its own pieces, repeated rows and
    null keys too; the key is cast to long, so it must be a number or text of one; an empty table gives none; other
    columns are left out. A text of any length is encoded whole, in a worker's memory.
    """
    python_batches(docs.sparkSession, 2000)
    schema = f"{key} long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    mark = np.array([end], "<u4").tobytes()

    def cut(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode
        for batch in rows:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in batches(texts):
                out = [[] for _ in range(6)]
                for name, ids in zip(keys[a:b], encode(texts[a:b])):
                    ids += mark
                    for k, at in enumerate(range(0, len(ids), capacity * 4)):
                        piece = ids[at : at + capacity * 4]
                        for column, value in zip(out, (name, k, at // 4, len(piece) // 4, zlib.crc32(piece), piece)):
                            column.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                names = (key, "piece", "start", "length", "ids_crc32", "ids")
                columns = [pa.array(v, t) for v, t in zip(out, kinds)][: 5 + with_ids]
                yield pa.RecordBatch.from_arrays(columns, names=list(names[: 5 + with_ids]))

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(cut, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Documents to packed pieces; see ``token_pieces`` and ``pack``. The pieces are written once."""
    return pack(materialize(token_pieces(docs, path, capacity, with_ids=with_ids), "pieces"), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
