"""SimHash near-duplicates through a Gray-order hierarchical index.

Sorted by Gray rank, fingerprints whose leading bits agree lie together; runs of them are factored into nodes that hold
the bits all their codes share, a child adding only what its parent lacks; and pairs of nodes are pruned, group by
group, by the differences accumulated on the way down. The same descent is made twice: among Spark rows, from the
ranges of the Gray order (all codes under a prefix) to the pairs of ranges that may hold links, before any code is
sent; and inside a task, from the ranges that meet there to the leaves.

Of ``most`` differences in 64 bits, one of most // 2 + 1 parts holds at most one. So there are as many Gray orders, each
with the codes rotated to begin with another part, and in each order pairs of nodes with two differences among the
leading part's bits are pruned as well: another order finds their links. No link is missed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, hinted, materialize, partitions, table
from .components import connected_components

BITS = 64
SEED = 42
WORDS = 4
MAX_DIFFERENCES = 4
LEAF, FANOUT = 16, 4
#: Codes under a prefix: at least and at most so many are aimed at, and in between what gives about GROUPS groups.
MIN_CELL, MAX_CELL, GROUPS = 4096, 1 << 18, 48
#: Bits by which prefixes of too many codes get longer.
STEP = 4
#: Pairs of nodes, and pairs of leaves, that a task looks at together.
_PAIRS, _LEAVES = 1 << 15, 1 << 11
#: Shingles in a chunk of texts whose similarity is verified; a task holds two chunks.
CHUNK_SHINGLES = 1 << 17

# ---- fingerprints


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another hash of the same shingles for the k-th fingerprint: a 64-bit finalizer; the 0th is the hash itself."""
    if k:
        h = h + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


def shingles(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Hashes of a text's word shingles in their order; a text of fewer words is one shingle, one without words has none."""
    import xxhash

    found = (text or "").encode().lower().split()  # bytes: lower-cases A-Z, splits at ASCII white space
    if not found:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) < words:
        return np.array([digest(joined, seed)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts.tolist(), ends[words - 1 :].tolist())), np.uint64, len(found) - words + 1)


def _simhashes(h: np.ndarray, tables: int) -> list[int]:
    if not len(h):
        return [0] * tables
    ones = np.zeros((tables, BITS), np.int64)
    for part in range(0, len(h), 8192):
        for k in range(tables):
            piece = _mixed(h[part : part + 8192], k)
            ones[k] += np.unpackbits(piece.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h), axis=1).view(">u8").astype(np.uint64).view(np.int64).ravel().tolist()


def _minwise(h: np.ndarray, tables: int) -> list[int]:
    """Fingerprints of which each bit is one bit of the shingles' minimum under a hash of its own.

    Of two texts of shingle similarity s a bit differs with probability (1 - s) / 2: 6.4 of 64 bits at 0.8.
    """
    if not len(h):
        return [0] * tables
    h = np.unique(h)
    factors = np.random.default_rng(SEED).integers(0, 2**63, (tables, BITS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    bits = np.zeros((tables, BITS), np.uint8)
    for k in range(tables):
        least = np.full(BITS, 2**64 - 1, np.uint64)
        for part in range(0, len(h), 2048):
            least = np.minimum(least, (factors[k] * h[part : part + 2048]).min(axis=1))
        bits[k] = (least >> np.uint64(20)) & np.uint64(1)
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64).view(np.int64).ravel().tolist()


def fingerprint(text: str | None, words: int = WORDS, tables: int = 1, seed: int = SEED, minwise: int = 0) -> list[int]:
    """SimHashes of a text's word shingles as signed 64-bit numbers, ``tables`` independent ones, then ``minwise``
    min-wise fingerprints; 0 without words."""
    h = shingles(text, words, seed)
    return _simhashes(h, tables) + (_minwise(h, minwise) if minwise else [])


def fingerprints(text: Column, words: int = WORDS, tables: int = 1, minwise: int = 0) -> Column:
    """array<bigint> of a text's fingerprints."""

    @F.pandas_udf("array<bigint>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(t, words, tables, minwise=minwise))

    return of(text)


# ---- the index, on the codes of a task's group


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray sequence (its inverse Gray transform)."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Nodes over codes in Gray order. Level 0 are runs of LEAF codes; each higher node joins FANOUT nodes.

    ``foreign`` marks codes whose links to each other are looked for elsewhere. ``looked`` counts by level the pairs of
    nodes that were looked at and ``compared`` the pairs of codes.
    """

    def __init__(self, codes: np.ndarray, foreign: np.ndarray | None = None):
        self.codes, self.foreign = codes, np.zeros(len(codes), bool) if foreign is None else foreign
        starts = np.arange(0, len(codes), LEAF)
        ones, any_, far = np.bitwise_and.reduceat(codes, starts), np.bitwise_or.reduceat(codes, starts), np.logical_and.reduceat(self.foreign, starts)
        self.masks, self.patterns, self.far = [ones | ~any_], [ones], [far]
        while len(ones) > FANOUT:
            starts = np.arange(0, len(ones), FANOUT)
            ones, any_, far = np.bitwise_and.reduceat(ones, starts), np.bitwise_or.reduceat(any_, starts), np.logical_and.reduceat(far, starts)
            self.masks.append(ones | ~any_)
            self.patterns.append(ones)
            self.far.append(far)
        self.looked, self.compared = [0] * len(self.masks), 0

    def links(self, most: int, lead: int = 0, few: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of the links with at most ``most`` differences, as positions (a, b).

        Pairs of nodes with more than ``few`` differences among the ``lead`` leading bits are pruned too.
        """
        forest, top = _Forest(len(self.codes)), len(self.masks) - 1
        leading = np.uint64(((1 << lead) - 1) << (BITS - lead))
        i, j = np.triu_indices(len(self.masks[top]))
        step = np.arange(FANOUT)
        left, right = np.repeat(step, FANOUT), np.tile(step, FANOUT)
        todo = [(top, i, j, np.zeros(len(i), np.uint64), np.zeros((2, len(i)), np.int8))]
        while todo:
            level, i, j, seen, acc = todo.pop()
            most_now = _PAIRS if level else _LEAVES
            if len(i) > most_now:
                todo.append((level, i[most_now:], j[most_now:], seen[most_now:], acc[:, most_now:]))
                i, j, seen, acc = i[:most_now], j[:most_now], seen[:most_now], acc[:, :most_now]
            self.looked[level] += len(i)
            shared = self.masks[level][i] & self.masks[level][j]
            new = (self.patterns[level][i] ^ self.patterns[level][j]) & shared & ~seen  # what the parents had is counted
            acc = acc + np.stack([np.bitwise_count(new), np.bitwise_count(new & leading)]).astype(np.int8)
            ok = (acc[0] <= most) & (acc[1] <= few if lead else True) & ~(self.far[level][i] & self.far[level][j])
            i, j, shared, acc = i[ok], j[ok], shared[ok], acc[:, ok]
            if not len(i):
                continue
            if level == 0:
                self._leaves(i, j, most, forest)
                continue
            size = len(self.masks[level - 1])
            ci, cj = (i[:, None] * FANOUT + left).ravel(), (j[:, None] * FANOUT + right).ravel()
            ok = (ci < size) & (cj < size) & (ci <= cj)
            ci, cj, seen, acc = ci[ok], cj[ok], np.repeat(shared, FANOUT * FANOUT)[ok], np.repeat(acc, FANOUT * FANOUT, axis=1)[:, ok]
            own = ci == cj  # a node with itself comes first: what it links needn't be looked at again
            todo.append((level - 1, ci[~own], cj[~own], seen[~own], acc[:, ~own]))
            todo.append((level - 1, ci[own], cj[own], seen[own], acc[:, own]))
        return forest.edges()

    def _leaves(self, i: np.ndarray, j: np.ndarray, most: int, forest: _Forest) -> None:
        one = forest.uniform(LEAF)
        if one is not None:  # both leaves already in one tree: nothing to learn
            ok = ~((one[i] >= 0) & (one[i] == one[j]))
            i, j = i[ok], j[ok]
        step = np.arange(LEAF)
        a = (i[:, None] * LEAF + np.repeat(step, LEAF)).ravel()
        b = (j[:, None] * LEAF + np.tile(step, LEAF)).ravel()
        ok = (a < b) & (b < len(self.codes))
        a, b = a[ok], b[ok]
        self.compared += len(a)
        near = (np.bitwise_count(self.codes[a] ^ self.codes[b]) <= most) & ~(self.foreign[a] & self.foreign[b])
        forest.add(a[near], b[near])


class _Forest:
    """Labels by least position; links are folded in as they come, never kept."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.touched, self.known = False, None

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            ra, rb = label[a], label[b]
            ok = ra != rb
            a, b, ra, rb = a[ok], b[ok], ra[ok], rb[ok]
            if not len(a):
                break
            self.touched, self.known = True, None
            np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up

    def uniform(self, run: int) -> np.ndarray | None:
        """The label of each run whose positions all have the same, else -1."""
        if self.touched and self.known is None:
            starts = np.arange(0, len(self.label), run)
            low, high = np.minimum.reduceat(self.label, starts), np.maximum.reduceat(self.label, starts)
            self.known = np.where(low == high, low, -1)
        return self.known

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.label != np.arange(len(self.label)))
        return at, self.label[at]


def _group_links(codes: np.ndarray, ids: np.ndarray, foreign: np.ndarray, most: int, lead: int, few: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest links among the codes that meet in one group, as ids."""
    order = np.argsort(gray_rank(codes), kind="stable")
    a, b = GrayIndex(codes[order], foreign[order]).links(most, lead, few)
    return ids[order[a]], ids[order[b]]


# ---- on DataFrames


def parts(most: int) -> tuple[list[tuple[int, int]], int]:
    """(first bit from the left, width) of the part that leads each order, and the differences allowed in it."""
    n = most // 2 + 1
    cut = np.linspace(0, BITS, n + 1).round().astype(int)
    return [(int(a), int(b - a)) for a, b in zip(cut, cut[1:])], most // n


def _prefix(code: Column, depth: int) -> Column:
    """The code with only its first bits."""
    return code.bitwiseAND(F.lit(-(1 << (BITS - depth)) if depth else 0).cast("long"))


def _apart(x: Column, depth: Column) -> Column:
    """How many of the first ``depth`` bits are set."""
    return F.when(depth > 0, F.bit_count(F.call_function("shiftrightunsigned", x, F.lit(BITS) - depth))).otherwise(F.lit(0))


def _ranges(codes: DataFrame, cell: int, depth: int, lead: int, few: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Codes (order, code, id) under their ``node``, and the pairs of nodes (order, a, b) that may hold links.

    Nodes are prefixes of ``depth`` bits; those of more than 2 * ``cell`` codes are split by STEP further bits, again and
    again, as long as that prunes (within the leading part), and beyond that where a task couldn't hold them. Pairs of
    their children are pruned by the differences of the bits that both have. What is counted and joined here are nodes,
    whose number is that of the codes divided by about ``cell``.
    """
    codes = codes.withColumn("node", _prefix(F.col("code"), depth))
    nodes = materialize(codes.groupBy("order", "node").agg(F.count(F.lit(1)).alias("n")), "nodes")
    near = F.array(F.col("node"), *(F.col("node").bitwiseXOR(F.lit(1 << (BITS - 1 - k) if k else -(1 << (BITS - 1))).cast("long")) for k in range(depth if few else 0)))
    there = nodes.select("order", F.col("node").alias("b"))
    pairs = nodes.select("order", F.col("node").alias("a"), F.explode(near).alias("b")).where("a <= b").join(hinted(there), ["order", "b"])
    pairs = materialize(pairs.select("order", "a", "b", F.lit(depth).alias("da"), F.lit(depth).alias("db")), "node-pairs")
    while depth < BITS:
        most_codes = 2 * cell if depth + STEP <= lead else 2 * max(cell, MAX_CELL)
        large = materialize(nodes.where(F.col("n") > most_codes).select("order", "node", F.lit(True).alias("large")), "large-nodes")
        if large.isEmpty():
            break
        depth = min(depth + STEP, BITS)
        split = codes.join(hinted(large), ["order", "node"], "left").withColumn("parent", F.when(F.col("large"), F.col("node")))
        split = split.withColumn("node", F.when(F.col("large"), _prefix(F.col("code"), depth)).otherwise(F.col("node"))).drop("large")
        nodes = materialize(split.where("parent is not null").groupBy("order", "parent", "node").agg(F.count(F.lit(1)).alias("n")), "nodes")
        for side, other in (("a", "b"), ("b", "a")):
            kids = nodes.select("order", F.col("parent").alias(side), F.col("node").alias("kid"))
            pairs = pairs.withColumn("own", F.col("a") == F.col("b")) if side == "a" else pairs
            pairs = pairs.join(hinted(kids), ["order", side], "left").withColumn(f"d{side}", F.when(F.col("kid").isNotNull(), F.lit(depth)).otherwise(F.col(f"d{side}")))
            pairs = pairs.withColumn(f"new_{side}", F.coalesce("kid", side)).drop("kid")
        pairs = pairs.select("order", F.col("new_a").alias("a"), F.col("new_b").alias("b"), "da", "db", "own")
        x, common = F.col("a").bitwiseXOR(F.col("b")), F.least("da", "db")
        pairs = pairs.where((~F.col("own") | (F.col("a") <= F.col("b"))) & (_apart(x, common) <= most) & (_apart(x, F.least(common, F.lit(lead))) <= few))
        pairs = materialize(pairs.drop("own"), "node-pairs")
        codes = split.drop("parent")
    return codes, pairs.select("order", "a", "b")


def near_links(prints: DataFrame, most: int = MAX_DIFFERENCES, cell: int | None = None) -> DataFrame:
    """(id, fps), one row per id, to links (u, v) between ids of which a fingerprint differs in at most ``most`` bits.

    Fingerprints are compared with those at the same place of the arrays. The links connect exactly the ids that all
    near pairs would connect: of each group only a spanning forest is returned, so a dense group of n gives fewer
    than n links, not n squared. Each node of the ranges is a group: its own codes, and those of the neighbouring nodes
    that are paired with it; of a pair, a hash says which node takes the other's codes. A code is sent once for itself
    and for about half of the neighbours of its node, of which there are as many as its prefix has bits. ``prints`` is
    read several times and should be a written table.
    """
    spark, fp = prints.sparkSession, F.col("fp")
    starts, few = parts(most)
    lead = min(width for _, width in starts)
    size = prints.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("fps")), F.lit(0)).alias("t")).first()
    cell = cell or int(min(max(size.n * size.t * len(starts) // GROUPS, MIN_CELL), MAX_CELL))
    depth = min(max((max(size.n - 1, 0) // cell).bit_length(), 0), lead)
    turned = F.array(*(F.struct((F.col("t") * len(starts) + k).cast("int").alias("order"), (fp if not at else F.shiftleft(fp, at).bitwiseOR(F.shiftrightunsigned(fp, BITS - at))).alias("code")) for k, (at, _) in enumerate(starts)))
    codes = prints.select("id", F.posexplode("fps").alias("t", "fp")).select(F.inline(turned), "id")
    codes, pairs = _ranges(codes, cell, depth, lead, few, most)
    flip = (F.xxhash64("a", "b") % 2 == 0) & (F.col("a") != F.col("b"))
    sent = pairs.select("order", F.when(flip, F.col("a")).otherwise(F.col("b")).alias("home"), F.when(flip, F.col("b")).otherwise(F.col("a")).alias("node"))
    sent = materialize(sent, "sent")
    dealt = codes.join(hinted(sent), ["order", "node"]).select("code", "id", "order", "home", (F.col("node") != F.col("home")).alias("foreign"))
    by = ["order", "home"]
    widths = [width for _, width in starts]

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at = None

        def found():
            if sum(map(len, held)) > 1:
                rows = np.concatenate(held)
                u, v = _group_links(rows[:, 0].view(np.uint64).copy(), rows[:, 1].copy(), rows[:, 2] != 0, most, widths[at[0] % len(widths)], few)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
            held.clear()

        for batch in batches:
            if not len(batch):
                continue
            rows = np.stack([batch.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in ("code", "id", "foreign")], axis=1)
            order, home = (batch.column(c).to_numpy(zero_copy_only=False) for c in by)
            ends = [0, *(np.flatnonzero((order[1:] != order[:-1]) | (home[1:] != home[:-1])) + 1).tolist(), len(rows)]
            for a, b in zip(ends, ends[1:]):
                if at != (now := (int(order[a]), int(home[a]))):
                    yield from found()
                    at = now
                held.append(rows[a:b])
        yield from found()

    return dealt.repartition(partitions(spark), *by).sortWithinPartitions(*by).mapInArrow(search, "u long, v long")


def classes(prints: DataFrame, most: int = MAX_DIFFERENCES) -> DataFrame:
    """(id, fps, rep), one row per id, to (id, component): the least ``rep`` reachable by links."""
    links = checkpoint(near_links(prints.select("id", "fps"), most).distinct())
    roots = connected_components(links).withColumnRenamed("node", "id")
    # only fingerprints with a link need the joins
    least = prints.join(roots, "id").groupBy("root").agg(F.min("rep").alias("component"))
    linked = roots.join(least, "root").select("id", "component")
    return prints.join(linked, "id", "left").select("id", F.coalesce("component", "rep").alias("component"))


def simhash_classes(docs: DataFrame, most: int = MAX_DIFFERENCES, words: int = WORDS, tables: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (key, fps, id, component_id) per input row: its fingerprints and the least key of its near-duplicates.

    With several ``tables``, texts are near if any of their independent fingerprints are; that finds more of the
    pairs whose shingles differ somewhat. Exact copies share fingerprints and are searched once. ``id`` is the
    fingerprint, or a 64-bit hash of several. Texts without words, null texts among them, have fingerprint 0, which
    links like any other. A text of fewer words than a shingle is one shingle. A null key never is a component's name
    unless the component has no other; repeated rows each get their row.
    """
    of = docs.select(F.col(key).alias(key), fingerprints(F.col(text), words, tables).alias("fps"))
    prints = materialize(of.withColumn("id", F.get("fps", F.lit(0)) if tables == 1 else F.xxhash64("fps")), "fingerprints")
    reps = materialize(prints.groupBy("id", "fps").agg(F.min(key).alias("rep")), "distinct-fingerprints")
    found = checkpoint(classes(reps, most))
    return prints.join(found, "id").select(key, "fps", "id", F.col("component").alias("component_id"))


# ---- verification by shingles


def _similar(sets: list[np.ndarray], own: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as positions (a, b), of the pairs whose sets have a Jaccard similarity of at least ``least``.

    Where ``own`` has two values, only pairs of different ones count. Sets without members equal each other.
    """
    sizes = np.array([len(x) for x in sets])
    order = np.argsort(sizes, kind="stable")
    sizes, side, cross = sizes[order], own[order], own.min() != own.max()
    starts = np.concatenate(([0], np.cumsum(sizes)))
    names, flat = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    forest, mark = _Forest(len(sets)), np.zeros(len(names), bool)
    for a in range(len(sets)):
        end = int(np.searchsorted(sizes, sizes[a] / least + 1e-9, "right"))  # what is larger can't be similar
        b = np.arange(a + 1, end)
        b = b[forest.label[a + 1 : end] != forest.label[a]]
        if cross:
            b = b[side[b] != side[a]]
        if not len(b):
            continue
        if sizes[a]:
            mark[flat[starts[a] : starts[a + 1]]] = True
            met = mark[np.concatenate([flat[starts[k] : starts[k + 1]] for k in b])]
            shared = np.add.reduceat(met, np.concatenate(([0], np.cumsum(sizes[b])[:-1])), dtype=np.int64)
            mark[flat[starts[a] : starts[a + 1]]] = False
            b = b[shared >= least * (sizes[a] + sizes[b] - shared) - 1e-9]
        forest.add(np.full(len(b), a), b)
    a, b = forest.edges()
    return order[a], order[b]


def similar_links(sets: DataFrame, least: float, chunk: int | None = None) -> DataFrame:
    """(group, unit, n, shingles) to links (u, v) that connect exactly the units of one group that pairs of similarity
    ``least`` or more connect. ``shingles``: the bytes of n distinct 64-bit hashes. A group of more than ``chunk``
    shingles is dealt in chunks, each pair of chunks a task's group, so it is read as often as it has chunks."""
    spark, most = sets.sparkSession, CHUNK_SHINGLES if chunk is None else chunk
    parts = materialize(sets.groupBy("group").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / most)).cast("int").alias("c")), "chunks")
    dealt = sets.join(hinted(parts), "group").withColumn("own", F.pmod(F.xxhash64("unit"), F.col("c")).cast("int"))
    dealt = dealt.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    by = ["group", "i", "j"]
    dealt = dealt.select("group", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"), "own", "unit", "shingles")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def found():
            if len(held) > 1:
                units = np.array([u for u, _, _ in held], np.int64)
                u, v = _similar([np.frombuffer(x, np.uint64) for _, _, x in held], np.array([o for _, o, _ in held]), least)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(units[u]), pa.array(units[v])], names=["u", "v"])

        for batch in batches:
            for g, i, j, own, unit, x in zip(*(c.to_pylist() for c in batch.columns)):
                if (g, i, j) != at:
                    yield from found()
                    at, held = (g, i, j), []
                held.append((unit, own, x))
        yield from found()

    return dealt.repartition(partitions(spark), *by).sortWithinPartitions(*by).mapInArrow(search, "u long, v long")


def _first(key: str, unit: str) -> Column:
    """What orders rows: null keys last."""
    return F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col(unit).alias("unit"))


def verified_classes(docs: DataFrame, prints: DataFrame, least: float, most: int, words: int, key: str, text: str) -> DataFrame:
    """``prints`` (key, fps, id, unit: the text's xxhash64) to (unit, first), one row per text: the first (key, unit)
    of the texts that pairs of shingle similarity ``least`` or more connect to it.

    The fingerprints' components say what may be near; inside each the shingle sets of its texts decide.
    """
    reps = materialize(prints.groupBy("id", "fps").agg(F.count(F.lit(1)).alias("n")).select("id", "fps"), "distinct-fingerprints")
    near = connected_components(checkpoint(near_links(reps, most).distinct())).select(F.col("node").alias("id"), "root")
    units = materialize(prints.groupBy("id", "unit").agg(F.min(_first(key, "unit")).alias("first")), "texts")
    grouped = materialize(units.join(near, "id", "left").select("unit", "first", F.coalesce("root", "id").alias("group")), "candidates")
    several = grouped.groupBy("group").count().where("count > 1").select("group")
    wanted = materialize(grouped.join(hinted(materialize(several, "candidate-groups")), "group", "left_semi"), "candidate-texts")
    asked = wanted.select(F.col("group").alias("__ls_group"), F.col("unit").alias("__ls_unit"), F.col("first.key").alias("__ls_key"))
    named = docs.select(F.col(key).alias("__ls_doc"), F.col(text).alias("text"))
    there = F.col("__ls_doc").eqNullSafe(F.col("__ls_key")) & (F.xxhash64("text") == F.col("__ls_unit"))
    rows = named.join(hinted(asked), there).select(F.col("__ls_group").alias("group"), F.col("__ls_unit").alias("unit"), "text").dropDuplicates(["unit"])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                sets = [np.unique(shingles(t, words)) for t in part.column(2).to_pylist()]
                columns = [part.column(0), part.column(1), pa.array([len(x) for x in sets], pa.int32()), pa.array([x.tobytes() for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["group", "unit", "n", "shingles"])

    sets = materialize(rows.mapInArrow(cut, "group long, unit long, n int, shingles binary"), "shingles")
    roots = connected_components(checkpoint(similar_links(sets, least))).withColumnRenamed("node", "unit")
    linked = wanted.join(roots, "unit")
    first = linked.groupBy("root").agg(F.min("first").alias("best"))
    best = materialize(linked.join(first, "root").select("unit", "best"), "similar-texts")
    return units.join(hinted(best), "unit", "left").select("unit", F.coalesce("best", "first").alias("first"))


def _of_groups(docs: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """The rows that stay: ``found`` has (key, unit: the text's xxhash64, first: what ``_first`` gives of the row that stays)
    of every row. A row is told by key and text together, so rows that repeat a key aren't mistaken for one another.
    Of rows equal in both one stays; rows with a null key all stay."""
    named = found.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__ls_key"), F.col("unit").alias("__ls_unit")).agg(F.count(F.lit(1)).alias("n"), F.first("first").alias("first"))
    named = materialize(named.withColumn("stays", (F.col("__ls_key") == F.col("first.key")) & (F.col("__ls_unit") == F.col("first.unit"))), "verdicts")
    rows = docs.withColumn("__ls_of", F.xxhash64(text))
    is_ = lambda x: (rows[key] == x["__ls_key"]) & (rows["__ls_of"] == x["__ls_unit"])
    gone = materialize(named.where(~F.col("stays")).select("__ls_key", "__ls_unit"), "dropped")
    twice = materialize(named.where("stays and n > 1").select("__ls_key", "__ls_unit"), "repeated")
    kept = rows.join(hinted(gone), is_(gone), "left_anti")
    if not twice.isEmpty():
        again = rows.join(hinted(twice), is_(twice), "left_semi").dropDuplicates([key, "__ls_of"])
        kept = kept.join(hinted(twice), is_(twice), "left_anti").unionByName(again)
    return kept.drop("__ls_of")


def similar_dedup(docs: DataFrame, least: float, most: int = MAX_DIFFERENCES, words: int = WORDS, tables: int = 1, minwise: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one of each group left that pairs of shingle similarity ``least`` or more connect.

    The fingerprints, ``tables`` SimHashes and ``minwise`` min-wise ones, only find candidates; a link counts if the
    whole texts' shingle sets are similar. Of a group the row of the least key stays, of rows that repeat a key and a
    text one; rows with a null key stay. Texts without words, null ones too, are alike; an empty table stays empty;
    further columns are kept, and no column name clashes.
    """
    of = docs.select(F.col(key).alias(key), fingerprints(F.col(text), words, tables, minwise).alias("fps"), F.xxhash64(text).alias("unit"))
    prints = materialize(of.withColumn("id", F.xxhash64("fps")), "fingerprints")
    named = materialize(verified_classes(docs, prints, least, most, words, key, text), "similar-classes")
    return _of_groups(docs, prints.select(key, "unit").join(named, "unit"), key, text)


def near_dedup(docs: DataFrame, most: int = MAX_DIFFERENCES, words: int = WORDS, tables: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one of each group of near fingerprints left, the row of the least key (then text hash).

    Rows with a null key stay; rows that repeat a key are told apart by their texts; of rows that repeat both one stays;
    texts without words, null ones too, are alike; an empty table stays empty; no column name clashes.
    """
    of = docs.select(F.col(key).alias(key), fingerprints(F.col(text), words, tables).alias("fps"), F.xxhash64(text).alias("unit"))
    prints = materialize(of.withColumn("id", F.xxhash64("fps")), "fingerprints")
    reps = materialize(prints.groupBy("id", "fps").agg(F.min(_first(key, "unit")).alias("rep")), "distinct-fingerprints")
    named = materialize(classes(reps, most), "near-classes")
    return _of_groups(docs, prints.select(key, "unit", "id").join(named, "id").select(key, "unit", F.col("component").alias("first")), key, text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("id")), 16, "0").alias("fingerprint"), "component_id")
