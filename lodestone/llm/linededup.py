"""Line dedup: exact copies and lines within a small edit distance, by a segment-partition join.

A line of length L is cut into one segment more than the allowed edits. Of two lines within that distance the
longer one holds some segment of the shorter unchanged, at a place that the lengths and the edits left and right of
it confine to a few positions. So the shorter line's segments are indexed under (its length, the segment's number, the
segment), and each line probes, for its own length and the few below it, the substrings at those positions.
Segments that many lines share aren't joined: cut into two segments more than the edits, lines within that distance share
two of them, so the lines under such a segment are joined by pairs of shorter ones instead.
Pairs that meet are verified by a banded bit-parallel edit distance. Everything here is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, added, hinted, let, materialize, table
from .components import connected_components

EDITS = 2
#: Shorter lines aren't compared by edits: too little to tell copies from coincidence. Of exact copies too they are left
#: alone, unless ``exact_chars`` asks for them.
MIN_CHARS = 20
#: Lines with more copies than both this and one in HOT_SHARE of all lines are probed once only.
HOT_COPIES, HOT_SHARE = 64, 1_000_000
LETTERS = "abcdefghiklmnoprstuwy"
#: Segments that more different lines than this share are joined in pairs.
CROWD = 8


def _ints(*values: int) -> Column:
    return F.array(*map(F.lit, values))


# ---- keys


def _segments(length: Column, n: int) -> list[tuple[Column, Column]]:
    """(start from 1, length) of each of ``n`` segments; the later ones take the remainder."""
    out, start = [], F.lit(1)
    for k in range(n):
        size = F.floor((length + k) / n).cast("int")
        out.append((start, size))
        start = start + size
    return out


def _key(length: Column, k: int, piece: Column) -> Column:
    return F.xxhash64(piece, length, F.lit(k))


def probe_keys(line: Column, length: Column, edits: int = EDITS) -> tuple[list[Column], list[int]]:
    """Keys of the substrings that can equal a segment of a line shorter by 0 to ``edits``; the places in this list
    of the line's own segments, which are the keys it is indexed under."""
    out, own = [], []
    for less in range(edits + 1):
        short = length - less
        for k, (start, size) in enumerate(_segments(short, edits + 1)):
            low, high = max(-k, less - (edits - k)), min(k, less + (edits - k))  # edits left and right of the segment
            for at in range(low, high + 1):
                if less == at == 0:
                    own.append(len(out))
                out.append(_key(short, k, F.substring(line, start + at, size)))
    return out, own


def pair_keys(line: Column, length: Column, edits: int = EDITS) -> tuple[list[Column], list[int]]:
    """As ``probe_keys``, for two segments of edits + 2 at once: with at most ``edits`` edits two stay unchanged.

    The edits before the first, between the two and behind the second shift them; as many shifts are probed as fit
    into ``edits`` together.
    """
    out, own = [], []
    for less in range(edits + 1):
        short = length - less
        segments = _segments(short, edits + 2)
        for i, (start, size) in enumerate(segments):
            for j, (start2, size2) in enumerate(segments[i + 1 :], i + 1):
                for at in range(-edits, edits + 1):
                    for at2 in range(-edits, edits + 1):
                        # nothing stands before the first segment of all, so it can't be shifted; nor, at the end, the last
                        fits = abs(at) + abs(at2 - at) + abs(less - at2) <= edits and (i or not at) and (j < edits + 1 or at2 == less) and (j > i + 1 or at == at2)
                        if fits:
                            if less == at == at2 == 0:
                                own.append(len(out))
                            pieces = F.concat_ws("\x00", F.substring(line, start + at, size), F.substring(line, start2 + at2, size2))
                            out.append(_key(short, 100 + i * (edits + 2) + j, pieces))
    return out, own


def signature(line: Column) -> Column:
    """Counts of some common letters modulo 8 in a cyclic Gray code, 3 bits each.

    An edit changes at most two counts by one, and a count that changes by one flips one bit: the signatures of
    lines within ``edits`` differ in at most 2 * edits bits.
    """
    out = F.lit(0).cast("long")
    for k, letter in enumerate(LETTERS):
        n = (F.length(line) - F.length(F.replace(line, F.lit(letter), F.lit("")))).bitwiseAND(F.lit(7)).cast("long")
        out = out.bitwiseOR(F.shiftleft(n.bitwiseXOR(F.shiftright(n, 1)), 3 * k))
    return out


# ---- verification


def _common(a: Column, b: Column, limit: Column, part) -> Column:
    """The longest length up to ``limit`` at which ``part`` of both is equal, by halving."""
    steps = F.array(*(F.lit(1 << k) for k in range(24, -1, -1)))

    def longer(found: Column, step: Column) -> Column:
        n = found + step
        return F.when((n <= limit) & (part(a, n) == part(b, n)), n).otherwise(found)

    return F.aggregate(steps, F.lit(0), longer)


def within(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether the edit distance of two strings is at most ``edits``.

    What both begin and end with is cut off first. The rest runs through the bit-parallel recurrence for a
    diagonal band of edits + 1 rows on either side, one column per character of the longer string; the vertical
    differences of the band are two bit vectors. A distance beyond ``edits`` stops the work of later columns.
    """
    head = lambda s, n: F.left(s, n)
    tail = lambda s, n: F.right(s, n)

    def trimmed(x: Column) -> Column:
        p, q = x["p"], x["q"]
        n = _common(p, q, F.length(p), head)

        def cut(front: Column) -> Column:
            p2, q2 = F.substring(p, front + 1, F.length(p) - front), F.substring(q, front + 1, F.length(q) - front)

            def both(y: Column) -> Column:
                end = _common(y["p"], y["q"], F.length(y["p"]), tail)
                return let(end, lambda e: F.struct(F.left(y["p"], F.length(y["p"]) - e).alias("p"), F.left(y["q"], F.length(y["q"]) - e).alias("q")))

            return let(F.struct(p2.alias("p"), q2.alias("q")), both)

        return let(n, cut)

    shorter = F.length(a) <= F.length(b)
    ordered = F.struct(F.when(shorter, a).otherwise(b).alias("p"), F.when(shorter, b).otherwise(a).alias("q"))

    def near(x: Column) -> Column:
        far = F.length(x["q"]) - F.length(x["p"]) > edits
        return F.when(far, F.lit(False)).when(F.length(x["p"]) == 0, F.lit(True)).otherwise(_banded(x["p"], x["q"], edits))

    return let(ordered, lambda x: let(trimmed(x), near))


def _banded(p: Column, q: Column, edits: int) -> Column:
    """Banded bit-parallel distance of p to q (p not longer) compared with ``edits``.

    In column j, bit i of the band stands for row j - edits + i (from 1). Rows above the first count as equal to
    row 0. The score follows the band's lowest row while that is inside the table, then climbs to the last row.
    """
    width = 2 * edits + 1
    full, low = (1 << width) - 1, 1 << (width - 1)

    def run(c: Column) -> Column:
        pc, qc = c["p"], c["q"]
        m = F.size(pc)

        def column(s: Column, j: Column) -> Column:
            letter = F.get(qc, j - 1)
            match = sum((F.when(F.get(pc, j - 1 - edits + i) == letter, F.lit(1 << i)).otherwise(F.lit(0)) for i in range(width)), F.lit(0))

            def step(x: Column) -> Column:
                vp, vn = s["vp"], s["vn"]
                d0 = ((x.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(F.lit(full))

                def after(d: Column) -> Column:
                    hp = vn.bitwiseOR(F.bitwise_not(d.bitwiseOR(vp)).bitwiseAND(F.lit(full)))
                    hn = d.bitwiseAND(vp)
                    over = j + edits - m  # rows by which the band has passed the last row
                    row = F.call_function("shiftright", F.lit(low), F.greatest(over, F.lit(0)))
                    bit = lambda v: F.when(v.bitwiseAND(row) != 0, F.lit(1)).otherwise(F.lit(0))
                    score = s["score"] + F.when(over <= 0, 1 - bit(d)).otherwise(bit(hp) - bit(hn))
                    down = F.shiftright(d, 1)
                    nvp = hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)).bitwiseAND(F.lit(full)))
                    return F.struct(nvp.alias("vp"), down.bitwiseAND(hp).alias("vn"), score.alias("score"))

                return let(d0, after)

            # along the last row the score falls by 1 a column at most, in no more than 2 * edits columns
            lost = s["score"] > 3 * edits
            return F.when(lost, s).otherwise(let(match, step))

        start = F.struct(F.lit(full ^ ((1 << edits) - 1)).alias("vp"), F.lit(0).alias("vn"), F.least(F.lit(edits), m).alias("score"))
        # the first column's band is rows 1 - edits .. 1 + edits, the state before it one row higher
        return F.aggregate(F.sequence(F.lit(1), F.size(qc)), start, column)["score"] <= edits

    return let(F.struct(F.split(p, "").alias("p"), F.split(q, "").alias("q")), run)


# ---- on DataFrames


def _lines(docs: DataFrame, min_chars: int, key: str, text: str) -> DataFrame:
    """(key, d, n, line, size, k1, k2): the lines that are long enough and hold a word."""
    cut = docs.select(key, F.xxhash64(text).alias("d"), F.posexplode(F.split(text, "\n")).alias("n", "line"))
    cut = cut.withColumn("size", F.length("line")).where((F.col("size") >= min_chars) & F.col("line").rlike(f"[^{WHITE}]"))
    return cut.select("*", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(7), "line").alias("k2"))


def _texts(docs: DataFrame, groups: DataFrame, wanted: DataFrame, min_chars: int, key: str, text: str) -> DataFrame:
    """The lines of the wanted k1, once each. Only the documents where they first stand are taken apart."""
    places = materialize(groups.join(hinted(wanted), "k1", "left_semi").select(F.col(f"first.{key}").alias("__ls_key"), F.col("first.d").alias("__ls_hash")).distinct(), "places")
    there = docs[key].eqNullSafe(F.col("__ls_key")) & (F.xxhash64(docs[text]) == F.col("__ls_hash"))
    lines = _lines(docs.join(hinted(places), there, "left_semi"), min_chars, key, text)
    return lines.join(hinted(wanted), "k1", "left_semi").groupBy("k1", "k2").agg(F.min("line").alias("line"))


def _candidates(narrow: DataFrame, own: list[int], hot: DataFrame, texts_of, edits: int, key: str) -> DataFrame:
    """Distinct pairs (a, b) of line hashes whose lines share a segment at a fitting place.

    A segment that more than CROWD lines share is not joined, so no key makes more rows than CROWD for a probe. The lines
    that meet under such a segment share two shorter ones if they are near, and are joined by those. Lines that share two
    and still differ by more (a form with other numbers in it) are told apart inside that join by their letter counts,
    without making rows.
    """
    probing = narrow.join(hinted(hot), "k1", "left")
    probing = probing.where(F.col("first").isNull() | F.col("first").eqNullSafe(F.struct(key, "d", "n"))).where("keys is not null")
    indexed = F.explode(F.array(*(F.get("keys", F.lit(k)) for k in own))).alias("key")
    index = probing.select(indexed, "k1").repartition("key").distinct()
    crowded = materialize(index.groupBy("key").count().where(F.col("count") > CROWD).select("key"), "crowded-keys")
    probe = probing.select(F.explode("keys").alias("key"), F.col("k1").alias("b"))
    sparse = index.join(hinted(crowded), "key", "left_anti").withColumnRenamed("k1", "a")
    met = sparse.hint("shuffle_hash").join(probe, "key").where("a <> b").select("a", "b")
    crowd = materialize(probe.join(hinted(crowded), "key", "left_semi").select(F.col("b").alias("k1")).distinct(), "crowd")
    line = F.col("line")
    keys, mine = pair_keys(line, F.length("line"), edits)
    pairs = materialize(texts_of(crowd).select("k1", signature(line).alias("sig"), F.array(*keys).alias("keys")), "crowd-keys")
    pair_index = pairs.select(F.explode(F.array(*(F.get("keys", F.lit(k)) for k in mine))).alias("key"), F.col("k1").alias("a"), F.col("sig").alias("asig"))
    pair_probe = pairs.select(F.explode("keys").alias("key"), F.col("k1").alias("b"), "sig")
    alike = F.bit_count(F.col("asig").bitwiseXOR(F.col("sig"))) <= 2 * edits
    met = met.union(pair_index.join(pair_probe, "key").where((F.col("a") != F.col("b")) & alike).select("a", "b"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def removed_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, key: str = "doc_id", text: str = "text", exact_chars: int | None = None) -> DataFrame:
    """(key, d, removed): for each document that loses lines, their numbers from 0; d is its text's xxhash64.

    1. The lines' two 64-bit hashes, place and keys are written once, without the texts.
    2. Exact copies: the first place by hash pair; a partial minimum, so a common line is no hot task.
    3. Near lines: index and probe keys meet by one shuffle. A line of very many copies takes part from its first
       place only; there can be at most HOT_SHARE such lines, which are broadcast behind a count.
    4. The texts of lines in candidate pairs are read again and verified; links become components.
    5. Each line learns the first place of its component; all others of it are removed.
    """
    lines = _lines(docs, min_chars if exact_chars is None else min(exact_chars, min_chars), key, text)
    keys, own = probe_keys(F.col("line"), F.col("size"), edits)
    held = F.array(*keys) if exact_chars is None else F.when(F.col("size") >= min_chars, F.array(*keys))
    narrow = materialize(lines.select(key, "d", "n", "k1", "k2", held.alias("keys")), "lines")
    place = F.struct(key, "d", "n")
    groups = materialize(narrow.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")), "line-groups")
    total = narrow.count()
    hot = groups.where(F.col("copies") > max(HOT_COPIES, total // HOT_SHARE)).groupBy("k1").agg(F.min("first").alias("first"))
    texts_of = lambda wanted: _texts(docs, groups, wanted, min_chars, key, text)
    pairs = materialize(_candidates(narrow, own, materialize(hot, "hot-lines"), texts_of, edits, key), "line-pairs")
    wanted = materialize(pairs.select(F.col("a").alias("k1")).union(pairs.select(F.col("b").alias("k1"))).distinct(), "pair-lines")
    texts = materialize(texts_of(wanted), "pair-texts")
    name = F.concat_ws(".", "k1", "k2")
    left = texts.select(F.col("k1").alias("a"), name.alias("u"), F.col("line").alias("p"))
    right = texts.select(F.col("k1").alias("b"), name.alias("v"), F.col("line").alias("q"))
    links = pairs.join(left, "a").join(right, "b").where(within(F.col("p"), F.col("q"), edits)).select("u", "v")
    roots = connected_components(links)
    members = groups.withColumn("node", name).join(roots, "node")
    least = members.groupBy("root").agg(F.min("first").alias("keep"))
    near = members.join(least, "root").select("k1", "k2", "keep")
    keep = groups.join(near, ["k1", "k2"], "left").withColumn("keep", F.coalesce("keep", "first"))
    doubled = keep.where((F.col("copies") > 1) | ~F.col("keep").eqNullSafe(F.col("first"))).select("k1", "k2", "keep")
    doubled = materialize(doubled, "doubled-lines")  # a plain scan, so that adaptive execution can split a common line
    gone = narrow.select(key, "d", "n", "k1", "k2").join(doubled, ["k1", "k2"]).where(~F.col("keep").eqNullSafe(place))
    return gone.groupBy(key, "d").agg(F.sort_array(F.collect_set("n")).alias("removed"))


def line_dedup(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, key: str = "doc_id", text: str = "text", exact_chars: int | None = None) -> DataFrame:
    """Documents without the lines that repeat an earlier line, exactly or within ``edits`` edits.

    Lines are what newlines separate. Of each component of links, over all documents, the line at the least
    (key, text hash, number) stays. Lines of fewer than ``min_chars`` characters stay, or, if ``exact_chars`` is given,
    are removed as exact copies from so many characters on; lines without a word stay. Lines and texts may be of any
    length. Adds n_lines, n_removed (long), n_long_left (long: lines of min_chars or more that stay) and removed (array of line numbers).

    A null text stays null with no lines; a null key orders before all others; rows equal in key and text are one
    place and lose the same lines; a document may be left empty; input columns named like an output give way.
    """
    gone = removed_lines(docs, edits, min_chars, key, text, exact_chars).select(F.col(key).alias("__ls_key"), F.col("d").alias("__ls_hash"), F.col("removed").alias("__ls_removed"))
    joined = docs.join(gone, docs[key].eqNullSafe(F.col("__ls_key")) & (F.xxhash64(text) == F.col("__ls_hash")), "left")

    def parts(x: Column) -> Column:
        at = F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("__ls_removed"))
        left = F.when(F.col("__ls_removed").isNull(), x).otherwise(F.transform(at, lambda i: F.get(x, i)))
        long_ = lambda y: F.size(F.filter(y, lambda s: (F.length(s) >= min_chars) & s.rlike(f"[^{WHITE}]")))
        return let(left, lambda y: F.struct(F.array_join(y, "\n").alias("text"), F.size(x).alias("n"), long_(y).alias("long")))

    out = joined.withColumn("__ls_p", let(F.split(text, "\n"), parts))
    removed = F.coalesce("__ls_removed", _ints().cast("array<int>"))
    new = added(
        out,
        n_lines=F.coalesce("__ls_p.n", F.lit(0)).cast("long"),
        n_removed=F.size(removed).cast("long"),
        n_long_left=F.coalesce("__ls_p.long", F.lit(0)).cast("long"),
        removed=removed,
    )
    whole = F.when(F.size("removed") > 0, F.col("__ls_p.text")).otherwise(F.col(text))
    return new.withColumn(text, whole).drop("__ls_p", "__ls_key", "__ls_hash", "__ls_removed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_lines", "n_removed", "removed")
