"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import added, let, materialize, partitions, table

#: Production weights: the hot source is held to a fifth; the others share the rest as they are.
WEIGHTS = {"src0": 0.2}
SEED = 17
#: Rate tables of more sources or more table entries than these are joined with a salt instead of being broadcast.
MAX_BROADCAST_SOURCES, MAX_BROADCAST_ENTRIES = 2_000, 500_000
SALTS = 64
#: Beyond this rate the distribution function is inverted by an expansion instead of a table.
TABLE_RATE = 4096.0
#: Copies of a document that are made from one row at once.
BLOCK = 1024
_BITS = 52


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the joined key."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *key)), 1, _BITS // 4), 16, 10).cast("double") / F.lit(float(2**_BITS))


def rates(counts: DataFrame, weights: Mapping[str | None, float], rows: int | None = None) -> DataFrame:
    """(source, n) to (source, n, rate): the mean number of times that each document of a source is taken.

    ``weights`` are shares of the output for the sources it names; what is left of 1 goes to all others in
    proportion to their sizes. Shares are rescaled if nothing is left over or no other source exists.
    ``rows``: the expected size of the output, as large as the input unless given.
    """
    named = {k: v for k, v in weights.items() if v > 0 or k in weights}
    if any(v < 0 for v in named.values()):
        raise ValueError("weights can't be negative")
    source = F.col("source")
    weight = F.lit(None).cast("double")
    for k, v in named.items():
        weight = F.when(source.eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(weight)
    counts = counts.withColumn("w", weight)
    t = counts.agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum(F.when(F.col("w").isNull(), F.col("n"))).alias("others")).first()
    total, held, others = t["n"] or 0, t["w"] or 0.0, t["others"] or 0
    rest = max(1.0 - held, 0.0) if others else 0.0
    scale = (rows if rows is not None else total) / ((held + rest) or 1.0)
    share = F.coalesce(F.col("w"), F.col("n") * F.lit(rest / others if others else 0.0))
    return counts.select("source", "n", (share * F.lit(float(scale)) / F.col("n")).alias("rate"))


def cumulative(with_rates: DataFrame) -> DataFrame:
    """Adds ``cdf``: the Poisson distribution function at 0, 1, ..., far enough that the rest is below 2**-52.

    Built from logarithms, so that large rates don't underflow. Rates beyond TABLE_RATE get no table (null), so a table
    has some 5,000 entries at most.
    """
    rate = F.col("rate")
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    by = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    k = with_rates.where((rate > 0) & (rate <= TABLE_RATE)).select("source", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    k = k.withColumn("logs", F.sum(F.log(F.greatest("k", F.lit(1)))).over(by))
    k = k.withColumn("p", F.sum(F.exp(-rate + F.col("k") * F.log(rate) - F.col("logs"))).over(by))
    lists = k.groupBy(F.col("source").alias("s")).agg(F.sort_array(F.collect_list("p")).alias("cdf"))
    joined = with_rates.join(lists, with_rates["source"].eqNullSafe(lists["s"]), "left").drop("s")
    return joined.withColumn("cdf", F.coalesce("cdf", F.when(rate <= TABLE_RATE, F.array(F.lit(1.0)))))


#: Acklam's rational approximation of the normal quantile (relative error 1.15e-9).
_CENTRE = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_CENTRE_BELOW = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_TAIL = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_TAIL_BELOW = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
_TAIL_AT = 0.02425


def _polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(u: Column) -> Column:
    """The standard normal distribution's quantile of a number in [0, 1)."""

    def tail(p: Column) -> Column:
        return let(F.sqrt(F.lit(-2.0) * F.log(p)), lambda q: _polynomial(_TAIL, q) / _polynomial(_TAIL_BELOW, q))

    def of(p: Column) -> Column:
        centre = let(p - 0.5, lambda q: let(q * q, lambda r: q * _polynomial(_CENTRE, r) / _polynomial(_CENTRE_BELOW, r)))
        return F.when(p < _TAIL_AT, tail(p)).when(p > 1 - _TAIL_AT, -tail(1 - p)).otherwise(centre)

    return let(F.greatest(u, F.lit(2.0 ** -(_BITS + 1))), of)


def large_draw(u: Column, rate: Column) -> Column:
    """The Poisson quantile of u for a large rate, by the Cornish-Fisher expansion; right to within one."""
    root = F.sqrt(rate)
    return let(normal_quantile(u), lambda z: F.greatest(F.lit(0.0), F.floor(rate + root * z + (z * z + 2) / 6 + (z - z * z * z) / (72 * root))).cast("long"))


def mix_sources(docs: DataFrame, weights: Mapping[str | None, float] = WEIGHTS, seed: int = SEED, rows: int | None = None, key: str = "doc_id") -> DataFrame:
    """Each document as often as a Poisson draw with its source's rate says, in a globally shuffled order.

    The draw inverts the distribution function at a uniform number hashed from seed and ``key``, so a rerun or
    a lost executor changes nothing. Adds ``copy`` (from 1) and ``shuffle_key``; rows are dealt over all
    partitions by that random key and sorted by it within each.

    Rates come from one partial count by source. They are broadcast when they are few; otherwise the join is
    salted, so a source with a third of all rows is spread over 64 keys. A small source with a large weight may be taken
    any number of times: up to a rate of TABLE_RATE the distribution function is a table, beyond it an expansion, and
    copies are made in blocks, which are dealt anew first where rates are that large. A document that would be taken
    2**31 times or more is an error. A null source is a source of its own; null keys all get the same draw; repeated
    rows get equal draws and all their copies; texts, however long, aren't looked at; an empty table gives an empty
    result; input columns named copy or shuffle_key give way.
    """
    counts = materialize(docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "sources")
    table_ = materialize(cumulative(rates(counts, weights, rows)).select(F.col("source").alias("__ls_source"), F.col("rate").alias("__ls_rate"), F.col("cdf").alias("__ls_cdf")), "rates")
    ident = F.coalesce(F.col(key).cast("string"), F.lit(""))
    docs = docs.withColumn("__ls_u", uniform(F.lit(str(seed)), ident))
    extent = table_.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.size("__ls_cdf"), F.lit(0))).alias("entries"), F.max("__ls_rate").alias("most")).first()
    if extent.n <= MAX_BROADCAST_SOURCES and (extent.entries or 0) <= MAX_BROADCAST_ENTRIES:
        joined = docs.join(F.broadcast(table_), F.col("source").eqNullSafe(F.col("__ls_source")))
    else:
        salted = table_.withColumn("__ls_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        docs = docs.withColumn("__ls_at", F.pmod(F.xxhash64(ident), F.lit(SALTS)).cast("int"))
        joined = docs.join(salted, F.col("source").eqNullSafe(F.col("__ls_source")) & (F.col("__ls_at") == F.col("__ls_salt"))).drop("__ls_at", "__ls_salt")
    few = F.size(F.filter("__ls_cdf", lambda c: c <= F.col("__ls_u"))).cast("long")
    drawn = joined.withColumn("__ls_n", F.when(F.col("__ls_cdf").isNull(), large_draw(F.col("__ls_u"), F.col("__ls_rate"))).otherwise(few))
    drawn = drawn.drop("__ls_cdf", "__ls_u", "__ls_source", "__ls_rate").where("__ls_n > 0")
    if (extent.most or 0) > TABLE_RATE:
        too_many = F.raise_error(F.lit("a document would be taken 2**31 times or more")).cast("long")
        drawn = drawn.withColumn("__ls_n", F.when(F.col("__ls_n") < 1 << 31, F.col("__ls_n")).otherwise(too_many))
        blocks = drawn.withColumn("__ls_block", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("__ls_n") - 1, F.lit(BLOCK).cast("long")))))
        blocks = blocks.repartition(partitions(docs.sparkSession), F.xxhash64(ident, "__ls_block"))
        first = F.col("__ls_block") * BLOCK
        copies = blocks.withColumn("__ls_copy", F.explode(F.sequence(first + 1, F.least(first + BLOCK, F.col("__ls_n"))))).drop("__ls_block")
    else:
        copies = drawn.withColumn("__ls_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__ls_n"))))
    copies = copies.withColumn("__ls_copy", F.col("__ls_copy").cast("int"))
    out = added(copies, copy=F.col("__ls_copy"), shuffle_key=F.md5(F.concat_ws("|", F.lit(f"{seed}s"), ident, F.col("__ls_copy").cast("string")))).drop("__ls_n", "__ls_copy")
    return out.repartition(partitions(docs.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


SQL = """
with counts as (select source, count(*) as n, case when source = 'src0' then 0.2 end as w from documents group by source),
totals as (select sum(n) as n, coalesce(sum(w), 0) as held, sum(n) filter (w is null) as others from counts),
rates as (
  select c.source, coalesce(w, c.n * greatest(1 - held, 0) / others) * t.n
    / (held + case when others > 0 then greatest(1 - held, 0) else 0 end) / c.n as rate
  from counts c, totals t),
steps as (select source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::bigint + 1)) as k from rates),
cdf as (
  select source, list(p order by k) as cdf from (
    select source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) over (partition by source order by k) as p from steps)
  group by source),
drawn as (
  select d.*, len(list_filter(c.cdf, lambda x: x <= ('0x' || substr(md5('17|' || doc_id), 1, 13))::bigint / 4503599627370496.0)) as n
  from documents d join cdf c on d.source is not distinct from c.source)
select doc_id, text, lang, source, n_chars, copy::integer as copy, md5('17s|' || doc_id || '|' || copy) as shuffle_key
from (select *, unnest(range(1, n + 1)) as copy from drawn)
"""
