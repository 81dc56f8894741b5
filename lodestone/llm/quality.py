"""Quality rules: per-document counts, then verdicts on whole hosts from shrunk failure rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, added, hinted, let, materialize, table

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_SYMBOLS_PER_WORD = 0.5
MAX_DUP_LINE_SHARE = 0.5
#: A host whose shrunk failure rate for any rule exceeds this is rejected as a whole.
HOST_RATE = 0.5
#: Bounds of the prior's weight in documents; the lower one also holds where hosts don't differ measurably.
PRIOR_DOCS = (2.0, 1000.0)
RULES = ("few_words", "repeats", "symbols", "dup_lines")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{WHITE}]+"), "")


def _covered(hashes: Column) -> Column:
    """Positions that lie in a window whose hash occurs twice or more; sorts, so long texts stay n log n."""

    def of(s: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            same = lambda at: F.coalesce(F.get(s, at)["h"] == x["h"], F.lit(False))
            return F.when(same(k - 1) | same(k + 1), x["i"])

        at = F.sort_array(F.filter(F.transform(s, twin), lambda i: i.isNotNull()))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last"))
        return F.aggregate(at, start, step)["n"]

    return let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of)


def repeated_words(words: Column) -> Column:
    """Number of words inside 5-word windows that occur twice or more (64-bit hashes stand for windows)."""

    def windows(w: Column) -> Column:
        hashed = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))
        return let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(windows(words))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) and base_failed."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(f"[^{WHITE}]"))

    def by_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words"))

    def by_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    parts = docs.withColumns({"__ls_w": let(words_of(F.col(text)), by_words), "__ls_l": let(lines, by_lines)})
    n, rep = F.col("__ls_w.n_words"), F.col("__ls_w.n_repeat_words")
    return added(
        parts,
        n_words=n,
        word_chars=F.col("__ls_w.word_chars"),
        n_symbols=F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long"),
        n_lines=F.col("__ls_l.n_lines"),
        n_dup_lines=F.col("__ls_l.n_dup_lines"),
        n_repeat_words=rep,
        base_failed=(n < MIN_WORDS) | (rep * 100 > n * MAX_REPEAT_PERCENT),
    ).drop("__ls_w", "__ls_l")


def rule_flags() -> dict[str, Column]:
    n = F.col("n_words")
    return {
        "few_words": n < MIN_WORDS,
        "repeats": F.col("n_repeat_words") * 100 > n * MAX_REPEAT_PERCENT,
        "symbols": F.col("n_symbols") > n * MAX_SYMBOLS_PER_WORD,
        "dup_lines": F.col("n_dup_lines") > F.col("n_lines") * MAX_DUP_LINE_SHARE,
    }


def host_rates(measured_docs: DataFrame, host: Column) -> DataFrame:
    """(__ls_host, n, one shrunk rate per rule, host_rejected): one row per host, a null host among them.

    Each rule's beta prior has its mean at the corpus rate; its weight follows from the spread of the hosts'
    rates beyond what their sizes explain (method of moments), within PRIOR_DOCS.
    """
    flags = rule_flags()
    hosts = materialize(
        measured_docs.groupBy(host.alias("__ls_host")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(v.cast("long")).alias(f"__ls_{k}") for k, v in flags.items())),
        "hosts",
    )
    n = F.col("n")
    total = hosts.agg(F.sum(n).alias("n"), F.sum(1 / n).alias("inv"), F.count(F.lit(1)).alias("hosts"), *(F.sum(f"__ls_{k}").alias(k) for k in RULES)).first()
    mean = {k: (total[k] or 0) / total["n"] if total["n"] else 0.0 for k in RULES}
    spread = hosts.agg(*(F.avg((F.col(f"__ls_{k}") / n - F.lit(mean[k])) ** 2).alias(k) for k in RULES)).first()
    rates = {}
    for k in RULES:
        p = mean[k]
        between = (spread[k] or 0.0) - p * (1 - p) * ((total["inv"] or 0.0) / max(total["hosts"], 1))
        weight = PRIOR_DOCS[1] if between <= 0 else p * (1 - p) / between - 1
        weight = min(max(weight, PRIOR_DOCS[0]), PRIOR_DOCS[1])
        rates[f"rate_{k}"] = (F.col(f"__ls_{k}") + F.lit(p * weight)) / (n + F.lit(weight))
    out = hosts.select("__ls_host", "n", *(v.alias(k) for k, v in rates.items()))
    return out.withColumn("host_rejected", F.greatest(*rates) > HOST_RATE)


def judged(measured_docs: DataFrame, host: Column | None = None) -> DataFrame:
    """Adds ``kept`` to the rows of ``measured``, which are written once and read for both steps."""
    rows = materialize(measured_docs.withColumn("__ls_of", F.col("source") if host is None else host), "measured")
    verdicts = host_rates(rows, F.col("__ls_of")).select("__ls_host", F.col("host_rejected").alias("__ls_bad")).where("__ls_bad")
    joined = rows.join(hinted(verdicts), F.col("__ls_of").eqNullSafe(F.col("__ls_host")), "left")
    return added(joined, kept=~(F.col("base_failed") | F.coalesce("__ls_bad", F.lit(False)))).drop("__ls_of", "__ls_host", "__ls_bad")


def quality_rules(docs: DataFrame, host: Column | None = None, text: str = "text") -> DataFrame:
    """Documents with their counts, ``base_failed`` and ``kept``.

    ``kept`` is false if the document fails the base rules, or if its host is rejected: rule failures are
    summed by host (``source`` unless given), the rates shrunk toward the corpus by an empirical beta prior,
    and the hosts' verdicts joined back. Only partial sums are shuffled by host, so a hot host is no hot task;
    the verdicts are broadcast behind a count.

    A null text has no words and fails; a null host is a host of its own; an empty table gives an empty
    result; repeated rows are judged each for itself; input columns named like an output column give way.
    """
    return judged(measured(docs, text), host)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = judged(measured(docs).drop("text"))  # the text isn't needed behind the counts
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = """
with base as (
  select doc_id, source, coalesce(text, '') as t,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l
  from documents),
numbered as (select row_number() over () as r, * from base),
windows as (
  select r, i, w[i:i + 4] as g from (select r, w, unnest(range(1, len(w) - 3)) as i from numbered where len(w) > 5)),
twice as (select r, i from windows qualify count(*) over (partition by r, g) > 1),
covered as (select r, count(distinct i + k) as n from (select r, i, unnest(range(0, 5)) as k from twice) group by r),
counts as (
  select doc_id, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, len(l)::bigint as n_lines,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words
  from numbered left join covered c using (r)),
flags as (
  select *, n_words < 10 as few_words, n_repeat_words * 100 > n_words * 20 as repeats,
    n_symbols > n_words * 0.5 as symbols, n_dup_lines > n_lines * 0.5 as dup_lines from counts),
hosts as (
  select source as host, count(*) as n, unnest([
    {'rule': 1, 'f': count(*) filter (few_words)}, {'rule': 2, 'f': count(*) filter (repeats)},
    {'rule': 3, 'f': count(*) filter (symbols)}, {'rule': 4, 'f': count(*) filter (dup_lines)}]) as x
  from flags group by source),
means as (select x.rule as rule, sum(x.f) / sum(n) as p, sum(1.0 / n) / count(*) as inv from hosts group by 1),
spreads as (
  select rule, any_value(p) as p, avg((h.x.f / n - p) ** 2) - any_value(p * (1 - p) * inv) as between
  from hosts h join means m on h.x.rule = m.rule group by rule),
priors as (
  select rule, p, case when between <= 0 then 1000.0 else least(greatest(p * (1 - p) / between - 1, 2.0), 1000.0) end as k
  from spreads),
bad as (select distinct host from hosts h join priors q on h.x.rule = q.rule where (h.x.f + p * k) / (n + k) > 0.5)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few_words or repeats as base_failed,
  not (few_words or repeats or exists (select 1 from bad where host is not distinct from source)) as kept
from flags
"""
