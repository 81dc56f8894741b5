"""Toxicity by a factorization machine over hashed terms.

A document's features are the hash buckets of its distinct words and of longer words' first letters. The machine adds, to a weight per bucket, the
inner products of the factors of every two buckets that occur together, so an insult beside a group's name can count
for more than either. It is trained on the driver, on a bounded sample of the labels, and sent to the executors as a
few arrays whose size is set by parameters.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hinted, materialize, python_batches, table

BUCKETS = 1 << 18
#: Labelled documents in training, about and in expectation at most.
SAMPLE = 20_000
#: Buckets that take part: those whose presence tells most about the label, by a chi-square test.
TERMS, LEAST_CHI2, LEAST_DOCS = 4096, 15.0, 3
PREFIX = 5
FACTORS, STEPS, RATE, PENALTY = 4, 300, 0.05, 1e-4
SEED = 11
FOLDS = 5


def held_out(key: str = "doc_id"):
    """The fold that training never sees: crc32 of the key as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def terms(text: str | None, known: dict[str, tuple[int, int]]) -> np.ndarray:
    """The sorted distinct buckets of a text's words and prefixes, as int32. ``known`` remembers words between texts."""
    words = set(re.findall(r"\w+", (text or "").lower()))
    if len(known) > 500_000:
        known.clear()
    for w in words.difference(known):
        own = zlib.crc32(w.encode()) & (BUCKETS - 1)
        known[w] = own, zlib.crc32(b"^" + w[:PREFIX].encode()) & (BUCKETS - 1) if len(w) > PREFIX else own
    return np.unique(np.array([known[w] for w in words], np.int32).reshape(-1))


@dataclass
class FactorizationMachine:
    buckets: np.ndarray  # sorted
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, found: np.ndarray) -> float:
        at = np.searchsorted(self.buckets, found)
        at = at[(at < len(self.buckets)) & (self.buckets[np.minimum(at, len(self.buckets) - 1)] == found)] if len(self.buckets) else at[:0]
        v = self.factors[at]
        pairs = 0.5 * ((v.sum(axis=0) ** 2) - (v**2).sum(axis=0)).sum()
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[at].sum() + pairs, -30, 30))))


def train(found: list[np.ndarray], labels: np.ndarray) -> FactorizationMachine:
    """Fits the machine by full-batch Adam on the logistic loss. Without both labels it scores their share."""
    rng = np.random.default_rng(SEED)
    y = np.asarray(labels, float)
    n = len(y)
    share = (y.sum() + 0.5) / (n + 1)
    bias = float(np.log(share / (1 - share)))
    df, hit = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for f, label in zip(found, y):  # a document at a time: all their buckets at once would be the largest array here
        df[f] += 1
        hit[f] += label
    p = y.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = n * (hit * (n - p) - (df - hit) * p) ** 2 / (df * (n - df) * p * (n - p))
    chi2 = np.where((df >= LEAST_DOCS) & np.isfinite(chi2), chi2, 0)
    best = np.argsort(-chi2, kind="stable")[:TERMS]
    buckets = np.sort(best[chi2[best] >= LEAST_CHI2])
    m = len(buckets)
    place = np.full(BUCKETS, -1, np.int32)
    place[buckets] = np.arange(m)
    kept = [k[k >= 0] for k in (place[f] for f in found)]
    row = np.repeat(np.arange(n), [len(k) for k in kept]) if n else np.zeros(0, int)
    col = np.concatenate(kept).astype(np.int64) if n else np.zeros(0, np.int64)
    params = [np.array([bias]), np.zeros(m), rng.normal(0, 0.01, (m, FACTORS))]
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in params]
    for step in range(1, STEPS + 1 if m else 1):
        b, w, v = params
        sums = np.stack([np.bincount(row, v[col, f], n) for f in range(FACTORS)], axis=1)
        squares = np.bincount(row, (v[col] ** 2).sum(axis=1), n)
        z = b[0] + np.bincount(row, w[col], n) + 0.5 * ((sums**2).sum(axis=1) - squares)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        gv = np.stack([np.bincount(col, g[row] * (sums[row, f] - v[col, f]), m) for f in range(FACTORS)], axis=1)
        grads = [np.array([g.sum()]), np.bincount(col, g[row], m) + PENALTY * w, gv + PENALTY * v]
        for x, grad, (m1, m2) in zip(params, grads, moments):
            m1 += 0.1 * (grad - m1)
            m2 += 0.001 * (grad**2 - m2)
            x -= RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return FactorizationMachine(buckets.astype(np.int32), float(params[0][0]), params[1], params[2])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "toxic") -> FactorizationMachine:
    """Trains on the labelled documents outside the held-out fold, all or about ``sample`` of them by key hash.

    Null labels and keys are left out; contradicting labels of a key count as toxic; repeated rows of a document count
    each; null and empty texts have no terms; without labels the machine scores one half. Documents and toxic ones are
    counted by bucket on the executors; the driver gets, of each sampled document, the chosen buckets only, at most
    TERMS of them.
    """
    python_batches(docs.sparkSession)
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max(label).alias("__ls_y"))
    n = marked.count()
    rank = F.pmod(F.xxhash64(key, F.lit(SEED)), F.lit(1_000_003))
    chosen = materialize(marked.where(rank < 1_000_003 * min(1.0, sample / max(n, 1))), "labelled")

    @F.pandas_udf("array<int>")
    def buckets(texts: pd.Series) -> pd.Series:
        known: dict[str, tuple[int, int]] = {}
        return texts.map(lambda t: terms(t, known))

    rows = docs.select(key, text).join(hinted(chosen), key).select(key, buckets(F.col(text)).alias("t"), (F.col("__ls_y") > 0).cast("int").alias("y"))
    rows = materialize(rows, "labelled-terms")
    all_ = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).first()
    total, toxic = float(all_.n), float(all_.p or 0)
    df, hit = F.col("df"), F.col("hit")
    seen = rows.select("y", F.explode("t").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).cast("double").alias("df"), F.sum("y").cast("double").alias("hit"))
    tells = total * (hit * (total - toxic) - (df - hit) * toxic) ** 2 / (df * (total - df) * F.lit(toxic * (total - toxic)))
    best = seen.where((df >= LEAST_DOCS) & (df < total)).withColumn("chi2", tells).where(F.col("chi2") >= LEAST_CHI2 * 0.999) if 0 < toxic < total else seen.limit(0)
    best = best.orderBy(F.desc("chi2"), "bucket").limit(TERMS) if 0 < toxic < total else best
    kept = np.sort(np.array([r.bucket for r in best.select("bucket").collect()], np.int32))

    @F.pandas_udf("binary")
    def packed(found: pd.Series) -> pd.Series:
        return found.map(lambda t: np.intersect1d(np.asarray(t, np.int32), kept).tobytes())

    got = sorted(rows.select(key, packed("t").alias("t"), "y").collect(), key=lambda r: (r[0], r.t, r.y))
    return train([np.frombuffer(r.t, np.int32) for r in got], np.array([r.y for r in got]))


def scored(docs: DataFrame, machine: FactorizationMachine, text: str = "text") -> DataFrame:
    """Adds ``score``; a null or empty text gets the bias alone. Each row is scored by itself, from its whole text; an
    empty table gives an empty result; an input column named score gives way."""
    python_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        known: dict[str, tuple[int, int]] = {}
        return texts.map(lambda t: machine.score(terms(t, known))).astype(float)

    return docs.drop("score").withColumn("score", score(F.col(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = fit(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, machine)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
