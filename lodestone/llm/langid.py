"""Language identification by error-correcting output codes.

Each language has a codeword; one binary classifier per bit, over hashed byte n-grams, predicts that bit. A text
goes to the language whose codeword costs least, each bit's logistic loss weighed by how well its classifier did
in training, and is flagged as ambiguous if the runner-up costs about as little.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import python_batches, table
from .toxicity import held_out

FEATURES = 1 << 12
#: Documents in training at most, in expectation, shared evenly by the languages.
SAMPLE = 4000
BITS, STEPS, RATE, PENALTY = 15, 120, 2.0, 1e-4
#: Runner-up within this share of the best cost: ambiguous.
MARGIN = 0.2
SEED = 5
UNKNOWN = "und"
#: Languages at most; what the driver gets in training is bounded by this and SAMPLE.
LANGUAGES = 1000
_BYTES = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str) -> bool:
    """Whether there is a character of the Unicode category L; numbers such as \u00bd or \u2167 are none."""
    return any(m[0].isalpha() for m in re.finditer(r"[^\W\d_]", text))


def features(text: str | None) -> np.ndarray | None:
    """Square roots of the shares of a text's byte bigrams and trigrams, hashed; None without a letter.

    Upper case, digits and ASCII marks make no difference, nor does how words are separated.
    """
    if not text or not has_letter(text):
        return None
    raw = b" " + b" ".join(text.lower().encode().translate(_BYTES).split()) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    two = b[:-1] << np.uint32(8) | b[1:]
    three = two[:-1] << np.uint32(8) | b[2:]
    counts = np.zeros(FEATURES)
    for grams in (two, three):
        counts += np.bincount((grams * np.uint32(2654435761)) >> np.uint32(20), minlength=FEATURES)
    return np.sqrt(counts / counts.sum())


def codewords(languages: int, bits: int = BITS) -> np.ndarray:
    """+1/-1 codewords far apart: the best of many random draws, bits that all languages share excluded."""
    rng = np.random.default_rng(SEED)
    bits = max(bits, 4 * int(np.ceil(np.log2(max(languages, 2)))) + 3)
    best, far = None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], (languages, bits))
        if languages > 1:
            apart = (bits - code @ code.T) // 2 + bits * np.eye(languages, dtype=int)
            score = int(apart.min()) * 2 + int((np.abs(code.sum(axis=0)) < languages).all())
        else:
            score = 0
        if score > far:
            best, far = code, score
    return best


@dataclass
class CodeClassifier:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous)."""
        x = features(text)
        if x is None or not self.languages:
            return UNKNOWN, 0.0, True
        margins = x @ self.weights + self.bias
        cost = (np.logaddexp(0, -self.code * margins) * self.trust).sum(axis=1)
        order = np.argsort(cost, kind="stable")
        share = np.exp(cost.min() - cost)
        close = len(order) > 1 and cost[order[1]] - cost[order[0]] < MARGIN * max(cost[order[1]], 1e-9)
        return self.languages[order[0]], float(share[order[0]] / share.sum()), bool(close)


def train(x: np.ndarray, languages: list[str]) -> CodeClassifier:
    """Logistic regression for every bit at once; bits are trusted by the log odds of their accuracy."""
    names = sorted(set(languages))
    code = codewords(len(names)) if names else np.zeros((0, BITS))
    y = code[[names.index(v) for v in languages]] if names else np.zeros((0, BITS))
    n = max(len(languages), 1)
    y = y.astype(np.float32)
    w, b = np.zeros((FEATURES, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1 if names else 1):
        g = -y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) / np.float32(n)
        grad = x.T @ g + PENALTY * w / n
        m1 += 0.1 * (grad - m1)
        m2 += 0.001 * (grad**2 - m2)
        w -= RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        b -= RATE * g.sum(axis=0)
    right = ((y * (x @ w + b) > 0).sum(axis=0) + 1) / (n + 2) if names else np.ones(code.shape[1])
    trust = np.clip(np.log(right / (1 - right + 1e-9)), 0.05, 6.0) / 6.0
    return CodeClassifier(names, code, w, b, trust)


def fit(docs: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", lang: str = "lang") -> CodeClassifier:
    """Trains on texts with a language outside the held-out fold: all of a language's, or about its even share of
    ``sample`` by key hash. The driver gets their n-gram shares. Null keys, texts and languages are left out, and texts
    without a letter; repeated rows count each; without any row every text is ``und``; more than LANGUAGES values of
    ``lang`` are an error. Whole texts are read, however long."""
    python_batches(docs.sparkSession)
    usable = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    counts = {r[0]: r[1] for r in usable.groupBy(lang).count().limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} values of {lang}")
    if not counts:
        return train(np.zeros((0, FEATURES)), [])
    each = sample / len(counts)
    share = F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, min(1.0, each / n))))
    rank = F.pmod(F.xxhash64(key, F.lit(SEED)), F.lit(1_000_003)) / F.lit(1_000_003.0)

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if (x := features(t)) is None else x.astype(np.float16).tobytes())

    rows = usable.where(rank < share[F.col(lang)]).select(key, lang, packed(F.col(text)).alias("x")).where("x is not null").collect()
    rows = sorted(rows, key=lambda r: (r[0], r[1], bytes(r.x)))
    x = np.stack([np.frombuffer(bytes(r.x), np.float16) for r in rows]).astype(np.float32) if rows else np.zeros((0, FEATURES), np.float32)
    return train(x, [r[1] for r in rows])


def identified(docs: DataFrame, model: CodeClassifier, text: str = "text") -> DataFrame:
    """Adds lang_pred, score and ambiguous; ``und`` with score 0 for null texts and texts without a letter. Each row is
    judged by itself, repeated ones too; ties go to the first language by name; an empty table gives an empty result.
    Input columns of these names give way."""
    python_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score", "ambiguous"])

    out = docs.drop("lang_pred", "score", "ambiguous").withColumn("__ls_p", predicted(F.col(text)))
    return out.select("*", "__ls_p.*").drop("__ls_p")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs)
    return identified(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
