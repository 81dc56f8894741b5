"""A corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and reread as the next stage's
``docs``. All but the last return the columns of ``documents``; further input columns, whatever their names, are left out.
An empty table goes through all stages empty. Texts of any length are worked on whole.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import WHITE, kept_only
from lodestone.llm.linededup import line_dedup
from lodestone.llm.mixing import mix_sources
from lodestone.llm.packing import pack_documents
from lodestone.llm.quality import MIN_WORDS, quality_rules, words_of
from lodestone.llm.simhash import similar_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near-duplicates in the pipeline share at least SIMILARITY of their five-word shingles. Candidates are texts of which one
#: of eight SimHashes or of the min-wise fingerprints is near; the shingles themselves decide.
SHINGLE_WORDS, FINGERPRINTS = 5, 8
MINWISE, SIMILARITY = 16, 0.8
TOKENIZER = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, by themselves or with their host.

    A null or empty text has no words and goes; a null source is a host of its own; null ids, languages and sizes don't
    matter; repeated rows are judged each.
    """
    return quality_rules(docs).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents of which they were all but scraps; n_chars follows the text.

    Scraps hold fewer words than the quality rules ask for and less than half of the text, and no line that the
    dedup looks at. A document that keeps more than that stays, however short its lines. Null and empty texts stay as
    they are; of equal lines the one in the document of the least id stays, a null id being the least, and then that of
    the least text hash; rows equal in id and text are one place and lose the same lines.
    """
    left = line_dedup(docs.withColumn("__ls_size", F.length("text")))
    much = (F.size(words_of(F.col("text"))) >= MIN_WORDS) | ((F.length("text") * 2 >= F.col("__ls_size")) & F.col("text").rlike(f"[^{WHITE}]"))
    left = left.where((F.col("n_removed") == 0) | (F.col("n_long_left") > 0) | much)
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, all links of which were verified: the one of the least id, then
    text hash. Rows with a null id stay; rows that repeat an id with another text are documents of their own, rows that
    repeat both are one; texts without words, null ones too, are alike.
    """
    return similar_dedup(docs, SIMILARITY, words=SHINGLE_WORDS, tables=FINGERPRINTS, minwise=MINWISE).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate draws it; copies are rows of their own. A null source is a source of its
    own; rows with a null id all get the same draw, as do repeated rows; texts aren't looked at.
    """
    return mix_sources(docs).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place. A null text is empty, its piece the end id; null ids and repeated rows
    have pieces of their own.
    """
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-dedup", near),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what one writes on its way is removed when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = kept_only(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fingerprints, edit distances and token ids aren't SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None
