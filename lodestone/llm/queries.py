"""The registered query of each corpus operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, langid, linededup, media, mixing, packing, quality, simhash, token_files, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_simhash_gray_index": simhash.query,
        "op2_configuration_packing": packing.query,
        "op3_reply_tree_chat": chat.query,
        "op4_seekable_token_files": token_files.query,
        "op5_poisson_mixing": mixing.query,
        "op6_interleaved_media": media.query,
        "op7_toxicity_machine": toxicity.query,
        "op8_language_codes": langid.query,
        "op9_host_quality": quality.query,
        "op10_line_edit_dedup": linededup.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_poisson_mixing": mixing.SQL, "op9_host_quality": quality.SQL}
