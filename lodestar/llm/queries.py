"""The operators as queries over the driver's tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import (
    bitpack, exactdedup, htmltext, langid, matroska, mixing, packing, sharding, simhash, wordpiece,
)
from lodestar.llm.common import documents


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    on = lambda f: lambda spark, sf_dir: f(documents(spark, sf_dir))
    return {
        "op1_balanced_shards": on(sharding.balanced_shards),
        "op2_packed_token_ids": on(bitpack.packed_token_ids),
        "op3_media_columns": on(matroska.media_columns),
        "op4_best_fit_packing": on(packing.pack_documents),
        "op5_mix_sources": on(mixing.mix_sizes),
        "op6_token_counts": on(wordpiece.token_counts),
        "op7_exact_dedup": on(exactdedup.duplicate_groups),
        "op8_html_text": lambda spark, sf_dir: htmltext.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")),
        "op9_language_id": on(langid.languages),
        "op10_simhash_near_dedup": on(simhash.near_duplicates),
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_mix_sources": mixing.SQL, "op7_exact_dedup": exactdedup.SQL}
