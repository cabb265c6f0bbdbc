"""Queries and SQL of the training-data operators, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import bpe, chat, fingerprint, mixing, near, phrases, pii, quality, repeats, spelling, tokencount, tokenfile, topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_duplicates": near.query,
        "op2_quality_rules": quality.query,
        "op3_byte_bpe": bpe.query,
        "op4_repeated_strings": repeats.query,
        "op5_pii": pii.query,
        "op6_token_counts": tokencount.query,
        "op7_fingerprints": fingerprint.query,
        "op8_source_mixing": mixing.query,
        "op9_token_files": tokenfile.query,
        "op10_chat_format": chat.query,
        "op11_phrases": phrases.query,
        "op12_exact_topk": topk.query,
        "op13_spelling_variants": spelling.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality.ORACLE_SQL, "op10_chat_format": chat.ORACLE_SQL, "op11_phrases": phrases.ORACLE_SQL, "op12_exact_topk": topk.ORACLE_SQL, "op13_spelling_variants": spelling.ORACLE_SQL}
