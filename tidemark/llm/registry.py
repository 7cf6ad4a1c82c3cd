"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import chat, exact, langid, lloyd, mpegts, packing, pii, quality, repeats, sentencepiece, simhash, substring, whitening

QUERIES = (
    mpegts.op1_media_mpegts,
    substring.op2_substring_dedup,
    exact.op3_exact_dedup,
    pii.op4_pii_crf,
    repeats.op5_suffix_dedup,
    simhash.op6_simhash_components,
    sentencepiece.op7_sentencepiece,
    langid.op8_language_id,
    packing.op9_bestfit_packing,
    chat.op10_chat_format,
    lloyd.op11_centroid_clustering,
    quality.op12_quality_rules,
    whitening.op13_embedding_whitening,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": substring.OP2_SQL, "op3_exact_dedup": exact.OP3_SQL, "op5_suffix_dedup": repeats.OP5_SQL, "op10_chat_format": chat.OP10_SQL,
        "op11_centroid_clustering": lloyd.OP11_SQL, "op12_quality_rules": quality.OP12_SQL,
    }
