"""Operators for preparing training data; nothing else in the library imports this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from solvarium.llm import ann, chat, decontam, filters, licenses, neardup, packing, pii, quality, secrets, tokens, warc, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op10_minhash_neardup": neardup.query,
        "op11_embedding_whitening": whitening.query,
        "op12_license_scan": licenses.query,
        "op13_filter_audit": filters.query,
        "op1_quality_classifier": quality.query,
        "op2_ann_learned_partitions": ann.query,
        "op3_token_counts": tokens.query,
        "op4_chat_format": chat.query,
        "op5_pii_surrogates": pii.query,
        "op6_best_fit_packing": packing.query,
        "op7_warc_writer": warc.query,
        "op8_decontamination": decontam.query,
        "op9_secret_scan": secrets.query,
    }


def oracle_sql() -> dict[str, str]:
    """Learned, approximate and tokenised results have no SQL form; those are tested against brute force."""
    return {
        "op10_minhash_neardup": neardup.ORACLE,
        "op12_license_scan": licenses.oracle(),
        "op13_filter_audit": filters.ORACLE,
        "op4_chat_format": chat.ORACLE,
        "op7_warc_writer": warc.ORACLE,
        "op8_decontamination": decontam.ORACLE,
        "op9_secret_scan": secrets.ORACLE,
    }
