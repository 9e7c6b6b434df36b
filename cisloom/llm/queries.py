"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, byte_dedup, jaccard_join, license_scan, media, mixing, quality_model, quality_rules, secret_scan, source_audit, vector_codes, warc, window_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_media_audio": media.op3_media_audio,
    "op4_substring_dedup": window_dedup.op4_substring_dedup,
    "op5_mixing": mixing.op5_mixing,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_quality_classifier": quality_model.op7_quality_classifier,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_suffix_dedup": byte_dedup.op9_suffix_dedup,
    "op10_license_scan": license_scan.op10_license_scan,
    "op11_warc": warc.op11_warc,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_source_audit": source_audit.op13_source_audit,
}

SQL: dict[str, str] = {"op4_substring_dedup": window_dedup.OP4_SQL, "op5_mixing": mixing.OP5_SQL, "op8_jaccard_join": jaccard_join.OP8_SQL, "op9_suffix_dedup": byte_dedup.OP9_SQL, "op11_warc": warc.OP11_SQL, "op12_vector_codes": vector_codes.OP12_SQL, "op13_source_audit": source_audit.OP13_SQL}
