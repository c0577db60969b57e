"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, fingerprints, language, near_duplicates, personal, pieces, sharding, substring, toxicity, url_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_substring_dedup": substring.op2_substring_dedup,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_language_id": language.op4_language_id,
    "op5_ngram_join": near_duplicates.op5_ngram_join,
    "op6_personal": personal.op6_personal,
    "op7_pieces": pieces.op7_pieces,
    "op8_url_rules": url_rules.op8_url_rules,
    "op9_sharding": sharding.op9_sharding,
    "op10_toxicity": toxicity.op10_toxicity,
}
ORACLES: dict[str, str] = {
    "op1_fingerprints": fingerprints.ORACLE,
    "op2_substring_dedup": substring.ORACLE,
    "op3_decontamination": decontamination.ORACLE,
    "op5_ngram_join": near_duplicates.ORACLE,
    "op8_url_rules": url_rules.ORACLE,
}
