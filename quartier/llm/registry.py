"""Queries of the subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quartier.llm import bpe, decontaminate, linededup, merkle, ngramjoin, preferences, quality, repair, secrets, sharding, substrings, tokenstore, urlfilter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": ngramjoin.query,
    "op2_decontamination": decontaminate.query,
    "op3_sharding": sharding.query,
    "op4_line_dedup": linededup.query,
    "op5_byte_bpe": bpe.query,
    "op6_token_store": tokenstore.query,
    "op7_quality_rules": quality.query,
    "op8_preferences": preferences.query,
    "op9_url_filters": urlfilter.query,
    "op10_secret_scans": secrets.query,
    "op11_substring_dedup": substrings.query,
    "op12_merkle_manifest": merkle.query,
    "op13_conversation_repair": repair.query,
}
ORACLES: dict[str, str] = {
    "op7_quality_rules": quality.ORACLE,
    "op8_preferences": preferences.ORACLE,
    "op9_url_filters": urlfilter.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
    "op13_conversation_repair": repair.ORACLE,
}
