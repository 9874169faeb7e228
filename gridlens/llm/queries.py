"""The numbered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat_format, html_extract, license_scan, media, mixing, ngram_join, period_runs, quality, sentencepiece_codec, toxicity, turn_repair, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": chat_format.op1,
    "op2_url_filters": url_filter.op2,
    "op3_html_extraction": html_extract.op3,
    "op4_approximate_nearest_neighbours": ann.op4,
    "op5_toxicity": toxicity.op5,
    "op6_sentencepiece_codec": sentencepiece_codec.op6,
    "op7_media_columns": media.op7,
    "op8_mixing_sources": mixing.op8,
    "op9_ngram_jaccard_join": ngram_join.op9,
    "op10_quality_classifier": quality.op10,
    "op11_license_scans": license_scan.op11,
    "op12_period_runs": period_runs.op12,
    "op13_turn_repair": turn_repair.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": chat_format.OP1_SQL,
    "op2_url_filters": url_filter.OP2_SQL,
    "op9_ngram_jaccard_join": ngram_join.OP9_SQL,
    "op11_license_scans": license_scan.OP11_SQL,
    "op12_period_runs": period_runs.OP12_SQL,
    "op13_turn_repair": turn_repair.OP13_SQL,
}
