"""The queries over whole tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, fingerprint, hard_negatives, html_extract, language_id, license_scan, merkle, mixing, secret_scan, simhash, substring, url_filter

_OPERATORS: dict[str, tuple[str, Callable[[DataFrame], DataFrame], str | None]] = {
    "op1_secret_scans": ("documents", secret_scan.op1_secret_scans, None),
    "op2_url_filters": ("pages", url_filter.op2_url_filters, url_filter.SQL),
    "op3_byte_bpe": ("documents", bpe.op3_byte_bpe, None),
    "op4_fingerprints": ("documents", fingerprint.op4_fingerprints, None),
    "op5_html_extraction": ("pages", html_extract.op5_html_extraction, None),
    "op6_language_id": ("documents", language_id.op6_language_id, None),
    "op7_mixing": ("documents", mixing.op7_mixing, mixing.SQL),
    "op8_license_scans": ("documents", license_scan.op8_license_scans, license_scan.SQL),
    "op9_nearest": ("embeddings", ann.op9_nearest, None),
    "op10_simhash": ("documents", simhash.op10_simhash, None),
    "op11_substring_dedup": ("documents", substring.op11_substring_dedup, None),
    "op12_hard_negatives": ("embeddings", hard_negatives.op12_hard_negatives, hard_negatives.SQL),
    "op13_merkle": ("documents", merkle.op13_merkle, merkle.SQL),
}


def _query(table: str, f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(table, f) for name, (table, f, _) in _OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, _, sql) in _OPERATORS.items() if sql}
