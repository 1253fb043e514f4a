"""Operators for large-scale training data; nothing else in the package imports this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, html_extract, langid, licence, near_dup, pii, quality, repeats, tokenstore

_MODULES = {"op7_repeats": repeats, "op9_licence": licence, "op5_near_dup": near_dup, "op4_language_id": langid, "op1_pii": pii, "op3_html": html_extract, "op2_bpe": bpe, "op6_token_store": tokenstore, "op8_decontamination": decontam, "op10_quality": quality}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(module, name) for name, module in _MODULES.items()} | {"page_language": langid.page_language}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE for name, module in _MODULES.items() if getattr(module, "ORACLE", None)}
