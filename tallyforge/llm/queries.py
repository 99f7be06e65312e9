"""The queries of this subpackage and the DuckDB SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from . import sql

#: Query: module.
_MODULES = {
    "op1_pack": "packing",
    "op2_mix": "mixing",
    "op3_hmm": "hmm",
    "op4_vptree": "vptree",
    "op5_warc": "warc",
    "op6_media": "media",
    "op7_token_counts": "token_counts",
    "op8_toxicity": "toxicity",
    "op9_ngram_join": "ngram_join",
    "op10_chat": "chat",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, text in sql.ORACLE.items() if name in _MODULES}
