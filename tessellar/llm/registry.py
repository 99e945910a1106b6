"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name and module.
QUERIES = {
    "op1_pii": "pii",
    "op3_licenses": "licenses",
    "op4_packing": "packing",
    "op5_chroma": "audio",
    "op6_quality": "quality",
    "op7_langid": "langid",
    "op2_kdtree_topk": "topk",
    "op9_warc": "warc",
    "op8_bpe_trie": "bpe_trie",
    "op10_near_dedup": "near",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, module in QUERIES.items() if (sql := getattr(import_module(f"{__package__}.{module}"), "SQL", None))}
