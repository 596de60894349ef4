"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name: module that has ``query`` and, where SQL can express it, ``SQL``.
MODULES = {
    "op1_token_counts": "op1_token_counts",
    "op2_sharding": "op2_sharding",
    "op3_decontamination": "op3_decontamination",
    "op4_packing": "op4_packing",
    "op5_substring_dedup": "op5_substring_dedup",
    "op6_exact_dedup": "op6_exact_dedup",
    "op7_pii": "op7_pii",
    "op8_jaccard_join": "op8_jaccard_join",
    "op9_quality": "op9_quality",
    "op10_licenses": "op10_licenses",
    "op11_collocations": "op11_collocations",
    "op12_secrets": "op12_secrets",
    "op13_filter_audit": "op13_filter_audit",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found = {name: import_module(f"{__package__}.{module}").query for name, module in MODULES.items()}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
