"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import importlib

#: Module and function of each query.
NAMES = {
    "op1_warc": "warc",
    "op2_license_scan": "license_scan",
    "op3_hyperminhash": "near_dedup",
    "op4_token_counts": "token_counts",
    "op5_exact_dedup": "exact_dedup",
    "op6_decontaminate": "decontaminate",
    "op7_suffix_dedup": "suffix_dedup",
    "op8_mix_sources": "mixing",
    "op9_secret_scan": "secret_scan",
    "op10_language_id": "language_id",
    "op11_periodic_runs": "periodic_runs",
    "op12_html_extract": "html_extract",
    "op13_collocations": "collocations",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"tessera.llm.{module}"), name) for name, module in NAMES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in NAMES.values() for name, sql in getattr(importlib.import_module(f"tessera.llm.{module}"), "ORACLE", {}).items()}
