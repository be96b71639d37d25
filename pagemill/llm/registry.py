"""The corpus operators' queries by name."""

from __future__ import annotations

import importlib

#: Query: module. Each module has query(spark, sf_dir) and, where SQL can express it, ORACLE.
MODULES = {
    "op1_substring": "substring",
    "op2_license": "licenses",
    "op3_bpe": "bpe",
    "op4_url_filter": "urlfilter",
    "op5_quality": "preference",
    "op6_token_counts": "unigram",
    "op7_decontam": "decontam",
    "op8_near_dup": "dartminhash",
    "op9_line_rules": "linerules",
    "op10_warc": "warc",
    "op11_byte_bpe": "bytebpe",
    "op12_fim": "fim",
    "op13_hard_negatives": "hardneg",
}
_loaded = {name: importlib.import_module(f"pagemill.llm.{module}") for name, module in MODULES.items()}


def queries() -> dict:
    return {name: module.query for name, module in _loaded.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE for name, module in _loaded.items() if getattr(module, "ORACLE", None)}
