"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: name of the query -> module
_MODULES = {
    "op1_token_binary": "token_binary",
    "op2_jaccard_join": "jaccard_join",
    "op3_decontaminate": "decontaminate",
    "op4_suffix_dedup": "suffix_dedup",
    "op5_token_counts": "token_counts",
    "op6_pii": "pii",
    "op7_quality_rules": "quality_rules",
    "op8_packing": "packing",
    "op9_byte_cnn": "byte_cnn",
    "op10_warc": "warc",
    "op11_spelling": "spelling",
    "op12_shards": "shards",
    "op13_cross_tokenizer": "cross_tokenizer",
}


def queries() -> dict:
    return {name: import_module(f"{__package__}.{module}").query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in _MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
