"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

#: Query name to module of this subpackage.
MODULES = {
    "op1_langid": "langid",
    "op2_token_rollup": "rollup",
    "op3_minhash": "minhash",
    "op4_gif": "gif",
    "op5_pii": "pii",
    "op6_decontaminate": "decontaminate",
    "op7_bpe": "bpe",
    "op8_toxicity": "toxicity",
    "op9_token_file": "tokenfile",
    "op10_secrets": "secrets",
}


def queries() -> dict[str, Callable]:
    return {name: getattr(importlib.import_module(f"tidewell.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    """By convention a module's ORACLE is the SQL of its query."""
    loaded = {name: importlib.import_module(f"tidewell.llm.{module}") for name, module in MODULES.items()}
    return {name: m.ORACLE for name, m in loaded.items() if hasattr(m, "ORACLE")}
