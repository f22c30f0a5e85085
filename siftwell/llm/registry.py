"""Queries and oracle SQL of all operators in this subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = ("langid", "sharding", "chat", "tokens", "pii", "ogg", "packing", "decontaminate", "setsketch", "repeats", "filter_audit", "quality_rules", "va_codes")


def queries() -> dict:
    return {k: q for m in MODULES for k, q in import_module(f"siftwell.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in import_module(f"siftwell.llm.{m}").ORACLES.items()}
