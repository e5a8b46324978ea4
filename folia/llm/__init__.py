"""Operators of a training-data pipeline; nothing else in the library imports this package."""

from __future__ import annotations

from importlib import import_module

MODULES = ("op1_chat", "op2_embedding", "op3_secrets", "op4_decontaminate", "op5_passages", "op6_url", "op7_toxicity", "op8_simhash", "op9_warc", "op10_mixing")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"folia.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"folia.llm.{m}").ORACLES.items()}
