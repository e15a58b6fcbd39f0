"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("suffixes", "quality", "near_duplicates", "warc", "licences", "html_text", "mixing", "decontamination", "token_counts", "packing", "hard_negatives", "conversations", "toxicity")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"moleweave.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"moleweave.llm.{m}").ORACLES.items()}
