"""The queries of the library's own operators and their SQL."""

from __future__ import annotations

from moleweave.plans import lift_queries, molecule_queries, operator_queries

MODULES = (molecule_queries, operator_queries, lift_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
