"""All queries of the library and their SQL oracles."""

from __future__ import annotations

from quillon.plans import layout, library, retrieval, sessions, texts

MODULES = [retrieval, sessions, texts, library, layout]


def flagship(spark, sf_dir: str):
    """Federated search over whole texts: union, filters, entity resolution, rank fusion and ranking."""
    return retrieval.Q["t01_t02_u01_federated_search"](spark, sf_dir)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.Q.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.O.items()}
