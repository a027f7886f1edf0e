"""All registered queries and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["q_retrieval", "q_corpus", "q_orders", "q_evidence", "q_trajectories", "q_runs"]

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"shelfmark.plans.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
