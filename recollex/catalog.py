"""All registered queries of the library and their SQL twins.

A query module has ``QUERIES`` (name -> function of session and data folder) and
``ORACLE_SQL`` (name -> SQL over the same tables).
"""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("plans.event_queries", "plans.search_queries", "plans.graph_queries", "plans.scalar_queries", "plans.memory_queries", "plans.stream_queries", "plans.agent_queries", "plans.more_queries", "plans.twins", "plans.store_queries")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"recollex.{name}"), attribute)
        if clash := out.keys() & part.keys():
            raise ValueError(f"registered twice: {sorted(clash)}")
        out |= part
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE_SQL")
