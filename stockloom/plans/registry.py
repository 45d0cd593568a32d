"""All registered queries and their oracle SQL, by SURVEY id."""

from __future__ import annotations

from importlib import import_module

MODULES = ("q_movement", "q_linkage", "q_dedupe", "q_health", "q_listings", "q_events", "q_catalogue", "q_search", "q_sources", "q_network", "q_expressions")


def _collect(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"stockloom.plans.{name}"), attribute)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("ORACLE")
