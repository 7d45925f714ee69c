"""Every registered query and its SQL twin."""

from __future__ import annotations

from importlib import import_module

from studyspark.plans.registry import Query

SECTIONS = ("study", "text", "entities", "vectors", "graph_build", "graph_query", "cards", "telemetry", "exchange", "streams")


def _collect(attribute: str) -> dict:
    out: dict = {}
    for section in SECTIONS:
        out.update(getattr(import_module(f"studyspark.plans.{section}").catalog, attribute))
    return out


def queries() -> dict[str, Query]:
    return _collect("queries")


def oracle_sql() -> dict[str, str]:
    return _collect("sql")
