"""All queries over the driver's tables, outside the llm subpackage, and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Modules of lachesis.plans; each has QUERIES and ORACLES.
MODULES: list[str] = ["series_queries", "table_queries", "evaluate_queries", "io_queries"]
FLAGSHIP = "response_transitions"


def collect(attribute: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"lachesis.plans.{m}"), attribute).items()}


def queries() -> dict:
    return collect("QUERIES")


def oracles() -> dict:
    return collect("ORACLES")
