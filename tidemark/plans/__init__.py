"""Named queries over the project's tables."""

from __future__ import annotations

from importlib import import_module

#: Modules that register queries when they are imported.
MODULES = ("periods", "timeline", "records", "signals", "pipeline", "exchange")


def load() -> tuple[dict, dict]:
    """All registered queries and their SQL twins."""
    for m in MODULES:
        import_module(f"tidemark.plans.{m}")
    from tidemark.plans.registry import QUERIES, SQL

    return QUERIES, SQL
