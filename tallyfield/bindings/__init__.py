"""The operators bound to the test tables, each with equivalent SQL where SQL can say it."""

from __future__ import annotations

from importlib import import_module

AREAS = ["retail", "purchases", "labelled", "modelled"]


def load() -> tuple[dict, dict]:
    """All registered queries and their SQL."""
    for area in AREAS:
        import_module(f"{__name__}.{area}")
    from .registry import QUERIES, SQL

    return QUERIES, SQL
