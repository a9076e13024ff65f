"""All queries with their oracles, by name."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: adds a query (spark, sf_dir) -> DataFrame, with its SQL where SQL can say it."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def load() -> None:
    """Imports every module that registers queries."""
    from gritmill.queries import functions, graph, index, mining, pipelines, rules, search, state  # noqa: F401
