"""Named queries of the core engine, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _load() -> None:
    from . import q_graph, q_matching, q_metrics, q_pairs, q_relational, q_sketches, q_sources, q_stats, q_streaming, q_tables, q_text  # noqa: F401


_load()
