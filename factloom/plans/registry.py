"""How a module of queries registers them."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    """(queries, oracles, decorator); the decorator takes the DuckDB SQL, or None where SQL can't express it."""
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None) -> Callable:
        def keep(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql is not None:
                oracles[f.__name__] = sql
            return f

        return keep

    return queries, oracles, query
