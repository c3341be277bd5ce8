"""How operator modules list their queries."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """queries: name -> function of (spark, folder); sql: name -> the same in DuckDB SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        def wrap(f: Callable) -> Callable:
            if name in self.queries:
                raise ValueError(f"{name} is registered twice")
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return wrap
