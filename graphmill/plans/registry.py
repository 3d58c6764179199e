"""Registration of queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable:
        def register(fn: Callable) -> Callable:
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return register
