"""A registry of queries and their oracle SQL, filled by decorators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrafold.sources.fixtures import with_views

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None, recursive: bool = False) -> Callable[[Query], Query]:
        """Registers a query under its own name; ``sql`` may name the derived views."""

        def wrap(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracles[f.__name__] = with_views(sql, recursive)
            return f

        return wrap
