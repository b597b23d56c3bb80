"""Registration of a query together with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self._queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Decorator: registers the function under its name, with the SQL that must give the same rows."""

        def register(f: Query) -> Query:
            self._queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return register

    def queries(self) -> dict[str, Query]:
        return self._queries
