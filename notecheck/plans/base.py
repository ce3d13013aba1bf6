"""How plans register queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.adapters import ctes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its oracle SQL over base and derived tables."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = ctes(sql)
        return f

    return register


def sql_round(x: str, places: int) -> str:
    return f"(floor(({x}) * 1e{places} + 0.500001e0) / 1e{places})"


def sql_km(a: str, b: str, c: str, d: str) -> str:
    h = f"(sin(radians({c} - {a}) / 2) * sin(radians({c} - {a}) / 2) + cos(radians({a})) * cos(radians({c})) * sin(radians({d} - {b}) / 2) * sin(radians({d} - {b}) / 2))"
    return f"(12742e0 * atan2(sqrt({h}), sqrt(1 - {h})))"
