"""Registry of queries: a Spark callable and, where SQL can express it, the oracle text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFunction = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: QueryFunction
    sql: str | None
    covers: str


REGISTRY: dict[str, Query] = {}


def query(covers: str, sql: str | None = None) -> Callable[[QueryFunction], QueryFunction]:
    """Register a query under its function name. ``covers`` lists the operators it exercises."""

    def add(fn: QueryFunction) -> QueryFunction:
        if fn.__name__ in REGISTRY:
            raise ValueError(f"query {fn.__name__} registered twice")
        REGISTRY[fn.__name__] = Query(fn, sql, covers)
        return fn

    return add


def r6(name: str, alias: str | None = None) -> Column:
    """Six digits for comparison."""
    return F.round(F.col(name), 6).alias(alias or name)


def b6(name: str) -> Column:
    """Six digits of a number that is not negative, without a decimal text: for queries of very many rows."""
    return (F.floor(F.col(name) * 1e6 + 0.5) / 1e6).alias(name)


def joined(column: str | Column, alias: str) -> Column:
    return F.concat_ws("|", column).alias(alias)
