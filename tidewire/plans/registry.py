"""Registered queries and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def rounded(value: str | Column, name: str | None = None, digits: int = 6) -> Column:
    """Rounded after a nudge, so that values on a tie but for their last bit round alike in every engine."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column + 33e-10, digits).alias(name or value)
