"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workload.fixtures import duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function name; ``sql`` may name tables ``{t}`` and fixtures ``[f]``."""
    def register(fn):
        key = name or fn.__name__
        assert key not in QUERIES, key
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = duck(sql)
        return fn
    return register


def r6(c, name: str | None = None) -> Column:
    """Six decimals, without negative zero."""
    column = F.col(c) if isinstance(c, str) else c
    return (F.round(column, 6) + F.lit(0.0)).alias(name or (c if isinstance(c, str) else "value"))


def s6(text: str, name: str) -> str:
    """SQL twin of :func:`r6`."""
    return f"round({text}, 6) + 0.0 AS {name}"


def s_hav(a: str, b: str, c: str, d: str, radius: str, clamp: bool = False) -> str:
    h = (f"sqrt(pow(sin(radians({c} - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) "
         f"* pow(sin(radians({d} - ({b})) / 2), 2))")
    return f"(2 * {radius} * asin({f'least(1.0, {h})' if clamp else h}))"
