"""Registered queries over the driver's tables, with their SQL oracles.

Those tables hold no postings, so adapters shape them into filings, postings and landed responses. An adapter is one SQL
text that both engines run; @name in a text stands for a table or for another adapter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(oracle: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            from rolespark.queries.adapters import expand

            ORACLES[f.__name__] = expand(oracle)
        return f

    return add
