"""The register of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL twin."""

    def add(f: Query) -> Query:
        REGISTERED[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add
