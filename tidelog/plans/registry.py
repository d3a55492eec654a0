"""All registered queries and their oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query by its function's name, with the same in SQL where SQL can express it."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


for _name in ("scalars", "temporal", "joins", "aggregates", "experts", "evaluation", "streams", "dossier", "retrieval"):
    importlib.import_module(f"tidelog.plans.{_name}")
