"""Every query of the library by name, with the DuckDB SQL that gives the same rows where there is one."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.tables import TABLES, views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `oracle` is left out where SQL cannot express it."""

    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


def frame(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Spark SQL over the base tables of a folder."""
    with views(spark, sf_dir, [t for t in TABLES if re.search(rf"\b{t}\b", text)]):
        return spark.sql(text)


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Register a query written in Spark SQL over the base tables; the oracle's text is the same unless given."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return frame(spark, sf_dir, text)

    run.__name__ = name
    query(name, oracle or text)(run)
