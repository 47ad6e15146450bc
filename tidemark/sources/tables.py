"""Readers of the base tables: one Parquet path per table, opened by Spark alone."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@contextmanager
def views(spark: SparkSession, sf_dir: str, names: Iterable[str]) -> Iterator[None]:
    """The tables as temp views for spark.sql; the session's own views of these names come back afterwards."""
    own = {n: spark.table(n) for n in names if spark.catalog.tableExists(n) and spark.catalog.getTable(n).isTemporary}
    try:
        for n in names:
            read_table(spark, sf_dir, n).createOrReplaceTempView(n)
        yield
    finally:
        for n in names:
            spark.catalog.dropTempView(n)
        for n, rows in own.items():
            rows.createOrReplaceTempView(n)
