"""Daily files of JSON lines: one folder a day, read by the days asked for, with a fingerprint that tells whether they are
the rows that were meant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Times keep their microseconds.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def write_days(rows: DataFrame, path: str, time: str) -> None:
    rows.withColumn("day", F.col(time).cast("date").cast("string")).write.mode("overwrite").options(**_TIMES).partitionBy("day").json(path)


def read_days(spark: SparkSession, path: str, schema: StructType, first: str, last: str) -> DataFrame:
    """The rows of the days first to last; other folders are not read."""
    rows = spark.read.schema(StructType(schema.fields).add("day", "date")).options(**_TIMES).json(path)
    return rows.filter(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).drop("day")


def fingerprint(rows: DataFrame) -> DataFrame:
    """n and print: the number of rows and a sum of their hashes, whatever their order."""
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("print"))


class StoreMismatch(RuntimeError):
    """The daily files do not hold the rows that their summary was made of."""


def checked(rows: DataFrame, meant: DataFrame) -> DataFrame:
    """rows, if their fingerprint is that of `meant`."""
    if fingerprint(rows).first() != meant.first():
        raise StoreMismatch("the daily files hold other rows than their summary")
    return rows
