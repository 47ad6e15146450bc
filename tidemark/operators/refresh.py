"""Paid results kept up to date: only rows whose content changed are computed again.

The results lie in buckets of their keys, each row with the hash of the content (and of the rule's version) that it was
made from. A refresh hashes the rows as they are now, joins them with the stored hashes, computes what is new or changed,
and writes anew only the buckets that lose or gain a row. The buckets are staged and then replaced, so a refresh that is
broken off leaves the old ones, and done again it finds what is still to do.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.sinks import listed, removed, stored
from tidemark.plans.registry import query
from tidemark.session import shared_folder
from tidemark.sources.tables import read_table

BUCKETS = 64


def content_hash(content: Column, rule: str) -> Column:
    """A new version of the rule, or another content, gives another hash; null content is empty."""
    return F.sha2(F.concat(F.lit(f"{rule}\n"), F.coalesce(content, F.lit(""))), 256)


class Refreshed:
    """Results in a folder: key, hash, and the columns that `compute` makes (key first)."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, rule: str, buckets: int = BUCKETS) -> None:
        """schema: of what compute() returns; its first column is the key, of the type of the rows' key."""
        self.spark, self.path, self.rule, self.buckets = spark, path.rstrip("/"), rule, buckets
        self.key, self.schema = schema.names[0], schema
        self.stored = T.StructType([*schema.fields, T.StructField("hash", T.StringType()), T.StructField("bucket", T.IntegerType())])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame:
        """All results with their hash and bucket."""
        if not listed(self.spark, f"{self.path}/bucket=*"):
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(self.stored).parquet(self.path)

    def refresh(self, rows: DataFrame, content: str, compute: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
        """Bring the results to the rows (key, content, one a key); compute() gets the rows that changed and returns a row for
        each. Returns how many rows were computed and removed, and how many buckets written."""
        now = rows.withColumn("hash", content_hash(F.col(content), self.rule))
        held = self.read().select(self.key, "hash")
        changed = stored(now.join(held, [self.key, "hash"], "left_anti"), "changed")
        gone = stored(held.join(now.select(self.key), self.key, "left_anti").select(self.key), "gone")
        touched = stored(changed.select(self.key).unionByName(gone).withColumn("bucket", self._bucket()), "touched")
        buckets = sorted(r["bucket"] for r in touched.select("bucket").distinct().collect())  # at most `buckets`
        counts = {"computed": changed.count(), "removed": gone.count(), "buckets": len(buckets)}
        if not buckets:
            return counts
        made = compute(changed.drop("hash")).select(*self.schema.names).join(changed.select(self.key, "hash"), self.key).withColumn("bucket", self._bucket())
        kept = self.read().filter(F.col("bucket").isin(buckets)).join(touched.select(self.key), self.key, "left_anti")
        staged = f"{shared_folder(self.spark)}/refresh-{uuid.uuid4().hex}"
        kept.select(*self.stored.names).unionByName(made.select(*self.stored.names)).repartition("bucket").write.partitionBy("bucket").parquet(staged)
        fresh = self.spark.read.schema(self.stored).parquet(staged)
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        full = {p.rsplit("=", 1)[1] for p in listed(self.spark, f"{staged}/bucket=*")}
        for bucket in buckets:
            if str(bucket) not in full:  # no row is left in it
                removed(self.spark, f"{self.path}/bucket={bucket}")
        removed(self.spark, staged)
        return counts


_COUNTED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("words", T.LongType()), T.StructField("run", T.IntegerType())])


@query(
    "txt_days_hash",
    r"""SELECT doc_id, sha256(concat('words-1', chr(10), t)) AS hash, len(regexp_extract_all(t, '[^ \t\n\r]+')) AS words, CASE WHEN t = text THEN 1 ELSE 2 END AS run
    FROM (SELECT doc_id, text, CASE WHEN lang = 'de' THEN concat(text, ' neu') ELSE text END AS t, lang FROM documents) WHERE lang <> 'es'""",
)
def txt_days_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words counted for every document, then refreshed after the German texts have changed and the Spanish ones gone: only
    the former are counted again (run 2)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    table = Refreshed(spark, f"{shared_folder(spark)}/results-{uuid.uuid4().hex}", _COUNTED, "words-1")

    def counted(run: int) -> Callable[[DataFrame], DataFrame]:
        words = F.size(F.regexp_extract_all("text", F.lit("[^ \t\n\r]+"), F.lit(0))).cast("bigint")
        return lambda rows: rows.select("doc_id", words.alias("words"), F.lit(run).alias("run"))

    table.refresh(docs.select("doc_id", "text"), "text", counted(1))
    later = docs.filter("lang <> 'es'").select("doc_id", F.when(F.col("lang") == "de", F.concat("text", F.lit(" neu"))).otherwise(F.col("text")).alias("text"))
    table.refresh(later, "text", counted(2))
    return table.read().select("doc_id", "hash", "words", "run")
