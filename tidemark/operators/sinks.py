"""Sinks: versioned tables with upserts, replaced time ranges, archives and backups.

Spark writes all files. A versioned table is a folder of complete versions; a version counts once Spark has marked it
as a success, and the newest such version is the table, so readers see the old rows until the new ones are all there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.registry import frame, query
from tidemark.session import shared_folder
from tidemark.sources.daily import checked, fingerprint, read_days, write_days


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a glob pattern meets, through the file system that Spark itself uses."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(str(x.getPath()) for x in found or [])


def removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class VersionedTable:
    """A table that is replaced whole; `keep` old versions stay for readers that have begun."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 1) -> None:
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def versions(self) -> list[int]:
        return [int(p.rsplit("/", 2)[-2].removeprefix("version=")) for p in listed(self.spark, f"{self.path}/version=*/_SUCCESS")]

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={max(self.versions()):08d}")

    def replace(self, rows: DataFrame) -> DataFrame:
        held = self.versions()
        rows.write.mode("overwrite").parquet(f"{self.path}/version={max(held, default=0) + 1:08d}")
        for old in held[: len(held) - self.keep]:
            removed(self.spark, f"{self.path}/version={old:08d}")
        return self.read()

    def insert_ignore(self, new: DataFrame, keys: list[str]) -> DataFrame:
        """Add the rows whose keys are not there yet, one a key."""
        return self.replace(self.read().unionByName(new.dropDuplicates(keys).join(self.read(), keys, "left_anti")))

    def update(self, new: DataFrame, keys: list[str]) -> DataFrame:
        """Each key's row from `new` if it has one, else the old one."""
        return self.replace(self.read().join(new, keys, "left_anti").unionByName(new.dropDuplicates(keys)))

    def newest_wins(self, new: DataFrame, keys: list[str], time: str) -> DataFrame:
        """Each key's row of the latest time; of equal times the one that is there."""
        rest = [c for c in new.columns if c not in keys]
        both = self.read().withColumn("_old", F.lit(1)).unionByName(new.withColumn("_old", F.lit(0)))
        best = both.groupBy(*keys).agg(F.max(F.struct(F.col(time).alias("_time"), "_old", *rest)).alias("v"))
        return self.replace(best.select(*keys, *[F.col(f"v.{c}").alias(c) for c in rest]))


def replace_range(rows: DataFrame, path: str, time: str, since: str, until: str) -> None:
    """Replace the rows of [since, until) in a table partitioned by day of `time`; other rows stay. Done again with the
    same rows, it leaves the same table. Only the days that the range touches are read or written."""
    spark = rows.sparkSession
    inside = (F.col(time) >= F.lit(since).cast("timestamp_ntz")) & (F.col(time) < F.lit(until).cast("timestamp_ntz"))
    day, new = F.col(time).cast("date").cast("string"), rows.filter(inside)
    first, last = since[:10], until[:10]
    if old := [p for p in listed(spark, f"{path}/day=*") if first <= p.rsplit("=", 1)[1] <= last]:
        kept = spark.read.schema(rows.schema).parquet(*old).filter(~inside)
        staged = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
        kept.unionByName(new).withColumn("day", day).write.partitionBy("day").parquet(staged)
        fresh = spark.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(staged)
    else:
        staged, fresh = None, new
    fresh.withColumn("day", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    if staged:
        written = {p.rsplit("=", 1)[1] for p in listed(spark, f"{staged}/day=*")}
        for p in old:
            if p.rsplit("=", 1)[1] not in written:  # a day that has no rows any more
                removed(spark, p)
        removed(spark, staged)


class ArchiveNotVerified(RuntimeError):
    pass


def archive(rows: DataFrame, path: str, time: str) -> DataFrame:
    """Write rows as gzipped JSON lines, apart by month, read them back and return month and n; raises if a month lacks
    rows, so that nothing is deleted on the strength of it."""
    month = F.date_format(F.col(time), "yyyy-MM")
    rows.select(month.alias("month"), F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").option("compression", "gzip").partitionBy("month").text(path)
    there = rows.sparkSession.read.text(path).groupBy("month").agg(F.count("*").alias("n"))
    meant = rows.groupBy(month.alias("month")).agg(F.count("*").alias("meant"))
    wrong = meant.join(there, "month", "left").filter(~F.col("meant").eqNullSafe(F.col("n")))
    if not wrong.isEmpty():
        raise ArchiveNotVerified(path)
    return there


class BackupTooLarge(RuntimeError):
    pass


def backup(tables: dict[str, DataFrame], path: str, most_bytes: int) -> DataFrame:
    """Write each table as gzipped JSON lines with a manifest (table, n, bytes) and SHA256SUMS; raises before it writes
    anything when the lines have more than `most_bytes`."""
    spark = next(iter(tables.values())).sparkSession
    lines = {name: rows.select(F.to_json(F.struct(*rows.columns)).alias("value")) for name, rows in tables.items()}
    manifest = None
    for name, text in lines.items():
        one = text.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("bytes")).select(F.lit(name).alias("table"), "n", "bytes")
        manifest = one if manifest is None else manifest.unionByName(one)
    if manifest.agg(F.sum("bytes")).first()[0] > most_bytes:
        raise BackupTooLarge(path)
    for name, text in lines.items():
        text.write.mode("overwrite").option("compression", "gzip").text(f"{path}/{name}")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    files = spark.read.format("binaryFile").load([f"{path}/{name}/part-*" for name in tables])
    sums = files.select(F.concat(F.sha2("content", 256), F.lit("  "), F.concat_ws("/", F.slice(F.split("path", "/"), -2, 2))).alias("value"))
    sums.write.mode("overwrite").text(f"{path}/SHA256SUMS")
    return spark.read.schema("table string, n bigint, bytes bigint").json(f"{path}/manifest")


def stored(rows: DataFrame, name: str) -> DataFrame:
    """rows, written to the shared folder once and read from there."""
    path = _new_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _table(spark: SparkSession, name: str, rows: DataFrame) -> VersionedTable:
    made = VersionedTable(spark, _new_path(spark, name))
    made.replace(rows)
    return made


@query("snk_upsert_ignore", "SELECT c_custkey AS k, 'old' AS src FROM customer UNION ALL SELECT DISTINCT user_id, 'new' FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)")
def snk_upsert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, "ignore", frame(spark, sf_dir, "SELECT c_custkey AS k, 'old' AS src FROM customer"))
    return table.insert_ignore(frame(spark, sf_dir, "SELECT user_id AS k, 'new' AS src FROM events"), ["k"])


@query(
    "snk_upsert_update",
    "SELECT k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY gen DESC) AS n FROM (SELECT c_custkey AS k, c_acctbal AS v, 1 AS gen FROM customer UNION ALL SELECT o_custkey, max(o_totalprice), 2 FROM orders GROUP BY o_custkey) u) t WHERE n = 1",
)
def snk_upsert_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, "update", frame(spark, sf_dir, "SELECT c_custkey AS k, c_acctbal AS v FROM customer"))
    return table.update(frame(spark, sf_dir, "SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders GROUP BY o_custkey"), ["k"])


_LATEST = "SELECT o_custkey AS k, max_by(o_totalprice, struct(o_orderdate, o_orderkey)) AS v, max(o_orderdate) AS t FROM orders WHERE o_orderstatus {} GROUP BY o_custkey"


@query(
    "snk_upsert_newest_wins",
    """WITH o AS (SELECT o_custkey AS k, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS v, max(o_orderdate) AS t FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey),
    n AS (SELECT o_custkey AS k, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS v, max(o_orderdate) AS t FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey)
    SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.t IS NULL OR n.t > o.t THEN n.v ELSE o.v END AS v, CASE WHEN o.t IS NULL OR n.t > o.t THEN n.t ELSE o.t END AS t FROM o FULL JOIN n ON o.k = n.k""",
)
def snk_upsert_newest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, "newest", frame(spark, sf_dir, _LATEST.format("= 'F'")))
    return table.newest_wins(frame(spark, sf_dir, _LATEST.format("<> 'F'")), ["k"], "t")


@query(
    "snk_delete_insert_range",
    """SELECT date_trunc('hour', ts) AS hour, event_type, CASE WHEN date_trunc('hour', ts) >= TIMESTAMP '2024-01-05 07:00:00' AND date_trunc('hour', ts) < TIMESTAMP '2024-01-09 20:00:00' THEN 2 ELSE 1 END * count(*) AS n
    FROM events WHERE NOT (date_trunc('hour', ts) >= TIMESTAMP '2024-01-07 00:00:00' AND date_trunc('hour', ts) < TIMESTAMP '2024-01-08 00:00:00') GROUP BY 1, 2""",
)
def snk_delete_insert_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hours are rolled once; four days of them twice more, with other counts and one day without any rows."""
    path = _new_path(spark, "hours")
    hours = frame(spark, sf_dir, "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
    hours = hours.withColumn("hour", F.col("hour").cast("timestamp_ntz"))
    replace_range(hours, path, "hour", "2000-01-01 00:00:00", "2100-01-01 00:00:00")
    again = hours.filter("CAST(hour AS DATE) <> DATE '2024-01-07'").withColumn("n", 2 * F.col("n"))
    for _ in range(2):
        replace_range(again, path, "hour", "2024-01-05 07:00:00", "2024-01-09 20:00:00")
    return spark.read.schema(hours.schema).option("recursiveFileLookup", "true").parquet(path)


@query("snk_archive_jsonl_gz", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01 00:00:00' GROUP BY 1")
def snk_archive_jsonl_gz(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _new_path(spark, "archive")
    rows = frame(spark, sf_dir, "SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01 00:00:00'")
    archive(rows, path, "o_orderdate")
    back = spark.read.text(path).select("month", F.from_json("value", rows.schema).alias("row"))
    return back.groupBy("month").agg(F.count("*").alias("n"), F.sum("row.o_orderkey").alias("keys"))


@query(
    "snk_tenant_backup",
    """SELECT 'customer' AS "table", count(*) AS n, CAST(coalesce(sum(c_custkey), 0) AS BIGINT) AS keys FROM customer WHERE c_nationkey = 3
    UNION ALL SELECT 'orders', count(*), CAST(coalesce(sum(o_orderkey), 0) AS BIGINT) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)""",
)
def snk_tenant_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _new_path(spark, "backup")
    tables = {"customer": frame(spark, sf_dir, "SELECT * FROM customer WHERE c_nationkey = 3"), "orders": frame(spark, sf_dir, "SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")}
    manifest = backup(tables, path, 1 << 40)
    keys: list[DataFrame] = []
    for name, key in (("customer", "c_custkey"), ("orders", "o_orderkey")):
        total: Column = F.coalesce(F.sum(F.get_json_object("value", f"$.{key}").cast("bigint")), F.lit(0))
        keys.append(spark.read.text(f"{path}/{name}").agg(total.alias("keys")).withColumn("table", F.lit(name)))
    return manifest.select("table", "n").join(keys[0].unionByName(keys[1]), "table")


@query(
    "src_ndjson_daily",
    """SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS cost FROM events
    WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-19 12:00:00' GROUP BY 1, 2""",
)
def src_ndjson_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as daily files, two weeks of them read back, held against the fingerprint of the rows and cut to a range."""
    path = _new_path(spark, "daily")
    events = frame(spark, sf_dir, "SELECT event_id, ts, user_id, event_type, value FROM events")
    write_days(events, path, "ts")
    days = events.filter("CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-19'")
    back = checked(read_days(spark, path, events.schema, "2024-01-05", "2024-01-19"), fingerprint(days))
    cut = back.filter("ts >= TIMESTAMP_NTZ '2024-01-05 06:00:00' AND ts < TIMESTAMP_NTZ '2024-01-19 12:00:00'")
    return cut.groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("cost"))


@query("snk_versioned_swap", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders)")
def snk_versioned_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build of the year before is there when the newest year's is written and takes its place."""
    text = "SELECT o_orderkey FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders) - {}"
    table = _table(spark, "graph", frame(spark, sf_dir, text.format(1)))
    return table.replace(frame(spark, sf_dir, text.format(0)))
