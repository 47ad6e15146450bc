"""Retention, lag, backlog and coverage reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.windows import exact_percentiles
from tidemark.plans.registry import frame, query, sql

sql(
    "op_retention_candidates",
    """
    SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00' AND o_orderstatus = 'F'
    AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""",
)
sql(
    "op_rollup_before_delete",
    """
    WITH rolled AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE event_type = 'signup' AND value > 60),
         complete AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-30 00:00:00' GROUP BY CAST(ts AS DATE))
    SELECT complete.day, n FROM complete WHERE NOT EXISTS (SELECT 1 FROM rolled WHERE rolled.day = complete.day)""",
)
sql(
    "op_archive_month_prefix",
    "SELECT concat('archive/', CAST(year(o_orderdate) AS STRING), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0')) AS prefix, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders GROUP BY concat('archive/', CAST(year(o_orderdate) AS STRING), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'))",
)
_LAGS = """
    WITH marks AS (SELECT event_id, user_id, ts, event_type, CASE WHEN event_type = 'purchase' THEN ts END AS done FROM events WHERE event_type IN ('error', 'purchase')),
         followed AS (SELECT event_type, ts, min(done) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN {strict} FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM marks)
    SELECT ts, next, {seconds} AS s FROM followed WHERE event_type = 'error'"""
_DUCK_LAGS = _LAGS.format(strict="INTERVAL 1 MICROSECOND", seconds="date_diff('microsecond', ts, next) / CAST(1000000 AS DOUBLE)")


@query(
    "op_lag_report",
    f"""SELECT count(*) AS events, count(next) AS followed, count(*) - count(next) AS waiting, count(CASE WHEN s > 86400 THEN 1 END) AS late,
    round(quantile_cont(s, 0.5), 4) AS p50, round(quantile_cont(s, 0.95), 4) AS p95, min(CASE WHEN next IS NULL THEN ts END) AS oldest FROM ({_DUCK_LAGS}) lags""",
)
def op_lag_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    lags = frame(spark, sf_dir, _LAGS.format(strict="INTERVAL '0.000001' SECOND", seconds="timestampdiff(MICROSECOND, ts, next) / 1000000.0D")).withColumn("all", F.lit(1))
    found = exact_percentiles(lags, ["all"], "s", {"p50": 0.5, "p95": 0.95})
    totals = lags.groupBy("all").agg(
        F.count("*").alias("events"), F.count("next").alias("followed"), (F.count("*") - F.count("next")).alias("waiting"), F.count_if(F.col("s") > 86400).alias("late"), F.min(F.when(F.col("next").isNull(), F.col("ts"))).alias("oldest")
    )
    return totals.join(found, "all", "left").select("events", "followed", "waiting", "late", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"), "oldest")


_AGE = """
    WITH jobs AS (SELECT o_orderpriority, {days} AS waited FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS started FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey)
    SELECT o_orderpriority, round({p}(CAST(greatest(0, waited) AS DOUBLE), 0.95), 4) AS p95 FROM jobs GROUP BY o_orderpriority"""
sql(
    "op_queue_age_p95",
    _AGE.format(days="datediff(started, o_orderdate)", p="percentile"),
    _AGE.format(days="date_diff('day', o_orderdate, started)", p="quantile_cont"),
)
sql(
    "op_backlog",
    """
    SELECT o_orderpriority, count(*) AS queued, count(CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '2001-01-01 00:00:00' THEN 1 END) AS overdue,
           CASE WHEN count(CASE WHEN o_orderstatus = 'F' THEN 1 END) = 0 THEN 'starved' WHEN count(CASE WHEN o_orderstatus = 'P' THEN 1 END) * 3 > count(*) THEN 'slow' ELSE 'moving' END AS reason
    FROM orders GROUP BY o_orderpriority""",
)
sql(
    "op_segment_gc",
    """
    SELECT p_type, count(*) AS parts, count(CASE WHEN l.k IS NULL THEN 1 END) AS unsold, count(CASE WHEN r.k IS NULL THEN 1 END) AS never_returned
    FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem) l ON l.k = p_partkey LEFT JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R') r ON r.k = p_partkey
    GROUP BY p_type""",
)
sql(
    "op_catchup_plan",
    """
    SELECT c_custkey FROM customer JOIN (SELECT o_custkey, bool_or(o_orderstatus = 'P') AS open FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey
    WHERE open AND NOT EXISTS (SELECT 1 FROM orders f WHERE f.o_custkey = c_custkey AND f.o_orderpriority = '1-URGENT')""",
)
sql(
    "op_derivatives",
    """
    WITH gone AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal < 0),
         counts AS (SELECT c_nationkey, count(*) AS n FROM gone GROUP BY c_nationkey
                    UNION ALL SELECT c_nationkey, count(*) FROM gone JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey
                    UNION ALL SELECT c_nationkey, count(*) FROM gone JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_nationkey)
    SELECT c_nationkey, CAST(sum(n) AS BIGINT) AS impact FROM counts GROUP BY c_nationkey""",
)
sql(
    "op_coverage_row",
    """
    SELECT c_nationkey, value, denominator, CASE WHEN denominator > 0 THEN round(value * 100 / CAST(denominator AS DOUBLE), 2) END AS pct,
           CASE WHEN denominator = 0 THEN 'na' WHEN value < denominator - 20 THEN 'gap' WHEN value = denominator THEN 'ok' ELSE 'info' END AS state
    FROM (SELECT c_nationkey, count(DISTINCT o_custkey) AS value, count(DISTINCT c_custkey) AS denominator FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_nationkey)""",
)
sql("op_daily_limit", "SELECT user_id, count(*) FILTER (WHERE event_type <> 'view') AS used, count(*) FILTER (WHERE event_type <> 'view') >= 5 AS over FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15' GROUP BY user_id")
