"""Joins: equi, semi, anti, full, as-of, lateral, fall-back chains, ranges and self pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.registry import query, sql
from tidemark.sources.tables import read_table


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, which must break ties."""
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.filter("_n = 1").drop("_n")


def asof_join(left: DataFrame, right: DataFrame, by: str, on: str, value: str, forward: bool = True, strict: bool = False, bucket: Column | None = None) -> DataFrame:
    """left with the value of right's nearest row of the same `by`, at or after (before) `on`; strict leaves equals out.

    One shuffle by key: both sides are laid on one time line and the value is carried along it, so no pairs are made.
    `bucket`, a column that rises with `on`, cuts the time line of a key that holds too many rows for one task: each piece
    is looked through alone, and rows that find nothing take the nearest value of the pieces beyond.
    """
    line = left.withColumn("_value", F.lit(None).cast(right.schema[value].dataType)).withColumn("_left", F.lit(True))
    marks = right.select(F.col(by), F.col(on), F.col(value).alias("_value")).withColumn("_left", F.lit(False))
    both = line.unionByName(marks, allowMissingColumns=True)
    keys = [by]
    if bucket is not None:
        both, keys = both.withColumn("_bucket", bucket), [by, "_bucket"]
    # of equal times, the side that the other may not see comes so that it is not yet, or no longer, in the frame
    mark_first = (not forward) != strict
    order = [F.col(on).asc(), F.col("_left").asc() if mark_first else F.col("_left").desc()]
    key = Window.partitionBy(*keys).orderBy(*order)
    frame = key.rowsBetween(0, Window.unboundedFollowing) if forward else key.rowsBetween(Window.unboundedPreceding, 0)
    pick = F.first("_value", ignorenulls=True) if forward else F.last("_value", ignorenulls=True)
    found = both.withColumn(f"{value}_asof", pick.over(frame)).filter("_left").drop("_left", "_value")
    if bucket is None:
        return found
    nearest = (F.min_by if forward else F.max_by)("_value", F.when(F.col("_value").isNotNull(), F.col(on)))
    edges = both.groupBy(*keys).agg(nearest.alias("_edge"))  # a row for each piece
    pieces = Window.partitionBy(by).orderBy("_bucket")
    beyond = F.first("_edge", ignorenulls=True).over(pieces.rowsBetween(1, Window.unboundedFollowing)) if forward else F.last("_edge", ignorenulls=True).over(pieces.rowsBetween(Window.unboundedPreceding, -1))
    carried = edges.select(F.col(by).alias("_by"), F.col("_bucket").alias("_at"), beyond.alias("_beyond"))
    joined = found.join(carried, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_bucket") == F.col("_at")), "left")
    return joined.withColumn(f"{value}_asof", F.coalesce(f"{value}_asof", "_beyond")).drop("_bucket", "_by", "_at", "_beyond")


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of the two that are missing on one side or differ, nulls equal to nulls."""
    a = left.select(*keys, F.struct(*columns).alias("a"))
    b = right.select(*keys, F.struct(*columns).alias("b"))
    return a.join(b, keys, "full").filter(~F.col("a").eqNullSafe(F.col("b")))


sql("jn_inner_equi", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")

sql(
    "jn_left_chain",
    """
    SELECT c_custkey,
           o.k IS NOT NULL AS has_order, u.k IS NOT NULL AS has_urgent, r.k IS NOT NULL AS has_return, e.k IS NOT NULL AS has_event,
           o.k IS NULL AND u.k IS NULL AND r.k IS NULL AND e.k IS NULL AS orphan
    FROM customer
    LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON c_custkey = o.k
    LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT') u ON c_custkey = u.k
    LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R') r ON c_custkey = r.k
    LEFT JOIN (SELECT DISTINCT user_id AS k FROM events) e ON c_custkey = e.k""",
)

sql(
    "jn_left_agg",
    """
    SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(total, 0.0) AS total
    FROM customer LEFT JOIN (
        SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY o_custkey
    ) o ON c_custkey = o_custkey""",
)

sql(
    "jn_semi_exists",
    """
    SELECT c_custkey, c_name FROM customer
    WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 400000)""",
)

sql(
    "jn_anti_not_exists",
    """
    SELECT p_partkey, p_name FROM part
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '2001-01-01 00:00:00')""",
)

sql(
    "jn_anti_correlated_set",
    """
    SELECT DISTINCT l_orderkey FROM lineitem dead
    WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM lineitem live WHERE live.l_orderkey = dead.l_orderkey AND live.l_returnflag = 'A')""",
)

sql(
    "jn_anti_disjunctive",
    """
    WITH runs AS (SELECT max(ts) AS last_sweep FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-20 00:00:00'),
         per_user AS (SELECT user_id, max(ts) AS last_own FROM events WHERE event_type = 'purchase' AND value > 30 GROUP BY user_id)
    SELECT e.event_id FROM events e CROSS JOIN runs LEFT JOIN per_user p ON e.user_id = p.user_id
    WHERE e.event_type = 'error' AND NOT (coalesce(p.last_own > e.ts, false) OR last_sweep > e.ts)""",
)

sql(
    "jn_anti_or_keys",
    """
    WITH facts AS (
        SELECT event_id, CASE WHEN event_type = 'error' THEN concat('u', CAST(user_id AS STRING)) ELSE concat('d', CAST(CAST(ts AS DATE) AS STRING)) END AS k
        FROM events WHERE event_type IN ('error', 'signup')
    ), notices AS (
        SELECT DISTINCT concat('u', CAST(user_id AS STRING)) AS k FROM events WHERE event_type = 'purchase' AND value > 60
        UNION SELECT DISTINCT concat('d', CAST(CAST(ts AS DATE) AS STRING)) FROM events WHERE event_type = 'purchase' AND value > 90
    )
    SELECT event_id FROM facts WHERE NOT EXISTS (SELECT 1 FROM notices n WHERE n.k = facts.k)""",
)


@query(
    "jn_full_reconcile",
    """
    WITH a AS (SELECT o_custkey AS custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
         b AS (SELECT o_custkey AS custkey, count(*) AS n FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1)
    SELECT coalesce(a.custkey, b.custkey) AS custkey, a.n AS n_kept, b.n AS n_resolved
    FROM a FULL JOIN b ON a.custkey = b.custkey WHERE a.n IS DISTINCT FROM b.n""",
)
def jn_full_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").withColumn("custkey", F.col("o_custkey"))
    kept = orders.filter("o_orderstatus <> 'P'").groupBy("custkey").agg(F.count("*").alias("n"))
    resolved = orders.filter("o_orderpriority <> '5-LOW'").groupBy("custkey").agg(F.count("*").alias("n"))
    return reconcile(kept, resolved, ["custkey"], ["n"]).select("custkey", F.col("a.n").alias("n_kept"), F.col("b.n").alias("n_resolved"))


#: A user's events are looked through week by week.
_WEEK = "date_trunc('week', ts)"


@query(
    "jn_asof_next",
    """
    SELECT e.event_id, (SELECT min(p.ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts > e.ts) AS done_asof
    FROM events e WHERE e.event_type = 'click'""",
)
def jn_asof_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    clicks = events.filter("event_type = 'click'").drop("event_type")
    done = events.filter("event_type = 'purchase'").select("user_id", "ts", F.col("ts").alias("done"))
    return asof_join(clicks, done, "user_id", "ts", "done", strict=True, bucket=F.expr(_WEEK)).select("event_id", "done_asof")


@query(
    "jn_asof_attribute",
    """
    SELECT e.event_id, (SELECT arg_min(p.event_id, (p.ts, p.event_id)) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'signup' AND p.ts >= e.ts) AS result_asof
    FROM events e WHERE e.event_type = 'error'""",
)
def jn_asof_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    calls = events.filter("event_type = 'error'").drop("event_type")
    results = events.filter("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("result"))
    return asof_join(calls, results, "user_id", "ts", "result", bucket=F.expr(_WEEK)).select("event_id", "result_asof")


@query(
    "gr_anchor_prev_stop",
    """
    SELECT e.event_id, (SELECT max(p.ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'signup' AND p.ts <= e.ts) AS stop_asof
    FROM events e WHERE e.event_type = 'view'""",
)
def gr_anchor_prev_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    views = events.filter("event_type = 'view'").drop("event_type")
    stops = events.filter("event_type = 'signup'").select("user_id", "ts", F.col("ts").alias("stop"))
    return asof_join(views, stops, "user_id", "ts", "stop", forward=False, bucket=F.expr(_WEEK)).select("event_id", "stop_asof")


@query(
    "jn_lateral_top1",
    """
    SELECT c_custkey, o_orderkey, o_totalprice FROM (
        SELECT o_custkey, o_orderkey, o_totalprice,
               row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_totalprice DESC, o_orderkey) AS n FROM orders
    ) t JOIN customer ON c_custkey = o_custkey WHERE n = 1""",
)
def jn_lateral_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    best = latest_per_key(orders, ["o_custkey"], [(F.col("o_orderstatus") == "F").desc(), F.desc("o_totalprice"), F.asc("o_orderkey")])
    customer = read_table(spark, sf_dir, "customer").select("c_custkey")
    return best.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")


sql(
    "jn_fallback_chain",
    """
    WITH own AS (SELECT o_custkey AS k, max(o_orderkey) AS cover FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey),
         any_own AS (SELECT o_custkey AS k, max(o_orderkey) AS cover FROM orders GROUP BY o_custkey),
         nation_best AS (SELECT c_nationkey AS k, max(o_orderkey) AS cover FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey),
         region_best AS (SELECT n_regionkey AS k, max(o_orderkey) AS cover FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey)
    SELECT c_custkey, coalesce(own.cover, any_own.cover, nation_best.cover, region_best.cover) AS cover,
           CASE WHEN own.cover IS NOT NULL THEN 1 WHEN any_own.cover IS NOT NULL THEN 2 WHEN nation_best.cover IS NOT NULL THEN 3
                WHEN region_best.cover IS NOT NULL THEN 4 ELSE 5 END AS level
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN own ON own.k = c_custkey LEFT JOIN any_own ON any_own.k = c_custkey
    LEFT JOIN nation_best ON nation_best.k = c_nationkey LEFT JOIN region_best ON region_best.k = n_regionkey""",
)

sql(
    "jn_self_pairs",
    "SELECT a.l_orderkey, a.l_partkey AS part_a, b.l_partkey AS part_b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey",
)

sql(
    "jn_cross_lateral_json",
    "SELECT event_id, k FROM (SELECT event_id, explode(from_json(concat('[', get_json_object(props, '$.k'), ',', user_id, ']'), 'array<bigint>')) AS k FROM events)",
    "SELECT event_id, unnest([CAST(json_extract_string(props, '$.k') AS BIGINT), user_id]) AS k FROM events",
)

sql(
    "jn_unnest_ordinality",
    "SELECT p_partkey, CAST(pos + 1 AS BIGINT) AS place, word FROM (SELECT p_partkey, posexplode(split(p_name, ' ')) AS (pos, word) FROM part)",
    "SELECT p_partkey, CAST(generate_subscripts(string_split(p_name, ' '), 1) AS BIGINT) AS place, unnest(string_split(p_name, ' ')) AS word FROM part",
)

sql(
    "jn_calendar_left",
    """
    WITH days AS (SELECT explode(sequence(DATE '2023-12-25', DATE '2024-02-05')) AS day)
    SELECT day, coalesce(n, 0) AS n, coalesce(spend, 0.0) AS spend FROM days LEFT JOIN (
        SELECT CAST(ts AS DATE) AS d, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS spend FROM events GROUP BY CAST(ts AS DATE)
    ) e ON day = d""",
    """
    WITH days AS (SELECT CAST(unnest(generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS day)
    SELECT day, coalesce(n, 0) AS n, coalesce(spend, 0.0) AS spend FROM days LEFT JOIN (
        SELECT CAST(ts AS DATE) AS d, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS spend FROM events GROUP BY CAST(ts AS DATE)
    ) e ON day = d""",
)

sql(
    "jn_next_newer_exists",
    """
    SELECT event_id FROM (SELECT event_id, ts, max(ts) OVER (PARTITION BY user_id, event_type) AS newest FROM events) t WHERE ts < newest""",
    "SELECT event_id FROM events a WHERE EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = a.event_type AND b.ts > a.ts)",
)

sql(
    "jn_scalar_subquery",
    """
    SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders,
           (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS largest, (SELECT count(*) FROM nation) AS n_nations
    FROM customer""",
)

sql(
    "jn_min_stale_compare",
    """
    SELECT p_partkey, landed IS NULL OR landed < researched AS stale
    FROM part LEFT JOIN (SELECT l_partkey, max(l_shipdate) AS landed FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_partkey) l ON l.l_partkey = p_partkey
    LEFT JOIN (SELECT l_partkey, max(l_shipdate) AS researched FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_partkey) r ON r.l_partkey = p_partkey""",
)

sql(
    "jn_narrowing_match",
    """
    WITH s AS (SELECT s_nationkey, count(*) AS n, min(s_suppkey) AS only FROM supplier GROUP BY s_nationkey),
         b AS (SELECT s_nationkey, s_suppkey, s_acctbal, explode(sequence(CAST(floor(s_acctbal / 500) AS INT) - 1, CAST(floor(s_acctbal / 500) AS INT) + 1)) AS bucket FROM supplier),
         near AS (SELECT c_custkey AS k, count(*) AS n, max(s_suppkey) AS one FROM customer JOIN b ON s_nationkey = c_nationkey AND bucket = CAST(floor(c_acctbal / 500) AS INT) AND abs(c_acctbal - s_acctbal) < 500 GROUP BY c_custkey)
    SELECT c_custkey, CASE WHEN s.n = 1 THEN only WHEN near.n = 1 THEN one END AS matched, CASE WHEN s.n = 1 THEN 'unique' WHEN near.n = 1 THEN 'narrowed' ELSE 'ambiguous' END AS how
    FROM customer JOIN s ON s_nationkey = c_nationkey LEFT JOIN near ON k = c_custkey""",
    """
    WITH cand AS (
        SELECT c_custkey, s_suppkey, abs(c_acctbal - s_acctbal) < 500 AS by_balance FROM customer JOIN supplier ON c_nationkey = s_nationkey
    ), counted AS (
        SELECT *, count(*) OVER (PARTITION BY c_custkey) AS n, count(CASE WHEN by_balance THEN 1 END) OVER (PARTITION BY c_custkey) AS n_balance FROM cand
    )
    SELECT c_custkey,
           max(CASE WHEN n = 1 THEN s_suppkey WHEN n_balance = 1 AND by_balance THEN s_suppkey END) AS matched,
           max(CASE WHEN n = 1 THEN 'unique' WHEN n_balance = 1 THEN 'narrowed' ELSE 'ambiguous' END) AS how
    FROM counted GROUP BY c_custkey""",
)

sql(
    "jn_stray_keys",
    """
    SELECT 'customer' AS side, c_nationkey AS k FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal > 9500) c
    WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > 5000)
    UNION ALL
    SELECT 'supplier' AS side, s_nationkey AS k FROM (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 5000) s
    WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal > 9500)""",
)
