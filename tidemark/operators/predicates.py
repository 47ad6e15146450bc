"""Filters and projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.registry import query, sql
from tidemark.sources.tables import read_table


def all_of(df: DataFrame, filters: dict[str, Column | None]) -> DataFrame:
    """df where every given filter holds; None leaves one out."""
    given = [f for f in filters.values() if f is not None]
    return df.filter(reduce(lambda a, b: a & b, given, F.lit(True)))


def keyset_page(df: DataFrame, keys: list[str], after: list, size: int) -> DataFrame:
    """The `size` rows after the given key, in key order."""
    beyond, equal = F.lit(False), F.lit(True)
    for name, value in zip(keys, after, strict=True):
        beyond = beyond | (equal & (F.col(name) > F.lit(value)))
        equal = equal & (F.col(name) == F.lit(value))
    return df.filter(beyond).orderBy(*keys).limit(size)


sql("flt_half_open_time", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-08 00:00:00' AND ts < TIMESTAMP '2024-01-15 00:00:00'")
sql(
    "flt_not_distinct",
    """
    SELECT o_orderkey FROM (SELECT o_orderkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) t
    WHERE before IS DISTINCT FROM o_orderstatus""",
)
sql("flt_like_escape", "SELECT doc_id, lower(text) LIKE '%!%!%!% d_!%!%!%%' ESCAPE '!' AS between_signs FROM documents WHERE text LIKE '%!%!%!%%' ESCAPE '!' OR text LIKE '%!_%' ESCAPE '!'")
sql("flt_prefix_search", "SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#1%' OR contains(p_name, 'ring')")
sql(
    "flt_regex_guarded_cast",
    "SELECT p_partkey, CASE WHEN regexp_like(substr(p_brand, 7), '^[0-9]+$') THEN try_cast(substr(p_brand, 7) AS INT) END AS brand_no FROM part",
    "SELECT p_partkey, CASE WHEN regexp_matches(substr(p_brand, 7), '^[0-9]+$') THEN try_cast(substr(p_brand, 7) AS INT) END AS brand_no FROM part",
)


@query("flt_dynamic_where", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 AND o_orderdate < TIMESTAMP '2000-01-01 00:00:00'")
def flt_dynamic_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {
        "status": F.col("o_orderstatus") == "F",
        "customer": None,
        "least": F.col("o_totalprice") >= 100000,
        "before": F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"),
    }
    return all_of(read_table(spark, sf_dir, "orders"), wanted).select("o_orderkey")


sql(
    "flt_json_contains",
    "SELECT event_id FROM events WHERE get_json_object(props, '$.k') = '7'",
    "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'",
)
sql(
    "flt_json_numeric_guard",
    "SELECT event_id FROM events WHERE try_cast(get_json_object(props, '$.k') AS BIGINT) > 50",
    "SELECT event_id FROM events WHERE try_cast(json_extract_string(props, '$.k') AS BIGINT) > 50",
)
sql(
    "prj_coalesce_chain",
    "SELECT event_id, coalesce(CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) END, try_cast(get_json_object(props, '$.k') AS BIGINT), 0) AS amount FROM events",
    "SELECT event_id, coalesce(CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) END, try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS amount FROM events",
)
sql(
    "prj_dimension_case",
    """
    SELECT event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'new' ELSE 'ok' END AS status,
           CASE WHEN user_id % 2 = 0 THEN 'app' ELSE 'web' END AS traffic, CASE WHEN value >= 30 THEN 'premium' WHEN value >= 10 THEN 'standard' ELSE 'basic' END AS tier FROM events""",
)
sql(
    "prj_product_case",
    """
    SELECT p_partkey, CASE WHEN p_name = 'red widget' THEN 'flagship' WHEN p_name LIKE 'red%' THEN 'red line' WHEN p_name LIKE 'blue%' THEN 'blue line' ELSE 'other' END AS product FROM part""",
)


@query("flt_keyset_page", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey > 700 OR (o_custkey = 700 AND o_orderkey > 100) ORDER BY o_custkey, o_orderkey LIMIT 500")
def flt_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyset_page(read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], [700, 100], 500)


sql(
    "flt_interval_overlap",
    """
    WITH spans AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events WHERE event_type = 'signup' GROUP BY user_id)
    SELECT user_id FROM spans WHERE a < TIMESTAMP '2024-01-05 00:00:00' AND b > TIMESTAMP '2024-01-02 00:00:00'""",
)
sql("flt_live_view", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' AND c_acctbal >= 0 AND o_orderpriority <> '5-LOW'")
sql(
    "flt_validity_window",
    """
    SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS valid_until FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey
    WHERE (c_nationkey IN (1, 2, 3) OR c_mktsegment = 'BUILDING') AND (valid_until IS NULL OR valid_until >= TIMESTAMP '2001-01-01 00:00:00')""",
)
sql(
    "prj_review_status",
    """
    SELECT o_orderkey, CASE WHEN before IS NULL THEN NULL WHEN before IS DISTINCT FROM o_orderstatus THEN 'needs_review' WHEN o_orderstatus = 'F' THEN 'confirmed' ELSE 'parsed' END AS review
    FROM (SELECT o_orderkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) t""",
)
