"""Roll-ups, conditional counts, exact percentiles, histograms and report statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.windows import exact_percentiles
from tidemark.plans.registry import query, sql
from tidemark.sources.tables import read_table

#: Bounds of the value histogram: bin i holds values from bound i (bin 0: below the first) up to the next.
BOUNDS = (1, 2, 3, 5, 7, 10, 13, 16, 20, 25, 30, 35, 40, 45, 50, 60, 70, 80, 90)
_BOUND_LIST = ", ".join(map(str, BOUNDS))


def bin_of(value: Column, bounds: tuple = BOUNDS) -> Column:
    """How many of the ascending bounds the value reaches: its bin, for bounds at any distances."""
    return sum((F.when(value >= b, 1).otherwise(0) for b in bounds), F.lit(0))


def histogram(value: Column, bounds: tuple = BOUNDS) -> Column:
    """An aggregate: counts per bin as one array."""
    b = bin_of(value, bounds)
    return F.array(*[F.count_if(b == i) for i in range(len(bounds) + 1)])


def histogram_percentile(hist: DataFrame, keys: list[str], share: float, bounds: tuple = BOUNDS) -> DataFrame:
    """keys, p: the percentile of histogram column `hist`, linear within a bin; the open last bin gives its lower bound."""
    edges = F.array(*[F.lit(float(x)) for x in (0, *bounds, bounds[-1])])
    total = F.aggregate("hist", F.lit(0).cast("bigint"), lambda s, x: s + x)
    state = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("double").alias("p"), F.lit(0).alias("i"))

    def step(s: Column, n: Column) -> Column:
        rank, lo, hi = share * total, F.get(edges, s["i"]), F.get(edges, s["i"] + 1)
        here = s["p"].isNull() & (n > 0) & (s["seen"] + n >= rank)
        value = lo + (hi - lo) * (rank - s["seen"]) / n
        return F.struct((s["seen"] + n).alias("seen"), F.when(here, value).otherwise(s["p"]).alias("p"), (s["i"] + 1).alias("i"))

    return hist.select(*keys, F.aggregate("hist", state, step)["p"].alias("p"))


def merge_histograms(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


_DUCK_BIN = " + ".join(f"CAST(value >= {b} AS INT)" for b in BOUNDS)
_DUCK_HIST = "list_value(" + ", ".join(f"count(*) FILTER (WHERE bin = {i})" for i in range(len(BOUNDS) + 1)) + ")"
_LEDGER = "SELECT *, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a paid-call ledger: source = event_type, tenant = user, cost = value, tokens = props.k."""
    return read_table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def money(value: Column) -> Column:
    return F.sum(value.cast("decimal(18,2)")).cast("double")


def hour(ts: str) -> Column:
    return F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz")


@query(
    "agg_hourly_union_rollup",
    f"""
    WITH ledger AS ({_LEDGER})
    SELECT date_trunc('hour', ts) AS hour, event_type AS source, status, count(*) AS calls, count(*) FILTER (WHERE value > 20) AS costly,
           CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS cost, CAST(sum(k) AS BIGINT) AS tokens, max(value) AS largest
    FROM ledger GROUP BY 1, 2, 3""",
)
def agg_hourly_union_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir)
    sources = [rows.filter(F.col("event_type") == t) for t in ("view", "click", "purchase")]
    union = sources[0].unionByName(sources[1]).unionByName(sources[2]).unionByName(rows.filter("event_type IN ('signup', 'error')"))
    return union.groupBy(hour("ts").alias("hour"), F.col("event_type").alias("source"), "status").agg(
        F.count("*").alias("calls"), F.count_if(F.col("value") > 20).alias("costly"), money(F.col("value")).alias("cost"),
        F.sum("k").alias("tokens"), F.max("value").alias("largest"),
    )


@query(
    "agg_hist_width_bucket",
    f"WITH binned AS (SELECT event_type, {_DUCK_BIN} AS bin FROM events) SELECT event_type, {_DUCK_HIST} AS hist FROM binned GROUP BY event_type",
)
def agg_hist_width_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").groupBy("event_type").agg(histogram(F.col("value")).alias("hist"))


_EDGES = "list_value(" + ", ".join(f"{float(x)}" for x in (0, *BOUNDS, BOUNDS[-1])) + ")"


@query(
    "agg_hist_percentile",
    f"""
    WITH binned AS (SELECT event_type, {_DUCK_BIN} AS bin FROM events),
         counts AS (SELECT event_type, bin, count(*) AS n FROM binned GROUP BY 1, 2),
         running AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY event_type) AS total FROM counts),
         hit AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY bin) AS r FROM running WHERE upto >= 0.95 * total)
    SELECT event_type, round({_EDGES}[bin + 1] + ({_EDGES}[bin + 2] - {_EDGES}[bin + 1]) * (0.95 * total - (upto - n)) / n, 6) AS p95 FROM hit WHERE r = 1""",
)
def agg_hist_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = read_table(spark, sf_dir, "events").groupBy("event_type").agg(histogram(F.col("value")).alias("hist"))
    return histogram_percentile(hist, ["event_type"], 0.95).select("event_type", F.round("p", 6).alias("p95"))


@query(
    "agg_hist_merge",
    f"WITH binned AS (SELECT {_DUCK_BIN} AS bin FROM events WHERE event_type IN ('view', 'click')) SELECT {_DUCK_HIST} AS hist FROM binned",
)
def agg_hist_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    one = {t: events.filter(F.col("event_type") == t).agg(histogram(F.col("value")).alias(t)) for t in ("view", "click")}
    return one["view"].crossJoin(one["click"]).select(merge_histograms(F.col("view"), F.col("click")).alias("hist"))  # one row each


@query(
    "agg_reconcile_totals",
    """
    SELECT event_type, count(*) AS n_raw, count(*) AS n_rolled, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS cost, true AS equal
    FROM events GROUP BY event_type""",
)
def agg_reconcile_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    exact = F.sum(F.col("value").cast("decimal(18,2)"))
    raw = events.groupBy("event_type").agg(F.count("*").alias("n_raw"), exact.alias("raw_cost"))
    rolled = events.groupBy("event_type", hour("ts").alias("hour")).agg(F.count("*").alias("n"), exact.alias("c"))
    rolled = rolled.groupBy("event_type").agg(F.sum("n").alias("n_rolled"), F.sum("c").alias("rolled_cost"))
    same = F.col("n_raw").eqNullSafe(F.col("n_rolled")) & F.col("raw_cost").eqNullSafe(F.col("rolled_cost"))
    return raw.join(rolled, "event_type", "full").select("event_type", "n_raw", "n_rolled", F.col("raw_cost").cast("double").alias("cost"), same.alias("equal"))


sql(
    "agg_daily_rollup",
    """
    SELECT CAST(ts AS DATE) AS day, event_type, user_id, count(*) AS calls, count(CASE WHEN value > 20 THEN 1 END) AS costly,
           CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS cost
    FROM events GROUP BY CAST(ts AS DATE), event_type, user_id""",
)
sql(
    "agg_monthly_usage",
    """
    SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS ok,
           count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS limited, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS failed
    FROM orders WHERE o_orderdate < TIMESTAMP '2001-08-01 00:00:00' GROUP BY year(o_orderdate), month(o_orderdate)""",
    """
    SELECT CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS ok,
           count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS limited, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS failed
    FROM orders WHERE o_orderdate < TIMESTAMP '2001-08-01 00:00:00' GROUP BY 1, 2""",
)
sql(
    "agg_filter_clause",
    """
    SELECT event_type, count(*) FILTER (WHERE value < 5) AS small, count(*) FILTER (WHERE value >= 5 AND value < 20) AS middle,
           count(*) FILTER (WHERE value >= 20) AS large FROM events GROUP BY event_type""",
)
@query("agg_percentile_cont", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def agg_percentile_cont(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_percentiles(read_table(spark, sf_dir, "events").select("event_type", "value"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    return found.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


sql("agg_count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY event_type")
sql(
    "agg_ordered_first",
    "SELECT user_id, min_by(event_id, struct(ts, event_id)) AS first_event, max_by(event_type, struct(ts, event_id)) AS last_type FROM events GROUP BY user_id",
    "SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id",
)
sql(
    "agg_array_distinct",
    "SELECT user_id, sort_array(collect_set(event_type)) AS types FROM events GROUP BY user_id",
    "SELECT user_id, list_sort(list(DISTINCT event_type)) AS types FROM events GROUP BY user_id",
)
sql("agg_bool_and", "SELECT o_custkey, bool_and(o_orderstatus <> 'P') AS none_pending, bool_or(o_totalprice > 400000) AS any_large FROM orders GROUP BY o_custkey")
sql(
    "agg_object",
    """
    WITH counts AS (
        SELECT c_nationkey AS k, 'customers' AS kind, count(*) AS n FROM customer GROUP BY c_nationkey
        UNION ALL SELECT s_nationkey, 'suppliers', count(*) FROM supplier GROUP BY s_nationkey
        UNION ALL SELECT c_nationkey, 'orders', count(*) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey
    )
    SELECT k, concat('{', array_join(sort_array(collect_list(concat('"', kind, '": ', n))), ', '), '}') AS impact FROM counts GROUP BY k""",
    """
    WITH counts AS (
        SELECT c_nationkey AS k, 'customers' AS kind, count(*) AS n FROM customer GROUP BY c_nationkey
        UNION ALL SELECT s_nationkey, 'suppliers', count(*) FROM supplier GROUP BY s_nationkey
        UNION ALL SELECT c_nationkey, 'orders', count(*) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey
    )
    SELECT k, concat('{', string_agg(concat('"', kind, '": ', n), ', ' ORDER BY kind), '}') AS impact FROM counts GROUP BY k""",
)
sql(
    "agg_unnest_group",
    "SELECT word, count(*) AS n FROM (SELECT explode(split(p_name, ' ')) AS word FROM part) GROUP BY word",
    "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word",
)
sql(
    "agg_overage",
    """
    SELECT user_id, used, greatest(used - 100, 0) * 2 AS overage, CASE WHEN quota > 0 THEN round(used * 100.0 / quota, 2) END AS pct
    FROM (SELECT user_id, count(*) AS used, CAST(user_id % 5 * 50 AS INT) AS quota FROM events GROUP BY user_id)""",
    """
    SELECT user_id, used, greatest(used - 100, 0) * 2 AS overage, CASE WHEN quota > 0 THEN CAST(round(used * 100.0 / quota, 2) AS DECIMAL(38,2)) END AS pct
    FROM (SELECT user_id, count(*) AS used, CAST(user_id % 5 * 50 AS INT) AS quota FROM events GROUP BY user_id)""",
)
sql(
    "agg_budget_remainder",
    """
    WITH pools AS (SELECT user_id, user_id % 7 AS pool, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS usd FROM events GROUP BY user_id),
         shares AS (SELECT user_id, 50.0 AS share FROM events GROUP BY user_id HAVING count(*) % 2 = 0)
    SELECT pool, round(sum(CASE WHEN share IS NULL THEN usd ELSE greatest(usd - share, 0.0) END), 2) AS remainder
    FROM pools LEFT JOIN shares ON pools.user_id = shares.user_id GROUP BY pool""",
    """
    WITH pools AS (SELECT user_id, user_id % 7 AS pool, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS usd FROM events GROUP BY user_id),
         shares AS (SELECT user_id, CAST(50.0 AS DOUBLE) AS share FROM events GROUP BY user_id HAVING count(*) % 2 = 0)
    SELECT pool, round(sum(CASE WHEN share IS NULL THEN usd ELSE greatest(usd - share, 0.0) END), 2) AS remainder
    FROM pools LEFT JOIN shares ON pools.user_id = shares.user_id GROUP BY pool""",
)
sql(
    "agg_seed_p95x1_5",
    """
    WITH last AS (SELECT CAST(max(ts) AS DATE) AS day FROM events), days AS (SELECT explode(sequence(day - 30, day - 1)) AS day FROM last),
         types AS (SELECT DISTINCT event_type FROM events),
         spent AS (SELECT event_type AS t, CAST(ts AS DATE) AS d, sum(CAST(value AS DECIMAL(18,2))) AS s FROM events GROUP BY event_type, CAST(ts AS DATE))
    SELECT event_type, round(percentile(CAST(coalesce(s, 0) AS DOUBLE), 0.95) * 1.5, 2) AS seed
    FROM days CROSS JOIN types LEFT JOIN spent ON t = event_type AND d = day GROUP BY event_type""",
    """
    WITH days AS (SELECT CAST(unnest(generate_series(CAST(max(ts) AS DATE) - 30, CAST(max(ts) AS DATE) - 1, INTERVAL 1 DAY)) AS DATE) AS day FROM events), types AS (SELECT DISTINCT event_type FROM events),
         spent AS (SELECT event_type AS t, CAST(ts AS DATE) AS d, sum(CAST(value AS DECIMAL(18,2))) AS s FROM events GROUP BY event_type, CAST(ts AS DATE))
    SELECT event_type, round(quantile_cont(CAST(coalesce(s, 0) AS DOUBLE), 0.95) * 1.5, 2) AS seed
    FROM days CROSS JOIN types LEFT JOIN spent ON t = event_type AND d = day GROUP BY event_type""",
)
sql(
    "agg_weekly_trend",
    """
    SELECT week, event_type, n, lag(n) OVER (PARTITION BY event_type ORDER BY week) AS previous
    FROM (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type, count(*) AS n FROM events GROUP BY CAST(date_trunc('week', ts) AS DATE), event_type)""",
)
sql(
    "agg_cap_share_worst_day",
    """
    WITH daily AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY event_type, CAST(ts AS DATE))
    SELECT event_type, max_by(day, struct(n, -datediff(day, DATE '2024-01-01'))) AS worst, max(n) / 100.0D AS worst_share FROM daily GROUP BY event_type""",
    """
    WITH daily AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY event_type, CAST(ts AS DATE))
    SELECT event_type, arg_max(day, (n, -datediff('day', DATE '2024-01-01', day))) AS worst, max(n) / CAST(100.0 AS DOUBLE) AS worst_share FROM daily GROUP BY event_type""",
)
sql(
    "agg_kpi_ratio4",
    "SELECT user_id, CAST(CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) / count(*) AS DECIMAL(9,4)) AS ratio FROM events GROUP BY user_id",
)
sql(
    "agg_multi_scope",
    """
    SELECT event_type, user_id, CAST(grouping(event_type) AS INT) AS all_types, CAST(grouping(user_id) AS INT) AS all_users, count(*) AS calls,
           CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS cost
    FROM events GROUP BY GROUPING SETS ((), (event_type), (user_id))""",
)
sql(
    "agg_framework_score",
    """
    SELECT o_orderpriority, round(count(*) FILTER (WHERE o_orderstatus = 'F') * 100.0D / count(*), 2) AS strict,
           round((count(*) FILTER (WHERE o_orderstatus = 'F') + 0.5D * count(*) FILTER (WHERE o_orderstatus = 'P')) * 100.0D / count(*), 2) AS weighted
    FROM orders GROUP BY o_orderpriority""",
    """
    SELECT o_orderpriority, round(CAST(count(*) FILTER (WHERE o_orderstatus = 'F') * 100 AS DOUBLE) / count(*), 2) AS strict,
           round((count(*) FILTER (WHERE o_orderstatus = 'F') + CAST(0.5 AS DOUBLE) * count(*) FILTER (WHERE o_orderstatus = 'P')) * 100 / count(*), 2) AS weighted
    FROM orders GROUP BY o_orderpriority""",
)
sql(
    "agg_state_fold",
    """
    WITH controls AS (
        SELECT o_custkey, o_orderpriority, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'met' WHEN bool_or(o_orderstatus = 'P') THEN 'gap' ELSE 'partial' END AS state
        FROM orders GROUP BY o_custkey, o_orderpriority
    )
    SELECT o_custkey, CASE WHEN bool_or(state = 'gap') THEN 'gap' WHEN bool_and(state = 'met') THEN 'met' ELSE 'partial' END AS state FROM controls GROUP BY o_custkey""",
)
sql(
    "agg_stale_share",
    """
    WITH fresh AS (SELECT DISTINCT c_nationkey AS k, o_orderpriority AS market FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '2001-06-01 00:00:00'),
         grid AS (SELECT n_nationkey, market FROM nation CROSS JOIN (SELECT DISTINCT o_orderpriority AS market FROM orders) m)
    SELECT grid.market, count(*) AS places, count(CASE WHEN k IS NULL THEN 1 END) AS stale, count(CASE WHEN k IS NULL THEN 1 END) * 4 > count(*) AS above
    FROM grid LEFT JOIN fresh ON k = n_nationkey AND fresh.market = grid.market GROUP BY grid.market""",
)
sql(
    "agg_demand_by_market",
    """
    SELECT p_type, count(DISTINCT p_partkey) AS parts, count(DISTINCT l_partkey) AS linked, count(CASE WHEN l_quantity > 25 THEN 1 END) AS volume
    FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_type""",
)
sql(
    "agg_coverage_report",
    """
    WITH covers AS (
        SELECT c_custkey, c_nationkey, CASE WHEN u.k IS NOT NULL THEN 1 WHEN o.k IS NOT NULL THEN 2 ELSE 3 END AS level FROM customer
        LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT') u ON u.k = c_custkey
        LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON o.k = c_custkey
    )
    SELECT level, count(*) AS n, count(DISTINCT c_nationkey) AS nations FROM covers GROUP BY level""",
)
@query(
    "agg_summary_stats",
    "SELECT o_orderpriority, count(*) AS n, round(quantile_cont(o_totalprice, 0.5), 6) AS median, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean, max(o_totalprice) AS largest FROM orders GROUP BY o_orderpriority",
)
def agg_summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice")
    totals = orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), (F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("mean"), F.max("o_totalprice").alias("largest"))
    medians = exact_percentiles(orders, ["o_orderpriority"], "o_totalprice", {"median": 0.5})
    return totals.join(medians, "o_orderpriority").select("o_orderpriority", "n", F.round("median", 6).alias("median"), "mean", "largest")


sql(
    "agg_incident_summary",
    """
    SELECT user_id, count(*) AS calls, count(*) FILTER (WHERE event_type <> 'error') AS live, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS cost,
           min(ts) FILTER (WHERE value > 10) AS first_paid, max(ts) FILTER (WHERE value > 10) AS last_paid FROM events GROUP BY user_id""",
)
@query(
    "agg_agency_reduce",
    """
    SELECT user_id, CAST(grouping(user_id) AS INT) AS total, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS errors,
           CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS cost, round(quantile_cont(value, 0.95), 6) AS p95
    FROM events WHERE event_type <> 'signup' GROUP BY GROUPING SETS ((), (user_id))""",
)
def agg_agency_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and in total; the total's percentile, which one task would hold, is found by ranks."""
    calls = read_table(spark, sf_dir, "events").filter("event_type <> 'signup'")
    sums = [F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("cost")]
    users = calls.groupBy("user_id").agg(*sums, F.percentile("value", 0.95).alias("p95")).withColumn("total", F.lit(0))
    found = exact_percentiles(calls.select("value", F.lit(1).alias("all")), ["all"], "value", {"p95": 0.95})
    whole = calls.agg(*sums).withColumn("all", F.lit(1)).join(found, "all").withColumn("total", F.lit(1)).withColumn("user_id", F.lit(None).cast("bigint"))
    return users.unionByName(whole.drop("all")).select("user_id", "total", "calls", "errors", "cost", F.round("p95", 6).alias("p95"))


sql(
    "agg_split_state",
    """
    WITH split AS (SELECT user_id % 10 AS pool, count(*) FILTER (WHERE event_type = 'purchase') AS a, count(*) FILTER (WHERE event_type = 'click') AS b, count(*) AS cap FROM events GROUP BY user_id % 10)
    SELECT pool, a + b AS allocated, cap - a - b AS headroom, CASE WHEN a + b > cap THEN 'over' WHEN (a + b) * 2 > cap THEN 'high' ELSE 'ok' END AS state FROM split""",
)
sql(
    "agg_newest_per_key_exploded",
    """
    SELECT k, event_type, max_by(value, struct(ts, event_id)) AS newest, max(ts) AS fetched
    FROM (SELECT *, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY k, event_type""",
    """
    SELECT k, event_type, arg_max(value, (ts, event_id)) AS newest, max(ts) AS fetched
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY k, event_type""",
)
sql(
    "agg_two_stage_repeats",
    """
    SELECT event_type, count(*) AS pairs, CAST(sum(n) AS BIGINT) AS calls, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS repeated, max(n) AS most
    FROM (SELECT event_type, user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY event_type, user_id, CAST(ts AS DATE)) GROUP BY event_type""",
)
sql(
    "agg_attribution_coverage",
    """
    SELECT o_orderpriority, count(*) AS n, count(CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS with_customer,
           count(l_orderkey) AS with_line FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') l ON o_orderkey = l_orderkey
    GROUP BY o_orderpriority""",
)
sql(
    "agg_prefix_bucket",
    "SELECT coalesce(nullif(split_part(p_name, ' ', 2), ''), '(none)') AS bucket, count(*) AS n FROM part GROUP BY coalesce(nullif(split_part(p_name, ' ', 2), ''), '(none)')",
)
sql(
    "agg_best_market_carry",
    """
    WITH ranked AS (SELECT c_nationkey, c_mktsegment, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY c_nationkey, c_mktsegment)
    SELECT c_nationkey, min_by(lo, c_mktsegment) AS lo, min_by(hi, c_mktsegment) AS hi, max(hi) AS free_hi FROM ranked GROUP BY c_nationkey""",
)
sql(
    "agg_bar_status_counts",
    """
    WITH bars AS (SELECT 'strict' AS bar, 40 AS qty, 0.02 AS disc UNION ALL SELECT 'loose', 10, 0.08)
    SELECT bar, CASE WHEN l_quantity < qty THEN 'quantity' WHEN l_discount > disc THEN 'discount' WHEN l_returnflag = 'R' THEN 'returned' ELSE 'passes' END AS unmet, count(*) AS n
    FROM lineitem CROSS JOIN bars GROUP BY bar, CASE WHEN l_quantity < qty THEN 'quantity' WHEN l_discount > disc THEN 'discount' WHEN l_returnflag = 'R' THEN 'returned' ELSE 'passes' END""",
)
sql(
    "agg_latest_and_last_success",
    """
    WITH newest AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events),
         ok AS (SELECT user_id, max(ts) AS last_ok FROM events WHERE event_type = 'purchase' GROUP BY user_id),
         bad AS (SELECT user_id, count(*) AS failures FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-23 00:00:00' GROUP BY user_id)
    SELECT newest.user_id, event_id, ts, last_ok, coalesce(failures, 0) AS failures
    FROM newest LEFT JOIN ok ON ok.user_id = newest.user_id LEFT JOIN bad ON bad.user_id = newest.user_id WHERE n = 1""",
)
sql(
    "agg_month_endpoint_stats",
    """
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_custkey, count(*) AS calls, count(*) FILTER (WHERE o_orderstatus = 'F') AS ok, count(*) FILTER (WHERE o_orderstatus = 'P') AS limited,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean, count(DISTINCT o_orderpriority) AS endpoints
    FROM orders GROUP BY CAST(date_trunc('month', o_orderdate) AS DATE), o_custkey""",
)
sql(
    "agg_reserved_and_split",
    """
    SELECT event_type, user_id, n, floor(n * 10000.0D * 500 / sum(n) OVER (PARTITION BY event_type)) / 10000.0D AS share
    FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY event_type, user_id)""",
    """
    SELECT event_type, user_id, n, floor(CAST(n AS DOUBLE) * 10000 * 500 / CAST(sum(n) OVER (PARTITION BY event_type) AS DOUBLE)) / CAST(10000 AS DOUBLE) AS share
    FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY event_type, user_id)""",
)
sql(
    "agg_confusion",
    """
    SELECT tp, fp, fn, tn, round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 6) AS accuracy,
           round(tn / CAST(nullif(tn + fn, 0) AS DOUBLE), 6) AS fail_precision, round(tn / CAST(nullif(tn + fp, 0) AS DOUBLE), 6) AS fail_recall
    FROM (SELECT count(*) FILTER (WHERE judge AND label) AS tp, count(*) FILTER (WHERE judge AND NOT label) AS fp, count(*) FILTER (WHERE NOT judge AND label) AS fn, count(*) FILTER (WHERE NOT judge AND NOT label) AS tn
          FROM (SELECT n_chars > 600 AS judge, quality = 1 AS label FROM documents JOIN labels ON documents.doc_id = labels.doc_id))""",
)
