"""Window, top-k and set operators."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import latest_per_key
from tidemark.plans.registry import frame, query, sql
from tidemark.session import shared_folder
from tidemark.sources.tables import read_table


def running(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """df with `name`: the sum of value (bigint) over all rows before, by `order`, which tells all rows apart.

    Rows are summed within range partitions, which start at the totals of those before; no task has all rows.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = df.withColumn("_value", value.cast("bigint")).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    path = f"{shared_folder(spark)}/running-{uuid.uuid4().hex}"
    spread.write.parquet(path)
    spread = spark.read.schema(spread.schema).parquet(path)
    totals = sorted(tuple(r) for r in spread.groupBy("_part").agg(F.sum("_value")).collect())  # one row per partition
    starts = itertools.accumulate((n or 0 for _, n in totals), initial=0)
    begun = spark.createDataFrame([(p, n) for (p, _), n in zip(totals, starts, strict=False)], "_part int, _start bigint")
    before = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = spread.withColumn(name, F.coalesce(F.sum("_value").over(before), F.lit(0)))
    return inside.join(F.broadcast(begun), "_part").select(*df.columns, (F.col("_start") + F.col(name)).alias(name))


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys, and for each of `shares` (name to share) the percentile of `value`, linear between neighbours; nulls stay out.

    Equal values are counted first and the counts lie in range partitions of (keys, value). How many values each partition
    has of a key tells in which of them a rank lies, so values are put in order and looked through only there. No task holds
    all values of a key, or of a table without keys.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/counts-{uuid.uuid4().hex}"
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    counts.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    spread = spark.read.parquet(path)
    of_key, ahead = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = spread.groupBy(*keys, "_part").agg(F.sum("_n").alias("_sum"))  # a row a key and partition
    parts = parts.withColumns({"_total": F.sum("_sum").over(of_key), "_begin": F.coalesce(F.sum("_sum").over(ahead), F.lit(0))})
    ranks = {name: (F.col("_total") - 1) * F.lit(share) for name, share in shares.items()}
    wanted = [F.struct(F.lit(f"{name} {side}").alias("of"), (place - F.col("_begin")).cast("bigint").alias("at")) for name, rank in ranks.items() for side, place in (("low", F.floor(rank)), ("high", F.ceil(rank)))]
    here = F.filter(F.array(*wanted), lambda w: (w["at"] >= 0) & (w["at"] < F.col("_sum")))
    asked = parts.select(F.struct(*keys, "_part").alias("_of"), "_total", here.alias("_asked")).filter(F.size("_asked") > 0)
    on = F.col("_part") == F.col("_of._part")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_of.{k}"))
    before = F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    placed = spread.join(asked, on).withColumn("_before", F.coalesce(before, F.lit(0)))
    met = F.filter("_asked", lambda w: (w["at"] >= F.col("_before")) & (w["at"] < F.col("_before") + F.col("_n")))
    found = placed.select(*keys, "_total", F.col(value).alias("_value"), F.explode(met).alias("_w"))
    at = lambda of: F.max(F.when(F.col("_w.of") == of, F.col("_value")))
    out = []
    for name, share in shares.items():
        rank = (F.max("_total") - 1) * F.lit(share)
        out.append((at(f"{name} low") + (rank - F.floor(rank)) * (at(f"{name} high") - at(f"{name} low"))).alias(name))
    made = found.groupBy(*keys).agg(*out)
    return made if keys else made.filter(F.col(next(iter(shares))).isNotNull())


sql("win_row_number_position", "SELECT s_nationkey, s_suppkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY (s_acctbal > 5000) DESC, s_name) AS BIGINT) AS position FROM supplier")

sql(
    "win_top1_resolver",
    """
    WITH candidates AS (
        SELECT o_custkey AS k, 1 AS precedence, o_orderkey AS grant_id FROM orders WHERE o_orderpriority = '1-URGENT'
        UNION ALL SELECT o_custkey, 2, o_orderkey FROM orders WHERE o_orderstatus = 'P'
        UNION ALL SELECT c_custkey, 3, c_custkey FROM customer
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY precedence, grant_id DESC) AS rn FROM candidates)
    SELECT k, precedence, grant_id FROM ranked WHERE rn = 1""",
)
sql(
    "win_version_number",
    """
    WITH versions AS (SELECT o_custkey, o_orderkey, o_orderstatus, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS version,
        row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_orderdate DESC, o_orderkey DESC) AS pick FROM orders)
    SELECT o_orderkey, version, pick = 1 AND o_orderstatus = 'F' AS active FROM versions""",
)
sql("win_count_over", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand, p_name) AS spelled FROM part")
sql(
    "win_canonical_spelling",
    """
    WITH counted AS (SELECT p_brand, p_name, count(*) AS n, min(p_partkey) AS first_seen FROM part GROUP BY p_brand, p_name),
         ranked AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_name) AS best, row_number() OVER (PARTITION BY p_brand ORDER BY first_seen) AS mention FROM counted)
    SELECT p_brand, p_name, n, CAST(mention AS BIGINT) AS mention FROM ranked WHERE best = 1""",
)


@query(
    "win_distinct_on",
    """
    SELECT user_id, event_type, event_id, ts FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) t WHERE n = 1""",
)
def win_distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return latest_per_key(events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])


sql(
    "win_topn_per_group",
    "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) t WHERE n <= 3",
)
sql(
    "win_next_stop",
    """
    SELECT event_id, event_type AS stop, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_stop,
           lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_id FROM events""",
)
sql(
    "win_dedupe_consecutive",
    """
    SELECT event_id, event_type FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) t
    WHERE before IS DISTINCT FROM event_type""",
)

_CHAIN = "{hash}(concat_ws('|', CAST(o_orderkey AS STRING), CAST(o_custkey AS STRING), o_orderstatus, o_orderpriority){bits})"


def _chain(hash_name: str, bits: str) -> str:
    """A chain over each customer's orders; every 97th stored hash is broken, and the first bad link of each is reported."""
    own = _CHAIN.format(hash=hash_name, bits=bits)
    return f"""
    WITH numbered AS (SELECT o_custkey, o_orderkey, {own} AS row_hash, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq FROM orders),
         stored AS (SELECT *, CASE WHEN o_orderkey % 97 = 0 THEN 'broken' ELSE row_hash END AS stored_hash FROM numbered),
         linked AS (SELECT *, lag(row_hash) OVER (PARTITION BY o_custkey ORDER BY seq) AS prev_hash, lag(stored_hash) OVER (PARTITION BY o_custkey ORDER BY seq) AS prev_stored FROM stored)
    SELECT o_custkey, count(*) AS n, CAST(min(CASE WHEN stored_hash <> row_hash OR prev_hash IS DISTINCT FROM prev_stored THEN seq END) AS BIGINT) AS first_bad
    FROM linked GROUP BY o_custkey"""


sql("win_chain_verify", _chain("sha2", ", 256"), _chain("sha256", ""))
sql("op_chain_verify", f"SELECT count(*) AS chains, count(first_bad) AS broken, max(first_bad) AS worst FROM ({_chain('sha2', ', 256')})", f"SELECT count(*) AS chains, count(first_bad) AS broken, max(first_bad) AS worst FROM ({_chain('sha256', '')})")

#: Trailing sums with the year-over-year change, and the month of the most orders in the last twelve (of equal ones the first).
sql(
    "win_trailing_12m",
    """
    WITH months AS (SELECT c_mktsegment, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS m, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
         sums AS (SELECT c_mktsegment, m, n, sum(n) OVER (PARTITION BY c_mktsegment ORDER BY m RANGE BETWEEN 11 PRECEDING AND CURRENT ROW) AS last12,
                  sum(n) OVER (PARTITION BY c_mktsegment ORDER BY m RANGE BETWEEN 23 PRECEDING AND 12 PRECEDING) AS previous12,
                  max(n * 100000 + 99999 - m) OVER (PARTITION BY c_mktsegment ORDER BY m RANGE BETWEEN 11 PRECEDING AND CURRENT ROW) AS best FROM months)
    SELECT c_mktsegment, m, n, CAST(last12 AS BIGINT) AS last12, CAST(previous12 AS BIGINT) AS previous12, CAST(99999 - best % 100000 AS BIGINT) AS peak, round(last12 / CAST(previous12 AS DOUBLE) - 1, 6) AS change FROM sums""",
    """
    WITH months AS (SELECT c_mktsegment, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS m, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
         t AS (SELECT a.c_mktsegment, a.m, a.n, sum(b.n) FILTER (WHERE b.m > a.m - 12) AS last12, sum(b.n) FILTER (WHERE b.m <= a.m - 12) AS previous12,
                  arg_min(b.m, (-b.n, b.m)) FILTER (WHERE b.m > a.m - 12) AS peak
               FROM months a JOIN months b ON a.c_mktsegment = b.c_mktsegment AND b.m BETWEEN a.m - 23 AND a.m GROUP BY 1, 2, 3)
    SELECT c_mktsegment, m, n, CAST(last12 AS BIGINT) AS last12, CAST(previous12 AS BIGINT) AS previous12, peak, round(last12 / CAST(previous12 AS DOUBLE) - 1, 6) AS change FROM t""",
)
@query(
    "win_round_robin",
    """
    SELECT user_id, event_id, CAST(row_number() OVER (ORDER BY turn, user_id) AS BIGINT) AS place FROM (
        SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events WHERE event_type = 'purchase') t WHERE turn <= 5""",
)
def win_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    bought = read_table(spark, sf_dir, "events").filter("event_type = 'purchase'").withColumn("turn", turn).filter("turn <= 5").select("user_id", "event_id", "turn")
    return running(bought, ["turn", "user_id"], F.lit(1), "place").select("user_id", "event_id", (F.col("place") + 1).alias("place"))


#: The days of a user's events in the order of their values: missing between first and last, said again, and out of order.
_SAID = "SELECT user_id, CAST(ts AS DATE) AS day, value, event_id FROM events"
sql(
    "win_source_days_gap",
    f"""
    WITH steps AS (SELECT user_id, day, lag(day) OVER (PARTITION BY user_id ORDER BY value, event_id) AS before FROM ({_SAID}))
    SELECT user_id, CAST(datediff(max(day), min(day)) + 1 - count(DISTINCT day) AS BIGINT) AS missing, count(DISTINCT day) AS present, count(*) - count(DISTINCT day) AS again, count_if(day < before) AS backwards FROM steps GROUP BY user_id""",
    f"""
    WITH said AS ({_SAID}), numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS i, row_number() OVER (PARTITION BY user_id, day ORDER BY value, event_id) AS nth FROM said),
         pairs AS (SELECT a.user_id, count(*) AS backwards FROM numbered a JOIN numbered b ON a.user_id = b.user_id AND b.i = a.i - 1 AND a.day < b.day GROUP BY 1),
         spans AS (SELECT user_id, count(*) FILTER (WHERE nth = 1) AS present, count(*) FILTER (WHERE nth > 1) AS again, max(day) - min(day) + 1 AS days FROM numbered GROUP BY 1)
    SELECT user_id, CAST(days - present AS BIGINT) AS missing, present, again, coalesce(backwards, 0) AS backwards FROM spans LEFT JOIN pairs USING (user_id)""",
)

# top-k

sql("top_multi_key", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY (o_orderstatus = 'F') DESC, o_totalprice DESC, o_orderkey LIMIT 2000")
sql(
    "top_nulls_last",
    "SELECT c_custkey, last_order FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS last_order FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey) o ON o_custkey = c_custkey ORDER BY last_order DESC NULLS LAST, c_custkey LIMIT 1400",
)


def nearest(queries: DataFrame, rows: DataFrame, k: int, id_column: str = "vec_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """query, neighbour, cosine: each query's k nearest other rows, by exact search.

    The queries (a stated set) go to every partition of rows as a matrix of at most `block` vectors, a pass for each
    block; a partition keeps its own k best per query, so the shuffle moves k rows per query and partition.
    """
    import numpy as np
    import pyarrow as pa

    def matrix(column: pa.Array) -> np.ndarray:
        out = np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    n = queries.count()
    out = None
    for part in range(max(1, -(-n // block))):
        own = queries.filter(F.pmod(F.xxhash64(id_column), F.lit(max(1, -(-n // block)))) == part) if n > block else queries
        table = own.select(id_column, vector).toArrow()
        if not table.num_rows:
            continue
        ids, vectors = np.array(table.column(0).to_pylist()), matrix(table.column(1).combine_chunks())
        shared = rows.sparkSession.sparkContext.broadcast((ids, vectors))

        def search(batches, shared=shared):
            ids, vectors = shared.value
            best_id, best = np.full((len(ids), k), -1, np.int64), np.full((len(ids), k), -np.inf)
            for batch in batches:
                if not batch.num_rows:
                    continue
                other = batch.column(0).to_numpy()
                score = np.round(vectors @ matrix(batch.column(1)).T, 9)
                score[ids[:, None] == other[None, :]] = -np.inf
                score = np.concatenate([best, score], 1)
                names = np.concatenate([best_id, np.broadcast_to(other, (len(ids), len(other)))], 1)
                order = np.lexsort((names, -score), axis=1)[:, :k]
                best, best_id = np.take_along_axis(score, order, 1), np.take_along_axis(names, order, 1)
            q, i = np.nonzero(np.isfinite(best))
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(best_id[q, i]), pa.array(best[q, i])], names=["query", "neighbour", "cosine"])

        found = rows.select(id_column, vector).mapInArrow(search, "query bigint, neighbour bigint, cosine double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return rows.sparkSession.createDataFrame([], "query bigint, neighbour bigint, cosine double")
    ranked = out.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour")))
    return ranked.filter(F.col("n") <= k).drop("n")


@query(
    "top_knn_cosine",
    """
    WITH d AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
         s AS (SELECT q.vec_id AS query, r.vec_id AS neighbour, round(list_cosine_similarity(q.e, r.e), 6) AS cosine, list_cosine_similarity(q.e, r.e) AS raw
               FROM d q JOIN d r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0)
    SELECT query, neighbour, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(raw, 9) DESC, neighbour) AS n FROM s) t WHERE n <= 10""",
)
def top_knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return nearest(rows.filter("vec_id % 50 = 0"), rows, 10).withColumn("cosine", F.round("cosine", 6))


sql(
    "top_rank_tuple",
    "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size < 5, p_size DESC, p_retailprice DESC, p_partkey) AS n FROM part) t WHERE n = 1",
)
sql(
    "top_best_per_group_market",
    """
    WITH sets AS (SELECT l_orderkey, array_join(sort_array(collect_set(l_returnflag)), ',') AS signature, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS v FROM lineitem GROUP BY l_orderkey)
    SELECT signature, count(*) AS n, max_by(l_orderkey, struct(v, -l_orderkey)) AS best FROM sets GROUP BY signature""",
    """
    WITH sets AS (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS signature, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS v FROM lineitem GROUP BY l_orderkey)
    SELECT signature, count(*) AS n, arg_max(l_orderkey, (v, -l_orderkey)) AS best FROM sets GROUP BY signature""",
)
@query(
    "top_priority_buckets",
    """
    WITH b AS (SELECT o_orderkey, o_orderdate, o_totalprice, CASE WHEN o_orderstatus = 'O' THEN 1 WHEN o_orderdate < TIMESTAMP '1998-01-01 00:00:00' THEN 2 ELSE 3 END AS bucket FROM orders)
    SELECT o_orderkey, bucket, CAST(row_number() OVER (PARTITION BY bucket ORDER BY CASE WHEN bucket = 1 THEN -o_totalprice END, o_orderdate, o_orderkey) AS BIGINT) AS place FROM b""",
)
def top_priority_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, """
        SELECT o_orderkey, o_orderdate, bucket, CASE WHEN bucket = 1 THEN -o_totalprice END AS price FROM (
            SELECT *, CASE WHEN o_orderstatus = 'O' THEN 1 WHEN o_orderdate < TIMESTAMP '1998-01-01 00:00:00' THEN 2 ELSE 3 END AS bucket FROM orders)""")
    sizes = dict(rows.groupBy("bucket").count().collect())  # three rows
    begun = F.when(F.col("bucket") == 1, 0).when(F.col("bucket") == 2, sizes.get(1, 0)).otherwise(sizes.get(1, 0) + sizes.get(2, 0))
    placed = running(rows, ["bucket", "price", "o_orderdate", "o_orderkey"], F.lit(1), "place")
    return placed.select("o_orderkey", "bucket", (F.col("place") - begun + 1).cast("bigint").alias("place"))


sql(
    "top_hash_shuffle_pick",
    "SELECT p_brand, min_by(p_partkey, md5(concat(p_brand, '/', CAST(p_partkey AS STRING)))) AS pick FROM part GROUP BY p_brand",
)
sql(
    "smp_capped_random",
    "SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY sha2(concat('seed-7:', CAST(doc_id AS STRING)), 256) LIMIT 100) t",
    "SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY sha256(concat('seed-7:', CAST(doc_id AS STRING))) LIMIT 100) t",
)

# sets

sql("set_union_all", "SELECT c_nationkey AS k, 'c' AS side FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier")
sql("set_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql(
    "set_except_all_both_ways",
    """
    WITH a AS (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 10), b AS (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity >= 10)
    SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) x) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) y) AS only_b""",
)
sql("set_intersect", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
