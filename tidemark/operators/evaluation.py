"""Evaluation statistics: hash splits, agreement, bars, sweeps and rank statistics."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.windows import running
from tidemark.plans.registry import frame, query, sql
from tidemark.sources.tables import read_table

_SHARE = {"spark": "conv(substr(sha2({key}, 256), 1, 8), 16, 10)", "duck": "CAST('0x' || substr(sha256({key}), 1, 8) AS BIGINT)"}


def _both(name: str, text: str) -> None:
    """text with {u32:KEY} places for the first 32 bits of a key's SHA-256, and {p50}/{p95} percentiles."""

    def put(kind: str) -> str:
        out = re.sub(r"\{u32:([^}]*)\}", lambda m: f"CAST({_SHARE[kind].format(key=m[1])} AS BIGINT)", text)
        return out.replace("@percentile", "percentile" if kind == "spark" else "quantile_cont")

    sql(name, put("spark"), put("duck"))


_both(
    "ev_hash_split_3way",
    """
    WITH b AS (SELECT doc_id, floor({u32:concat('split-v1:', CAST(doc_id AS STRING))} / 4294967296.0 * 1000000) / 1000000 AS bucket FROM documents)
    SELECT doc_id, CAST(bucket AS DOUBLE) AS bucket, CASE WHEN bucket < 0.30 THEN 'calibration' WHEN bucket < 0.60 THEN 'gate' ELSE 'dev' END AS side FROM b""",
)
_both(
    "ev_group_split",
    """
    SELECT doc_id, {u32:concat('held-out|', coalesce(source, CAST(doc_id AS STRING)))} / CAST(4294967295 AS DOUBLE) < 0.3 AS held_out FROM documents""",
)
_both(
    "ev_split_drift",
    """
    WITH stored AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'dev' WHEN {u32:concat('split-v1:', CAST(doc_id AS STRING))} < 1288490188 THEN 'calibration' ELSE 'dev' END AS side FROM documents),
         again AS (SELECT doc_id, CASE WHEN {u32:concat('split-v1:', CAST(doc_id AS STRING))} < 1288490188 THEN 'calibration' ELSE 'dev' END AS side FROM documents)
    SELECT stored.doc_id, stored.side AS stored_side, again.side AS now_side FROM stored JOIN again ON stored.doc_id = again.doc_id WHERE stored.side <> again.side""",
)

_JUDGED = "SELECT documents.doc_id, documents.source, n_chars / 400.0 AS raw, n_chars > 600 AS judge, quality = 1 AS label, toxic = 1 AS toxic FROM documents JOIN labels ON documents.doc_id = labels.doc_id"
_WILSON = "(p + 1.9207 / n - 1.96 * sqrt((p * (1 - p) + 0.9604 / n) / n)) / (1 + 3.8416 / n)"

sql("ev_wilson_lower", f"SELECT source, n, CASE WHEN n > 0 THEN round({_WILSON}, 6) END AS low FROM (SELECT source, count(*) AS n, count(CASE WHEN label THEN 1 END) / CAST(count(*) AS DOUBLE) AS p FROM ({_JUDGED}) GROUP BY source)".replace("1.9207", "CAST(1.9207 AS DOUBLE)").replace("1.96 ", "CAST(1.96 AS DOUBLE) ").replace("0.9604", "CAST(0.9604 AS DOUBLE)").replace("3.8416", "CAST(3.8416 AS DOUBLE)"))
#: Precision, its lower bound, the number of labelled violations and the agreement; without a judged row nothing passes.
sql(
    "ev_bar_passes",
    f"""
    SELECT source, n_pos, CASE WHEN n = 0 THEN false ELSE p >= 0.8 AND n_pos >= 5 AND agree >= 0.6 AND {_WILSON} >= 0.5 END AS passes FROM (
        SELECT source, CAST(count(CASE WHEN judge THEN 1 END) AS DOUBLE) AS n, count(CASE WHEN label THEN 1 END) AS n_pos, count(CASE WHEN judge AND label THEN 1 END) / CAST(nullif(count(CASE WHEN judge THEN 1 END), 0) AS DOUBLE) AS p,
               count(CASE WHEN judge = label THEN 1 END) / CAST(count(*) AS DOUBLE) AS agree FROM ({_JUDGED}) GROUP BY source)""",
)
_MIN_FLAGGED = """
    WITH grid AS (SELECT CAST(n AS DOUBLE) AS n, p FROM (SELECT {series} AS n) s CROSS JOIN (SELECT CAST(0.9 AS DOUBLE) AS p UNION ALL SELECT CAST(0.95 AS DOUBLE) UNION ALL SELECT CAST(0.97 AS DOUBLE)) q)
    SELECT p, CAST(min(n) AS BIGINT) AS least FROM grid
    WHERE (p + CAST(1.9207 AS DOUBLE) / n - CAST(1.96 AS DOUBLE) * sqrt((p * (1 - p) + CAST(0.9604 AS DOUBLE) / n) / n)) / (1 + CAST(3.8416 AS DOUBLE) / n) >= 0.85 GROUP BY p"""
sql("ev_min_flagged", _MIN_FLAGGED.format(series="explode(sequence(1, 5000))"), _MIN_FLAGGED.format(series="unnest(generate_series(1, 5000))"))
_RATES = f"SELECT source, count(*) AS n, count(CASE WHEN judge THEN 1 END) AS flagged, count(CASE WHEN label THEN 1 END) AS violations, count(CASE WHEN judge AND label THEN 1 END) AS tp FROM ({_JUDGED}) GROUP BY source"
BAR_PRECISION, BAR_BOUND, BAR_POSITIVES, HELD_OUT = 0.8, 0.6, 15, 0.2


def wilson_lower(successes: int, n: int, z: float = 1.96) -> float:
    p, z2 = successes / n, z * z
    return max(0.0, (p + z2 / (2 * n) - z * math.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n))


def least_flagged(precision: float | None) -> int | None:
    """The fewest flagged claims that clear the bar at an observed precision, whole true positives rounded down."""
    if precision is None or precision < BAR_PRECISION:
        return None
    for n in range(1, 5001):
        tp = math.floor(precision * n + 1e-9)
        if tp / n >= BAR_PRECISION and wilson_lower(tp, n) >= BAR_BOUND:
            return n
    return None


_NEED = f"SELECT min(k) FROM (SELECT unnest(generate_series(1, 5000)) AS k) g WHERE floor(p * k + 1e-9) / k >= {BAR_PRECISION} AND p >= {BAR_PRECISION} AND ((floor(p * k + 1e-9) / k) + 1.9208 / k - 1.96 * sqrt(((floor(p * k + 1e-9) / k) * (1 - floor(p * k + 1e-9) / k) + 0.9604 / k) / k)) / (1 + 3.8416 / k) >= {BAR_BOUND}"


@query(
    "ev_label_budget",
    f"""WITH r AS (SELECT *, CASE WHEN flagged > 0 THEN tp / CAST(flagged AS DOUBLE) END AS p FROM ({_RATES}) t), k AS (SELECT *, ({_NEED}) AS need FROM r)
    SELECT source, n, flagged, need, CASE WHEN need IS NOT NULL AND violations > 0 THEN CAST(ceil(greatest(ceil(need * n / CAST(flagged AS DOUBLE) - 1e-9), ceil({BAR_POSITIVES} * n / CAST(violations AS DOUBLE) - 1e-9)) / {HELD_OUT} - 1e-9) AS BIGINT) END AS to_label FROM k""",
)
def ev_label_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims to label so that the held-out fifth alone clears the bar; null where it is out of reach."""
    rates = frame(spark, sf_dir, _RATES)
    need = F.udf(least_flagged, "int")(F.try_divide("tp", "flagged"))
    held = lambda wanted, of: F.ceil(wanted * F.col("n") / F.col(of) - 1e-9)
    known = rates.withColumn("need", need.cast("bigint"))
    total = F.ceil(F.greatest(held(F.col("need"), "flagged"), held(F.lit(BAR_POSITIVES), "violations")) / HELD_OUT - 1e-9).cast("bigint")
    return known.select("source", "n", "flagged", "need", F.when(F.col("need").isNotNull() & (F.col("violations") > 0), total).alias("to_label"))


_KAPPA = "CASE WHEN pe < 1 THEN round((po - pe) / (1 - pe), 6) END"
_PE = "(tp + tn) / n AS po, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) AS pe"
_COUNTS = "CAST(count(CASE WHEN judge AND label THEN 1 END) AS DOUBLE) AS tp, CAST(count(CASE WHEN judge AND NOT label THEN 1 END) AS DOUBLE) AS fp, CAST(count(CASE WHEN NOT judge AND label THEN 1 END) AS DOUBLE) AS fn, CAST(count(CASE WHEN NOT judge AND NOT label THEN 1 END) AS DOUBLE) AS tn, CAST(count(*) AS DOUBLE) AS n"
sql("ev_cohen_kappa", f"SELECT source, {_KAPPA} AS kappa FROM (SELECT source, {_PE} FROM (SELECT source, {_COUNTS} FROM ({_JUDGED}) GROUP BY source))")
_SWEEP = """
    WITH bars AS (SELECT b / CAST(2 AS DOUBLE) AS bar FROM (SELECT {series} AS b)),
         j AS (SELECT bar, raw >= bar AS judge, label FROM ({judged}) CROSS JOIN bars)
    SELECT bar, kappa, coalesce(kappa = max(kappa) OVER () AND row_number() OVER (ORDER BY kappa DESC NULLS LAST, bar) = 1, false) AS best
    FROM (SELECT bar, {kappa} AS kappa FROM (SELECT bar, {pe} FROM (SELECT bar, {counts} FROM j GROUP BY bar)))"""  # twelve bars
_sweep = {"judged": _JUDGED, "kappa": _KAPPA, "pe": _PE, "counts": _COUNTS}
sql("ev_threshold_sweep", _SWEEP.format(series="explode(sequence(8, 19))", **_sweep), _SWEEP.format(series="unnest(generate_series(8, 19))", **_sweep))
sql(
    "ev_auc",
    f"""
    WITH byscore AS (SELECT raw, count(CASE WHEN label THEN 1 END) AS pos, count(CASE WHEN NOT label THEN 1 END) AS neg FROM ({_JUDGED}) GROUP BY raw),
         run AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY raw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM byscore)
    SELECT round(CAST(sum(pos * (below + neg / CAST(2 AS DOUBLE))) AS DOUBLE) / CAST(sum(pos) * sum(neg) AS DOUBLE), 6) AS auc FROM run""",
)
_LOO = "SELECT c.source, dj, dl, {pe} FROM (SELECT source, tp - CAST(dj AND dl AS INT) AS tp, fp - CAST(dj AND NOT dl AS INT) AS fp, fn - CAST(NOT dj AND dl AS INT) AS fn, tn - CAST(NOT dj AND NOT dl AS INT) AS tn, n - 1 AS n, dj, dl FROM c JOIN (SELECT DISTINCT source AS s, judge AS dj, label AS dl FROM ({judged})) d ON c.source = d.s WHERE n > 1) c"
sql(
    "ev_loo_kappa",
    f"WITH c AS (SELECT source, {_COUNTS} FROM ({_JUDGED}) GROUP BY source), k AS (SELECT source, {_KAPPA} AS kappa FROM ({_LOO.format(pe=_PE, judged=_JUDGED)})) SELECT source, min(kappa) AS low, max(kappa) AS high FROM k GROUP BY source",
)
sql(
    "ev_spearman",
    """
    WITH v AS (SELECT c_nationkey, c_acctbal AS x, CAST(n AS DOUBLE) AS y FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey),
         r AS (SELECT c_nationkey, rank() OVER (PARTITION BY c_nationkey ORDER BY x) + (count(*) OVER (PARTITION BY c_nationkey, x) - 1) / CAST(2 AS DOUBLE) AS rx,
                      rank() OVER (PARTITION BY c_nationkey ORDER BY y) + (count(*) OVER (PARTITION BY c_nationkey, y) - 1) / CAST(2 AS DOUBLE) AS ry FROM v)
    SELECT c_nationkey, round(corr(rx, ry), 6) AS rho FROM r GROUP BY c_nationkey""",
)
def sign_p(a: int, b: int) -> float | None:
    """The exact two-sided p of a sign test with a and b differences each way; none without differences."""
    n, k = a + b, min(a, b)
    if not n:
        return None
    if n <= 1000:
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
    # The tail from its largest term down, as multiples of it: they fall off within some sqrt(n) terms.
    top = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)
    tail, term, i = 1.0, 1.0, k
    while i and term > 1e-17 * tail:
        term *= i / (n - i + 1)
        tail, i = tail + term, i - 1
    return min(1.0, 2 * tail * math.exp(top))


@query(
    "ev_sign_test",
    f"""
    WITH t AS (SELECT source, count(CASE WHEN judge AND NOT label THEN 1 END) AS a, count(CASE WHEN label AND NOT judge THEN 1 END) AS b FROM ({_JUDGED}) GROUP BY source),
         k AS (SELECT source, a, b, unnest(generate_series(0, least(a, b))) AS i FROM t)
    SELECT source, a, b, CASE WHEN a + b > 0 THEN round(least(CAST(1 AS DOUBLE), 2 * sum(exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - (a + b) * ln(2)))), 6) END AS p
    FROM k GROUP BY source, a, b""",
)
def ev_sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = frame(spark, sf_dir, f"SELECT source, count(CASE WHEN judge AND NOT label THEN 1 END) AS a, count(CASE WHEN label AND NOT judge THEN 1 END) AS b FROM ({_JUDGED}) GROUP BY source")
    return counts.withColumn("p", F.round(F.udf(sign_p, "double")("a", "b"), 6))


#: Candidate (b) against control (a), lower is better; the noise arm is a second run of the candidate on every fifth pair.
_PAIRED = """
    WITH arms AS (SELECT o_custkey, max(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS a, max(CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice END) AS b, max(CASE WHEN o_orderpriority = '3-MEDIUM' THEN o_totalprice END) AS again FROM orders GROUP BY o_custkey),
         d AS (SELECT b - a AS diff, CASE WHEN o_custkey % 5 = 0 THEN again - b END AS noise FROM arms WHERE a IS NOT NULL AND b IS NOT NULL),
         s AS (SELECT count(*) AS n, avg(diff) AS mean, {sd_diff} / sqrt(count(*)) AS se, count(noise) AS n_noise, {sd_noise} / sqrt(nullif(count(noise), 0)) AS se_noise FROM d),
         v AS (SELECT n, mean, mean + 1.645 * se AS bound, greatest(20000, 2 * coalesce(se_noise, 0)) AS allowance, n_noise FROM s)
    SELECT n, n_noise, round(mean, 2) AS mean, round(bound, 2) AS bound, round(allowance, 2) AS allowance, CASE WHEN n = 0 OR n_noise = 0 THEN 'invalid' WHEN bound < 0 AND -mean >= allowance THEN 'improve' WHEN bound <= allowance THEN 'non_inferior' ELSE 'inferior' END AS verdict FROM v"""
_SD = "coalesce(sqrt((sum({0} * {0}) - sum({0}) * sum({0}) / count({0})) / nullif(count({0}) - 1, 0)), 0)"
sql("ev_paired_decision", _PAIRED.format(sd_diff="coalesce(stddev_samp(diff), 0)", sd_noise="coalesce(stddev_samp(noise), 0)"), _PAIRED.format(sd_diff=_SD.format("diff"), sd_noise=_SD.format("noise")))
#: Claims that the held-out documents of a writer should give, claims and cost of one, and picks of one group at most.
TARGET_CLAIMS, CLAIMS_EACH, COST_EACH, GROUP_CAP = 900, 4, 0.25, 8


def quota_picks(candidates: DataFrame, target: int = TARGET_CLAIMS, each: int = CLAIMS_EACH, cost: float = COST_EACH, cap: int | None = GROUP_CAP) -> DataFrame:
    """writer, have, need, picked, missing, missing_cost, picks (ids in order): whole objects to take next, one group after
    another and each group's by id, `cap` of a group at most; candidates: writer, grp (null: never picked), id, taken (its
    claims count already). What the picks do not give is missing and has its cost."""
    have = candidates.groupBy("writer").agg((F.count_if("taken") * each).alias("have"))
    open_ = candidates.filter("NOT taken AND grp IS NOT NULL")
    depth = F.row_number().over(Window.partitionBy("writer", "grp").orderBy("id"))
    ranked = open_.withColumn("depth", depth)
    ranked = ranked if cap is None else ranked.filter(F.col("depth") <= cap)
    need = have.withColumn("need", F.ceil(F.greatest(F.lit(0), F.lit(target) - F.col("have")) / each).cast("bigint"))
    numbered = running(ranked.select("writer", "depth", "grp", "id"), ["writer", "depth", "grp", "id"], F.lit(1), "before")
    first = numbered.groupBy("writer").agg(F.min("before").alias("first"))
    chosen = numbered.join(first, "writer").join(need, "writer").filter(F.col("before") - F.col("first") < F.col("need"))
    picks = chosen.groupBy("writer").agg(F.count("*").alias("picked"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("before", "id"))), lambda x: x["id"].cast("string")), ",").alias("picks"))
    full = need.join(picks, "writer", "left").select("writer", "have", "need", F.coalesce("picked", F.lit(0).cast("bigint")).alias("picked"), F.coalesce("picks", F.lit("")).alias("picks"))
    missing = F.greatest(F.lit(0).cast("bigint"), F.col("need") - F.col("picked"))
    return full.withColumns({"missing": missing, "missing_cost": F.round(missing * cost, 2)})


_CANDIDATES = "SELECT lang AS writer, source AS grp, d.doc_id AS id, l.doc_id IS NOT NULL AS taken FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"


@query(
    "ev_quota_picks",
    f"""
    WITH c AS ({_CANDIDATES}), h AS (SELECT writer, count(*) FILTER (WHERE taken) * {CLAIMS_EACH} AS have FROM c GROUP BY 1),
         n AS (SELECT *, CAST(ceil(greatest(0, {TARGET_CLAIMS} - have) / {CLAIMS_EACH}) AS BIGINT) AS need FROM h),
         r AS (SELECT *, row_number() OVER (PARTITION BY writer, grp ORDER BY id) AS depth FROM c WHERE NOT taken AND grp IS NOT NULL),
         o AS (SELECT *, row_number() OVER (PARTITION BY writer ORDER BY depth, grp, id) AS nth FROM r WHERE depth <= {GROUP_CAP}),
         p AS (SELECT o.writer, count(*) AS picked, string_agg(CAST(id AS VARCHAR), ',' ORDER BY nth) AS picks FROM o JOIN n ON o.writer = n.writer WHERE nth <= need GROUP BY 1)
    SELECT n.writer, have, need, coalesce(picked, 0) AS picked, coalesce(picks, '') AS picks, greatest(0, need - coalesce(picked, 0)) AS missing, round(greatest(0, need - coalesce(picked, 0)) * CAST({COST_EACH} AS DOUBLE), 2) AS missing_cost
    FROM n LEFT JOIN p ON p.writer = n.writer""",
)
def ev_quota_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages as writers, sources as groups; labelled documents have given their claims already."""
    return quota_picks(frame(spark, sf_dir, _CANDIDATES))


sql("ev_disagreement_queue", f"SELECT doc_id, judge, label FROM ({_JUDGED}) WHERE judge <> label ORDER BY doc_id DESC LIMIT 100")

def threshold_counts(queries: DataFrame, rows: DataFrame, bars: list[float]) -> DataFrame:
    """bar, tp, fp, fn of "same label" by cosine at each bar, over all pairs of a query with another row.

    Queries go out in blocks of at most 4096; every partition of rows returns one row per bar.
    """
    n = queries.count()
    blocks, out = max(1, -(-n // 4096)), None
    for part in range(blocks):
        table = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == part).select("vec_id", "embedding", "label").toArrow()
        shared = rows.sparkSession.sparkContext.broadcast((np.array(table.column(0).to_pylist()), table.column(1).to_pylist(), np.array(table.column(2).to_pylist())))

        def count(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            ids, vectors, labels = shared.value
            if not len(ids):
                return
            a = np.array(vectors, float)
            a /= np.linalg.norm(a, axis=1, keepdims=True)
            for batch in batches:
                if not batch.num_rows:
                    continue
                b = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(float)
                sim = np.round(a @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T, 6)
                other = ids[:, None] != batch.column(0).to_numpy()[None, :]
                same = (labels[:, None] == batch.column(2).to_numpy()[None, :]) & other
                hit = [sim >= x for x in bars]
                made = [[int((h & same).sum()), int((h & ~same & other).sum()), int((~h & same).sum())] for h in hit]
                yield pa.RecordBatch.from_arrays([pa.array(bars), *[pa.array([m[i] for m in made]) for i in range(3)]], names=["bar", "tp", "fp", "fn"])

        found = rows.select("vec_id", "embedding", "label").mapInArrow(count, "bar double, tp bigint, fp bigint, fn bigint")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("bar").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


@query(
    "ev_threshold_f1",
    """
    WITH d AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
         pairs AS (SELECT a.label = b.label AS same, round(list_cosine_similarity(a.e, b.e), 6) AS sim FROM d a JOIN d b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
         bars AS (SELECT CAST(b AS DOUBLE) / 10 AS bar FROM (SELECT unnest(generate_series(1, 9)) AS b)),
         c AS (SELECT bar, count(CASE WHEN sim >= bar AND same THEN 1 END) AS tp, count(CASE WHEN sim >= bar AND NOT same THEN 1 END) AS fp, count(CASE WHEN sim < bar AND same THEN 1 END) AS fn FROM pairs CROSS JOIN bars GROUP BY bar)
    SELECT bar, tp, fp, fn, round(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 6) AS f1 FROM c""",
)
def ev_threshold_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    counts = threshold_counts(rows.filter("vec_id % 50 = 0"), rows, [i / 10 for i in range(1, 10)])
    f1 = F.round(2 * F.col("tp") / F.expr("CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE)"), 6)
    return counts.withColumn("f1", f1)
