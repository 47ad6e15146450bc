"""General operators on small frames, and the catalogue as a whole."""

import datetime
import math
import random
from collections import Counter, defaultdict
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators.aggregates import BOUNDS, bin_of, histogram, histogram_percentile
from tidemark.operators.evaluation import sign_p
from tidemark.operators.joins import asof_join, latest_per_key, reconcile
from tidemark.operators.predicates import all_of, keyset_page
from tidemark.operators.markup import safe_fragment
from tidemark.operators.text import near_duplicate_pairs
from tidemark.operators.windows import exact_percentiles, nearest, running
from tidemark.plans import all_oracles, all_queries


def test_every_oracle_has_a_query():
    assert set(all_oracles()) <= set(all_queries())


@pytest.mark.parametrize(("forward", "strict", "expected"), [(True, False, [1, 2, None]), (True, True, [2, None, None]), (False, False, [1, 2, 2]), (False, True, [None, 1, 2])])
def test_asof_join_at_equal_times(spark, forward, strict, expected):
    left = spark.createDataFrame([("a", 10), ("a", 20), ("a", 30)], "k string, t int")
    right = spark.createDataFrame([("a", 10, 1), ("a", 20, 2), ("b", 25, 9)], "k string, t int, v int")
    got = {r["t"]: r["v_asof"] for r in asof_join(left, right, "k", "t", "v", forward, strict).collect()}
    assert [got[t] for t in (10, 20, 30)] == expected


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("strict", [True, False])
def test_asof_join_in_pieces_of_the_time_line(spark, forward, strict):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.randint(0, 60)) for _ in range(80)]
    marks = [(rng.choice("ab"), t, 100 + t) for t in rng.sample(range(60), 12)]
    left = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "i int, k string, t int")
    right = spark.createDataFrame(marks, "k string, t int, v int")
    got = {r["i"]: r["v_asof"] for r in asof_join(left, right, "k", "t", "v", forward, strict, bucket=F.floor(F.col("t") / 7)).collect()}
    for i, (k, t) in enumerate(rows):
        seen = [(abs(m - t), v) for key, m, v in marks if key == k and ((m > t if forward else m < t) or (m == t and not strict))]
        assert got[i] == (min(seen)[1] if seen else None)


def test_exact_percentiles(spark):
    values = {"a": [1.0, 1.0, 2.5, 9.0], None: [3.0], "c": [float(x % 13) for x in range(101)]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in [*vs, None]], "k string, v double")
    got = {r["k"]: (r["p50"], r["p95"]) for r in exact_percentiles(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert got.keys() == values.keys()
    for k, vs in values.items():
        assert np.allclose(got[k], np.percentile(vs, [50, 95]))
    whole = exact_percentiles(df, [], "v", {"p": 0.25}).collect()
    assert len(whole) == 1 and np.isclose(whole[0]["p"], np.percentile(sum(values.values(), []), 25))


def test_reconcile_takes_nulls_as_equal(spark):
    a = spark.createDataFrame([(1, None), (2, 5), (3, 1)], "k int, v int")
    b = spark.createDataFrame([(1, None), (2, 6), (4, 1)], "k int, v int")
    assert sorted(r["k"] for r in reconcile(a, b, ["k"], ["v"]).collect()) == [2, 3, 4]


def test_latest_per_key(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "k string, v int")
    assert sorted((r["k"], r["v"]) for r in latest_per_key(df, ["k"], [F.desc("v")]).collect()) == [("a", 3), ("b", 2)]


def test_histogram_counts_all_and_its_percentile_is_bounded(spark):
    df = spark.createDataFrame([(float(v),) for v in range(100)], "value double")
    row = df.agg(histogram(F.col("value")).alias("hist"))
    assert sum(row.first()["hist"]) == 100
    assert 40 <= histogram_percentile(row, [], 0.5).first()["p"] <= 60
    assert df.select(F.max(bin_of(F.col("value"))).alias("m")).first()["m"] == len(BOUNDS)


def test_keyset_page_and_filters(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 1)], "a int, b int")
    assert [tuple(r) for r in keyset_page(df, ["a", "b"], [1, 1], 2).collect()] == [(1, 2), (2, 1)]
    assert all_of(df, {"x": F.col("a") > 1, "y": None}).count() == 2


def test_shingles_and_jaccard(spark):
    df = spark.createDataFrame([("a b c d", "b c d e"), ("a", "a")], "x string, y string")
    s = [X.shingles(X.words(F.col(c)), 2) for c in ("x", "y")]
    got = [r[0] for r in df.select(X.jaccard(*s)).collect()]
    assert got == [0.5, None]


def test_near_duplicate_pairs_match_brute_force(spark):
    import itertools

    rng = random.Random(3)
    rows = [(i, "b", rng.sample("abcdefgh", 5), rng.sample("abcdefghijkl", 9)) for i in range(25)]
    df = spark.createDataFrame(rows, "id bigint, block string, name array<string>, body array<string>")
    j = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    expected = {(max(p[0], q[0]), min(p[0], q[0])) for p, q in itertools.combinations(rows, 2) if j(p[2], q[2]) >= 0.6 or j(p[3], q[3]) >= 0.9}
    assert {(r["a"], r["b"]) for r in near_duplicate_pairs(df).collect()} == expected


def test_nearest_is_exact(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(30)], "vec_id bigint, embedding array<float>")
    got = nearest(rows.filter("vec_id = 3"), rows, 3).collect()
    assert len(got) == 3 and all(r["neighbour"] != 3 for r in got)
    assert nearest(rows.filter("vec_id < 0"), rows, 3).count() == 0


def test_sanitiser():
    assert safe_fragment('<p onclick="x">a<script>b</script><a href="javascript:x">c') == "<p>a<a>c</a></p>"
    assert safe_fragment(None) is None


def test_sign_test_keeps_every_source(spark):
    assert sign_p(0, 0) is None
    for a, b in [(0, 1), (7, 1), (20, 40), (990, 1100), (2000, 1), (3000, 3000), (5200, 5000)]:
        exact = min(1.0, 2 * sum(math.comb(a + b, i) for i in range(min(a, b) + 1)) / 2 ** (a + b))
        assert math.isclose(sign_p(a, b), exact, rel_tol=1e-8)
    for sf in ("sf0.001", "sf0.1"):
        base = f"/root/testdata/{sf}"
        rows = spark.read.parquet(f"{base}/documents.parquet").join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").collect()
        more, less = (Counter(r["source"] for r in rows if (r["n_chars"] > 600, r["quality"] == 1) == way) for way in ((True, False), (False, True)))
        expected = {s: (more[s], less[s]) for s in {r["source"] for r in rows}}
        got = all_queries()["ev_sign_test"](spark, base).collect()
        assert {r["source"]: (r["a"], r["b"]) for r in got} == expected
        assert all(r["p"] is None if not r["a"] + r["b"] else math.isclose(r["p"], sign_p(r["a"], r["b"]), abs_tol=1e-6) for r in got)


def test_seed_takes_all_users_and_the_last_30_days(spark, tmp_path):
    rows = [(datetime.datetime(2025, 3, 1 + i % 31, i % 24), i % 13, "ab"[i % 2], float(i % 97) + 0.25) for i in range(700)]
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame(rows, "ts timestamp_ntz, user_id bigint, event_type string, value double").write.parquet(path)
    spent = defaultdict(Decimal)
    for ts, _, kind, value in rows:
        spent[kind, ts.date()] += Decimal(str(value)).quantize(Decimal("0.01"), ROUND_HALF_UP)
    end = max(r[0] for r in rows).date()
    expected = {}
    for kind in "ab":
        daily = sorted(float(spent[kind, end - datetime.timedelta(i)]) for i in range(1, 31))
        at = 0.95 * 29
        low = int(at)
        expected[kind] = (daily[low] + (at - low) * (daily[low + 1] - daily[low])) * 1.5
    got = {r["event_type"]: r["seed"] for r in all_queries()["agg_seed_p95x1_5"](spark, str(tmp_path)).collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 0.006 for k in got)


def test_running_sums_go_over_partitions(spark):
    rows = [(i * 37 % 101, i) for i in range(101)]
    got = running(spark.createDataFrame(rows, "k bigint, v bigint"), ["k"], F.col("v"), "before").collect()
    assert {r["k"]: r["before"] for r in got} == {k: sum(v for x, v in rows if x < k) for k, _ in rows}


@pytest.mark.parametrize("name", ["win_round_robin", "top_priority_buckets", "ev_quota_picks"])
def test_no_task_numbers_all_rows(spark, name):
    plan = all_queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "hashpartitioning(bucket" not in plan
