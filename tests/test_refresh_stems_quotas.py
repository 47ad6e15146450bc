"""Refreshed results, stems, quota plans and the rank of near duplicates on small tables against plain Python."""

import math
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import evaluation, refresh, stems, text

SIZED = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.IntegerType())])


def test_a_refresh_computes_what_changed_and_writes_its_buckets(spark, tmp_path):
    asked = []

    def sized(rows):
        asked.append(sorted(r["k"] for r in rows.collect()))
        return rows.select("k", F.length(F.coalesce("t", F.lit(""))).alias("n"))

    frame = lambda rows: spark.createDataFrame(rows, "k string, t string")
    table = refresh.Refreshed(spark, f"{tmp_path}/results", SIZED, "v1", buckets=8)
    first = [(f"k{i}", "x" * i) for i in range(30)] + [("none", None)]
    assert table.refresh(frame(first), "t", sized)["computed"] == 31
    files = {p.name: {f.name for f in p.glob("part-*")} for p in tmp_path.glob("results/bucket=*")}
    assert table.refresh(frame(first), "t", sized) == {"computed": 0, "removed": 0, "buckets": 0}
    later = [*first[:-2], ("k29", "changed"), ("new", "y")]
    done = table.refresh(frame(later), "t", sized)
    assert done["computed"] == 2 and done["removed"] == 1 and done["buckets"] <= 3 and asked[1] == ["k29", "new"]
    assert {r["k"]: r["n"] for r in table.read().collect()} == {k: len(t or "") for k, t in later}
    now = {p.name: {f.name for f in p.glob("part-*")} for p in tmp_path.glob("results/bucket=*")}
    assert sum(now[b] == files[b] for b in files if b in now) >= len(files) - 3  # other buckets keep their files
    again = refresh.Refreshed(spark, f"{tmp_path}/results", SIZED, "v2", buckets=8)
    assert again.refresh(frame(later), "t", sized)["computed"] == len(later)  # a new version of the rule
    assert again.refresh(frame([]), "t", sized)["removed"] == len(later) and again.read().count() == 0


def test_stems_without_support(spark):
    table = spark.createDataFrame([("trek", "trek"), ("hike", "trek"), ("spa", "spa"), ("game drive", "game drive"), ("cooking", "cooking")], "stem string, name string")
    roots = spark.createDataFrame([("cook", "cooking")], "root string, name string")
    texts = spark.createDataFrame([(1, "Trekking to the spa"), (2, "Spain, a GAME  drives day"), (3, "hikers cooking"), (4, None), (5, "a hîked trek, game, drive")], "id int, text string")
    sources = spark.createDataFrame([(1, "short hike"), (2, "game drive"), (3, "cooks here"), (5, "")], "id int, text string")
    got = sorted((r["id"], r["name"]) for r in stems.unsupported(texts, sources, table, roots, ["id"]).collect())
    assert got == [(1, "spa"), (3, "trek"), (5, "game drive"), (5, "trek")]
    assert stems.uses(texts, table.limit(0), ["id"]).count() == 0


def test_support_is_grouped_and_sends_no_uses_to_the_tasks(spark):
    rows = spark.createDataFrame([(1, "thinning ment"), (2, "then that")], "id int, text string")
    table, roots = spark.createDataFrame([("thin", "thin"), ("that", "that")], "stem string, name string"), spark.createDataFrame([("then", "that")], "root string, name string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        found = stems.unsupported(rows, rows.withColumn("text", F.lit("then")), table, roots, ["id"])
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert [tuple(r) for r in found.collect()] == [(1, "thin")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "LeftAnti" not in plan and plan.count("BroadcastExchange") <= 2  # the stems alone


def test_quota_plans_by_a_plain_round_robin(spark):
    rng = random.Random(1)
    rows = [(f"w{i % 3}", rng.choice([None, "a", "b", "c"]), i, rng.random() < 0.2) for i in range(90)]
    frame = spark.createDataFrame(rows, "writer string, grp string, id int, taken boolean")
    for target, cap in ((60, 3), (10_000, None), (5, 2)):
        got = {r["writer"]: (r["have"], r["need"], r["picks"], r["missing"], r["missing_cost"]) for r in evaluation.quota_picks(frame, target, 4, 0.3, cap).collect()}
        for w in ("w0", "w1", "w2"):
            have = sum(t for x, _, _, t in rows if x == w) * 4
            need = math.ceil(max(0, target - have) / 4)
            groups = {g: [i for x, y, i, t in rows if x == w and y == g and not t][:cap] for g in "abc"}
            order = [groups[g][d] for d in range(90) for g in "abc" if d < len(groups[g])][:need]
            assert got[w] == (have, need, ",".join(map(str, order)), need - len(order), round((need - len(order)) * 0.3, 2))


def test_a_live_duplicate_comes_before_a_deleted_one(spark):
    name, body = list("abcde"), [f"t{i}" for i in range(20)]
    rows = [
        (1, "x", name, body, 5, True), (2, "x", name, body[:19], 5, False), (3, "x", name, body, 5, False), (4, "x", name, body, 6, False), (5, "x", name, body, None, False),
        (6, "y", name, body, 5, True), (7, "y", name, body, 5, False), (8, "y", list("abcdf"), body[:5], 5, False),
    ]
    frame = spark.createDataFrame(rows, "id bigint, block string, name array<string>, body array<string>, days int, deleted boolean")
    got = {r["a"]: (r["kind"], r["match"], r["deleted"]) for r in text.best_match(text.near_duplicate_pairs(frame)).collect()}
    assert got == {2: ("duplicate", 1, True), 3: ("duplicate", 2, False), 4: ("variant", 3, False), 5: ("duplicate", 3, False), 7: ("duplicate", 6, True), 8: ("variant", 7, False)}
