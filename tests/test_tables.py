"""Sinks, views, domain parsers and text rules on small inputs."""

import datetime
import hashlib
import re
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import domain as D
from tidemark.functions import text as X
from tidemark.operators import sinks, text_rules
from tidemark.operators.markup import safe_fragment as sanitised
from tidemark.operators.parsers import first_json
from tidemark.plans import all_oracles, all_queries
from tidemark.session import shared_folder


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions_and_upserts(spark, tmp_path):
    frame = lambda *rows: spark.createDataFrame(rows, "k int, v string, t int")
    table = sinks.VersionedTable(spark, f"{tmp_path}/t")
    table.replace(frame((1, "a", 5), (2, "b", 5)))
    old = table.read()
    assert rows_of(table.insert_ignore(frame((2, "x", 9), (3, "c", 1), (3, "c", 1)), ["k"])) == [(1, "a", 5), (2, "b", 5), (3, "c", 1)]
    assert rows_of(old) == [(1, "a", 5), (2, "b", 5)]  # one version back is still there
    assert rows_of(table.update(frame((1, "z", 0)), ["k"])) == [(1, "z", 0), (2, "b", 5), (3, "c", 1)]
    assert rows_of(table.newest_wins(frame((2, "n", 6), (3, "o", 1), (4, "p", 0)), ["k"], "t")) == [(1, "z", 0), (2, "n", 6), (3, "c", 1), (4, "p", 0)]
    assert len(table.versions()) == 2


def test_a_range_replaced_again_leaves_the_same_table(spark, tmp_path):
    hour = lambda d, h: datetime.datetime(2024, 1, d, h)
    path = f"{tmp_path}/hours"
    first = [(hour(d, h), 1) for d in (1, 2, 3, 4) for h in (0, 12)]
    make = lambda rows: spark.createDataFrame(rows, "hour timestamp_ntz, n int")
    sinks.replace_range(make(first), path, "hour", "2024-01-01 00:00:00", "2024-02-01 00:00:00")
    again = make([(hour(1, 12), 7), (hour(3, 0), 9), (hour(4, 12), 99)])
    expected = sorted([(hour(1, 0), 1), (hour(1, 12), 7), (hour(3, 0), 9), (hour(4, 12), 1), (hour(4, 0), 1)])
    for _ in range(2):
        sinks.replace_range(again, path, "hour", "2024-01-01 10:00:00", "2024-01-04 00:00:00")
        assert rows_of(spark.read.schema("hour timestamp_ntz, n int").option("recursiveFileLookup", "true").parquet(path)) == expected


def test_archive_and_backup(spark, tmp_path):
    df = spark.createDataFrame([(i, datetime.datetime(2024, 1 + i % 3, 5)) for i in range(10)], "id int, t timestamp_ntz")
    assert rows_of(sinks.archive(df, f"{tmp_path}/a", "t")) == [("2024-01", 4), ("2024-02", 3), ("2024-03", 3)]
    with pytest.raises(sinks.BackupTooLarge):
        sinks.backup({"x": df}, f"{tmp_path}/b", 100)
    lines = [r[0] for r in df.select(F.to_json(F.struct("*"))).collect()]
    assert rows_of(sinks.backup({"x": df, "y": df.limit(0)}, f"{tmp_path}/b", 10**6)) == [("x", 10, sum(len(x) + 1 for x in lines)), ("y", 0, 0)]
    sums = [r[0] for r in spark.read.text(f"{tmp_path}/b/SHA256SUMS").collect()]
    assert sums and all(len(s.split("  ")[0]) == 64 and s.split("  ")[1].startswith(("x/part-", "y/part-")) for s in sums)


def test_queries_leave_the_views_of_the_session(spark):
    spark.range(3).createOrReplaceTempView("events")
    all_queries()["agg_weekly_trend"](spark, "/root/testdata/sf0.001").count()
    assert spark.table("events").columns == ["id"] and not spark.catalog.tableExists("orders")
    spark.catalog.dropTempView("events")


def test_no_machine_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        conf = {}
        sparkContext = Context()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("USD 1,450 per person", (Decimal(1450), "USD", "per_person", [])),
        ("1.722,50 EUR / group", (Decimal("1722.50"), "EUR", "per_group", [])),
        ("From A$1.290", (Decimal(1290), "AUD", "from", [])),
        ("฿12,000 pp; 2-4 pax ฿10,000 pp", (Decimal(12000), "THB", "per_person", ["several_amounts", "tiered"])),
        ("Price: 1,450 (all in USD)", (Decimal(1450), "USD", "per_person", ["basis_assumed"])),
        ("450 or so", (None, None, None, ["no_currency"])),
        ("ask", (None, None, None, ["no_amount"])),
        (None, (None, None, None, ["no_text"])),
        ("$0 each", (None, None, None, ["no_amount"])),
        ("12.5 dollars each", (Decimal("12.5"), "USD", "per_person", [])),
    ],
)
def test_prices(text, expected):
    assert D.price_of(text) == expected


def test_durations_and_periods(spark):
    texts = ["7 days", "10 DAYS 9 nights", "half-day, HALF DAY", "4-5 hours", "overnight", "90 MIN.", "x", None, "Day trip of 1 day"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(D.duration_days(F.col("t"))).collect()] == [7, 10, 0, 0, 1, 0, None, None, 1]
    periods = {"Mar-May,Sep-Nov": [3, 4, 5, 9, 10, 11], "November - February": [1, 2, 11, 12], "Jul": [7], "all year": [], None: [], "May-Xyz, Jun": [6]}
    df = spark.createDataFrame([(t,) for t in periods], "t string")
    assert {r["t"]: r["m"] for r in df.select("t", D.months_of(F.col("t")).alias("m")).collect()} == periods


def test_day_blocks_and_places(spark):
    text = "Intro\nDay 1 — Drive from Leh to Stok\nRoad.\nOvernight in the Stok Camp near a river.\n\nDays 2 to 4: Sakti to Paro via X—48 Kilometers\nb\nDay 9-2 - Back\nDay 20-40 – Far\nStay at Hotel X."
    df = spark.createDataFrame([(text,)], "t string").select(F.inline(D.day_blocks(F.col("t"))))
    got = [(r["day_from"], r["day_to"], r["title"], tuple(r["p"])) for r in df.select("*", D.day_places(F.col("title"), F.col("body")).alias("p")).collect()]
    assert got == [
        (1, 1, "Drive from Leh to Stok", ("Leh", "Stok", "Stok Camp")),
        (2, 4, "Sakti to Paro via X—48 Kilometers", ("Sakti", "Paro", None)),
        (9, 9, "Back", (None, None, None)),
        (20, 20, "Far", (None, None, "Hotel X")),
    ]


def test_json_replies():
    assert first_json('```json\n{"a": [1, "}"]}\n```\nand {"b": 2}') == '{"a":[1,"}"]}'
    assert first_json("for {n} of [x] see [1, 2]") == "[1,2]"
    assert first_json('{"a": {"b": 1}, ') is None and first_json(None) is None and first_json("no") is None


def test_sentence_offsets_point_into_the_text(spark):
    text = "One two three. \"Four five six!\" One two three.\nShort. One two three? Again one  two."
    got = text_rules.sentences(spark.createDataFrame([(1, text)], "id int, text string"), ["id"]).filter("sentence <> ''").orderBy("pos").collect()
    assert [r["sentence"] for r in got] == ["One two three.", '"Four five six!"', "One two three.", "Short.", "One two three?", "Again one  two."]
    assert all(text[r["start"] : r["start"] + len(r["sentence"])] == r["sentence"] for r in got) and len({r["start"] for r in got}) == len(got)


def test_sanitiser_keeps_what_follows_a_void_element():
    assert sanitised('<p>a</p><embed src="x"><p>hello</p><object><p>b</p></object>c') == "<p>a</p><p>hello</p>c"


def test_injections_go_from_the_whole_text(spark, tmp_path):
    long = "Some words of a turn. " * 40  # 880 characters
    texts = {long + "end one": None, long + "end two": None, long + "Pretend  to be\nx": long + "[redacted] x", " a\t\n b ": "a b", "": "", "say <|a\rb|> <|c\nd|>": "say [redacted] <|c d|>"}
    texts |= {"act as aé": "[redacted]é", "new inſtructions:": "[redacted]", "askİng": "askİng", "ignore\x0bprior instructions": "ignore\x0bprior instructions"}
    rows = [(i, 6, "user", t) for i, t in enumerate(texts)] + [(99, 6, "user", None)]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = rows_of(all_queries()["txt_injection_redact"](spark, str(tmp_path)))
    safe = [re.sub("[ \t\n]+", " ", t).strip() if w is None else w for t, w in texts.items()] + [""]
    assert [(i, s) for i, _, _, s in got] == [(r[0], hashlib.md5(s.encode()).hexdigest()) for r, s in zip(rows, safe, strict=True)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(con.execute(all_oracles()["txt_injection_redact"]).fetchall())


def test_dashes(spark):
    cases = {"Day 1 — A — B\nopen 2—4 now — or later — ok": "Day 1: A, B\nopen 2–4 now: or later, ok", "Day 1 — To: X\nDay 2 — Y": "Day 1 · To: X\nDay 2 · Y", "plain": "plain"}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r["t"]: r["d"] for r in df.select("t", text_rules.without_em_dashes(F.col("t")).alias("d")).collect()} == cases


def test_folding_goes_by_unicode():
    assert len(X.ACCENTED) == len(X.PLAIN) > 250
    for letter, plain in zip("éñøłđçğıőşžạ", "enoldcgiosza", strict=True):
        assert dict(zip(X.ACCENTED, X.PLAIN, strict=True)).get(letter, X.LIGATURES.get(letter)) == plain
