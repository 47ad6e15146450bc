"""Distances on the sphere, names of a dictionary, markup and leases against plain Python."""

import math
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import dictionary, geo, markup
from tidemark.plans import all_queries
from tidemark.streaming.rollups import LEASE_MINUTES, MOST_ATTEMPTS, reaped, rocksdb_state, run_available


def _km(a, b):
    half = lambda x, y: math.sin(math.radians(y - x) / 2) ** 2
    return 2 * geo.RADIUS * math.asin(math.sqrt(min(1, half(a[0], b[0]) + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * half(a[1], b[1]))))


@pytest.fixture(scope="module")
def places(spark):
    rng = random.Random(2)
    at = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(150)]
    at += [(rng.choice([-1, 1]) * rng.uniform(88, 90), rng.uniform(-180, 180)) for _ in range(60)]  # about the poles
    at += [(rng.uniform(-5, 5), rng.choice([-1, 1]) * rng.uniform(179, 180)) for _ in range(60)]  # at the date line
    at += [(90.0, 0.0), (-90.0, 10.0), (0.0, 180.0), (0.0, -180.0), (0.0, 0.0), (0.0, 0.0)]
    rows = [(i, i % 7 if i < 270 else 99 + i, lat, lng) for i, (lat, lng) in enumerate(at)]
    return rows, spark.createDataFrame(rows, "id bigint, country int, lat double, lng double")


@pytest.mark.parametrize("km", [0.0, 25.0, 300.0, 2500.0, 9000.0, 20_100.0])
def test_pairs_within_a_radius_by_all_pairs(places, km):
    rows, frame = places
    expected = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and _km(a[2:], b[2:]) <= km}
    got = [(r["id_a"], r["id_b"]) for r in geo.within(frame, frame, km).collect()]
    assert len(got) == len(set(got))
    edge = {p for p in expected ^ set(got) if abs(_km(rows[p[0]][2:], rows[p[1]][2:]) - km) > 1e-6}
    assert not edge and len(set(got)) >= len(expected) - 5


@pytest.mark.parametrize("km", [0.0, 25.0, 300.0, 2500.0, 9000.0, 20_100.0])
def test_pairs_meet_once_with_their_columns(places, km):
    rows, frame = places
    expected = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and _km(a[2:], b[2:]) <= km}
    got = geo.pairs_within(frame, km, ("country",)).collect()
    pairs = [tuple(sorted((r["id_a"], r["id_b"]))) for r in got]
    assert len(pairs) == len(set(pairs)) and all((r["country_a"], r["country_b"]) == (rows[r["id_a"]][1], rows[r["id_b"]][1]) for r in got)
    edge = {p for p in expected ^ set(pairs) if abs(_km(rows[p[0]][2:], rows[p[1]][2:]) - km) > 1e-6}
    assert not edge and len(pairs) >= len(expected) - 5


@pytest.mark.parametrize("name", ["jn_pairs_distance", "gr_junctions"])
def test_places_are_not_broadcast(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")  # files are small, their rows need not be
    try:
        plan = all_queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_nearest_or_same_country_by_all_pairs(spark, places):
    rows, frame = places
    got = {r["id"]: (r["other"], r["level"]) for r in geo.nearest_or_same_country(frame, 25.0).collect()}
    for i, country, *at in rows:
        near = [(round(_km(at, b[2:]), 3), b[0]) for b in rows if b[0] != i and _km(at, b[2:]) <= 25]
        same = [(round(_km(at, b[2:]), 3), b[0]) for b in rows if b[0] != i and b[1] == country]
        assert got[i] == ((min(near)[1], "near") if near else (min(same)[1], "country") if same else (None, None))
    assert geo.nearest_or_same_country(frame.limit(0), 25.0).count() == 0


def test_names_are_the_leftmost_longest(spark):
    table = spark.createDataFrame([("Viet Nam", "VN"), ("North Korea", "KP"), ("Korea", "KR"), ("Côte d'Ivoire", "CI"), ("St. Lucia", "LC"), ("new zealand north", "NZ"), ("New Zealand", "NZ0"), ("Oman", "OM"), ("korea", "A"), ("that", "X"), ("abc", "Y")], "spelling string, name string")
    texts = ["Viet-Nam and  north\nkorea; koreas, Korea.", "in cÔte D'ivoire or St. Lucia, st.lucia", "new zealand north korea", "womans oman Romany oman2 ÉOman", "that abc", "", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = lambda case: {i: [r["name"] for r in sorted(dictionary.named(frame, table, ["that"], case).filter(F.col("id") == i).collect(), key=lambda r: r["place"])] for i in range(len(texts))}
    assert found(False) == {0: ["VN", "KP", "A"], 1: ["CI", "LC"], 2: ["NZ", "A"], 3: ["OM", "OM"], 4: [], 5: [], 6: []}
    assert found(True) == {0: ["KR"], 1: ["LC"], 2: [], 3: ["OM"], 4: [], 5: [], 6: []}
    assert dictionary.named(frame, table.limit(0)).count() == 0


def test_proper_names_in_parts(spark, monkeypatch):
    table = spark.createDataFrame([("New York", "a"), ("New", "b"), ("York City", "c"), ("City Hall", "d"), ("Hall", "e")], "spelling string, name string")
    frame = spark.createDataFrame([(1, "New York City Hall, new york"), (2, "York City Hall"), (3, None)], "id int, text string")
    held = lambda: sorted(map(tuple, dictionary.named(frame, table, case=True).collect()))
    whole = held()
    assert whole == [(1, 0, "a"), (1, 2, "d"), (2, 0, "c"), (2, 2, "e")]
    monkeypatch.setattr(dictionary, "SENT", 1)
    assert held() == whole


def test_texts_are_not_shuffled_for_their_names(spark, monkeypatch):
    words = [f"word{i}" for i in range(400)]
    table = spark.createDataFrame([(" ".join(words[i : i + 1 + i % 7]), f"n{i}") for i in range(0, 400, 9)], "spelling string, name string")
    frame = spark.createDataFrame([(i, " ".join(words[i % 50 :])) for i in range(60)], "id int, text string")
    held = lambda: sorted(map(tuple, dictionary.named(frame, table).collect()))
    whole = held()
    monkeypatch.setattr(dictionary, "SENT", 10)  # in parts
    assert held() == whole and len(whole) == sum(len(range(-(-(i % 50) // 9) * 9, 400, 9)) for i in range(60))
    monkeypatch.undo()
    plan = dictionary.named(frame, table)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan



def test_names_by_a_plain_alternation(spark):
    rng = random.Random(5)
    words = ["ab", "abc", "b-c", "cd", "d.", "é", "a1"]
    spelt = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(60)}
    texts = [rng.choice(["", " ", ", "]).join([rng.choice(words) + rng.choice([" ", "  ", ", ", "-"]) for _ in range(40)]) for _ in range(40)]
    flat = lambda t: " ".join(t.lower().replace("-", " ").split())
    names = {flat(s): flat(s) for s in spelt if len(flat(s)) >= 4}
    # a spelling that begins or ends with another sign needs no edge of a word there
    pattern = re.compile(r"(?<![a-z0-9])(?:" + "|".join(re.escape(w) for w in sorted(names, key=lambda w: (-len(w), w)) if w[0].isascii() and w[0].isalnum()) + r")(?![a-z0-9])")
    table = spark.createDataFrame([(s, flat(s)) for s in spelt if flat(s)[0].isascii()], "spelling string, name string")
    got = {}
    for r in dictionary.named(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), table).collect():
        got.setdefault(r["id"], []).append((r["place"], r["name"]))
    assert {i: [n for _, n in sorted(v)] for i, v in got.items()} == {i: f for i, t in enumerate(texts) if (f := pattern.findall(flat(t)))}


@pytest.mark.parametrize(
    ("page", "clean"),
    [
        ('<p onclick="x">a<script>b</script><a href="java\tscript:x">c', "<p>a<a>c</a></p>"),
        ('<a href=" https://x.y/?a=1&b=2 " title=\'t"\'>z</a>', '<a href="https://x.y/?a=1&amp;b=2" title="t&quot;">z</a>'),
        ("a < b > c & d &amp; &#x41;", "a &lt; b &gt; c &amp; d &amp; &#x41;"),
        ('<td style="text-align: left;" class=x>1<br/>', '<td style="text-align: left;">1<br /></td>'),
        ("<b><i>x</b>y</i>", "<b><i>x</i></b>y"),
        ("<!-- c --><!doctype html><P>x<blink>y</blink><!-- un", "<p>xy</p>"),
        ("t<svg/>u<form><form>a</form>b</form>c<meta x>d", "tucd"),
        ('<a href="data:text/html,x">1</a><a href="#a:b">2</a>', '<a>1</a><a href="#a:b">2</a>'),
        ("", ""),
        (None, None),
    ],
)
def test_safe_fragments(page, clean):
    assert markup.safe_fragment(page) == clean and markup.safe_fragment(clean) == clean


def test_markup_of_random_pieces_is_safe_and_stays():
    rng = random.Random(7)
    parts = ["<", ">", "</", "b", "script", "p", "div", " ", "x", "<b>", "</b>", "<script>", "</script>", "<!--", "-->", '"', "href=", "&", "/", "style", "<a href='javascript:1'>", "on=1", "é"]
    tags = re.compile(r"<(/?)([a-z][^\s/>]*)[^>]*>")
    for _ in range(4000):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        clean = markup.safe_fragment(page)
        opened = []
        for end, tag in tags.findall(clean):
            assert tag in markup.ALLOWED
            if end:
                assert opened.pop() == tag
            elif tag not in markup.VOID:
                opened.append(tag)
        assert not opened and "javascript" not in clean and markup.safe_fragment(clean) == clean
        text = markup.plain(page)
        assert not markup._TAG.search(text) and markup.plain(text) == text


def test_plain_text_keeps_signs_and_forms_no_tag():
    cases = {"a < b > c": "a < b > c", "<scr<b>ipt>x</script>y": "y", "<<b>i>x": "x", "1<2 and 3>2": "1<2 and 3>2", "<style>never": "", "a<!-- x -->b": "ab", "see javascript: x": "see blocked: x", "<?php x ?>y": "y"}
    assert {k: markup.plain(k) for k in cases} == cases and markup.plain(None) is None
    assert len(markup.plain("<a " * 200_000)) == 600_000


def test_leases_run_out_without_a_further_row(spark, tmp_path):
    """Job 1 is claimed and never heard of again; 2 renews in time and is done; 3 fails after its last attempt; 4 still runs."""
    lease, start = LEASE_MINUTES * 60_000, 1_700_000_000_000
    rows = [(1, 0, False), (2, 0, False), (2, lease, False), (2, lease + 5, True), *[(3, i * (lease + 1000), False) for i in range(MOST_ATTEMPTS + 1)], (4, 0, True), (9, 9 * lease, True), (4, 9 * lease - 1000, False)]
    for number, low in enumerate((0, 1)):  # two batches: the watermark of the first lets leases run out in the second
        part = [(job, start + ms, done) for job, ms, done in rows if (ms > 2 * lease) == bool(low)]
        frame = spark.createDataFrame(pd.DataFrame(part, columns=["job", "ms", "done"]), "job bigint, ms bigint, done boolean")
        frame.withColumn("ts", F.timestamp_millis("ms")).coalesce(1).write.parquet(f"{tmp_path}/in/{number}")
    stream = spark.readStream.schema("job bigint, ms bigint, done boolean, ts timestamp").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with rocksdb_state(spark):
        got = sorted((r["job"], r["expired_ms"] - start, r["attempt"], r["status"]) for r in run_available(reaped(stream.withWatermark("ts", "1 minute")), "append").collect())
    third = [(3, i * (lease + 1000) + lease, i % MOST_ATTEMPTS + 1, "failed" if i % MOST_ATTEMPTS == MOST_ATTEMPTS - 1 else "queued") for i in range(MOST_ATTEMPTS + 1)]
    assert got == [(1, lease, 1, "queued"), *third]


def test_zones_by_rules_and_nearest_points(spark):
    rows = [("ID", 0.0, 130.0), ("us", 40.7, -74.0), ("US", 21.3, -157.8), ("RU", 43.1, 131.9), ("PT", 37.7, -25.7), ("DE", None, None), ("XX", 1.0, 1.0), (None, 1.0, 1.0), ("NZ", -43.9, -176.5)]
    made = geo.with_zone(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, code string, lat double, lng double"), geo.zone_points(spark))
    assert [r["zone"] for r in made.orderBy("id").collect()] == [
        "Asia/Jayapura", "America/New_York", "Pacific/Honolulu", "Asia/Vladivostok", "Atlantic/Azores", "Europe/Berlin", None, None, "Pacific/Chatham",
    ]
