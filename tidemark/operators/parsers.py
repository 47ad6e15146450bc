"""Domain parsers and reply readers over inputs of the real shape.

The base tables hold no tours, so each query first writes tour texts out of columns (a duration phrase, an itinerary, a
price) and then parses them. The oracles do not parse: they answer from the columns that the text was written from.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import domain as D
from tidemark.plans.registry import frame, query, sql

_MON = lambda n: f"substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(3 * ({n}) + 1 AS INT), 3)"
_TOWN = lambda n: f"split_part('Leh,Stok,Sakti,Paro,Thimphu,Gyantse,Kandy,Ella', ',', CAST(({n}) % 8 + 1 AS INT))"

_DURATIONS = """SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN concat(p_size, ' days') WHEN 1 THEN concat(p_size, ' Days ', p_size - 1, ' Nights') WHEN 2 THEN 'HALF DAY TOUR'
    WHEN 3 THEN concat('Total time: ', p_size, ' hours') WHEN 4 THEN 'Same day return' WHEN 5 THEN 'OVERNIGHT trip' WHEN 6 THEN concat(p_size, ' min.') WHEN 7 THEN 'on request' END AS duration FROM part"""


@query("fn_parse_duration", "SELECT p_partkey, CASE WHEN p_partkey % 9 < 2 THEN p_size WHEN p_partkey % 9 IN (2, 3, 4, 6) THEN 0 WHEN p_partkey % 9 = 5 THEN 1 END AS days FROM part")
def fn_parse_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, _DURATIONS).select("p_partkey", D.duration_days(F.col("duration")).alias("days"))


_SPAN = "c_custkey % 12 AS a, (c_custkey + c_nationkey) % 12 AS b, (c_custkey * 5) % 12 AS c"


@query(
    "fn_parse_period",
    f"""WITH k AS (SELECT c_custkey, {_SPAN}, c_custkey % 5 AS shape FROM customer), m AS (SELECT unnest(generate_series(0, 11)) AS m)
    SELECT c_custkey, coalesce(string_agg(CAST(m + 1 AS VARCHAR), ',' ORDER BY m) FILTER (WHERE (shape = 0 AND m = a) OR (shape IN (1, 2) AND (m - a + 12) % 12 <= (b - a + 12) % 12) OR (shape = 2 AND m = c)), '') AS months
    FROM k, m GROUP BY c_custkey""",
)
def fn_parse_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = f"CASE c_custkey % 5 WHEN 0 THEN {_MON('a')} WHEN 1 THEN concat({_MON('a')}, '-', {_MON('b')}) WHEN 2 THEN concat({_MON('a')}, ' - ', {_MON('b')}, ', ', {_MON('c')}) WHEN 3 THEN 'all year' END"
    rows = frame(spark, sf_dir, f"SELECT c_custkey, {text} AS period FROM (SELECT *, {_SPAN} FROM customer) k")
    return rows.select("c_custkey", F.array_join(D.months_of(F.col("period")).cast("array<string>"), ",").alias("months"))


@query(
    "fn_stage_band",
    """SELECT o_orderkey, CASE o_orderkey % 3
        WHEN 0 THEN CASE WHEN d < 3 THEN 'TOFU' WHEN d <= 4.5 THEN 'BOFU' WHEN d <= 7.5 THEN 'MOFU' WHEN d <= 13.5 THEN 'TOFU' ELSE 'OFF' END
        WHEN 1 THEN CASE WHEN d < 6 THEN 'TOFU' WHEN d <= 9 THEN 'BOFU' WHEN d <= 15 THEN 'MOFU' WHEN d <= 27 THEN 'TOFU' ELSE 'OFF' END
        ELSE CASE WHEN d < 0.5 THEN 'TOFU' WHEN d <= 1.25 THEN 'BOFU' WHEN d <= 2.75 THEN 'MOFU' WHEN d <= 5.75 THEN 'TOFU' ELSE 'OFF' END END AS band
    FROM (SELECT o_orderkey, o_custkey % 32 AS d FROM orders) t""",
)
def fn_stage_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "SELECT o_orderkey, CAST(o_custkey % 32 AS DOUBLE) AS d, CASE o_orderkey % 3 WHEN 0 THEN 'long_haul' WHEN 1 THEN 'family_extended' ELSE 'short_haul' END AS kind FROM orders")
    least, most = (D.lookup({k: v[i] for k, v in D.RUNWAY.items()}, F.col("kind")) for i in (0, 1))
    return rows.select("o_orderkey", D.stage_of(F.col("d"), least, most).alias("band"))


_TRIPS = f"""SELECT concat('D', p_partkey % 40) AS destination, p_partkey % 7 <> 0 AS served, concat(p_size, ' days') AS duration,
    CASE WHEN p_partkey % 11 = 0 THEN 'A walk for FAMILIES' ELSE 'A walk' END AS itinerary,
    CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE concat({_MON('first')}, '-', {_MON('(first + p_partkey % 3) % 12')}) END AS period
    FROM (SELECT *, (p_partkey % 40 + 6 * (p_partkey % 2)) % 12 AS first FROM part) t"""


def runway_map(trips: DataFrame, markets: list[str]) -> DataFrame:
    """destination, market, month, stage: trips not served or without a period stay out; a season starts in a month whose
    month before is no travel month; a destination's bounds are the widest of its trips'."""
    good = trips.filter(F.col("served") & F.col("period").isNotNull()).withColumn("months", D.months_of(F.col("period"))).filter(F.size("months") > 0)
    split = good.withColumn("market", F.explode(F.array(*map(F.lit, markets))))
    least, most = D.runway_bounds(F.col("market"), F.col("itinerary"), F.col("duration"))
    bounds = split.groupBy("destination", "market").agg(F.min(least).alias("least"), F.max(most).alias("most"), F.array_distinct(F.flatten(F.collect_set("months"))).alias("months"))
    before = F.filter("months", lambda m: ~F.array_contains(F.col("months"), F.pmod(m - 2, F.lit(12)) + 1))
    starts = bounds.withColumn("starts", F.when(F.size(before) > 0, before).otherwise(F.col("months"))).withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    distance = F.array_min(F.transform("starts", lambda s: F.pmod(s - F.col("month"), F.lit(12)))).cast("double")
    return starts.select("destination", "market", "month", D.stage_of(distance, F.col("least"), F.col("most")).alias("stage"))


@query(
    "fn_runway_map",
    """WITH t AS (SELECT p_partkey % 40 AS d, (p_partkey % 40 + 6 * (p_partkey % 2)) % 12 AS first, p_partkey % 3 AS more, p_partkey % 11 = 0 OR p_size >= 14 AS fam FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 5 <> 0),
    twelve AS (SELECT unnest(generate_series(0, 11)) AS m), k AS (SELECT unnest(['US', 'UK', 'SG', 'JP']) AS market),
    travel AS (SELECT DISTINCT d, m FROM t, twelve WHERE (m - first + 12) % 12 <= more),
    starting AS (SELECT d, m FROM travel x WHERE NOT EXISTS (SELECT 1 FROM travel y WHERE y.d = x.d AND y.m = (x.m + 11) % 12)),
    starts AS (SELECT * FROM starting UNION ALL SELECT * FROM travel WHERE d NOT IN (SELECT d FROM starting)),
    b AS (SELECT d, market, min(CASE WHEN market IN ('SG', 'JP') THEN 0.5 WHEN fam THEN 6 ELSE 3 END) AS lo, max(CASE WHEN market IN ('SG', 'JP') THEN 2 WHEN fam THEN 12 ELSE 6 END) AS hi FROM t, k GROUP BY d, market),
    x AS (SELECT b.d, market, lo, hi - lo AS w, twelve.m + 1 AS month, min((starts.m - twelve.m + 12) % 12) AS dist FROM b JOIN starts ON starts.d = b.d, twelve GROUP BY b.d, market, lo, hi, twelve.m)
    SELECT concat('D', d) AS destination, market, CAST(month AS INT) AS month,
        CASE WHEN dist < lo THEN 'TOFU' WHEN dist <= lo + w / 2 THEN 'BOFU' WHEN dist <= lo + 1.5 * w THEN 'MOFU' WHEN dist <= lo + 3.5 * w THEN 'TOFU' ELSE 'OFF' END AS stage FROM x""",
)
def fn_runway_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runway_map(frame(spark, sf_dir, _TRIPS), ["US", "UK", "SG", "JP"])


# itineraries: one line item is one day block

_LINES = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k FROM lineitem"
_ITINERARIES = f"""SELECT l_orderkey, concat('Intro text.\\n', array_join(transform(array_sort(collect_list(struct(k, line))), x -> x.line), '\\n')) AS text FROM (
    SELECT l_orderkey, k, concat(CASE l_partkey % 4
        WHEN 0 THEN concat('Day ', k, ' — Drive from ', {_TOWN('l_partkey')}, ' to ', {_TOWN('l_suppkey')}, '\\nA long road. Overnight stay in ', {_TOWN('l_suppkey')}, ' with dinner.')
        WHEN 1 THEN concat('Days ', k, '-', k + 2, ': ', {_TOWN('l_partkey')}, ' to ', {_TOWN('l_suppkey')}, ' via Alchi—48 km\\n\\nWe stay in the ', {_TOWN('l_quantity')}, '.')
        WHEN 2 THEN concat('  DAY ', k, ' - Rest\\nFree day in town; day trip possible\\n')
        ELSE concat('Day ', k + 1, ' to ', k, ' – Trek\\nNight in a camp near the pass.') END, '\\n') AS line FROM ({_LINES}) l) t GROUP BY l_orderkey"""
_BLOCK = f"""CASE l_partkey % 4 WHEN 0 THEN concat('Drive from ', {_TOWN('l_partkey')}, ' to ', {_TOWN('l_suppkey')}) WHEN 1 THEN concat({_TOWN('l_partkey')}, ' to ', {_TOWN('l_suppkey')}, ' via Alchi—48 km') WHEN 2 THEN 'Rest' ELSE 'Trek' END AS title,
    CAST(k + CASE WHEN l_partkey % 4 = 3 THEN 1 ELSE 0 END AS INT) AS day_from"""


def itinerary_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, _ITINERARIES).select("l_orderkey", F.inline(D.day_blocks(F.col("text"))))


@query(
    "fn_parse_days",
    f"""SELECT l_orderkey, {_BLOCK}, CAST(k + CASE l_partkey % 4 WHEN 1 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS INT) AS day_to,
    CASE l_partkey % 4 WHEN 0 THEN concat('A long road. Overnight stay in ', {_TOWN('l_suppkey')}, ' with dinner.') WHEN 1 THEN concat('We stay in the ', {_TOWN('l_quantity')}, '.') WHEN 2 THEN 'Free day in town; day trip possible' ELSE 'Night in a camp near the pass.' END AS body FROM ({_LINES}) t""",
)
def fn_parse_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itinerary_days(spark, sf_dir).select("l_orderkey", "day_from", "day_to", "title", "body")


@query(
    "fn_rule_day",
    f"""SELECT l_orderkey, {_BLOCK}, CASE WHEN l_partkey % 4 < 2 THEN {_TOWN('l_partkey')} END AS start, CASE WHEN l_partkey % 4 < 2 THEN {_TOWN('l_suppkey')} END AS "end",
    CASE l_partkey % 4 WHEN 0 THEN {_TOWN('l_suppkey')} WHEN 1 THEN {_TOWN('l_quantity')} END AS overnight FROM ({_LINES}) t""",
)
def fn_rule_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = itinerary_days(spark, sf_dir).withColumn("p", D.day_places(F.col("title"), F.col("body")))
    return rows.select("l_orderkey", "title", "day_from", "p.start", "p.end", "p.overnight")


@query(
    "fn_grounded",
    """WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(coalesce(text, ''), '[^A-Za-z0-9]+'), lambda x: x <> '') AS ws FROM documents)
    SELECT doc_id, CASE WHEN len(ws) = 0 THEN false ELSE doc_id % 2 = 0 OR concat(' ', regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ') LIKE concat('% ', lower(ws[1]), ' ', lower(ws[1]), ' %') END AS grounded FROM w""",
)
def fn_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two words of a text, or its first word twice, with other case and punctuation."""
    rows = frame(spark, sf_dir, "SELECT doc_id, text, filter(split(coalesce(text, ''), '[^A-Za-z0-9]+'), x -> x <> '') AS ws FROM documents")
    second = F.when(F.col("doc_id") % 2 == 0, F.coalesce(F.get("ws", F.lit(1)), F.lit(""))).otherwise(F.get("ws", F.lit(0)))
    return rows.select("doc_id", D.grounded(F.concat(F.upper(F.get("ws", F.lit(0))), F.lit("--"), second, F.lit("!")), F.col("text")).alias("grounded"))


_WRITTEN = f"SELECT l_orderkey, k, CAST(k + CASE WHEN l_quantity > 44 THEN 2 WHEN l_quantity < 4 THEN -1 ELSE 0 END AS INT) AS day, CASE WHEN l_quantity % 17 = 0 THEN 'Departure day' ELSE 'Walk' END AS title, max(k) OVER (PARTITION BY l_orderkey) AS n FROM ({_LINES}) t"
_STATED = "CASE l_orderkey % 5 WHEN 0 THEN n WHEN 1 THEN n + 2 WHEN 2 THEN n END"


@query(
    "fn_day_oracle",
    f"""WITH w AS ({_WRITTEN}), o AS (SELECT l_orderkey, max(n) AS n, max({_STATED}) AS exact, l_orderkey % 5 = 3 AS part, list(day ORDER BY k) AS days, list(title ORDER BY k) AS titles FROM w GROUP BY l_orderkey),
    s AS (SELECT *, len(list_distinct(days)) AS nd, CASE WHEN n >= 2 AND l_orderkey % 3 > 0 THEN n END AS src, list_min(days) AS lo, list_max(days) AS hi FROM o),
    f AS (SELECT *, src IS NOT NULL AND exact IS NOT NULL AND src <> exact AS contra FROM s),
    g AS (SELECT *, list_filter(generate_series(lo, hi), lambda x: NOT list_contains(days, x) AND (src IS NULL OR x BETWEEN 1 AND src)) AS gaps FROM f)
    SELECT l_orderkey, CASE WHEN src IS NULL AND exact IS NULL AND NOT part THEN 'DAY_CHECK_SKIPPED' ELSE array_to_string(list_filter([
        CASE WHEN part AND nd > 1 THEN 'DAY_SUBDAY_SPLIT' END, CASE WHEN nd < len(days) THEN 'DAY_OUTPUT_DUPLICATE' END,
        CASE WHEN len(list_filter(generate_series(2, len(days)), lambda i: days[i] < days[i - 1])) > 0 THEN 'DAY_OUTPUT_ORDER' END,
        CASE WHEN len(gaps) > 0 THEN 'DAY_OUTPUT_GAP' END, CASE WHEN contra THEN 'SOURCE_DAY_CONTRADICTION' END,
        CASE WHEN NOT part AND CASE WHEN src IS NOT NULL THEN lo < 1 OR hi > src ELSE coalesce(hi > exact, false) END THEN 'DAY_OUTPUT_EXTRA' END,
        CASE WHEN len(list_filter(titles[:-2], lambda t: t LIKE 'Dep%')) > 0 THEN 'DAY_DEPARTURE_MIDTRIP' END,
        CASE WHEN exact IS NOT NULL AND NOT contra AND NOT part AND nd <> exact THEN 'DAY_COUNT_VS_DURATION' END], lambda x: x IS NOT NULL), ',') END AS codes FROM g""",
)
def fn_day_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, f"SELECT l_orderkey, CAST(max({_STATED}) AS INT) AS exact, CAST(max(n) AS INT) AS n, array_sort(collect_list(struct(k, day, title))) AS days FROM ({_WRITTEN}) w GROUP BY l_orderkey")
    source = F.when((F.col("n") >= 2) & (F.col("l_orderkey") % 3 > 0), F.sequence(F.lit(1), F.col("n")))
    codes = D.day_findings(source, F.col("exact"), F.col("l_orderkey") % 5 == 3, F.col("days"))
    return rows.select("l_orderkey", F.array_join(codes, ",").alias("codes"))


# prices

_CENTS = "(p_partkey * 137 % 900000 + 1000)"
_POINTS = lambda sign, point: f"concat(CAST(floor(c / 100000) AS INT), '{sign}', lpad(CAST(floor(c / 100) % 1000 AS STRING), 3, '0'), '{point}', lpad(CAST(c % 100 AS STRING), 2, '0'))"
_PRICES = f"""SELECT p_partkey, CASE p_partkey % 11 WHEN 0 THEN concat('$', {_POINTS(',', '.')}, ' per person') WHEN 1 THEN concat({_POINTS('.', ',')}, ' EUR per group') WHEN 2 THEN concat('From US$ ', c)
    WHEN 3 THEN concat('Price ', c) WHEN 4 THEN '  ' WHEN 5 THEN concat('THB ', c, ' / pax, THB ', c + 1, ' for 4 pax') WHEN 6 THEN 'call us' WHEN 7 THEN concat('USD ', c, ' or ', c, ' euros each')
    WHEN 8 THEN concat('Price: ', c, ' (all in usd)') WHEN 9 THEN '£4 per group per person' ELSE 'PAX 12 DAY 3' END AS raw FROM (SELECT *, CAST({_CENTS} AS BIGINT) AS c FROM part) t"""


@F.pandas_udf(T.StructType([T.StructField("amount", T.DoubleType()), *[T.StructField(c, T.StringType()) for c in ("currency", "basis", "reasons")]]))
def parsed_price(texts: pd.Series) -> pd.DataFrame:
    made = [D.price_of(t) for t in texts]
    return pd.DataFrame({"amount": [None if a is None else float(a) for a, *_ in made], "currency": [m[1] for m in made], "basis": [m[2] for m in made], "reasons": [",".join(m[3]) for m in made]})


@query(
    "fn_parse_price",
    f"""SELECT p_partkey, CASE WHEN s IN (0, 1) THEN c / 100.0 WHEN s IN (2, 5, 7, 8) THEN c WHEN s = 9 THEN 4 END AS amount,
        CASE WHEN s IN (0, 2, 7, 8) THEN 'USD' WHEN s = 1 THEN 'EUR' WHEN s = 5 THEN 'THB' WHEN s = 9 THEN 'GBP' END AS currency,
        CASE WHEN s IN (0, 5, 7, 8) THEN 'per_person' WHEN s IN (1, 9) THEN 'per_group' WHEN s = 2 THEN 'from' END AS basis,
        CASE WHEN s IN (0, 1, 2) THEN '' WHEN s IN (3, 10) THEN 'no_currency' WHEN s = 4 THEN 'no_text' WHEN s = 5 THEN 'several_amounts,tiered' WHEN s = 6 THEN 'no_amount' WHEN s = 7 THEN 'several_currencies' WHEN s = 8 THEN 'basis_assumed' ELSE 'basis_unclear,amount_small' END AS reasons
    FROM (SELECT p_partkey, p_partkey % 11 AS s, CAST({_CENTS} AS DOUBLE) AS c FROM part) t""",
)
def fn_parse_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, _PRICES).select("p_partkey", parsed_price("raw").alias("p")).select("p_partkey", "p.*")


# places, markets, countries


@query(
    "fn_place_filter",
    """SELECT o_orderkey, CASE o_orderkey % 12 WHEN 0 THEN 'Yali La Pass' WHEN 1 THEN 'Gogina' WHEN 3 THEN 'Simatai to Jinshan Great Wall' WHEN 9 THEN 'city palace' WHEN 11 THEN 'Great Mosque' END AS place,
    CASE o_orderkey % 12 WHEN 2 THEN 'route_segment' WHEN 4 THEN 'lodging' WHEN 5 THEN 'activity' WHEN 6 THEN 'region' WHEN 7 THEN 'generic_kind' WHEN 8 THEN 'descriptive' WHEN 10 THEN 'annotation_only' END AS cause FROM orders""",
)
def fn_place_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(
        spark,
        sf_dir,
        """SELECT o_orderkey, CASE o_orderkey % 12 WHEN 0 THEN 'Yali La Pass (4820 m)' WHEN 1 THEN 'the small village of Gogina' WHEN 2 THEN 'Lhasa to Gyantse' WHEN 3 THEN 'Simatai to Jinshan Great Wall'
        WHEN 4 THEN 'a comfortable hotel in Seoul (or similar)' WHEN 5 THEN 'Korean cooking class' WHEN 6 THEN 'Arabian Sea' WHEN 7 THEN 'international airport' WHEN 8 THEN CASE WHEN o_orderkey % 24 = 8 THEN 'small riverside bend' ELSE 'small riverside Lao village' END WHEN 9 THEN 'city palace'
        WHEN 10 THEN 'At about 4040 m' ELSE 'Great Mosque' END AS name, CASE WHEN o_orderkey % 12 = 9 THEN 'Jaipur' ELSE '' END AS locality FROM orders""",
    )
    rows = rows.withColumn("cause", D.not_a_place(F.col("name"), F.col("locality")))
    return rows.select("o_orderkey", F.when(F.col("cause").isNull(), D.clean_place(F.col("name"))).alias("place"), "cause")


#: Stand-in names of the nations, by key.
_COUNTRIES = "ALGERIA|ARGENTINA|BRAZIL|CANADA|EGYPT|ETHIOPIA|FRANCE|GERMANY|INDIA|INDONESIA|IRAN|IRAQ|JAPAN|JORDAN|KENYA|MOROCCO|MOZAMBIQUE|PERU|CHINA|ROMANIA|SAUDI ARABIA|VIET NAM|NEPAL|SRI LANKA|UNITED STATES"
#: What the column of a sheet and its file name say of a customer's nation `a`, and of another one `b`.
_NAMED = f"""SELECT c_custkey, c_custkey % 5 AS k, a, b, CASE c_custkey % 5 WHEN 0 THEN a WHEN 1 THEN lower(replace(a, ' ', '-')) WHEN 2 THEN '' WHEN 3 THEN concat(a, ' & ', b) ELSE 'the Himalayas' END AS raw,
    CASE c_custkey % 5 WHEN 2 THEN concat(a, '_tours.xlsx') WHEN 3 THEN concat(b, '.xlsx') WHEN 4 THEN concat(a, ' and ', b, '.xlsx') ELSE 'x.xlsx' END AS file
    FROM (SELECT c_custkey, split_part('{_COUNTRIES}', '|', CAST(c_nationkey + 1 AS INT)) AS a, split_part('{_COUNTRIES}', '|', CAST(c_custkey % 25 + 1 AS INT)) AS b FROM customer) c"""


@query("fn_country_resolve", f"SELECT c_custkey, CASE WHEN k IN (0, 1, 2) OR a = b THEN a WHEN k = 3 THEN b END AS country FROM ({_NAMED})")
def fn_country_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, _NAMED)
    return rows.select("c_custkey", D.country_of(F.col("raw"), F.col("file"), {c: c for c in _COUNTRIES.split("|")}).alias("country"))


@query(
    "fn_market_normalise",
    """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'UK,DE,FR,NL' WHEN 1 THEN 'US,CA' WHEN 2 THEN 'AE' WHEN 3 THEN 'UK' WHEN 4 THEN 'JP,AU' ELSE '' END AS countries,
    CASE c_custkey % 6 WHEN 0 THEN 'UK,DE,FR,NL' WHEN 1 THEN 'US' WHEN 3 THEN 'UK' WHEN 4 THEN 'AU' ELSE '' END AS supported,
    CASE c_custkey % 6 WHEN 1 THEN 'CA' WHEN 2 THEN 'AE' WHEN 4 THEN 'JP' ELSE '' END AS unsupported, CASE c_custkey % 6 WHEN 3 THEN 'Atlantis' ELSE '' END AS unknown FROM customer""",
)
def fn_market_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "SELECT c_custkey, split(split_part(' Europe ;Germany|North  America;usa|UAE;Dubai.|Atlantis;England|jp;Australia|', '|', CAST(c_custkey % 6 + 1 AS INT)), ';') AS declared FROM customer")
    made = rows.withColumn("m", D.markets_of(F.col("declared")))
    return made.select("c_custkey", *[F.array_join(f"m.{c}", ",").alias(c) for c in ("countries", "supported", "unsupported", "unknown")])


@query(
    "fn_timezone_of",
    """SELECT s_suppkey, CASE k WHEN 0 THEN CASE WHEN lng >= 127 OR (lng >= 125 AND lat < 1) THEN 'Asia/Jayapura' WHEN lng >= 114.42 THEN 'Asia/Makassar' ELSE 'Asia/Jakarta' END WHEN 1 THEN CASE WHEN lng >= 109 THEN 'Asia/Kuching' ELSE 'Asia/Kuala_Lumpur' END
    WHEN 2 THEN CASE WHEN lng < 96.5 THEN 'Asia/Hovd' ELSE 'Asia/Ulaanbaatar' END WHEN 3 THEN 'Asia/Kathmandu' WHEN 4 THEN 'Asia/Jakarta' END AS zone FROM (SELECT s_suppkey, s_suppkey % 6 AS k, 90 + s_suppkey * 7 % 45 AS lng, s_suppkey % 5 - 2 AS lat FROM supplier) t""",
)
def fn_timezone_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "SELECT s_suppkey, split_part('id,MY,mn,NP,ID,XX', ',', CAST(s_suppkey % 6 + 1 AS INT)) AS code, CASE WHEN s_suppkey % 6 <> 4 THEN CAST(90 + s_suppkey * 7 % 45 AS DOUBLE) END AS lng, CAST(s_suppkey % 5 - 2 AS DOUBLE) AS lat FROM supplier")
    return rows.select("s_suppkey", D.zone_of(F.col("code"), F.col("lng"), F.col("lat")).alias("zone"))


_ACTIONS = "Arrive in Kandy|Overnight at the hotel|Stay at Amanjena|Explore Leh|Explore here at leisure|Have lunch|Have momos in Paro|Relax|Visit the fort|Dine together"


@query(
    "fn_transit_rules",
    """SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'arrive' WHEN 1 THEN 'overnight' WHEN 4 THEN 'explore' WHEN 5 THEN 'have lunch' WHEN 9 THEN 'dine' END AS opener FROM events""",
)
def fn_transit_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, f"SELECT event_id, split_part('{_ACTIONS}', '|', CAST(event_id % 10 + 1 AS INT)) AS action FROM events")
    return rows.select("event_id", D.transit_opener(F.col("action")).alias("opener"))


_KINDS = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(D.KIND_WORDS))


@query(
    "fn_names_somewhere",
    rf"""SELECT doc_id, len(list_filter(string_split_regex(place, '\s+'), lambda w: regexp_matches(w, '^\p{{Lu}}') AND lower(regexp_replace(w, '^[,.''’]+|[,.''’]+$', '', 'g')) NOT IN ({_KINDS}))) > 0 AS named
    FROM (SELECT doc_id, concat_ws(' ', CASE WHEN doc_id % 3 = 0 THEN 'Temple, the' WHEN doc_id % 3 = 1 THEN 'lake' END, string_split(text, ' ')[1], string_split(text, ' ')[2], CASE WHEN doc_id % 2 = 0 THEN 'Market.' END) AS place FROM documents)""",
)
def fn_names_somewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two words of each document, between kinds of places."""
    rows = frame(spark, sf_dir, "SELECT doc_id, concat_ws(' ', CASE WHEN doc_id % 3 = 0 THEN 'Temple, the' WHEN doc_id % 3 = 1 THEN 'lake' END, get(split(text, ' '), 0), get(split(text, ' '), 1), CASE WHEN doc_id % 2 = 0 THEN 'Market.' END) AS place FROM documents")
    return rows.select("doc_id", D.names_somewhere(F.col("place")).alias("named"))


@query("fn_claimable_words", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'koya,mount,nakasendo' WHEN 1 THEN 'leh,market' WHEN 2 THEN '' ELSE 'kandy,lake' END AS words FROM events")
def fn_claimable_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "SELECT event_id, split_part('Mount Koya|the market in Leh||Lake of Kandy', '|', CAST(event_id % 4 + 1 AS INT)) AS place, split_part('walk the Nakasendo|buy fruit|see it|To the Lake', '|', CAST(event_id % 4 + 1 AS INT)) AS action FROM events")
    return rows.select("event_id", F.array_join(D.claimable_words(F.col("place"), F.col("action")), ",").alias("words"))


_COMPONENT = "concat_ws('|', CAST(o_orderkey AS {t}), CAST(o_custkey % 9 AS {t}), 'leh palace', 'in', lower(trim(o_orderpriority)))"
_DIGEST = "sha1(CAST(unhex('6f1d6a520f7c5a129b1e712a71200000') || encode(" + _COMPONENT.format(t="VARCHAR") + ") AS BLOB))"


@query(
    "fn_component_id",
    f"""SELECT o_orderkey, concat(h[1:8], '-', h[9:12], '-5', h[14:16], '-', substr('89ab', CAST(instr('0123456789abcdef', h[17:17]) - 1 AS INT) % 4 + 1, 1), h[18:20], '-', h[21:32]) AS id FROM (SELECT o_orderkey, {_DIGEST} AS h FROM orders) t""",
)
def fn_component_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, f"SELECT o_orderkey, {_COMPONENT.format(t='STRING')} AS name FROM orders")
    return rows.select("o_orderkey", D.uuid5(D.COMPONENT_NAMESPACE, F.col("name")).alias("id"))


sql("fn_relevance_bucket", "SELECT p_brand, CASE WHEN max(p_size) >= 48 THEN 'HIGH' WHEN max(p_size) >= 20 THEN 'MED' WHEN max(p_size) IS NULL THEN 'MED' ELSE 'LOW' END AS bucket FROM part GROUP BY p_brand")


@query(
    "fn_periods",
    """SELECT event_id, CAST(d AS DATE) AS day, CAST(date_trunc('week', d) AS DATE) AS week, CAST(date_trunc('week', d) + INTERVAL 6 DAY AS DATE) AS week_ends, CAST(date_trunc('month', d) AS DATE) AS month, CAST(last_day(d) AS DATE) AS month_ends,
    CAST(f + CASE isodow(f) WHEN 5 THEN INTERVAL 3 DAY WHEN 6 THEN INTERVAL 3 DAY WHEN 7 THEN INTERVAL 2 DAY ELSE INTERVAL 1 DAY END AS DATE) AS second_business_day FROM (SELECT event_id, CAST(ts + INTERVAL 7 HOUR AS DATE) AS d, date_trunc('month', CAST(ts + INTERVAL 7 HOUR AS DATE)) AS f FROM events) t""",
)
def fn_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a zone seven hours ahead."""
    day = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Bangkok"), F.col("ts")))
    rows = frame(spark, sf_dir, "SELECT event_id, ts FROM events").select("event_id", day.alias("day"))
    week = F.trunc("day", "week")
    return rows.select("event_id", "day", week.alias("week"), F.date_add(week, 6).alias("week_ends"), F.trunc("day", "month").alias("month"), F.last_day("day").alias("month_ends"), D.nth_business_day(F.col("day"), 2).alias("second_business_day"))


_HOURS = "CASE WHEN date_trunc('hour', {c}) = {c} THEN {c} ELSE date_trunc('hour', {c}) + INTERVAL {one} END"
_CLAMP = lambda one, kind: (
    f"SELECT event_id, CAST(greatest(date_trunc('hour', ts), TIMESTAMP{kind} '2024-01-03 01:00:00') AS TIMESTAMP{kind}) AS since, "
    f"CAST(least({_HOURS.format(c='ts', one=one)}, TIMESTAMP{kind} '2024-01-20 00:00:00') AS TIMESTAMP{kind}) AS until FROM events WHERE greatest(date_trunc('hour', ts), TIMESTAMP{kind} '2024-01-03 01:00:00') < least({_HOURS.format(c='ts', one=one)}, TIMESTAMP{kind} '2024-01-20 00:00:00')"
)
sql("fn_floor_ceil_hour", _CLAMP("'1' HOUR", "_NTZ"), _CLAMP("1 HOUR", ""))
sql("fn_clamp_distance", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity / 30 < 0.6 OR l_quantity / 30 > 1.5 THEN NULL ELSE l_quantity END AS kept FROM lineitem")
sql(
    "fn_row_hash",
    "SELECT o_orderkey, sha2(concat_ws('|', CAST(o_orderkey AS STRING), coalesce(o_orderstatus, ''), o_orderpriority), 256) AS h FROM orders",
    "SELECT o_orderkey, sha256(concat_ws('|', CAST(o_orderkey AS STRING), coalesce(o_orderstatus, ''), o_orderpriority)) AS h FROM orders",
)


@query("fn_title_case_caps", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_type[1]) || lower(p_type[2:]) || ' Tour' ELSE p_type || ' tour' END AS title, 'A bold word and ' || p_name AS body FROM part")
def fn_title_case_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat(p_type, ' TOUR') ELSE concat(p_type, ' tour') END AS name, concat(' A **bold** word and **', p_name, ' ') AS body FROM part")
    title = F.when(F.col("name") == F.upper("name"), F.initcap("name")).otherwise(F.col("name"))
    body = F.trim(F.replace(F.regexp_replace("body", r"\*\*([^*]+)\*\*", "$1"), F.lit("**"), F.lit("")))
    return rows.select("p_partkey", title.alias("title"), body.alias("body"))


@query(
    "fn_grade",
    "SELECT o_custkey, round(100.0 * count(CASE WHEN (o_orderkey % 4 = 0 AND o_orderstatus = 'F') OR (o_orderkey % 4 = 1 AND o_orderstatus <> 'F') THEN 1 END) / count(*), 2) AS grade FROM orders GROUP BY o_custkey",
)
def fn_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer is right when its set of choices is the key's; no choice counts as wrong."""
    rows = frame(spark, sf_dir, "SELECT o_custkey, CASE WHEN o_orderstatus = 'F' THEN array(2, 0) ELSE array(1) END AS answer, CASE o_orderkey % 4 WHEN 0 THEN array(0, 2, 2) WHEN 1 THEN array(1) WHEN 2 THEN array(0, 1) END AS chosen FROM orders")
    right = F.array_sort(F.array_distinct(F.coalesce("chosen", F.array().cast("array<int>")))) == F.array_sort("answer")
    return rows.groupBy("o_custkey").agg(F.round(100.0 * F.count_if(right) / F.count("*"), 2).alias("grade"))


@query("fn_json_build", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS kind, event_id % 3 + 1 AS coalesced FROM events")
def fn_json_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload with one field set and others added, written and read again."""
    rows = frame(spark, sf_dir, "SELECT event_id, event_type, props FROM events")
    old = F.from_json("props", "map<string,string>")
    new = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("coalesced"), (F.col("event_id") % 3 + 1).cast("string"))
    built = F.to_json(F.map_concat(F.map_filter(old, lambda k, _: ~k.isin("kind", "coalesced")), new))
    return rows.select("event_id", *[F.get_json_object(built, f"$.{c}").cast(t).alias(c) for c, t in (("k", "bigint"), ("kind", "string"), ("coalesced", "bigint"))])


#: $ per million tokens: in, out, cache read (a share of in), limit of the first tier, in and out above it.
RATES = [("small", 0.1, 0.5, 0.1, 100_000, 0.5, 2.5), ("medium", 3.0, 15.0, 0.1, None, None, None), ("large", 5.0, 25.0, 0.05, None, None, None)]


def quoted(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """calls (id, model, tokens_in, tokens_out, cached, written, batch, geo_us) with cost, by the tier that the prompt's
    tokens reach; cache writes cost 1.25 of input, a batch half, the US region a tenth more."""
    prompt = F.col("tokens_in") + F.col("cached") + F.col("written")
    above = F.coalesce(prompt > F.col("tier"), F.lit(False))
    rate_in, rate_out = (F.when(above, F.col(f"{c}_above")).otherwise(F.col(c)) for c in ("rate_in", "rate_out"))
    plain = F.col("tokens_in") * rate_in + F.col("tokens_out") * rate_out + F.col("cached") * rate_in * F.col("rate_cached") + F.col("written") * rate_in * 1.25
    factor = F.when(F.col("batch"), 0.5).otherwise(1.0) * F.when(F.col("geo_us"), 1.1).otherwise(1.0)
    return calls.join(F.broadcast(rates), "model", "left").withColumn("cost", plain * factor / 1e6)  # one row a model


@query(
    "fn_price_quote",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round((t_in * i + t_out * o + 200 * i * 1.25 + 1000 * i * c) * CASE WHEN l_returnflag = 'A' THEN 0.5 ELSE 1 END * CASE WHEN l_linestatus = 'O' THEN 1.1 ELSE 1 END / 1e6, 10) AS cost
    FROM (SELECT *, CASE m WHEN 0 THEN CASE WHEN t_in + 1200 > 100000 THEN 0.5 ELSE 0.1 END WHEN 1 THEN 3 ELSE 5 END AS i, CASE m WHEN 0 THEN CASE WHEN t_in + 1200 > 100000 THEN 2.5 ELSE 0.5 END WHEN 1 THEN 15 ELSE 25 END AS o, CASE m WHEN 2 THEN 0.05 ELSE 0.1 END AS c
    FROM (SELECT *, l_partkey % 3 AS m, l_quantity * 4000 AS t_in, l_suppkey * 10 AS t_out FROM lineitem) t) u""",
)
def fn_price_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = frame(
        spark,
        sf_dir,
        "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, split_part('small,medium,large', ',', CAST(l_partkey % 3 + 1 AS INT)) AS model, l_quantity * 4000 AS tokens_in, l_suppkey * 10 AS tokens_out, 1000 AS cached, 200 AS written, l_returnflag = 'A' AS batch, l_linestatus = 'O' AS geo_us FROM lineitem",
    )
    rates = spark.createDataFrame(RATES, "model string, rate_in double, rate_out double, rate_cached double, tier long, rate_in_above double, rate_out_above double")
    return quoted(calls, rates).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.round("cost", 10).alias("cost"))


# merging a sheet into what is there

_REVISIONS = """SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE WHEN event_type IN ('click', 'view') THEN 'staff_edit' ELSE 'excel_merge' END AS source,
    split_part('name,price,days', ',', CAST(event_id % 3 + 1 AS INT)) AS field, CASE WHEN event_id % 4 = 0 THEN 'current' ELSE 'incoming' END AS choice FROM events"""


def owned_fields(revisions: DataFrame) -> DataFrame:
    """id, field: what a person owns after all revisions (id, n, source, field, choice) in order: a staff edit takes a
    field, a merge gives it back unless the choice kept the current value."""
    last = revisions.groupBy("id", "field").agg(F.max_by(F.struct("source", "choice"), "n").alias("last"))
    return last.filter((F.col("last.source") == "staff_edit") | (F.col("last.choice") == "current")).select("id", "field")


_OWNED_SQL = f"SELECT id, field FROM (SELECT *, lead(n) OVER (PARTITION BY id, field ORDER BY n) AS later FROM ({_REVISIONS}) r) t WHERE later IS NULL AND NOT (source = 'excel_merge' AND choice <> 'current')"


@query("fn_owned_fields", _OWNED_SQL)
def fn_owned_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owned_fields(frame(spark, sf_dir, _REVISIONS))


@query(
    "fn_merge_three_way",
    f"""WITH o AS ({_OWNED_SQL}), f AS (SELECT c_custkey AS id, unnest(['name', 'price', 'days']) AS field, c_custkey % 5 AS k FROM customer)
    SELECT id, field, CASE WHEN field = 'name' THEN CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN 'unchanged' ELSE s END WHEN field = 'price' THEN CASE WHEN k IN (0, 2) THEN NULL WHEN k = 3 THEN 'unchanged' ELSE s END ELSE CASE WHEN k = 4 THEN NULL ELSE s END END AS state
    FROM (SELECT f.*, CASE WHEN o.id IS NULL THEN 'auto' ELSE 'conflict' END AS s FROM f LEFT JOIN o ON o.id = f.id AND o.field = f.field) t""",
)
def fn_merge_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each field of each tour, given its current and incoming values and who owns it."""
    rows = frame(
        spark,
        sf_dir,
        """SELECT c_custkey AS id, stack(3, 'name', 'Old  Town walk', split_part('| Old Town walk |New|Newer|Newest', '|', CAST(c_custkey % 5 + 1 AS INT)), 'price', '100', split_part('[]|120|{}|100 |90', '|', CAST(c_custkey % 5 + 1 AS INT)),
        'days', NULL, CASE WHEN c_custkey % 5 = 4 THEN '  ' ELSE '7' END) AS (field, current, incoming) FROM customer""",
    )
    owned = owned_fields(frame(spark, sf_dir, _REVISIONS)).withColumn("owned", F.lit(True))
    joined = rows.join(owned, ["id", "field"], "left").withColumn("owned", F.coalesce("owned", F.lit(False)))
    return joined.select("id", "field", D.merge_state(F.col("current"), F.col("incoming"), F.col("owned")).alias("state"))


@query(
    "fn_demote_lifecycle",
    """SELECT c_custkey, CASE WHEN v = 0 THEN CASE WHEN a < 2 THEN 'suspended' END WHEN v = 1 THEN CASE WHEN a < 2 THEN 'past_due' END
        WHEN a = 2 AND r THEN CASE WHEN s THEN 'active' ELSE 'past_due' END WHEN a = 1 AND s THEN 'active' END AS state FROM (SELECT c_custkey, c_custkey % 3 AS v, c_custkey // 3 % 4 AS a, c_custkey % 2 = 0 AS r, c_custkey % 5 < 3 AS s FROM customer) t""",
)
def fn_demote_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(
        spark,
        sf_dir,
        """SELECT c_custkey, split_part('past_due,warn,ok', ',', CAST(c_custkey % 3 + 1 AS INT)) AS view, split_part('active,past_due,suspended,closed', ',', CAST(c_custkey div 3 % 4 + 1 AS INT)) AS account,
        CASE WHEN c_custkey % 2 = 0 THEN 'billing' ELSE 'abuse' END AS reason, CASE WHEN c_custkey % 5 < 3 THEN 'active' END AS content FROM customer""",
    )
    return rows.select("c_custkey", D.billing_move(*[F.col(c) for c in ("view", "account", "reason", "content")]).alias("state"))


# sheets and replies

sql("src_group_size_fix", "SELECT o_orderkey, concat(CAST(least(month(o_orderdate), day(o_orderdate)) AS STRING), '-', CAST(greatest(month(o_orderdate), day(o_orderdate)) AS STRING)) AS size FROM orders")


_HEADER = "concat(upper(p_name), CASE WHEN p_size % 2 = 0 THEN ' (USD)' ELSE ':' END, '_', p_brand, ' / ', p_type, '.-')"


@query("src_header_normalise", rf"""SELECT p_partkey, array_to_string(list_filter(string_split(translate(lower(replace({_HEADER}, ' (USD)', ' ')), '_-/.:', '     '), ' '), lambda x: x <> ''), ' ') AS header FROM part""")
def src_header_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, f"SELECT p_partkey, {_HEADER} AS name FROM part")
    return rows.select("p_partkey", D.header(F.col("name")).alias("header"))


#: Canonical fields by header.
COLUMN_MAP = {"tour name": "src_name", "country": "country", "duration": "duration", "group size": "group_size", "price": "price_raw", "itinerary": "src_itineraries", "highlights": "src_highlights"}


def column_map(headers: DataFrame, table: dict[str, str], least: float = 0.5) -> DataFrame:
    """sheet, name, field (null without one), trusted (the share of a sheet's columns with a field is at least `least`)."""
    mapped = headers.withColumn("field", D.lookup(table, D.header(F.trim("name"))))
    rates = mapped.groupBy("sheet").agg((F.avg(F.col("field").isNotNull().cast("int")) >= least).alias("trusted"))
    return mapped.join(rates, "sheet").select("sheet", "name", "field", "trusted")


@query(
    "src_column_map",
    """WITH h AS (SELECT o_custkey AS sheet, o_orderkey, o_orderpriority, (o_orderkey * 7 + o_custkey) % 6 AS k FROM orders)
    SELECT sheet, concat(CASE k WHEN 0 THEN 'Tour_Name' WHEN 1 THEN ' PRICE (USD)' WHEN 2 THEN 'Notes' WHEN 3 THEN 'group.size' WHEN 4 THEN 'Operator' ELSE 'x' END, ' (', o_orderpriority, ')') AS name, CASE k WHEN 0 THEN 'src_name' WHEN 1 THEN 'price_raw' WHEN 3 THEN 'group_size' END AS field,
    2 * count(*) FILTER (WHERE k IN (0, 1, 3)) OVER (PARTITION BY sheet) >= count(*) OVER (PARTITION BY sheet) AS trusted FROM h""",
)
def src_column_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = frame(spark, sf_dir, "SELECT o_custkey AS sheet, concat(split_part('Tour_Name| PRICE (USD)|Notes|group.size|Operator|x', '|', CAST((o_orderkey * 7 + o_custkey) % 6 + 1 AS INT)), ' (', o_orderpriority, ')') AS name FROM orders")
    return column_map(headers, COLUMN_MAP)


_SHEET = "SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, CASE WHEN l_quantity >= 25 THEN concat('T', l_orderkey) END AS name, concat('line ', l_orderkey, '/', l_linenumber, '/', l_suppkey) AS line, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity) AS k FROM lineitem"


def continued(rows: DataFrame, sheet: str, order: str, name: str, text: str) -> DataFrame:
    """sheet, grp, name, text: rows without a name continue the row before; their texts are joined in order. Rows before
    the first name belong to nothing."""
    from pyspark.sql import Window

    grouped = rows.withColumn("grp", F.sum(F.col(name).isNotNull().cast("bigint")).over(Window.partitionBy(sheet).orderBy(order)))
    lines = F.array_sort(F.collect_list(F.struct(order, text)))
    return grouped.filter("grp > 0").groupBy(sheet, "grp").agg(F.max(name).alias("name"), F.array_join(F.transform(lines, lambda x: x[text]), "\n").alias("text"))


@query(
    "src_continuation_merge",
    f"""WITH s AS ({_SHEET}), n AS (SELECT l_partkey, k, name, row_number() OVER (PARTITION BY l_partkey ORDER BY k) AS grp, lead(k) OVER (PARTITION BY l_partkey ORDER BY k) AS upto FROM s WHERE name IS NOT NULL)
    SELECT n.l_partkey, n.grp, n.name, string_agg(s.line, chr(10) ORDER BY s.k) AS text FROM n JOIN s ON s.l_partkey = n.l_partkey AND s.k >= n.k AND (n.upto IS NULL OR s.k < n.upto) GROUP BY n.l_partkey, n.grp, n.name""",
)
def src_continuation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return continued(frame(spark, sf_dir, _SHEET), "l_partkey", "k", "name", "line")


def first_json(reply: str | None) -> str | None:
    """The first complete JSON object or array in a reply, or null: a bracket that opens no valid value is passed over with
    all inside it; one that is never closed ends the search."""
    text, at, decoder = reply or "", 0, json.JSONDecoder()
    while True:
        opening = [i for i in (text.find("{", at), text.find("[", at)) if i >= 0]
        if not opening:
            return None
        start = min(opening)
        try:
            value, _ = decoder.raw_decode(text, start)
            return json.dumps(value, sort_keys=True, separators=(",", ":"))
        except ValueError:
            at = _closing(text, start)
            if at is None:
                return None


def _closing(text: str, start: int) -> int | None:
    depth, quoted, i = 0, False, start
    while i < len(text):
        c = text[i]
        if quoted:
            i += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        else:
            depth += (c in "{[") - (c in "}]")
            if not depth:
                return i + 1
        i += 1
    return None


@F.pandas_udf(T.StringType())
def json_reply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for replies in batches:
        yield replies.map(first_json)


@query(
    "src_json_reply",
    """SELECT event_id, CASE WHEN event_id % 5 IN (0, 1, 2) THEN concat('{"a":[1,', event_id, '],"p":', replace(props, ' ', ''), ',"s":"}{"}') WHEN event_id % 5 = 3 THEN concat('[', replace(props, ' ', ''), ',2]') END AS value FROM events""",
)
def src_json_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies around the events' own JSON: fenced, in prose, bare, an array, cut off."""
    rows = frame(
        spark,
        sf_dir,
        """SELECT event_id, CASE event_id % 5 WHEN 0 THEN concat('```json\\n{"s": "}{", "p": ', props, ', "a": [1, ', event_id, ']}\\n``` {"b": 2}') WHEN 1 THEN concat('For {n} questions: {"a": [1, ', event_id, '], "s": "}{", "p": ', props, '} done') WHEN 2 THEN concat('{"a": [1, ', event_id, '], "p": ', props, ', "s": "}{"}')
        WHEN 3 THEN concat('so [', props, ', 2] it is') ELSE concat('cut {"a": ', rtrim('}', props)) END AS reply FROM events""",
    )
    return rows.select("event_id", json_reply("reply").alias("value"))


@query("src_json_array_guard", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 3 WHEN event_id % 4 = 1 THEN 0 ELSE 0 END AS n, CASE WHEN event_id % 4 = 0 THEN CAST(event_id AS VARCHAR) ELSE '' END AS first FROM events")
def src_json_array_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat(' [', event_id, ', 2, \"x\"]') WHEN 1 THEN '{\"a\": [1]}' WHEN 2 THEN 'no json [' END AS text FROM events")
    held: Column = D.json_array(F.col("text"))
    return rows.select("event_id", F.size(held).alias("n"), F.coalesce(F.get(held, F.lit(0)), F.lit("")).alias("first"))
