"""Distances on the sphere: pairs within a radius, and the nearest place with a fall-back of growing rings.

The sphere is cut into bands as high as the radius, and each band into cells about as wide as it is high at its edge next
to a pole, so bands have fewer cells towards the poles and one at them. A place covers the cells that its circle touches: the
circle's range of longitudes widens towards the poles and wraps at 180 degrees, and is the whole band where the circle holds
a pole. Each place lies in one cell, so each pair meets once, however near to a pole or to the date line.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.domain import zone_of
from tidemark.operators.sinks import stored
from tidemark.plans.registry import frame, query

#: Kilometres: the mean radius of the earth, and half of a great circle.
RADIUS = 6371.0088
FARTHEST = math.pi * RADIUS


def great_circle(lat_a: Column, lng_a: Column, lat_b: Column, lng_b: Column) -> Column:
    """Kilometres between two points in degrees (haversine)."""
    half = lambda x, y: F.pow(F.sin(F.radians(y - x) / 2), F.lit(2.0))
    h = half(lat_a, lat_b) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * half(lng_a, lng_b)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


class Cells:
    """Bands and cells for a radius in kilometres."""

    def __init__(self, km: float) -> None:
        self.angle = min(km / RADIUS * (1 + 1e-9) + 1e-12, math.pi)
        self.bands = max(1, math.floor(math.pi / max(self.angle, 1e-4)))
        self.height = 180.0 / self.bands

    def band(self, lat: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(self.bands - 1), F.floor((lat + 90) / self.height).cast("int")))

    def columns(self, band: Column) -> Column:
        """Cells of a band: as many as fit its shorter edge."""
        low = band * self.height - 90
        shorter = F.least(F.cos(F.radians(low)), F.cos(F.radians(low + self.height)))
        return F.greatest(F.lit(1), F.floor(F.greatest(shorter, F.lit(0.0)) * 360 / self.height).cast("int"))

    def column(self, lng: Column, n: Column) -> Column:
        return F.pmod(F.floor((lng + 180) / 360 * n).cast("int"), n)

    def own(self, lat: Column, lng: Column) -> Column:
        band = self.band(lat)
        return F.struct(band.alias("band"), self.column(lng, self.columns(band)).alias("column"))

    def cover(self, lat: Column, lng: Column) -> Column:
        """The cells that the circle around a point touches, each once."""
        degrees = math.degrees(self.angle)
        pole = (F.abs(lat) + degrees) >= 90
        reach = F.degrees(F.asin(F.least(F.lit(math.sin(min(self.angle, math.pi / 2))) / F.cos(F.radians(lat)), F.lit(1.0)))) + 1e-9
        whole = pole | F.lit(degrees >= 90)

        def of_band(band: Column) -> Column:
            n = self.columns(band)
            first, last = (F.floor((lng + way * reach + 180) / 360 * n).cast("int") for way in (-1, 1))
            some = F.when(whole | (last - first >= n), F.sequence(F.lit(0), n - 1)).otherwise(F.sequence(first, last))
            return F.transform(F.array_distinct(F.transform(some, lambda c: F.pmod(c, n))), lambda c: F.struct(band.alias("band"), c.alias("column")))

        return F.flatten(F.transform(F.sequence(self.band(lat - degrees), self.band(lat + degrees)), of_band))


def within(a: DataFrame, b: DataFrame, km: float, same: tuple[str, ...] = ()) -> DataFrame:
    """id_a, id_b, km: places of a and b (id, lat, lng, unlike ids) at most so far apart, with equal columns `same`."""
    cells = Cells(km)
    left = a.select(*same, *[F.col(c).alias(f"{c}_a") for c in ("id", "lat", "lng")], F.explode(cells.cover(F.col("lat"), F.col("lng"))).alias("cell"))
    right = b.select(*same, *[F.col(c).alias(f"{c}_b") for c in ("id", "lat", "lng")], cells.own(F.col("lat"), F.col("lng")).alias("cell"))
    met = left.join(right, [*same, "cell"]).filter("id_a <> id_b")
    far = great_circle(F.col("lat_a"), F.col("lng_a"), F.col("lat_b"), F.col("lng_b"))
    return met.withColumn("km", far).filter(F.col("km") <= km).select("id_a", "id_b", "km")


def pairs_within(places: DataFrame, km: float, columns: tuple[str, ...] = ()) -> DataFrame:
    """id_a, id_b, km, and `columns` of both: places (id, lat, lng) at most so far apart, each pair once, either of the two first.

    A place covers its own cell and those behind it, so two places meet in the later one of their cells. The columns travel
    with the places, so pairs are not shuffled. Places grow with the table while their files stay small, so neither side may
    be sent whole to the driver and the tasks: they are merged by cell.
    """
    cells = Cells(km)
    named = lambda side: [F.col(c).alias(f"{c}_{side}") for c in ("id", "lat", "lng", *columns)]
    own = cells.own(F.col("lat"), F.col("lng"))
    behind = F.filter(cells.cover(F.col("lat"), F.col("lng")), lambda c: c >= F.col("own"))
    left = places.withColumn("own", own).select(*named("a"), "own", F.explode(behind).alias("cell")).withColumn("inside", F.col("cell") == F.col("own")).drop("own")
    met = left.join(places.select(*named("b"), own.alias("cell")).hint("merge"), "cell")
    met = met.filter((F.col("id_a") < F.col("id_b")) | ~F.col("inside") & (F.col("id_a") > F.col("id_b")))
    far = great_circle(F.col("lat_a"), F.col("lng_a"), F.col("lat_b"), F.col("lng_b"))
    return met.withColumn("km", far).filter(F.col("km") <= km).select("id_a", "id_b", "km", *[f"{c}_{side}" for c in columns for side in "ab"])


def _nearest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.col("id_a").alias("id")).agg(F.min(F.struct(F.round("km", 3).alias("km"), F.col("id_b").alias("other"))).alias("best")).select("id", "best.other", "best.km")


def nearest_or_same_country(places: DataFrame, km: float, widen: float = 4.0) -> DataFrame:
    """id, other, km, level: the nearest other place within km (`near`), else the nearest of the same country (`country`), else
    nulls; places: id, country, lat, lng. Rings for the rest grow by `widen`, each only for places without one so far."""
    places = stored(places.filter("lat IS NOT NULL AND lng IS NOT NULL"), "places")
    found = stored(_nearest(within(places, places, km)).withColumn("level", F.lit("near")), "nearest")
    ring = km
    while ring < FARTHEST:
        ring = min(ring * widen, FARTHEST)
        left = stored(places.join(found, "id", "left_anti"), "left")
        if left.isEmpty():
            break
        more = _nearest(within(left, places, ring, same=("country",))).withColumn("level", F.lit("country"))
        found = stored(found.unionByName(more), "nearest")
    return places.select("id").join(found, "id", "left")


#: Stand-in places: customers, spread over the whole sphere by their keys; the nation is the country.
_PLACES = "SELECT c_custkey AS id, c_nationkey AS country, c_custkey * 7919 % 17900 / 100.0 - 89.5 AS lat, c_custkey * 104729 % 36000 / 100.0 - 180.0 AS lng FROM customer"
_KM = f"2 * {RADIUS} * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))))"
_DUCK = f"p AS (SELECT id, country, CAST(lat AS DOUBLE) AS lat, CAST(lng AS DOUBLE) AS lng FROM ({_PLACES})), d AS (SELECT a.id, b.id AS other, a.country <> b.country AS cross_border, {_KM} AS km FROM p a JOIN p b ON a.id <> b.id)"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, _PLACES).select("id", "country", F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))


@query(
    "jn_spatial_range",
    f"""WITH {_DUCK}, r AS (SELECT id, other, round(km, 3) AS km, CASE WHEN km <= 25 THEN 'near' ELSE 'country' END AS level, row_number() OVER (PARTITION BY id ORDER BY km > 25, round(km, 3), other) AS nth FROM d WHERE km <= 25 OR NOT cross_border)
    SELECT p.id, other, km, level FROM p LEFT JOIN (SELECT * FROM r WHERE nth = 1) r ON r.id = p.id""",
)
def jn_spatial_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_or_same_country(_places(spark, sf_dir), 25.0)


@query("jn_pairs_distance", f"WITH {_DUCK} SELECT id, other, cross_border, round(km, 1) AS km FROM d WHERE km <= 150")
def jn_pairs_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = pairs_within(_places(spark, sf_dir), 150.0, ("country",))
    ways = F.array(*[F.struct(F.col(f"id_{a}").alias("id"), F.col(f"id_{b}").alias("other")) for a, b in ("ab", "ba")])
    return pairs.select((F.col("country_a") != F.col("country_b")).alias("cross_border"), F.round("km", 1).alias("km"), F.inline(ways)).select("id", "other", "cross_border", "km")


@query("gr_junctions", f"WITH {_DUCK} SELECT id AS x, other AS y, cross_border, round(km, 1) AS km FROM d WHERE km <= 300 AND id < other")
def gr_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within 300 km, each once."""
    pairs = pairs_within(_places(spark, sf_dir), 300.0, ("country",))
    ends = F.when(F.col("id_a") < F.col("id_b"), F.struct(F.col("id_a").alias("x"), F.col("id_b").alias("y"))).otherwise(F.struct(F.col("id_b").alias("x"), F.col("id_a").alias("y")))
    return pairs.select(ends["x"].alias("x"), ends["y"].alias("y"), (F.col("country_a") != F.col("country_b")).alias("cross_border"), F.round("km", 1).alias("km"))


#: The public time zone database's table of zones with a reference point each.
ZONE_TABLE = "/usr/share/zoneinfo/zone.tab"
_POINT = re.compile(r"([+-])(\d\d)(\d\d)(\d\d)?([+-])(\d{3})(\d\d)(\d\d)?")


def zone_points(spark: SparkSession, path: str = ZONE_TABLE) -> DataFrame:
    """code, zones: for each country its zones (place in the table, zone, lat, lng); some 420 zones in all."""
    held: dict[str, list] = {}
    with open(path) as lines:
        for n, line in enumerate(lines):
            if not line.startswith("#"):
                code, point, zone = line.rstrip("\n").split("\t")[:3]
                said = _POINT.fullmatch(point).groups()
                lat, lng = (int(s + "1") * (int(d) + int(m) / 60 + int(sec or 0) / 3600) for s, d, m, sec in (said[:4], said[4:]))
                held.setdefault(code, []).append((n, zone, lat, lng))
    return spark.createDataFrame(list(held.items()), "code string, zones array<struct<place:int,zone:string,lat:double,lng:double>>")


def with_zone(rows: DataFrame, points: DataFrame) -> DataFrame:
    """The rows (code, lat, lng, and more) with zone: by the rules of the countries that have any, else the country's zone
    whose reference point is nearest (the first one without coordinates); null for an unknown code."""
    spans = F.transform("zones", lambda z: F.struct(F.round(great_circle(z["lat"], z["lng"], F.col("lat"), F.col("lng")), 6).alias("km"), z["place"].alias("place"), z["zone"].alias("zone")))
    by_table = rows.withColumn("_code", F.upper("code")).join(points.withColumnRenamed("code", "_code"), "_code", "left")
    return by_table.withColumn("zone", F.coalesce(zone_of(F.col("code"), F.col("lng"), F.col("lat")), F.array_min(spans)["zone"])).select(*rows.columns, "zone")


#: The countries' codes of the nations table.
_CODES = "DZ AR BR CA EG ET FR DE IN ID IR IQ JP JO KE MA MZ PE CN RO SA VN RU GB US".split()
_LOCATED = f"SELECT p.id, CASE WHEN p.id % 50 = 0 THEN 'xx' ELSE split_part('{','.join(_CODES)}', ',', CAST(country + 1 AS INT)) END AS code, lat, lng FROM ({_PLACES}) p"


@query(
    "fn_timezone_nearest",
    rf"""WITH lines AS (SELECT unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS place FROM read_text('{ZONE_TABLE}')),
    raw AS (SELECT string_split(line, chr(9))[1] AS code, string_split(line, chr(9))[2] AS pt, string_split(line, chr(9))[3] AS zone, place FROM lines WHERE line <> '' AND line NOT LIKE '#%'),
    s AS (SELECT *, regexp_extract(pt, '^([+-][0-9]+)([+-][0-9]+)$', 1) AS y, regexp_extract(pt, '^([+-][0-9]+)([+-][0-9]+)$', 2) AS x FROM raw),
    z AS (SELECT code, zone, place, CASE WHEN y[1] = '-' THEN -1 ELSE 1 END * (CAST(y[2:3] AS DOUBLE) + CAST(y[4:5] AS DOUBLE) / 60 + coalesce(try_cast(y[6:7] AS DOUBLE), 0) / 3600) AS lat, CASE WHEN x[1] = '-' THEN -1 ELSE 1 END * (CAST(x[2:4] AS DOUBLE) + CAST(x[5:6] AS DOUBLE) / 60 + coalesce(try_cast(x[7:8] AS DOUBLE), 0) / 3600) AS lng FROM s),
    b AS (SELECT id, code, CAST(lat AS DOUBLE) AS lat, CAST(lng AS DOUBLE) AS lng FROM ({_LOCATED})),
    n AS (SELECT b.id, a.zone, row_number() OVER (PARTITION BY b.id ORDER BY round({_KM}, 6), a.place) AS nth FROM b JOIN z a ON a.code = upper(b.code))
    SELECT b.id, b.code, CASE b.code WHEN 'ID' THEN CASE WHEN b.lng >= 127 OR (b.lng >= 125 AND b.lat < 1) THEN 'Asia/Jayapura' WHEN b.lng >= 114.42 THEN 'Asia/Makassar' ELSE 'Asia/Jakarta' END WHEN 'CN' THEN 'Asia/Shanghai' WHEN 'IN' THEN 'Asia/Kolkata' WHEN 'JP' THEN 'Asia/Tokyo' WHEN 'VN' THEN 'Asia/Ho_Chi_Minh' ELSE n.zone END AS zone
    FROM b LEFT JOIN n ON n.id = b.id AND nth = 1""",
)
def fn_timezone_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, _LOCATED).select("id", "code", F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))
    return with_zone(rows, zone_points(spark)).select("id", "code", "zone")
