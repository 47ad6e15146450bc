"""A place graph from trip-like sequences: users are tours, days their days, event types the places."""

from __future__ import annotations

from tidemark.plans.registry import sql

_STOPS = """
    counted AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type AS place, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY user_id, CAST(ts AS DATE), event_type),
    stops AS (SELECT user_id, day, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY n DESC, place) AS r FROM counted) t WHERE r = 1),
    moved AS (SELECT user_id, day, place FROM (SELECT *, lag(place) OVER (PARTITION BY user_id ORDER BY day) AS before FROM stops) t WHERE before IS DISTINCT FROM place)"""

sql("gr_main_destination", f"WITH {_STOPS} SELECT user_id, day, place FROM stops")
sql(
    "gr_choose_stops",
    f"""
    WITH {_STOPS}, overnight AS (SELECT user_id, CAST(ts AS DATE) AS day, min(event_type) AS place FROM events WHERE event_type = 'signup' GROUP BY user_id, CAST(ts AS DATE))
    SELECT stops.user_id, stops.day, coalesce(overnight.place, stops.place) AS place FROM stops LEFT JOIN overnight ON overnight.user_id = stops.user_id AND overnight.day = stops.day""",
)
#: Where a place lies (the test tables have no map): by its name's length and first letter.
_GRID = "SELECT DISTINCT place, length(place) * 7 % 20 AS lat, ascii(place) % 30 AS lng, concat('C', length(place) % 3) AS country FROM stops"
_EDGES = f"""{_STOPS}, places AS ({_GRID}), steps AS (SELECT user_id, place AS a, lead(place) OVER (PARTITION BY user_id ORDER BY day) AS b FROM moved),
    edges AS (SELECT a, b, count(DISTINCT user_id) AS tours, round(111.0 * sqrt(max((x.lat - y.lat) * (x.lat - y.lat) + (x.lng - y.lng) * (x.lng - y.lng))), 3) AS km FROM steps JOIN places x ON x.place = a JOIN places y ON y.place = b WHERE b IS NOT NULL AND a <> b GROUP BY a, b)"""

sql("gr_edges", f"WITH {_EDGES} SELECT a, b, tours, km FROM edges")
#: Every span between two stop days of a tour: its path without repeats in a row, its countries and what was done on its days.
_SPANS = """
    days AS (SELECT user_id, day, place, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM stops),
    spans AS (SELECT x.user_id, x.day AS day_from, y.day AS day_to, x.i AS i, y.i AS j FROM days x JOIN days y ON x.user_id = y.user_id AND x.i < y.i)"""
sql(
    "gr_legs",
    f"""
    WITH {_STOPS}, {_SPANS},
    paths AS (SELECT s.user_id, s.day_from, s.day_to, array_sort(collect_list(struct(d.i, d.place))) AS path FROM spans s JOIN days d ON d.user_id = s.user_id AND d.i BETWEEN s.i AND s.j GROUP BY s.user_id, s.day_from, s.day_to),
    done AS (SELECT s.user_id, s.day_from, s.day_to, array_join(array_sort(collect_set(e.event_type)), ',') AS activities FROM spans s JOIN events e ON e.user_id = s.user_id AND CAST(e.ts AS DATE) BETWEEN s.day_from AND s.day_to GROUP BY s.user_id, s.day_from, s.day_to)
    SELECT p.user_id, p.day_from, p.day_to, CAST(datediff(p.day_to, p.day_from) + 1 AS BIGINT) AS days, array_join(transform(filter(path, (x, k) -> k = 0 OR get(path, k - 1).place <> x.place), x -> x.place), '>') AS path,
        array_join(array_distinct(transform(path, x -> concat('C', length(x.place) % 3))), ',') AS countries, activities FROM paths p JOIN done ON done.user_id = p.user_id AND done.day_from = p.day_from AND done.day_to = p.day_to""",
    f"""
    WITH {_STOPS}, {_SPANS},
    marked AS (SELECT s.user_id, s.day_from, s.day_to, d.i, d.place, lag(d.place) OVER (PARTITION BY s.user_id, s.day_from, s.day_to ORDER BY d.i) AS before, row_number() OVER (PARTITION BY s.user_id, s.day_from, s.day_to, length(d.place) % 3 ORDER BY d.i) AS nth FROM spans s JOIN days d ON d.user_id = s.user_id AND d.i BETWEEN s.i AND s.j),
    done AS (SELECT s.user_id, s.day_from, s.day_to, string_agg(DISTINCT e.event_type, ',' ORDER BY e.event_type) AS activities FROM spans s JOIN events e ON e.user_id = s.user_id AND CAST(e.ts AS DATE) BETWEEN s.day_from AND s.day_to GROUP BY ALL)
    SELECT m.user_id, m.day_from, m.day_to, CAST(m.day_to - m.day_from + 1 AS BIGINT) AS days, string_agg(place, '>' ORDER BY i) FILTER (WHERE before IS DISTINCT FROM place) AS path, string_agg(concat('C', length(place) % 3), ',' ORDER BY i) FILTER (WHERE nth = 1) AS countries, any_value(activities) AS activities
    FROM marked m JOIN done ON done.user_id = m.user_id AND done.day_from = m.day_from AND done.day_to = m.day_to GROUP BY m.user_id, m.day_from, m.day_to""",
)
_LEVEL = "CASE WHEN value < 20 THEN 1 WHEN value < 80 THEN 2 ELSE 3 END"
sql(
    "gr_nodes",
    f"""
    WITH {_STOPS}, counted_stops AS (SELECT place, count(DISTINCT user_id) AS tours, count(*) AS stops FROM stops GROUP BY place),
    seen AS (SELECT event_type AS place, min({_LEVEL}) AS level_min, max({_LEVEL}) AS level_max, array_join(array_sort(collect_set(event_type || '-' || (user_id % 3))), ',') AS activities, array_join(array_sort(collect_set(month(ts))), ',') AS months FROM events GROUP BY event_type)
    SELECT c.place, tours, stops, level_min, level_max, activities, months FROM counted_stops c JOIN seen ON seen.place = c.place""",
    f"""
    WITH {_STOPS}, seen AS (SELECT event_type AS place, min({_LEVEL}) AS level_min, max({_LEVEL}) AS level_max, string_agg(DISTINCT event_type || '-' || (user_id % 3), ',' ORDER BY event_type || '-' || (user_id % 3)) AS activities, string_agg(DISTINCT month(ts), ',' ORDER BY month(ts)) AS months FROM events GROUP BY event_type)
    SELECT s.place, count(DISTINCT s.user_id) AS tours, count(*) AS stops, any_value(level_min) AS level_min, any_value(level_max) AS level_max, any_value(activities) AS activities, any_value(months) AS months FROM stops s JOIN seen ON seen.place = s.place GROUP BY s.place""",
)
sql(
    "gr_stats",
    f"""
    WITH {_EDGES}, kinds AS (SELECT country, 'nodes' AS kind, count(*) AS n FROM places GROUP BY country UNION ALL SELECT x.country, 'edges', count(*) FROM edges JOIN places x ON x.place = a GROUP BY x.country
        UNION ALL SELECT x.country, 'junctions', count(*) FROM places x JOIN places y ON x.place <> y.place AND (x.lat - y.lat) * (x.lat - y.lat) + (x.lng - y.lng) * (x.lng - y.lng) <= 144 GROUP BY x.country)
    SELECT country, kind, n FROM kinds""",
)
sql(
    "gr_merge_alias",
    """
    WITH keepers AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name, p_brand, p_type) AS keeper FROM part)
    SELECT l_orderkey, l_linenumber, coalesce(keeper, l_partkey) AS part FROM lineitem LEFT JOIN keepers ON l_partkey = p_partkey""",
)
