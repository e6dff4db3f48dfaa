"""Street-map tables derived from the star-schema tables, as views that both Spark and DuckDB can read.

Each definition is SQL over tables and earlier views. ``view`` gives a DataFrame, ``with_views`` the text of the common
table expressions for an oracle. Double literals are written ``1.5D``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from terrafold.sources.tables import table

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "node_records", "street_segment_records", "poi_records", "place_pages")

# Definitions of the test views.
VIEWS: dict[str, str] = {
    "intersections": """SELECT p_partkey AS intersection_id, 9000000000 + p_partkey AS osm_node_id, 43.50D + CAST(FLOOR(p_partkey / 20.0) AS DOUBLE) * 0.0015D AS lat,
  -79.60D + CAST(p_partkey % 20 AS DOUBLE) * 0.0020D AS lon FROM part""",
    "segments": """SELECT 2 * p_partkey AS segment_id, 5000000000 + CAST(FLOOR(p_partkey / 20.0) AS BIGINT) AS way_osm_id, p_partkey AS from_id, p_partkey + 1 AS to_id,
  CAST(FLOOR(p_partkey / 20.0) AS BIGINT) AS street_id, p_partkey % 7 = 3 AS one_way,
  CASE WHEN p_partkey % 97 = 96 THEN 0.0D ELSE 8.0D + CAST(p_size % 5 AS DOUBLE) * 3.0D END AS speed_mps
FROM part WHERE p_partkey % 20 < 19 AND p_partkey + 1 <= (SELECT MAX(p_partkey) FROM part)
UNION ALL
SELECT 2 * p_partkey + 1, 6000000000 + p_partkey % 20, p_partkey, p_partkey + 20, 1000000 + p_partkey % 20, p_partkey % 11 = 5, 8.0D + CAST(p_size % 5 AS DOUBLE) * 3.0D
FROM part WHERE p_partkey + 20 <= (SELECT MAX(p_partkey) FROM part)""",
    "curve_points": """SELECT s.segment_id, k.idx, a.lat + (b.lat - a.lat) * CAST(k.idx + 1 AS DOUBLE) / 3.0D + 0.0001D AS lat, a.lon + (b.lon - a.lon) * CAST(k.idx + 1 AS DOUBLE) / 3.0D - 0.0001D AS lon
FROM segments s JOIN intersections a ON a.intersection_id = s.from_id JOIN intersections b ON b.intersection_id = s.to_id CROSS JOIN (SELECT 0 AS idx UNION ALL SELECT 1) k
WHERE s.segment_id % 3 = 0 AND k.idx <= s.segment_id % 2""",
    "streets": """SELECT DISTINCT street_id, CASE WHEN street_id % 13 = 12 THEN '<unknown>' WHEN street_id >= 1000000 THEN CONCAT('Nation ', n.n_name, ' Avenue')
  ELSE CONCAT('Row ', CAST(street_id AS VARCHAR(20)), ' Street') END AS street_name FROM segments JOIN nation n ON n.n_nationkey = street_id % 25""",
    "pois": """SELECT c_custkey AS poi_id, 7000000000 + c_custkey AS osm_node_id, CASE c_custkey % 8 WHEN 0 THEN 'cafe' WHEN 1 THEN 'hospital' WHEN 2 THEN 'pub' WHEN 3 THEN 'clinic'
  WHEN 4 THEN 'cinema' WHEN 5 THEN 'fast_food' WHEN 6 THEN 'bus_station' ELSE 'bench' END AS poi_type, CONCAT(c_mktsegment, ' ', CAST(c_nationkey AS VARCHAR(20))) AS poi_name,
  43.50D + CAST(c_custkey % 97 AS DOUBLE) * 0.0011D AS lat, -79.60D + CAST(c_custkey % 41 AS DOUBLE) * 0.0009D AS lon FROM customer""",
    "features": "SELECT n_nationkey AS feature_id, n_nationkey % 11 AS feature_type_code, n_name AS feature_name FROM nation",
    "feature_points": """SELECT n.n_nationkey AS feature_id, k.idx, 43.50D + CAST(n.n_nationkey AS DOUBLE) * 0.002D + CASE WHEN k.idx IN (1, 2) THEN 0.001D ELSE 0.0D END AS lat,
  -79.60D + CASE WHEN k.idx IN (2, 3) THEN 0.002D ELSE 0.0D END AS lon
FROM nation n CROSS JOIN (SELECT 0 AS idx UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) k WHERE n.n_nationkey % 5 <> 0 OR k.idx < 4""",
    "way_tags": """SELECT 5000000000 + p_partkey AS way_osm_id, CASE p_partkey % 9 WHEN 0 THEN 'motorway_link' WHEN 1 THEN 'Primary' WHEN 2 THEN 'living_street' WHEN 3 THEN 'pedestrian'
  WHEN 4 THEN 'cycleway' WHEN 5 THEN 'unclassified' WHEN 6 THEN 'service' WHEN 7 THEN 'bridleway' ELSE NULL END AS highway,
  CASE p_partkey % 8 WHEN 0 THEN '50' WHEN 1 THEN '30 mph' WHEN 2 THEN '25MPH' WHEN 3 THEN 'none' WHEN 4 THEN '' WHEN 5 THEN '60;80' WHEN 6 THEN ' 4 0 ' ELSE NULL END AS maxspeed FROM part""",
    "deliveries": """SELECT o_orderkey AS delivery_id, (o_orderkey * 37 + 11) % (SELECT COUNT(*) FROM part) AS pick_up, (o_orderkey * 53 + o_custkey) % (SELECT COUNT(*) FROM part) AS drop_off
FROM orders WHERE o_orderkey < 25""",
    "depots": "SELECT (s_suppkey * 19 + 3) % (SELECT COUNT(*) FROM part) AS intersection_id FROM supplier WHERE s_suppkey < 10",
    "pings": "SELECT event_id, user_id, ts, 43.50D + CAST(event_id % 89 AS DOUBLE) * 0.0015D AS lat, -79.60D + CAST(user_id % 37 AS DOUBLE) * 0.0010D AS lon FROM events",
    # raw map entities: ways with references (some short, some to nodes that are not there), nodes with tags, relations
    "way_refs": """SELECT 5000000000 + p.p_partkey AS way_osm_id, k.idx, 9000000000 + p.p_partkey + k.idx * 3 AS node_id
FROM part p CROSS JOIN (SELECT 0 AS idx UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) k WHERE k.idx <= p.p_partkey % 4""",
    "node_tags": """SELECT 7000000000 + c_custkey AS osm_node_id, k.k AS tag_key, CASE k.k WHEN 'name' THEN c_name WHEN 'amenity' THEN 'cafe' WHEN 'shop' THEN 'bakery' WHEN 'tourism' THEN 'hotel'
  WHEN 'railway' THEN 'station' WHEN 'highway' THEN CASE WHEN c_custkey % 2 = 0 THEN 'Bus_Stop' ELSE 'crossing' END WHEN 'aeroway' THEN 'gate' ELSE 'subway' END AS tag_value
FROM customer CROSS JOIN (SELECT 'name' AS k UNION ALL SELECT 'amenity' UNION ALL SELECT 'shop' UNION ALL SELECT 'tourism' UNION ALL SELECT 'railway' UNION ALL SELECT 'highway' UNION ALL SELECT 'aeroway' UNION ALL SELECT 'station') k
WHERE (k.k = 'name' AND c_custkey % 7 <> 0) OR (k.k = 'amenity' AND c_custkey % 5 = 0) OR (k.k = 'shop' AND c_custkey % 6 = 1) OR (k.k = 'tourism' AND c_custkey % 4 = 2)
  OR (k.k = 'railway' AND c_custkey % 9 = 3) OR (k.k = 'highway' AND c_custkey % 8 = 4) OR (k.k = 'aeroway' AND c_custkey % 10 = 7) OR (k.k = 'station' AND c_custkey % 50 = 9)""",
    "way_kinds": """SELECT 5000000000 + p_partkey AS way_osm_id, CASE p_partkey % 6 WHEN 0 THEN 'tram' WHEN 1 THEN 'rail' WHEN 2 THEN 'monorail' WHEN 3 THEN 'light_rail' ELSE NULL END AS railway,
  CASE WHEN p_partkey % 15 = 7 THEN '2' ELSE NULL END AS tracks, CASE WHEN p_partkey % 11 = 4 THEN 'yes' ELSE NULL END AS embedded_rails,
  CASE WHEN p_partkey % 13 = 6 THEN 'left' ELSE NULL END AS embedded_lanes FROM part""",
    "relation_members": """SELECT 3000000000 + s.s_suppkey AS relation_id, k.idx, CASE WHEN k.idx = 2 THEN 'node' ELSE 'way' END AS member_type, 5000000000 + s.s_suppkey * 2 + k.idx AS ref,
  CASE WHEN k.idx = 3 THEN 'platform' ELSE '' END AS role FROM supplier s CROSS JOIN (SELECT 0 AS idx UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) k""",
    "relation_tags": """SELECT 3000000000 + s_suppkey AS relation_id, CASE WHEN s_suppkey % 3 = 0 THEN 'subway' ELSE 'bus' END AS route,
  CASE s_suppkey % 5 WHEN 0 THEN '#FF7900' WHEN 1 THEN 'yellow' WHEN 2 THEN 'green' WHEN 3 THEN 'purple' ELSE 'mauve' END AS colour, s_name AS name FROM supplier""",
    # routes along the rows of the grid, and tours over the stops
    "routes": """SELECT CAST(FLOOR(p_partkey / 20.0) AS BIGINT) AS request_id, CAST(p_partkey % 20 AS INT) AS seq, CASE WHEN p_partkey % 20 < 10 THEN 2 * p_partkey ELSE 2 * (p_partkey - p_partkey % 20 + 10) + 1 END AS segment_id
FROM part WHERE p_partkey % 20 <= 10 AND p_partkey + 40 <= (SELECT MAX(p_partkey) FROM part)""",
    "tours": """SELECT t.tour_id, ROW_NUMBER() OVER (PARTITION BY t.tour_id ORDER BY (d.delivery_id * 7 + d.kind * 11 * t.tour_id) % 31, d.kind, d.delivery_id) AS seq, d.intersection_id
FROM (SELECT delivery_id, 0 AS kind, pick_up AS intersection_id FROM deliveries UNION ALL SELECT delivery_id, 1, drop_off FROM deliveries) d
CROSS JOIN (SELECT 0 AS tour_id UNION ALL SELECT 1 UNION ALL SELECT 2) t""",
}


def _names(sql: str) -> list[str]:
    return [n for n in (*BASE, *VIEWS) if re.search(rf"\b(?:FROM|JOIN) {n}\b", sql)]


def view(spark: SparkSession, d: str, name: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """A table of the data directory, or a view derived from such. given: views that are there already, of which it is then made."""
    if given and name in given:
        return given[name]
    if name not in VIEWS:
        return table(spark, d, name)
    sql = VIEWS[name]
    needed = _names(sql)
    for n in needed:
        sql = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
    return spark.sql(sql, **{n: view(spark, d, n, given) for n in needed})


def _duck(sql: str) -> str:
    return re.sub(r"(-?\d+\.\d+)D\b", r"CAST(\1 AS DOUBLE)", sql)


def with_views(sql: str, recursive: bool = False) -> str:
    """``sql`` (which may begin with common table expressions after ``WITH``) preceded by the views that it names."""
    wanted: list[str] = []

    def add(names: list[str]) -> None:
        for n in names:
            if n in VIEWS and n not in wanted:
                add(_names(VIEWS[n]))
                wanted.append(n)

    add([n for n in VIEWS if re.search(rf"\b{n}\b", sql)])
    body = sql.strip()
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    rest = body[own.end() :] if own else ""
    views = ",\n".join(f"{n} AS MATERIALIZED ({_duck(VIEWS[n])})" for n in wanted)
    head = "WITH RECURSIVE " if recursive or (own and own.group(1)) else "WITH "
    if not views:
        return _duck(body)
    return f"{head}{views}{', ' + _duck(rest) if own else chr(10) + _duck(body)}"
