"""Queries and oracle SQL of the data-preparation operators of the core (p2 to p5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.operators import orphans, shred, spatial, units
from terrafold.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return spatial.nearby(table(spark, d, "poi_records"), table(spark, d, "node_records"), table(spark, d, "map_feature_points"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _speeds(spark, d).where("unit_code <> 'kmh'").select("row_id", "unit_code")


def p3_speeds(spark: SparkSession, d: str) -> DataFrame:
    """Every row's speed in km/h with the unit it was recorded in."""
    return _speeds(spark, d).select("row_id", "unit_code", F.round("speed_kph", 3).alias("speed_kph"), F.coalesce("is_unique", F.lit(False)).alias("is_unique"))


def _speeds(spark: SparkSession, d: str) -> DataFrame:
    return units.speed_units(table(spark, d, "street_segment_records"), table(spark, d, "speed_feeds"), table(spark, d, "speed_units"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(table(spark, d, "street_segment_records"), table(spark, d, "node_records"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("row_id", "node_id", "orphan_kind")


def p4_by_period(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans_by_period(_orphans(spark, d), "street_segment_records")


def p4_current(spark: SparkSession, d: str) -> DataFrame:
    return orphans.current_orphans(orphans.signed_counts(table(spark, d, "street_segment_records"), table(spark, d, "node_records")))


def p4_live(spark: SparkSession, d: str) -> DataFrame:
    """Orphans now, references of replaced segment rows being taken back."""
    return orphans.current_orphans(orphans.live_counts(table(spark, d, "street_segment_records"), table(spark, d, "node_records")))


def _shredded(spark: SparkSession, d: str, paths: str | None = None) -> DataFrame:
    return shred.shred(table(spark, d, "place_pages"), paths=paths)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return shred.place_items(_shredded(spark, d, shred.ITEM_PATHS)).select("page_id", "place_path", "item_kind", "item_key").distinct()


def p5_places(spark: SparkSession, d: str) -> DataFrame:
    return shred.places(_shredded(spark, d, shred.PLACE_PATHS))


def p5_geocodes(spark: SparkSession, d: str) -> DataFrame:
    return shred.place_items(_shredded(spark, d, shred.ITEM_PATHS)).where("item_kind = 'geocode'").select("page_id", "place_path", F.col("item_key").alias("geocode"), "lat", "lon")


def p5_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The adjacency table itself, nodes named by path and ordinals instead of their numbers."""
    return _shredded(spark, d).select(F.col("doc_id").alias("page_id"), "path", "at", "label", "kind", "scalar", F.when(F.col("label").isNull(), F.col("ordinal")).alias("ordinal"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p2_found, p3_found, p3_speeds, p4_found, p4_by_period, p4_current, p4_live, p5_found, p5_places, p5_geocodes, p5_nodes)}

_USABLE = "isfinite(lat) AND isfinite(lon) AND abs(lat) <= 90 AND abs(lon) <= 180 AND NOT (lat = 0 AND lon = 0)"

_P2 = f"""
WITH poi AS (SELECT osm_id, max(lat) AS lat, max(lon) AS lon FROM poi_records WHERE osm_id IS NOT NULL AND {_USABLE} GROUP BY osm_id),
ranked AS (SELECT *, coalesce({_USABLE}, false) AS u FROM node_records),
node AS (SELECT osm_id, lat, lon FROM ranked
  QUALIFY row_number() OVER (PARTITION BY osm_id ORDER BY version DESC, u DESC, is_visible DESC) = 1 AND u AND is_visible),
pts AS (SELECT DISTINCT feature_id, idx, lat, lon FROM map_feature_points),
closed AS (SELECT feature_id, min(lat) AS a, max(lat) AS b FROM pts GROUP BY 1
  HAVING min_by(lat, idx) = max_by(lat, idx) AND min_by(lon, idx) = max_by(lon, idx) AND count(*) >= 4),
e AS (SELECT feature_id, lat AS lat1, lon AS lon1, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM pts
  WINDOW w AS (PARTITION BY feature_id ORDER BY idx)),
x AS (SELECT p.osm_id, e.feature_id, p.lat, lat1, lat2, ((lon1 - p.lon + 540) % 360) - 180 AS x1, ((lon2 - lon1 + 540) % 360) - 180 AS d
  FROM poi p JOIN closed f ON p.lat BETWEEN f.a AND f.b JOIN e ON e.feature_id = f.feature_id AND e.lat2 IS NOT NULL)
SELECT 'near' AS pair_kind, p.osm_id AS poi_id, n.osm_id AS other_id
FROM poi p JOIN node n ON n.lat BETWEEN p.lat - 0.0003 AND p.lat + 0.0003
WHERE 2 * 6371008.8 * asin(least(1.0, sqrt(sin(radians(n.lat - p.lat) / 2) ^ 2
  + cos(radians(p.lat)) * cos(radians(n.lat)) * sin(radians(n.lon - p.lon) / 2) ^ 2))) <= 30
UNION ALL
SELECT 'inside', osm_id, CAST(feature_id AS BIGINT) FROM x
WHERE (x1 < 0) <> (x1 + d < 0) AND lat1 + (-x1 / d) * (lat2 - lat1) > lat
GROUP BY osm_id, feature_id HAVING count(*) % 2 = 1
"""

_UNIT_CASE = """CASE
  WHEN regexp_matches({0}, 'tenths?|1/10|x 0[.,]1|ten times') THEN 'dkmh'
  WHEN regexp_matches({0}, 'mph|m\\.p\\.h|mi/h|miles|meilen') THEN 'mph'
  WHEN regexp_matches({0}, '\\d ?kn|knots|\\d ?kts?\\b|\\d ?kt$|\\d ?kt[; ]') THEN 'kn'
  WHEN regexp_matches({0}, 'ft/s|fps|feet') THEN 'fps'
  WHEN regexp_matches({0}, 'km|kph|kilom|км') THEN 'kmh'
  WHEN regexp_matches({0}, 'm/s|m s-1|met(re|er)s|mètres|м/с') THEN 'mps' END"""

_SPEED_CTE = f"""
WITH s AS (SELECT row_id, feed, edited_at, CAST(max_speed_kph AS DOUBLE) AS stored,
  regexp_replace(lower(translate(max_speed_text, '０１２３４５６７８９．，；／', '0123456789.,;/')), '[\\s\u00a0\u2000-\u200b\u202f\u3000]+', ' ', 'g') AS t FROM street_segment_records),
n AS (SELECT *, CAST(replace(nullif(regexp_extract(t, '(\\d+([.,]\\d+)?)', 1), ''), ',', '.') AS DOUBLE) AS num,
  coalesce({_UNIT_CASE.format("regexp_extract(t, '^([^;]*\\d[^;]*)', 1)")}, {_UNIT_CASE.format("t")}) AS named FROM s),
f AS (SELECT feed, lower(speed_note) AS note, CASE WHEN regexp_matches(lower(speed_note), 'before 1 july 2024') THEN TIMESTAMP '2024-07-01' END AS cut,
  coalesce({_UNIT_CASE.format("lower(speed_note)")}, 'kmh') AS noted FROM speed_feeds),
g AS (SELECT n.*, CASE WHEN f.cut IS NOT NULL AND NOT coalesce(n.edited_at < f.cut, false) THEN 'kmh' ELSE coalesce(f.noted, 'kmh') END AS feed_unit
  FROM n LEFT JOIN f USING (feed)),
p AS (SELECT *, CASE WHEN num > 0 THEN num ELSE stored END AS posted,
  CASE WHEN num > 0 THEN coalesce(named, feed_unit) ELSE feed_unit END AS posted_unit FROM g WHERE stored > 0),
r AS (SELECT p.row_id, p.stored, u.unit_code, u.kph_factor, abs(ln(p.stored * u.kph_factor / (p.posted * q.kph_factor))) AS residual
  FROM p JOIN speed_units q ON q.unit_code = p.posted_unit CROSS JOIN speed_units u),
best AS (SELECT row_id, stored, min_by(unit_code, residual) AS unit_code, min_by(kph_factor, residual) AS kph_factor,
  list_sort(list(residual))[2] - min(residual) > greatest(0.002, 0.05 / stored) AS is_unique FROM r GROUP BY row_id, stored)
"""
_P3 = _SPEED_CTE + "SELECT row_id, unit_code FROM best WHERE unit_code <> 'kmh'"
_P3_SPEEDS = _SPEED_CTE + """SELECT s.row_id, best.unit_code, round(best.stored * best.kph_factor, 3) AS speed_kph, coalesce(best.is_unique, false) AS is_unique
FROM street_segment_records s LEFT JOIN best ON best.row_id = s.row_id"""

_P4_CTE = """
WITH r AS (SELECT DISTINCT row_id, loaded_at, unnest(node_refs) AS node_id FROM street_segment_records),
refs AS (SELECT * FROM r WHERE node_id IS NOT NULL),
j AS (SELECT refs.row_id, refs.node_id, refs.loaded_at, count(n.osm_id) AS n_any, count(CASE WHEN n.loaded_at <= refs.loaded_at THEN 1 END) AS n_then,
  max_by(n.is_visible, n.version) FILTER (n.loaded_at <= refs.loaded_at) AS visible
  FROM refs LEFT JOIN node_records n ON n.osm_id = refs.node_id GROUP BY ALL),
k AS (SELECT row_id, node_id, loaded_at, CASE WHEN n_any = 0 THEN 'missing' WHEN n_then = 0 THEN 'late' WHEN NOT visible THEN 'deleted' END AS orphan_kind FROM j)
"""
_P4 = _P4_CTE + "SELECT row_id, node_id, orphan_kind FROM k WHERE orphan_kind IS NOT NULL"
_P4_PERIOD = _P4_CTE + """SELECT 'street_segment_records' AS table_name, strftime(loaded_at, '%Y-%m') AS period, orphan_kind,
  CAST(count(*) AS BIGINT) AS n_refs, CAST(count(DISTINCT row_id) AS BIGINT) AS n_rows FROM k WHERE orphan_kind IS NOT NULL GROUP BY ALL"""
_P4_CURRENT = """
WITH r AS (SELECT DISTINCT row_id, unnest(node_refs) AS node_id FROM street_segment_records),
live AS (SELECT osm_id FROM node_records GROUP BY 1 HAVING max_by(is_visible, version))
SELECT node_id, CAST(count(*) AS BIGINT) AS n_refs FROM r WHERE node_id IS NOT NULL AND node_id NOT IN (SELECT osm_id FROM live) GROUP BY 1
"""

_P4_LIVE = """
WITH newest AS (SELECT osm_id, max_by(node_refs, {'e': coalesce(edited_at, TIMESTAMP '0001-01-01'), 'r': row_id}) AS refs FROM street_segment_records WHERE osm_id IS NOT NULL GROUP BY 1
  UNION ALL SELECT NULL, node_refs FROM street_segment_records WHERE osm_id IS NULL),
r AS (SELECT unnest(list_distinct(refs)) AS node_id FROM newest),
live AS (SELECT osm_id FROM node_records GROUP BY 1 HAVING max_by(is_visible, version))
SELECT node_id, CAST(count(*) AS BIGINT) AS n_refs FROM r WHERE node_id IS NOT NULL AND node_id NOT IN (SELECT osm_id FROM live) GROUP BY 1
"""

_P5_PLACES = """
WITH RECURSIVE ok AS (SELECT page_id, CAST(body AS JSON) AS j FROM place_pages WHERE body IS NOT NULL AND json_valid(body)),
arr AS (SELECT page_id, j -> '$.results' AS r FROM ok WHERE json_type(j -> '$.results') = 'ARRAY'),
places AS (
  SELECT page_id, CAST(i AS VARCHAR) AS place_path, CAST(NULL AS VARCHAR) AS parent_path, json_extract(r, '$[' || i || ']') AS p
  FROM (SELECT page_id, r, unnest(range(CAST(json_array_length(r) AS BIGINT))) AS i FROM arr)
  UNION ALL
  SELECT page_id, place_path || '.' || i, place_path, json_extract(c, '$[' || i || ']')
  FROM (SELECT page_id, place_path, c, unnest(range(CAST(json_array_length(c) AS BIGINT))) AS i
        FROM (SELECT page_id, place_path, p -> '$.related_places.children' AS c FROM places) WHERE json_type(c) = 'ARRAY'))
SELECT page_id, place_path, parent_path, p ->> '$.fsq_id' AS fsq_id, p ->> '$.name' AS name FROM places WHERE json_type(p) = 'OBJECT'
"""


def _decoded(v: str) -> str:
    """A JSON value, or the JSON that a text value holds."""
    return f"(CASE WHEN json_type({v}) = 'VARCHAR' AND ltrim({v} ->> '$')[1] IN ('{{', '[') AND json_valid({v} ->> '$') THEN CAST({v} ->> '$' AS JSON) ELSE {v} END)"


def _each(v: str) -> str:
    """A list's elements, or the value alone, as a list of JSON."""
    return f"(CASE json_type({v}) WHEN 'ARRAY' THEN CAST({v} AS JSON[]) ELSE [{v}] END)"


def _number(v: str) -> str:
    return f"(CASE WHEN json_type({v}) NOT IN ('BOOLEAN', 'OBJECT', 'ARRAY', 'NULL') THEN TRY_CAST(replace(trim({v} ->> '$'), ',', '.') AS DOUBLE) END)"


_P5 = (
    _P5_PLACES[: _P5_PLACES.rindex("SELECT page_id")]
    + f""", pl AS (SELECT page_id, place_path, {_decoded("(p -> '$.location')")} AS loc, {_decoded("(p -> '$.geocodes')")} AS geo, {_decoded("(p -> '$.website')")} AS web, {_decoded("(p -> '$.rating')")} AS rat
  FROM places WHERE json_type(p) = 'OBJECT'),
loc AS (SELECT page_id, place_path, unnest({_each("loc")}) AS l FROM pl),
geo AS (SELECT page_id, place_path, k, json_extract(geo, '$."' || k || '"') AS g FROM (SELECT page_id, place_path, geo, unnest(json_keys(geo)) AS k FROM pl WHERE json_type(geo) = 'OBJECT')
  UNION ALL SELECT page_id, place_path, g ->> '$.type', g FROM (SELECT page_id, place_path, unnest(CAST(geo AS JSON[])) AS g FROM pl WHERE json_type(geo) = 'ARRAY')),
gn AS (SELECT page_id, place_path, k, coalesce(g -> '$.latitude', g -> '$.lat') AS la, coalesce(g -> '$.longitude', g -> '$.lng') AS lo FROM geo WHERE json_type(g) = 'OBJECT'),
web AS (SELECT page_id, place_path, CASE json_type(w) WHEN 'OBJECT' THEN w ->> '$.url' WHEN 'VARCHAR' THEN w ->> '$' END AS u FROM (SELECT page_id, place_path, unnest({_each("web")}) AS w FROM pl)),
rat AS (SELECT page_id, place_path, replace(regexp_extract(CASE json_type(r) WHEN 'OBJECT' THEN r ->> '$.value' WHEN 'BOOLEAN' THEN NULL ELSE r ->> '$' END, '[+-]?[0-9]+([.,][0-9]+)?'), ',', '.') AS n
  FROM (SELECT page_id, place_path, rat AS r FROM pl))
SELECT DISTINCT page_id, place_path, item_kind, item_key FROM (
  SELECT page_id, place_path, 'address' AS item_kind, CASE json_type(l) WHEN 'OBJECT' THEN coalesce(nullif(l ->> '$.address', ''), nullif(l ->> '$.formatted_address', '')) WHEN 'VARCHAR' THEN nullif(l ->> '$', '') END AS item_key FROM loc
  UNION ALL SELECT page_id, place_path, 'geocode', k FROM gn WHERE {_number("la")} IS NOT NULL AND {_number("lo")} IS NOT NULL
  UNION ALL SELECT page_id, place_path, 'website', u FROM web WHERE trim(u) <> ''
  UNION ALL SELECT page_id, place_path, 'rating', CAST(CAST(round(CAST(n AS DECIMAL(18, 8)), 1) AS DECIMAL(18, 1)) AS VARCHAR) FROM rat WHERE n <> '')
WHERE item_key IS NOT NULL
"""
)

_P5_GEOCODES = _P5[: _P5.index("SELECT DISTINCT page_id")] + f"""
SELECT page_id, place_path, k AS geocode, {_number("la")} AS lat, {_number("lo")} AS lon FROM gn WHERE {_number("la")} IS NOT NULL AND {_number("lo")} IS NOT NULL"""

_P5_NODES = f"""
WITH RECURSIVE ok AS (SELECT page_id, CAST(body AS JSON) AS j FROM place_pages WHERE body IS NOT NULL AND json_valid(body)),
t AS (
  SELECT page_id, '' AS path, '' AS "at", CAST(NULL AS VARCHAR) AS label, CAST(NULL AS INT) AS ordinal, j AS raw, {_decoded("j")} AS v FROM ok
  UNION ALL
  SELECT page_id, path, "at", label, ordinal, raw, {_decoded("raw")} FROM (
    SELECT page_id, CASE WHEN path = '' THEN '' ELSE path || '/' END || replace(replace(replace(k, '~', '~0'), '/', '~1'), '[]', '~2') AS path, "at", k AS label, CAST(NULL AS INT) AS ordinal, json_extract(v, '$."' || k || '"') AS raw
    FROM (SELECT page_id, path, "at", v, unnest(json_keys(v)) AS k FROM t WHERE json_type(v) = 'OBJECT')
    UNION ALL
    SELECT page_id, path || '[]', CASE WHEN "at" = '' THEN '' ELSE "at" || '.' END || i, NULL, CAST(i AS INT), json_extract(v, '$[' || i || ']')
    FROM (SELECT page_id, path, "at", v, unnest(range(CAST(json_array_length(v) AS BIGINT))) AS i FROM t WHERE json_type(v) = 'ARRAY')))
SELECT page_id, path, "at", label, ordinal, CASE json_type(v) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind,
  CASE WHEN json_type(raw) NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN raw ->> '$' END AS scalar FROM t
"""

#: Flat places of the first level, for json_places.
P5_FLAT = _P5.replace("SELECT DISTINCT page_id", ", items AS (SELECT DISTINCT page_id") + f"""),
main AS (SELECT page_id, place_path, {_number("la")} AS lat, {_number("lo")} AS lon FROM gn WHERE k = 'main' AND {_number("la")} IS NOT NULL AND {_number("lo")} IS NOT NULL),
flat AS (SELECT page_id, place_path, min(item_key) FILTER (item_kind = 'address') AS address, min(item_key) FILTER (item_kind = 'website') AS website, min(item_key) FILTER (item_kind = 'rating') AS rating FROM items GROUP BY ALL)
SELECT p.page_id, p.place_path, p.p ->> '$.name' AS name, f.address, f.website, f.rating, m.lat, m.lon FROM places p LEFT JOIN flat f USING (page_id, place_path)
LEFT JOIN (SELECT page_id, place_path, min(lat) AS lat, min(lon) AS lon FROM main GROUP BY ALL) m USING (page_id, place_path) WHERE p.parent_path IS NULL AND json_type(p.p) = 'OBJECT'"""

ORACLES: dict[str, str] = {
    "p5_nodes": _P5_NODES, "p2_found": _P2, "p3_found": _P3, "p3_speeds": _P3_SPEEDS, "p4_found": _P4, "p4_by_period": _P4_PERIOD, "p4_current": _P4_CURRENT, "p4_live": _P4_LIVE, "p5_found": _P5, "p5_geocodes": _P5_GEOCODES, "p5_places": _P5_PLACES,
}
