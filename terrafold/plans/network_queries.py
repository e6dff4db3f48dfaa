"""Joins, aggregations, order-dependent operators, search and sources of the street map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrafold.functions import geo, tags
from terrafold.operators import features, network, osm, search, shred
from terrafold.plans.problem_queries import P5_FLAT
from terrafold.plans.registry import Registry
from terrafold.plans.scalar_queries import _CATEGORY, _CLASS, _LINES, _TAGS, _WAY_USE, MEAN, RADIUS, _r, _tagged_nodes, _way_kinds, dist_sql
from terrafold.session import local_path, shared_dir
from terrafold.sources import pbf
from terrafold.sources.fixtures import view

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

# 2.1 sources


def _ways(spark: SparkSession, d: str) -> DataFrame:
    """Raw ways: references in order and tags."""
    refs = view(spark, d, "way_refs").groupBy("way_osm_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "node_id"))), lambda r: r.node_id).alias("node_refs"))
    t = view(spark, d, "way_tags")
    entries = F.array(*(F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in ("highway", "maxspeed")))
    return refs.join(t.select("way_osm_id", F.map_from_entries(F.filter(entries, lambda e: e.v.isNotNull())).alias("tags")), "way_osm_id").withColumnRenamed("way_osm_id", "osm_id")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """Raw nodes: the crossings, every thirteenth without a place, and the POIs with their tags."""
    crossings = view(spark, d, "intersections").select(F.col("osm_node_id").alias("osm_id"), F.when(F.col("intersection_id") % 13 != 5, F.col("lat")).alias("lat"), "lon", F.lit(None).cast("map<string,string>").alias("tags"))
    return crossings.unionAll(_tagged_nodes(spark, d).select("osm_node_id", "lat", "lon", "tags"))


_HIGHWAYS = "hw AS (SELECT r.way_osm_id, r.idx, r.node_id FROM way_refs r JOIN way_tags t USING (way_osm_id) WHERE t.highway IS NOT NULL)"
_SPEED = r"""coalesce(CASE WHEN length(regexp_replace(t.maxspeed, '\s+', '', 'g')) > 3 AND lower(right(regexp_replace(t.maxspeed, '\s+', '', 'g'), 3)) = 'mph'
  THEN CAST(CAST(nullif(regexp_extract(regexp_replace(t.maxspeed, '\s+', '', 'g'), '^([+-]?(\d+\.?\d*|\.\d+))', 1), '') AS FLOAT) * CAST(1.60934 AS FLOAT) AS FLOAT)
  ELSE CAST(nullif(regexp_extract(regexp_replace(t.maxspeed, '\s+', '', 'g'), '^([+-]?(\d+\.?\d*|\.\d+))', 1), '') AS FLOAT) END, CAST(-1 AS FLOAT))"""


def _category_sql(column: str) -> str:
    return f"coalesce(CASE lower({column}) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in tags.HIGHWAY_CODES.items()) + " END, 0)"


@R.add(f"WITH {_HIGHWAYS} SELECT hw.way_osm_id AS osm_id, {_category_sql('t.highway')} AS category, {_SPEED} AS max_speed_kph, CAST(count(*) AS INT) AS n_refs FROM hw JOIN way_tags t USING (way_osm_id) GROUP BY hw.way_osm_id, t.highway, t.maxspeed HAVING count(*) >= 2")
def src_ways(spark: SparkSession, d: str) -> DataFrame:
    return osm.street_segments(_ways(spark, d)).select("osm_id", "category", "max_speed_kph", F.size("node_refs").alias("n_refs"))


@R.add(f"WITH {_HIGHWAYS} SELECT i.osm_node_id AS osm_id, i.lat, i.lon FROM intersections i WHERE i.intersection_id % 13 <> 5 AND i.osm_node_id IN (SELECT node_id FROM hw)")
def src_nodes(spark: SparkSession, d: str) -> DataFrame:
    return osm.referenced_nodes(_nodes(spark, d), _ways(spark, d))


@R.add(f"WITH {_TAGS}, c AS (SELECT p.osm_node_id, p.lat, p.lon, t.name, {_CATEGORY} AS category FROM pois p JOIN t USING (osm_node_id)) SELECT osm_node_id AS osm_id, lat, lon, category, coalesce(name, '') AS name FROM c WHERE category IS NOT NULL")
def src_pois(spark: SparkSession, d: str) -> DataFrame:
    return osm.points_of_interest(_nodes(spark, d))


@R.add(f"WITH {_HIGHWAYS} SELECT DISTINCT node_id FROM hw WHERE node_id NOT IN (SELECT osm_node_id FROM intersections WHERE intersection_id % 13 <> 5)")
def missing_refs(spark: SparkSession, d: str) -> DataFrame:
    return osm.missing_references(_nodes(spark, d), _ways(spark, d))


@R.add(f"""WITH {_HIGHWAYS}, n AS (SELECT osm_node_id FROM intersections WHERE intersection_id % 13 <> 5), s AS (SELECT way_osm_id FROM hw GROUP BY 1 HAVING count(*) >= 2),
{_TAGS}, c AS (SELECT {_CATEGORY} AS category FROM pois p JOIN t USING (osm_node_id))
SELECT (SELECT count(*) FROM n WHERE osm_node_id IN (SELECT node_id FROM hw)) AS n_nodes, (SELECT count(*) FROM s) AS n_segments, (SELECT count(category) FROM c) AS n_pois,
  (SELECT count(DISTINCT node_id) FROM hw WHERE node_id NOT IN (SELECT osm_node_id FROM n)) AS n_missing""")
def pbf_read(spark: SparkSession, d: str) -> DataFrame:
    """What a whole conversion of nodes and ways comes to that are written as PBF extracts and read again."""
    path = f"{local_path(shared_dir(spark))}/pbf_read"
    pbf.write_pbf(_nodes(spark, d), _ways(spark, d), path)
    read = pbf.read_pbf(spark, path)
    return osm.summary(pbf.nodes(read), pbf.ways(read))


@R.add("""SELECT way_osm_id AS osm_id, k AS tag_key, v AS tag_value FROM (SELECT way_osm_id, 'highway' AS k, highway AS v FROM way_tags UNION ALL SELECT way_osm_id, 'maxspeed', maxspeed FROM way_tags) WHERE v IS NOT NULL""")
def csv_tags(spark: SparkSession, d: str) -> DataFrame:
    """All tags of ways, dumped as CSV lines to the shared folder and read again."""
    path = f"{shared_dir(spark)}/csv_tags"
    form = {"quoteAll": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"', "nullValue": "\\N"}
    tags_ = _ways(spark, d).select("osm_id", F.explode("tags").alias("tag_key", "tag_value"))
    tags_.write.mode("overwrite").options(**form).csv(path)
    return spark.read.schema(tags_.schema).options(**form).csv(path)


@R.add("SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{t}', '{p}')" for c, t, p in search.CATALOG) + ") AS t(country, city, path)")
def catalog(spark: SparkSession, d: str) -> DataFrame:
    return search.catalog(spark)


@R.add("SELECT city, path FROM (VALUES " + ", ".join(f"('{c}', '{t}', '{p}')" for c, t, p in search.CATALOG) + ") AS t(country, city, path) WHERE country = 'canada'")
def city_lookup(spark: SparkSession, d: str) -> DataFrame:
    return search.cities(spark, "CANADA ")


@R.add(P5_FLAT)
def json_places(spark: SparkSession, d: str) -> DataFrame:
    """Places of search answers as flat rows: name, address, website, rating to one decimal and main position."""
    nodes = shred.shred(view(spark, d, "place_pages"))
    items = shred.place_items(nodes)
    at = F.col("item_kind")
    flat = items.groupBy("page_id", "place_path").agg(
        F.min(F.when(at == "address", F.col("item_key"))).alias("address"), F.min(F.when(at == "website", F.col("item_key"))).alias("website"), F.min(F.when(at == "rating", F.col("item_key"))).alias("rating"),
        F.min(F.when((at == "geocode") & (F.col("item_key") == "main"), F.col("lat"))).alias("lat"), F.min(F.when((at == "geocode") & (F.col("item_key") == "main"), F.col("lon"))).alias("lon"),
    )
    return shred.places(nodes).where("parent_path IS NULL").join(flat, ["page_id", "place_path"], "left").select("page_id", "place_path", "name", "address", "website", "rating", "lat", "lon")


# 2.4 joins


@R.add("SELECT s.segment_id, a.lat AS from_lat, a.lon AS from_lon, b.lat AS to_lat, b.lon AS to_lon FROM segments s JOIN intersections a ON a.intersection_id = s.from_id JOIN intersections b ON b.intersection_id = s.to_id")
def seg_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return network.endpoints(view(spark, d, "segments"), view(spark, d, "intersections")).select("segment_id", "from_lat", "from_lon", "to_lat", "to_lon")


@R.add("SELECT s.segment_id, CASE WHEN t.highway IN (" + ", ".join(f"'{x}'" for x in tags.ROAD_TYPES) + ") THEN t.highway ELSE 'other' END AS road_type FROM segments s LEFT JOIN way_tags t USING (way_osm_id)")
def seg_road_type(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "segments").join(view(spark, d, "way_tags"), "way_osm_id", "left").select("segment_id", tags.road_type(F.col("highway")).alias("road_type"))


@R.add("SELECT w.way_osm_id, coalesce(f.feature_name, 'Unknown') AS feature_name FROM way_tags w LEFT JOIN features f ON f.feature_id = w.way_osm_id - 5000000000")
def way_feature(spark: SparkSession, d: str) -> DataFrame:
    f = view(spark, d, "features").select((F.col("feature_id") + 5000000000).alias("way_osm_id"), "feature_name")
    return view(spark, d, "way_tags").join(f, "way_osm_id", "left").select("way_osm_id", F.coalesce("feature_name", F.lit("Unknown")).alias("feature_name"))


@R.add("SELECT r.way_osm_id, r.idx, i.lat, i.lon FROM way_refs r JOIN intersections i ON i.osm_node_id = r.node_id")
def way_points(spark: SparkSession, d: str) -> DataFrame:
    n = view(spark, d, "intersections").select(F.col("osm_node_id").alias("node_id"), "lat", "lon")
    return view(spark, d, "way_refs").join(n, "node_id").select("way_osm_id", "idx", "lat", "lon")


_SUBWAY = """sw AS (SELECT t.relation_id, t.colour, m.idx AS member, r.idx, i.lat, i.lon FROM relation_tags t JOIN relation_members m USING (relation_id) JOIN way_refs r ON r.way_osm_id = m.ref
  JOIN intersections i ON i.osm_node_id = r.node_id WHERE t.route = 'subway' AND m.member_type = 'way' AND m.role <> 'platform')"""


def _subways(spark: SparkSession, d: str) -> DataFrame:
    n = view(spark, d, "intersections").select(F.col("osm_node_id").alias("node_id"), "lat", "lon")
    return osm.subway_lines(view(spark, d, "relation_tags"), view(spark, d, "relation_members"), view(spark, d, "way_refs"), n)


@R.add(f"WITH {_SUBWAY} SELECT relation_id, colour, CAST(count(DISTINCT member) AS BIGINT) AS n_ways, CAST(count(*) AS BIGINT) AS n_points FROM sw GROUP BY 1, 2")
def subway_lines(spark: SparkSession, d: str) -> DataFrame:
    return _subways(spark, d).groupBy("relation_id", "colour").agg(F.count_distinct("member").alias("n_ways"), F.count(F.lit(1)).alias("n_points"))


@R.add(f"""WITH {_SUBWAY}, l AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM sw WINDOW w AS (PARTITION BY relation_id, member ORDER BY idx))
SELECT relation_id, member, idx, lat AS lat1, lon AS lon1, lat2, lon2 FROM l WHERE lat2 IS NOT NULL""")
def subway_pieces(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("relation_id", "member").orderBy("idx")
    p = _subways(spark, d).select("relation_id", "member", "idx", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.lead("lat").over(w).alias("lat2"), F.lead("lon").over(w).alias("lon2"))
    return p.where("lat2 IS NOT NULL")


@R.add("SELECT t.relation_id, t.name, CAST(count(*) AS BIGINT) AS n_members, min_by(m.member_type, m.idx) AS first_type, string_agg(m.role, ',' ORDER BY m.idx) AS roles FROM relation_tags t JOIN relation_members m USING (relation_id) GROUP BY 1, 2")
def relations(spark: SparkSession, d: str) -> DataFrame:
    m = view(spark, d, "relation_members").groupBy("relation_id").agg(F.array_sort(F.collect_list(F.struct("idx", "member_type", "role"))).alias("m"))
    r = view(spark, d, "relation_tags").join(m, "relation_id")
    return r.select("relation_id", "name", F.size("m").cast("long").alias("n_members"), F.col("m")[0]["member_type"].alias("first_type"), F.array_join(F.transform("m", lambda x: x.role), ",").alias("roles"))


@R.add(f"""WITH c AS (SELECT p.poi_id, i.intersection_id, {RADIUS} * sqrt(power(radians(i.lat) - radians(p.lat), 2) + power((radians(i.lon) - radians(p.lon)) * cos((radians(p.lat) + radians(i.lat)) / 2), 2)) AS m
  FROM pois p CROSS JOIN intersections i)
SELECT poi_id, min_by(intersection_id, {{'m': round(m, 6), 'i': intersection_id}}) AS intersection_id, round(min(round(m, 6)), 2) AS metres FROM c GROUP BY 1""")
def nearest_intersection(spark: SparkSession, d: str) -> DataFrame:
    probes = view(spark, d, "pois").select(F.col("poi_id").alias("probe_id"), "lat", "lon")
    n = network.nearest(probes, view(spark, d, "intersections").select(F.col("intersection_id").alias("target_id"), "lat", "lon"))
    return n.select(F.col("probe_id").alias("poi_id"), F.col("target_id").alias("intersection_id"), _r("metres", 2).alias("metres"))


@R.add(f"""WITH c AS (SELECT i.intersection_id, p.poi_id, round({dist_sql('i', 'p')}, 6) AS m FROM (SELECT *, 'BUILDING ' || (intersection_id % 25) AS wanted FROM intersections) i JOIN pois p ON p.poi_name = i.wanted)
SELECT i.intersection_id, min_by(c.poi_id, {{'m': c.m, 'i': c.poi_id}}) AS poi_id FROM intersections i LEFT JOIN c USING (intersection_id) GROUP BY 1""")
def nearest_poi(spark: SparkSession, d: str) -> DataFrame:
    """The nearest POI of a given name for each crossing; null where there is none."""
    i = view(spark, d, "intersections").withColumn("wanted", F.concat(F.lit("BUILDING "), (F.col("intersection_id") % 25).cast("string")))
    return search.nearest_named(i, view(spark, d, "pois")).select("intersection_id", "poi_id")


@R.add(f"""WITH k AS (SELECT feature_id, lat, lon FROM feature_points WHERE idx = 0),
c AS (SELECT k.feature_id, 'food' AS kind, min(round({dist_sql('k', 'p')}, 6)) AS m, min_by(p.poi_id, {{'m': round({dist_sql('k', 'p')}, 6), 'i': p.poi_id}}) AS id FROM k CROSS JOIN pois p WHERE p.poi_type IN ('cafe', 'fast_food') GROUP BY 1
  UNION ALL SELECT k.feature_id, 'shop', min(round({dist_sql('k', 'p')}, 6)), min_by(p.poi_id, {{'m': round({dist_sql('k', 'p')}, 6), 'i': p.poi_id}}) FROM k CROSS JOIN pois p WHERE p.poi_type = 'pub' GROUP BY 1
  UNION ALL SELECT k.feature_id, 'crossing', min(round({dist_sql('k', 'i')}, 6)), min_by(i.intersection_id, {{'m': round({dist_sql('k', 'i')}, 6), 'i': i.intersection_id}}) FROM k CROSS JOIN intersections i GROUP BY 1),
w AS (SELECT feature_id, max(m) FILTER (kind = 'food') AS fm, max(id) FILTER (kind = 'food') AS f, max(m) FILTER (kind = 'shop') AS sm, max(id) FILTER (kind = 'shop') AS s, max(id) FILTER (kind = 'crossing') AS x FROM c GROUP BY 1)
SELECT feature_id, CASE WHEN fm <= sm AND fm < 150 THEN 'food' WHEN sm < 150 THEN 'shop' ELSE 'crossing' END AS kind, CASE WHEN fm <= sm AND fm < 150 THEN f WHEN sm < 150 THEN s ELSE x END AS picked_id FROM w""")
def click_pick(spark: SparkSession, d: str) -> DataFrame:
    """What a click at each feature's first point picks: food if nearest and within 150 m, else a shop within 150 m, else a crossing."""
    k = view(spark, d, "feature_points").where("idx = 0").select(F.col("feature_id").alias("probe_id"), "lat", "lon")
    p = view(spark, d, "pois")
    return search.picked(k, p.where(F.col("poi_type").isin("cafe", "fast_food")), p.where("poi_type = 'pub'"), view(spark, d, "intersections")).withColumnRenamed("probe_id", "feature_id")


@R.add("""WITH q AS (SELECT intersection_id AS a, intersection_id + k AS b FROM intersections CROSS JOIN (SELECT unnest([0, 1, 20, 21]) AS k))
SELECT a, b, a = b OR EXISTS (SELECT 1 FROM segments s WHERE (s.from_id = q.a AND s.to_id = q.b) OR (s.from_id = q.b AND s.to_id = q.a)) AS connected FROM q""")
def directly_connected(spark: SparkSession, d: str) -> DataFrame:
    q = view(spark, d, "intersections").select(F.col("intersection_id").alias("a"), F.explode(F.array(*(F.col("intersection_id") + k for k in (0, 1, 20, 21)))).alias("b"))
    n = network.adjacency(view(spark, d, "segments")).select(F.col("intersection_id").alias("a"), F.col("neighbour_id").alias("b"), F.lit(True).alias("near")).distinct()
    return q.join(n, ["a", "b"], "left").select("a", "b", ((F.col("a") == F.col("b")) | F.coalesce("near", F.lit(False))).alias("connected"))


_STREET_X = "sx AS (SELECT street_id, from_id AS intersection_id FROM segments UNION SELECT street_id, to_id FROM segments)"


@R.add(f"WITH {_STREET_X} SELECT a.street_id AS street_1, b.street_id AS street_2, a.intersection_id FROM sx a JOIN sx b ON a.intersection_id = b.intersection_id AND a.street_id < b.street_id")
def two_street_intersections(spark: SparkSession, d: str) -> DataFrame:
    return search.crossings(view(spark, d, "segments"))


# 2.5 aggregations

_LENGTHS = f"""{_LINES}, pc AS (SELECT segment_id, l, unnest(range(1, len(l))) AS k FROM lines), sl AS (SELECT segment_id, sum({dist_sql('l[k]', 'l[k + 1]')}) AS length FROM pc GROUP BY 1),
m AS (SELECT s.*, sl.length, CASE WHEN s.speed_mps = 0 THEN 0.0 ELSE sl.length / s.speed_mps END AS seconds FROM segments s JOIN sl USING (segment_id))"""


def metrics(spark: SparkSession, d: str) -> DataFrame:
    return network.segment_metrics(view(spark, d, "segments"), view(spark, d, "intersections"), view(spark, d, "curve_points"))


@R.add(f"WITH {_LENGTHS} SELECT segment_id, round(length, 6) AS length FROM m")
def segment_length(spark: SparkSession, d: str) -> DataFrame:
    return metrics(spark, d).select("segment_id", _r("length").alias("length"))


@R.add(f"WITH {_LENGTHS} SELECT segment_id, round(seconds, 6) AS seconds FROM m")
def segment_time(spark: SparkSession, d: str) -> DataFrame:
    return metrics(spark, d).select("segment_id", _r("seconds").alias("seconds"))


@R.add(f"WITH {_LENGTHS} SELECT street_id, round(sum(length), 4) AS length FROM m GROUP BY 1")
def street_length(spark: SparkSession, d: str) -> DataFrame:
    return metrics(spark, d).groupBy("street_id").agg(_r(F.sum("length"), 4).alias("length"))


@R.add(f"WITH {_STREET_X} SELECT street_id, string_agg(CAST(intersection_id AS VARCHAR), ',' ORDER BY intersection_id) AS intersections FROM sx GROUP BY 1")
def street_intersections(spark: SparkSession, d: str) -> DataFrame:
    x = network.street_intersections(view(spark, d, "segments")).groupBy("street_id").agg(F.array_sort(F.collect_list("intersection_id")).alias("a"))
    return x.select("street_id", F.array_join(F.transform("a", lambda v: v.cast("string")), ",").alias("intersections"))


@R.add("SELECT intersection_id, string_agg(CAST(segment_id AS VARCHAR), ',' ORDER BY segment_id) AS segments FROM (SELECT from_id AS intersection_id, segment_id FROM segments UNION SELECT to_id, segment_id FROM segments) GROUP BY 1")
def intersection_segments(spark: SparkSession, d: str) -> DataFrame:
    x = network.adjacency(view(spark, d, "segments")).groupBy("intersection_id").agg(F.array_sort(F.collect_set("segment_id")).alias("a"))
    return x.select("intersection_id", F.array_join(F.transform("a", lambda v: v.cast("string")), ",").alias("segments"))


@R.add(f"""WITH p AS (SELECT r.way_osm_id, r.idx, i.lat, i.lon FROM way_refs r LEFT JOIN intersections i ON i.osm_node_id = r.node_id),
l AS (SELECT way_osm_id, {{'lat': lat, 'lon': lon}} AS a, {{'lat': lead(lat) OVER w, 'lon': lead(lon) OVER w}} AS b FROM p WINDOW w AS (PARTITION BY way_osm_id ORDER BY idx))
SELECT way_osm_id, round(coalesce(sum({dist_sql('a', 'b')}), 0.0), 6) AS length FROM l GROUP BY 1""")
def way_length(spark: SparkSession, d: str) -> DataFrame:
    n = view(spark, d, "intersections").select(F.col("osm_node_id").alias("node_id"), "lat", "lon")
    return osm.way_lengths(view(spark, d, "way_refs"), n).select("way_osm_id", _r("length").alias("length"))


@R.add(f"""WITH a AS (SELECT *, avg(radians(lat)) OVER (PARTITION BY feature_id) AS m FROM feature_points),
x AS (SELECT feature_id, idx, {RADIUS} * radians(lon) * cos(m) AS x, {RADIUS} * radians(lat) AS y FROM a),
l AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM x WINDOW w AS (PARTITION BY feature_id ORDER BY idx)),
s AS (SELECT feature_id, abs(sum((y + y2) * (x - x2))) / 2 AS area FROM l GROUP BY 1), c AS (SELECT feature_id, count(*) > 1 AND min_by(lat, idx) = max_by(lat, idx) AND min_by(lon, idx) = max_by(lon, idx) AS closed FROM feature_points GROUP BY 1)
SELECT f.feature_id, round(CASE WHEN c.closed THEN s.area ELSE 0.0 END, 1) AS area FROM features f LEFT JOIN s USING (feature_id) LEFT JOIN c USING (feature_id)""")
def feature_area(spark: SparkSession, d: str) -> DataFrame:
    return features.areas(view(spark, d, "features"), view(spark, d, "feature_points")).select("feature_id", _r("area", 1).alias("area"))


@R.add("SELECT min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon, round(radians((min(lat) + max(lat)) / 2), 9) AS mean_lat FROM intersections")
def map_bounds(spark: SparkSession, d: str) -> DataFrame:
    return network.bounds(view(spark, d, "intersections")).withColumn("mean_lat", _r("mean_lat", 9))


@R.add("SELECT greatest(max(speed_mps), 0.0) AS max_speed FROM segments")
def max_speed(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "segments").agg(F.greatest(F.max("speed_mps"), F.lit(0.0)).alias("max_speed"))


_SEG_BOX = f"""{_LINES}, sp AS (SELECT segment_id, unnest(l) AS p FROM lines), sb AS (SELECT segment_id, min(p.lat) AS min_lat, max(p.lat) AS max_lat, min(p.lon) AS min_lon, max(p.lon) AS max_lon FROM sp GROUP BY 1)"""


def _segment_boxes(spark: SparkSession, d: str) -> DataFrame:
    lines = network.segment_polylines(view(spark, d, "segments"), view(spark, d, "intersections"), view(spark, d, "curve_points"))
    lat, lon = F.transform("line", lambda p: p.lat), F.transform("line", lambda p: p.lon)
    mid = [_r((F.col(f"from_{c}") + F.col(f"to_{c}")) / 2, 9).alias(f"mid_{c}") for c in ("lat", "lon")]
    return lines.select("segment_id", F.array_min(lat).alias("min_lat"), F.array_max(lat).alias("max_lat"), F.array_min(lon).alias("min_lon"), F.array_max(lon).alias("max_lon"), *mid)


@R.add(f"WITH {_SEG_BOX} SELECT sb.*, round((l[1].lat + l[-1].lat) / 2, 9) AS mid_lat, round((l[1].lon + l[-1].lon) / 2, 9) AS mid_lon FROM sb JOIN lines USING (segment_id)")
def segment_bbox(spark: SparkSession, d: str) -> DataFrame:
    return _segment_boxes(spark, d)


@R.add(f"WITH {_SEG_BOX} SELECT r.request_id, min(min_lat) AS min_lat, max(max_lat) AS max_lat, min(min_lon) AS min_lon, max(max_lon) AS max_lon FROM routes r JOIN sb USING (segment_id) GROUP BY 1")
def route_bbox(spark: SparkSession, d: str) -> DataFrame:
    j = view(spark, d, "routes").join(_segment_boxes(spark, d), "segment_id")
    return j.groupBy("request_id").agg(F.min("min_lat").alias("min_lat"), F.max("max_lat").alias("max_lat"), F.min("min_lon").alias("min_lon"), F.max("max_lon").alias("max_lon"))


@R.add("SELECT feature_id, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon, round((min(lon) + max(lon)) / 2, 9) AS x_avg, round((min(lat) + max(lat)) / 2, 9) AS y_avg FROM feature_points GROUP BY 1")
def feature_bbox(spark: SparkSession, d: str) -> DataFrame:
    b = features.boxes(view(spark, d, "feature_points"))
    return b.withColumns({"x_avg": _r((F.col("min_lon") + F.col("max_lon")) / 2, 9), "y_avg": _r((F.col("min_lat") + F.col("max_lat")) / 2, 9)})


@R.add(f"SELECT {_CLASS} AS poi_class, poi_type, CAST(count(*) AS BIGINT) AS n FROM pois GROUP BY 1, 2")
def poi_counts(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "pois").groupBy(tags.poi_class(F.col("poi_type")).alias("poi_class"), "poi_type").agg(F.count(F.lit(1)).alias("n"))


@R.add(f"""WITH {_LENGTHS}, q AS (SELECT DISTINCT street_id AS request_id FROM segments), j AS (SELECT r.request_id, m.seconds, m.street_id <> lag(m.street_id) OVER (PARTITION BY r.request_id ORDER BY r.seq) AS turns FROM routes r JOIN m USING (segment_id)),
c AS (SELECT request_id, sum(seconds) + 15.0 * count(CASE WHEN turns THEN 1 END) AS s FROM j GROUP BY 1) SELECT q.request_id, CASE WHEN c.s IS NULL THEN 'Infinity'::DOUBLE ELSE round(c.s, 5) END AS seconds FROM q LEFT JOIN c USING (request_id)""")
def path_time(spark: SparkSession, d: str) -> DataFrame:
    requests = view(spark, d, "segments").select(F.col("street_id").alias("request_id")).distinct()
    t = network.path_times(view(spark, d, "routes"), metrics(spark, d), 15.0, requests)
    return t.select("request_id", F.when(F.col("seconds") == float("inf"), F.col("seconds")).otherwise(_r("seconds", 5)).alias("seconds"))


@R.add("SELECT intersection_id FROM depots UNION SELECT pick_up FROM deliveries UNION SELECT drop_off FROM deliveries")
def unique_stops(spark: SparkSession, d: str) -> DataFrame:
    x = view(spark, d, "deliveries")
    return view(spark, d, "depots").union(x.select("pick_up")).union(x.select("drop_off")).distinct()


@R.add("""WITH p AS (SELECT pick_up AS id, string_agg(CAST(drop_off AS VARCHAR), ',' ORDER BY drop_off) AS l FROM (SELECT DISTINCT pick_up, drop_off FROM deliveries) GROUP BY 1),
o AS (SELECT drop_off AS id, string_agg(CAST(pick_up AS VARCHAR), ',' ORDER BY pick_up) AS l FROM (SELECT DISTINCT pick_up, drop_off FROM deliveries) GROUP BY 1)
SELECT coalesce(p.id, o.id) AS intersection_id, p.id IS NOT NULL AS is_pick_up, o.id IS NOT NULL AS is_drop_off, coalesce(p.l, '') AS drop_offs, coalesce(o.l, '') AS pick_ups FROM p FULL JOIN o ON p.id = o.id""")
def delivery_details(spark: SparkSession, d: str) -> DataFrame:
    x = view(spark, d, "deliveries").select("pick_up", "drop_off")

    def side(own: str, other: str) -> DataFrame:
        ids = F.transform(F.array_sort(F.collect_set(other)), lambda v: v.cast("string"))
        return x.groupBy(F.col(own).alias("intersection_id")).agg(F.array_join(ids, ",").alias(f"{other}s"))

    j = side("pick_up", "drop_off").join(side("drop_off", "pick_up"), "intersection_id", "full")
    return j.select("intersection_id", F.col("drop_offs").isNotNull().alias("is_pick_up"), F.col("pick_ups").isNotNull().alias("is_drop_off"), F.coalesce("drop_offs", F.lit("")).alias("drop_offs"), F.coalesce("pick_ups", F.lit("")).alias("pick_ups"))


# 2.6 order-dependent

_TURNS = f"""{_LINES}, st AS (SELECT request_id, seq, segment_id, lead(segment_id) OVER (PARTITION BY request_id ORDER BY seq) AS nxt FROM routes),
tj AS (SELECT st.*, s.street_id, n.street_id AS next_street,
  CASE WHEN s.to_id = n.from_id THEN [s.l[-2], s.l[-1], n.l[2]] WHEN s.from_id = n.from_id THEN [s.l[2], s.l[1], n.l[2]] WHEN s.to_id = n.to_id THEN [s.l[-2], s.l[-1], n.l[-2]] ELSE [s.l[2], s.l[1], n.l[-2]] END AS t
  FROM st JOIN lines s ON s.segment_id = st.segment_id LEFT JOIN lines n ON n.segment_id = st.nxt),
tx AS (SELECT *, atan2(radians(t[2].lat) - radians(t[1].lat), (radians(t[2].lon) - radians(t[1].lon)) * cos({MEAN})) AS b, atan2(radians(t[3].lat) - radians(t[2].lat), (radians(t[3].lon) - radians(t[2].lon)) * cos({MEAN})) AS a FROM tj),
tn AS (SELECT request_id, seq, segment_id, nxt AS next_segment, street_id, next_street, CASE WHEN nxt IS NULL THEN NULL WHEN abs(b - a) < 0.17 THEN 'STRAIGHT'
  WHEN b * a > 0 THEN CASE WHEN abs(a) = abs(b) THEN 'STRAIGHT' WHEN (abs(a) > abs(b)) = (b > 0) THEN 'LEFT' ELSE 'RIGHT' END
  WHEN b * a < 0 THEN CASE WHEN abs(a) = pi() - abs(b) THEN 'STRAIGHT' WHEN (abs(a) > pi() - abs(b)) = (b > 0) THEN 'LEFT' ELSE 'RIGHT' END
  WHEN b > a THEN 'RIGHT' WHEN b < a THEN 'LEFT' ELSE 'STRAIGHT' END AS turn FROM tx)"""


def _turns(spark: SparkSession, d: str) -> DataFrame:
    i = view(spark, d, "intersections")
    lines = network.segment_polylines(view(spark, d, "segments"), i, view(spark, d, "curve_points"))
    return network.route_turns(view(spark, d, "routes"), lines, network.bounds(i))


@R.add(f"WITH {_TURNS} SELECT request_id, seq, turn FROM tn WHERE turn IS NOT NULL")
def turn_direction(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).where("turn IS NOT NULL").select("request_id", "seq", "turn")


def _words(turn: Column) -> Column:
    return F.coalesce(F.when(turn == "STRAIGHT", "Go straight at: ").when(turn == "LEFT", "Turn left at: ").when(turn == "RIGHT", "Turn right at:  "), F.lit(""))


_WORDS = "CASE turn WHEN 'STRAIGHT' THEN 'Go straight at: ' WHEN 'LEFT' THEN 'Turn left at: ' WHEN 'RIGHT' THEN 'Turn right at:  ' ELSE '' END"


@R.add(f"WITH {_TURNS} SELECT request_id, seq, {_WORDS} AS text FROM tn")
def directions(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).select("request_id", "seq", _words(F.col("turn")).alias("text"))


@R.add(f"WITH {_TURNS} SELECT request_id, seq, {_WORDS} || coalesce(s.street_name, '') AS line FROM tn LEFT JOIN streets s ON s.street_id = tn.next_street WHERE tn.next_street <> tn.street_id")
def itinerary(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d).where("next_street <> street_id")
    s = view(spark, d, "streets").withColumnRenamed("street_id", "next_street")
    return t.join(s, "next_street", "left").select("request_id", "seq", F.concat(_words(F.col("turn")), F.coalesce("street_name", F.lit(""))).alias("line"))


@R.add("""WITH r AS (SELECT r.*, s.from_id, s.to_id, lead(s.from_id) OVER w AS nf, lead(s.to_id) OVER w AS nt, lag(s.from_id) OVER w AS pf, lag(s.to_id) OVER w AS pt FROM routes r JOIN segments s USING (segment_id) WINDOW w AS (PARTITION BY r.request_id ORDER BY r.seq))
SELECT request_id, seq, CASE WHEN nf IS NOT NULL THEN to_id IN (nf, nt) ELSE coalesce(from_id IN (pf, pt), true) END AS forward FROM r""")
def route_orientation(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("request_id").orderBy("seq")
    r = view(spark, d, "routes").join(view(spark, d, "segments").select("segment_id", "from_id", "to_id"), "segment_id")
    r = r.withColumns({"nf": F.lead("from_id").over(w), "nt": F.lead("to_id").over(w), "pf": F.lag("from_id").over(w), "pt": F.lag("to_id").over(w)})
    on = F.when(F.col("nf").isNotNull(), (F.col("to_id") == F.col("nf")) | (F.col("to_id") == F.col("nt"))).otherwise(F.coalesce((F.col("from_id") == F.col("pf")) | (F.col("from_id") == F.col("pt")), F.lit(True)))
    return r.select("request_id", "seq", on.alias("forward"))


# 2.7 sorts, limits, sets


@R.add("SELECT feature_id, CAST(list_position(['glacier','lake','island','beach','river','stream','greenspace','park','golfcourse','unknown','building'], (['unknown','park','beach','lake','river','island','building','greenspace','golfcourse','stream','glacier'])[feature_type_code + 1]) AS INT) AS paint_rank FROM features")
def paint_order(spark: SparkSession, d: str) -> DataFrame:
    return features.painted(view(spark, d, "features")).select("feature_id", "paint_rank").orderBy("paint_rank", "feature_id")


@R.add("SELECT street_name, street_id FROM streets WHERE lower(replace(street_name, ' ', '')) LIKE 'row%' ORDER BY street_name, street_id LIMIT 15")
def suggest_top15(spark: SparkSession, d: str) -> DataFrame:
    return search.streets_by_prefix(view(spark, d, "streets"), "Row").select("street_name", "street_id").orderBy("street_name", "street_id").limit(15)


# 2.8 search

_PREFIX = "pf AS (SELECT street_id, street_name, lower(replace(street_name, ' ', '')) AS norm FROM streets)"


@R.add(f"WITH {_PREFIX} SELECT street_id, street_name FROM pf WHERE starts_with(norm, 'row1')")
def prefix_streets(spark: SparkSession, d: str) -> DataFrame:
    return search.streets_by_prefix(view(spark, d, "streets"), "ROW 1").select("street_id", "street_name")


_NAMES = f"""{_PREFIX}, {_STREET_X}, xn AS (SELECT sx.intersection_id, string_agg(street_name, ' & ' ORDER BY pf.street_id) AS name, count(*) AS n FROM sx JOIN pf USING (street_id) GROUP BY 1)"""
_ONE = f"""{_NAMES}, o AS (SELECT xn.intersection_id, split_part(name, ' & ', 1) AS n1, split_part(name, ' & ', 2) AS n2, pf.street_name AS own, pf.norm, pf.street_id FROM xn JOIN sx USING (intersection_id) JOIN pf USING (street_id) WHERE n = 2 AND starts_with(pf.norm, 'row1')),
p AS (SELECT intersection_id, norm, street_id, CASE WHEN n1 = own THEN n1 || ' & ' || n2 ELSE n2 || ' & ' || n1 END AS name FROM o WHERE n1 <> '<unknown>' AND n2 <> '<unknown>'),
u AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY name ORDER BY norm, street_id, intersection_id) = 1)"""


@R.add(f"WITH {_ONE} SELECT intersection_id, name FROM u")
def search_one_street(spark: SparkSession, d: str) -> DataFrame:
    return search.intersections(view(spark, d, "streets"), view(spark, d, "segments"), "row 1").select("intersection_id", "name")


@R.add(f"WITH {_ONE} SELECT intersection_id, name FROM u ORDER BY norm, street_id, intersection_id LIMIT 5")
def search_top5(spark: SparkSession, d: str) -> DataFrame:
    return search.intersections(view(spark, d, "streets"), view(spark, d, "segments"), "row 1").orderBy("norm_1", "street_1", "intersection_id").limit(5).select("intersection_id", "name")


_TWO = f"""t AS (SELECT a.intersection_id, p.street_name || ' & ' || q.street_name AS name, p.norm AS n1, q.norm AS n2, p.street_id AS s1, q.street_id AS s2 FROM sx a JOIN sx b USING (intersection_id) JOIN pf p ON p.street_id = a.street_id JOIN pf q ON q.street_id = b.street_id
  WHERE starts_with(p.norm, 'row') AND starts_with(q.norm, 'nation') AND p.street_name <> q.street_name AND p.street_name <> '<unknown>' AND q.street_name <> '<unknown>'),
v AS (SELECT intersection_id, name FROM t QUALIFY row_number() OVER (PARTITION BY name ORDER BY n1, s1, n2, s2, intersection_id) = 1)"""


@R.add(f"WITH {_PREFIX}, {_STREET_X}, {_TWO} SELECT intersection_id, name FROM v")
def search_two_streets(spark: SparkSession, d: str) -> DataFrame:
    return search.intersections(view(spark, d, "streets"), view(spark, d, "segments"), " row  & nation ").select("intersection_id", "name")


@R.add(f"WITH {_ONE}, {_TWO} SELECT 'row 1' AS text, intersection_id, name FROM u UNION ALL SELECT 'row & nation', intersection_id, name FROM v")
def search_intersections(spark: SparkSession, d: str) -> DataFrame:
    """What several search texts find; each text tells whether one street or two are asked for."""
    found = [search.intersections(view(spark, d, "streets"), view(spark, d, "segments"), t).select(F.lit(t).alias("text"), "intersection_id", "name") for t in ("row 1", "row & nation")]
    return found[0].unionAll(found[1])



@R.add("SELECT * FROM (VALUES ('bloor & spadina', 'bloor', 'spadina'), ('  King  St ', 'KingSt', ''), ('& queen', '', 'queen')) AS t(text, street_1, street_2)")
def parse_query(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(t, *search.parse_query(t)) for t in ("bloor & spadina", "  King  St ", "& queen")], "text string, street_1 string, street_2 string")


@R.add("SELECT from_id AS intersection_id FROM segments WHERE one_way INTERSECT SELECT to_id FROM segments WHERE one_way")
def set_ops(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "segments").where("one_way")
    return s.select(F.col("from_id").alias("intersection_id")).intersect(s.select("to_id"))
