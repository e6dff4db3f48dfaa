"""Projections, scalar functions and filters of the street map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrafold.functions import geo, tags
from terrafold.operators import features, network
from terrafold.plans.registry import Registry
from terrafold.sources.fixtures import view

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

RADIUS = "6371008.8"
MEAN = "(SELECT radians((min(lat) + max(lat)) / 2) FROM intersections)"
#: What the camera query shows, in metres: left, bottom, right, top.
CAMERA = (-6_423_000.0, 4_837_500.0, -6_420_500.0, 4_850_000.0)
#: The view that the culling queries look through: these shares of the map's extent in degrees, from the lower left.
VIEW_FROM, VIEW_TO = -0.05, 0.6
LEFT, BOTTOM, RIGHT, TOP = "v_left", "v_bottom", "v_right", "v_top"
_VIEW = f"""vb AS (SELECT {RADIUS} * radians(min(lon) + {VIEW_FROM} * (max(lon) - min(lon))) * cos(radians((min(lat) + max(lat)) / 2)) AS v_left,
  {RADIUS} * radians(min(lon) + {VIEW_TO} * (max(lon) - min(lon))) * cos(radians((min(lat) + max(lat)) / 2)) AS v_right,
  {RADIUS} * radians(min(lat) + {VIEW_FROM} * (max(lat) - min(lat))) AS v_bottom, {RADIUS} * radians(min(lat) + {VIEW_TO} * (max(lat) - min(lat))) AS v_top FROM intersections)"""


def _sides() -> tuple[Column, ...]:
    return tuple(F.col(f"view.{k}") for k in ("left", "bottom", "right", "top"))


def _viewed(spark: SparkSession, d: str, df: DataFrame) -> DataFrame:
    """Rows with the view in metres."""
    b = network.bounds(view(spark, d, "intersections"))

    def at(axis: str, share: float) -> Column:
        return F.col(f"min_{axis}") + share * (F.col(f"max_{axis}") - F.col(f"min_{axis}"))

    x = [geo.lon_to_x(at("lon", k), F.col("mean_lat")) for k in (VIEW_FROM, VIEW_TO)]
    y = [geo.lat_to_y(at("lat", k)) for k in (VIEW_FROM, VIEW_TO)]
    return df.join(F.broadcast(b.select(F.struct(x[0].alias("left"), y[0].alias("bottom"), x[1].alias("right"), y[1].alias("top")).alias("view"))))  # one row


def _r(c: Column | str, n: int = 6) -> Column:
    return F.round(c, n)


def _case(column: str, values: dict, other: str) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items() if k) + f" ELSE {other} END"


@R.add(f"""SELECT s.segment_id, round({RADIUS} * sqrt(power(radians(b.lat) - radians(a.lat), 2) + power((radians(b.lon) - radians(a.lon)) * cos((radians(a.lat) + radians(b.lat)) / 2), 2)), 6) AS metres
FROM segments s JOIN intersections a ON a.intersection_id = s.from_id JOIN intersections b ON b.intersection_id = s.to_id""")
def geo_distance(spark: SparkSession, d: str) -> DataFrame:
    e = network.endpoints(view(spark, d, "segments"), view(spark, d, "intersections"))
    return e.select("segment_id", _r(geo.geo_distance(F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon"))).alias("metres"))


@R.add(f"SELECT intersection_id, round({RADIUS} * radians(lon) * cos(0.76), 3) AS x, round({RADIUS} * radians(lat), 3) AS y FROM intersections")
def project_xy(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "intersections").select("intersection_id", _r(geo.lon_to_x(F.col("lon"), F.lit(0.76)), 3).alias("x"), _r(geo.lat_to_y(F.col("lat")), 3).alias("y"))


@R.add(f"SELECT poi_id, round({RADIUS} * radians(lon) * cos({MEAN}), 3) AS x FROM pois")
def lon_to_x(spark: SparkSession, d: str) -> DataFrame:
    return network.projected(view(spark, d, "pois"), view(spark, d, "intersections")).select("poi_id", _r("x", 3).alias("x"))


@R.add(f"SELECT poi_id, round({RADIUS} * radians(lat), 3) AS y FROM pois")
def lat_to_y(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "pois").select("poi_id", _r(geo.lat_to_y(F.col("lat")), 3).alias("y"))


@R.add(f"SELECT intersection_id, round(degrees(intersection_id * 100.0 / ({RADIUS} * cos({MEAN}))), 8) AS lon FROM intersections")
def x_to_lon(spark: SparkSession, d: str) -> DataFrame:
    i = view(spark, d, "intersections")
    return i.join(F.broadcast(network.bounds(i).select("mean_lat"))).select("intersection_id", _r(geo.x_to_lon(F.col("intersection_id") * 100.0, F.col("mean_lat")), 8).alias("lon"))  # one row


@R.add(f"SELECT intersection_id, round(degrees(intersection_id * 100.0 / {RADIUS}), 8) AS lat FROM intersections")
def y_to_lat(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "intersections").select("intersection_id", _r(geo.y_to_lat(F.col("intersection_id") * 100.0), 8).alias("lat"))


@R.add(f"SELECT intersection_id, round({RADIUS} * radians(lon) * cos({MEAN}), 3) AS x, round({RADIUS} * radians(lat), 3) AS y FROM intersections")
def latlon_to_point(spark: SparkSession, d: str) -> DataFrame:
    i = view(spark, d, "intersections")
    p = i.join(F.broadcast(network.bounds(i).select("mean_lat"))).select("intersection_id", geo.point(geo.lon_to_x(F.col("lon"), F.col("mean_lat")), geo.lat_to_y(F.col("lat"))).alias("p"))  # one row
    return p.select("intersection_id", _r("p.x", 3).alias("x"), _r("p.y", 3).alias("y"))


_LINES = """lines AS (
  SELECT segment_id, from_id, to_id, street_id, list({'lat': lat, 'lon': lon} ORDER BY k) AS l FROM (
    SELECT s.segment_id, s.from_id, s.to_id, s.street_id, -1 AS k, a.lat, a.lon FROM segments s JOIN intersections a ON a.intersection_id = s.from_id
    UNION ALL SELECT s.segment_id, s.from_id, s.to_id, s.street_id, c.idx, c.lat, c.lon FROM segments s JOIN curve_points c ON c.segment_id = s.segment_id
    UNION ALL SELECT s.segment_id, s.from_id, s.to_id, s.street_id, 99, b.lat, b.lon FROM segments s JOIN intersections b ON b.intersection_id = s.to_id) GROUP BY ALL)"""


def dist_sql(p: str, q: str) -> str:
    return f"({RADIUS} * sqrt(power(radians({q}.lat) - radians({p}.lat), 2) + power((radians({q}.lon) - radians({p}.lon)) * cos((radians({p}.lat) + radians({q}.lat)) / 2), 2)))"


@R.add(f"""WITH {_LINES},
c AS (SELECT s.segment_id AS src, d.segment_id AS dst,
  CASE WHEN s.from_id = d.from_id THEN [s.l[2], s.l[1], d.l[2]] WHEN s.to_id = d.from_id THEN [s.l[-2], s.l[-1], d.l[2]]
       WHEN s.from_id = d.to_id THEN [s.l[2], s.l[1], d.l[-2]] WHEN s.to_id = d.to_id THEN [s.l[-2], s.l[-1], d.l[-2]] END AS t
  FROM lines s JOIN lines d ON d.segment_id = s.segment_id + 2 OR d.segment_id = s.segment_id + 41),
m AS (SELECT src, dst, {dist_sql('t[1]', 't[2]')} AS a, {dist_sql('t[2]', 't[3]')} AS b, {dist_sql('t[1]', 't[3]')} AS o FROM c)
SELECT src, dst, CASE WHEN a * b > 0 THEN round(pi() - acos(greatest(-1.0, least(1.0, (a * a + b * b - o * o) / (2 * a * b)))), 5) END AS angle FROM m""")
def turn_angle(spark: SparkSession, d: str) -> DataFrame:
    lines = network.segment_polylines(view(spark, d, "segments"), view(spark, d, "intersections"), view(spark, d, "curve_points"))
    ids = view(spark, d, "segments").select("segment_id")
    pairs = ids.select(F.col("segment_id").alias("src"), F.explode(F.array(F.col("segment_id") + 2, F.col("segment_id") + 41)).alias("dst"))
    return network.corner_angles(pairs, lines).select("src", "dst", _r("angle", 5).alias("angle"))


@R.add(f"""WITH p AS (SELECT s.segment_id, {RADIUS} * radians(a.lon) * cos({MEAN}) AS x1, {RADIUS} * radians(a.lat) AS y1, {RADIUS} * radians(b.lon) * cos({MEAN}) AS x2, {RADIUS} * radians(b.lat) AS y2
  FROM segments s JOIN intersections a ON a.intersection_id = s.from_id JOIN intersections b ON b.intersection_id = s.to_id),
q AS (SELECT segment_id, CASE WHEN x1 < x2 THEN x2 - x1 ELSE x1 - x2 END AS dx, CASE WHEN x1 < x2 THEN y2 - y1 ELSE y1 - y2 END AS dy FROM p),
r AS (SELECT segment_id, dx, dy, degrees(atan2(dy, dx)) AS a FROM q)
SELECT segment_id, round(CASE WHEN dx = 0 AND dy = 0 THEN 0.0 WHEN a > 90 AND a < 270 THEN a - 180 ELSE a END, 5) AS angle FROM r""")
def text_angle(spark: SparkSession, d: str) -> DataFrame:
    e = _projected_ends(spark, d)
    return e.select("segment_id", _r(geo.label_angle(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), 5).alias("angle"))


def _projected_ends(spark: SparkSession, d: str) -> DataFrame:
    i = view(spark, d, "intersections")
    e = network.endpoints(view(spark, d, "segments"), i).join(F.broadcast(network.bounds(i).select("mean_lat")))  # one row
    return e.withColumns({f"x{k}": geo.lon_to_x(F.col(f"{n}_lon"), F.col("mean_lat")) for k, n in ((1, "from"), (2, "to"))} | {f"y{k}": geo.lat_to_y(F.col(f"{n}_lat")) for k, n in ((1, "from"), (2, "to"))})


@R.add(f"SELECT street_id, translate(street_name, '{tags.UPPER}', '{tags.LOWER}') AS name FROM streets")
def lower_ascii(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "streets").select("street_id", tags.lower_ascii(F.col("street_name")).alias("name"))


@R.add("SELECT street_id, replace(lower(street_name), ' ', '') AS name FROM streets")
def name_normalise(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "streets").select("street_id", tags.normalised(F.col("street_name")).alias("name"))


@R.add("SELECT street_id, regexp_replace(street_name, 'e', 'OSM') AS name FROM streets")
def replace_first(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "streets").select("street_id", tags.replaced_first(F.col("street_name"), "e", "OSM").alias("name"))


@R.add(f"SELECT way_osm_id, coalesce({_case('lower(highway)', tags.HIGHWAY_CODES, '0')}, 0) AS category FROM way_tags")
def highway_category(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "way_tags").select("way_osm_id", tags.highway_category(F.col("highway")).alias("category"))


@R.add(r"""WITH s AS (SELECT way_osm_id, regexp_replace(maxspeed, '\s+', '', 'g') AS v FROM way_tags),
n AS (SELECT way_osm_id, v, CAST(nullif(regexp_extract(v, '^([+-]?(\d+\.?\d*|\.\d+))', 1), '') AS FLOAT) AS x FROM s)
SELECT way_osm_id, coalesce(CASE WHEN length(v) > 3 AND lower(right(v, 3)) = 'mph' THEN CAST(x * CAST(1.60934 AS FLOAT) AS FLOAT) ELSE x END, CAST(-1 AS FLOAT)) AS kph FROM n""")
def parse_maxspeed(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "way_tags").select("way_osm_id", tags.max_speed(F.col("maxspeed")).alias("kph"))


def _tagged_nodes(spark: SparkSession, d: str) -> DataFrame:
    t = view(spark, d, "node_tags").groupBy("osm_node_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag_key", "tag_value")))).alias("tags"))
    return view(spark, d, "pois").select("osm_node_id", "lat", "lon").join(t, "osm_node_id", "left")


_TAGS = "t AS (SELECT osm_node_id, " + ", ".join(f"max(CASE WHEN tag_key = '{k}' THEN tag_value END) AS {k}" for k in ("name", "amenity", "shop", "tourism", "railway", "highway", "aeroway", "station")) + " FROM node_tags GROUP BY 1)"
_CATEGORY = """coalesce('amenity:' || amenity, 'shop:' || shop, 'tourism:' || tourism, 'railway:' || railway,
  CASE WHEN lower(highway) IN ('bus_stop', 'tram_stop', 'platform') THEN 'highway:' || lower(highway) END, 'aeroway:' || aeroway)"""


@R.add(f"WITH {_TAGS} SELECT p.osm_node_id, {_CATEGORY} AS category FROM pois p LEFT JOIN t USING (osm_node_id)")
def poi_category(spark: SparkSession, d: str) -> DataFrame:
    return _tagged_nodes(spark, d).select("osm_node_id", tags.poi_category(F.col("tags")).alias("category"))


@R.add(f"SELECT way_osm_id, CASE WHEN highway IN ({', '.join(repr(x) for x in tags.ROAD_TYPES)}) THEN highway ELSE 'other' END AS road_type FROM way_tags")
def road_type(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "way_tags").select("way_osm_id", tags.road_type(F.col("highway")).alias("road_type"))


_WAY_USE = """CASE WHEN tracks IS NOT NULL THEN 'tracks' WHEN railway IN ('tram', 'rail', 'monorail', 'subway') THEN railway WHEN railway IS NOT NULL THEN 'other'
  WHEN embedded_rails IS NOT NULL OR embedded_lanes IS NOT NULL THEN 'tram' ELSE 'notrail' END"""


def _way_kinds(spark: SparkSession, d: str) -> DataFrame:
    k = view(spark, d, "way_kinds")
    entries = F.array(*(F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in {"railway": "railway", "tracks": "tracks", "embedded_rails": "embedded_rails", "embedded_rails:lanes": "embedded_lanes"}.items()))
    return k.select("way_osm_id", F.map_from_entries(F.filter(entries, lambda e: e.v.isNotNull())).alias("tags"))


@R.add(f"SELECT way_osm_id, {_WAY_USE} AS way_use FROM way_kinds")
def way_use(spark: SparkSession, d: str) -> DataFrame:
    return _way_kinds(spark, d).select("way_osm_id", tags.way_use(F.col("tags")).alias("way_use"))


def _in(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


_CLASS = f"CASE WHEN poi_type IN ({_in(tags.SUBORDINATE)}) THEN 'subordinate' WHEN poi_type IN ({_in(tags.ENTERTAINMENT)}) THEN 'entertainment' WHEN poi_type IN ({_in(tags.BASIC)}) THEN 'basic' ELSE 'negligible' END"
_GROUP = f"CASE WHEN poi_type IN ({_in(tags.ENTERTAINMENT[:10])}) THEN 'FOOD' WHEN poi_type IN ({_in(tags.ENTERTAINMENT[10:13])}) THEN 'DRINK' WHEN poi_type IN ({_in(tags.ENTERTAINMENT)}) THEN 'ENTERTAINMENT' ELSE 'OTHER' END"


@R.add(f"SELECT poi_id, {_CLASS} AS poi_class, {_GROUP} AS poi_group FROM pois")
def poi_classify(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "pois").select("poi_id", tags.poi_class(F.col("poi_type")).alias("poi_class"), tags.poi_group(F.col("poi_type")).alias("poi_group"))


@R.add("SELECT poi_id, " + ", ".join(f"CAST(greatest(coalesce(list_position([{_in(v)}], replace(poi_type, ' ', '')), 0) - 1, 0) AS INT) AS {n}" for n, v in (("basic", tags.BASIC), ("entertainment", tags.ENTERTAINMENT), ("subordinate", tags.SUBORDINATE))) + " FROM pois")
def poi_type_code(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "pois").select("poi_id", *(tags.type_code(F.col("poi_type"), v).alias(n) for n, v in (("basic", tags.BASIC), ("entertainment", tags.ENTERTAINMENT), ("subordinate", tags.SUBORDINATE))))


@R.add(f"SELECT poi_id, round({RADIUS} * radians(lon) * cos({MEAN}), 3) AS x, round({RADIUS} * radians(lat), 3) AS y, round({RADIUS} * radians(lat) + 3, 3) AS label_y FROM pois")
def poi_project(spark: SparkSession, d: str) -> DataFrame:
    p = network.projected(view(spark, d, "pois"), view(spark, d, "intersections"))
    return p.select("poi_id", _r("x", 3).alias("x"), _r("y", 3).alias("y"), _r(F.col("y") + 3, 3).alias("label_y"))


@R.add("""WITH h AS (SELECT relation_id, CASE WHEN colour LIKE '#%' THEN substring(colour, 2, 6) WHEN colour = 'yellow' THEN 'FF7900' WHEN colour = 'green' THEN '00923F' WHEN colour = 'purple' THEN '80276C' ELSE 'CE8E00' END AS c FROM relation_tags)
SELECT relation_id, """ + ", ".join(f"round(CAST('0x' || substring(c, {i}, 2) AS INT) / 255.0, 6) AS {n}" for i, n in ((1, "r"), (3, "g"), (5, "b"))) + ", CAST(1.0 AS DOUBLE) AS a FROM h")
def colour_parse(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "relation_tags").select("relation_id", tags.colour(F.col("colour")).alias("c")).select("relation_id", *(_r(f"c.{k}").alias(k) for k in "rgba"))


def _style_key(kind: Column) -> Column:
    return F.regexp_replace(kind, "_link$", "")


_WIDTH_SQL = "CASE " + "regexp_replace(highway, '_link$', '')" + " " + " ".join(f"WHEN '{k}' THEN [{', '.join(str(list(r)) for r in v)}]" for k, v in tags.ROAD_WIDTHS.items()) + " ELSE [[8, 0]] END"


def _widths(kind: Column) -> Column:
    def rules(v: list) -> Column:
        return F.array(*(F.array(F.lit(a), F.lit(b)) for a, b in v))

    return F.coalesce(F.try_element_at(F.create_map(*(x for k, v in tags.ROAD_WIDTHS.items() for x in (F.lit(k), rules(v)))), _style_key(kind)), rules([(8, 0)]))


@R.add(f"""SELECT way_osm_id, unnest({_WIDTH_SQL})[1] AS min_zoom, unnest({_WIDTH_SQL})[2] AS width,
  {_case("regexp_replace(highway, '_link$', '')", {k: f"'{v[0]}'" for k, v in tags.ROAD_COLOURS.items()}, "'AEA4A4'")} AS light,
  {_case("regexp_replace(highway, '_link$', '')", {k: f"'{v[1]}'" for k, v in tags.ROAD_COLOURS.items()}, "'5A6E81'")} AS dark FROM way_tags""")
def street_style(spark: SparkSession, d: str) -> DataFrame:
    kind = F.coalesce("highway", F.lit("other"))
    shade = [F.coalesce(F.try_element_at(tags.literal_map({k: v[i] for k, v in tags.ROAD_COLOURS.items()}), _style_key(kind)), F.lit(tags.ROAD_COLOURS[""][i])) for i in (0, 1)]
    df = view(spark, d, "way_tags").select("way_osm_id", F.explode(_widths(kind)).alias("rule"), shade[0].alias("light"), shade[1].alias("dark"))
    return df.select("way_osm_id", F.col("rule")[0].alias("min_zoom"), F.col("rule")[1].alias("width"), "light", "dark")


_FTYPE = f"([{_in(tags.FEATURE_TYPES)}])[feature_type_code + 1]"


@R.add(f"SELECT feature_id, {_FTYPE} AS feature_type, {_case(_FTYPE, {k: repr(v[0]) for k, v in tags.FEATURE_STYLES.items()}, 'NULL')} AS light, {_case(_FTYPE, {k: repr(v[1]) for k, v in tags.FEATURE_STYLES.items()}, 'NULL')} AS dark, {_case(_FTYPE, {k: v[2] for k, v in tags.FEATURE_STYLES.items()}, 'NULL')} AS zoom_lod FROM features")
def feature_style(spark: SparkSession, d: str) -> DataFrame:
    kind = tags.feature_type(F.col("feature_type_code"))
    at = [F.try_element_at(tags.literal_map({k: v[i] for k, v in tags.FEATURE_STYLES.items()}), kind) for i in range(3)]
    return view(spark, d, "features").select("feature_id", kind.alias("feature_type"), at[0].alias("light"), at[1].alias("dark"), at[2].alias("zoom_lod"))


@R.add(f"SELECT way_osm_id, z AS zoom FROM way_tags CROSS JOIN (SELECT unnest([0, 3, 5, 8, 10]) AS z) WHERE z > coalesce({_case('highway', tags.ROAD_LOD, '7')}, 7)")
def lod_street(spark: SparkSession, d: str) -> DataFrame:
    w = view(spark, d, "way_tags").withColumn("zoom", F.explode(F.array(*map(F.lit, (0, 3, 5, 8, 10)))))
    return w.where(F.col("zoom") > F.coalesce(F.try_element_at(tags.literal_map(tags.ROAD_LOD), F.col("highway")), F.lit(7))).select("way_osm_id", "zoom")


@R.add(f"SELECT feature_id, z AS zoom FROM features CROSS JOIN (SELECT unnest([-3, 0, 2, 3, 5, 8]) AS z) WHERE z > {_case(_FTYPE, tags.FEATURE_LOD, '2')}")
def lod_feature(spark: SparkSession, d: str) -> DataFrame:
    f = view(spark, d, "features").withColumn("zoom", F.explode(F.array(*map(F.lit, (-3, 0, 2, 3, 5, 8)))))
    return f.where(F.col("zoom") > F.coalesce(F.try_element_at(tags.literal_map(tags.FEATURE_LOD), tags.feature_type(F.col("feature_type_code"))), F.lit(2))).select("feature_id", "zoom")


@R.add("SELECT p.osm_node_id, coalesce(t.tag_value, '') AS name FROM pois p LEFT JOIN node_tags t ON t.osm_node_id = p.osm_node_id AND t.tag_key = 'name'")
def tag_value(spark: SparkSession, d: str) -> DataFrame:
    return _tagged_nodes(spark, d).select("osm_node_id", F.coalesce(F.try_element_at("tags", F.lit("name")), F.lit("")).alias("name"))


_BOX = "b AS (SELECT feature_id, min(lon) AS x1, max(lat) AS y1, max(lon) AS x2, min(lat) AS y2 FROM feature_points GROUP BY 1)"


@R.add(f"""WITH {_BOX} SELECT feature_id, x1 AS "left", x2 AS "right", y2 AS bottom, y1 AS top, round(x2 - x1, 9) AS width, round(y1 - y2, 9) AS height, round((x2 - x1) * (y1 - y2), 12) AS area,
  round((x1 + x2) / 2, 9) AS center_x, round((y1 + y2) / 2, 9) AS center_y, 43.511 BETWEEN y2 AND y1 AND -79.599 BETWEEN x1 AND x2 AS holds FROM b""")
def rect_ops(spark: SparkSession, d: str) -> DataFrame:
    b = features.boxes(view(spark, d, "feature_points"))
    corners = (F.col("min_lon"), F.col("max_lat"), F.col("max_lon"), F.col("min_lat"))
    r = b.select("feature_id", geo.rectangle(*corners).alias("r"), geo.box_contains(*corners, F.lit(-79.599), F.lit(43.511)).alias("holds"))
    return r.select("feature_id", *(F.col(f"r.{k}") for k in ("left", "right", "bottom", "top")), *(_r(f"r.{k}", n).alias(k) for k, n in (("width", 9), ("height", 9), ("area", 12), ("center_x", 9), ("center_y", 9))), "holds")


@R.add("""SELECT s.segment_id, round(a.lat + b.lat, 6) AS sum_lat, round(a.lon + b.lon, 6) AS sum_lon, round(b.lat - a.lat, 6) AS diff_lat, round(b.lon - a.lon, 6) AS diff_lon,
  round(a.lat * b.lat, 4) AS product_lat, round(a.lon * b.lon, 4) AS product_lon, a.lat = b.lat AND a.lon = b.lon AS same FROM segments s JOIN intersections a ON a.intersection_id = s.from_id JOIN intersections b ON b.intersection_id = s.to_id""")
def point_ops(spark: SparkSession, d: str) -> DataFrame:
    e = network.endpoints(view(spark, d, "segments"), view(spark, d, "intersections"))
    both = [(k, F.col(f"from_{k}"), F.col(f"to_{k}")) for k in ("lat", "lon")]
    sums = [_r(a + b).alias(f"sum_{k}") for k, a, b in both] + [_r(b - a).alias(f"diff_{k}") for k, a, b in both] + [_r(a * b, 4).alias(f"product_{k}") for k, a, b in both]
    return e.select("segment_id", *sums, ((both[0][1] == both[0][2]) & (both[1][1] == both[1][2])).alias("same"))


@R.add(f"SELECT poi_id, round(x * 0.05 + 400 + 12, 4) AS sx, round(y * 0.05 + 300 - 7, 4) AS sy, round(x, 2) AS wx, round(y, 2) AS wy FROM (SELECT poi_id, {RADIUS} * radians(lon) * cos({MEAN}) AS x, {RADIUS} * radians(lat) AS y FROM pois)")
def screen_world(spark: SparkSession, d: str) -> DataFrame:
    at = (800, 600, 0.05, 12.0, -7.0)
    p = network.projected(view(spark, d, "pois"), view(spark, d, "intersections")).withColumn("s", geo.world_to_screen(F.col("x"), F.col("y"), *at))
    p = p.withColumn("w", geo.screen_to_world(F.col("s.x"), F.col("s.y"), *at))
    return p.select("poi_id", _r("s.x", 4).alias("sx"), _r("s.y", 4).alias("sy"), _r("w.x", 2).alias("wx"), _r("w.y", 2).alias("wy"))


@R.add(f"""WITH p AS (SELECT poi_id, {RADIUS} * radians(lon) * cos({MEAN}) AS x, {RADIUS} * radians(lat) AS y FROM pois),
k AS (SELECT least(800 / ({CAMERA[2]} - ({CAMERA[0]})), 600 / ({CAMERA[3]} - {CAMERA[1]})) AS s)
SELECT poi_id, round(greatest(-10000.0, least(10000.0, (x - ({CAMERA[0]})) * s + (800 - ({CAMERA[2]} - ({CAMERA[0]})) * s) / 2)), 4) AS sx,
  round(greatest(-10000.0, least(10000.0, ({CAMERA[3]} - y) * s + (600 - ({CAMERA[3]} - {CAMERA[1]}) * s) / 2)), 4) AS sy FROM p CROSS JOIN k""")
def camera(spark: SparkSession, d: str) -> DataFrame:
    p = network.projected(view(spark, d, "pois"), view(spark, d, "intersections")).withColumn("s", geo.camera_point(F.col("x"), F.col("y"), CAMERA, (800.0, 600.0)))
    return p.select("poi_id", _r("s.x", 4).alias("sx"), _r("s.y", 4).alias("sy"))


@R.add(f"""WITH {_BOX}, c AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM b)
SELECT feature_id, round(cx - (cx - x1) / 1.6, 9) AS "left", round(cy + (y2 - cy) / 1.6, 9) AS bottom, round(cx + (x2 - cx) / 1.6, 9) AS "right", round(cy - (cy - y1) / 1.6, 9) AS top,
  round(cx - (cx - x1) * 1.6, 9) AS out_left, round(cy - (cy - y1) * 1.6, 9) AS out_top, round(x1 + (x2 - x1) / 5, 9) AS moved_left FROM c""")
def zoom_rect(spark: SparkSession, d: str) -> DataFrame:
    b = features.boxes(view(spark, d, "feature_points"))
    box = (F.col("min_lon"), F.col("min_lat"), F.col("max_lon"), F.col("max_lat"))
    centre = ((box[0] + box[2]) / 2, (box[1] + box[3]) / 2)
    z = b.select("feature_id", geo.zoomed(*box, *centre, 1.6).alias("i"), geo.zoomed(*box, *centre, 1 / 1.6).alias("o"), (box[0] + (box[2] - box[0]) / 5).alias("m"))
    return z.select("feature_id", *(_r(f"i.{k}", 9).alias(k) for k in ("left", "bottom", "right", "top")), _r("o.left", 9).alias("out_left"), _r("o.top", 9).alias("out_top"), _r("m", 9).alias("moved_left"))


@R.add(f"""WITH {_BOX}, c AS (SELECT *, x2 - x1 AS w, y1 - y2 AS h, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM b),
e AS (SELECT feature_id, cx, cy, CASE WHEN w / 1.5 >= h THEN w ELSE h * 1.5 END AS w, CASE WHEN w / 1.5 >= h THEN w / 1.5 ELSE h END AS h FROM c)
SELECT feature_id, round(cx - w / 2, 9) AS "left", round(cy - h / 2, 9) AS bottom, round(cx + w / 2, 9) AS "right", round(cy + h / 2, 9) AS top FROM e""")
def visible_fit(spark: SparkSession, d: str) -> DataFrame:
    b = features.boxes(view(spark, d, "feature_points"))
    f = b.select("feature_id", geo.fitted(F.col("min_lon"), F.col("min_lat"), F.col("max_lon"), F.col("max_lat"), 1.5).alias("f"))
    return f.select("feature_id", *(_r(f"f.{k}", 9).alias(k) for k in ("left", "bottom", "right", "top")))


@R.add(f"""WITH p AS (SELECT s.street_id, s.segment_id, round(abs({RADIUS} * radians(a.lon) * cos({MEAN}) - {RADIUS} * radians(b.lon) * cos({MEAN})), 3) AS w, round(abs({RADIUS} * radians(a.lat) - {RADIUS} * radians(b.lat)), 3) AS h
  FROM segments s JOIN intersections a ON a.intersection_id = s.from_id JOIN intersections b ON b.intersection_id = s.to_id),
l AS (SELECT street_id, list({{'w': w, 'h': h, 'level': 0}} ORDER BY segment_id) AS boxes FROM p GROUP BY 1)
SELECT street_id, list_reduce(boxes, lambda s, b: CASE WHEN s.w = 0 AND s.h = 0 THEN CASE WHEN b.w <> 0 AND b.h <> 0 THEN {{'w': b.w, 'h': b.h, 'level': s.level + 1}} ELSE s END
  WHEN b.w <> s.w AND b.h <> s.h AND b.w * s.h <> 0 AND b.h * s.w <> 0 AND b.w / s.w - b.h / s.h > -0.01 THEN {{'w': b.w, 'h': b.h, 'level': CASE WHEN b.w > s.w AND b.h > s.h THEN s.level - 1 ELSE s.level + 1 END}}
  ELSE s END, {{'w': CAST(0 AS DOUBLE), 'h': CAST(0 AS DOUBLE), 'level': 0}}).level AS level FROM l""")
def zoom_level(spark: SparkSession, d: str) -> DataFrame:
    """A zoom level folded over each street's successive boxes: boxes larger both ways zoom out, others in.

    A box counts if it differs both ways from the last that did, and is not scaled less along x than along y by 0.01 or more.
    """
    e = _projected_ends(spark, d).select("street_id", "segment_id", _r(F.abs(F.col("x1") - F.col("x2")), 3).alias("w"), _r(F.abs(F.col("y1") - F.col("y2")), 3).alias("h"))
    boxes = e.groupBy("street_id").agg(F.array_sort(F.collect_list(F.struct("segment_id", "w", "h"))).alias("boxes"))
    start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("h"), F.lit(0).alias("level"))

    def step(s: Column, b: Column) -> Column:
        fx, fy = F.coalesce(F.try_divide(b.w, s.w), F.lit(0.0)), F.coalesce(F.try_divide(b.h, s.h), F.lit(0.0))
        first = (s.w == 0) & (s.h == 0)
        moves = (b.w != s.w) & (b.h != s.h) & (fx - fy > -0.01) & (((fx != 0) & (fy != 0)) | first)
        level = F.when((b.w > s.w) & (b.h > s.h) & ~first, s.level - 1).otherwise(s.level + 1)
        return F.when(moves, F.struct(b.w.alias("w"), b.h.alias("h"), level.alias("level"))).otherwise(s)

    return boxes.select("street_id", F.aggregate("boxes", start, step)["level"].alias("level"))


@R.add(f"SELECT intersection_id, osm_node_id, round({RADIUS} * radians(lon) * cos({MEAN}), 3) AS x, round({RADIUS} * radians(lat), 3) AS y FROM intersections")
def intersection_project(spark: SparkSession, d: str) -> DataFrame:
    i = view(spark, d, "intersections")
    return network.projected(i, i).select("intersection_id", "osm_node_id", _r("x", 3).alias("x"), _r("y", 3).alias("y"))


@R.add(f"WITH {_LINES}, i AS (SELECT segment_id, l, unnest(range(1, len(l))) AS k FROM lines) SELECT segment_id, CAST(k - 1 AS INT) AS piece, round(l[k].lat, 9) AS lat1, round(l[k].lon, 9) AS lon1, round(l[k + 1].lat, 9) AS lat2, round(l[k + 1].lon, 9) AS lon2 FROM i")
def segment_polyline(spark: SparkSession, d: str) -> DataFrame:
    lines = network.segment_polylines(view(spark, d, "segments"), view(spark, d, "intersections"), view(spark, d, "curve_points"))
    p = lines.select("segment_id", F.posexplode(F.arrays_zip(F.slice("line", F.lit(1), F.size("line") - 1).alias("a"), F.slice("line", F.lit(2), F.size("line") - 1).alias("b"))).alias("piece", "p"))
    return p.select("segment_id", "piece", *(_r(f"p.{k}.{c}", 9).alias(f"{c}{n}") for n, k in ((1, "a"), (2, "b")) for c in ("lat", "lon")))


@R.add(f"""WITH p AS (SELECT s.segment_id, t.street_name, {RADIUS} * radians(a.lon) * cos({MEAN}) AS x1, {RADIUS} * radians(a.lat) AS y1, {RADIUS} * radians(b.lon) * cos({MEAN}) AS x2, {RADIUS} * radians(b.lat) AS y2
  FROM segments s JOIN streets t USING (street_id) JOIN intersections a ON a.intersection_id = s.from_id JOIN intersections b ON b.intersection_id = s.to_id WHERE t.street_name <> '<unknown>')
SELECT segment_id, street_name, round((x1 + x2) / 2, 3) AS x, round((y1 + y2) / 2, 3) AS y, round(sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)), 3) AS width, 100.0::DOUBLE AS height FROM p""")
def street_label(spark: SparkSession, d: str) -> DataFrame:
    e = _projected_ends(spark, d).join(view(spark, d, "streets"), "street_id").where("street_name <> '<unknown>'")
    return e.select("segment_id", "street_name", _r(F.expr("(x1 + x2) / 2"), 3).alias("x"), _r(F.expr("(y1 + y2) / 2"), 3).alias("y"), _r(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), 3).alias("width"), F.lit(100.0).alias("height"))


@R.add(f"""WITH p AS (SELECT s.segment_id, {RADIUS} * radians(a.lon) * cos({MEAN}) AS x1, {RADIUS} * radians(a.lat) AS y1, {RADIUS} * radians(b.lon) * cos({MEAN}) AS x2, {RADIUS} * radians(b.lat) AS y2
  FROM segments s JOIN intersections a ON a.intersection_id = s.from_id JOIN intersections b ON b.intersection_id = s.to_id WHERE s.one_way),
q AS (SELECT *, sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) AS l FROM p), n AS (SELECT *, unnest(range(CAST(floor((l - 5 - 15) / 30) AS BIGINT) + 1)) AS k FROM q WHERE l >= 30)
SELECT segment_id, CAST(k AS INT) AS arrow, round(x1 + (x2 - x1) / l * (5 + 30 * k), 3) AS tail_x, round(y1 + (y2 - y1) / l * (5 + 30 * k), 3) AS tail_y,
  round(x1 + (x2 - x1) / l * (15 + 30 * k), 3) AS tip_x, round(y1 + (y2 - y1) / l * (15 + 30 * k), 3) AS tip_y FROM n""")
def arrows(spark: SparkSession, d: str) -> DataFrame:
    """Shafts of 10 m every 30 m along one-way segments; none on segments shorter than 30 m."""
    e = _projected_ends(spark, d).where("one_way").withColumn("l", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).where("l >= 30")
    e = e.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("l") - 20) / 30).cast("int"))))

    def at(axis: str, metres: int) -> Column:
        return _r(F.col(f"{axis}1") + (F.col(f"{axis}2") - F.col(f"{axis}1")) / F.col("l") * (metres + 30 * F.col("k")), 3)

    return e.select("segment_id", F.col("k").alias("arrow"), at("x", 5).alias("tail_x"), at("y", 5).alias("tail_y"), at("x", 15).alias("tip_x"), at("y", 15).alias("tip_y"))


# 2.3 filters

_POI_XY = f"p AS (SELECT poi_id, poi_type, poi_name, {RADIUS} * radians(lon) * cos({MEAN}) AS x, {RADIUS} * radians(lat) AS y FROM pois)"
_INSIDE = f"x > {LEFT} AND x < {RIGHT} AND y > {BOTTOM} AND y < {TOP}"


@R.add(f"WITH {_VIEW}, {_POI_XY} SELECT poi_id FROM p, vb WHERE {_INSIDE}")
def viewport_points(spark: SparkSession, d: str) -> DataFrame:
    p = _viewed(spark, d, network.projected(view(spark, d, "pois"), view(spark, d, "intersections")))
    return p.where(geo.strictly_inside(F.col("x"), F.col("y"), _sides())).select("poi_id")


_FBOX = f"f AS (SELECT feature_id, {RADIUS} * radians(min(lon)) * cos({MEAN}) AS x1, {RADIUS} * radians(max(lon)) * cos({MEAN}) AS x2, {RADIUS} * radians(min(lat)) AS y1, {RADIUS} * radians(max(lat)) AS y2 FROM feature_points GROUP BY 1)"
_OVERLAP = f"NOT (x2 < {LEFT} OR x1 > {RIGHT} OR y2 < {BOTTOM} OR y1 > {TOP})"


def _feature_boxes(spark: SparkSession, d: str) -> DataFrame:
    b = features.boxes(view(spark, d, "feature_points")).join(F.broadcast(network.bounds(view(spark, d, "intersections")).select("mean_lat")))  # one row
    x = [geo.lon_to_x(F.col(c), F.col("mean_lat")) for c in ("min_lon", "max_lon")]
    y = [geo.lat_to_y(F.col(c)) for c in ("min_lat", "max_lat")]
    return b.select("feature_id", x[0].alias("x1"), x[1].alias("x2"), y[0].alias("y1"), y[1].alias("y2"))


def _seen(spark: SparkSession, d: str, df: DataFrame) -> DataFrame:
    return _viewed(spark, d, df).where(geo.boxes_overlap(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), _sides()))


@R.add(f"WITH {_VIEW}, {_FBOX} SELECT feature_id FROM f, vb WHERE {_OVERLAP}")
def viewport_rects(spark: SparkSession, d: str) -> DataFrame:
    return _seen(spark, d, _feature_boxes(spark, d)).select("feature_id")


@R.add(f"WITH {_VIEW}, {_FBOX} SELECT f.feature_id FROM f JOIN features USING (feature_id) CROSS JOIN vb WHERE {_OVERLAP} AND 3 > {_case(_FTYPE, {k: v[2] for k, v in tags.FEATURE_STYLES.items()}, 'NULL')}")
def cull_features(spark: SparkSession, d: str) -> DataFrame:
    lod = F.try_element_at(tags.literal_map({k: v[2] for k, v in tags.FEATURE_STYLES.items()}), tags.feature_type(F.col("feature_type_code")))
    return _seen(spark, d, _feature_boxes(spark, d)).join(view(spark, d, "features").where(F.lit(3) > lod), "feature_id").select("feature_id")


@R.add(f"""WITH {_VIEW}, s AS (SELECT s.segment_id, w.highway, least(a.x, b.x) AS x1, greatest(a.x, b.x) AS x2, least(a.y, b.y) AS y1, greatest(a.y, b.y) AS y2 FROM segments s
  JOIN (SELECT intersection_id, {RADIUS} * radians(lon) * cos({MEAN}) AS x, {RADIUS} * radians(lat) AS y FROM intersections) a ON a.intersection_id = s.from_id
  JOIN (SELECT intersection_id, {RADIUS} * radians(lon) * cos({MEAN}) AS x, {RADIUS} * radians(lat) AS y FROM intersections) b ON b.intersection_id = s.to_id LEFT JOIN way_tags w USING (way_osm_id)),
r AS (SELECT segment_id, unnest({_WIDTH_SQL}) AS z FROM s, vb WHERE {_OVERLAP})
SELECT segment_id, max_by(z[2], z[1]) AS width FROM r WHERE 8.5 > z[1] GROUP BY 1""")
def cull_streets(spark: SparkSession, d: str) -> DataFrame:
    e = _projected_ends(spark, d).join(view(spark, d, "way_tags"), "way_osm_id", "left")
    box = e.select("segment_id", "highway", F.least("x1", "x2").alias("x1"), F.greatest("x1", "x2").alias("x2"), F.least("y1", "y2").alias("y1"), F.greatest("y1", "y2").alias("y2"))
    rules = F.filter(_widths(F.coalesce("highway", F.lit("other"))), lambda z: z[0] < 8.5)
    return _seen(spark, d, box).withColumn("rules", F.array_sort(rules)).where(F.size("rules") > 0).select("segment_id", F.element_at("rules", -1)[1].alias("width"))


@R.add(f"WITH n AS (SELECT way_osm_id, count(*) AS n FROM way_refs GROUP BY 1) SELECT way_osm_id, {_WAY_USE} AS way_use FROM way_kinds JOIN n USING (way_osm_id) WHERE n >= 2 AND {_WAY_USE} <> 'notrail'")
def rail_ways(spark: SparkSession, d: str) -> DataFrame:
    n = view(spark, d, "way_refs").groupBy("way_osm_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return _way_kinds(spark, d).select("way_osm_id", tags.way_use(F.col("tags")).alias("way_use")).where("way_use <> 'notrail'").join(n, "way_osm_id").select("way_osm_id", "way_use")


def _ranked_pois(spark: SparkSession, d: str) -> DataFrame:
    p = network.projected(view(spark, d, "pois"), view(spark, d, "intersections")).withColumn("poi_class", tags.poi_class(F.col("poi_type")))
    w = Window.partitionBy("poi_type")
    return p.withColumns({"rank": F.row_number().over(w.orderBy("poi_id")), "n": F.count(F.lit(1)).over(w)})


@R.add(f"""WITH {_VIEW}, {_POI_XY}, r AS (SELECT *, {_CLASS} AS poi_class, row_number() OVER (PARTITION BY poi_type ORDER BY poi_id) AS rank, count(*) OVER (PARTITION BY poi_type) AS n FROM p)
SELECT poi_id, poi_class, CASE WHEN poi_class = 'entertainment' THEN CASE WHEN greatest(list_position([{_in(tags.ENTERTAINMENT)}], poi_type) - 1, 0) <= 10 THEN 'FOOD' ELSE 'ENTERTAINMENT' END ELSE upper(poi_class) END AS icon
FROM r, vb WHERE {_INSIDE} AND poi_class IN ('basic', 'entertainment', 'subordinate') AND rank <= ceil(n * 0.058 * 12)""")
def poi_layers(spark: SparkSession, d: str) -> DataFrame:
    """Icons at zoom 12: the first share of each type of the layers shown, inside the view."""
    r = _viewed(spark, d, _ranked_pois(spark, d)).where(geo.strictly_inside(F.col("x"), F.col("y"), _sides()) & F.col("poi_class").isin("basic", "entertainment", "subordinate"))
    icon = F.when(F.col("poi_class") == "entertainment", F.when(tags.type_code(F.col("poi_type"), tags.ENTERTAINMENT) <= 10, "FOOD").otherwise("ENTERTAINMENT")).otherwise(F.upper("poi_class"))
    return r.where(F.col("rank") <= F.ceil(F.col("n") * (0.058 * 12))).select("poi_id", "poi_class", icon.alias("icon"))


@R.add(f"""WITH {_VIEW}, {_POI_XY}, r AS (SELECT *, {_CLASS} AS poi_class, row_number() OVER (PARTITION BY poi_type ORDER BY poi_id) AS rank, count(*) OVER (PARTITION BY poi_type) AS n FROM p)
SELECT poi_id, poi_name, round(x, 3) AS x, round(y + 3, 3) AS label_y FROM r, vb WHERE x > {LEFT} AND x < {RIGHT} AND y + 3 > {BOTTOM} AND y + 3 < {TOP} AND (poi_class = 'negligible' OR rank <= ceil(n * 0.3))""")
def poi_labels(spark: SparkSession, d: str) -> DataFrame:
    r = _viewed(spark, d, _ranked_pois(spark, d)).withColumn("label_y", F.col("y") + 3).where(geo.strictly_inside(F.col("x"), F.col("label_y"), _sides()))
    return r.where((F.col("poi_class") == "negligible") | (F.col("rank") <= F.ceil(F.col("n") * 0.3))).select("poi_id", "poi_name", _r("x", 3).alias("x"), _r("label_y", 3).alias("label_y"))


@R.add("SELECT street_id FROM streets WHERE NOT contains(street_name, '<unknown>')")
def unknown_filter(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "streets").where(~F.contains("street_name", F.lit("<unknown>"))).select("street_id")


@R.add("SELECT feature_id, count(*) > 1 AND min_by(lat, idx) = max_by(lat, idx) AND min_by(lon, idx) = max_by(lon, idx) AS is_closed FROM feature_points GROUP BY 1")
def closed_feature(spark: SparkSession, d: str) -> DataFrame:
    return features.rings(view(spark, d, "feature_points")).select("feature_id", "is_closed")


@R.add(f"WITH {_TAGS} SELECT p.osm_node_id, coalesce(t.name, '') AS name, round({RADIUS} * radians(p.lat) + 10, 3) AS label_y FROM pois p JOIN t USING (osm_node_id) WHERE t.station = 'subway'")
def subway_station(spark: SparkSession, d: str) -> DataFrame:
    n = _tagged_nodes(spark, d).where(F.try_element_at("tags", F.lit("station")) == "subway")
    return n.select("osm_node_id", F.coalesce(F.try_element_at("tags", F.lit("name")), F.lit("")).alias("name"), _r(geo.lat_to_y(F.col("lat")) + 10, 3).alias("label_y"))
