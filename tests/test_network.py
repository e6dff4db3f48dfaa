import math

from pyspark.sql import functions as F

from terrafold.functions import geo, tags
from terrafold.operators import features, network, osm, routing, search

I = "intersection_id long, lat double, lon double"
S = "segment_id long, from_id long, to_id long, street_id long, one_way boolean, speed_mps double"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_max_speed(spark):
    rows = [("50",), ("30 mph",), ("25MPH",), ("none",), ("",), ("60;80",), (" 4 0 ",), (None,), ("mph",), (".5",), ("+7",)]
    got = [r.v for r in spark.createDataFrame(rows, "s string").select(tags.max_speed(F.col("s")).alias("v")).collect()]
    assert [round(x, 3) for x in got] == [50, 48.28, 40.233, -1, -1, 60, 40, -1, -1, 0.5, 7]


def test_turns(spark):
    def turn(a, b):
        return one(spark, geo.turn(F.lit(a), F.lit(b)))

    assert turn(0.5, 0.6) == "STRAIGHT" and turn(0.5, 1.0) == "LEFT" and turn(1.0, 0.5) == "RIGHT" and turn(-0.5, -1.0) == "RIGHT" and turn(-1.0, -0.5) == "LEFT"
    assert turn(1.0, -3.0) == "LEFT" and turn(1.0, -1.0) == "RIGHT" and turn(-1.0, 1.0) == "LEFT" and turn(0.0, 1.0) == "LEFT" and turn(1.0, 0.0) == "RIGHT"
    assert turn(3.1, -3.1) == "LEFT"


def test_corner_order_and_missing(spark):
    i = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.01), (3, 0.01, 0.01), (4, 1.0, 1.0)], I)
    s = spark.createDataFrame([(1, 1, 2, 1, False, 5.0), (2, 2, 3, 2, False, 5.0), (3, 4, 4, 3, False, 5.0)], S)
    c = spark.createDataFrame([], "segment_id long, idx int, lat double, lon double")
    lines = network.segment_polylines(s, i, c)
    got = {(r.src, r.dst): r.angle for r in network.corner_angles(spark.createDataFrame([(1, 2), (2, 1), (1, 3), (1, 1)], "src long, dst long"), lines).collect()}
    assert math.isclose(got[1, 2], math.pi / 2, abs_tol=1e-3) and math.isclose(got[2, 1], math.pi / 2, abs_tol=1e-3) and got[1, 3] is None and math.isclose(got[1, 1], math.pi, abs_tol=1e-3)


def test_speed_zero(spark):
    i = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.01)], I)
    s = spark.createDataFrame([(1, 1, 2, 1, False, 0.0)], S)
    m = network.segment_metrics(s, i, spark.createDataFrame([], "segment_id long, idx int, lat double, lon double"))
    assert m.first().seconds == 0.0 and routing.directed(m).count() == 0


def test_nearest_is_exact_and_breaks_ties(spark):
    t = spark.createDataFrame([(5, 0.0, 0.01), (3, 0.0, -0.01), (9, 40.0, 100.0)], "target_id long, lat double, lon double")
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 39.0, 99.0), (3, -60.0, -100.0), (4, 0.0, 0.009)], "probe_id long, lat double, lon double")
    got = {r.probe_id: r.target_id for r in network.nearest(p, t).collect()}
    assert got == {1: 3, 2: 9, 3: 3, 4: 5}
    assert [r.target_id for r in network.nearest(p, t.limit(0)).collect()] == [None] * 4
    assert network.nearest(p.limit(0), t).count() == 0


def test_area_of_open_ring(spark):
    f = spark.createDataFrame([(1,), (2,), (3,)], "feature_id int")
    sq = [(0.0, 0.0), (0.0, 0.001), (0.001, 0.001), (0.001, 0.0)]
    pts = [(1, i, la, lo) for i, (la, lo) in enumerate(sq + sq[:1])] + [(2, i, la, lo) for i, (la, lo) in enumerate(sq)]
    got = {r.feature_id: r.area for r in features.areas(f, spark.createDataFrame(pts, "feature_id int, idx int, lat double, lon double")).collect()}
    assert abs(got[1] - 12364) < 5 and got[2] == 0.0 and got[3] == 0.0


def test_conversion(spark):
    tag = "osm_id long, node_refs array<long>, tags map<string,string>"
    ways = spark.createDataFrame([(1, [1, 2], {"highway": "Primary", "maxspeed": "30 mph"}), (2, [9], {"highway": "path"}), (3, [4, 5], {"railway": "rail"}), (4, [1, 7], {"highway": "x"})], tag)
    nodes = spark.createDataFrame([(1, 1.0, 1.0, None), (1, 1.0, 1.0, None), (2, None, 1.0, {"shop": "a"}), (9, 2.0, 2.0, {"amenity": "cafe", "name": "N", "shop": "b"}), (4, 1.0, 1.0, {"highway": "Platform"})], "osm_id long, lat double, lon double, tags map<string,string>")
    assert {(r.osm_id, r.category, round(r.max_speed_kph, 2)) for r in osm.street_segments(ways).collect()} == {(1, 3, 48.28), (4, 0, -1.0)}
    assert {r.osm_id for r in osm.referenced_nodes(nodes, ways).collect()} == {1, 9}
    assert {(r.osm_id, r.category, r.name) for r in osm.points_of_interest(nodes).collect()} == {(9, "amenity:cafe", "N"), (4, "highway:platform", "")}
    assert {r.node_id for r in osm.missing_references(nodes, ways).collect()} == {2, 7}


def test_search_words(spark):
    assert search.parse_query("a  b & c d") == ("ab", "cd") and search.parse_query("&") == ("", "") and search.parse_query("") == ("", "")
    s = spark.createDataFrame([(1, "King St"), (2, "<unknown>")], "street_id long, street_name string")
    assert search.streets_by_prefix(s, "").count() == 0 and search.streets_by_prefix(s, "KI ng").count() == 1
    assert search.cities(spark, "Atlantis").count() == 0


def test_classes(spark):
    got = [tuple(r) for r in spark.createDataFrame([("cafe",), ("bar",), ("casino",), ("bank",), ("school",), ("bench",), (None,)], "k string").select(tags.poi_class(F.col("k")), tags.poi_group(F.col("k")), tags.type_code(F.col("k"), tags.BASIC)).collect()]
    assert [g[:2] for g in got] == [("entertainment", "FOOD"), ("entertainment", "DRINK"), ("entertainment", "ENTERTAINMENT"), ("subordinate", "OTHER"), ("basic", "OTHER"), ("negligible", "OTHER"), ("negligible", "OTHER")]
    assert one(spark, tags.colour(F.lit("#102030")))["g"] == 32 / 255
