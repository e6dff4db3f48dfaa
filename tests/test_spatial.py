import math
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from terrafold.operators import spatial

P = "id long, lat double, lon double, cell string"


def metres(a, b):
    la, lb = math.radians(a[1]), math.radians(b[1])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * spatial.EARTH_RADIUS_M * math.asin(math.sqrt(min(1, h)))


def near(spark, points, items, m=30.0, **k):
    df = spatial.near_pairs(spark.createDataFrame(points, P), spark.createDataFrame(items, P), m, **k)
    return sorted((r.point_id, r.item_id) for r in df.collect())


def scattered(n, seed, centres=((43.6, -160.0), (-45.0, 179.9999), (-45.0, -179.9999), (0.00001, 0.0), (89.9999, 10.0), (90.0, 0.0), (-90.0, 5.0), (51.4, 10.0))):
    r = random.Random(seed)
    out = []
    for i in range(n):
        la, lo = r.choice(centres)
        lon = lo + r.uniform(-0.0006, 0.0006) * (1 if abs(la) < 80 else 3e5)
        lon = (lon + 540) % 360 - 180
        out.append((i, max(-90.0, min(90.0, la + r.uniform(-0.0006, 0.0006))), 180.0 if r.random() < 0.01 else lon, "x"))
    return out


def test_near_is_brute_force(spark):
    points, items = scattered(300, 1), scattered(900, 2)
    want = sorted((p[0], i[0]) for p in points for i in items if metres(p, i) <= 30)
    assert len(want) > 100
    assert near(spark, points, items) == want
    assert near(spark, points, items, cell_rows=20) == want  # every full cell is split


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6), st.sampled_from([1.0, 30.0, 500.0]))
def test_near_any_distance(spark, seed, m):
    points, items = scattered(60, seed), scattered(120, seed + 1)
    assert near(spark, points, items, m) == sorted((p[0], i[0]) for p in points for i in items if metres(p, i) <= m)


def test_near_empty_and_same_spot(spark):
    assert near(spark, [], []) == []
    assert near(spark, [(1, 5.0, 5.0, "")], []) == []
    items = [(i, 5.0, 5.0, "") for i in range(2500)]
    assert len(near(spark, [(1, 5.0, 5.0, ""), (2, 5.0, 5.0, "")], items, cell_rows=100)) == 5000


def test_node_positions(spark):
    rows = [
        (1, 1.0, 1.0, 1, True), (1, 2.0, 2.0, 2, True), (1, None, 2.0, 2, True),  # the same version, once without a place
        (2, 1.0, 1.0, 1, True), (2, 1.0, 1.0, 2, False), (3, 1.0, 1.0, 1, True), (3, None, None, 2, True), (4, 0.0, 0.0, 1, True), (5, 91.0, 0.0, 1, True),
        (6, float("nan"), 1.0, 1, True), (7, 3.0, 180.0, None, None), (None, 1.0, 1.0, 1, True),
    ]
    df = spatial.node_positions(spark.createDataFrame(rows, "osm_id long, lat double, lon double, version int, is_visible boolean"))
    assert sorted(map(tuple, df.collect())) == [(1, 2.0, 2.0), (7, 3.0, 180.0)]


def inside(spark, points, outlines, cell_rows=spatial.CELL_ROWS):
    rows = [(f, i, la, lo, "x") for f, ring in outlines.items() for i, (la, lo) in enumerate(ring)]
    o = spark.createDataFrame(rows, "feature_id int, idx int, lat double, lon double, name string")
    return sorted((r.point_id, r.feature_id) for r in spatial.containing_outlines(spark.createDataFrame(points, P), o, cell_rows).collect())


def holds(p, ring):
    if ring[0] != ring[-1] or len(ring) < 4:
        return False
    n = 0
    for (la, lo), (lb, l2) in zip(ring, ring[1:]):
        x1 = (lo - p[2] + 180) % 360 - 180
        raw = (l2 - p[2] + 180) % 360 - 180
        d = (l2 - lo + 180) % 360 - 180
        x2 = raw + 360 * round((x1 + d - raw) / 360)
        if (x1 < 0) != (x2 < 0) and la + (-x1 / (x2 - x1)) * (lb - la) > p[1]:
            n += 1
    return n % 2 == 1


def star(rnd, lat, lon, size, n, close=True):
    ring = []
    for k in range(n):
        r = size * rnd.uniform(0.3, 1)
        ring.append((lat + r * math.sin(2 * math.pi * k / n), (lon + r * math.cos(2 * math.pi * k / n) + 540) % 360 - 180))
    return ring + ring[:1] if close else ring


def test_inside_is_brute_force(spark):
    rnd = random.Random(5)
    outlines = {}
    for f in range(60):
        la, lo = rnd.choice([(43.6, -160.0), (-45.0, 179.999), (10.0, 0.0)])
        ring = star(rnd, la + rnd.uniform(-0.01, 0.01), lo + rnd.uniform(-0.01, 0.01), rnd.choice([0.0005, 0.004, 0.02]), rnd.choice([3, 8, 40]), f % 7 != 0)
        outlines[f] = ring[::-1] if f % 3 == 0 else ring
    outlines[100] = star(rnd, 20.0, -170.0, 60.0, 30)  # over the date line, a third of the globe
    outlines[101] = [(-30.0, float(x if x < 180 else x - 360)) for x in range(0, 271, 10)] + [(30.0, float(x if x < 180 else x - 360)) for x in range(270, -1, -10)] + [(-30.0, 0.0)]  # three quarters around
    outlines[102] = [(80.0, float(x)) for x in range(-180, 180, 20)] + [(80.0, -180.0)]  # around a pole: contains nothing
    outlines[103] = [(1.0, 1.0), (2.0, 2.0), (1.0, 1.0)]
    points = [(i, rnd.uniform(-0.02, 0.02) + la, (lo + rnd.uniform(-0.02, 0.02) + 540) % 360 - 180, "") for i in range(500) for la, lo in [rnd.choice([(43.6, -160.0), (-45.0, 179.999), (10.0, 0.0)])]]
    points += [(1000 + i, rnd.uniform(-60, 60), rnd.uniform(-180, 180), "") for i in range(200)] + [(2000, 85.0, 0.0, ""), (2001, 43.6, 180.0, "")]
    want = sorted((p[0], f) for p in points for f, ring in outlines.items() if f != 102 and holds(p, ring))
    assert len(want) > 300
    assert inside(spark, points, outlines) == want
    assert inside(spark, points, outlines, cell_rows=15) == want  # full cells of one outline around half the globe and of a crowded spot


def test_inside_dirty(spark):
    square = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]
    rows = [(1, i, la, lo) for i, (la, lo) in enumerate(square)] * 2 + [(2, i, la, lo) for i, (la, lo) in enumerate(square[:-1])] + [(3, i, None if i == 2 else la, lo) for i, (la, lo) in enumerate(square)] + [(None, 0, 0.0, 0.0), (4, None, 0.0, 0.0)]
    o = spark.createDataFrame(rows, "feature_id int, idx int, lat double, lon double")
    p = spark.createDataFrame([(1, 0.5, 0.5, "")], P)
    assert [tuple(r) for r in spatial.containing_outlines(p, o).collect()] == [(1, 1)]
    assert spatial.containing_outlines(p, o.limit(0)).count() == 0
    assert spatial.containing_outlines(p.limit(0), o).count() == 0


def test_long_outline_is_linked_over_its_parts(spark):
    n = 3 * spatial.OUTLINE_PART
    ring = [(10 + math.sin(2 * math.pi * k / n), 20 + math.cos(2 * math.pi * k / n)) for k in range(n)]
    assert inside(spark, [(1, 10.0, 20.0, ""), (2, 10.99, 20.9, ""), (3, 10.5, 20.5, "")], {1: ring + ring[:1]}) == [(1, 1), (3, 1)]
