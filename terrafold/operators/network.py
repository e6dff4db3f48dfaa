"""Road-network operators: lengths, times, adjacency, boxes, turns and directions. DataFrames in, DataFrames out."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.functions import geo
from terrafold.session import stored


def bounds(intersections: DataFrame) -> DataFrame:
    """One row: extent in degrees and the mean latitude in radians."""
    a = intersections.agg(F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"))
    return a.withColumn("mean_lat", F.radians((F.col("min_lat") + F.col("max_lat")) / 2))


def projected(points: DataFrame, intersections: DataFrame) -> DataFrame:
    """Points with x and y in metres about the map's mean latitude, a scalar of one row."""
    one = bounds(intersections).select("mean_lat")
    df = points.join(F.broadcast(one))  # a single row
    return df.withColumns({"x": geo.lon_to_x(F.col("lon"), F.col("mean_lat")), "y": geo.lat_to_y(F.col("lat"))}).drop("mean_lat")


def endpoints(segments: DataFrame, intersections: DataFrame) -> DataFrame:
    """Segments with the positions of both ends (from_lat, from_lon, to_lat, to_lon)."""
    a = intersections.select(F.col("intersection_id").alias("from_id"), F.col("lat").alias("from_lat"), F.col("lon").alias("from_lon"))
    b = intersections.select(F.col("intersection_id").alias("to_id"), F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"))
    return segments.join(a, "from_id").join(b, "to_id")


def segment_polylines(segments: DataFrame, intersections: DataFrame, curve_points: DataFrame) -> DataFrame:
    """(segment columns, line): the points of a segment in order, its two ends included."""
    curves = curve_points.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("idx", "lat", "lon"))).alias("c"))
    df = endpoints(segments, intersections).join(curves, "segment_id", "left")

    def at(lat: Column, lon: Column) -> Column:
        return F.struct(lat.alias("lat"), lon.alias("lon"))

    between = F.coalesce(F.transform("c", lambda p: at(p.lat, p.lon)), F.array().cast("array<struct<lat:double,lon:double>>"))
    line = F.concat(F.array(at(F.col("from_lat"), F.col("from_lon"))), between, F.array(at(F.col("to_lat"), F.col("to_lon"))))
    return df.withColumn("line", line).drop("c")


def line_length(line: Column) -> Column:
    """Metres along an array of (lat, lon)."""
    steps = F.arrays_zip(F.slice(line, F.lit(1), F.size(line) - 1).alias("a"), F.slice(line, F.lit(2), F.size(line) - 1).alias("b"))
    return F.aggregate(steps, F.lit(0.0), lambda s, p: s + geo.geo_distance(p["a"]["lat"], p["a"]["lon"], p["b"]["lat"], p["b"]["lon"]))


def segment_metrics(segments: DataFrame, intersections: DataFrame, curve_points: DataFrame) -> DataFrame:
    """Segments with length in metres and travel time in seconds (0 where the speed is 0)."""
    df = segment_polylines(segments, intersections, curve_points).withColumn("length", line_length(F.col("line")))
    return df.withColumn("seconds", F.when(F.col("speed_mps") == 0, 0.0).otherwise(F.try_divide(F.col("length"), F.col("speed_mps"))))


def adjacency(segments: DataFrame) -> DataFrame:
    """(intersection_id, segment_id, neighbour_id) in both directions, one-way or not."""
    ends = F.array(F.struct(F.col("from_id").alias("a"), F.col("to_id").alias("b")), F.struct(F.col("to_id").alias("a"), F.col("from_id").alias("b")))
    return segments.select("segment_id", F.explode(F.array_distinct(ends)).alias("e")).select(F.col("e.a").alias("intersection_id"), "segment_id", F.col("e.b").alias("neighbour_id"))


def street_intersections(segments: DataFrame) -> DataFrame:
    """(street_id, intersection_id), each pair once."""
    return segments.select("street_id", F.explode(F.array("from_id", "to_id")).alias("intersection_id")).distinct()


def corner_angles(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """pairs (src, dst) of segments with the angle at their common end; null if they share none.

    The nearest curve point stands for the far end. Ends are tried in order: from-from, to-from, from-to, to-to.
    """
    def side(name: str) -> DataFrame:
        return lines.select(
            F.col("segment_id").alias(name), F.col("from_id").alias(f"{name}_from"), F.col("to_id").alias(f"{name}_to"), F.col("line")[0].alias(f"{name}_a"), F.element_at("line", -1).alias(f"{name}_b"),
            F.col("line")[1].alias(f"{name}_near_a"), F.element_at("line", -2).alias(f"{name}_near_b"),
        )

    df = pairs.join(side("src"), "src").join(side("dst"), "dst")
    rules = [("from", "from"), ("to", "from"), ("from", "to"), ("to", "to")]
    near = {"from": "near_a", "to": "near_b"}
    end = {"from": "a", "to": "b"}
    corner = F.lit(None).cast("struct<p:struct<lat:double,lon:double>,q:struct<lat:double,lon:double>,r:struct<lat:double,lon:double>>")
    for s, d in reversed(rules):
        corner = F.when(F.col(f"src_{s}") == F.col(f"dst_{d}"), F.struct(F.col(f"src_{near[s]}").alias("p"), F.col(f"src_{end[s]}").alias("q"), F.col(f"dst_{near[d]}").alias("r"))).otherwise(corner)
    df = df.withColumn("c", corner)

    def metres(a: str, b: str) -> Column:
        return geo.geo_distance(F.col(f"c.{a}.lat"), F.col(f"c.{a}.lon"), F.col(f"c.{b}.lat"), F.col(f"c.{b}.lon"))

    return df.select("src", "dst", geo.corner_angle(metres("p", "q"), metres("q", "r"), metres("p", "r")).alias("angle"))


def route_turns(routes: DataFrame, lines: DataFrame, mean_lat: DataFrame) -> DataFrame:
    """routes (request_id, seq, segment_id) with next_segment and the turn onto it; null for the last of each route.

    Segments meet to-from, from-from or to-to, else from-to, in that order.
    """
    steps = routes.select("request_id", "seq", "segment_id", F.lead("segment_id").over(Window.partitionBy("request_id").orderBy("seq")).alias("next_segment"))

    def side(name: str) -> DataFrame:
        return lines.select(F.col("segment_id").alias(f"{name}_id"), *(F.col(c).alias(f"{name}_{c}") for c in ("from_id", "to_id", "line", "street_id")))

    df = steps.join(side("s"), F.col("segment_id") == F.col("s_id")).join(side("d"), F.col("next_segment") == F.col("d_id"), "left").join(F.broadcast(mean_lat.select("mean_lat")))  # one row
    leaves_end = (F.col("s_to_id") == F.col("d_from_id")) | ((F.col("s_from_id") != F.col("d_from_id")) & (F.col("s_to_id") == F.col("d_to_id")))
    enters_start = (F.col("s_to_id") == F.col("d_from_id")) | (F.col("s_from_id") == F.col("d_from_id"))
    df = df.withColumns(
        {
            "p": F.when(leaves_end, F.element_at("s_line", -2)).otherwise(F.col("s_line")[1]),
            "q": F.when(leaves_end, F.element_at("s_line", -1)).otherwise(F.col("s_line")[0]),
            "r": F.when(enters_start, F.col("d_line")[1]).otherwise(F.element_at("d_line", -2)),
        }
    )

    def heading(a: str, b: str) -> Column:
        x = [geo.lon_to_x(F.col(f"{k}.lon"), F.col("mean_lat")) for k in (a, b)]
        y = [geo.lat_to_y(F.col(f"{k}.lat")) for k in (a, b)]
        return F.atan2(y[1] - y[0], x[1] - x[0])

    df = df.withColumns({"before": heading("p", "q"), "after": heading("q", "r")})
    side_of = F.when(F.col("next_segment").isNotNull(), geo.turn(F.col("before"), F.col("after")))
    return df.select("request_id", "seq", "segment_id", "next_segment", F.col("s_street_id").alias("street_id"), F.col("d_street_id").alias("next_street"), side_of.alias("turn"))


def path_times(routes: DataFrame, metrics: DataFrame, penalty: float, requests: DataFrame | None = None) -> DataFrame:
    """(request_id, seconds): segment times plus a penalty for each change of street; infinite for a request without a route."""
    df = routes.join(metrics.select("segment_id", "street_id", "seconds"), "segment_id")
    before = F.lag("street_id").over(Window.partitionBy("request_id").orderBy("seq"))
    cost = df.withColumn("turns", F.coalesce(F.col("street_id") != before, F.lit(False)).cast("int")).groupBy("request_id").agg((F.sum("seconds") + penalty * F.sum("turns")).alias("seconds"))
    if requests is None:
        return cost
    return requests.join(cost, "request_id", "left").select("request_id", F.coalesce("seconds", F.lit(math.inf)).alias("seconds"))


#: Cells of the nearest search: so many degrees on the first level, a share of that on each further one, and how many levels.
NEAREST_DEG, NEAREST_SPLIT, NEAREST_LEVELS = 45.0, 8, 6


def _bounds_to(lat: Column, lon: Column, box: Column) -> tuple[Column, Column]:
    """(least, most) metres from a position to any point in a box (south, north, west, east)."""
    cos = [F.cos(F.radians((lat + box[k]) / 2)) for k in ("south", "north")]
    mean_crosses = (lat + box["south"] < 0) & (lat + box["north"] > 0)
    zero = F.lit(0.0)

    def metres(dlat: Column, dlon: Column, c: Column) -> Column:
        return geo.EARTH_RADIUS_M * F.hypot(F.radians(dlat), F.radians(dlon) * c)

    least = metres(F.greatest(box["south"] - lat, lat - box["north"], zero), F.greatest(box["west"] - lon, lon - box["east"], zero), F.least(*cos))
    most = metres(
        F.greatest(F.abs(lat - box["south"]), F.abs(lat - box["north"])), F.greatest(F.abs(lon - box["west"]), F.abs(lon - box["east"])), F.when(mean_crosses, 1.0).otherwise(F.greatest(*cos))
    )
    return least, most


def nearest(probes: DataFrame, targets: DataFrame, by: str | None = None, levels: int = NEAREST_LEVELS) -> DataFrame:
    """(probe_id, target_id, metres): probes (probe_id, lat, lon) each with the nearest of targets (target_id, lat, lon); of equals the least id.

    With ``by`` only targets with the probe's value of that column count. Targets lie in a tree of cells, each with the
    box of its targets. The farthest corner of the box of the smallest cell that holds the probe and a target bounds the
    distance; then the search goes down the tree and keeps, for each probe, only cells whose box begins within the
    bound. So few cells stay on every level, however dense or far away the targets are, and the answer is exact. Probes,
    and targets, at one position count as one. Probes without a target come out with nulls.
    """
    group = F.col(by) if by else F.lit(0)
    named = probes.select("probe_id", "lat", "lon", group.alias("g"))
    lat, lon = F.col("lat"), F.col("lon")
    p = named.where("lat IS NOT NULL AND lon IS NOT NULL AND g IS NOT NULL").select("g", "lat", "lon").distinct()
    t = targets.select("target_id", "lat", "lon", group.alias("g")).where("lat IS NOT NULL AND lon IS NOT NULL AND g IS NOT NULL").groupBy("g", "lat", "lon").agg(F.min("target_id").alias("target_id"))

    def cell(level: int) -> Column:
        size = NEAREST_DEG / NEAREST_SPLIT**level
        return F.floor((lat + 90) / size) * (1 << 31) + F.floor((lon + 180) / size)

    own_cells = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), (cell(k - 1) if k else F.lit(0)).cast("long").alias("above"), cell(k).alias("cell")) for k in range(levels)))).alias("own")
    extent = [F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east")]
    boxes = stored(t.select("g", "lat", "lon", own_cells).select("g", "lat", "lon", "own.*").groupBy("g", "level", "above", "cell").agg(*extent))

    sides = F.struct("south", "north", "west", "east")
    asked = p.select("g", "lat", "lon", own_cells).select("g", "lat", "lon", "own.level", "own.cell").join(boxes.select("g", "level", "cell", sides.alias("box")), ["g", "level", "cell"])
    bound = asked.groupBy("g", "lat", "lon").agg(F.min(_bounds_to(lat, lon, F.col("box"))[1]).alias("far"))
    left = p.join(bound, ["g", "lat", "lon"], "left").withColumns({"above": F.lit(0).cast("long"), "far": F.coalesce("far", F.lit(float("inf")))})
    left = stored(left)

    def judged(x: Column) -> Column:
        least, most = _bounds_to(lat, lon, x)
        return F.struct(x["cell"].alias("cell"), least.alias("least"), most.alias("most"))

    for k in range(levels):
        # at most NEAREST_SPLIT^2 parts of a cell; on the first level the cells of the globe
        parts = boxes.where(F.col("level") == k).groupBy("g", "above").agg(F.collect_list(F.struct("cell", "south", "north", "west", "east")).alias("parts"))
        met = left.join(parts, ["g", "above"]).withColumn("parts", F.transform("parts", judged))
        met = met.withColumn("far", F.least("far", F.array_min(F.transform("parts", lambda x: x["most"]))))
        # a few micrometres of slack, so that equals stay in
        near = F.explode(F.filter("parts", lambda x: x["least"] <= F.col("far") + 1e-5)).alias("x")
        left = met.select("lat", "lon", "g", "far", near).select("lat", "lon", "g", "far", F.col("x.cell").alias("above"))
    ends = t.select("g", cell(levels - 1).alias("above"), "target_id", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"))
    # to the micrometre, so that equal distances are equal however they were computed
    d = F.round(geo.geo_distance(lat, lon, F.col("t_lat"), F.col("t_lon")), 6)
    best = left.join(ends, ["g", "above"]).groupBy("g", "lat", "lon").agg(F.min(F.struct(d.alias("d"), "target_id")).alias("best"))
    return named.join(best, ["g", "lat", "lon"], "left").select("probe_id", F.col("best.target_id").alias("target_id"), F.col("best.d").alias("metres"))
