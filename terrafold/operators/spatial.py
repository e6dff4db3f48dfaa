"""Points near points, and the regions that contain points, by latitude strips and a local sweep.

Latitude is cut into strips, each strip into blocks of longitude. A point belongs to one cell, its owner; the other
side's rows go to every cell that they can matter in, so strips overlap and each pair comes out of one cell only. Cells
are range-partitioned, sorted by longitude within and swept with an active set (see ``sweep``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.operators.sweep import sweep
from terrafold.session import checkpointed, stored

EARTH_RADIUS_M = 6371008.8
#: Height of the strips of the near join, in degrees (about 1.1 km); the distance must not exceed it.
STRIP_DEG = 0.01
#: A cell with more rows of one side than this is split into salted parts, one more for each multiple.
CELL_ROWS = 200_000
#: Full cells up to which their list is broadcast.
SPLIT_CELLS = 10_000
#: Rows of an outline that are ordered together; longer outlines are ordered in parts that are then linked.
OUTLINE_PART = 4096
BLOCK_BASE = 1 << 20
SALTS = 1 << 24


def usable_position(lat: Column, lon: Column) -> Column:
    """Both present and finite, in range, and not both 0."""
    return F.coalesce(
        lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0)),
        F.lit(False),
    )


def point_positions(points: DataFrame, key: str = "osm_id") -> DataFrame:
    """(id, lat, lon): the usable position of each key; keys without one are left out, as are null keys.

    If usable positions of a key differ, one is picked by its hash, the same in every run.
    """
    some = points.where(F.col(key).isNotNull() & usable_position(F.col("lat"), F.col("lon")))
    pick = F.xxhash64("lat", "lon")
    return some.groupBy(F.col(key).alias("id")).agg(F.max_by("lat", pick).alias("lat"), F.max_by("lon", pick).alias("lon"))


def node_positions(nodes: DataFrame) -> DataFrame:
    """(id, lat, lon): where the highest version of each node puts it; nowhere if that is not visible or not usable.

    Deliveries of the same version count as one: a usable position goes before an unusable one, then visible before
    not, then the greater hash. All buffers are fixed-width, so that hash aggregation with map-side combining applies.
    """
    usable = usable_position(F.col("lat"), F.col("lon"))
    visible = F.coalesce(F.col("is_visible"), F.lit(True))
    version = F.coalesce(F.col("version").cast("long"), F.lit(-1))
    rank = version * (1 << 32) + F.when(usable, 1 << 31).otherwise(0) + F.when(visible, 1 << 30).otherwise(0) + F.pmod(F.xxhash64("lat", "lon"), F.lit((1 << 30) - 1))
    found = (
        nodes.where(F.col("osm_id").isNotNull())
        .select("osm_id", "lat", "lon", rank.alias("rank"))
        .groupBy(F.col("osm_id").alias("id"))
        .agg(F.max("rank").alias("rank"), F.max_by("lat", "rank").alias("lat"), F.max_by("lon", "rank").alias("lon"))
    )
    flags = F.shiftright("rank", 30).bitwiseAND(F.lit(3))
    return found.where(flags == 3).select("id", "lat", "lon")


def reach_deg(metres: float) -> float:
    return math.degrees(metres / EARTH_RADIUS_M) * (1 + 1e-9)


def _strip_shape(strip: Column, metres: float) -> tuple[Column, Column]:
    """(half-width of the longitude window, number of blocks) of a strip; near a pole one block that is all longitudes."""
    reach = reach_deg(metres)
    farthest = F.greatest(F.abs(strip * STRIP_DEG - 90), F.abs((strip + 1) * STRIP_DEG - 90))
    polar = farthest + reach >= 89.0
    cos = F.cos(F.radians(F.least(farthest, F.lit(89.0))))
    half = F.when(polar, F.lit(361.0)).otherwise(F.degrees(F.asin(F.sin(F.radians(F.lit(reach))) / cos)) * (1 + 1e-9))
    return half, F.when(polar, F.lit(1)).otherwise(F.floor(F.lit(360.0) / (F.lit(STRIP_DEG) / cos))).cast("int")


def _half_width(strip: int, metres: float) -> float:
    """The window's half-width again, on the worker; a little wider than that of _strip_shape."""
    reach = reach_deg(metres)
    farthest = max(abs(strip * STRIP_DEG - 90), abs((strip + 1) * STRIP_DEG - 90))
    if farthest + reach >= 89.0:
        return 361.0
    return math.degrees(math.asin(math.sin(math.radians(reach)) / math.cos(math.radians(farthest)))) * (1 + 1e-8)


def _owned(points: DataFrame, metres: float) -> DataFrame:
    """Points with the cell that owns them; longitude 180 is -180."""
    strip = F.floor((F.col("lat") + 90) / STRIP_DEG).cast("int")
    lon = F.when(F.col("lon") >= 180, F.col("lon") - 360).otherwise(F.col("lon"))
    df = points.select("id", "lat", lon.alias("lon"), strip.alias("strip"))
    _, blocks = _strip_shape(F.col("strip"), metres)
    block = F.least(F.floor((F.col("lon") + 180) * blocks / 360), blocks - 1)
    return df.select("id", "lat", "lon", (F.col("strip").cast("long") * BLOCK_BASE + block).alias("cell"))


def _overlapping(items: DataFrame, metres: float) -> DataFrame:
    """Items once for every cell within reach, their longitude shifted where a cell lies beyond the date line."""
    reach = reach_deg(metres)
    lon = F.when(F.col("lon") >= 180, F.col("lon") - 360).otherwise(F.col("lon"))
    strips = F.sequence(F.floor((F.col("lat") - reach + 90) / STRIP_DEG).cast("int"), F.floor((F.col("lat") + reach + 90) / STRIP_DEG).cast("int"))
    df = items.select("id", "lat", lon.alias("lon"), F.explode(strips).alias("strip"))
    half, blocks = _strip_shape(F.col("strip"), metres)
    df = df.withColumns({"half": half, "blocks": blocks})
    lowest = F.floor((F.col("lon") - F.col("half") + 180) * F.col("blocks") / 360)
    highest = F.floor((F.col("lon") + F.col("half") + 180) * F.col("blocks") / 360)
    around = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(lowest, highest))
    df = df.select("id", "lat", "lon", "strip", "blocks", F.explode(around).alias("block"))
    turn = F.when(F.col("block") < 0, 360.0).when(F.col("block") >= F.col("blocks"), -360.0).otherwise(0.0)
    return df.select("id", "lat", (F.col("lon") + turn).alias("lon"), (F.col("strip").cast("long") * BLOCK_BASE + F.pmod("block", "blocks")).alias("cell"))


def salted(points: DataFrame, items: DataFrame, cell_rows: int, sizes_of: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides (cell, id, ...) with a salt. A full cell becomes parts: rows of one side are dealt out, those of the other are repeated.

    The counts (of ``sizes_of``, cells of rows that need not be deduplicated yet) are aggregated before they are
    shuffled. Full cells are few, and are broadcast up to SPLIT_CELLS of them; beyond, they are joined by shuffle.
    """
    sizes_of = sizes_of or (points, items)
    sizes = (
        sizes_of[0].select("cell", F.lit(1).alias("p"), F.lit(0).alias("i"))
        .unionAll(sizes_of[1].select("cell", F.lit(0).alias("p"), F.lit(1).alias("i")))
        .groupBy("cell")
        .agg(F.sum("p").alias("p"), F.sum("i").alias("i"))
        .where((F.col("p") > cell_rows) | (F.col("i") > cell_rows))
    )
    by = {f"by_{x}": F.greatest(F.lit(1), F.ceil(F.col(x) / cell_rows)).cast("int") for x in ("p", "i")}
    parts = stored(sizes.select("cell", *(c.alias(n) for n, c in by.items())))
    n = parts.count()
    if not n:
        return points.withColumn("salt", F.lit(0)), items.withColumn("salt", F.lit(0))
    if n <= SPLIT_CELLS:
        parts = F.broadcast(parts)  # a checked bound
    whole = {name: F.coalesce(name, F.lit(1)) for name in by}
    own = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    p = points.join(parts, "cell", "left").withColumns(whole)
    p = p.withColumn("salt", F.explode(F.transform(F.sequence(F.lit(0), F.col("by_i") - 1), lambda k: (F.pmod(own, F.col("by_p")) * F.col("by_i") + k).cast("int"))))
    i = items.join(parts, "cell", "left").withColumns(whole)
    i = i.withColumn("salt", F.explode(F.transform(F.sequence(F.lit(0), F.col("by_p") - 1), lambda k: (k * F.col("by_i") + F.pmod(own, F.col("by_i"))).cast("int"))))
    return p.drop("by_p", "by_i"), i.drop("by_p", "by_i")


def _swept(rows: DataFrame) -> DataFrame:
    return rows.repartitionByRange("cell", "salt").sortWithinPartitions("cell", "salt", "lon")


def near_pairs(points: DataFrame, items: DataFrame, metres: float, cell_rows: int = CELL_ROWS, sizes_of: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(point_id, item_id) of all pairs at most ``metres`` apart along the great circle.

    Both inputs: (id, lat, lon) with usable positions and unique ids; other columns are ignored. Empty inputs give no
    rows. Distances across the date line and at the poles count as any other. ``sizes_of`` may name cheaper frames
    (id, lat, lon) of at least these rows to find full cells in, such as the tables before they are deduplicated.
    """
    if not 0 <= reach_deg(metres) <= STRIP_DEG:
        raise ValueError("the distance must be at most the height of a strip")
    p, i = _owned(points, metres), _overlapping(items, metres)
    p, i = salted(p, i, cell_rows, None if sizes_of is None else (_owned(sizes_of[0], metres), _owned(sizes_of[1], metres)))
    rows = p.withColumn("is_item", F.lit(False)).unionByName(i.withColumn("is_item", F.lit(True)))
    rows = rows.select("id", "lat", "lon", "cell", "salt", "is_item")
    limit = math.sin(min(metres / EARTH_RADIUS_M / 2, math.pi / 2)) ** 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def with_key() -> Iterator[pa.RecordBatch]:
            for b in batches:  # cells and salts in one key: salts are few
                key = b.column("cell").to_numpy() * SALTS + b.column("salt").to_numpy()
                yield b.append_column("key", pa.array(key))

        def keep(a: dict, b: dict) -> np.ndarray:
            la, lb = np.radians(a["lat"]), np.radians(b["lat"])
            h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin(np.radians(b["lon"] - a["lon"]) / 2) ** 2
            return h <= limit

        def result(a: dict, b: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a["id"]), pa.array(b["id"])], ["point_id", "item_id"])

        def window(key: int) -> tuple[float, float]:
            half = _half_width(key // SALTS // BLOCK_BASE, metres)
            return half, half

        yield from sweep(with_key(), "key", ["id", "lat"], window, keep, result)

    return _swept(rows).mapInArrow(run, "point_id long, item_id long")


def wrapped(x: Column) -> Column:
    """A difference of longitudes as the shorter way round, in [-180, 180)."""
    return F.pmod(x + 180, F.lit(360.0)) - 180


def outline_edges(outline_points: DataFrame) -> DataFrame:
    """(feature_id, lat1, lon1, lat2, lon2) of closed outlines: the first and last points by idx are equal.

    Repeated rows count once; rows without feature_id or idx are left out; an outline with an unusable point, of under
    four points, or that winds around a pole contains nothing and gives no edges. Long outlines are put in order in
    parts of OUTLINE_PART, which are linked by the first point of each part, so none is sorted in one task.
    """
    pick = F.xxhash64("lat", "lon")
    pts = (
        outline_points.where(F.col("feature_id").isNotNull() & F.col("idx").isNotNull())
        .groupBy("feature_id", F.col("idx").cast("int").alias("idx"))
        .agg(F.max_by("lat", pick).alias("lat"), F.max_by("lon", pick).alias("lon"))
    )
    fits = F.coalesce(F.abs(F.col("lat")) <= 90, F.lit(False)) & F.coalesce(F.abs(F.col("lon")) <= 180, F.lit(False))
    closed = (
        pts.groupBy("feature_id")
        .agg(
            F.min_by("lat", "idx").alias("a"), F.max_by("lat", "idx").alias("b"), F.min_by("lon", "idx").alias("c"), F.max_by("lon", "idx").alias("d"),
            F.min(fits.cast("int")).alias("fit"), F.count(F.lit(1)).alias("n"),
        )
        .where("a = b AND c = d AND fit = 1 AND n >= 4")
        .select("feature_id")
    )
    part = F.floor(F.col("idx") / OUTLINE_PART)
    pts = pts.join(closed, "feature_id", "left_semi").withColumn("part", part)
    in_part = Window.partitionBy("feature_id", "part").orderBy("idx")
    heads = pts.groupBy("feature_id", "part").agg(F.min_by("lat", "idx").alias("head_lat"), F.min_by("lon", "idx").alias("head_lon"))
    of_parts = Window.partitionBy("feature_id").orderBy("part")
    links = heads.select("feature_id", "part", F.lead("head_lat").over(of_parts).alias("next_lat"), F.lead("head_lon").over(of_parts).alias("next_lon"))
    inner = pts.select("feature_id", "part", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.lead("lat").over(in_part).alias("lat2"), F.lead("lon").over(in_part).alias("lon2"))
    edges = inner.join(links, ["feature_id", "part"])
    return edges.select("feature_id", "lat1", "lon1", F.coalesce("lat2", "next_lat").alias("lat2"), F.coalesce("lon2", "next_lon").alias("lon2")).where("lat2 IS NOT NULL")


#: Levels of cells of the containment join: level L has cells of STRIP_DEG * 4^L degrees, until one cell is all.
LEVELS = 8


def _outline_boxes(edges: DataFrame) -> DataFrame:
    """(feature_id, south, north, west, width, bands, level): extent of each outline, bands of longitude for its edges.

    An outline that reaches more than half around the globe from its first point gets all longitudes. There are so many
    bands that on average an edge lies in at most about four.
    """
    d = wrapped(F.col("lon2") - F.col("lon1"))
    start = edges.groupBy("feature_id").agg(F.min("lon1").alias("lon0"))
    e = edges.join(start, "feature_id").withColumns({"x1": wrapped(F.col("lon1") - F.col("lon0")), "d": d})
    jump = F.abs(F.col("x1") + F.col("d") - wrapped(F.col("lon2") - F.col("lon0"))) > 1
    b = e.groupBy("feature_id").agg(
        F.min("lat1").alias("south"), F.max("lat1").alias("north"), F.first("lon0").alias("lon0"), F.min("x1").alias("lo"), F.max("x1").alias("hi"),
        F.max(jump.cast("int")).alias("wide"), F.count(F.lit(1)).alias("n"), F.sum(F.abs("d")).alias("run"), F.abs(F.sum("d")).alias("turn"),
    ).where("turn < 1")  # a ring around a pole turns by 360
    width = F.when(F.col("wide") == 1, F.lit(360.0)).otherwise(F.col("hi") - F.col("lo"))
    west = F.when(F.col("wide") == 1, F.lit(-180.0)).otherwise(wrapped(F.col("lon0") + F.col("lo")))
    bands = F.greatest(F.lit(1.0), F.least(F.col("n") / 4, F.when(F.col("run") > 0, 3 * F.col("n") * width / F.col("run")).otherwise(1.0)))
    size = F.greatest(F.col("north") - F.col("south"), width, F.lit(1e-9))
    level = F.least(F.lit(LEVELS), F.greatest(F.lit(0), F.ceil(F.log(size / STRIP_DEG) / math.log(4)))).cast("int")
    return b.select("feature_id", "south", "north", west.alias("west"), width.alias("width"), F.floor(bands).cast("int").alias("bands"), level.alias("level"))


def _level_shape(level: Column) -> tuple[Column, Column]:
    """(height, number of blocks) of a level's cells."""
    height = F.pow(F.lit(4.0), level) * STRIP_DEG
    blocks = F.floor(360 / height)
    return height, F.when(blocks < 3, F.lit(1)).otherwise(blocks).cast("long")


def containing_outlines(points: DataFrame, outline_points: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(point_id, feature_id): the closed outlines that contain each point, edges being straight in degrees.

    points: (id, lat, lon), usable and with unique ids. Boxes of outlines are swept against the points on the level of
    cells that fits their size; for what remains, crossings of the meridian north of the point are counted over the
    edges in the point's band of the outline, so that no outline is ever assembled in one row.
    """
    edges = checkpointed(outline_edges(outline_points))
    boxes = checkpointed(_outline_boxes(edges))
    level, height, blocks = F.col("level"), F.col("height"), F.col("blocks")
    h, n = _level_shape(level)
    items = boxes.withColumns({"height": h, "blocks": n})
    items = items.withColumn("strip", F.explode(F.sequence(F.floor((F.col("south") + 90) / height), F.floor((F.col("north") + 90) / height))))
    lowest, highest = F.floor((F.col("west") + 180) * blocks / 360), F.floor((F.col("west") + F.col("width") + 180) * blocks / 360)
    again = F.when(F.col("west") + F.col("width") > 180, F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    items = items.withColumn("block", F.explode(F.when(blocks == 1, again).otherwise(F.sequence(lowest, highest))))
    turn = F.when(F.col("block") >= blocks, -360.0).otherwise(0.0)

    def cell(strip: Column, block: Column) -> Column:
        return (strip * LEVELS * 2 + level) * BLOCK_BASE + block

    items = items.select(
        F.col("feature_id").cast("long").alias("id"), F.col("south").alias("lat"), (F.col("west") + turn).alias("lon"), "north", "width", "bands",
        cell(F.col("strip"), F.pmod("block", "blocks")).alias("cell"), F.lit(True).alias("is_item"),
    )
    # on the coarse levels a cell may hold half of all points, so full cells are split
    levels = [r.level for r in boxes.select("level").distinct().collect()]  # at most LEVELS + 1 rows
    lon = F.when(F.col("lon") >= 180, F.col("lon") - 360).otherwise(F.col("lon"))
    own = points.select("id", "lat", lon.alias("lon"), F.explode(F.array(*map(F.lit, levels)) if levels else F.expr("array()").cast("array<int>")).alias("level"))
    own = own.withColumns({"height": h, "blocks": n})
    own = own.select(
        "id", "lat", "lon", F.lit(0.0).alias("north"), F.lit(0.0).alias("width"), F.lit(0).alias("bands"),
        cell(F.floor((F.col("lat") + 90) / height), F.least(F.floor((F.col("lon") + 180) * blocks / 360), blocks - 1)).alias("cell"), F.lit(False).alias("is_item"),
    )
    own, items = salted(own, items, cell_rows)
    rows = own.unionByName(items).withColumn("key", F.col("cell") * SALTS + F.col("salt")).drop("cell", "salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keep(a: dict, b: dict) -> np.ndarray:
            return (a["lon"] <= b["lon"] + b["width"]) & (a["lat"] >= b["lat"]) & (a["lat"] <= b["north"])

        def result(a: dict, b: dict) -> pa.RecordBatch:
            k = b["bands"].astype(np.int64)
            at = np.where(b["width"] > 0, (a["lon"] - b["lon"]) / np.where(b["width"] > 0, b["width"], 1) * k, 0)
            band = np.clip(np.floor(at), 0, k - 1).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (a["id"], a["lat"], a["lon"], b["id"], band)], ["point_id", "lat", "lon", "feature_id", "band"])

        def window(key: int) -> tuple[float, float]:
            return min(STRIP_DEG * 4 ** ((key // SALTS // BLOCK_BASE) % (LEVELS * 2)), 360.0) * (1 + 1e-9), 0.0

        yield from sweep(batches, "key", ["id", "lat", "north", "width", "bands"], window, keep, result)

    swept = rows.repartitionByRange("key").sortWithinPartitions("key", "lon")
    pairs = swept.mapInArrow(run, "point_id long, lat double, lon double, feature_id long, band long")

    b = edges.join(boxes, "feature_id").withColumn("x1", F.pmod(F.col("lon1") - F.col("west") + 1e-9, F.lit(360.0)) - 1e-9)
    b = b.withColumn("x2", F.col("x1") + wrapped(F.col("lon2") - F.col("lon1")))
    step = F.greatest(F.col("width"), F.lit(1e-12)) / F.col("bands")
    low, high = F.floor(F.least("x1", "x2") / step - 1e-6), F.floor(F.greatest("x1", "x2") / step + 1e-6)
    # bands of outlines around the globe go on from the last to the first
    around = F.transform(F.sequence(low, high), lambda k: F.when(F.col("width") >= 360, F.pmod(k, F.col("bands").cast("long"))).otherwise(F.least(F.greatest(k, F.lit(0)), F.col("bands").cast("long") - 1)))
    banded = b.select(F.col("feature_id").cast("long").alias("feature_id"), "lat1", "lon1", "lat2", "lon2", F.explode(F.array_distinct(around)).alias("band"))
    met = pairs.join(banded, ["feature_id", "band"])
    x1, raw2 = wrapped(F.col("lon1") - F.col("lon")), wrapped(F.col("lon2") - F.col("lon"))
    x2 = raw2 + 360 * F.round((x1 + wrapped(F.col("lon2") - F.col("lon1")) - raw2) / 360)
    crosses = (x1 < 0) != (x2 < 0)
    north_of = F.col("lat1") + F.try_divide(-x1, x2 - x1) * (F.col("lat2") - F.col("lat1")) > F.col("lat")
    counted = met.groupBy("point_id", "feature_id").agg(F.sum((crosses & north_of).cast("int")).alias("n"))
    return counted.where(F.col("n") % 2 == 1).select("point_id", "feature_id")


def nearby(pois: DataFrame, nodes: DataFrame, outline_points: DataFrame, metres: float = 30.0) -> DataFrame:
    """(pair_kind, poi_id, other_id): nodes within ``metres`` of each POI, and the closed outlines that contain it."""
    points = point_positions(pois)
    usable = usable_position(F.col("lat"), F.col("lon"))
    rows = tuple(df.where(usable).select(F.col("osm_id").alias("id"), "lat", "lon") for df in (pois, nodes))
    near = near_pairs(points, node_positions(nodes), metres, sizes_of=rows)
    inside = containing_outlines(points, outline_points)
    return near.select(F.lit("near").alias("pair_kind"), F.col("point_id").alias("poi_id"), F.col("item_id").alias("other_id")).unionAll(
        inside.select(F.lit("inside"), "point_id", "feature_id")
    )
