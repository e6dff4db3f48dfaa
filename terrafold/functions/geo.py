"""Geometry as Column functions: spherical distances, projection, boxes, and the camera's mappings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8
#: What the camera clamps screen coordinates to.
SCREEN_LIMIT = 10_000.0


def geo_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance in metres."""
    dlat = F.radians(lat2) - F.radians(lat1)
    dlon = (F.radians(lon2) - F.radians(lon1)) * F.cos((F.radians(lat1) + F.radians(lat2)) / 2)
    return EARTH_RADIUS_M * F.sqrt(dlat * dlat + dlon * dlon)


def lon_to_x(lon: Column, mean_lat: Column) -> Column:
    """Metres east; mean_lat in radians."""
    return EARTH_RADIUS_M * F.radians(lon) * F.cos(mean_lat)


def lat_to_y(lat: Column) -> Column:
    return EARTH_RADIUS_M * F.radians(lat)


def x_to_lon(x: Column, mean_lat: Column) -> Column:
    return F.degrees(x / (EARTH_RADIUS_M * F.cos(mean_lat)))


def y_to_lat(y: Column) -> Column:
    return F.degrees(y / EARTH_RADIUS_M)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def label_angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Rotation of a label along a line in degrees, so that it is never upside down; 0 for a line of no length."""
    swap = x1 < x2
    dx = F.when(swap, x2 - x1).otherwise(x1 - x2)
    dy = F.when(swap, y2 - y1).otherwise(y1 - y2)
    angle = F.degrees(F.atan2(dy, dx))
    return F.when((dx == 0) & (dy == 0), 0.0).otherwise(F.when((angle > 90) & (angle < 270), angle - 180).otherwise(angle))


def corner_angle(side1: Column, side2: Column, opposite: Column) -> Column:
    """pi less the angle between two sides of a triangle, by the law of cosines; null if a side has no length."""
    cos = F.try_divide(side1 * side1 + side2 * side2 - opposite * opposite, 2 * side1 * side2)
    return F.when(cos.isNotNull(), F.lit(math.pi) - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))


def turn(before: Column, after: Column) -> Column:
    """LEFT, RIGHT or STRAIGHT from the headings before and after a corner.

    Headings of equal sign compare by size, of unequal sign against the heading turned about; where one is 0 they
    compare as they are. Differences below 0.17 are straight whatever their sign.
    """
    size, back = F.abs(after), F.abs(F.when(before > 0, F.lit(math.pi) - before).otherwise(F.lit(math.pi) + before))
    left, right, straight = F.lit("LEFT"), F.lit("RIGHT"), F.lit("STRAIGHT")
    more, less = F.when(before > 0, left).otherwise(right), F.when(before > 0, right).otherwise(left)

    def by(limit: Column) -> Column:
        return F.when(size > limit, more).when(size < limit, less).otherwise(straight)

    side = F.when(before * after > 0, by(F.abs(before))).when(before * after < 0, by(back)).when(before > after, right).when(before < after, left).otherwise(straight)
    return F.when(F.abs(before - after) < 0.17, straight).otherwise(side)


def boxes_overlap(left: Column, bottom: Column, right: Column, top: Column, view: tuple[float, float, float, float]) -> Column:
    """Whether a box is not wholly off the view (left, bottom, right, top)."""
    vl, vb, vr, vt = view
    return ~((right < vl) | (left > vr) | (top < vb) | (bottom > vt))


def strictly_inside(x: Column, y: Column, view: tuple[float, float, float, float]) -> Column:
    vl, vb, vr, vt = view
    return (x > vl) & (x < vr) & (y > vb) & (y < vt)


def rectangle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A box with its derived measures, whichever corners are given."""
    left, right, bottom, top = F.least(x1, x2), F.greatest(x1, x2), F.least(y1, y2), F.greatest(y1, y2)
    return F.struct(
        left.alias("left"), right.alias("right"), bottom.alias("bottom"), top.alias("top"), (right - left).alias("width"), (top - bottom).alias("height"),
        ((right - left) * (top - bottom)).alias("area"), ((left + right) / 2).alias("center_x"), ((bottom + top) / 2).alias("center_y"),
    )


def box_contains(x1: Column, y1: Column, x2: Column, y2: Column, x: Column, y: Column) -> Column:
    """Whether the box holds the point, its edges included."""
    return (x >= F.least(x1, x2)) & (x <= F.greatest(x1, x2)) & (y >= F.least(y1, y2)) & (y <= F.greatest(y1, y2))


def screen_to_world(x: Column, y: Column, width: float, height: float, zoom: float, dx: float, dy: float) -> Column:
    return point((x - width / 2 - dx) / zoom, (y - height / 2 - dy) / zoom)


def world_to_screen(x: Column, y: Column, width: float, height: float, zoom: float, dx: float, dy: float) -> Column:
    return point(x * zoom + width / 2 + dx, y * zoom + height / 2 + dy)


def camera_point(x: Column, y: Column, world: tuple[float, float, float, float], widget: tuple[float, float]) -> Column:
    """World to screen with y turned over, the world kept in proportion in the middle of the widget, and clamped."""
    left, bottom, right, top = world
    width, height = widget
    w, h = right - left, top - bottom
    scale = min(width / w, height / h)
    x0, y0 = (width - w * scale) / 2, (height - h * scale) / 2

    def clamp(v: Column) -> Column:
        return F.greatest(F.lit(-SCREEN_LIMIT), F.least(F.lit(SCREEN_LIMIT), v))

    return point(clamp((x - left) * scale + x0), clamp((top - y) * scale + y0))


def zoomed(left: Column, bottom: Column, right: Column, top: Column, px: Column, py: Column, factor: float) -> Column:
    """The box zoomed in about a point by a factor (out by a factor below 1)."""
    return F.struct(
        (px - (px - left) / factor).alias("left"), (py + (bottom - py) / factor).alias("bottom"), (px + (right - px) / factor).alias("right"), (py - (py - top) / factor).alias("top")
    )


def fitted(left: Column, bottom: Column, right: Column, top: Column, aspect: float) -> Column:
    """The box widened about its centre to an aspect ratio (width by height), so that all of it stays visible."""
    w, h = right - left, top - bottom
    width = F.when(w / aspect >= h, w).otherwise(h * aspect)
    height = F.when(w / aspect >= h, w / aspect).otherwise(h)
    cx, cy = (left + right) / 2, (bottom + top) / 2
    return F.struct((cx - width / 2).alias("left"), (cy - height / 2).alias("bottom"), (cx + width / 2).alias("right"), (cy + height / 2).alias("top"))
