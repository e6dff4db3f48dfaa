"""Polygon features: rings, areas, boxes and the order of painting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafold.functions import geo, tags


def rings(feature_points: DataFrame) -> DataFrame:
    """(feature_id, n_points, is_closed): closed if the first point equals the last and there is more than one."""
    a = feature_points.groupBy("feature_id").agg(
        F.count(F.lit(1)).alias("n_points"), F.min_by("lat", "idx").alias("lat1"), F.max_by("lat", "idx").alias("lat2"), F.min_by("lon", "idx").alias("lon1"), F.max_by("lon", "idx").alias("lon2")
    )
    return a.select("feature_id", "n_points", ((F.col("n_points") > 1) & (F.col("lat1") == F.col("lat2")) & (F.col("lon1") == F.col("lon2"))).alias("is_closed"))


def areas(features: DataFrame, feature_points: DataFrame) -> DataFrame:
    """(feature_id, area) in square metres; 0 for features that are not closed.

    The projection is about the mean latitude of all points of the feature, the repeated last one included.
    """
    whole = Window.partitionBy("feature_id")
    order = whole.orderBy("idx")
    pts = feature_points.withColumn("mean_lat", F.avg(F.radians("lat")).over(whole))
    pts = pts.withColumns({"x": geo.lon_to_x(F.col("lon"), F.col("mean_lat")), "y": geo.lat_to_y(F.col("lat"))})
    pts = pts.withColumns({"x2": F.lead("x").over(order), "y2": F.lead("y").over(order)})
    twice = pts.groupBy("feature_id").agg(F.abs(F.sum((F.col("y") + F.col("y2")) * (F.col("x") - F.col("x2")))).alias("twice"))
    df = features.select("feature_id").join(rings(feature_points), "feature_id", "left").join(twice, "feature_id", "left")
    return df.select("feature_id", F.when(F.col("is_closed"), F.coalesce(F.col("twice") / 2, F.lit(0.0))).otherwise(0.0).alias("area"))


def boxes(feature_points: DataFrame) -> DataFrame:
    """(feature_id, min_lat, max_lat, min_lon, max_lon)."""
    return feature_points.groupBy("feature_id").agg(F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"))


def painted(features: DataFrame) -> DataFrame:
    """Features with their type and its place in the order of painting."""
    kind = tags.feature_type(F.col("feature_type_code"))
    return features.withColumn("feature_type", kind).withColumn("paint_rank", F.array_position(F.array(*map(F.lit, tags.PAINT_ORDER)), F.col("feature_type")).cast("int"))
