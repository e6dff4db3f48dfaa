"""Raw map entities (nodes, ways, relations with tags) turned into street segments, nodes and points of interest.

nodes: osm_id, lat, lon, tags; ways: osm_id, node_refs, tags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafold.functions import geo, tags


def _highways(ways: DataFrame) -> DataFrame:
    return ways.where(F.try_element_at("tags", F.lit("highway")).isNotNull())


def _placed(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.abs("lat") <= 90) & (F.abs("lon") <= 180))


def street_segments(ways: DataFrame) -> DataFrame:
    """(osm_id, category, max_speed_kph, name, node_refs) of ways with a highway tag and at least two references."""
    t = F.col("tags")
    some = _highways(ways).where(F.size("node_refs") >= 2)
    return some.select(
        "osm_id", tags.highway_category(F.try_element_at(t, F.lit("highway"))).alias("category"), tags.max_speed(F.try_element_at(t, F.lit("maxspeed"))).alias("max_speed_kph"),
        F.coalesce(F.try_element_at(t, F.lit("name")), F.lit("")).alias("name"), "node_refs",
    )


def references(ways: DataFrame) -> DataFrame:
    """(node_id) referenced by any way with a highway tag, those with a single reference included."""
    return _highways(ways).select(F.explode("node_refs").alias("node_id")).where("node_id IS NOT NULL").distinct()


def referenced_nodes(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(osm_id, lat, lon) of placed nodes that ways refer to; repeated ids once."""
    refs = references(ways).withColumnRenamed("node_id", "osm_id")
    pick = F.xxhash64("lat", "lon")
    return _placed(nodes).join(refs, "osm_id", "left_semi").groupBy("osm_id").agg(F.min_by("lat", pick).alias("lat"), F.min_by("lon", pick).alias("lon"))


def points_of_interest(nodes: DataFrame) -> DataFrame:
    """(osm_id, lat, lon, category, name) of placed nodes whose tags make a POI, referenced or not."""
    c = _placed(nodes).withColumn("category", tags.poi_category(F.col("tags"))).where("category IS NOT NULL")
    return c.select("osm_id", "lat", "lon", "category", F.coalesce(F.try_element_at("tags", F.lit("name")), F.lit("")).alias("name"))


def missing_references(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(node_id) that ways refer to but no placed node has."""
    return references(ways).join(_placed(nodes).select(F.col("osm_id").alias("node_id")), "node_id", "left_anti")


def summary(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """One row of counts of a conversion: nodes, segments, POIs and missing references."""
    parts = {"n_nodes": referenced_nodes(nodes, ways), "n_segments": street_segments(ways), "n_pois": points_of_interest(nodes), "n_missing": missing_references(nodes, ways)}
    rows = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("what"))
        rows = one if rows is None else rows.unionAll(one)
    return rows.agg(*(F.sum((F.col("what") == n).cast("long")).alias(n) for n in parts))


def way_lengths(way_refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way_osm_id, length) over consecutive references; steps with a missing node are skipped."""
    p = way_refs.join(nodes, "node_id", "left")
    w = Window.partitionBy("way_osm_id").orderBy("idx")
    step = geo.geo_distance(F.col("lat"), F.col("lon"), F.lead("lat").over(w), F.lead("lon").over(w))
    return p.select("way_osm_id", step.alias("step")).groupBy("way_osm_id").agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"))


def subway_lines(relation_tags: DataFrame, relation_members: DataFrame, way_refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(relation_id, colour, member, idx, lat, lon): points of the ways of subway routes, platforms left out."""
    r = relation_tags.where("route = 'subway'").select("relation_id", "colour")
    m = relation_members.where("member_type = 'way' AND role <> 'platform'").select("relation_id", F.col("idx").alias("member"), F.col("ref").alias("way_osm_id"))
    return r.join(m, "relation_id").join(way_refs, "way_osm_id").join(nodes, "node_id").select("relation_id", "colour", "member", "idx", "lat", "lon")
