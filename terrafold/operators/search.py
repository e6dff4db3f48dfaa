"""Search by name and by place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrafold.functions import geo, tags
from terrafold.operators import network

# Fixed values: (country, city, file) of the map catalogue; hamilton has the file of the golden horseshoe.
CATALOG = [
    ("china", "beijing", "beijing_china.streets.bin"), ("usa", "boston", "boston_usa.streets.bin"), ("south-africa", "cape-town", "cape-town_south-africa.streets.bin"),
    ("canada", "golden_horseshoe", "golden-horseshoe_canada.streets.bin"), ("canada", "hamilton", "golden-horseshoe_canada.streets.bin"), ("china", "hong-kong", "hong-kong_china.streets.bin"),
    ("iceland", "iceland", "iceland.streets.bin"), ("switzerland", "interlaken", "interlaken_switzerland.streets.bin"), ("ukraine", "kyiv", "kyiv_ukraine.streets.bin"),
    ("england", "london", "london_england.streets.bin"), ("india", "new-delhi", "new-delhi_india.streets.bin"), ("usa", "new-york", "new-york_usa.streets.bin"),
    ("brazil", "rio-de-janeiro", "rio-de-janeiro_brazil.streets.bin"), ("saint-helena", "saint-helena", "saint-helena.streets.bin"), ("singapore", "singapore", "singapore.streets.bin"),
    ("australia", "sydney", "sydney_australia.streets.bin"), ("iran", "tehran", "tehran_iran.streets.bin"), ("japan", "tokyo", "tokyo_japan.streets.bin"), ("canada", "toronto", "toronto_canada.streets.bin"),
]


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOG, "country string, city string, path string")


def cities(spark: SparkSession, country: str) -> DataFrame:
    """(city, path) of a country, spaces and case aside; no rows for an unknown one."""
    return catalog(spark).where(F.col("country") == tags.normalised(F.lit(country))).select("city", "path")


def parse_query(text: str) -> tuple[str, str]:
    """The two street names of a search: words are joined, a word ``&`` parts them."""
    words = text.split()
    at = words.index("&") if "&" in words else len(words)
    return "".join(words[:at]), "".join(words[at + 1 :])


def streets_by_prefix(streets: DataFrame, prefix: str) -> DataFrame:
    """Streets (with norm) whose name begins with the prefix, spaces and case aside; an empty prefix finds none."""
    wanted = "".join(prefix.split(" ")).translate(str.maketrans(tags.UPPER, tags.LOWER))
    s = streets.withColumn("norm", tags.normalised(F.col("street_name")))
    return s.where(F.startswith("norm", F.lit(wanted))) if wanted else s.where(F.lit(False))


def crossings(segments: DataFrame) -> DataFrame:
    """(street_1, street_2, intersection_id) of streets that meet, by an equi-join on the crossing."""
    x = network.street_intersections(segments)
    a, b = x.withColumnRenamed("street_id", "street_1"), x.withColumnRenamed("street_id", "street_2")
    return a.join(b, "intersection_id").where("street_1 < street_2").select("street_1", "street_2", "intersection_id")


def intersections(streets: DataFrame, segments: DataFrame, text: str) -> DataFrame:
    """(intersection_id, name, norm_1, street_1) found by a search text, each displayed name once.

    One street: its crossings with exactly one other street, the searched one named first. Two: crossings of both.
    Streets without a name are left out.
    """
    first, second = parse_query(text)
    x = network.street_intersections(segments)
    known = streets.withColumn("norm", tags.normalised(F.col("street_name")))
    named = x.join(known, "street_id")
    a = named.join(streets_by_prefix(streets, first).select("street_id"), "street_id", "left_semi")
    if second:
        b = named.join(streets_by_prefix(streets, second).select("street_id"), "street_id", "left_semi")
    else:
        ways = x.groupBy("intersection_id").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("intersection_id")
        a, b = a.join(ways, "intersection_id", "left_semi"), named
    a = a.select("intersection_id", F.col("street_id").alias("street_1"), F.col("street_name").alias("name_1"), F.col("norm").alias("norm_1"))
    b = b.select("intersection_id", F.col("street_id").alias("street_2"), F.col("street_name").alias("name_2"), F.col("norm").alias("norm_2"))
    met = a.join(b, "intersection_id").where("street_1 <> street_2 AND name_1 <> '<unknown>' AND name_2 <> '<unknown>'")
    if second:
        met = met.where(~F.contains("name_1", F.lit("&")) & ~F.contains("name_2", F.lit("&")) & (F.col("name_1") != F.col("name_2")))
    met = met.withColumn("name", F.concat_ws(" & ", "name_1", "name_2"))
    best = Window.partitionBy("name").orderBy("norm_1", "street_1", *(["norm_2", "street_2"] if second else []), "intersection_id")
    return met.withColumn("rank", F.row_number().over(best)).where("rank = 1").select("intersection_id", "name", "norm_1", "street_1")


def nearest_named(probes: DataFrame, pois: DataFrame) -> DataFrame:
    """probes (intersection_id, lat, lon, wanted) each with the nearest POI of just that name; of equals the least id, null if none."""
    p = pois.select(F.col("poi_name").alias("wanted"), F.col("poi_id").alias("target_id"), "lat", "lon")
    found = network.nearest(probes.withColumnRenamed("intersection_id", "probe_id"), p, by="wanted")
    return found.select(F.col("probe_id").alias("intersection_id"), F.col("target_id").alias("poi_id"))


def picked(probes: DataFrame, food: DataFrame, shops: DataFrame, crossings_: DataFrame, limit: float = 150.0) -> DataFrame:
    """(probe_id, kind, picked_id): the nearest food place if not beyond the nearest shop and within the limit, else that shop, else the nearest crossing."""
    def near(targets: DataFrame, key: str, name: str) -> DataFrame:
        n = network.nearest(probes, targets.select(F.col(key).alias("target_id"), "lat", "lon"))
        return n.select("probe_id", F.col("target_id").alias(name), F.coalesce("metres", F.lit(float("inf"))).alias(f"{name}_m"))

    j = near(food, "poi_id", "food").join(near(shops, "poi_id", "shop"), "probe_id").join(near(crossings_, "intersection_id", "crossing"), "probe_id")
    eats = (F.col("food_m") <= F.col("shop_m")) & (F.col("food_m") < limit)
    buys = F.col("shop_m") < limit
    return j.select("probe_id", F.when(eats, "food").when(buys, "shop").otherwise("crossing").alias("kind"), F.when(eats, F.col("food")).when(buys, F.col("shop")).otherwise(F.col("crossing")).alias("picked_id"))
