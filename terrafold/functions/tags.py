"""Tags, names and classes of map entities, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Codes of highway categories.
HIGHWAY_CODES = {
    "motorway": 1, "motorway_link": 1, "trunk": 2, "trunk_link": 2, "primary": 3, "primary_link": 3, "secondary": 4, "secondary_link": 4, "tertiary": 5, "tertiary_link": 5,
    "residential": 6, "living_street": 6, "service": 7, "track": 8, "footway": 9, "pedestrian": 9, "path": 10, "cycleway": 11,
}
# Names of road types; anything else is "other".
ROAD_TYPES = [
    "bridleway", "cycleway", "footway", "living_street", "motorway", "motorway_link", "path", "pedestrian", "primary", "primary_link", "residential", "road", "secondary",
    "secondary_link", "service", "tertiary", "tertiary_link", "trail", "trunk", "trunk_link", "unclassified",
]
# POI types by class, in the order of their codes.
BASIC = ["hospital", "emergency_room", "bus_station", "school", "pharmacy", "university"]
ENTERTAINMENT = [
    "cafe", "internet_cafe", "juice_bar", "restaurant", "old_restaurant", "fast_food", "food_court", "deli", "bakery", "ice_cream", "pub", "bar", "beer", "nightclub", "Theater",
    "theater", "cinema", "karaoke", "bicycle_rental", "boat_rental", "ice_rinks", "gambling", "casino", "stripclub", "spa", "beauty",
]
SUBORDINATE = ["clinic", "police", "library", "bank", "college", "public_building", "condo", "psychologist", "food_bank", "shelter", "toilets"]
FOOD_END, DRINK_END = 10, 13
# Feature types by code, and their order of painting.
FEATURE_TYPES = ["unknown", "park", "beach", "lake", "river", "island", "building", "greenspace", "golfcourse", "stream", "glacier"]
PAINT_ORDER = ["glacier", "lake", "island", "beach", "river", "stream", "greenspace", "park", "golfcourse", "unknown", "building"]
# Least zoom (exclusive) of road types that are drawn, else 7; and of feature types, else 2.
ROAD_LOD = {
    "motorway": -5, "motorway_link": -5, "trunk": -5, "trunk_link": -5, "primary": 2, "primary_link": 2, "secondary": 3, "secondary_link": 3, "tertiary": 4, "tertiary_link": 4, "road": 4,
    "service": 8, "footway": 9, "path": 9, "bridleway": 9, "trail": 9, "pedestrian": 9, "cycleway": 9, "residential": 7, "living_street": 7,
}
FEATURE_LOD = {"park": 2, "building": 6, "beach": 2, "glacier": 2, "golfcourse": 3, "greenspace": -1, "island": -1, "lake": -5, "river": -1, "stream": 1, "unknown": 4}
# Fixed values: (zoom above which, line width) rules of road types, else (8, 0).
ROAD_WIDTHS = {
    "motorway": [(-5, 2), (3, 3), (7, 8)], "trunk": [(-5, 2), (3, 3), (7, 8)], "primary": [(2, 0), (4, 4), (7, 6)], "secondary": [(4, 0), (6, 3), (8, 5)],
    "tertiary": [(5, 0), (8, 3), (10, 5)], "road": [(5, 0), (8, 3), (10, 5)], "residential": [(6, 0), (8, 3), (10, 5)], "living_street": [(6, 0), (8, 3), (10, 5)],
}
# Fixed values: (light, dark) colours of road types, else the last.
ROAD_COLOURS = {
    "motorway": ("F6CF65", "76A3CD"), "trunk": ("F6CF65", "76A3CD"), "primary": ("F6CF65", "76A3CD"), "secondary": ("AEA4A4", "718598"), "tertiary": ("AEA4A4", "718598"),
    "road": ("000000", "5A6E81"), "footway": ("124429", "5A6E81"), "path": ("124429", "5A6E81"), "bridleway": ("124429", "5A6E81"), "trail": ("124429", "5A6E81"),
    "pedestrian": ("124429", "5A6E81"), "cycleway": ("808080", "5A6E81"), "residential": ("C0C0C0", "718598"), "living_street": ("C0C0C0", "718598"), "": ("AEA4A4", "5A6E81"),
}
# Fixed values: (light, dark, zoom) of feature types.
FEATURE_STYLES = {
    "park": ("B8F4CC", "3C6863", 2), "building": ("D5D8DB", "485E73", 7), "beach": ("F5ECD3", "667E89", 3), "glacier": ("E8E8E8", "708193", 2), "golfcourse": ("60BF8A", "22524D", 3),
    "greenspace": ("B8F4CC", "3C6863", 0), "island": ("99E4BA", "2C5D58", -1), "lake": ("82D8F5", "020E1C", -5), "river": ("82D8F5", "020E1C", -1), "stream": ("82D8F5", "020E1C", 1),
    "unknown": ("E8E8E8", "44515D", 4),
}
# Named line colours, else the last.
LINE_COLOURS = {"yellow": "FF7900", "green": "00923F", "purple": "80276C", "": "CE8E00"}


def lower_ascii(s: Column) -> Column:
    return F.translate(s, UPPER, LOWER)


def normalised(s: Column) -> Column:
    """Names as they are compared: without spaces, A to Z in lower case."""
    return F.translate(s, UPPER + " ", LOWER)


def replaced_first(s: Column, what: str, by: str) -> Column:
    at = F.instr(s, what)
    return F.when(at > 0, F.concat(F.substring(s, F.lit(1), at - 1), F.lit(by), F.substring(s, at + len(what), F.length(s)))).otherwise(s)


def literal_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def highway_category(value: Column) -> Column:
    """0 to 11 from the lower-cased tag; 0 is unknown."""
    return F.coalesce(F.try_element_at(literal_map(HIGHWAY_CODES), F.lower(value)), F.lit(0))


def max_speed(value: Column) -> Column:
    """km/h as a 32-bit float, -1 where there is none; spaces do not count, mph is converted, the leading number is enough."""
    s = F.regexp_replace(value, r"\s+", "")
    mph = (F.length(s) > 3) & (F.lower(F.right(s, F.lit(3))) == "mph")
    number = F.nullif(F.regexp_extract(s, r"^([+-]?(?:\d+\.?\d*|\.\d+))", 1), F.lit("")).cast("float")
    return F.coalesce(F.when(mph, number * F.lit(1.60934).cast("float")).otherwise(number), F.lit(-1.0).cast("float"))


def poi_category(tags: Column) -> Column:
    """key:value of the first tag that makes a POI; null if none does."""
    def tag(k: str) -> Column:
        return F.try_element_at(tags, F.lit(k))

    plain = [F.concat(F.lit(f"{k}:"), tag(k)) for k in ("amenity", "shop", "tourism", "leisure", "railway", "public_transport")]
    stop = F.lower(tag("highway"))
    return F.coalesce(*plain, F.when(stop.isin("bus_stop", "tram_stop", "platform"), F.concat(F.lit("highway:"), stop)), F.concat(F.lit("aeroway:"), tag("aeroway")))


def road_type(value: Column) -> Column:
    return F.when(value.isin(ROAD_TYPES), value).otherwise("other")


def way_use(tags: Column) -> Column:
    """What rails make of a way; tracks go before railway, that before embedded rails."""
    def tag(k: str) -> Column:
        return F.try_element_at(tags, F.lit(k))

    kinds = F.when(tag("railway").isin("tram", "rail", "monorail", "subway"), tag("railway")).when(tag("railway").isNotNull(), "other")
    return F.coalesce(F.when(tag("tracks").isNotNull(), "tracks"), kinds, F.when(tag("embedded_rails").isNotNull() | tag("embedded_rails:lanes").isNotNull(), "tram"), F.lit("notrail"))


def poi_class(kind: Column) -> Column:
    return F.when(kind.isin(SUBORDINATE), "subordinate").when(kind.isin(ENTERTAINMENT), "entertainment").when(kind.isin(BASIC), "basic").otherwise("negligible")


def poi_group(kind: Column) -> Column:
    return F.when(kind.isin(ENTERTAINMENT[:FOOD_END]), "FOOD").when(kind.isin(ENTERTAINMENT[FOOD_END:DRINK_END]), "DRINK").when(kind.isin(ENTERTAINMENT), "ENTERTAINMENT").otherwise("OTHER")


def type_code(kind: Column, names: list[str]) -> Column:
    """Place in a list of types, 0 where it is absent; spaces do not count."""
    at = F.array_position(F.array(*map(F.lit, names)), F.replace(kind, F.lit(" "), F.lit("")))
    return F.greatest(at - 1, F.lit(0)).cast("int")


def colour(text: Column) -> Column:
    """(r, g, b, a) in 0 to 1 of #RRGGBB or a line's colour name."""
    named = literal_map({k: v for k, v in LINE_COLOURS.items() if k})
    code = F.conv(F.when(F.startswith(text, F.lit("#")), F.substring(text, 2, 6)).otherwise(F.coalesce(F.try_element_at(named, text), F.lit(LINE_COLOURS[""]))), 16, 10).cast("int")
    return F.struct(*((F.shiftright(code, s).bitwiseAND(F.lit(255)) / 255.0).alias(c) for c, s in (("r", 16), ("g", 8), ("b", 0))), F.lit(1.0).alias("a"))


def feature_type(code: Column) -> Column:
    return F.get(F.array(*map(F.lit, FEATURE_TYPES)), code.cast("int"))
