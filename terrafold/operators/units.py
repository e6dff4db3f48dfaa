"""Quantities recorded in different units, resolved through identities among columns.

An identity says that the product of some quantities, each raised to a known power, is 1 once all are in common units
(mass = density x volume: exponents 1, -1, -1). In logarithms it is a sum, so every choice of units leaves a residual;
the choice with the smallest one is taken, and choices that come as close as rounding allows are flagged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions.units import first_number, named_unit, plain, text_unit


@dataclass(frozen=True)
class Quantity:
    """One factor of an identity: a positive column, its exponent, and the units it may be in as (code, factor to common)."""

    name: str
    value: Column
    exponent: float
    units: tuple[tuple[str, float], ...]


def resolve_units(df: DataFrame, quantities: list[Quantity], rounding: Column | None = None, prefix: str = "unit_") -> DataFrame:
    """``df`` with, per quantity, ``<prefix><name>``, and ``<prefix>residual``, ``<prefix>unique``.

    The combinations of units are a product of short fixed lists and are tried inside one expression, row by row, so
    there is no shuffle. ``rounding`` is the relative error that recording may have caused (default 0.005): a solution
    is unique if every other one leaves a residual that is larger by more than it. Rows where a quantity is null or not
    positive get nulls. Ties go to the combination listed first.
    """
    rounding = F.lit(0.005) if rounding is None else rounding
    total = sum((F.log(q.value.cast("double")) * q.exponent for q in quantities), F.lit(0.0))
    usable = F.lit(True)
    for q in quantities:
        usable = usable & F.coalesce(q.value > 0, F.lit(False))
    choices = list(product(*(q.units for q in quantities)))
    offsets = [sum(q.exponent * math.log(u[1]) for q, u in zip(quantities, c, strict=True)) for c in choices]
    tried = F.array(*(F.struct(F.abs(F.col("__total") + F.lit(o)).alias("residual"), F.lit(i).alias("i")) for i, o in enumerate(offsets)))
    ranked = df.withColumn("__total", F.when(usable, total)).withColumn("__ranked", F.when(F.col("__total").isNotNull(), F.array_sort(tried)))
    best = F.col("__ranked")[0]
    out = ranked
    for k, q in enumerate(quantities):
        codes = F.array(*(F.lit(c[k][0]) for c in choices))
        out = out.withColumn(prefix + q.name, F.when(best.isNotNull(), F.get(codes, best["i"])))
    unique = (F.col("__ranked")[1]["residual"] - best["residual"] > rounding) if len(choices) > 1 else F.lit(True)
    return out.withColumns({prefix + "residual": best["residual"], prefix + "unique": F.when(best.isNotNull(), unique)}).drop("__total", "__ranked")


def feed_units(feeds: DataFrame) -> DataFrame:
    """(feed, early_unit, late_unit, changed_on) from what each feed says of its speeds.

    Without a date both units are the one the note names, km/h if it names none. A note such as "before 1 July 2024 are
    in ..., later ones in ..." gives the unit on either side of the date. One row a feed; of repeated feeds the
    greatest note counts.
    """
    note = plain(F.col("speed_note"))
    dated = F.regexp_extract(note, r"before (\d{1,2} \p{L}+ \d{4})", 1)
    early = F.regexp_extract(note, r"before \d{1,2} \p{L}+ \d{4}([^,.;]*)", 1)
    late = F.regexp_extract(note, r"before \d{1,2} \p{L}+ \d{4}[^,.;]*(.*)$", 1)
    return (
        feeds.groupBy("feed")
        .agg(F.max("speed_note").alias("speed_note"))
        .select(
            "feed",
            F.coalesce(F.when(dated != "", named_unit(early)), named_unit(note), F.lit("kmh")).alias("early_unit"),
            F.coalesce(F.when(dated != "", named_unit(late)), named_unit(note), F.lit("kmh")).alias("late_unit"),
            F.to_date(F.nullif(F.initcap(dated), F.lit("")), "d MMMM yyyy").cast("timestamp_ntz").alias("changed_on"),
        )
    )


def speed_units(segments: DataFrame, feeds: DataFrame, units: DataFrame) -> DataFrame:
    """Segments' row_id with posted limit, the unit of the stored number, the speed in km/h and how sure that is.

    The posted limit is the first number of max_speed_text in the unit the text names, else in the feed's unit at
    edited_at; without a number it is the stored number in the feed's unit. The identity is stored x unit = posted x
    unit, the posted one's unit being known. Rows whose stored number is null or not above 0 come out with nulls.
    ``units`` (fixed, 6 rows in TESTDATA) is configuration: its factors become part of the expression, whole, however
    many they are. Feeds (fixed, 12 rows) are joined. Of a code with several factors the least counts.
    """
    factors = units.select("unit_code", "kph_factor").dropna().where("kph_factor > 0").groupBy("unit_code").agg(F.min("kph_factor").alias("kph_factor"))
    known = sorted((r.unit_code, float(r.kph_factor)) for r in factors.collect())
    factor = F.create_map(*(x for code, f in known for x in (F.lit(code), F.lit(f)))) if known else F.lit(None).cast("map<string,double>")
    says = feed_units(feeds)
    # texts repeat a lot: each is read once
    text = plain(F.col("max_speed_text"))
    texts = segments.select("max_speed_text").where("max_speed_text IS NOT NULL").distinct()
    texts = texts.select(F.col("max_speed_text").alias("read_text"), first_number(text).alias("number"), text_unit(text).alias("named"))
    rows = segments.select("row_id", "feed", F.col("max_speed_kph").cast("double").alias("stored"), "max_speed_text", F.col("edited_at").cast("timestamp_ntz").alias("edited_at"))
    rows = rows.join(says.withColumnRenamed("feed", "said_feed"), F.col("feed") == F.col("said_feed"), "left")
    rows = rows.join(texts, F.col("max_speed_text") == F.col("read_text"), "left")
    of_feed = F.coalesce(F.when(F.col("edited_at") < F.col("changed_on"), F.col("early_unit")).otherwise(F.col("late_unit")), F.lit("kmh"))
    has = F.col("number") > 0
    rows = rows.withColumns(
        {
            "posted": F.when(F.coalesce(has, F.lit(False)), F.col("number")).otherwise(F.col("stored")),
            "posted_unit": F.when(F.coalesce(has, F.lit(False)), F.coalesce("named", of_feed)).otherwise(of_feed),
        }
    )
    rows = rows.withColumn("posted_kph", F.col("posted") * F.try_element_at(factor, F.col("posted_unit")))
    solved = resolve_units(
        rows,
        [Quantity("stored", F.col("stored"), 1.0, tuple(known) or (("kmh", 1.0),)), Quantity("posted", F.col("posted_kph"), -1.0, (("kmh", 1.0),))],
        rounding=F.greatest(F.lit(0.002), F.try_divide(F.lit(0.05), F.col("stored"))),
    )
    positive = F.col("stored") > 0
    return solved.select(
        "row_id",
        "feed",
        F.when(positive, F.col("posted")).alias("posted"),
        F.when(positive, F.col("posted_unit")).alias("posted_unit"),
        F.when(positive, F.col("unit_stored")).alias("unit_code"),
        F.when(positive, F.col("stored") * F.try_element_at(factor, F.col("unit_stored"))).alias("speed_kph"),
        F.when(positive, F.col("unit_residual")).alias("residual"),
        F.when(positive, F.col("unit_unique")).alias("is_unique"),
    )
