import datetime as dt
import math

from pyspark.sql import functions as F

from terrafold.operators import units
from terrafold.operators.units import Quantity

SEG = "row_id long, max_speed_kph float, max_speed_text string, feed string, edited_at timestamp_ntz, unit_code string"
UNITS = [("kmh", "", 1.0), ("mph", "", 1.609344), ("mps", "", 3.6), ("kn", "", 1.852), ("fps", "", 1.09728), ("dkmh", "", 0.1)]
NOTES = [("a", None), ("b", "Limits are in miles per hour."), ("c", "Edits dated before 1 July 2024 are in miles per hour, later ones in kilometres per hour."), ("d", "Vitesses en mètres par seconde."), ("e", "every figure is ten times the limit in km/h")]


def solve(spark, rows):
    now = dt.datetime(2024, 6, 30)
    full = [(i, s, t, f, e[0] if e else now, "x") for i, (s, t, f, *e) in enumerate(rows)]
    df = units.speed_units(spark.createDataFrame(full, SEG), spark.createDataFrame(NOTES, "feed string, speed_note string"), spark.createDataFrame(UNITS, "unit_code string, unit_name string, kph_factor double"))
    return {r.row_id: (r.unit_code, None if r.speed_kph is None else round(r.speed_kph, 1)) for r in df.collect()}


def test_speeds(spark):
    late = dt.datetime(2024, 7, 1)
    got = solve(
        spark,
        [
            (50.0, "50", "a"), (50.0, "50 km/h", "b"), (30.0, "30 mph", "a"), (48.28, "30 mph", "a"), (48.0, "30mph;50", "b"), (30.0, None, "c"), (30.0, None, "c", late), (30.0, None, "c", None),
            (13.9, "13,9", "d"), (50.0, "５０ km/h", "e"), (500.0, None, "e"), (-1.0, "50", "b"), (None, "50", "b"), (0.0, "50", "b"), (30.0, "walk", "b"), (30.0, "", None), (20.0, "20 kn", "a"),
            (13.41, "30 mph", "zz"), (100.0, "100 (1/10 km/h)", "a"), (10.0, "0", "b"), (44.0, "44 ft/s", "a"),
        ],
    )
    want = ["kmh", "kmh", "mph", "kmh", "kmh", "mph", "kmh", "kmh", "mps", "kmh", "dkmh", None, None, None, "mph", "kmh", "kn", "mps", "dkmh", "mph", "fps"]
    assert [got[i][0] for i in range(len(want))] == want
    assert got[2][1] == 48.3 and got[10][1] == 50.0 and got[11][1] is None


def test_empty(spark):
    assert solve(spark, []) == {}


def test_identity_of_three_columns(spark):
    # mass = density * volume, in kg and kg/m3 and m3
    rows = [(1, 2.0, 1000.0, 0.002), (2, 2000.0, 1.0, 2.0), (3, 0.0, 1.0, 1.0), (4, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, mass double, density double, volume double")
    q = [
        Quantity("mass", F.col("mass"), 1, (("kg", 1.0), ("g", 0.001))),
        Quantity("density", F.col("density"), -1, (("kg/m3", 1.0), ("g/cm3", 1000.0))),
        Quantity("volume", F.col("volume"), -1, (("m3", 1.0), ("l", 0.001))),
    ]
    got = {r.id: r for r in units.resolve_units(df, q).collect()}
    assert (got[1].unit_mass, got[1].unit_density, got[1].unit_volume) in {("kg", "kg/m3", "m3"), ("kg", "g/cm3", "l")}
    assert got[1].unit_unique is False  # two combinations fit alike
    assert got[1].unit_residual < 1e-9 and got[3].unit_mass is None and got[4].unit_unique is None
    one = units.resolve_units(df, [q[0], Quantity("density", F.col("density"), -1, (("kg/m3", 1.0),)), Quantity("volume", F.col("volume"), -1, (("m3", 1.0),))])
    assert [r.unit_unique for r in one.orderBy("id").collect()][:2] == [True, True]
    assert math.isclose(one.orderBy("id").first().unit_residual, 0.0, abs_tol=1e-9)
