"""Routing and courier queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.operators import courier, network, routing
from terrafold.plans.network_queries import _LENGTHS
from terrafold.plans.registry import Registry
from terrafold.plans.scalar_queries import _r
from terrafold.session import checkpointed, stored
from terrafold.sources.fixtures import view

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

PENALTY, TOUR_PENALTY = 30.0, 15.0


def _search(sources: str, penalty: float) -> str:
    """Cheapest cost of every directed segment from each source, as recursive SQL keyed by state."""
    return f"""{_LENGTHS},
e AS MATERIALIZED (SELECT segment_id, from_id AS a, to_id AS b, street_id, seconds AS t FROM m WHERE speed_mps > 0 UNION ALL SELECT segment_id, to_id, from_id, street_id, seconds FROM m WHERE speed_mps > 0 AND NOT one_way),
q AS MATERIALIZED ({sources}),
sp(src, segment_id, node, street_id, cost) USING KEY (src, segment_id, node) AS (
  SELECT q.src, e.segment_id, e.b, e.street_id, e.t FROM q JOIN e ON e.a = q.src
  UNION
  SELECT x.src, x.segment_id, x.node, x.street_id, x.cost FROM (
    SELECT s.src, e.segment_id, e.b AS node, e.street_id, min(s.cost + e.t + CASE WHEN e.street_id <> s.street_id THEN CAST({penalty} AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END) AS cost
    FROM sp s JOIN e ON e.a = s.node GROUP BY ALL) x
  LEFT JOIN recurring.sp k ON k.src = x.src AND k.segment_id = x.segment_id AND k.node = x.node WHERE k.cost IS NULL OR x.cost < k.cost - 1e-9),
tm AS (SELECT src AS from_id, node AS to_id, min(cost) AS seconds FROM sp WHERE src <> node GROUP BY 1, 2 UNION ALL SELECT src, src, 0.0 FROM q)"""


_STOPS = "SELECT intersection_id AS src FROM depots UNION SELECT pick_up FROM deliveries UNION SELECT drop_off FROM deliveries"
_MATRIX = f"WITH RECURSIVE {_search(_STOPS, TOUR_PENALTY)}, mx AS (SELECT tm.* FROM tm SEMI JOIN q ON q.src = tm.to_id)"


def _roads(spark: SparkSession, d: str) -> routing.Roads:
    """Stored in steps: Spark plans anew after every exchange, so that a plan's cost to the driver grows with its square."""
    given = {"segments": stored(view(spark, d, "segments").drop("way_osm_id"))}
    given["curve_points"] = stored(view(spark, d, "curve_points", given))
    return routing.Roads(network.segment_metrics(given["segments"], view(spark, d, "intersections"), given["curve_points"]))


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    return _times(_roads(spark, d), view(spark, d, "depots"), view(spark, d, "deliveries"))


def _times(roads: routing.Roads, depots: DataFrame, deliveries: DataFrame) -> DataFrame:
    stops = depots.select("intersection_id").union(deliveries.select("pick_up")).union(deliveries.select("drop_off"))
    return routing.times_between(roads, stops, TOUR_PENALTY)


@R.add(f"WITH RECURSIVE {_search('SELECT 0 AS src', 0.0)} SELECT to_id AS intersection_id, round(seconds, 5) AS seconds FROM tm")
def sssp(spark: SparkSession, d: str) -> DataFrame:
    t = routing.times_from(_roads(spark, d), spark.range(1).withColumnRenamed("id", "intersection_id"), 0.0)
    return t.select(F.col("to_id").alias("intersection_id"), _r("seconds", 5).alias("seconds"))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "deliveries").select(F.col("delivery_id").alias("request_id"), F.col("pick_up").alias("from_id"), F.col("drop_off").alias("to_id"))


@R.add(f"""WITH RECURSIVE {_search('SELECT DISTINCT pick_up AS src FROM deliveries', PENALTY)}
SELECT x.delivery_id AS request_id, round(tm.seconds, 5) AS seconds FROM deliveries x JOIN tm ON tm.from_id = x.pick_up AND tm.to_id = x.drop_off WHERE x.pick_up <> x.drop_off""")
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    """The time of a fastest way for each request."""
    return routing.shortest_paths(_roads(spark, d), _requests(spark, d), PENALTY).groupBy("request_id").agg(_r(F.max("seconds"), 5).alias("seconds"))


@R.add()
def shortest_path_segments(spark: SparkSession, d: str) -> DataFrame:
    """The ways themselves, which need not be the only fastest ones."""
    return routing.shortest_paths(_roads(spark, d), _requests(spark, d), PENALTY).select("request_id", "seq", "segment_id")


@R.add(f"{_MATRIX} SELECT from_id, to_id, round(seconds, 5) AS seconds FROM mx")
def time_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d).select("from_id", "to_id", _r("seconds", 5).alias("seconds"))


@R.add(f"""{_MATRIX}, lg AS (SELECT tour_id, intersection_id AS a, lead(intersection_id) OVER (PARTITION BY tour_id ORDER BY seq) AS b FROM tours)
SELECT tour_id, round(sum(mx.seconds), 4) AS seconds FROM lg JOIN mx ON mx.from_id = lg.a AND mx.to_id = lg.b GROUP BY 1""")
def tour_cost(spark: SparkSession, d: str) -> DataFrame:
    return courier.tour_costs(stored(view(spark, d, "tours")), stored(_matrix(spark, d))).select("tour_id", _r("seconds", 4).alias("seconds"))


@R.add("""WITH vis AS (SELECT tour_id, intersection_id, min(seq) AS f, max(seq) AS l FROM tours GROUP BY 1, 2),
k AS (SELECT p.tour_id, count(*) AS n FROM deliveries x JOIN vis p ON p.intersection_id = x.pick_up JOIN vis o ON o.intersection_id = x.drop_off AND o.tour_id = p.tour_id WHERE p.f <= o.l GROUP BY 1)
SELECT t.tour_id, coalesce(k.n, 0) = (SELECT count(*) FROM deliveries) AS is_legal FROM (SELECT DISTINCT tour_id FROM tours) t LEFT JOIN k USING (tour_id)""")
def tour_legal(spark: SparkSession, d: str) -> DataFrame:
    return courier.tours_legal(view(spark, d, "tours"), view(spark, d, "deliveries"))


@R.add(f"""{_MATRIX}, b AS (SELECT kind, from_id, round(min(seconds), 6) AS s FROM (SELECT 'pick_up' AS kind, mx.* FROM mx WHERE to_id IN (SELECT pick_up FROM deliveries) UNION ALL SELECT 'drop_off', mx.* FROM mx WHERE to_id IN (SELECT drop_off FROM deliveries))
  WHERE from_id IN (SELECT intersection_id FROM depots) GROUP BY 1, 2),
r AS (SELECT kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY s, from_id) AS INT) AS rank, from_id AS depot_id, round(s, 5) AS seconds FROM b) SELECT * FROM r WHERE rank <= 2""")
def depots_near(spark: SparkSession, d: str) -> DataFrame:
    x, t, depots = (stored(df) for df in (view(spark, d, "deliveries"), _matrix(spark, d), view(spark, d, "depots")))  # each read twice
    near = [courier.nearest_depots(depots, x.select(F.col(c).alias("intersection_id")), t).withColumn("kind", F.lit(c)) for c in ("pick_up", "drop_off")]
    return near[0].unionByName(near[1]).select("kind", "rank", "depot_id", _r("seconds", 5).alias("seconds"))


def _free_depots(spark: SparkSession, d: str) -> DataFrame:
    """Depots that are not stops."""
    return _free(view(spark, d, "depots"), view(spark, d, "deliveries"))


def _free(depots: DataFrame, deliveries: DataFrame) -> DataFrame:
    return depots.join(deliveries.select(F.explode(F.array("pick_up", "drop_off")).alias("intersection_id")), "intersection_id", "left_anti")


@R.add()
def greedy_tour(spark: SparkSession, d: str) -> DataFrame:
    return courier.greedy_tours(_free_depots(spark, d), view(spark, d, "deliveries"), _matrix(spark, d))


@R.add()
def tour_search(spark: SparkSession, d: str) -> DataFrame:
    return _tour(spark, d)


def _tour(spark: SparkSession, d: str, roads: routing.Roads | None = None) -> DataFrame:
    depots, deliveries = (routing.bounded(view(spark, d, name))[0] for name in ("depots", "deliveries"))  # read by the times and by the tours
    return courier.best_tour(_free(depots, deliveries), deliveries, _times(roads or _roads(spark, d), depots, deliveries))


@R.add()
def subpaths(spark: SparkSession, d: str) -> DataFrame:
    """The legs of the best tour with their segments in order."""
    roads = _roads(spark, d)  # for the times and for the ways
    tour = _tour(spark, d, roads).select("seq", "intersection_id")
    from pyspark.sql import Window

    legs = tour.select(F.col("seq").cast("long").alias("request_id"), F.col("intersection_id").alias("from_id"), F.lead("intersection_id").over(Window.orderBy("seq")).alias("to_id")).where("to_id IS NOT NULL")  # one tour
    legs = stored(legs)
    way = routing.shortest_paths(roads, legs, TOUR_PENALTY).groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "segment_id"))), lambda s: s.segment_id).alias("segments"))
    return legs.join(way, "request_id", "left").select(F.col("request_id").alias("leg"), "from_id", "to_id", "segments")


@R.add()
def anneal(spark: SparkSession, d: str) -> DataFrame:
    """What annealing saves on the best greedy tour."""
    depots, deliveries, times = _free_depots(spark, d), view(spark, d, "deliveries"), checkpointed(_matrix(spark, d))
    g = courier.greedy_tours(depots, deliveries, times).where("seq = 0").agg(F.min("cost").alias("greedy_cost"))
    return courier.best_tour(depots, deliveries, times).where("seq = 0").select("depot_id", F.col("cost").alias("annealed_cost")).join(F.broadcast(g))  # one row each


_MOVED = """WITH l AS (SELECT tour_id, list(intersection_id ORDER BY seq) AS t FROM tours GROUP BY 1),
m AS (SELECT tour_id, 'swap' AS move, t[:2] || [t[7]] || t[4:6] || [t[3]] || t[8:] AS t FROM l UNION ALL SELECT tour_id, 'reverse', t[:2] || list_reverse(t[3:7]) || t[8:] FROM l
  UNION ALL SELECT tour_id, 'move_one', t[:2] || t[4:7] || [t[3]] || t[8:] FROM l UNION ALL SELECT tour_id, 'shift_window', t[:2] || [t[6]] || t[3:5] || t[7:] FROM l)"""


@R.add(_MOVED + " SELECT tour_id, move, array_to_string(t, ',') AS stops FROM m")
def moves(spark: SparkSession, d: str) -> DataFrame:
    """Each move of the tour search once on every tour."""
    import pandas as pd

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        t = rows.sort_values("seq")["intersection_id"].tolist()
        made = {"swap": courier.swap(t, 2, 6), "reverse": courier.reverse(t, 2, 6), "move_one": courier.move_one(t, 2, 6), "shift_window": courier.shift_window(t, 2)}
        return pd.DataFrame([(int(key[0]), k, ",".join(map(str, v))) for k, v in made.items()], columns=["tour_id", "move", "stops"])

    return view(spark, d, "tours").select(F.col("tour_id").cast("long").alias("tour_id"), "seq", "intersection_id").groupBy("tour_id").applyInPandas(run, "tour_id long, move string, stops string")
