"""Pickup and drop-off tours: construction, improvement, legality and cost.

A tour begins and ends at one depot and visits every stop once; a stop where items are dropped comes after all stops
where they are picked up. The search is a greedy tour from each candidate depot and seeded annealing of the best one.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafold.operators.routing import bounded
from terrafold.session import stored

Times = dict[tuple[int, int], float]

START_TEMPERATURE, COOLING = 150.0, 0.99
#: Moves tried by one annealing run, and how many runs start from the greedy tour.
MOVES, SEEDS = 20_000, 8
#: Deliveries above which annealing is worth it, and depots above which only four candidates are tried.
ANNEAL_ABOVE, ALL_DEPOTS = 20, 8


def swap(tour: list[int], i: int, j: int) -> list[int]:
    """Two stops exchanged."""
    out = tour[:]
    out[i], out[j] = out[j], out[i]
    return out


def reverse(tour: list[int], i: int, j: int) -> list[int]:
    """The stops from i to j in reverse."""
    i, j = min(i, j), max(i, j)
    return tour[:i] + tour[i : j + 1][::-1] + tour[j + 1 :]


def move_one(tour: list[int], i: int, j: int) -> list[int]:
    """The stop at i put at place j."""
    out = tour[:i] + tour[i + 1 :]
    out.insert(j, tour[i])
    return out


def shift_window(tour: list[int], i: int, width: int = 4) -> list[int]:
    """The stops of a window moved on by one, the last to its front."""
    w = tour[i : i + width]
    return tour[:i] + w[-1:] + w[:-1] + tour[i + len(w) :]


def cost(tour: Sequence[int], times: Times) -> float:
    return sum(times.get((a, b), math.inf) for a, b in zip(tour, tour[1:], strict=False))


def before(deliveries: Sequence[tuple[int, int]]) -> dict[int, set[int]]:
    """For each stop the pickups that must come first; a pickup at the same stop is no hindrance."""
    need: dict[int, set[int]] = {}
    for p, d in deliveries:
        need.setdefault(p, set())
        need.setdefault(d, set())
        if p != d:
            need[d].add(p)
    return need


def legal(tour: Sequence[int], need: dict[int, set[int]]) -> bool:
    """Whether some visit of every stop comes after all pickups that its drop-offs need, and all stops are visited."""
    seen: set[int] = set()
    served: set[int] = set()
    for stop in tour:
        seen.add(stop)
        if need.get(stop, set()) <= seen:
            served.add(stop)
    return set(need) <= served


def greedy(depot: int, need: dict[int, set[int]], times: Times) -> list[int] | None:
    """From the depot always on to the nearest stop that is allowed, and back; None if one can't be reached.

    Stops that wait for each other's pickups are visited a second time once that is possible.
    """
    tour, seen, served, here = [depot], set(), set(), depot
    pickups = {p for s in need.values() for p in s}
    while len(served) < len(need):
        allowed = [s for s in need if s not in served and need[s] <= seen] or [s for s in need if s in pickups and s not in seen]
        step = min(allowed, key=lambda s: (times.get((here, s), math.inf), s), default=None)
        if step is None or times.get((here, step), math.inf) == math.inf:
            return None
        tour.append(step)
        seen.add(step)
        served |= {step} if need[step] <= seen else set()
        here = step
    tour.append(depot)
    return tour if cost(tour, times) < math.inf else None


def anneal(tour: list[int], need: dict[int, set[int]], times: Times, seed: int, moves: int = MOVES) -> list[int]:
    """The best tour met by annealing: legal moves that shorten are taken, others with probability exp(-longer/T)."""
    rnd = random.Random(seed)
    now = best = tour
    c = best_cost = cost(tour, times)
    t = START_TEMPERATURE
    last = len(tour) - 2
    if last < 2:
        return tour
    for k in range(moves):
        i, j = rnd.randint(1, last), rnd.randint(1, last)
        new = (reverse, move_one, swap)[k % 3](now, i, j)
        n = cost(new, times)
        if n < math.inf and (n < c or rnd.random() < math.exp(-(n - c) / max(t, 1e-9))) and legal(new, need):
            now, c = new, n
            if c < best_cost:
                best, best_cost = now, c
        if k % 20 == 19:
            t *= COOLING
    return best


def tour_costs(tours: DataFrame, times: DataFrame) -> DataFrame:
    """(tour_id, seconds) of tours (tour_id, seq, intersection_id); infinite if a leg has no way."""
    legs = tours.select("tour_id", F.col("intersection_id").alias("from_id"), F.lead("intersection_id").over(Window.partitionBy("tour_id").orderBy("seq")).alias("to_id")).where("to_id IS NOT NULL")
    j = legs.join(times, ["from_id", "to_id"], "left")
    return j.groupBy("tour_id").agg(F.sum(F.coalesce("seconds", F.lit(math.inf))).alias("seconds"))


def tours_legal(tours: DataFrame, deliveries: DataFrame) -> DataFrame:
    """(tour_id, is_legal): every delivery is picked up at some visit not later than the last visit of its drop-off."""
    at = tours.groupBy("tour_id", "intersection_id").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    p = at.select("tour_id", F.col("intersection_id").alias("pick_up"), F.col("first").alias("picked"))
    o = at.select("tour_id", F.col("intersection_id").alias("drop_off"), F.col("last").alias("dropped"))
    n = deliveries.select(F.lit(1).alias("one")).groupBy().agg(F.count("one").alias("n"))
    ok = deliveries.join(p, "pick_up").join(o, ["tour_id", "drop_off"]).where("picked <= dropped").groupBy("tour_id").agg(F.count(F.lit(1)).alias("ok"))
    ids = tours.select("tour_id").distinct().join(F.broadcast(n))  # one row
    return ids.join(ok, "tour_id", "left").select("tour_id", (F.coalesce("ok", F.lit(0)) == F.col("n")).alias("is_legal"))


def _nearest(depots: DataFrame, stops: DataFrame, times: DataFrame, n: int = 2) -> DataFrame:
    """(from_id, seconds): the depots with the least time to any of the stops; of equals the least id."""
    d = depots.select(F.col("intersection_id").alias("from_id"))
    s = stops.select(F.col("intersection_id").alias("to_id"))
    best = times.join(d, "from_id", "left_semi").join(s, "to_id", "left_semi").groupBy("from_id").agg(F.round(F.min("seconds"), 6).alias("seconds"))
    return best.orderBy("seconds", "from_id").limit(n)


def nearest_depots(depots: DataFrame, stops: DataFrame, times: DataFrame, n: int = 2) -> DataFrame:
    """(rank, depot_id, seconds): the depots with the least time to any of the stops; of equals the least id."""
    top = _nearest(depots.select("intersection_id").distinct(), stops.select("intersection_id").distinct(), times, n)
    return top.select(F.row_number().over(Window.orderBy("seconds", "from_id")).alias("rank"), F.col("from_id").alias("depot_id"), "seconds")  # n rows


def _problem(rows: pd.DataFrame) -> tuple[list[tuple[int, int]], Times]:
    d = rows[rows["kind"] == 0]
    t = rows[rows["kind"] == 1]
    return list(zip(d["a"].tolist(), d["b"].tolist(), strict=True)), dict(zip(zip(t["a"].tolist(), t["b"].tolist(), strict=True), t["seconds"].tolist(), strict=True))


TOUR = "job long, depot_id long, seq int, intersection_id long, cost double"
#: (job, depot_id, seed) of a tour to be made.
Job = tuple[int, int, int]


def _run(jobs: Sequence[Job], deliveries: DataFrame, times: DataFrame, annealed: bool) -> DataFrame:
    """A tour for every job, of which there are a few dozen at most: one task each, which the deliveries and times are sent to.

    One vehicle's deliveries and the times between their stops are what a task holds.
    """
    if not jobs:
        return times.sparkSession.createDataFrame([], TOUR)
    given = deliveries.select(F.lit(0).alias("kind"), F.col("pick_up").alias("a"), F.col("drop_off").alias("b"), F.lit(0.0).alias("seconds")).unionAll(times.select(F.lit(1), "from_id", "to_id", "seconds"))
    # literals: a table of the jobs would be planned, broadcast and sent to the tasks once more
    keys = F.array(*(F.struct(*(F.lit(v).cast("long").alias(k) for k, v in zip(("job", "depot_id", "seed"), job, strict=True))) for job in jobs))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pairs, t = _problem(rows)
        need = before(pairs)
        job, depot, seed = map(int, key)
        tour = greedy(depot, need, t)
        if tour is not None and annealed:
            tour = anneal(tour, need, t, seed)
        out = [(job, depot, k, s, cost(tour, t)) for k, s in enumerate(tour)] if tour else []
        return pd.DataFrame(out, columns=["job", "depot_id", "seq", "intersection_id", "cost"])

    return given.select("*", F.explode(keys).alias("j")).select("j.*", *given.columns).groupBy("job", "depot_id", "seed").applyInPandas(run, TOUR)


def candidate_depots(depots: DataFrame, deliveries: DataFrame, times: DataFrame) -> list[int]:
    """All depots if there are at most ALL_DEPOTS, else the two nearest to pickups and to drop-offs."""
    few = depots.limit(ALL_DEPOTS + 1).collect()
    if len(few) <= ALL_DEPOTS:
        return [r.intersection_id for r in few]
    near = [_nearest(depots, deliveries.select(F.col(c).alias("intersection_id")), times) for c in ("pick_up", "drop_off")]
    return sorted({r.from_id for r in near[0].union(near[1]).collect()})  # four at most


def greedy_tours(depots: DataFrame, deliveries: DataFrame, times: DataFrame) -> DataFrame:
    """(depot_id, seq, intersection_id, cost): the greedy tour of each candidate depot; none where it can't be made."""
    return _run(*_first(depots, deliveries, times), False).drop("job")


def _first(depots: DataFrame, deliveries: DataFrame, times: DataFrame) -> tuple[list[Job], DataFrame, DataFrame]:
    """The jobs of the greedy tours, and deliveries and times as tables that are there already: several branches read each, and a plan
    that held how they came about as often would fill the driver."""
    depots, deliveries, times = bounded(depots.select("intersection_id").distinct())[0], bounded(deliveries.select("pick_up", "drop_off"))[0], stored(times)
    return [(d, d, 0) for d in candidate_depots(depots, deliveries, times)], deliveries, times


def best_tour(depots: DataFrame, deliveries: DataFrame, times: DataFrame) -> DataFrame:
    """(depot_id, seq, intersection_id, cost): the cheapest tour found. Above ANNEAL_ABOVE deliveries the best greedy tour is annealed.

    Seeds are fixed, so equal inputs give equal tours; no tour gives no rows.
    """
    jobs, deliveries, times = _first(depots, deliveries, times)
    annealed = len(deliveries.limit(ANNEAL_ABOVE + 1).collect()) > ANNEAL_ABOVE
    tours = _run(jobs, deliveries, times, False)
    if annealed:
        depot = _cheapest(tours)  # all that annealing needs of the greedy tours
        jobs = [] if depot is None else [(depot * 64 + seed, depot, seed) for seed in range(SEEDS)]
        tours = _run(jobs, deliveries, times, True)
    tours = stored(tours)
    job = _cheapest(tours)
    return tours.where(F.lit(False) if job is None else F.col("job") == job).drop("job")


def _cheapest(tours: DataFrame) -> int | None:
    """The job of the cheapest tour, of equals the least; None if there is no tour."""
    first = tours.where("seq = 0").orderBy("cost", "job").limit(1).collect()
    return first[0].job if first else None
