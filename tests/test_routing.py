import math
import random
from pathlib import Path

import pytest

from terrafold.operators import courier, routing
from terrafold.session import local_path

M = "segment_id long, from_id long, to_id long, street_id long, one_way boolean, speed_mps double, seconds double"


def city(seed, n=6):
    r = random.Random(seed)
    rows, k = [], 0
    for y in range(n):
        for x in range(n):
            for dx, dy, street in ((1, 0, y), (0, 1, 100 + x)):
                if x + dx < n and y + dy < n:
                    rows.append((k, y * n + x, (y + dy) * n + x + dx, street, r.random() < 0.2, 0.0 if r.random() < 0.05 else 5.0, r.uniform(5, 50)))
                    k += 1
    return rows


def by_states(rows, source, penalty):
    """Bellman-Ford over directed segments."""
    states = [(s, a, b, st, t) for s, a, b, st, one, v, t in rows if v > 0] + [(s, b, a, st, t) for s, a, b, st, one, v, t in rows if v > 0 and not one]
    cost = {i: t for i, (_, a, _, _, t) in enumerate(states) if a == source}
    for _ in range(len(states)):
        new = dict(cost)
        for i, c in cost.items():
            for j, (_, a, _, st, t) in enumerate(states):
                if a == states[i][2]:
                    n = c + t + (penalty if st != states[i][3] else 0)
                    if n < new.get(j, math.inf) - 1e-12:
                        new[j] = n
        if new == cost:
            break
        cost = new
    best = {source: 0.0}
    for i, c in cost.items():
        if states[i][2] != source:
            best[states[i][2]] = min(c, best.get(states[i][2], math.inf))
    return best


@pytest.mark.parametrize("penalty", [0.0, 30.0])
def test_kernel_and_frontier_agree_with_brute_force(spark, penalty, monkeypatch):
    rows = city(3, 4)
    m = spark.createDataFrame(rows, M)
    src = spark.createDataFrame([(0,), (7,), (999,)], "intersection_id long")
    kernel = {(r.from_id, r.to_id): r.seconds for r in routing.times_from(m, src, penalty).collect()}
    frontier = {(r.from_id, r.to_id): r.seconds for r in routing.frontier_times(routing.directed(m), src, penalty).collect()}
    want = {(s, t): c for s in (0, 7) for t, c in by_states(rows, s, penalty).items()} | {(999, 999): 0.0}
    assert kernel.keys() == frontier.keys() == want.keys()
    assert all(math.isclose(kernel[k], want[k]) and math.isclose(frontier[k], want[k]) for k in want)
    monkeypatch.setattr(routing, "MAX_BROADCAST_STATES", 1)  # too large a graph goes through the frontier
    assert {(r.from_id, r.to_id) for r in routing.times_from(m, src, penalty).collect()} == want.keys()


@pytest.mark.parametrize("broadcast", [True, False])
def test_paths_connect_and_cost_what_they_say(spark, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(routing, "MAX_BROADCAST_STATES", 1)
    rows = city(8)
    m = spark.createDataFrame(rows, M)
    req = spark.createDataFrame([(1, 0, 35), (2, 5, 5), (3, 0, 999), (4, 30, 2)], "request_id long, from_id long, to_id long")
    got = routing.shortest_paths(m, req, 15.0).collect()
    ends = {s: (a, b, st, one, t) for s, a, b, st, one, v, t in rows}
    assert {r.request_id for r in got} == {1, 4}
    for q, a, b in ((1, 0, 35), (4, 30, 2)):
        path = [r.segment_id for r in sorted((r for r in got if r.request_id == q), key=lambda r: r.seq)]
        here, total, street = a, 0.0, None
        for s in path:
            f, t, st, one, sec = ends[s]
            assert here == f or (here == t and not one)
            here = t if here == f else f
            total += sec + (15.0 if street is not None and st != street else 0.0)
            street = st
        assert here == b and math.isclose(total, by_states(rows, a, 15.0)[b])
        assert math.isclose(max(r.seconds for r in got if r.request_id == q), total)


def test_moves():
    t = [0, 1, 2, 3, 4, 5, 0]
    assert courier.swap(t, 1, 3) == [0, 3, 2, 1, 4, 5, 0] and courier.reverse(t, 4, 2) == [0, 1, 4, 3, 2, 5, 0]
    assert courier.move_one(t, 1, 4) == [0, 2, 3, 4, 1, 5, 0] and courier.shift_window(t, 1) == [0, 4, 1, 2, 3, 5, 0]
    assert t == [0, 1, 2, 3, 4, 5, 0]


def tours(spark, n_deliveries, seed=1):
    rows = city(seed, 7)
    m = spark.createDataFrame([(s, a, b, st, False, 5.0, t) for s, a, b, st, one, v, t in rows], M)
    r = random.Random(seed)
    d = [(i, *r.sample(range(5, 49), 2)) for i in range(n_deliveries)]
    stops = sorted({x for _, p, q in d for x in (p, q)} | {0, 1})
    times = routing.times_between(m, spark.createDataFrame([(s,) for s in stops], "intersection_id long"), 15.0)
    return d, times, spark.createDataFrame(d, "delivery_id long, pick_up long, drop_off long"), spark.createDataFrame([(0,), (1,)], "intersection_id long")


def test_no_stop_is_left_out_beyond_the_bound(spark, monkeypatch):
    m = spark.createDataFrame(city(4, 4), M)
    stops = spark.createDataFrame([(s,) for s in (0, 3, 5, 10, 15)], "intersection_id long")
    want = {(r.from_id, r.to_id): round(r.seconds, 6) for r in routing.times_between(m, stops, 15.0).collect()}
    limit = type(stops).limit
    monkeypatch.setattr(type(stops), "limit", lambda df, n: limit(df, min(n, 3) if n in (100_000, 3) else n))
    monkeypatch.setattr(routing, "MAX_TARGETS", 2, raising=False)
    assert {(r.from_id, r.to_id): round(r.seconds, 6) for r in routing.times_between(m, stops, 15.0).collect()} == want


@pytest.mark.parametrize("n", [4, 24])
def test_tours_are_legal_and_annealing_does_not_cost(spark, n):
    d, times, deliveries, depots = tours(spark, n)
    t = {(r.from_id, r.to_id): r.seconds for r in times.collect()}
    greedy = courier.greedy_tours(depots, deliveries, times).collect()
    best = courier.best_tour(depots, deliveries, times).collect()
    need = courier.before([x[1:] for x in d])
    for rows in ([r for r in greedy if r.depot_id == 0], best):
        tour = [r.intersection_id for r in sorted(rows, key=lambda r: r.seq)]
        assert tour[0] == tour[-1] == rows[0].depot_id and courier.legal(tour, need)
        assert math.isclose(courier.cost(tour, t), rows[0].cost)
    assert best[0].cost <= min(r.cost for r in greedy) + 1e-9
    again = courier.best_tour(depots, deliveries, times).collect()
    assert sorted(map(tuple, best)) == sorted(map(tuple, again))


def test_no_way_no_tour(spark):
    times = spark.createDataFrame([(0, 0, 0.0), (0, 1, 5.0)], "from_id long, to_id long, seconds double")
    d = spark.createDataFrame([(1, 1, 2)], "delivery_id long, pick_up long, drop_off long")
    assert courier.best_tour(spark.createDataFrame([(0,)], "intersection_id long"), d, times).count() == 0


def test_stops_that_wait_for_each_other():
    need = courier.before([(1, 2), (2, 1)])
    times = {(a, b): 1.0 for a in range(3) for b in range(3)}
    tour = courier.greedy(0, need, times)
    assert courier.legal(tour, need) and not courier.legal([0, 1, 2, 0], need)


@pytest.mark.parametrize("penalty", [0.0, 30.0])
def test_blocks_agree_with_brute_force(spark, penalty, monkeypatch):
    monkeypatch.setattr(routing, "BLOCK_STATES", 20)
    rows = city(5, 5)
    rows = [(*x[:6], 0.0) if x[0] % 6 == 1 else x for x in rows] + [(900, 24, 77, 5, True, 5.0, 3.0), (901, 60, 0, 6, True, 5.0, 4.0)]  # lengths of 0, ends that nothing leaves or leads to
    m = spark.createDataFrame(rows, M)
    src = spark.createDataFrame([(0,), (12,), (60,), (77,), (999,)], "intersection_id long")
    want = {(s, t): c for s in (0, 12, 60) for t, c in by_states(rows, s, penalty).items()} | {(77, 77): 0.0, (999, 999): 0.0}
    assert len(routing.Blocks(routing.directed(m)).cuts) > 2
    for targets in ((None,), ({0, 12, 60, 77, 999}, {24, 60}))[penalty > 0]:
        got = {(r.from_id, r.to_id): r.seconds for r in routing.frontier_times(routing.directed(m), src, penalty, targets).collect()}
        asked = {k: c for k, c in want.items() if targets is None or k[1] in targets or k[0] == k[1]}
        assert got.keys() == asked.keys() and all(math.isclose(got[k], asked[k], abs_tol=1e-9) for k in asked)


def test_a_long_way_takes_few_rounds_and_no_large_graph_reaches_the_driver(spark, monkeypatch):
    n = routing.MAX_BROADCAST_STATES + 1000
    i = "CAST(id AS LONG)"
    m = spark.range(n).selectExpr(f"{i} AS segment_id", f"{i} AS from_id", f"{i} + 1 AS to_id", "CAST(id % 7 AS LONG) AS street_id", "true AS one_way", "5D AS speed_mps", "1D AS seconds")
    assert n < 250_000 and routing.broadcast_graph(routing.directed(m)) is None
    monkeypatch.setattr(routing, "BLOCK_STATES", 40_000)
    t = routing.times_from(m, spark.range(1).withColumnRenamed("id", "intersection_id"), 0.0)
    assert t.where("seconds = to_id").count() == n + 1


@pytest.mark.parametrize("name", ["sssp", "time_matrix", "shortest_path_segments", "anneal", "greedy_tour", "subpaths", "tour_search", "depots_near", "tour_cost", "shortest_path"])
def test_what_may_reach_the_driver_is_small(spark, sf, monkeypatch, name):
    import __spark_entry__

    asked, limit = [0], type(spark.range(1)).limit
    monkeypatch.setattr(type(spark.range(1)), "limit", lambda df, n: asked.append(n) or limit(df, n))
    assert __spark_entry__.queries()[name](spark, sf).count() > 0
    assert 0 < max(asked) < 250_000


def plans(spark, since):
    """The plans of what ran after the first ``since`` executions, and how many executions there are."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ran = spark._jsparkSession.sharedState().statusStore()
    texts = {x.executionId(): x.physicalPlanDescription() for x in (ran.executionsList().apply(i) for i in range(ran.executionsList().size()))}
    return [t for i, t in texts.items() if i > since and "CreateViewCommand" not in t], max(texts, default=-1)


@pytest.mark.parametrize("name", ["greedy_tour", "time_matrix", "depots_near", "shortest_path", "subpaths", "tour_cost", "tour_search"])
def test_lengths_are_planned_once_and_plans_stay_small(spark, sf, monkeypatch, name):
    import __spark_entry__

    monkeypatch.setattr(routing, "MAX_BROADCAST_STATES", 1)  # as on a large map
    _, since = plans(spark, -1)
    assert __spark_entry__.queries()[name](spark, sf).count() > 0
    ran, _ = plans(spark, since)
    assert sum("p_size" in t for t in ran) == 1  # which only speeds are made of
    assert max(map(len, ran)) < 80_000


@pytest.mark.parametrize("name", ["time_matrix", "shortest_path", "tour_search"])
def test_roads_are_stored_in_steps_of_small_plans(spark, sf, monkeypatch, name):
    import __spark_entry__

    monkeypatch.setattr(routing, "MAX_BROADCAST_STATES", 1)  # as on a large map
    _, since = plans(spark, -1)
    assert __spark_entry__.queries()[name](spark, sf).count() > 0
    ran, _ = plans(spark, since)
    assert max(map(len, ran)) < 45_000


def test_a_tour_plans_little_and_rounds_are_few_files(spark, sf, monkeypatch):
    import __spark_entry__

    monkeypatch.setattr(routing, "MAX_BROADCAST_STATES", 1)  # as on a large map
    monkeypatch.setattr(routing, "BLOCK_STATES", 200)
    folders, new = [], routing.new_folder
    monkeypatch.setattr(routing, "new_folder", lambda s: folders.append(new(s)) or folders[-1])
    _, since = plans(spark, -1)
    assert __spark_entry__.queries()["tour_search"](spark, sf).count() > 0
    ran, _ = plans(spark, since)
    rounds = sorted(Path(local_path(folders[-1])).glob("round=*"))
    assert len(rounds) > 3 and max(len([*r.rglob("*.parquet")]) for r in rounds) <= 6
    assert max(map(len, ran)) < 28_000


def test_directions_of_segments(spark):
    m = spark.createDataFrame([(1, 5, 6, 3, False, 2.0, 4.0), (2, 6, 7, 3, True, 2.0, 4.5), (3, 7, 8, None, None, 2.0, 5.0), (4, 8, 9, 3, False, 0.0, 0.0), (5, 8, 9, 3, False, None, None)], M)
    got = sorted(map(tuple, routing.directed(m).select("state", "segment_id", "a", "b", "street_id", "seconds").collect()))
    assert got == [(2, 1, 5, 6, 3, 4.0), (3, 1, 6, 5, 3, 4.0), (4, 2, 6, 7, 3, 4.5), (6, 3, 7, 8, None, 5.0)]


@pytest.mark.parametrize("bound", [1, 100_000])
def test_searches_share_roads(spark, monkeypatch, bound):
    monkeypatch.setattr(routing, "MAX_BROADCAST_STATES", bound)
    rows = city(9, 4)
    m = spark.createDataFrame(rows, M)
    roads = routing.Roads(m)
    stops = spark.createDataFrame([(0,), (15,)], "intersection_id long")
    times = {(r.from_id, r.to_id): r.seconds for r in routing.times_between(roads, stops, 15.0).collect()}
    assert {k: round(v, 6) for k, v in times.items()} == {(r.from_id, r.to_id): round(r.seconds, 6) for r in routing.times_between(m, stops, 15.0).collect()}
    way = routing.shortest_paths(roads, spark.createDataFrame([(1, 0, 15)], "request_id long, from_id long, to_id long"), 15.0)
    assert math.isclose(max(r.seconds for r in way.collect()), times[0, 15]) and math.isclose(times[0, 15], by_states(rows, 0, 15.0)[15])
