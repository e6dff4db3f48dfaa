"""Shortest paths with turn penalties.

The cost of a step depends on the street that it is reached by, so the search runs over directed segments: a state is a
segment and the end it leads to. Two ways to the same result: a label-setting kernel over a broadcast graph, one task a
source, for graphs up to a checked size; and for any size the same kernel within blocks of the graph, each in a task, which
send each other the labels of segments that cross from block to block, until none improves.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from terrafold.session import new_folder, stored

#: Directed segments up to which the graph passes through the driver and is broadcast.
MAX_BROADCAST_STATES = 100_000
#: Directed segments of a block, about, which a task holds.
BLOCK_STATES = 250_000
#: Tasks that share the sources of a block.
SOURCE_GROUPS = 8
#: Stops up to which every task holds them all; beyond, their times come from the search by blocks, which then has no early end.
MAX_TARGETS = 100_000
#: (node, street, seconds, steps) that a search starts with; no street: no turn into the first segment.
Seed = tuple[int, int | None, float, int]


def directed(metrics: DataFrame) -> DataFrame:
    """(state, segment_id, a, b, street_id, seconds): usable directions of segments; speed 0 makes one impassable."""

    def way(state: Column, a: str, b: str) -> Column:
        return F.struct(state.alias("state"), F.col(a).alias("a"), F.col(b).alias("b"))

    on, back = way(F.col("segment_id") * 2, "from_id", "to_id"), way(F.col("segment_id") * 2 + 1, "to_id", "from_id")
    # not a union, whose plan would hold twice how the lengths come about
    ways = F.explode(F.when(~F.col("one_way"), F.array(on, back)).otherwise(F.array(on))).alias("w")
    return metrics.where("speed_mps > 0").select("segment_id", "street_id", "seconds", ways).select("w.state", "segment_id", "w.a", "w.b", "street_id", "seconds")


class Graph:
    """Directed segments in arrays, grouped by the node they leave. others: nodes besides those of segments."""

    def __init__(self, rows: pd.DataFrame, others: Sequence[int] = ()):
        rows = rows.sort_values(["a", "state"], kind="stable").reset_index(drop=True)
        nodes = np.unique(np.r_[rows["a"].to_numpy(np.int64), rows["b"].to_numpy(np.int64), np.asarray(others, np.int64)])
        self.nodes = nodes
        a = np.searchsorted(nodes, rows["a"])
        self.first = np.searchsorted(a, np.arange(len(nodes) + 1)).tolist()
        self.end = np.searchsorted(nodes, rows["b"]).tolist()
        self.state, self.segment, self.street, self.seconds = (rows[c].tolist() for c in ("state", "segment_id", "street_id", "seconds"))

    def at(self, node: int) -> int | None:
        i = int(np.searchsorted(self.nodes, node))
        return i if i < len(self.nodes) and self.nodes[i] == node else None

    def search(self, source: int, penalty: float, targets: set[int] | None = None) -> tuple[dict[int, tuple[float, int]], list[int]]:
        """Best (seconds, state) of every node reached, until all targets are, and the state before each state."""
        start = self.at(source)
        if start is None:
            return {}, []
        wanted = None if targets is None else {i for i in map(self.at, targets) if i is not None}
        best, _, _, before, _ = self.labels([(start, None, 0.0, 0)], penalty, wanted)
        return best, before

    def labels(self, seeds: Sequence[Seed], penalty: float, wanted: set[int] | None = None, bound: float = math.inf) -> tuple[dict[int, tuple[float, int]], list[float], list[int], list[int], float]:
        """Best (seconds, state) of every node reached, until all wanted are or bound is passed; of states the seconds, steps and
        state before; and the seconds up to which labels are final. Nodes are given by place, seed k stands for a state as -1 - k.

        Of ways of equal time that of fewer steps counts, so every step adds and none can lead back to itself.
        """
        best: dict[int, tuple[float, int]] = {}
        cost, steps, before = [math.inf] * len(self.end), [0] * len(self.end), [-1] * len(self.end)
        first, end, seconds, streets = self.first, self.end, self.seconds, self.street
        heap = [(c, h, -1 - k) for k, (_, _, c, h) in enumerate(seeds)]
        heapq.heapify(heap)
        left = None if wanted is None else set(wanted)
        final = bound
        while heap and (left is None or left):
            c, h, s = heapq.heappop(heap)
            if c > bound:
                break
            if s < 0:
                node, street = seeds[-1 - s][:2]
            elif c != cost[s] or h != steps[s]:
                continue
            else:
                node, street = end[s], streets[s]
            if node not in best:
                best[node] = (c, s)
                if left is not None:
                    left.discard(node)
                    final = bound if left else c
            h += 1
            for t in range(first[node], first[node + 1]):
                n = c + seconds[t] + (penalty if street is not None and streets[t] != street else 0.0)
                if n < cost[t] or (n == cost[t] and h < steps[t]):
                    cost[t], steps[t], before[t] = n, h, s
                    heapq.heappush(heap, (n, h, t))
        return best, cost, steps, before, final


def broadcast_graph(states: DataFrame):
    """The graph as a broadcast variable; None if it has more than MAX_BROADCAST_STATES directed segments, of which no more come here."""
    rows = states.limit(MAX_BROADCAST_STATES + 1).toArrow()  # a checked bound, and no objects of rows
    if len(rows) > MAX_BROADCAST_STATES:
        return None
    return states.sparkSession.sparkContext.broadcast(Graph(rows.to_pandas()))


class Roads:
    """The directed segments of a map, computed once and stored. Searches that are given the same Roads share its graph or its blocks.

    What every search plans is then the reading of a table, and not again the lengths of all segments.
    """

    def __init__(self, metrics: DataFrame):
        self.states = stored(directed(metrics))

    @staticmethod
    def of(metrics: DataFrame | Roads) -> Roads:
        return metrics if isinstance(metrics, Roads) else Roads(metrics)

    @cached_property
    def n(self) -> int:
        return self.states.count()

    @cached_property
    def graph(self):
        return broadcast_graph(self.states) if self.n <= MAX_BROADCAST_STATES else None

    @cached_property
    def blocks(self) -> Blocks:
        return Blocks(self.states, self.n)


def _per_source(requests: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, key: str) -> DataFrame:
    return requests.repartition(key).mapInPandas(run, schema)


def bounded(df: DataFrame) -> tuple[DataFrame, list[Row] | None]:
    """``df`` as a table to be read several times, made of its rows if these are at most MAX_TARGETS, else stored; and the rows if so."""
    rows = df.limit(MAX_TARGETS + 1).collect()  # a checked bound
    if len(rows) > MAX_TARGETS:
        return stored(df), None
    table = pa.Table.from_pydict({c: [r[c] for r in rows] for c in df.columns}, schema=to_arrow_schema(df.schema))
    return df.sparkSession.createDataFrame(table, df.schema), rows  # of Arrow, which is a local table in plans


def times_between(metrics: DataFrame | Roads, stops: DataFrame, penalty: float) -> DataFrame:
    """(from_id, to_id, seconds) between all stops (intersection_id); 0 on the diagonal, no row where there is no way."""
    roads = Roads.of(metrics)
    graph = roads.graph
    stops, rows = bounded(stops.select("intersection_id").distinct())
    if graph is None or rows is None:
        far = frontier_times(roads.blocks, stops, penalty, None if rows is None else {r.intersection_id for r in rows})
        to = stops.withColumnRenamed("intersection_id", "to_id")
        return far.join(to, "to_id").select("from_id", "to_id", "seconds")
    wanted = sorted(r.intersection_id for r in rows)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = graph.value
        for f in frames:
            for source in f["intersection_id"]:
                best, _ = g.search(int(source), penalty, set(wanted))
                found = [(int(source), t, 0.0 if t == source else best[g.at(t)][0]) for t in wanted if t == source or (g.at(t) is not None and g.at(t) in best)]
                yield pd.DataFrame(found, columns=["from_id", "to_id", "seconds"])

    return _per_source(stops, run, "from_id long, to_id long, seconds double", "intersection_id")


def times_from(metrics: DataFrame | Roads, sources: DataFrame, penalty: float) -> DataFrame:
    """(from_id, to_id, seconds) from each source (intersection_id) to every intersection it reaches, itself at 0."""
    roads = Roads.of(metrics)
    graph = roads.graph
    if graph is None:
        return frontier_times(roads.blocks, sources, penalty)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = graph.value
        for f in frames:
            for source in f["intersection_id"]:
                best, _ = g.search(int(source), penalty)
                if not best:
                    best = {}
                    yield pd.DataFrame({"from_id": [int(source)], "to_id": [int(source)], "seconds": [0.0]})
                    continue
                at = np.fromiter(best, np.int64, len(best))
                yield pd.DataFrame({"from_id": int(source), "to_id": g.nodes[at], "seconds": [c for c, _ in best.values()]})

    return _per_source(sources.select("intersection_id").distinct(), run, "from_id long, to_id long, seconds double", "intersection_id")


def shortest_paths(metrics: DataFrame | Roads, requests: DataFrame, penalty: float) -> DataFrame:
    """(request_id, seq, segment_id, seconds): the segments of a fastest way for requests (request_id, from_id, to_id).

    seconds is the time from the start to the end of the segment, turns included; the first segment takes no penalty.
    Requests from a place to itself, and those without a way, have no rows.
    """
    roads = Roads.of(metrics)
    graph = roads.graph
    if graph is None:
        return frontier_paths(roads.blocks, requests, penalty)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = graph.value
        for f in frames:
            for request, a, b in zip(f["request_id"], f["from_id"], f["to_id"], strict=True):
                best, before = g.search(int(a), penalty, {int(b)})
                at = g.at(int(b))
                if a == b or at is None or at not in best:
                    continue
                path = []
                s = best[at][1]
                while s >= 0:
                    path.append(s)
                    s = before[s]
                path.reverse()
                total, street, rows = 0.0, None, []
                for k, s in enumerate(path):
                    total += g.seconds[s] + (penalty if street is not None and g.street[s] != street else 0.0)
                    street = g.street[s]
                    rows.append((int(request), k, g.segment[s], total))
                yield pd.DataFrame(rows, columns=["request_id", "seq", "segment_id", "seconds"])

    return _per_source(requests.select("request_id", "from_id", "to_id"), run, "request_id long, seq int, segment_id long, seconds double", "request_id")


#: What tasks of the search by blocks write: NODE, a node's time; CROSSING, the label of a segment that leaves the block for ``block``; EDGE, the
#: time of a node at the edge of the block.
NODE, CROSSING, EDGE = 0, 1, 2
_OUT = "from_id long, block int, home int, node long, street_id long, state long, cost double, steps long, kind int"
_TRACED = "request_id long, from_id long, block int, back long, state long, cost double, kind int"


class Blocks:
    """A graph of any size as a table in the shared folder, cut into blocks by ranges of the node that segments leave.

    Each round searches the blocks, one task for a block and a share of the sources, into which labels came that improve
    on those before; it starts from all labels that came in so far. There are about as many rounds as a way crosses from
    block to block. Only cuts and numbers of blocks reach the driver.
    """

    def __init__(self, states: DataFrame, rows: int | None = None):
        """rows: how many there are, if states are a stored table, to be read several times."""
        self.spark = states.sparkSession
        states = states.where("a IS NOT NULL AND b IS NOT NULL")
        states = stored(states) if rows is None else states
        n = max(1, math.ceil((states.count() if rows is None else rows) / BLOCK_STATES))
        at = states.approxQuantile("a", [k / n for k in range(1, n)], 0.1 / n) if n > 1 else []
        self.cuts = np.unique(np.array(at, np.float64)).astype(np.int64)
        path = new_folder(self.spark)
        states = states.withColumn("block", self.block_of("a"))
        states.repartition(len(self.cuts) + 1, "block").write.partitionBy("block").parquet(path)
        self.states = self.spark.read.schema(states.schema).parquet(path)

    def block_of(self, node: str) -> Column:
        cuts = self.cuts

        @F.pandas_udf("int")
        def of(n: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(cuts, n.to_numpy(np.int64), side="right"))

        return of(F.col(node))

    def _run(self, given: DataFrame, run: Callable, schema: str) -> DataFrame | None:
        """``run`` on each block and share of the sources that rows are given for, with the block's segments; None without rows."""
        given = stored(given)
        pairs = [(r.block, r.share) for r in given.select("block", "share").distinct().collect()]  # at most SOURCE_GROUPS a block
        if not pairs:
            return None
        keys, n = ["block", "share"], 2 * len(pairs)
        mine = self.states.where(F.col("block").isin(sorted({b for b, _ in pairs}))).join(F.broadcast(self.spark.createDataFrame(pairs, "block int, share int")), "block")
        return given.repartition(n, *keys).groupBy(*keys).cogroup(mine.repartition(n, *keys).groupBy(*keys)).applyInPandas(run, schema)

    def search(self, sources: DataFrame, penalty: float, targets: set[int] | dict[int, set[int]] | None) -> tuple[DataFrame, DataFrame]:
        """Times of nodes (from_id, node, cost) from sources (from_id), of targets only if there are any; and the labels that came into blocks.

        targets: nodes wanted from all sources, or from each. A source is done with once no label left is less than the time of its farthest target.
        """
        cuts = self.cuts
        if targets is not None:  # those that no segment leads to are not waited for
            asked = targets if isinstance(targets, set) else set().union(*targets.values())
            ends = self.states.select("b").join(F.broadcast(self.spark.createDataFrame([(t,) for t in asked], "b long")), "b", "left_semi").distinct()
            reach = {row.b for row in ends.collect()}  # at most MAX_TARGETS
            targets = targets & reach if isinstance(targets, set) else {k: v & reach for k, v in targets.items()}
        wanted = self.spark.sparkContext.broadcast(targets)
        path = new_folder(self.spark)

        def of(source: int) -> set[int] | None:
            return wanted.value[source] if isinstance(wanted.value, dict) else wanted.value

        def run(key: tuple, labels: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            here = int(key[0])
            g = Graph(rows, labels["node"])
            blocks = np.searchsorted(cuts, g.nodes, side="right")
            end = np.array(g.end, np.int64)
            out = np.flatnonzero(blocks[end] != here)
            leaves = np.unique(np.searchsorted(np.array(g.first), out, side="right") - 1).tolist()
            out = out.tolist()
            frames = []
            for source, own in labels.groupby("from_id"):
                goals = of(int(source))
                local = None if goals is None else {t: g.at(t) for t in goals if np.searchsorted(cuts, t, side="right") == here}
                whole = local is not None and len(local) == len(goals) and None not in local.values()
                best, cost, steps, _, final = g.labels(_seeds(g, own), penalty, set(local.values()) if whole else None, float(own["bound"].iloc[0]))

                def at_nodes(places: list[int], kind: int) -> pd.DataFrame:
                    return _as({"from_id": source, "node": g.nodes[places], "cost": [best[i][0] for i in places], "kind": kind}, len(places), _OUT)

                reached = list(best) if local is None else [i for i in local.values() if i in best]
                frames.append(at_nodes([i for i in reached if blocks[i] == here], NODE))
                frames.append(at_nodes([i for i in leaves if i in best], EDGE))
                to = [s for s in out if cost[s] <= final and cost[s] < math.inf]
                label = {k: [v[s] for s in to] for k, v in (("street_id", g.street), ("state", g.state), ("cost", cost), ("steps", steps))}
                frames.append(_as({"from_id": source, "block": blocks[end[to]], "home": here, "node": g.nodes[end[to]], "kind": CROSSING} | label, len(to), _OUT))
            return pd.concat(frames)

        src = sources.where("from_id IS NOT NULL").distinct()
        need = src.withColumn("n", F.lit(len(targets)).cast("long") if isinstance(targets, set) else F.lit(None).cast("long"))
        if isinstance(targets, dict):
            need = src.join(self.spark.createDataFrame([(k, len(v)) for k, v in targets.items()], "from_id long, n long"), "from_id", "left")
        need = stored(need.select("from_id", "n", self.block_of("from_id").alias("block")))
        begin = need.select("from_id", "block", F.lit(-1).alias("home"), F.col("from_id").alias("node"), F.lit(0).cast("long").alias("street_id"), F.lit(-1).cast("long").alias("state"), F.lit(0.0).alias("cost"), F.lit(0).cast("long").alias("steps"), F.lit(0).alias("round"))
        written = self.spark.createDataFrame([], f"{_OUT}, round int")
        ahead = 0
        while True:
            found = written.where(F.col("kind") == NODE).groupBy("from_id", "node").agg(F.min("cost").alias("cost"))
            if ahead:
                labels = self._labels(begin, written, None if targets is None else self._bounds(need, found), penalty)
                fresh = F.max(F.col("round") == ahead).over(Window.partitionBy("from_id", "block"))
                given = labels.withColumn("fresh", fresh).where("fresh").drop("fresh")
            else:
                given = labels = begin.withColumns({"bound": F.lit(math.inf), "share": _share()})
            got = self._run(given, run, _OUT)
            if got is None:
                return found, labels
            ahead += 1
            # few files: all rounds are read again after each, and each file costs the driver
            got.hint("rebalance", "node").write.partitionBy("kind").parquet(f"{path}/round={ahead}")
            written = self.spark.read.schema(f"{_OUT}, round int").parquet(path)

    def _bounds(self, need: DataFrame, found: DataFrame) -> DataFrame:
        """(from_id, bound): the time of the farthest target of sources that have reached all; a table of its own, so that it isn't planned again with the labels."""
        done = found.groupBy("from_id").agg(F.count(F.lit(1)).alias("found"), F.max("cost").alias("farthest"))
        bounds = need.join(done, "from_id", "left").select("from_id", F.when(F.col("found") == F.col("n"), F.col("farthest")).otherwise(math.inf).alias("bound"))
        return bounded(bounds)[0]

    def _labels(self, begin: DataFrame, written: DataFrame, bounds: DataFrame | None, penalty: float) -> DataFrame:
        """The least label of each segment that came into a block, and the bound of its source; without those that can't lead to anything less."""
        came = begin.unionByName(written.where(F.col("kind") == CROSSING).select(begin.columns))
        least = came.groupBy("from_id", "state").agg(F.min(F.struct("cost", "steps", "round", "block", "home", "node", "street_id")).alias("l")).select("from_id", "state", "l.*")
        edge = written.where(F.col("kind") == EDGE).groupBy("from_id", "node").agg(F.min("cost").alias("edge"))
        # from a node's best label every segment is at most one turn away
        out = least.join(edge, ["from_id", "node"], "left").where(F.col("edge").isNull() | (F.col("cost") <= F.col("edge") + penalty)).drop("edge")
        out = out.withColumn("bound", F.lit(math.inf)) if bounds is None else out.join(bounds, "from_id").where("cost <= bound")
        return out.withColumn("share", _share())

    def trace(self, asked: DataFrame, labels: DataFrame, penalty: float) -> DataFrame:
        """(request_id, back, state, cost): the segments of the ways to nodes asked for (request_id, from_id, node, cost), back counted from the end."""
        path = new_folder(self.spark)

        def run(key: tuple, given: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            g = Graph(rows, given["node"])
            here = set(given["state"])
            place = {s: i for i, s in enumerate(g.state) if s in here}
            out = []
            for source, own in given.groupby("from_id"):
                asks, own = own[own["asks"]], own[~own["asks"]]
                best, cost, _, before, _ = g.labels(_seeds(g, own), penalty, None, float(asks["cost"].max()))
                for request, node, state, back in zip(*(asks[c].tolist() for c in ("request_id", "node", "state", "back")), strict=True):
                    s = best[g.at(node)][1] if state < 0 else place[state]
                    while s >= 0:
                        out.append((request, source, 0, back, g.state[s], cost[s], NODE))
                        back += 1
                        s = before[s]
                    seed = own.iloc[-1 - s]
                    if seed["state"] >= 0:
                        out.append((request, source, seed["home"], back, seed["state"], seed["cost"], CROSSING))
            return pd.DataFrame(out, columns=[c.split()[0] for c in _TRACED.split(", ")])

        labels = stored(labels.drop("bound", "round"))
        none = F.lit(0).cast("long")
        asks = asked.select("request_id", "from_id", self.block_of("node").alias("block"), none.alias("back"), "node", F.lit(-1).cast("long").alias("state"), "cost")
        ahead = 0
        while True:
            asks = asks.withColumns({"share": _share(), "home": F.lit(-1), "steps": none, "street_id": none, "asks": F.lit(True)})
            seeds = labels.join(asks.select("from_id", "block").distinct(), ["from_id", "block"], "left_semi").withColumns({"request_id": none, "back": none, "asks": F.lit(False)})
            got = self._run(asks.unionByName(seeds), run, _TRACED)
            if got is None:
                break
            ahead += 1
            got.write.partitionBy("kind").parquet(f"{path}/round={ahead}")
            traced = self.spark.read.schema(f"{_TRACED}, round int").parquet(path)
            asks = traced.where((F.col("kind") == CROSSING) & (F.col("round") == ahead)).select("request_id", "from_id", "block", "back", none.alias("node"), "state", "cost")
        if not ahead:
            return self.spark.createDataFrame([], "request_id long, back long, state long, cost double")
        return traced.where(F.col("kind") == NODE).select("request_id", "back", "state", "cost")


def _share() -> Column:
    return F.expr(f"pmod(hash(from_id), {SOURCE_GROUPS})")


def _seeds(g: Graph, labels: pd.DataFrame) -> list[Seed]:
    """Labels that came into a block as what a search starts with."""
    columns = (labels[c].tolist() for c in ("node", "state", "street_id", "cost", "steps"))
    return [(g.at(n), None if state < 0 else street, c, h) for n, state, street, c, h in zip(*columns, strict=True)]


def _as(columns: dict, n: int, schema: str) -> pd.DataFrame:
    """n rows with the columns of a schema; numbers that are not given lack."""
    kinds = {"long": "Int64", "int": "Int32", "double": "float64"}
    return pd.DataFrame({c: pd.Series(columns.get(c), range(n), kinds[k]) for c, k in (x.split() for x in schema.split(", "))})


def frontier_times(states: DataFrame | Blocks, sources: DataFrame, penalty: float, targets: set[int] | None = None) -> DataFrame:
    """The same as times_from for graphs of any size, block by block. With targets only these need be reached."""
    src = sources.select(F.col("intersection_id").alias("from_id")).distinct()
    blocks = states if isinstance(states, Blocks) else Blocks(states)
    found, _ = blocks.search(src, penalty, targets)
    best = found.select("from_id", F.col("node").alias("to_id"), F.col("cost").alias("seconds")).where("from_id <> to_id")
    return best.unionAll(src.select("from_id", F.col("from_id").alias("to_id"), F.lit(0.0).alias("seconds")))


def frontier_paths(states: DataFrame | Blocks, requests: DataFrame, penalty: float) -> DataFrame:
    """The same as shortest_paths for graphs of any size: times block by block, then all ways traced back together."""
    asked, rows = bounded(requests.select("request_id", "from_id", "to_id").where("from_id <> to_id"))
    targets: dict[int, set[int]] | None = None if rows is None else {}
    for r in rows or ():
        targets.setdefault(r.from_id, set()).add(r.to_id)
    blocks = states if isinstance(states, Blocks) else Blocks(states)
    found, labels = blocks.search(asked.select("from_id"), penalty, targets)
    way = blocks.trace(asked.withColumnRenamed("to_id", "node").join(found, ["from_id", "node"]), labels, penalty)
    length = way.groupBy("request_id").agg(F.max("back").alias("last"))
    seq = (F.col("last") - F.col("back")).cast("int")
    return way.join(length, "request_id").select("request_id", seq.alias("seq"), F.shiftright("state", 1).alias("segment_id"), F.col("cost").alias("seconds"))
