import datetime as dt

from terrafold.operators import orphans

SEG = "row_id long, node_refs array<long>, loaded_at timestamp_ntz, osm_id long, version int"
NODE = "osm_id long, version int, is_visible boolean, loaded_at timestamp_ntz, row_id long"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def found(spark, segs, nodes):
    df = orphans.orphan_references(spark.createDataFrame(segs, SEG), spark.createDataFrame(nodes, NODE))
    return sorted((r.row_id, r.node_id, r.orphan_kind) for r in df.collect())


def test_kinds(spark):
    nodes = [
        (1, 1, True, day(0), 9), (1, 2, False, day(5), 9), (1, 3, True, day(9), 9),  # removed and restored
        (2, 1, True, day(4), 9), (3, 2, False, day(1), 9), (3, 1, True, day(2), 9),  # 3: the old version comes late
        (4, 1, None, day(0), 9), (5, 1, True, None, 9), (None, 1, True, day(0), 9), (1, 2, False, day(6), 9),
    ]
    segs = [
        (10, [1, 1, None, 2, 3, 4, 5, 6], day(3), 1, 1), (11, [1], day(5), 1, 1), (12, [1, 2], day(10), 1, 1), (13, None, day(1), 1, 1), (14, [], day(1), 1, 1), (15, [5, 1], None, 1, 1),
    ]
    assert found(spark, segs, nodes) == [(10, 2, "late"), (10, 3, "deleted"), (10, 5, "late"), (10, 6, "missing"), (11, 1, "deleted")]


def test_versions_of_one_load(spark):
    nodes = [(1, 2, False, day(1), 0), (1, 1, True, day(1), 0)]
    assert found(spark, [(1, [1], day(1), 0, 0)], nodes) == [(1, 1, "deleted")]


def test_empty_tables(spark):
    assert found(spark, [], []) == []
    assert found(spark, [(1, [7], day(0), 0, 0)], []) == [(1, 7, "missing")]
    assert found(spark, [], [(1, 1, True, day(0), 0)]) == []


def test_signed_counts_merge_in_any_order(spark):
    kinds = "node_id long, n_refs long, n_exists long"
    state = spark.createDataFrame([(1, 2, 1), (2, 1, 0)], kinds)
    batches = [[(1, 0, -1)], [(2, 0, 1), (3, 1, 0)], [(3, -1, 0)]]
    a = b = state
    for x in batches:
        a = orphans.merge_counts(a, spark.createDataFrame(x, kinds))
    for x in reversed(batches):
        b = orphans.merge_counts(b, spark.createDataFrame(x, kinds))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) == [(1, 2, 0), (2, 1, 1)]
    assert [tuple(r) for r in orphans.current_orphans(a).collect()] == [(1, 2)]


def test_hot_key(spark):
    segs = [(i, [1, 2], day(3), 0, 0) for i in range(3000)]
    nodes = [(1, v, v % 2 == 0, day(v), 0) for v in range(400)]
    rows = found(spark, segs, nodes)
    assert len(rows) == 6000 and {r[2] for r in rows} == {"deleted", "missing"}


def test_periods(spark):
    o = orphans.orphan_references(spark.createDataFrame([(1, [5, 6], day(0), 0, 0), (2, [5], day(40), 0, 0), (3, [5], None, 0, 0)], SEG), spark.createDataFrame([], NODE))
    got = sorted(map(tuple, orphans.orphans_by_period(o, "t").collect()))
    assert got == [("t", "2024-01", "missing", 2, 1), ("t", "2024-02", "missing", 1, 1), ("t", "none", "missing", 1, 1)]


def test_replaced_and_removed_segments_take_references_back(spark):
    kinds = "osm_id long, row_id long, node_refs array<long>, edited_at timestamp_ntz, x int"
    old = spark.createDataFrame([(1, 10, [5, 6, None], day(0), 0), (2, 11, [6], day(0), 0), (None, 12, [7], day(0), 0), (3, 13, None, day(0), 0)], kinds)
    new = spark.createDataFrame([(1, 20, [6, 8, 8], day(2), 0), (1, 19, [9], day(1), 0), (None, 12, [7], day(0), 0), (3, 13, None, day(0), 0)], kinds)  # 2 is gone
    before, after = orphans.current_references(old), orphans.current_references(old.where("osm_id <> 2 OR osm_id IS NULL").unionAll(new).dropDuplicates(["row_id"]))
    deltas = orphans.reference_deltas(before, after)
    assert sorted(map(tuple, deltas.collect())) == [(5, -1, 0), (6, -1, 0), (8, 1, 0)]
    state = orphans.merge_counts(orphans.reference_deltas(before.limit(0), before), deltas)
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, orphans.reference_deltas(after.limit(0), after).collect())) == [(6, 1, 0), (7, 1, 0), (8, 1, 0)]
