import struct
import zlib

import numpy as np
import pytest

from terrafold.operators import osm
from terrafold.sources import binary, pbf
from terrafold.sources.mapstore import MapStore
from terrafold.streaming import pings


def test_round_trip_and_store(spark, tmp_path):
    n = spark.createDataFrame([(1, 1.5, -2.5), (2, 0.0, 180.0)], binary.NODE_SCHEMA)
    s = spark.createDataFrame([(7, 3, 48.25, "Straße", [1, 2]), (8, 0, -1.0, None, []), (9, 11, None, "", None)], binary.SEGMENT_SCHEMA)
    p = spark.createDataFrame([(5, 1.0, 2.0, "amenity:cafe", "Çay"), (6, 1.0, 2.0, None, None)], binary.PLACE_SCHEMA)
    path = str(tmp_path / "x.streets.bin")
    assert binary.write_streets(n, s, path) == (2, 3) and binary.write_places(p, binary.places_path(path)) == 2
    assert binary.places_path(path).endswith("x.osm.bin")
    assert sorted(map(tuple, binary.read_nodes(spark, path).collect())) == [(1, 1.5, -2.5), (2, 0.0, 180.0)]
    assert sorted(map(tuple, binary.read_segments(spark, path).collect())) == [(7, 3, 48.25, "Straße", [1, 2]), (8, 0, -1.0, "", []), (9, 11, -1.0, "", [])]
    store = MapStore(spark, str(tmp_path))
    assert store.load(path) and store.load(path) and spark.table("map_places").count() == 2
    assert not store.load(str(tmp_path / "none.streets.bin")) and store.path == path
    store.close()
    assert not spark.catalog.tableExists("map_places")
    one = str(tmp_path / "one.streets.bin")
    binary.joined(path, one)
    binary.joined(binary.places_path(path), binary.places_path(one))
    assert sorted(map(tuple, binary.read_nodes(spark, one).collect())) == [(1, 1.5, -2.5), (2, 0.0, 180.0)]
    assert binary.read_segments(spark, one).count() == 3 and binary.read_places(spark, binary.places_path(one)).count() == 2 and store.load(one)
    open(one, "wb").write(b"nonsense" * 8)
    assert not MapStore(spark).load(one)


def test_many_files_of_a_map(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "RECORDS_PER_FILE", 7)
    n = spark.range(100).selectExpr("id AS osm_id", "id / 2D AS lat", "0D AS lon").repartition(3)
    s = spark.range(50).selectExpr("id AS osm_id", "1 AS category", "CAST(2 AS FLOAT) AS max_speed_kph", "'x' AS name", "array(id, id + 1) AS node_refs").repartition(2)
    path = str(tmp_path / "m.streets.bin")
    assert binary.write_streets(n, s, path) == (100, 50) == binary.write_streets(n, s, path)
    assert binary.read_nodes(spark, path).rdd.getNumPartitions() > 5
    assert sorted(r.osm_id for r in binary.read_nodes(spark, path).collect()) == list(range(100)) and sorted(r.node_refs[1] for r in binary.read_segments(spark, path).collect()) == list(range(1, 51))


def test_empty_files(spark, tmp_path):
    path = str(tmp_path / "e.streets.bin")
    assert binary.write_streets(spark.createDataFrame([], binary.NODE_SCHEMA), spark.createDataFrame([], binary.SEGMENT_SCHEMA), path) == (0, 0)
    assert binary.read_nodes(spark, path).count() == 0 and binary.read_segments(spark, path).count() == 0


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(k, v):
    return varint(k << 3) + varint(v) if isinstance(v, int) else varint(k << 3 | 2) + varint(len(v)) + v


def many(values, zig=False):
    return b"".join(varint((v << 1 ^ v >> 63) if zig else v) for v in values)


def deltas(values):
    return [b - a for a, b in zip([0, *values], values)]


def blob(kind, data, compress=True):
    body = field(2, len(data)) + field(3, zlib.compress(data)) if compress else field(1, data)
    h = field(1, kind) + field(3, len(body))
    return struct.pack(">I", len(h)) + h + body


def test_pbf(spark, tmp_path):
    words = [b"", b"highway", b"primary", b"amenity", b"cafe", b"outer", b"type"]
    table = field(1, b"".join(field(1, w) for w in words))
    lat, lon = [435000000, 436000001, -10], [-1600000000, -1599999999, 1800000000]
    dense = field(1, many(deltas([10, 12, 11]), True)) + field(8, many(deltas(lat), True)) + field(9, many(deltas(lon), True)) + field(10, many([3, 4, 0, 0, 0]))
    node = field(1, 2 * 99) + field(2, many([3])) + field(3, many([4])) + field(8, 2 * 5) + field(9, 2 * 7 - 1)
    way = field(1, 77) + field(2, many([1])) + field(3, many([2])) + field(8, many(deltas([10, 12, 555]), True))
    rel = field(1, 88) + field(2, many([6])) + field(3, many([5])) + field(8, many([5, 0])) + field(9, many(deltas([77, 10]), True)) + field(10, many([1, 0]))
    block = table + field(2, field(2, dense)) + field(2, field(1, node)) + field(2, field(3, way)) + field(2, field(4, rel))
    path = str(tmp_path / "a.osm.pbf")
    open(path, "wb").write(blob(b"OSMHeader", b"") + blob(b"OSMData", block) + blob(b"OSMData", table + field(2, field(3, field(1, 78))), compress=False))
    e = pbf.read_pbf(spark, path)
    nodes = {r.osm_id: r for r in pbf.nodes(e).collect()}
    assert sorted(nodes) == [10, 11, 12, 99] and nodes[10].tags == {"amenity": "cafe"} and nodes[12].tags == {}
    assert abs(nodes[12].lat - 43.6000001) < 1e-9 and abs(nodes[11].lon - 180.0) < 1e-9 and abs(nodes[99].lon + 7e-7) < 1e-12
    ways = {r.osm_id: r for r in pbf.ways(e).collect()}
    assert ways[77].node_refs == [10, 12, 555] and ways[77].tags == {"highway": "primary"} and ways[78].node_refs == []
    r = pbf.relations(e).first()
    assert [tuple(m) for m in r.members] == [("way", 77, "outer"), ("node", 10, "")]
    assert {x.node_id for x in osm.missing_references(pbf.nodes(e), pbf.ways(e)).collect()} == {555}
    done = binary.convert(pbf.nodes(e), pbf.ways(e), str(tmp_path / "a.streets.bin"))
    assert done == {"skipped": False, "nodes": 2, "segments": 1, "places": 2, "missing": 1}
    assert binary.convert(pbf.nodes(e), pbf.ways(e), str(tmp_path / "a.streets.bin")) == {"skipped": True}


def test_packed_numbers():
    values = [0, 1, 127, 128, 300, 2**63, 2**64 - 1]
    assert pbf.packed(many(values)).tolist() == values and len(pbf.packed(b"")) == 0
    assert pbf.zigzag(pbf.packed(many([-5, 5, -(2**40)], True))).tolist() == [-5, 5, -(2**40)]
    assert isinstance(pbf.packed(b"\x01"), np.ndarray)


def test_stream_equals_batch(spark, tmp_path):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    kinds = "event_id long, user_id long, ts timestamp, lat double, lon double"
    rows = [(i, i % 7, t0 + dt.timedelta(minutes=i), 43.5 + i % 3 * 0.01, -79.6) for i in range(200)]
    spark.createDataFrame(rows, kinds).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kinds).parquet(str(tmp_path / "in"))
    q = pings.cell_counts(stream).writeStream.outputMode("complete").format("memory").queryName("cells").start()
    q.processAllAvailable()
    q.stop()
    batch = pings.cell_counts(spark.read.parquet(str(tmp_path / "in")))
    exact = {tuple(r)[:4]: r.n_users for r in batch.collect()}
    about = {tuple(r)[:4]: r.n_users_about for r in spark.table("cells").collect()}
    assert exact.keys() == about.keys() and all(abs(exact[k] - about[k]) <= 1 for k in exact)


@pytest.mark.parametrize("again", [False, True])
def test_counts_kept_by_a_stream(spark, tmp_path, again):
    kinds = "node_id long, n_refs long, n_exists long"
    counts = pings.OrphanCounts(str(tmp_path / f"state{again}"))
    for k, rows in enumerate(([(1, 1, 0), (2, 1, 1)], [(1, 1, 0)], [(2, 0, -1)])):
        df = spark.createDataFrame(rows, kinds)
        counts.apply(df, k)
        if again:
            counts.apply(df, k)
            counts = pings.OrphanCounts(str(tmp_path / f"state{again}"))  # as after a restart
            counts.apply(df, k)
    assert counts.batches(spark) == [1, 2]
    assert sorted(map(tuple, counts.state(spark).collect())) == [(1, 2, 0), (2, 1, 0)]


def test_pbf_is_written_and_read_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pbf, "BLOCK_ENTITIES", 3)
    n = spark.createDataFrame([(i, i / 8 - 3, -i / 4, {"name": f"n{i}", "": "x"} if i % 3 else {}) for i in range(20)] + [(99, None, 1.0, {"a": "b"}), (-5, 89.5, -179.25, None)], "osm_id long, lat double, lon double, tags map<string,string>")
    w = spark.createDataFrame([(7, [5, 2, 9], {"highway": "primary", "name": "Ü"}), (8, None, None), (9, [1, None, 3], {})], "osm_id long, node_refs array<long>, tags map<string,string>")
    path = str(tmp_path / "x")
    assert pbf.write_pbf(n, w, path) >= 2 and pbf.write_pbf(n, w, path) >= 2
    read = pbf.read_pbf(spark, path)
    got = {r.osm_id: (round(r.lat, 6), round(r.lon, 6), r.tags) for r in pbf.nodes(read).collect()}
    assert got == {i: (i / 8 - 3, -i / 4, {"name": f"n{i}"} if i % 3 else {}) for i in range(20)} | {-5: (89.5, -179.25, {})}
    assert sorted((r.osm_id, r.node_refs, r.tags) for r in pbf.ways(read).collect()) == [(7, [5, 2, 9], {"highway": "primary", "name": "Ü"}), (8, [], {}), (9, [1, 3], {})]
