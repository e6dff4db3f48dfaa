"""Map extracts in the PBF format as DataFrames of nodes, ways and relations.

A file is a row of blobs, each of up to 32 MB and compressed by itself. Where they lie is read from their headers; the
blobs are then decoded by the tasks, a few each, so that a file is read in parallel in one pass.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from terrafold.sources.binary import opened

SCHEMA = (
    "kind string, osm_id long, lat double, lon double, tags map<string,string>, node_refs array<long>, "
    "members array<struct<type:string,ref:long,role:string>>"
)
ARROW = pa.schema(
    [
        ("kind", pa.string()), ("osm_id", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("tags", pa.map_(pa.string(), pa.string())), ("node_refs", pa.list_(pa.int64())),
        ("members", pa.list_(pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())]))),
    ]
)
#: Entities of a block that is written, and blocks that a task reads.
BLOCK_ENTITIES, BLOBS_PER_TASK = 8_000, 4
MEMBER_TYPES = ("node", "way", "relation")


def _varint(b: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        x = b[at]
        at += 1
        value |= (x & 0x7F) << shift
        if x < 0x80:
            return value, at
        shift += 7


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message; numbers as integers, all else as bytes."""
    at = 0
    while at < len(b):
        key, at = _varint(b, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(b, at)
            yield key >> 3, value
        elif kind == 2:
            n, at = _varint(b, at)
            yield key >> 3, b[at : at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[kind]
            yield key >> 3, b[at : at + n]
            at += n


def packed(b: bytes) -> np.ndarray:
    """Varints of a packed field as unsigned numbers."""
    x = np.frombuffer(b, np.uint8)
    if not len(x):
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(x < 0x80)
    starts = np.r_[0, ends[:-1] + 1]
    shift = np.arange(len(x)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((x & 0x7F).astype(np.uint64) << (7 * shift).astype(np.uint64), starts)


def zigzag(u: np.ndarray) -> np.ndarray:
    return (u >> np.uint64(1)).astype(np.int64) ^ -(u & np.uint64(1)).astype(np.int64)


def blobs(path: str) -> list[tuple[int, int]]:
    """(offset, size) of every data blob of a file."""
    out = []
    files, name = opened(path)
    with files.open_input_file(name) as f:
        while n := f.read(4):
            h = dict(fields(f.read(struct.unpack(">I", n)[0])))
            at, size = f.tell(), int(h[3])
            if h[1] == b"OSMData":
                out.append((at, size))
            f.seek(at + size)
    return out


def _inflated(blob: bytes) -> bytes:
    f = dict(fields(blob))
    if 1 in f:
        return f[1]
    if 3 in f:
        return zlib.decompress(f[3])
    raise ValueError("a blob is compressed in a way that is not supported")


def entities(block: bytes) -> Iterator[dict]:
    """Nodes, ways and relations of one primitive block."""
    groups, strings, grain, lat0, lon0 = [], [], 100, 0, 0
    for k, v in fields(block):
        if k == 1:
            strings = [s.decode(errors="replace") for n, s in fields(v) if n == 1]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            grain = v
        elif k in (19, 20):
            signed = v - (1 << 64) if v >> 63 else v
            lat0, lon0 = (signed, lon0) if k == 19 else (lat0, signed)

    def degrees(x: np.ndarray, base: int) -> list[float]:
        return ((x * grain + base) * 1e-9).tolist()

    def tags(f: dict) -> list[tuple[str, str]]:
        return list({strings[int(k)]: strings[int(v)] for k, v in zip(packed(f.get(2, b"")), packed(f.get(3, b"")), strict=True)}.items())

    for g in groups:
        for k, v in fields(g):
            f = dict(fields(v)) if k in (1, 2, 3, 4) else {}
            if k == 1:
                x = zigzag(np.array([f[8], f[9], f[1]], np.uint64))
                yield {"kind": "node", "osm_id": int(x[2]), "lat": degrees(x[:1], lat0)[0], "lon": degrees(x[1:2], lon0)[0], "tags": tags(f)}
            elif k == 2:
                ids = np.cumsum(zigzag(packed(f.get(1, b"")))).tolist()
                lat, lon = (degrees(np.cumsum(zigzag(packed(f.get(n, b"")))), base) for n, base in ((8, lat0), (9, lon0)))
                words, at = packed(f.get(10, b"")).tolist(), 0
                for i, la, lo in zip(ids, lat, lon, strict=True):
                    own: dict[str, str] = {}
                    while at < len(words) and words[at]:
                        own[strings[words[at]]] = strings[words[at + 1]]
                        at += 2
                    at += 1
                    yield {"kind": "node", "osm_id": i, "lat": la, "lon": lo, "tags": list(own.items())}
            elif k == 3:
                yield {"kind": "way", "osm_id": f[1], "tags": tags(f), "node_refs": np.cumsum(zigzag(packed(f.get(8, b"")))).tolist()}
            elif k == 4:
                refs = np.cumsum(zigzag(packed(f.get(9, b"")))).tolist()
                kinds, roles = packed(f.get(10, b"")).tolist(), packed(f.get(8, b"")).tolist()
                members = [{"type": MEMBER_TYPES[t], "ref": r, "role": strings[o]} for t, r, o in zip(kinds, refs, roles, strict=True)]
                yield {"kind": "relation", "osm_id": f[1], "tags": tags(f), "members": members}


def _extracts(path: str) -> list[str]:
    """The file itself, or the files of a folder."""
    files, at = opened(path)
    if files.get_file_info(at).type != fs.FileType.Directory:
        return [path]
    base = path[: len(path) - len(at)] if path.endswith(at) else ""
    return sorted(base + i.path for i in files.get_file_info(fs.FileSelector(at)) if i.base_name.endswith(".pbf"))


def read_pbf(spark: SparkSession, path: str) -> DataFrame:
    """All entities of a file, or of the files of a folder, that every task can reach; filter on ``kind`` for nodes, ways or relations."""
    tasks = []
    for file in _extracts(path):
        places = blobs(file)
        tasks += [(file, places[i : i + BLOBS_PER_TASK]) for i in range(0, len(places), BLOBS_PER_TASK)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                file, places = tasks[k]
                files, name = opened(file)
                with files.open_input_file(name) as f:
                    for at, size in places:
                        f.seek(at)
                        rows = [{n: e.get(n) for n in ARROW.names} for e in entities(_inflated(f.read(size)))]
                        for i in range(0, len(rows), 10_000):
                            yield pa.RecordBatch.from_pylist(rows[i : i + 10_000], ARROW)

    return spark.range(0, len(tasks), 1, max(1, len(tasks))).mapInArrow(run, SCHEMA)


def _number(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(k: int, v: int | bytes) -> bytes:
    return _number(k << 3) + _number(v) if isinstance(v, int) else _number(k << 3 | 2) + _number(len(v)) + v


def _signed(values: list[int]) -> bytes:
    """Differences of successive values, as zigzag varints."""
    return b"".join(_number(((b - a) << 1) ^ ((b - a) >> 63)) for a, b in zip([0, *values], values, strict=False))


def _blob(kind: bytes, data: bytes) -> bytes:
    body = _field(2, len(data)) + _field(3, zlib.compress(data))
    h = _field(1, kind) + _field(3, len(body))
    return struct.pack(">I", len(h)) + h + body


def packed_block(rows: list[dict]) -> bytes:
    """One primitive block of nodes (dense) and ways; positions are kept to 1e-7 degrees, nodes without one are left out."""
    strings: dict[str, int] = {"": 0}

    def ref(text: str | None) -> int:
        return strings.setdefault(text or "", len(strings))

    points = [r for r in rows if r["kind"] == "node" and r["lat"] is not None and r["lon"] is not None]
    groups = b""
    if points:
        keys = b"".join(_number(ref(x)) for r in points for x in [*(y for kv in (r["tags"] or ()) for y in kv), ""])
        dense = _field(1, _signed([r["osm_id"] for r in points])) + _field(8, _signed([round(r["lat"] * 1e7) for r in points])) + _field(9, _signed([round(r["lon"] * 1e7) for r in points])) + _field(10, keys)
        groups += _field(2, _field(2, dense))
    ways_ = b""
    for r in rows:
        if r["kind"] == "way":
            tags = r["tags"] or ()
            way = _field(1, r["osm_id"]) + _field(2, b"".join(_number(ref(k)) for k, _ in tags)) + _field(3, b"".join(_number(ref(v)) for _, v in tags)) + _field(8, _signed(r["node_refs"] or []))
            ways_ += _field(3, way)
    if ways_:
        groups += _field(2, ways_)
    return _field(1, b"".join(_field(1, s.encode()) for s in strings)) + groups


def write_pbf(nodes_: DataFrame, ways_: DataFrame, folder: str) -> int:
    """Nodes (osm_id, lat, lon, tags) and ways (osm_id, node_refs, tags) as a folder of extracts, one a task; returns how many files.

    Of a task that is run again only the file of the attempt that counted stays. Tags with an empty key are lost, as the
    format has no place for them.
    """
    none = {"lat": "CAST(NULL AS DOUBLE)", "lon": "CAST(NULL AS DOUBLE)", "node_refs": "CAST(NULL AS ARRAY<BIGINT>)"}
    rows = nodes_.selectExpr("'node' AS kind", "osm_id", "lat", "lon", "map_filter(tags, (k, v) -> k <> '') AS tags", f"{none['node_refs']} AS node_refs")
    rows = rows.unionAll(ways_.selectExpr("'way' AS kind", "osm_id", f"{none['lat']} AS lat", f"{none['lon']} AS lon", "map_filter(tags, (k, v) -> k <> '') AS tags", "filter(node_refs, x -> x IS NOT NULL) AS node_refs"))
    files, at = opened(folder)
    if files.get_file_info(at).type == fs.FileType.Directory:
        files.delete_dir(at)
    files.create_dir(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c = TaskContext.get()
        files, at = opened(folder)
        name = f"part-{c.partitionId():08d}-{c.taskAttemptId()}.osm.pbf"
        with files.open_output_stream(f"{at}/{name}") as f:
            f.write(_blob(b"OSMHeader", _field(4, b"OsmSchema-V0.6") + _field(4, b"DenseNodes")))
            for b in batches:
                for i in range(0, len(b), BLOCK_ENTITIES):
                    f.write(_blob(b"OSMData", packed_block(b.slice(i, BLOCK_ENTITIES).to_pylist())))
        yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    kept = {r.name for r in rows.mapInArrow(run, "name string").collect()}  # one row a task
    for i in files.get_file_info(fs.FileSelector(at)):
        if i.base_name not in kept:
            files.delete_file(i.path)
    return len(kept)


def nodes(entities_: DataFrame) -> DataFrame:
    return entities_.where("kind = 'node'").select("osm_id", "lat", "lon", "tags")


def ways(entities_: DataFrame) -> DataFrame:
    return entities_.where("kind = 'way'").select("osm_id", "node_refs", "tags")


def relations(entities_: DataFrame) -> DataFrame:
    return entities_.where("kind = 'relation'").select("osm_id", "members", "tags")
