"""The packed binary map files, as a sink and sources of DataFrames.

A streets file holds nodes (id, lat, lon) and segments (id, category, speed, name, references), a map file points of
interest. A map may be one file of each kind, or a folder of such, each whole and of at most RECORDS_PER_FILE records:
so tasks write and read files of their own and nothing passes through the driver. Within one file nodes have a fixed
width and are read in ranges by many tasks; the other records follow one another and are read by one task. Paths may
be any that pyarrow's file systems open, such as those of object stores.
"""

from __future__ import annotations

import io
import posixpath
import struct
from collections.abc import Callable, Iterator
from typing import Any, BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

# Marks at the start of the files, and their version.
STREETS_MAGIC, PLACES_MAGIC, VERSION = b"GISEVOS1", b"GISEVOO1", 1
STREETS_HEAD, PLACES_HEAD, NODE = struct.Struct("=8sIQQ"), struct.Struct("=8sIQ"), struct.Struct("=qdd")
#: Nodes that one task reads.
NODES_PER_TASK = 1_000_000
#: Records of one file of a folder, which a task holds in memory while it writes them.
RECORDS_PER_FILE = 500_000
NODE_SCHEMA = "osm_id long, lat double, lon double"
SEGMENT_SCHEMA = "osm_id long, category int, max_speed_kph float, name string, node_refs array<long>"
PLACE_SCHEMA = "osm_id long, lat double, lon double, category string, name string"


def _text(s: str | None) -> bytes:
    b = (s or "").encode()
    return struct.pack("=I", len(b)) + b


def pack_node(r: dict) -> bytes:
    return NODE.pack(r["osm_id"], r["lat"], r["lon"])


def pack_segment(r: dict) -> bytes:
    refs = r["node_refs"] or []
    speed = -1.0 if r["max_speed_kph"] is None else r["max_speed_kph"]
    return struct.pack("=qBf", r["osm_id"], r["category"] or 0, speed) + _text(r["name"]) + struct.pack(f"=I{len(refs)}q", len(refs), *refs)


def pack_place(r: dict) -> bytes:
    return NODE.pack(r["osm_id"], r["lat"], r["lon"]) + _text(r["category"]) + _text(r["name"])


class _Reader:
    def __init__(self, f: BinaryIO):
        self.f = f

    def values(self, form: str) -> tuple:
        s = struct.Struct("=" + form)
        b = self.f.read(s.size)
        if len(b) != s.size:
            raise ValueError("the file ends within a record")
        return s.unpack(b)

    def text(self) -> str:
        (n,) = self.values("I")
        return self.f.read(n).decode(errors="replace")

    def segment(self) -> dict:
        i, c, v = self.values("qBf")
        name = self.text()
        (n,) = self.values("I")
        return {"osm_id": i, "category": c, "max_speed_kph": v, "name": name, "node_refs": list(self.values(f"{n}q"))}

    def place(self) -> dict:
        i, la, lo = self.values("qdd")
        return {"osm_id": i, "lat": la, "lon": lo, "category": self.text(), "name": self.text()}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and the path in it."""
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def _kind(path: str) -> fs.FileType:
    files, at = opened(path)
    return files.get_file_info(at).type


def exists(path: str) -> bool:
    return _kind(path) != fs.FileType.NotFound


def head(path: str) -> tuple[str, int, int]:
    """(kind, first count, second count) of a file; kind is streets or places."""
    files, at = opened(path)
    with files.open_input_file(at) as f:
        b = f.read(STREETS_HEAD.size)
    if b[:8] == STREETS_MAGIC:
        if len(b) < STREETS_HEAD.size:
            raise ValueError(f"{path} ends within its head")
        _, version, n, m = STREETS_HEAD.unpack(b)
        kind = "streets"
    elif b[:8] == PLACES_MAGIC:
        if len(b) < PLACES_HEAD.size:
            raise ValueError(f"{path} ends within its head")
        _, version, n = PLACES_HEAD.unpack(b[: PLACES_HEAD.size])
        kind, m = "places", 0
    else:
        raise ValueError(f"{path} is no map file")
    if version != VERSION:
        raise ValueError(f"{path} has version {version}")
    return kind, n, m


def _files(path: str, kind: str) -> list[tuple[str, int, int]]:
    """(path, first count, second count) of the files of a map; one head is read of each, so a folder should hold large ones."""
    if _kind(path) != fs.FileType.Directory:
        names = [path]
    else:
        files, at = opened(path)
        base = path[: len(path) - len(at)] if path.endswith(at) else ""
        names = sorted(base + i.path for i in files.get_file_info(fs.FileSelector(at)) if i.base_name.endswith(".bin"))
    heads = [(n, *head(n)) for n in names]
    if any(h[1] != kind for h in heads):
        raise ValueError(f"{path} holds no {kind}")
    return [(n, x, y) for n, _, x, y in heads]


def _read(spark: SparkSession, jobs: list[tuple], one: Callable[[tuple], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """The batches of all jobs, each a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                yield from one(jobs[k])

    return spark.range(0, len(jobs), 1, max(1, len(jobs))).mapInArrow(run, schema)


def _node_batches(job: tuple) -> Iterator[pa.RecordBatch]:
    path, first, last = job
    files, at = opened(path)
    with files.open_input_file(at) as f:
        f.seek(STREETS_HEAD.size + first * NODE.size)
        columns = list(zip(*NODE.iter_unpack(f.read((last - first) * NODE.size)), strict=True))
    if columns:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["osm_id", "lat", "lon"])


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of a streets file or of a folder of them."""
    jobs = [(p, at, min(n, at + NODES_PER_TASK)) for p, n, _ in _files(path, "streets") for at in range(0, n, NODES_PER_TASK)]
    return _read(spark, jobs, _node_batches, NODE_SCHEMA)


def _sequential(spark: SparkSession, jobs: list[tuple[str, int, int]], record: Callable[[_Reader], dict], schema: str, kinds: pa.Schema) -> DataFrame:
    """Records that follow one another, of jobs (path, where they begin, how many)."""

    def one(job: tuple) -> Iterator[pa.RecordBatch]:
        files, at = opened(job[0])
        with files.open_input_file(at) as raw:
            raw.seek(job[1])
            r = _Reader(io.BufferedReader(raw, 1 << 20))
            for k in range(0, job[2], 10_000):
                yield pa.RecordBatch.from_pylist([record(r) for _ in range(min(10_000, job[2] - k))], kinds)

    return _read(spark, jobs, one, schema)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments of a streets file or of a folder of them."""
    kinds = pa.schema([("osm_id", pa.int64()), ("category", pa.int32()), ("max_speed_kph", pa.float32()), ("name", pa.string()), ("node_refs", pa.list_(pa.int64()))])
    jobs = [(p, STREETS_HEAD.size + n * NODE.size, m) for p, n, m in _files(path, "streets") if m]
    return _sequential(spark, jobs, _Reader.segment, SEGMENT_SCHEMA, kinds)


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """Points of interest of a map file or of a folder of them."""
    kinds = pa.schema([("osm_id", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("category", pa.string()), ("name", pa.string())])
    jobs = [(p, PLACES_HEAD.size, n) for p, n, _ in _files(path, "places") if n]
    return _sequential(spark, jobs, _Reader.place, PLACE_SCHEMA, kinds)


def _nodes_head(n: int) -> bytes:
    return STREETS_HEAD.pack(STREETS_MAGIC, VERSION, n, 0)


def _segments_head(n: int) -> bytes:
    return STREETS_HEAD.pack(STREETS_MAGIC, VERSION, 0, n)


def _places_head(n: int) -> bytes:
    return PLACES_HEAD.pack(PLACES_MAGIC, VERSION, n)


def _written(df: DataFrame, pack: Callable[[dict], bytes], header: Callable[[int], bytes], folder: str, tag: str) -> int:
    """Records packed by the tasks into whole files of the folder, of an attempt each; returns how many. Files of attempts that failed are removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c = TaskContext.get()
        files, at = opened(folder)
        out, n, k = io.BytesIO(), 0, 0

        def put() -> pa.RecordBatch:
            name = f"{tag}-{c.partitionId():08d}-{c.taskAttemptId()}-{k}.bin"
            with files.open_output_stream(posixpath.join(at, name)) as f:
                f.write(header(n))
                f.write(out.getbuffer())
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["name", "n"])

        for b in batches:
            for row in b.to_pylist():
                out.write(pack(row))
                n += 1
                if n == RECORDS_PER_FILE:
                    yield put()
                    out, n, k = io.BytesIO(), 0, k + 1
        if n:
            yield put()

    done = df.mapInArrow(run, "name string, n long").collect()  # one row a file
    files, at = opened(folder)
    kept = {r.name for r in done}
    for i in files.get_file_info(fs.FileSelector(at)):
        if i.base_name.startswith(tag + "-") and i.base_name not in kept:
            files.delete_file(i.path)
    return sum(r.n for r in done)


def _fresh(folder: str) -> None:
    files, at = opened(folder)
    info = files.get_file_info(at)
    if info.type == fs.FileType.Directory:
        files.delete_dir(at)
    elif info.type == fs.FileType.File:
        files.delete_file(at)
    files.create_dir(at)


def _empty(folder: str, header: bytes) -> None:
    """A file without records, so that an empty map has its kind."""
    files, at = opened(folder)
    with files.open_output_stream(posixpath.join(at, "empty.bin")) as f:
        f.write(header)


def write_streets(nodes: DataFrame, segments: DataFrame, path: str) -> tuple[int, int]:
    """Writes a folder of streets files on storage that all tasks can reach; returns how many nodes and segments."""
    _fresh(path)
    n = _written(nodes.select("osm_id", "lat", "lon"), pack_node, _nodes_head, path, "nodes")
    m = _written(segments.select("osm_id", "category", "max_speed_kph", "name", "node_refs"), pack_segment, _segments_head, path, "segments")
    if not n + m:
        _empty(path, _nodes_head(0))
    return n, m


def write_places(places: DataFrame, path: str) -> int:
    """Writes a folder of map files of points of interest."""
    _fresh(path)
    n = _written(places.select("osm_id", "lat", "lon", "category", "name"), pack_place, _places_head, path, "places")
    if not n:
        _empty(path, _places_head(0))
    return n


def joined(folder: str, path: str) -> None:
    """One file from the files of a folder, as other programs want a map; for a map that one machine can copy."""
    files, at = opened(folder)
    names = sorted(i.path for i in files.get_file_info(fs.FileSelector(at)) if i.base_name.endswith(".bin"))
    heads = [head(n) for n in names]
    places = heads[0][0] == "places"
    size = PLACES_HEAD.size if places else STREETS_HEAD.size
    n, m = sum(h[1] for h in heads), sum(h[2] for h in heads)
    out_files, out_at = opened(path)
    with out_files.open_output_stream(out_at) as out:
        out.write(PLACES_HEAD.pack(PLACES_MAGIC, VERSION, n) if places else STREETS_HEAD.pack(STREETS_MAGIC, VERSION, n, m))
        for with_nodes in (True, False):  # nodes come first
            for name, h in zip(names, heads, strict=True):
                if bool(h[1]) == with_nodes:
                    with files.open_input_file(name) as f:
                        f.seek(size)
                        while b := f.read(1 << 20):
                            out.write(b)


def places_path(streets_path: str) -> str:
    """The map file beside a streets file: the first "streets" of the name replaced by "osm"."""
    return streets_path.replace("streets", "osm", 1)


def convert(nodes: DataFrame, ways: DataFrame, streets_path: str, force: bool = False) -> dict[str, Any]:
    """Raw nodes and ways (see operators.osm) to both files. Nothing is done if both exist, unless forced."""
    from terrafold.operators import osm

    if not force and exists(streets_path) and exists(places_path(streets_path)):
        return {"skipped": True}
    n, m = write_streets(osm.referenced_nodes(nodes, ways), osm.street_segments(ways), streets_path)
    p = write_places(osm.points_of_interest(nodes), places_path(streets_path))
    return {"skipped": False, "nodes": n, "segments": m, "places": p, "missing": osm.missing_references(nodes, ways).count()}
