"""Sources, sinks and streams (the rest of SURVEY 2.1, 2.8 and 2.10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.plans.network_queries import _nodes, _ways
from terrafold.plans.registry import Registry
from terrafold.session import local_path, shared_dir
from terrafold.sources import binary
from terrafold.sources.fixtures import view
from terrafold.sources.mapstore import MapStore
from terrafold.streaming.pings import cell_counts

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

_SEGMENTS = "SELECT row_id AS osm_id, category, max_speed_kph, coalesce(name, '') AS name, CAST(coalesce(len(list_filter(node_refs, lambda x: x IS NOT NULL)), 0) AS INT) AS n_refs FROM street_segment_records"


def _folder(spark: SparkSession) -> str:
    return local_path(shared_dir(spark))


def _records(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = view(spark, d, "node_records").where("lat IS NOT NULL AND lon IS NOT NULL").select("osm_id", "lat", "lon")
    s = view(spark, d, "street_segment_records").select(
        F.col("row_id").alias("osm_id"), "category", F.coalesce("max_speed_kph", F.lit(-1.0).cast("float")).alias("max_speed_kph"), "name", F.filter("node_refs", lambda x: x.isNotNull()).alias("node_refs")
    )
    p = view(spark, d, "poi_records").where("lat IS NOT NULL AND lon IS NOT NULL").select("osm_id", "lat", "lon", "category", "name")
    return n, s, p


def _saved(spark: SparkSession, d: str) -> str:
    n, s, p = _records(spark, d)
    path = f"{_folder(spark)}/toronto_canada.streets.bin"
    binary.write_streets(n, s, path)
    binary.write_places(p, binary.places_path(path))
    return path


@R.add(_SEGMENTS.replace("max_speed_kph,", "coalesce(max_speed_kph, CAST(-1 AS FLOAT)) AS max_speed_kph,"))
def bin_sink(spark: SparkSession, d: str) -> DataFrame:
    """Segments after writing and reading the packed file."""
    return binary.read_segments(spark, _saved(spark, d)).select("osm_id", "category", "max_speed_kph", "name", F.size("node_refs").alias("n_refs"))


@R.add("SELECT osm_id, lat, lon FROM node_records WHERE lat IS NOT NULL AND lon IS NOT NULL")
def db_load(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of an opened map."""
    store = MapStore(spark)
    assert store.load(_saved(spark, d))
    return store.tables["map_nodes"]


@R.add("SELECT CAST(count(*) AS BIGINT) AS n_places FROM poi_records WHERE lat IS NOT NULL AND lon IS NOT NULL")
def map_switch(spark: SparkSession, d: str) -> DataFrame:
    """Places of the map that is open after a switch of cities."""
    store = MapStore(spark, _folder(spark))
    _saved(spark, d)
    assert store.switch("Canada", "Toronto") and not store.switch("nowhere", "x")
    return store.tables["map_places"].agg(F.count(F.lit(1)).alias("n_places"))


@R.add("SELECT CAST(0 AS BIGINT) AS n_views, true AS is_closed")
def db_close(spark: SparkSession, d: str) -> DataFrame:
    """What is left of a map after it is closed."""
    store = MapStore(spark)
    store.load(_saved(spark, d))
    store.close()
    left = sum(spark.catalog.tableExists(v) for v in MapStore.VIEWS)
    return spark.createDataFrame([(left, store.path is None)], "n_views long, is_closed boolean")


@R.add()
def conv_cli(spark: SparkSession, d: str) -> DataFrame:
    """A conversion of raw entities: done, skipped as its files exist, done again by force."""
    path = f"{_folder(spark)}/conv.streets.bin"
    first = binary.convert(_nodes(spark, d), _ways(spark, d), path, force=True)
    again = binary.convert(_nodes(spark, d), _ways(spark, d), path)
    rows = [(k, bool(r["skipped"]), r.get("nodes"), r.get("segments"), r.get("places"), r.get("missing")) for k, r in enumerate((first, again))]
    return spark.createDataFrame(rows, "run int, skipped boolean, nodes long, segments long, places long, missing long")


@R.add("SELECT osm_id, lat, lon, category FROM (SELECT r.osm_id, r.lat, r.lon, r.category FROM poi_records r WHERE r.lat IS NOT NULL AND r.lon IS NOT NULL)")
def bin_places(spark: SparkSession, d: str) -> DataFrame:
    return binary.read_places(spark, binary.places_path(_saved(spark, d))).select("osm_id", "lat", "lon", "category")


@R.add("""SELECT time_bucket(INTERVAL '10 minutes', ts) AS window_start, CAST(floor(lat / 0.01) AS BIGINT) AS cell_lat, CAST(floor(lon / 0.01) AS BIGINT) AS cell_lon, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS n_users FROM pings GROUP BY ALL""")
def ping_windows(spark: SparkSession, d: str) -> DataFrame:
    return cell_counts(view(spark, d, "pings"))
