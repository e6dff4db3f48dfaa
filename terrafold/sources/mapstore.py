"""One open map at a time: its tables as cached DataFrames and temporary views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrafold.operators import search
from terrafold.sources import binary


class MapStore:
    """Opens, closes and switches maps that are stored as a streets file and the map file beside it."""

    VIEWS = ("map_nodes", "map_segments", "map_places")

    def __init__(self, spark: SparkSession, folder: str = "."):
        self.spark, self.folder, self.path = spark, folder, None
        self.tables: dict[str, DataFrame] = {}

    def load(self, path: str) -> bool:
        """Opens a map; opening the one that is open does nothing, another is closed first. False if it can't be read."""
        if self.path == path:
            return True
        try:
            tables = {
                "map_nodes": binary.read_nodes(self.spark, path),
                "map_segments": binary.read_segments(self.spark, path),
                "map_places": binary.read_places(self.spark, binary.places_path(path)),
            }
        except (OSError, ValueError):
            return False
        self.close()
        for name, df in tables.items():
            self.tables[name] = df.cache()
            df.createOrReplaceTempView(name)
        self.path = path
        return True

    def close(self) -> None:
        """Lets go of all tables; views of a closed map are gone."""
        for name, df in self.tables.items():
            df.unpersist()
            self.spark.catalog.dropTempView(name)
        self.tables, self.path = {}, None

    def switch(self, country: str, city: str) -> bool:
        """Opens the map of a city of the catalogue; False for an unknown city or a file that can't be read."""
        wanted = "".join(city.lower().split())
        paths = [r.path for r in search.cities(self.spark, country).collect() if r.city == wanted]  # the catalogue is a fixed list
        return bool(paths) and self.load(f"{self.folder}/{paths[0]}")
