"""Streams: positions counted per cell and time, and orphan counts kept up with changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.operators.orphans import merge_counts


def cell_counts(pings: DataFrame, window: str = "10 minutes", late: str = "1 hour", cell_deg: float = 0.01) -> DataFrame:
    """(window_start, cell_lat, cell_lon, n, n_users; n_users_about in streams) of positions (event_id, user_id, ts, lat, lon), streamed or not.

    Rows later than ``late`` are dropped from a stream by the watermark. Users are counted approximately in streams,
    where exact distinct counts would keep every user.
    """
    if pings.isStreaming:
        pings = pings.withWatermark("ts", late)
    cells = pings.where("ts IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").groupBy(
        F.window("ts", window).alias("w"), F.floor(F.col("lat") / cell_deg).alias("cell_lat"), F.floor(F.col("lon") / cell_deg).alias("cell_lon")
    )
    users = F.approx_count_distinct("user_id").alias("n_users_about") if pings.isStreaming else F.count_distinct("user_id").alias("n_users")
    return cells.agg(F.count(F.lit(1)).alias("n"), users).select(F.col("w.start").alias("window_start"), "cell_lat", "cell_lon", "n", "n_users_about" if pings.isStreaming else "n_users")


class OrphanCounts:
    """Signed counts kept in a folder of states, one batch of deltas after another; for ``foreachBatch``.

    A state is named by the last batch in it and counts once it is written whole (its ``_SUCCESS``). A new object takes
    up the newest such state, so a restarted stream goes on where it was, and a batch that is delivered again is not
    counted twice. States before the one that a running batch reads are removed.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def path(self, batch: int) -> str:
        return f"{self.folder}/state-{batch}"

    def _files(self, spark: SparkSession):
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def batches(self, spark: SparkSession) -> list[int]:
        """Batches whose states are whole, in order; the folder tells, not the object."""
        folder, files = self._files(spark)
        if not files.exists(folder):
            return []
        names = [(s.getPath(), s.getPath().getName()) for s in files.listStatus(folder)]
        whole = [n for p, n in names if n.startswith("state-") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(n.removeprefix("state-")) for n in whole)

    def apply(self, deltas: DataFrame, batch: int) -> None:
        spark = deltas.sparkSession
        done = self.batches(spark)
        if done and batch <= done[-1]:
            return
        state = spark.read.parquet(self.path(done[-1])) if done else deltas.limit(0)
        merge_counts(state, deltas).write.mode("overwrite").parquet(self.path(batch))
        _, files = self._files(spark)
        for old in done[:-1]:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(self.path(old)), True)

    def state(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path(self.batches(spark)[-1]))
