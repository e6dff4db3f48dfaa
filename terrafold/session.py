"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "terrafold") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TERRAFOLD_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (tests, notebooks) a folder of our own is made and registered.
    """
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not told and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="terrafold-checkpoint-"))
    return told or sc._jsc.sc().getCheckpointDir().get()


def local_path(path: str) -> str:
    """A path of the local file system without its scheme; others as they are."""
    return path.removeprefix("file://").removeprefix("file:")


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def stored(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage as a Parquet table in the shared folder: compressed, and read by column.

    For what several branches of a plan read; rows come back in no order. The folder is removed when Python ends.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder for tables of our own. It is removed when Python ends."""
    path = f"{shared_dir(spark)}/terrafold-{uuid.uuid4().hex}"
    _STORED.append((spark, path))
    return path


_STORED: list[tuple[SparkSession, str]] = []


@atexit.register
def _remove_stored() -> None:
    for spark, path in _STORED:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended before
            return
