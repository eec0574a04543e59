"""Folders for intermediate files, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where that is unset and Spark runs inside one machine (tests) a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="sheetmill-files-")
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(_FALLBACK[app])
    return _FALLBACK[app]


def computed_once(rows: DataFrame) -> DataFrame:
    """``rows`` computed into the shared folder, their lineage cut; for slim rows that several plans read."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, deleted when the application ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return folder
