"""Session settings."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive plans and Arrow; everything else is the cluster's to set."""
    builder = SparkSession.builder.appName("isobar").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, as spark.checkpoint.dir names it; a local
    session without one gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="isobar-")
    return _own_folder[app]


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()
