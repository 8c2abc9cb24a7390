"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Unset, a local session gets one of its own; on a cluster
    it is an error, because executors share no local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="docwarden-shared-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder where nothing is yet."""
    return f"{shared_folder(spark)}/tables/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: later plans know its size, and
    nothing before it runs twice."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Whether the exchanges of a statement are removed when it ends.
_REMOVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written_alone(df: DataFrame, label: str) -> DataFrame:
    """As :func:`written`. The exchanges behind the table are removed from the disks at once, not when the
    driver's memory happens to be collected: nothing reads them again."""
    conf = df.sparkSession.conf
    before = conf.get(_REMOVED, None)
    conf.set(_REMOVED, "true")
    try:
        return written(df, label)
    finally:
        conf.unset(_REMOVED) if before is None else conf.set(_REMOVED, before)
