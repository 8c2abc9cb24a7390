"""Written intermediate tables, so that a lost executor never repeats the work before them."""

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


def new_path(folder: str, label: str) -> str:
    return f"{folder}/tables/{label}-{uuid.uuid4().hex}"


def written_to(folder: str, df: DataFrame, label: str, **options: str) -> DataFrame:
    """Writes ``df`` as Parquet, with writer options, into a new table below ``folder`` and reads it back."""
    path = new_path(folder, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back."""
    return written_to(shared_folder(df.sparkSession), df, label)
