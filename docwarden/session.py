"""Session defaults for local runs; on a cluster the submitted configuration wins."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that task functions find it
    there whatever the driver's working directory."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    archive = shutil.make_archive(
        str(Path(tempfile.mkdtemp(prefix="docwarden-")) / _PACKAGE.name), "zip", root_dir=_PACKAGE.parent, base_dir=_PACKAGE.name
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def local_session(app: str, cpus: int = 8, memory: str = "12g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark
