"""Places of rows within a group, whatever the group's size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docwarden.sources.tables import written


def ranked(rows: DataFrame, key: str, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds ``name``, the place 1, 2, ... of each row within its ``key`` by ``order``, in which no two rows
    of a key may tie; a NULL key is a group of its own.

    Rows are dealt to tasks by ranges of (key, order), so a large group is cut into many. Each range counts
    its own rows; how many rows of the key lie in earlier ranges is a sum over at most as many counts as
    there are ranges. The ranges are drawn from a sample, so they are written down before they are used."""
    dealt = rows.repartitionByRange(F.col(key), *order).withColumn("_range", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy(key, "_range").agg(F.count("*").alias("_n")).select(
        F.col(key).alias("_key"), F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order))
    joined = dealt.withColumn("_place", place).join(before, (F.col("_range") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key")))
    return joined.select(*rows.columns, (F.col("_before") + F.col("_place")).cast("long").alias(name))
