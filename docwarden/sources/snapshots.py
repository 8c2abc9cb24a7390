"""Counts and listings of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, row_count`` of several tables, one pass each."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("row_count")).orderBy(column)


def upload_listing(uploads: DataFrame) -> DataFrame:
    return uploads.select("original_filename", "status", "chunk_count", "uploaded_at").orderBy("uploaded_at")
