"""Point-in-time helpers. Every operator takes its clock as a parameter, so a rerun of a
lost task, or of the whole job, gives the same rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F


def at(as_of: str | datetime | Column) -> Column:
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, datetime):
        as_of = as_of.isoformat(sep=" ")
    return F.lit(as_of).cast("timestamp_ntz")


def days(n: int) -> Column:
    return F.expr(f"INTERVAL {int(n)} DAY")


def hours(n: int) -> Column:
    return F.expr(f"INTERVAL {int(n)} HOUR")
