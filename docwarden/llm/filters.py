"""A bit filter of 64-bit values whose size does not depend on the input (8 MB), to spare tasks the rows
that a later join would drop. It may let others pass; the join decides."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 26
_PART = 32_768  # bits of one value of bitmap_construct_agg


def slot(value: Column) -> Column:
    """The filter's bit for a long value."""
    return value.bitwiseAND(F.lit((1 << BITS) - 1))


def bit_filter(values: DataFrame) -> np.ndarray:
    """The filter of all values of the one long column of ``values``: 2**BITS bits as bytes. The tasks
    send whole parts of it, at most 2,048 of 4 kB. They come in one job (8 MB, whatever the input): an
    iterator would run a job for each partition, one after the other."""
    place = slot(F.col(values.columns[0])) + 1
    parts = (
        values.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    )
    found = np.zeros((1 << BITS) // 8, np.uint8)
    for row in parts.collect():
        at = (row["part"] - 1) * (_PART // 8)
        found[at : at + _PART // 8] = np.frombuffer(row["bits"], np.uint8)
    return found


def passes(found: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the 64-bit values the filter lets pass."""
    place = (values.view(np.uint64) & np.uint64((1 << BITS) - 1)).astype(np.int64)
    return (found[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
