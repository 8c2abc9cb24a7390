"""A reproducible shuffle into shards by a permutation of row numbers, in DataFrame operations only.

Rows get global numbers 0 to n - 1 (by hash bucket, then id). A Feistel network over two digits in bases
a and b, with a * b the least such product that holds n, permutes 0 to a * b - 1; a result of n or more
is permuted again until it falls below n (cycle walking), which keeps it a permutation of 0 to n - 1. The
permuted number p gives shard p mod shards and slot p div shards: shards differ by one row at most, slots
have no gaps, and both can be computed for any row number without the other rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS, ROUNDS, SEED = 16, 6, 20_240_501
#: Hash buckets in which rows are numbered; a bucket is one task's sort of narrow rows.
BUCKETS = 4096
#: Passes of cycle walking. Fewer than a (about the root of n) values lie outside. Up to 24 * 24 rows that
#: many passes always suffice; beyond, a row needs all of them with probability n ** -12 or less, and the
#: job would stop rather than give a wrong place.
WALKS = 24


def bases(n: int) -> tuple[int, int]:
    """(a, b) with a * b >= n and a * b - n < a."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _pass(x: Column, a: int, b: int) -> Column:
    """One pass of the network: the digits (x div b in base a, x mod b in base b) shift each other in
    turn. Each shift is undone by its inverse, so the pass is a permutation."""
    digits = F.struct(F.floor(x / b).cast("long").alias("left"), F.pmod(x, F.lit(b)).alias("right"))

    def shifted(d: Column, turn: Column) -> Column:
        left = F.pmod(d["left"] + F.pmod(F.xxhash64(d["right"], turn), F.lit(a)), F.lit(a))
        right = F.pmod(d["right"] + F.pmod(F.xxhash64(d["left"], turn), F.lit(b)), F.lit(b))
        even = turn % 2 == 0
        return F.struct(F.when(even, left).otherwise(d["left"]).alias("left"), F.when(even, d["right"]).otherwise(right).alias("right"))

    turns = F.sequence(F.lit(SEED), F.lit(SEED + ROUNDS - 1))
    return F.aggregate(turns, digits, shifted, lambda d: d["left"] * b + d["right"])


def permuted(number: Column, n: int) -> Column:
    """The place of row ``number`` (0 to n - 1) in the shuffle."""
    if n <= 1:
        return number
    a, b = bases(n)
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)), _pass(number, a, b), lambda x, _: F.when(x < n, x).otherwise(_pass(x, a, b)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with a column ``number``, 0 to n - 1, decided by the columns ``order`` alone. Rows that are
    equal in them get neighbouring numbers, in any order. Only counts per bucket are summed up across
    buckets."""
    keyed = rows.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(BUCKETS)))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS rows at most
    base = keyed.groupBy("bucket").count().select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*order)) - 1
    return keyed.withColumn("rank", rank).join(F.broadcast(base), "bucket").withColumn("number", F.col("base") + F.col("rank")).drop("bucket", "base", "rank")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): size (UTF-8 bytes plus 1),
    text_crc32, law (``rows``), shard, slot and grown_shard (null under this law). A null text has no
    bytes. Rows with a null id and repeated rows get places of their own."""
    bytes_of = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(bytes_of) + 1).cast("long").alias("size"), F.crc32(bytes_of).alias("text_crc32"))
    n = docs.count()
    place = permuted(F.col("number"), n)
    return numbered(rows, "doc_id", "text_crc32", "size").withColumn("place", place).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
