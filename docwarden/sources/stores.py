"""Tables that batches change in place, written by Spark's own Parquet writer.

A keyed table is partitioned by ``shard``, the first hex digits of the key's hash, so its partitions are
as even as a hash and at most ``16 ** digits`` in number. A batch reads and rewrites only the shards its
keys fall in (partition pruning on the way in, dynamic partition overwrite on the way out).

Batches have ids, those of ``foreachBatch``. What a batch leaves in its shards is first written beside the
table, into a folder of its own, and from there into the table. A batch that died while it replaced shards
is finished from that folder when it comes again, before anything reads the table. One writer at a time."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docwarden.operators.ingest import upsert

SHARD = "shard"
BATCH = "batch_id"


def shard_of(key: Column, digits: int = 2) -> Column:
    return F.substring(F.md5(key.cast("string")), 1, digits)


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The Parquet rows under ``path``, or None if nothing was ever written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _replace_partitions(rows: DataFrame, path: str, partition: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


class KeyedTable:
    """Rows of ``schema`` (DDL), unique in ``key``, under ``root``."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, digits: int = 2):
        self.spark, self.key, self.digits = spark, key, digits
        self.columns = spark.createDataFrame([], schema).columns
        self.schema = f"{schema}, {SHARD} STRING"
        self.path, self._staged = f"{root.rstrip('/')}/rows", f"{root.rstrip('/')}/batches"

    def _table(self) -> DataFrame:
        rows = _rows(self.spark, self.path, self.schema)
        return self.spark.createDataFrame([], self.schema) if rows is None else rows

    def read(self) -> DataFrame:
        return self._table().select(*self.columns)

    def for_keys(self, keys: list) -> DataFrame:
        """The rows of a few keys, from their shards alone."""
        shards = [shard_of(F.lit(k), self.digits) for k in keys]
        return self._table().where(F.col(SHARD).isin(*shards) & F.col(self.key).isin(*keys)).select(*self.columns)

    def touched(self, batch: DataFrame) -> DataFrame:
        """All rows of the shards that the keys of ``batch`` fall in. The shards, at most ``16 ** digits``
        short strings, become a filter on the partitions."""
        found = batch.where(F.col(self.key).isNotNull()).select(shard_of(F.col(self.key), self.digits).alias(SHARD)).distinct()
        return self._table().where(F.col(SHARD).isin(*[r[0] for r in found.collect()])).select(*self.columns)

    def apply(self, changed: DataFrame, batch_id: int) -> None:
        """Rows of ``changed`` (unique in the key; rows without one are left out) replace or join those of
        the table. The same batch may be applied again."""
        new = changed.where(F.col(self.key).isNotNull()).select(*self.columns)
        rows = upsert(self.touched(new), new, self.key).withColumn(SHARD, shard_of(F.col(self.key), self.digits))
        self._mark(batch_id, False)
        rows.write.mode("overwrite").partitionBy(SHARD).parquet(f"{self._staged}/{batch_id}/rows")
        self._mark(batch_id, True)
        self.finish(batch_id)

    def _mark(self, batch_id: int, whole: bool) -> None:
        self.spark.range(int(whole)).coalesce(1).write.mode("overwrite").parquet(f"{self._staged}/{batch_id}/whole")

    def finish(self, batch_id: int) -> bool:
        """Puts the shards of a batch that was written whole into the table; False if it was not. Call it
        before a batch that may have run before reads the table."""
        whole = _rows(self.spark, f"{self._staged}/{batch_id}/whole", "id LONG")
        if whole is None or whole.isEmpty():
            return False
        rows = _rows(self.spark, f"{self._staged}/{batch_id}/rows", self.schema)
        _replace_partitions(rows, self.path, SHARD)
        return True

    def archive_to(self, path: str) -> None:
        """Moves every row to ``path``, where nothing may be yet, and leaves this table empty. Whoever
        finds ``path`` there after a failure compares the two before trying again."""
        self.read().write.mode("errorifexists").parquet(path)
        self.spark.createDataFrame([], self.schema).write.mode("overwrite").partitionBy(SHARD).parquet(self.path)


def append_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Adds a batch to the append-only rows under ``path``. Rows of other batches cannot change; the same
    batch again takes the place of its own rows."""
    _replace_partitions(rows.withColumn(BATCH, F.lit(batch_id).cast("long")), path, BATCH)


def appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All appended rows, with their ``batch_id``."""
    whole = f"{schema}, {BATCH} LONG"
    rows = _rows(spark, path, whole)
    return spark.createDataFrame([], whole) if rows is None else rows
