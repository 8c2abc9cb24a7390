"""Keyed tables that batches change shard by shard, and append-only rows."""

from pathlib import Path

import pytest
from pyspark.errors import AnalysisException

from docwarden.sources import stores
from docwarden.sources.stores import KeyedTable

SCHEMA = "id string, v string"


def rows_of(df):
    return sorted((r.id, r.v) for r in df.collect())


def files_of(table):
    return {p.relative_to(table.path): p.stat().st_mtime_ns for p in Path(table.path).rglob("*.parquet")}


@pytest.fixture
def table(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "id", digits=1)
    t.apply(spark.createDataFrame([(str(k), "old") for k in range(100)], SCHEMA), 0)
    return t


def test_rows_replace_and_join(spark, table):
    table.apply(spark.createDataFrame([("3", "new"), ("x", None), (None, "nobody")], SCHEMA), 1)
    assert rows_of(table.read()) == sorted([(str(k), "new" if k == 3 else "old") for k in range(100)] + [("x", None)])
    assert rows_of(table.for_keys(["3", "x", "none"])) == [("3", "new"), ("x", None)]


def test_a_batch_of_one_shard_rewrites_one(spark, table):
    before = files_of(table)
    table.apply(spark.createDataFrame([("3", "new")], SCHEMA), 1)
    after = files_of(table)
    gone = {p.parts[0] for p in before if after.get(p) != before[p]}
    assert len(gone) == 1 and {p.parts[0] for p in after if p not in before} == gone and len({p.parts[0] for p in before}) == 16


def test_shards_are_pruned_in_the_plan(spark, table):
    touched = table.touched(spark.createDataFrame([("3", "new")], SCHEMA))
    plan = touched._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan and touched.count() < 100
    assert "PartitionFilters: [" in (p := table.for_keys(["3"])._jdf.queryExecution().executedPlan().toString()) and "shard" in p


def test_an_interrupted_batch_is_finished(spark, table, monkeypatch):
    change = spark.createDataFrame([(str(k), "new") for k in range(50)], SCHEMA)

    def die(rows, path, partition):
        """Loses a shard of the batch, as a job that ends between removing and renaming it does."""
        for file in Path(path, f"{partition}={rows.first()[partition]}").glob("*"):
            file.unlink()
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(stores, "_replace_partitions", die)
        with pytest.raises(RuntimeError):
            table.apply(change, 1)
    assert table.read().count() < 100
    assert table.finish(1) and rows_of(table.read()) == sorted((str(k), "new" if k < 50 else "old") for k in range(100))
    table.apply(change, 1)
    assert table.read().count() == 100


def test_a_batch_not_written_whole_changes_nothing(spark, table):
    before = rows_of(table.read())
    spark.createDataFrame([("3", "half", "0")], table.schema).write.parquet(f"{table._staged}/1/rows")
    assert not table.finish(1) and rows_of(table.read()) == before


def test_no_rows(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "id")
    assert t.read().isEmpty() and t.read().columns == ["id", "v"] and not t.finish(0)
    t.apply(spark.createDataFrame([], SCHEMA), 0)
    assert t.read().isEmpty()


def test_archive(spark, tmp_path, table):
    table.archive_to(str(tmp_path / "old"))
    assert table.read().isEmpty() and spark.read.parquet(str(tmp_path / "old")).count() == 100
    table.apply(spark.createDataFrame([("1", "again")], SCHEMA), 2)
    assert rows_of(table.read()) == [("1", "again")]
    with pytest.raises(AnalysisException):
        table.archive_to(str(tmp_path / "old"))
    assert rows_of(table.read()) == [("1", "again")]


def test_appended_batches(spark, tmp_path):
    log = str(tmp_path / "log")
    assert stores.appended(spark, log, SCHEMA).isEmpty()
    stores.append_batch(spark.createDataFrame([("1", "x")], SCHEMA), log, 0)
    for _ in range(2):  # a task or batch that runs again
        stores.append_batch(spark.createDataFrame([("2", "y"), ("2", "y")], SCHEMA), log, 1)
    assert sorted((r.id, r.batch_id) for r in stores.appended(spark, log, SCHEMA).collect()) == [("1", 0), ("2", 1), ("2", 1)]
