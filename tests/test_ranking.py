"""Places within groups of any size."""

import random

from pyspark.sql import functions as F

from docwarden.operators.ranking import ranked


def test_one_group_is_cut_into_many(spark):
    rng = random.Random(3)
    rows = [("big" if n % 3 else rng.choice(["a", "b", None]), rng.randrange(50), n) for n in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, id int").repartition(7)
    got = {r.id: r.rank for r in ranked(df, "k", [F.col("v").desc(), F.col("id")]).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        for place, (_, _, n) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2])), 1):
            want[n] = place
    assert got == want


def test_no_rows(spark):
    none = ranked(spark.createDataFrame([], "k string, id int"), "k", [F.col("id")])
    assert none.isEmpty() and none.columns == ["k", "id", "rank"]


def test_no_global_sort_and_no_window_over_the_key_alone(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, id int")
    plan = ranked(df, "k", [F.col("id")])._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan and "row_number() windowspecdefinition(k#" in plan and ", _range#" in plan
