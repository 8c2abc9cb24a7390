"""The cell index finds what the full scan finds, reading less."""

import random

import numpy as np
from pyspark.sql import functions as F

from docwarden.operators import retrieval as R, vector_index as VI


def test_index_gives_the_same_hits_from_fewer_cells(spark, tmp_path):
    rng = random.Random(9)
    dim, centres = 8, []
    for c in range(12):
        v = [0.0] * dim
        v[c % dim] = 1.0 if c < dim else -1.0
        centres.append(v)
    rows = []
    for n in range(1500):
        # A third of the rows are copies of one vector.
        base = centres[0] if n % 3 == 0 else centres[rng.randrange(12)]
        noise = 0.0 if n % 3 == 0 else 0.15
        rows.append((f"c{n:04d}", [x + rng.gauss(0, noise) for x in base]))
    rows += [("zero", [0.0] * dim), ("null", None)]
    corpus = spark.createDataFrame(rows, "chunk_id string, embedding array<float>").repartition(4)
    queries = spark.createDataFrame([(0, centres[0]), (1, centres[3])], "query_id int, embedding array<double>")

    centroids = VI.train_centroids(corpus, 12)
    VI.write_index(VI.assign_cells(corpus, centroids), str(tmp_path / "index"))
    index = VI.read_index(spark, str(tmp_path / "index"))
    widths = VI.cell_widths(index)
    vectors = np.array([centres[0], centres[3]])
    for threshold in (0.8, 0.5, 0.0):
        want = R.top_k(queries, corpus, 20).where(R.relevant(F.col("similarity"), threshold))
        got = VI.relevant_hits(queries, index, centroids, widths, threshold=threshold, k=20)
        key = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, r.similarity) for r in df.collect())
        assert key(got) == key(want)
    assert len(VI.cells_to_read(vectors, centroids, widths, 0.8)) < len(widths)
    plan = VI.relevant_hits(queries, index, centroids, widths, threshold=0.8, k=20)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
