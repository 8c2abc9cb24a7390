"""Retrieval on hand-made vectors, and against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docwarden.operators import retrieval as R

DIM = 12
QUERY = [1.0] + [0.0] * (DIM - 1)
CORPUS = "chunk_id string, embedding array<float>, est_tokens long"


def controlled(similarity, axis):
    v = [0.0] * DIM
    v[0], v[axis] = similarity, math.sqrt(max(0.0, 1 - similarity ** 2))
    return v


def at_angle(degrees):
    v = [0.0] * DIM
    v[0], v[1] = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return v


def run(spark, corpus, **options):
    queries = spark.createDataFrame([(1, QUERY)], "query_id long, embedding array<double>")
    return R.retrieve(queries, spark.createDataFrame(corpus, CORPUS), **options).orderBy("rank").collect()


def test_threshold(spark):
    (hit,) = run(spark, [("near", controlled(0.9, 1), 10), ("far", controlled(0.3, 2), 10)])
    assert hit.chunk_id == "near" and abs(hit.similarity - 0.9) < 1e-6
    assert (hit.candidates_considered, hit.above_threshold, hit.deduped_out) == (2, 1, 0)


def test_impossible_threshold_keeps_the_question(spark):
    (row,) = run(spark, [("a", controlled(0.99, 1), 10)], threshold=1.1)
    assert row.chunk_id is None and row.candidates_considered == 1 and row.above_threshold == 0


def test_empty_corpus(spark):
    (row,) = run(spark, [])
    assert row.chunk_id is None and row.candidates_considered == 0


def test_near_duplicate_is_dropped(spark):
    first = math.degrees(math.acos(0.9))
    (hit,) = run(spark, [("a", at_angle(first), 10), ("b", at_angle(first + 3), 10)])
    assert hit.chunk_id == "a" and hit.deduped_out == 1


def test_distinct_rows_stay(spark):
    rows = [("a", at_angle(math.degrees(math.acos(0.9))), 10), ("b", at_angle(math.degrees(math.acos(0.6))), 10)]
    assert [r.chunk_id for r in run(spark, rows)] == ["a", "b"]


def test_dropped_row_suppresses_nothing(spark):
    rows = [("a", at_angle(20), 10), ("b", at_angle(32), 10), ("c", at_angle(44), 10)]
    got = run(spark, rows, dedup_threshold=math.cos(math.radians(13)))
    assert [r.chunk_id for r in got] == ["a", "c"] and got[0].deduped_out == 1


def test_budget_stops_at_first_overflow(spark):
    rows = [("a", controlled(0.9, 1), 2000), ("b", controlled(0.85, 2), 2000), ("c", controlled(0.8, 3), 10)]
    (hit,) = run(spark, rows, max_tokens=3000)
    assert hit.chunk_id == "a" and hit.context_tokens == 2000


def test_oversize_first_row_stays(spark):
    (hit,) = run(spark, [("a", controlled(0.9, 1), 5000)], max_tokens=1000)
    assert hit.context_tokens == 5000


def test_null_and_zero_vectors(spark):
    rows = [("null", None, 1), ("zero", [0.0] * DIM, 1), ("nan", [float("nan")] + [0.0] * (DIM - 1), 1), ("a", controlled(0.9, 1), 1)]
    (hit,) = run(spark, rows)
    assert hit.chunk_id == "a" and hit.candidates_considered == 3 and hit.above_threshold == 1


def test_wrong_length_is_an_error(spark):
    with pytest.raises(Exception, match="vector length"):
        run(spark, [("a", [1.0, 2.0], 1)])


def brute_force(queries, corpus, k):
    out = {}
    for q, qv in queries:
        scored = []
        for c, cv in corpus:
            d, a, b = 0.0, 0.0, 0.0
            for x, y in zip(qv, cv):
                d, a, b = d + x * y, a + x * x, b + y * y
            scored.append((-(d / math.sqrt(a * b)), c))
        out[q] = [c for _, c in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("block", [4096, 8])
def test_top_k_matches_brute_force_with_many_copies(spark, monkeypatch, block):
    """A third of the corpus is one vector; several question blocks; many small Arrow batches."""
    monkeypatch.setattr(R, "MAX_QUERY_ROWS", block)
    rng = random.Random(3)
    vector = lambda: [float(rng.randint(-3, 3)) for _ in range(DIM - 1)] + [1.0]
    copy = vector()
    corpus = [(f"c{i:04d}", copy if i % 3 == 0 else vector()) for i in range(900)]
    rng.shuffle(corpus)
    queries = [(i, vector()) for i in range(20)] + [(20, copy)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        hits = R.top_k(
            spark.createDataFrame(queries, "query_id long, embedding array<double>"),
            spark.createDataFrame(corpus, "chunk_id string, embedding array<float>").repartition(5), 15,
        ).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    got = {}
    for h in sorted(hits, key=lambda h: h["rank"]):
        got.setdefault(h.query_id, []).append(h.chunk_id)
    assert got == brute_force(queries, corpus, 15)


def test_random_pipeline_matches_loop(spark):
    rng = random.Random(11)
    corpus = [(f"c{i:03d}", [rng.gauss(0, 1) for _ in range(DIM)], rng.randint(1, 400)) for i in range(300)]
    # Float storage rounds; the model must see the stored values.
    df = spark.createDataFrame(corpus, CORPUS)
    stored = {r.chunk_id: (r.embedding, r.est_tokens) for r in df.collect()}
    queries = [(i, [rng.gauss(0, 1) for _ in range(DIM)]) for i in range(6)]
    got = R.retrieve(
        spark.createDataFrame(queries, "query_id long, embedding array<double>"), df, threshold=0.2, dedup_threshold=4.0, pool=25, max_tokens=1500
    )
    chosen = {}
    for r in sorted(got.collect(), key=lambda r: r["rank"] or 0):
        chosen.setdefault(r.query_id, []).append(r.chunk_id)
    ranked = brute_force(queries, [(c, v) for c, (v, _) in stored.items()], 25)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for q, qv in queries:
        kept = []
        for c in ranked[q]:
            v = stored[c][0]
            if dot(qv, v) / math.sqrt(dot(qv, qv) * dot(v, v)) >= 0.2 and not any(dot(v, stored[o][0]) >= 4.0 for o in kept):
                kept.append(c)
        context, total = [], 0
        for c in kept:
            if context and total + stored[c][1] > 1500:
                break
            context.append(c)
            total += stored[c][1]
        assert chosen[q] == (context or [None])


def test_relevant_rejects_nan_and_null(spark):
    df = spark.createDataFrame([(0.5,), (float("nan"),), (None,), (0.49,)], "s double")
    assert [r[0] for r in df.select(R.relevant(F.col("s"), 0.5)).collect()] == [True, False, False, False]


def test_similarity_reads_only_what_it_needs(spark, tmp_path):
    path = str(tmp_path / "corpus")
    spark.range(10).select(
        F.col("id").cast("string").alias("chunk_id"), F.array(F.lit(1.0).cast("float")).alias("embedding"), F.lit("t").alias("chunk_text")
    ).write.parquet(path)
    question = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>")
    texts = [R.top_k(question, spark.read.parquet(path), 3)._jdf.queryExecution().executedPlan().toString(),
             R.nearest(question, spark.read.parquet(path), 3)._jdf.queryExecution().executedPlan().toString()]
    assert all("chunk_text" not in t and "IsNotNull(embedding)" in t for t in texts) and "WindowGroupLimit" in texts[1]


def _random_vectors(n, seed, width=8):
    return np.random.default_rng(seed).normal(size=(n, width)).astype(np.float32)


def _as_rows(spark, vectors, name, parts):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>").repartition(parts)


def test_lower_bounds_keep_rows_in_their_tasks(spark, monkeypatch):
    """Without bounds 40 tasks would send 400 rows a question; a tenth of the corpus bounds that to about ten times k."""
    monkeypatch.setattr(R, "SAMPLE_ROWS", 50)
    corpus, asked = _as_rows(spark, _random_vectors(20_000, 1), "chunk_id", 40), _as_rows(spark, _random_vectors(5, 2), "query_id", 1)
    left = R.local_winners(asked, corpus, 10)
    assert left.columns == ["query_id", "similarity", "chunk_id"]
    sent = left.count()
    assert 5 * 10 <= sent <= 5 * 150
    monkeypatch.setattr(R, "SAMPLE_ROWS", 500)  # every row: the bound is the k-th best itself
    assert R.local_winners(asked, corpus, 10).count() == 50


def test_many_questions_never_pass_through_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    def refuse(self):
        raise AssertionError("collected")

    questions, vectors = _random_vectors(10_000, 3), _random_vectors(3_000, 4)
    asked, corpus = _as_rows(spark, questions, "query_id", 4), _as_rows(spark, vectors, "chunk_id", 4)
    monkeypatch.setattr(DataFrame, "toArrow", refuse)
    monkeypatch.setattr(R, "SPLIT_ROWS", 700)
    got = R.nearest(asked, corpus, 5).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "similarity"))).alias("hits"))
    rows = got.limit(20_000).collect()
    a, b = questions.astype(float), vectors.astype(float)
    scores = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    best = np.sort(scores, axis=1)[:, ::-1][:, :5]
    assert len(rows) == 10_000
    for r in rows:
        assert [h.rank for h in r.hits] == [1, 2, 3, 4, 5]
        assert np.allclose([h.similarity for h in r.hits], best[r.query_id]) and np.allclose([scores[r.query_id, h.chunk_id] for h in r.hits], best[r.query_id])
