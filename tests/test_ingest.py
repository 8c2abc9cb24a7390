"""Change classification, failures, upsert and the upload ledger."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from docwarden.functions.text import content_hash
from docwarden.operators import ingest as I

CHUNK = "chunk_id string, chunk_text string, section_label string"


def incoming(spark, *rows):
    return spark.createDataFrame(rows, CHUNK).withColumn("content_hash", content_hash(F.col("chunk_text")))


def test_classification_and_upsert(spark):
    store = incoming(spark, ("same", "t", "old"), ("changed", "before", "old"), ("null", "t", "old"), ("other", "t", "old"))
    store = store.withColumn("content_hash", F.when(F.col("chunk_id") != "null", F.col("content_hash")))
    new = incoming(spark, ("same", "t", "new"), ("changed", "after", "new"), ("null", "t", "new"), ("fresh", "t", "new"))
    c = I.classify_changes(new, store)
    assert {r.chunk_id: r.outcome for r in c.collect()} == {"same": "skipped", "changed": "updated", "null": "updated", "fresh": "inserted"}
    after = I.upsert(store, c.where("outcome <> 'skipped'"))
    assert {r.chunk_id: (r.chunk_text, r.section_label) for r in after.collect()} == {
        "same": ("t", "old"), "other": ("t", "old"), "changed": ("after", "new"), "null": ("t", "new"), "fresh": ("t", "new")}
    again = I.classify_changes(new, after)
    assert {r.outcome for r in again.collect()} == {"skipped"}
    counts = I.outcome_counts(c).first()
    assert (counts.inserted, counts.updated, counts.skipped, counts.failed, counts.total) == (1, 2, 1, 0, 4)


def test_one_bad_item_fails_alone(spark):
    def embed(texts):
        if any("bad" in t for t in texts):
            raise ValueError("refused")
        return [[1.0, 2.0] if "short" not in t else [1.0] for t in texts]

    new = incoming(spark, ("a", "fine", None), ("b", "bad", None), ("c", "fine too", None), ("d", "short", None), ("e", "z" * 24_001, None), ("f", " ", None))
    empty = new.limit(0)
    done = I.embed_changed(I.classify_changes(new, empty), embed, dim=2)
    got = {r.chunk_id: r for r in done.collect()}
    assert {k: r.outcome for k, r in got.items()} == {"a": "inserted", "b": "failed", "c": "inserted", "d": "failed", "e": "failed", "f": "failed"}
    assert got["b"].error == "ValueError: refused" and got["d"].error == "expected 2 values, got 1"
    assert list(got["a"].embedding) == [1.0, 2.0]
    assert {r.chunk_id for r in I.failed_chunks(done).collect()} == {"b", "d", "e", "f"}


def test_skipped_rows_are_not_embedded(spark):
    def embed(texts):
        raise AssertionError("must not be called")

    rows = incoming(spark, ("a", "t", None))
    assert I.embed_changed(I.classify_changes(rows, rows), embed).count() == 0


def test_one_per_key_with_a_hot_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("v"))
    got = I.one_per_key(rows, "k", [-F.col("v")])
    assert got.where("k = 'hot'").first().v == 2999 and got.count() == 1001


def fold(attempts):
    """The ledger as a loop over attempts."""
    rows, answers = {}, {}
    for a in sorted(attempts, key=lambda a: (a[4], a[1])):
        h = a[0]
        old = rows.get(h)
        if old and old["status"] == "completed":
            answers[a[1]] = "completed"
            continue
        answers[a[1]] = "processing"
        rows[h] = {
            "name": a[2], "status": a[5], "reason": a[6] if a[5] == "failed" else None, "chunks": a[7] if a[5] == "completed" else None,
            "first": old["first"] if old else a[4], "done": a[8] if a[5] == "completed" else None,
        }
    return rows, answers


def test_ledger_matches_loop(spark):
    rng = random.Random(5)
    t0 = datetime(2024, 1, 1)
    attempts = []
    for n in range(600):
        h = "hot" if n % 3 == 0 else f"h{rng.randint(0, 60)}"
        outcome = rng.choice(["completed", "failed", "failed", "processing"]) if h != "hot" or n > 400 else rng.choice(["failed", "processing"])
        at = t0 + timedelta(minutes=rng.randint(0, 500))
        attempts.append((h, n, f"f{n}", "text/plain", at, outcome, f"r{n}", n, at + timedelta(seconds=9)))
    df = spark.createDataFrame(attempts, """file_hash string, attempt_id long, filename string, content_type string, at timestamp, outcome string,
        failure_reason string, chunk_count int, finished_at timestamp""")
    rows, answers = fold(attempts)
    for r in I.ledger(df).collect():
        assert (r.original_filename, r.status, r.failure_reason, r.chunk_count, r.uploaded_at, r.completed_at) == tuple(rows[r.file_hash].values())
    assert {r.attempt_id: r.response for r in I.attempt_responses(df).collect()} == answers


LEDGER = """file_hash string, original_filename string, content_type string, status string, failure_reason string, chunk_count int,
    uploaded_at timestamp, completed_at timestamp"""


def test_begin_and_finish(spark):
    old, now = datetime(2024, 1, 1), datetime(2024, 1, 2)
    current = spark.createDataFrame([
        ("done", "old.txt", "text/plain", "completed", None, 4, old, old), ("failed", "old.txt", "text/plain", "failed", "because", None, old, None),
        ("stuck", "old.txt", "text/plain", "processing", None, None, old, None)], LEDGER)
    uploads = spark.createDataFrame([(h, "new.txt", "text/plain", now) for h in ("done", "failed", "stuck", "fresh")],
                                    "file_hash string, filename string, content_type string, at timestamp")
    got = {r.file_hash: r for r in I.begin_attempts(current, uploads).collect()}
    assert {h: (r.status, r.http_status, r.original_filename, r.uploaded_at) for h, r in got.items()} == {
        "done": ("completed", 200, "old.txt", old), "failed": ("processing", 202, "new.txt", old),
        "stuck": ("processing", 202, "new.txt", old), "fresh": ("processing", 202, "new.txt", now)}
    assert got["failed"].previous_failure_reason == "because" and got["done"].chunk_count == 4 and got["failed"].failure_reason is None

    processing = I.begin_attempts(current, uploads).where("status = 'processing'").select(current.columns)
    outcomes = spark.createDataFrame([("fresh", "inserted"), ("fresh", "skipped"), ("failed", "inserted"), ("failed", "failed")], "file_hash string, outcome string")
    end = {r.file_hash: r for r in I.finish_attempts(processing, outcomes, F.lit(now)).collect()}
    assert (end["fresh"].status, end["fresh"].chunk_count, end["fresh"].completed_at) == ("completed", 2, now)
    assert (end["failed"].status, end["failed"].failure_reason) == ("failed", "1/2 chunk(s) failed to embed/insert")
    assert end["stuck"].status == "failed" and end["stuck"].chunk_count is None
