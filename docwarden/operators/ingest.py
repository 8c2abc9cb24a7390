"""Idempotent ingest: change classification, embedding, upsert, outcomes, upload ledger."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from docwarden.functions.vectors import EMBEDDING_DIM, invalid_vector_reason
from docwarden.operators.chunking import chunk_problem
from docwarden.operators.grounding import RetryPolicy


def one_per_key(rows: DataFrame, key: str, prefer: list[Column]) -> DataFrame:
    """One row per key, the one with the smallest ``prefer`` values. An aggregate rather than a
    ranked window: copies of one key meet in the map-side combine, however many there are."""
    others = [c for c in rows.columns if c != key]
    order = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(prefer)])
    return rows.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("_row")).select(key, "_row.*")


def classify_changes(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds ``outcome`` to incoming chunks: ``inserted`` for a new id, ``skipped`` for an equal
    content hash, ``updated`` otherwise (a stored NULL hash included). Both sides are unique in
    ``chunk_id``; of the store only the id and the hash are read."""
    stored = existing.select("chunk_id", F.col("content_hash").alias("_stored"), F.lit(True).alias("_known"))
    outcome = (
        F.when(F.col("_known").isNull(), "inserted")
        .when(F.col("_stored") == F.col("content_hash"), "skipped")
        .otherwise("updated")
    )
    return incoming.join(stored, "chunk_id", "left").withColumn("outcome", outcome).drop("_stored", "_known")


def embed_changed(
    classified: DataFrame,
    embed: Callable[[list[str]], list[list[float]]],
    *,
    dim: int = EMBEDDING_DIM,
    batch_size: int = 64,
    policy: RetryPolicy = RetryPolicy(),
) -> DataFrame:
    """Embeds the chunks that are new or changed. ``embed`` maps texts to vectors and runs in the
    tasks, on up to ``batch_size`` texts at once. What ``policy`` calls retryable is tried again with
    growing pauses; if it lasts, a lost connection ends the job and anything else fails the batch. On
    any other error each text of the batch is tried by itself, so that one bad text fails alone. Adds ``embedding`` and ``error``; rows with an error,
    or with a vector of the wrong shape, become ``failed``.

    A task that is run again calls ``embed`` again. Write the result, or checkpoint it, before
    anything else reads it, so that a paid model is not called once per use."""
    todo = classified.where(F.col("outcome") != "skipped").withColumn("error", chunk_problem(F.col("chunk_text")))

    def vectors_of(texts: list[str]) -> list[tuple]:
        try:
            vectors = list(policy.call(embed, texts))
            if len(vectors) != len(texts):
                raise ValueError(f"expected {len(texts)} embeddings, got {len(vectors)}")
            return [(v, None) for v in vectors]
        except ConnectionError:
            raise
        except Exception as exc:
            if len(texts) == 1 or isinstance(exc, policy.retryable):
                return [(None, f"{type(exc).__name__}: {exc}")] * len(texts)
            return [vectors_of([t])[0] for t in texts]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start:start + batch_size].copy()
                fit = part["error"].isna().to_numpy()
                done = iter(vectors_of(part["chunk_text"][fit].tolist()) if fit.any() else ())
                results = [next(done) if ok else (None, error) for ok, error in zip(fit, part["error"])]
                part["embedding"], part["error"] = [v for v, _ in results], [e for _, e in results]
                yield part[order]

    fields = [f for f in todo.schema.fields if f.name != "error"]
    order = [f.name for f in fields] + ["embedding", "error"]
    added = [T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())]
    embedded = todo.mapInPandas(run, T.StructType(fields + added))
    error = F.coalesce("error", invalid_vector_reason(F.col("embedding"), dim))
    checked = embedded.withColumn("error", error)
    return checked.withColumn("outcome", F.when(F.col("error").isNotNull(), "failed").otherwise(F.col("outcome")))


def outcome_counts(classified: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``inserted, updated, skipped, failed, total`` per ``by`` (or overall)."""
    def n(name):
        return F.count_if(F.col("outcome") == name).alias(name)
    return classified.groupBy(*(by or [])).agg(
        n("inserted"), n("updated"), n("skipped"), n("failed"), F.count("*").alias("total")
    )


def failed_chunks(classified: DataFrame) -> DataFrame:
    """Ids of the chunks that failed, as rows: their number has no bound."""
    return classified.where(F.col("outcome") == "failed").select("chunk_id", "error")


def upsert(existing: DataFrame, changed: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``existing`` after a batch: rows of ``changed`` replace rows with the same key, in every column.
    ``sources.stores`` applies it to the shards of a stored table that a batch touches."""
    kept = existing.join(changed.select(key), key, "left_anti")
    return kept.select(existing.columns).unionByName(changed.select(existing.columns))


def insert_if_absent(existing: DataFrame, proposed: DataFrame, key: str, must_match: list[str]) -> DataFrame:
    """Insert-or-ignore, then look again: each proposed row with ``inserted`` and ``usable``.
    A proposal is usable if it was inserted, or if the row already there agrees on
    ``must_match``."""
    there = existing.select(key, F.struct(*must_match).alias("_there"))
    joined = proposed.join(there, key, "left")
    inserted = F.col("_there").isNull()
    same = F.lit(True)
    for c in must_match:
        same = same & F.col(c).eqNullSafe(F.col("_there")[c])
    return joined.select(*proposed.columns, inserted.alias("inserted"), (inserted | same).alias("usable"))


# --- upload ledger ---------------------------------------------------------


def ledger(attempts: DataFrame) -> DataFrame:
    """State of the upload ledger after all attempts.

    ``attempts(file_hash, attempt_id, filename, content_type, at, outcome, failure_reason,
    chunk_count, finished_at)``; ``outcome`` is what processing this attempt leads to
    (``completed``, ``failed``, or ``processing`` if it never ended).

    The first completed attempt settles a file: later attempts are answered from the ledger and
    change nothing. Until then each attempt starts over and the last one shows. ``uploaded_at`` is
    when the file was first seen. Three mergeable aggregates give all of this, so a file uploaded
    any number of times needs no ordered group."""
    order = F.struct("at", "attempt_id")
    row = F.struct("filename", "content_type", "outcome", "failure_reason", "chunk_count", "finished_at")
    done = F.col("outcome") == "completed"
    state = attempts.groupBy("file_hash").agg(
        F.min("at").alias("uploaded_at"),
        F.min_by(F.when(done, row), F.when(done, order)).alias("settled"),
        F.max_by(row, order).alias("latest"),
        F.count("*").alias("attempts"),
    ).withColumn("r", F.coalesce("settled", "latest"))
    status = F.col("r.outcome")
    return state.select(
        "file_hash",
        F.col("r.filename").alias("original_filename"),
        F.col("r.content_type").alias("content_type"),
        status.alias("status"),
        F.when(status == "failed", F.col("r.failure_reason")).alias("failure_reason"),
        F.when(status == "completed", F.col("r.chunk_count")).alias("chunk_count"),
        "uploaded_at",
        F.when(status == "completed", F.col("r.finished_at")).alias("completed_at"),
        "attempts",
    )


def attempt_responses(attempts: DataFrame) -> DataFrame:
    """What each attempt is answered: ``200 completed`` once the file is settled, else
    ``202 processing``. Adds ``response`` and ``http_status``."""
    order = F.struct("at", "attempt_id")
    settled = attempts.where(F.col("outcome") == "completed").groupBy("file_hash").agg(F.min(order).alias("_settled"))
    late = F.coalesce(F.struct("at", "attempt_id") > F.col("_settled"), F.lit(False))
    return (
        attempts.join(settled, "file_hash", "left")
        .withColumn("response", F.when(late, "completed").otherwise("processing"))
        .withColumn("http_status", F.when(late, 200).otherwise(202).cast("long"))
        .drop("_settled")
    )


def begin_attempts(current: DataFrame, uploads: DataFrame) -> DataFrame:
    """One wave of uploads, at most one per file, against the current ledger: the ledger row each
    upload leaves behind, the answer it gets, and the failure reason of the attempt before.

    ``uploads(file_hash, filename, content_type, at)``."""
    now = current.select("file_hash", F.struct(*[c for c in current.columns if c != "file_hash"]).alias("old"))
    j = uploads.join(now, "file_hash", "left")
    done = F.coalesce(F.col("old.status") == "completed", F.lit(False))

    def pick(name, fresh):
        return F.when(done, F.col(f"old.{name}")).otherwise(fresh).alias(name)

    return j.select(
        "file_hash",
        pick("original_filename", F.col("filename")),
        F.when(done, F.col("old.content_type")).otherwise(F.col("content_type")).alias("content_type"),
        F.when(done, "completed").otherwise("processing").alias("status"),
        F.lit(None).cast("string").alias("failure_reason"),
        pick("chunk_count", F.lit(None).cast("int")),
        F.coalesce("old.uploaded_at", "at").alias("uploaded_at"),
        pick("completed_at", F.lit(None).cast(current.schema["completed_at"].dataType)),
        F.when(F.col("old.status") == "failed", F.col("old.failure_reason")).alias("previous_failure_reason"),
        F.when(done, 200).otherwise(202).cast("long").alias("http_status"),
    )


def finish_attempts(processing: DataFrame, outcomes: DataFrame, finished_at: Column) -> DataFrame:
    """Closes ``processing`` ledger rows from chunk outcomes ``(file_hash, outcome)``. One failed
    chunk fails the file; the chunks that succeeded stay in the store. A file that produced no
    chunk row at all fails as well."""
    per_file = outcome_counts(outcomes, ["file_hash"])
    failed, total = F.coalesce("failed", F.lit(0)), F.coalesce("total", F.lit(0))
    reason = (
        F.when(total == 0, "no chunk was produced")
        .when(failed > 0, F.concat(failed.cast("string"), F.lit("/"), total.cast("string"), F.lit(" chunk(s) failed to embed/insert")))
    )
    j = processing.join(per_file, "file_hash", "left").withColumn("_reason", reason)
    ok = F.col("_reason").isNull()
    return (
        j.withColumn("status", F.when(ok, "completed").otherwise("failed"))
        .withColumn("failure_reason", F.col("_reason"))
        .withColumn("chunk_count", F.when(ok, F.col("total")).cast("int"))
        .withColumn("completed_at", F.when(ok, finished_at))
        .select(processing.columns)
    )
