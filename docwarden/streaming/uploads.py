"""Uploads as a file stream: the micro-batch form of the background upload task.

A batch reads the new files, refuses what may not be uploaded, skips files the ledger already
shows as completed, chunks the rest, embeds what is new or changed, and rewrites the shards of the
store and the ledger that it touches. Chunk ids depend only on file hash and position, so a batch that
is run again after a failure changes nothing that it had already written."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from docwarden.functions.temporal import at
from docwarden.functions.vectors import EMBEDDING_DIM
from docwarden.operators import chunking as C, ingest as I
from docwarden.operators.grounding import durable
from docwarden.sources import files as S
from docwarden.sources.stores import KeyedTable

_BINARY_FILE = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"


def upload_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """New files under ``folder`` as a stream."""
    return (
        spark.readStream.format("binaryFile").schema(_BINARY_FILE)
        .option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").load(folder)
    )


def document_sections(
    files: DataFrame,
    pdf_pages: Callable[[bytes], Iterable[str]] | None = None,
    docx_paragraphs: Callable[[bytes], Iterable[tuple[str, str | None]]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(file_hash, filename, sections)`` of ``files(file_hash, filename, kind, content)``, and the
    files that could not be read ``(file_hash, failure_reason)``. PDF and DOCX need an extractor."""
    names = files.select("file_hash", "filename")
    txt = files.where(F.col("kind") == "txt").select(
        "file_hash", "filename", C.whole_text_section(S.decode_text(F.col("content"))).alias("sections")
    )
    read, unread = [txt], []

    def extracted(rows: DataFrame, assemble) -> None:
        unread.append(rows.where(F.col("error").isNotNull()).select("file_hash", F.col("error").alias("failure_reason")))
        fitting, over = S.fitting_documents(rows.where(F.col("error").isNull()), "file_hash")
        unread.append(over)
        read.append(assemble(fitting).join(names, "file_hash").select("file_hash", "filename", "sections"))

    for kind, extractor, rows_of, assemble in (
        ("pdf", pdf_pages, S.extract_pages, lambda r: S.join_pages(r).select("file_hash", C.whole_text_section(F.col("text")).alias("sections"))),
        ("docx", docx_paragraphs, S.extract_paragraph_rows, S.docx_sections),
    ):
        of_kind = files.where(F.col("kind") == kind)
        if extractor is None:
            unread.append(of_kind.select("file_hash", F.lit(f"no extractor for {kind} files").alias("failure_reason")))
        else:
            extracted(durable(rows_of(of_kind, extractor)), assemble)
    return _union(read), _union(unread)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ingest_uploads(
    uploads: DataFrame,
    store: KeyedTable,
    ledger: KeyedTable,
    embed: Callable[[list[str]], list[list[float]]],
    now: str,
    batch_id: int,
    *,
    embedding_model: str,
    dim: int = EMBEDDING_DIM,
    pdf_pages=None,
    docx_paragraphs=None,
) -> DataFrame:
    """Ingests one batch of files (``binaryFile`` rows) under the batch id of the stream and returns the
    uploads that were refused (``filename, problem``). What an interrupted run of the same batch had
    begun to put into the store or the ledger is finished first."""
    store.finish(batch_id)
    ledger.finish(batch_id)
    described = S.describe_files(uploads)
    described = described.withColumn("kind", S.file_kind(F.col("filename"), F.lit(None).cast("string")))
    described = described.withColumn("problem", S.upload_problem(F.col("size"), F.col("kind")))
    refused = described.where(F.col("problem").isNotNull()).select("filename", "problem")

    accepted = described.where(F.col("problem").isNull())
    one = I.one_per_key(accepted.select("file_hash", "filename", "kind", "content"), "file_hash", [F.col("filename")])
    wave = one.select(
        "file_hash", "filename", S.canonical_content_type(F.col("kind")).alias("content_type"), at(now).cast("timestamp").alias("at")
    )
    current = ledger.touched(wave)
    columns = current.columns
    begun = durable(I.begin_attempts(current, wave))
    processing = begun.where(F.col("status") == "processing").select(*columns)

    todo = one.join(processing.select("file_hash"), "file_hash", "left_semi")
    docs, unread = document_sections(todo, pdf_pages, docx_paragraphs)
    docs = durable(docs)
    failures = unread.unionByName(C.empty_documents(docs).select("file_hash", "failure_reason"))
    chunks = C.chunk_documents(docs, ingested_at=at(now).cast("timestamp"))
    existing = store.touched(chunks)
    embedded = durable(
        I.embed_changed(I.classify_changes(chunks, existing), embed, dim=dim)
        .withColumns({"embedding_model": F.lit(embedding_model), "embedded_at": at(now).cast("timestamp")})
    )
    changed = embedded.where(F.col("outcome") != "failed").select(existing.columns)
    store.apply(changed, batch_id)

    # Every chunk of a file counts, also those that were already in the store.
    outcomes = chunks.select("file_hash", "chunk_id").join(embedded.select("chunk_id", "outcome"), "chunk_id", "left").select(
        "file_hash", F.coalesce("outcome", F.lit("skipped")).alias("outcome")
    )
    finished = I.finish_attempts(processing, outcomes, at(now).cast("timestamp"))
    why = failures.groupBy("file_hash").agg(F.min("failure_reason").alias("_why"))
    finished = finished.join(why, "file_hash", "left").withColumn("failure_reason", F.coalesce("_why", "failure_reason")).select(*columns)
    ledger.apply(finished, batch_id)
    return refused


def start_ingest(uploads: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs ``handle`` on every micro-batch until the files present are used up."""
    return (
        uploads.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
