"""Uploaded files: kind, size limits, text extraction."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docwarden.operators.chunking import headed_sections

# Accepted kinds and limits.
EXTENSION_KIND = {".pdf": "pdf", ".docx": "docx", ".txt": "txt"}
CONTENT_TYPE_KIND = {
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "text/plain": "txt",
}
MAX_UPLOAD_BYTES = 20 * 1024 * 1024

# Extracted text of one document that may be put together in one task. A file within the upload
# limit stays far below it unless it is a decompression bomb.
MAX_TEXT_BYTES = 256 * 1024 * 1024


def _lookup(key: Column, table: dict[str, str]) -> Column:
    found = F.lit(None).cast("string")
    for k, v in table.items():
        found = F.when(key == k, v).otherwise(found)
    return found


def file_kind(filename: Column, content_type: Column) -> Column:
    """The file's extension decides; the declared content type only where the extension says
    nothing. NULL for an unsupported file."""
    extension = F.regexp_extract(F.lower(filename), r"[^/](\.[^./]+)$", 1)
    return F.coalesce(_lookup(extension, EXTENSION_KIND), _lookup(F.lower(content_type), CONTENT_TYPE_KIND))


def canonical_content_type(kind: Column) -> Column:
    return _lookup(kind, {v: k for k, v in CONTENT_TYPE_KIND.items()})


def upload_problem(size: Column, kind: Column, declared: Column | None = None, max_bytes: int = MAX_UPLOAD_BYTES) -> Column:
    """First refusal of an upload, or NULL."""
    too_large = f"File exceeds the {max_bytes // (1024 * 1024)}MB upload limit."
    first = F.when(declared > max_bytes, too_large) if declared is not None else F
    return (
        first.when(size == 0, "Uploaded file is empty.")
        .when(size > max_bytes, too_large)
        .when(kind.isNull(), "Unsupported file type — only PDF, DOCX, and TXT files are accepted.")
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, filename, size, content, file_hash`` of the files under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return describe_files(files)


def describe_files(files: DataFrame) -> DataFrame:
    return files.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.col("length").alias("size"),
        "content",
        F.sha2("content", 256).alias("file_hash"),
    )


def decode_text(content: Column) -> Column:
    """UTF-8 text; each invalid sequence becomes U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def extract_pages(files: DataFrame, extractor: Callable[[bytes], Iterable[str]]) -> DataFrame:
    """Page texts of PDF files. ``extractor`` maps a file's bytes to its pages and runs in the
    tasks; a file it cannot read becomes one row with ``error`` set."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for file_hash, content in zip(frame["file_hash"], frame["content"]):
                try:
                    pages = [(file_hash, n, text or "", None) for n, text in enumerate(extractor(bytes(content)))]
                except Exception as exc:  # the file is at fault, not the job
                    pages = [(file_hash, 0, None, f"{type(exc).__name__}: {exc}")]
                rows.extend(pages)
            yield pd.DataFrame(rows, columns=["file_hash", "page", "text", "error"])

    schema = "file_hash string, page long, text string, error string"
    return files.select("file_hash", "content").mapInPandas(run, schema)


def extract_paragraph_rows(
    files: DataFrame, extractor: Callable[[bytes], Iterable[tuple[str, str | None]]]
) -> DataFrame:
    """Paragraphs with their style names, of DOCX files. Same contract as :func:`extract_pages`."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for file_hash, content in zip(frame["file_hash"], frame["content"]):
                try:
                    paras = [(file_hash, n, t, s, None) for n, (t, s) in enumerate(extractor(bytes(content)))]
                except Exception as exc:
                    paras = [(file_hash, 0, None, None, f"{type(exc).__name__}: {exc}")]
                rows.extend(paras)
            yield pd.DataFrame(rows, columns=["file_hash", "pos", "text", "style", "error"])

    schema = "file_hash string, pos long, text string, style string, error string"
    return files.select("file_hash", "content").mapInPandas(run, schema)


def fitting_documents(rows: DataFrame, key: str, max_bytes: int = MAX_TEXT_BYTES) -> tuple[DataFrame, DataFrame]:
    """Splits the rows of many-row documents into those of documents that may be assembled in
    one task, and the list of documents that may not (``key, failure_reason``). Sizes are added
    up by a partial aggregate, so an enormous document is found without being gathered."""
    sizes = rows.groupBy(key).agg(F.sum(F.octet_length("text")).alias("bytes"))
    over = sizes.where(F.col("bytes") > max_bytes)
    reason = F.concat(F.lit("extracted text is "), F.col("bytes").cast("string"), F.lit(f" bytes, over {max_bytes}"))
    return rows.join(over, key, "left_anti"), over.select(key, reason.alias("failure_reason"))


def join_pages(pages: DataFrame, key: str = "file_hash") -> DataFrame:
    """One text per document, pages joined by a newline so that a paragraph may run across a
    page break. ``pages(key, page, text)``, of fitting documents."""
    ordered = F.sort_array(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text"))))
    return pages.groupBy(key).agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("text"))


def docx_sections(rows: DataFrame, key: str = "file_hash") -> DataFrame:
    """``key, sections`` from styled paragraph rows ``(key, pos, text, style)``, of fitting
    documents. A style name that begins with ``Heading`` marks a heading."""
    heading = F.coalesce(F.col("style").startswith("Heading"), F.lit(False))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "text", heading.alias("is_heading"))))
    return rows.groupBy(key).agg(ordered.alias("lines")).select(key, headed_sections(F.col("lines")).alias("sections"))
