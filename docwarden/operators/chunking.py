"""Splitting documents into deterministic, size-capped chunks.

A document is one row with its sections as an array, so everything here is a narrow projection
followed by two explodes: no shuffle, and nothing depends on how documents are spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docwarden.functions import text as X

DOC_TYPE = "uploaded_document"  # fixed value


def whole_text_section(text: Column, pattern: str = X.PARAGRAPH_BREAK) -> Column:
    """A document without headings: one section without a heading."""
    return F.array(F.struct(F.lit(None).cast("string").alias("heading"), X.paragraphs(text, pattern).alias("paragraphs")))


def headed_sections(lines: Column) -> Column:
    """Sections of an ordered array of ``struct(text, is_heading)``. Each heading opens a
    section; what precedes the first heading belongs to a section without one. Blank lines
    carry nothing, not even as headings."""
    lines = F.filter(
        F.transform(lines, lambda r: F.struct(X.strip(r["text"]).alias("text"), r["is_heading"].alias("is_heading"))),
        lambda r: r["text"] != "",
    )
    return X.let(lines, _cut_at_headings)


def _cut_at_headings(lines: Column) -> Column:
    marks = F.filter(
        F.transform(lines, lambda r, i: F.when(r["is_heading"], i)), lambda i: i.isNotNull()
    )

    def cut(heads):
        def body(first, end):
            return F.transform(F.slice(lines, first + 1, end - first), lambda r: r["text"])

        def section(head, i):
            end = F.coalesce(F.get(heads, i + 1), F.size(lines))
            return F.struct(F.get(lines, head)["text"].alias("heading"), body(head + 1, end).alias("paragraphs"))

        preamble = F.struct(
            F.lit(None).cast("string").alias("heading"),
            body(F.lit(0), F.coalesce(F.get(heads, F.lit(0)), F.size(lines))).alias("paragraphs"),
        )
        return F.concat(F.array(preamble), F.transform(heads, section))

    return X.let(marks, cut)


def non_empty(sections: Column) -> Column:
    return F.filter(sections, lambda s: F.size(s["paragraphs"]) > 0)


def group_documents(docs: DataFrame, *, target_chars: int = X.TARGET_CHARS) -> DataFrame:
    """One row per size group: ``group_index`` counts through the whole document, ``position``
    and ``groups_in_section`` within the section. ``docs`` has an array column ``sections``."""
    sized = docs.withColumn(
        "sections",
        F.transform(non_empty(F.col("sections")), lambda s: F.struct(
            s["heading"].alias("heading"),
            s["paragraphs"].alias("paragraphs"),
            X.greedy_starts(F.transform(s["paragraphs"], F.length), target_chars, len(X.PARAGRAPH_JOIN)).alias("starts"),
        )),
    )

    def groups_of(section):
        texts = X.joined_groups(section["paragraphs"], section["starts"], X.PARAGRAPH_JOIN)
        return F.transform(texts, lambda t, i: F.struct(
            section["heading"].alias("heading"),
            (i + 1).alias("position"),
            F.size(section["starts"]).alias("groups_in_section"),
            t.alias("body"),
        ))

    groups = F.flatten(F.transform("sections", groups_of))
    others = [c for c in docs.columns if c != "sections"]
    # The outer form keeps the optimizer from filtering on the exploded expression beforehand,
    # which would compute it twice.
    exploded = sized.select(*others, F.posexplode_outer(groups).alias("group_index", "g"))
    return exploded.where(F.col("group_index").isNotNull()).select(*others, "group_index", "g.*")


def split_oversized(text: Column, sentences: Column, max_chars: int = X.CHUNK_MAX_CHARS) -> Column:
    """Pieces of an over-long text: whole sentences packed greedily, and fixed slices where a
    piece is still too long. ``sentences`` is NULL for a text that fits."""
    packed = X.joined_groups(sentences, X.greedy_starts(F.transform(sentences, F.length), max_chars, 1), " ")
    pieces = F.when(F.size(sentences) > 1, packed).otherwise(F.array(text))
    cut = F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) <= max_chars, F.array(p)).otherwise(X.hard_slices(p, max_chars))))
    return F.when(sentences.isNull(), F.array(text)).otherwise(cut)


def chunk_documents(
    docs: DataFrame,
    *,
    ingested_at: Column,
    target_chars: int = X.TARGET_CHARS,
    max_chars: int = X.CHUNK_MAX_CHARS,
) -> DataFrame:
    """Chunks of ``docs(file_hash, filename, sections)``, without embeddings.

    Ids come from the file hash and the position in the document, never from the text, so
    chunking the same bytes again gives the same ids. A document without text yields no rows;
    see :func:`empty_documents`."""
    groups = group_documents(docs.select("file_hash", "filename", "sections"), target_chars=target_chars)
    headed = F.coalesce(F.col("heading"), F.lit("")) != ""
    base_label = F.when(headed, F.col("heading")).otherwise(F.col("filename"))
    groups = (
        groups.withColumn("body", F.when(headed, F.concat("heading", F.lit(X.PARAGRAPH_JOIN), "body")).otherwise(F.col("body")))
        .withColumn("label", F.when(F.col("groups_in_section") == 1, base_label)
                    .otherwise(F.concat(base_label, F.lit(" (part "), F.col("position").cast("string"), F.lit(")"))))
        .withColumn("identity", F.concat(F.coalesce("heading", F.lit("")), F.lit("#"), F.col("group_index").cast("string")))
        .withColumn("sentences", F.when(F.length("body") > max_chars, X.sentences(F.col("body"))))
        .withColumn("pieces", split_oversized(F.col("body"), F.col("sentences"), max_chars))
    )
    pieces = groups.select(
        "file_hash", "group_index", "label", "identity",
        F.size("pieces").alias("n"), F.posexplode_outer("pieces").alias("piece_index", "chunk_text"),
    )
    split = F.col("n") > 1
    number = (F.col("piece_index") + 1).cast("string")
    url = F.concat(F.lit("upload://"), F.col("file_hash"))
    identity = F.when(split, F.concat("identity", F.lit(":split"), number)).otherwise(F.col("identity"))
    return pieces.select(
        X.stable_id(url, F.lit(DOC_TYPE), identity).alias("chunk_id"),
        F.lit(DOC_TYPE).alias("doc_type"),
        "chunk_text",
        X.content_hash(F.col("chunk_text")).alias("content_hash"),
        F.when(split, F.concat("label", F.lit(" (split "), number, F.lit("/"), F.col("n").cast("string"), F.lit(")")))
        .otherwise(F.col("label")).alias("section_label"),
        *provenance(url, ingested_at),
        F.lit(None).cast("double").alias("start_seconds"),
        F.lit(None).cast("double").alias("end_seconds"),
        "file_hash", "group_index", "piece_index",
    )


def provenance(source_url: Column, ingested_at: Column, published_date: Column | None = None) -> list[Column]:
    """Where a row came from and when. The date a document was published stays NULL when
    unknown; the ingest time is a parameter of the run."""
    published = F.lit(None) if published_date is None else published_date
    return [
        source_url.alias("source_url"),
        published.cast("date").alias("published_date"),
        ingested_at.alias("retrieval_timestamp"),
    ]


def empty_documents(docs: DataFrame) -> DataFrame:
    """Documents that parse to nothing, with the failure to record for them."""
    reason = F.concat(F.lit("EmptyDocumentError: "), F.col("filename"), F.lit(" has no non-empty paragraph"))
    return docs.where(F.size(non_empty(F.col("sections"))) == 0).select("file_hash", "filename", reason.alias("failure_reason"))


def chunk_problem(chunk_text: Column, max_input_chars: int = X.EMBEDDING_MAX_CHARS) -> Column:
    """NULL for a chunk that can be embedded, else why it cannot."""
    return (
        F.when(X.is_blank(chunk_text), "empty text")
        .when(F.length(chunk_text) > max_input_chars, F.concat(
            F.lit("input text is "), F.length(chunk_text).cast("string"), F.lit(f" chars, over {max_input_chars}")))
    )
