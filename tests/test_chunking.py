"""Chunker cases with their expected values, and a randomized comparison with a Python model."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from docwarden.functions import text as X
from docwarden.functions.temporal import at
from docwarden.operators import chunking as C
from docwarden.sources import files
from test_text import model_groups, texts

HASH = "deadbeef" * 8


def chunk(spark, text=None, sections=None, **options):
    if sections is None:
        df = spark.createDataFrame([(HASH, "f.txt", text)], "file_hash string, filename string, text string")
        df = df.select("file_hash", "filename", C.whole_text_section(F.col("text")).alias("sections"))
    else:
        df = spark.createDataFrame(
            [(HASH, "f.docx", sections)], "file_hash string, filename string, sections array<struct<heading: string, paragraphs: array<string>>>"
        )
    options.setdefault("ingested_at", at("2026-01-01 00:00:00"))
    return C.chunk_documents(df, **options).orderBy("group_index", "piece_index").collect()


def test_short_paragraphs_become_one_chunk(spark):
    (c,) = chunk(spark, "One.\n\nTwo.\n\nThree.")
    assert c.chunk_text == "One.\n\nTwo.\n\nThree." and c.section_label == "f.txt" and c.source_url == f"upload://{HASH}"
    assert c.published_date is None and c.start_seconds is None and c.doc_type == "uploaded_document"
    assert c.content_hash == hashlib.sha256(c.chunk_text.encode()).hexdigest()


def test_grouping_and_labels(spark):
    paragraphs = [str(i) * 100 for i in range(5)]
    got = chunk(spark, "\n\n".join(paragraphs), target_chars=250)
    assert [c.chunk_text.count("\n\n") + 1 for c in got] == [2, 2, 1]
    assert [c.section_label for c in got] == ["f.txt (part 1)", "f.txt (part 2)", "f.txt (part 3)"]


def test_long_paragraph_stays_whole_and_alone(spark):
    (only,) = chunk(spark, "x" * 3000)
    assert len(only.chunk_text) == 3000
    assert [len(c.chunk_text) for c in chunk(spark, "x" * 3000 + "\n\nshort")] == [3000, 5]


def test_headings(spark):
    got = chunk(spark, sections=[(None, ["Before."]), ("Intro", ["A.", "B."]), ("Empty", []), ("Details", ["C."])])
    assert [c.chunk_text for c in got] == ["Before.", "Intro\n\nA.\n\nB.", "Details\n\nC."]
    assert [c.section_label for c in got] == ["f.docx", "Intro", "Details"]
    assert [c.group_index for c in got] == [0, 1, 2]


def test_long_section_is_labelled_by_part(spark):
    got = chunk(spark, sections=[("Big Section", [str(i) * 100 for i in range(5)])], target_chars=250)
    assert [c.section_label for c in got] == [f"Big Section (part {n})" for n in (1, 2, 3)]
    assert all(c.chunk_text.startswith("Big Section\n\n") for c in got)


@pytest.mark.parametrize("text", ["", "  \n\n \t", "　"])
def test_blank_document_has_no_chunks_and_is_reported(spark, text):
    assert chunk(spark, text) == []
    df = spark.createDataFrame([(HASH, "f.txt", text)], "file_hash string, filename string, text string")
    (r,) = C.empty_documents(df.select("file_hash", "filename", C.whole_text_section(F.col("text")).alias("sections"))).collect()
    assert r.failure_reason.startswith("EmptyDocumentError")


def test_identity(spark):
    first, again = chunk(spark, "Same.\n\nText."), chunk(spark, "Same.\n\nText.")
    assert [c.chunk_id for c in first] == [c.chunk_id for c in again]
    want = hashlib.sha256(f"upload://{HASH}\x1fuploaded_document\x1f#0".encode()).hexdigest()[:32]
    assert first[0].chunk_id == want


def test_sentence_split(spark):
    text = " ".join(f"This is sentence number {i} of a very long paragraph." for i in range(800))
    assert len(text) > 23_500
    got = chunk(spark, text)
    assert len(got) > 1
    assert all(len(c.chunk_text) <= 23_500 and c.chunk_text.endswith(".") for c in got)
    assert [c.section_label for c in got] == [f"f.txt (split {i}/{len(got)})" for i in range(1, len(got) + 1)]
    assert " ".join(c.chunk_text for c in got) == text
    assert got[0].chunk_id == hashlib.sha256(f"upload://{HASH}\x1fuploaded_document\x1f#0:split1".encode()).hexdigest()[:32]


def test_hard_split_without_boundary(spark):
    text = "x" * 24_500
    got = chunk(spark, text)
    assert [len(c.chunk_text) for c in got] == [23_500, 1_000] and "".join(c.chunk_text for c in got) == text


def test_below_ceiling_is_untouched(spark):
    (c,) = chunk(spark, "y" * 23_400)
    assert c.section_label == "f.txt"


def model_pieces(text, limit):
    if len(text) <= limit:
        return [text]
    parts = [s for s in re.split(r"(?<=[.!?])\s+", text) if s]
    if len(parts) > 1:
        starts = model_groups([len(p) for p in parts], limit, 1)
        pieces = [" ".join(parts[a:b]) for a, b in zip(starts, starts[1:] + [len(parts)])]
    else:
        pieces = [text]
    return [p[i:i + limit] for p in pieces for i in range(0, len(p), limit)]


def test_random_documents_match_model(spark):
    cases = texts(150, 300, 7)
    df = spark.createDataFrame([(str(i), "n", t) for i, t in enumerate(cases)], "file_hash string, filename string, text string")
    docs = df.select("file_hash", "filename", C.whole_text_section(F.col("text")).alias("sections"))
    got = {}
    rows = C.chunk_documents(docs, ingested_at=at("2026-01-01 00:00:00"), target_chars=60, max_chars=40)
    for c in sorted(rows.collect(), key=lambda c: (c.group_index, c.piece_index)):
        got.setdefault(int(c.file_hash), []).append(c.chunk_text)
    for i, t in enumerate(cases):
        paragraphs = [b.strip() for b in re.split(r"\n\s*\n+", t) if b.strip()]
        starts = model_groups([len(p) for p in paragraphs], 60, 2)
        groups = ["\n\n".join(paragraphs[a:b]) for a, b in zip(starts, starts[1:] + [len(paragraphs)])]
        assert got.get(i, []) == [p for g in groups for p in model_pieces(g, 40)]


def test_docx_rows_become_sections(spark):
    rows = [("d", 0, "Intro text", None), ("d", 1, "  ", "Heading 1"), ("d", 2, " First ", "Heading 1"), ("d", 3, "a", "Normal"),
            ("d", 4, "Second", "Heading 2"), ("e", 0, "plain", "Titel")]
    df = spark.createDataFrame(rows, "file_hash string, pos long, text string, style string")
    got = {r.file_hash: [(s.heading, s.paragraphs) for s in r.sections] for r in files.docx_sections(df).collect()}
    assert got == {"d": [(None, ["Intro text"]), ("First", ["a"]), ("Second", [])], "e": [(None, ["plain"])]}


def test_pages_join_before_splitting(spark):
    pages = spark.createDataFrame([("d", 1, "continues here."), ("d", 0, "A sentence that"), ("d", 2, None)], "file_hash string, page long, text string")
    (r,) = files.join_pages(pages).collect()
    assert r.text == "A sentence that\ncontinues here.\n"


def test_chunk_problem(spark):
    df = spark.createDataFrame([("ok",), (" ",), ("z" * 24_001,), ("z" * 24_000,)], "t string")
    assert [r[0] for r in df.select(C.chunk_problem(F.col("t"))).collect()] == [
        None, "empty text", "input text is 24001 chars, over 24000", None]


def test_chunking_does_not_shuffle(spark):
    df = spark.createDataFrame([(HASH, "f", "a\n\nb")], "file_hash string, filename string, text string")
    docs = df.select("file_hash", "filename", C.whole_text_section(F.col("text")).alias("sections"))
    plan = C.chunk_documents(docs, ingested_at=at("2026-01-01 00:00:00"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan
