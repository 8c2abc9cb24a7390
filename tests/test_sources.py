"""Files, snapshots and the upload stream."""

import random
import zipfile
from io import BytesIO
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from docwarden import schemas
from docwarden.functions import validation as V
from docwarden.functions.vectors import cosine_similarity, dot, invalid_vector_reason
from docwarden.sources import files as S
from docwarden.sources.stores import KeyedTable
from docwarden.streaming import uploads as U


@pytest.mark.parametrize("name,declared,kind", [
    ("a.PDF", None, "pdf"), ("a.txt", "application/pdf", "txt"), ("a.bin", "Text/Plain", "txt"), ("a", None, None), (None, "application/pdf", "pdf"),
    (".pdf", None, None), ("dir.pdf/a", None, None), ("a.tar.docx", None, "docx"), ("", "text/plain", "txt"), ("a.exe", "text/html", None)])
def test_file_kind(spark, name, declared, kind):
    df = spark.createDataFrame([(name, declared)], "n string, c string")
    assert df.select(S.file_kind(F.col("n"), F.col("c"))).first()[0] == kind


def test_upload_problem(spark):
    limit = S.MAX_UPLOAD_BYTES
    df = spark.createDataFrame([(0, "txt", 0), (limit, "txt", limit), (limit + 1, "txt", 1), (5, None, 5), (5, "txt", limit + 1)], "size long, kind string, declared long")
    got = [r[0] for r in df.select(S.upload_problem(F.col("size"), F.col("kind"), F.col("declared"))).collect()]
    large = "File exceeds the 20MB upload limit."
    assert got == ["Uploaded file is empty.", None, large, "Unsupported file type — only PDF, DOCX, and TXT files are accepted.", large]


def test_decode_matches_python_replacement(spark):
    rng = random.Random(4)
    alphabet = [b"a", b"\n", "é".encode(), "文".encode(), "𝄞".encode(), b"\xff", b"\xc3", b"\xe6\x96", b"\xf0\x9d", b"\x80", b"\xed\xa0\x80", b"\xc0\xaf"]
    cases = [bytearray(b"".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12)))) for _ in range(500)]
    df = spark.createDataFrame([(c,) for c in cases], "b binary")
    for r in df.select("b", S.decode_text(F.col("b")).alias("t")).collect():
        assert r.t == bytes(r.b).decode("utf-8", errors="replace")


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [tuple(r) for r in df.select(dot(F.col("a"), F.col("b")), cosine_similarity(F.col("a"), F.col("b"))).collect()] == [(24.0, 0.96), (0.0, None)]
    bad = spark.createDataFrame([([1.0, 2.0],), ([1.0],), ([1.0, None],), ([1.0, float("nan")],), ([1.0, float("-inf")],), (None,)], "v array<double>")
    assert [r[0] for r in bad.select(invalid_vector_reason(F.col("v"), 2)).collect()] == [
        None, "expected 2 values, got 1", "non-numeric value", "non-finite value", "non-finite value", "missing"]


@pytest.mark.parametrize("value,strict,loose", [
    ("A@Example.org ", True, True), ("a@b", False, False), ("a b@example.org", False, False), ("é@example.org", False, True), ("a@b.c\nx", False, False),
    (None, False, False), ("x" * 250 + "@example.org", False, True), ("a@b@c.org", False, False)])
def test_emails(spark, value, strict, loose):
    df = spark.createDataFrame([(value,)], "e string")
    assert tuple(df.select(V.valid_email(F.col("e")), V.valid_contact_email(F.col("e"))).first()) == (strict, loose)


def test_questions(spark):
    cases = [("why?", True), ("", False), (" \n", False), ("q" * 2000, True), ("q" * 2001, False), (None, False)]
    df = spark.createDataFrame(cases, "q string, want boolean")
    assert all(r.want == r.got for r in df.select("want", V.valid_question(F.col("q")).alias("got")).collect())


def test_oversize_documents_are_listed_not_gathered(spark):
    rows = spark.range(300).select(F.when(F.col("id") % 3 == 0, "big").otherwise(F.col("id").cast("string")).alias("d"), F.lit("x" * 50).alias("text"))
    fitting, over = S.fitting_documents(rows, "d", max_bytes=1000)
    assert fitting.where("d = 'big'").isEmpty() and fitting.count() == 200
    assert over.first().failure_reason == "extracted text is 5000 bytes, over 1000"


W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_bytes(paragraphs):
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for t, s in paragraphs)
    xml = f'<w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>'
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


def read_docx(raw):
    with zipfile.ZipFile(BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    for p in root.iter(f"{W}p"):
        style = p.find(f"{W}pPr/{W}pStyle")
        yield "".join(t.text or "" for t in p.iter(f"{W}t")), None if style is None else style.get(f"{W}val")


def read_pages(raw):
    if not raw.startswith(b"%PDF"):
        raise ValueError("not a PDF")
    return raw.decode().split("\f")[1:]


def embed(texts):
    if any("poison" in t for t in texts):
        raise ValueError("no vector")
    return [[float(len(t)), 1.0] for t in texts]


def test_upload_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.txt").write_text("First.\n\nSecond.")
    (inbox / "copy.txt").write_text("First.\n\nSecond.")
    (inbox / "h.docx").write_bytes(docx_bytes([("Intro", "Heading1"), ("Text.", "Normal")]))
    (inbox / "p.pdf").write_bytes(b"%PDF\fA sentence over\ftwo pages.")
    (inbox / "broken.pdf").write_bytes(b"nope")
    (inbox / "blank.txt").write_text(" \n ")
    (inbox / "bad.txt").write_text("poison")
    (inbox / "x.exe").write_text("x")
    (inbox / "empty.txt").write_text("")
    store = KeyedTable(spark, str(tmp_path / "store"), schemas.CHUNKS, "chunk_id")
    ledger = KeyedTable(spark, str(tmp_path / "ledger"), schemas.DOCUMENT_UPLOADS, "file_hash", digits=1)
    refused, batches = [], []

    def handle(batch, batch_id):
        batches.append(batch_id)
        out = U.ingest_uploads(batch, store, ledger, embed, "2026-01-01 00:00:00", batch_id, embedding_model="m", dim=2, pdf_pages=read_pages, docx_paragraphs=read_docx)
        refused.extend(r.filename for r in out.collect())

    def run():
        U.start_ingest(U.upload_stream(spark, str(inbox)), str(tmp_path / "ck"), handle).awaitTermination()

    run()
    assert refused == ["x.exe"]  # Spark's file sources pass over empty files
    chunks = {r.section_label: r for r in store.read().collect()}
    assert {k: r.chunk_text for k, r in chunks.items()} == {
        "a.txt": "First.\n\nSecond.", "Intro": "Intro\n\nText.", "p.pdf": "A sentence over\ntwo pages."}
    assert list(chunks["a.txt"].embedding) == [15.0, 1.0] and chunks["a.txt"].embedding_model == "m"
    status = {r.original_filename: (r.status, r.failure_reason, r.chunk_count) for r in ledger.read().collect()}
    assert status["a.txt"] == ("completed", None, 1) and status["p.pdf"] == ("completed", None, 1) and status["h.docx"] == ("completed", None, 1)
    assert status["broken.pdf"] == ("failed", "ValueError: not a PDF", None)
    assert status["blank.txt"][0] == "failed" and status["blank.txt"][1].startswith("EmptyDocumentError")
    assert status["bad.txt"] == ("failed", "1/1 chunk(s) failed to embed/insert", None)
    assert len(status) == 6 and "copy.txt" not in status

    before = {r.chunk_id: r.embedded_at for r in store.read().collect()}
    (inbox / "again.txt").write_text("First.\n\nSecond.")
    run()
    assert {r.chunk_id: r.embedded_at for r in store.read().collect()} == before
    assert {r.original_filename for r in ledger.read().collect()} == set(status)
