"""The pipeline's rows against a brute-force version of its five stages, at the smallest scale."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from docwarden.llm import quality
from test_documents import BASE, base_measures
from test_jaccard_join import model as components_of

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def upper(value):
    """The largest number in the sketch bin of a value."""
    sub = quality.SUB
    if value < sub:
        return value
    shift = value.bit_length() - sub.bit_length()
    return ((value >> shift) + 1 << shift) - 1 if shift else value


def kept_by_rules(rows):
    """A model of the quality rules that sorts values instead of merging sketches."""
    rates, least, failed = {}, {}, {}
    sure = lambda n: max(0, n - 2 * math.ceil(math.sqrt(n)) - 2)
    for doc_id, text, *_ in rows:
        words, chars, symbols, dup, repeats, bad = base_measures(text)
        lines = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
        of = [(symbols, chars), (repeats, words), (dup, lines)]
        rates[doc_id] = (*[1000 * n // max(d, 1) for n, d in of], 1000 * chars // max(words, 1))
        least[doc_id] = (*[1000 * sure(n) // max(d, 1) for n, d in of], 1000 * chars // max(words, 1))
        failed[doc_id] = bad
    groups = defaultdict(list)
    for doc_id, _, lang, source, _ in rows:
        if not failed[doc_id]:
            for g in ((lang, source), (lang,), ()):
                groups[g].append(rates[doc_id])

    def fences(g):
        columns, out = list(zip(*groups[g])), []
        coarse = fences(g[:-1]) if g else None
        for k, (values, (tail, times)) in enumerate(zip(columns, quality.RATES.values())):
            ordered, n = sorted(values), len(values)
            mid, high, far = (upper(ordered[-(-n * q // 100) - 1]) for q in (50, 75, tail))
            own = mid + max(quality.SPREAD * (high - mid), times * (far - mid))
            out.append((n * own + quality.PRIOR * coarse[k]) // (n + quality.PRIOR) if g else own)
        return out

    limits = {g: fences(g) for g in groups if len(g) == 2}
    return [r for r in rows if not failed[r[0]] and all(x <= f for x, f in zip(least[r[0]], limits[r[2], r[3]]))]


def holds(text, item):
    """Whether a text holds most windows of eight words of an item (the test data has no slots)."""
    strip = lambda t: [w.strip("\"'`.,;:!?()[]{}<>|*#&$_~-").lower() for w in WORD.findall(t)]
    a, b = strip(text), strip(item)
    have = {tuple(a[k : k + 8]) for k in range(len(a) - 7)}
    runs = [tuple(b[k : k + 8]) for k in range(len(b) - 7)]
    return sum(r in have for r in runs) >= 0.6 * len(runs)


def redact(text):
    spans = sorted((m.start(), m.end()) for p, g, n in BASE.values() for m in p.finditer(text) if len(m[g]) >= n)
    out, at = "", 0
    for s, e in spans:
        if s >= at:
            out += text[at:s] + "[secret]"
        at = max(at, e)
    return out + text[at:]


@pytest.fixture(scope="module")
def stages(spark):
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test")
        found.append(docs)
    return found


def test_stages(spark, stages):
    con = duckdb.connect()
    rows = con.execute(f"select doc_id, text, lang, source, n_chars from '{SF}/documents.parquet'").fetchall()
    items = con.execute(f"select text from '{SF}/benchmark.parquet'").fetchall()
    plain = lambda df: sorted(tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect())
    left = kept_by_rules(rows)
    assert 0 < len(left) < len(rows) and plain(stages[0]) == sorted(left)
    first = {i for i, _, c in components_of([r[:2] for r in left]) if i == c}
    left = [r for r in left if r[0] in first]
    assert plain(stages[1]) == sorted(left)
    left = [r for r in left if not any(holds(r[1], t) for (t,) in items)]
    assert plain(stages[2]) == sorted(left)
    left = [(i, t := redact(text), lang, source, len(t)) for i, text, lang, source, _ in left]
    assert plain(stages[3]) == sorted(left)
    tokenizer, want = Tokenizer.from_file(corpus_pipeline.tokenizer_path()), Counter()
    for i, text, *_ in left:
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [1], "<u4")
        for s in range(0, len(ids), 2048):
            want[i, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in stages[4].collect()) == want
    assert all(d.columns == ["doc_id", "text", "lang", "source", "n_chars"] for d in stages[:4])


def test_odd_rows_and_empty_table(spark, frame, odd_rows, tmp_path):
    for k, rows in enumerate(([], odd_rows)):
        folder = tmp_path / str(k)
        frame(rows).write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
        got = {r.doc_id for r in corpus_pipeline.run(spark, str(folder)).collect()}
        assert got == ({1, None} if rows else set())
