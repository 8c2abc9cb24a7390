"""Token alignment, WARC archives and clustering beside plain versions."""

import base64
import hashlib
import math
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from docwarden.llm import archives, clustering, token_alignment

BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# Token alignment

def _tokens(text):
    a, b = Tokenizer.from_file(BYTE_BPE), SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    signs, whole = token_alignment.byte_of_sign(), b" " + text.encode()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(signs[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    return ([], [], [], []) if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole else (ids_a, bytes_a, ids_b, bytes_b)


def _ranges(parts):
    ends = [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
    return [(e - len(p), e) for e, p in zip(ends, parts)]


def _plain_alignment(rows):
    docs, holders = [], Counter()
    for doc_id, text in rows:
        ids_a, bytes_a, ids_b, bytes_b = _tokens(text or "")
        ra, rb = _ranges(bytes_a), _ranges(bytes_b)
        links = [(ids_a[i], ids_b[j]) for i, x in enumerate(ra) for j, y in enumerate(rb) if x[0] < y[1] and y[0] < x[1]]
        common = sorted({x[1] for x in ra} & {y[1] for y in rb})
        groups = [
            ",".join(str(i) for i, x in zip(ids_a, ra) if low < x[1] <= high) + "|" + ",".join(str(i) for i, y in zip(ids_b, rb) if low < y[1] <= high)
            for low, high in zip([0, *common], common)
        ]
        holders.update(set(links))
        docs.append((doc_id, len(ids_a), len(ids_b), groups, links))
    best = defaultdict(int)
    for (a, _), n in holders.items():
        best[a] = max(best[a], n)
    return Counter(
        (doc_id, n_a, n_b, len(groups), len(links), sum(holders[x] == best[x[0]] for x in links), sum(holders[x] for x in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for doc_id, n_a, n_b, groups, links in docs)


@pytest.mark.parametrize("block_links", [1, 200, token_alignment.BLOCK_LINKS])
def test_alignment_equals_a_plain_version(spark, frame, odd_rows, block_links):
    rows = [r for r in odd_rows if r[0] != 7] + [
        (20, "<|endoftext|> and <s> </s> <0x41> <unk>"), (21, "a▁b"), (22, " two  spaces \n\n and\tlines\r\n"), (23, "naïve Straße ½ don't we'LL ×÷ “q” 🙂🙂"),
        (24, "x" * 300), (25, "\x00\x01\xa0\x85"), (26, "日本語テキスト mixed 日本語"), (27, "12345 1,000.50 $$$ ###"),
    ]
    got = Counter(tuple(r) for r in token_alignment.align(frame(rows).repartition(3), BYTE_BPE, PIECES, block_links).collect())
    assert got == _plain_alignment([r[:2] for r in rows])


def test_alignment_of_long_texts_and_no_texts(frame):
    rows = [(1, "x " * 60_000), (2, "plain words again " * 5_000)]
    got = {r.doc_id: r for r in token_alignment.align(frame(rows), BYTE_BPE, PIECES).collect()}
    for doc_id, text in rows:
        ids_a, _, ids_b, _ = _tokens(text)
        assert (got[doc_id].n_a, got[doc_id].n_b) == (len(ids_a), len(ids_b)) and got[doc_id].n_links >= max(len(ids_a), len(ids_b))
    assert token_alignment.align(frame(rows).limit(0), BYTE_BPE, PIECES).count() == 0
    assert token_alignment.align(frame([(1, None), (2, "")]), BYTE_BPE, PIECES).select("n_links", "groups_sha256").distinct().collect() == [(0, "")]


def test_units_on_end_are_the_whole_text(monkeypatch):
    import random

    monkeypatch.setattr(token_alignment, "REMEMBERED", 3000)
    draw, signs = random.Random(5), " \n\t\r'sdtmrevl.,(0129abcÄéßɏ×÷\xa0“"
    texts = ["".join(draw.choice(signs[: draw.choice([5, 20, len(signs) - 2, len(signs)])]) for _ in range(draw.randint(1, 50))) for _ in range(3000)]
    aligner = token_alignment.Aligner(BYTE_BPE, PIECES)
    assert aligner.b.cuts_at_space
    got = [found for low in range(0, len(texts), 100) for found in aligner.documents(texts[low : low + 100])]
    for text, found in zip(texts, got):
        want = token_alignment._result(aligner._whole(text))
        assert found[:5] == want[:5] and (found[5] == want[5]).all(), text


# Archives

def _plain_records(rows):
    held = defaultdict(list)
    for page_id, _, html in rows:
        held[html or ""].append(page_id)
    out = Counter()
    for page_id, url, html in rows:
        payload, ids = (html or "").encode(), [i for i in held[html or ""] if i is not None]
        holder = max(ids) if ids else None
        revisit = len(held[html or ""]) > 1 and holder is not None and page_id != holder
        out[page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", holder if revisit else None] += 1
    return out


def _inner(payload):
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: {len(payload)}\r\n\r\n{payload}\r\n\r\n"


PAGES = [
    (1, "http://a", "<p>one</p>"), (2, "http://b", None), (3, None, ""), (4, "u\r\nContent-Length: 3", "<p>é 日本 😀</p>"), (5, "x", "same"), (6, "y", "same"), (6, "y", "same"),
    (None, "z", "same"), (None, "n", "only null"), (7, "m", "before WARC/1.1\r\nafter"), (8, "m", "WARC/1.1\r\n"), (9, "m", "WARWARC/1.1\r\n\r\n\r\nWARC/1.1\r"),
    (10, "e", "text " + _inner("a whole record inside") + " tail"), (11, "e", _inner("first") + _inner("second") + _inner("third")), (12, "l", "long " * 20_000),
    (13, "q", "\r\n\r\n"), (14, "w", (_inner("x" * 900) + "gap") * 6), (-3, "k", "WARC/1.1\r\nContent-Length: 99999999999999999999\r\n\r\n"),
    (15, "h", "WARC/1.1\r\nContent-Length: 5000000\r\n\r\nreaches beyond the file"),
]


@pytest.mark.parametrize("range_bytes", ["128m", "700b", "97b"])
def test_pages_come_back_from_archives(spark, range_bytes):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("value", F.lit(0)).coalesce(2)
    path, settings = archives.archived(pages), {"spark.sql.files.maxPartitionBytes": range_bytes, "spark.sql.files.openCostInBytes": "1b"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        rows = archives.read_back(spark, path).collect()
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == _plain_records(PAGES)
    assert all(r.whole for r in rows) and {r.url for r in rows if r.page_id == 4} == {"u%0D%0AContent-Length: 3"}


def test_no_pages_and_a_cut_file(spark, tmp_path):
    pages = spark.createDataFrame(PAGES[:1], "page_id long, url string, html string")
    assert archives.read_back(spark, archives.archived(pages.limit(0))).count() == 0
    text = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 4\r\n\r\nfull\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((text + text.replace("page:1", "page:2").replace("Length: 4", "Length: 40")).encode())
    got = {r.page_id: (r.payload_bytes, r.whole) for r in archives.read_back(spark, f"file://{tmp_path}").collect()}
    assert got[1] == (4, True) and got[2][1] is False and len(got) == 2


# Clustering

def _plain_clusters(rows, components=64, clusters=16, rounds=3, seed=1):
    kept = [(i, [max(-clustering.BOUND, min(clustering.BOUND, math.floor(64 * x))) for x in v]) for i, v in rows
            if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in start[:clusters]]

    def nearest(v):
        return min((sum((x - c) ** 2 for x, c in zip(v, centroid)), k) for k, centroid in enumerate(centroids))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(members[k]) for x in zip(*members[k])] if members[k] else c for k, c in enumerate(centroids)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, k in found:
        inertia[k] += d
    return Counter((i, k, d, inertia[k], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, d, k in found)


@pytest.mark.parametrize("n", [0, 5, 300])
def test_clusters_equal_a_plain_version(spark, n):
    import random

    draw = random.Random(n)
    rows = [(i, [draw.gauss(i % 7 - 3, 0.6) for _ in range(64)]) for i in range(n)]
    rows += rows[:3] + [(900 + k, v) for k, v in enumerate([v for _, v in rows[:2]])]  # repeated rows, ties
    odd = [(None, rows[0][1])] if n else []
    odd += [(500, None), (501, []), (502, [0.1] * 63), (503, [0.1] * 65), (504, [float("nan")] + [0.0] * 63), (505, [float("inf")] + [0.0] * 63), (506, [None] + [0.0] * 63)]
    odd += [(507, [1e30] + [0.0] * 63), (508, [-0.0] * 64)] if n else []
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("cluster", F.lit(9)).withColumn("packet", F.lit("clash"))
    assert Counter(tuple(r) for r in clustering.cluster(vectors.repartition(3)).collect()) == _plain_clusters(rows + odd)


def test_column_blocks_of_any_width_agree(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [Counter(tuple(r) for r in clustering.cluster(vectors, width=w).collect()) for w in (7, 64)]
    assert rows[0] == rows[1]
