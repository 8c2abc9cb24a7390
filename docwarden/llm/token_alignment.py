"""Alignment of the tokens of two tokenizers over the same bytes, and corpus-wide counts of linked ids.

Tokenizer A is byte-level BPE (a ``tokenizers`` file), tokenizer B a sentencepiece model that puts a
space before the text. Both cut the bytes of a space and the text. Per document, dictionaries lead from
the cumulative byte end of a token to its number; the ends that both dictionaries hold, sorted, slice
both id lists into groups, and each slice is expanded into its links: the pairs of tokens that share bytes.

The corpus-wide part never moves single tokens. Tasks keep blocks of documents; a block lists its distinct
id pairs once, with the number of its documents that hold them, and documents refer to that list by place.
Lists are summed over all blocks (map-side first), the sums go back to the blocks that asked for them, and
each block adds up its own documents.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docwarden.llm.durable import shared_folder, written_to

#: A block is closed at so many links or documents; a document with more links is a block of its own.
BLOCK_LINKS, BLOCK_DOCS = 1 << 20, 1 << 14
#: Texts tokenized together, in characters.
TOGETHER = 1 << 18
#: Characters of the units of text whose alignment a task remembers, and units that are aligned together.
REMEMBERED, LEARNED = 1 << 19, 1 << 12
#: Texts of which a unit is white space with what follows it up to the next white space. Other texts are
#: aligned whole. (Fixed values: Latin letters and the signs, digits and white space of ASCII.)
_PLAIN = re.compile(r"[\t\n\x20-\x7e\xc0-ɏ]*")
_UNITS = re.compile(r"[ \n\t]+[^ \n\t]*")

_DOCS_DDL = (
    "block long, is_list boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "places array<int>, times array<int>, codes array<long>, holders array<int>"
)
_DOCS = pa.schema([
    ("block", pa.int64()), ("is_list", pa.bool_()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("places", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())),
    ("codes", pa.list_(pa.int64())), ("holders", pa.list_(pa.int32())),
])
_RESULT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_RESULT = pa.schema([(part.split()[0], pa.string() if part.endswith("string") else pa.int64()) for part in _RESULT_DDL.split(", ")])


# Tokens and their bytes

def byte_of_sign() -> dict[str, int]:
    """The signs of byte-level vocabularies: printable bytes stand for themselves, the others for the
    code points from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE file. The strings of special tokens inside a text are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        signs, vocabulary = byte_of_sign(), self.tokenizer.get_vocab()
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(map(signs.__getitem__, token)) if all(c in signs for c in token) else token.encode()

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids


class Pieces:
    """A sentencepiece model. It puts a space before a text by itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = [
            bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode() for i, piece in enumerate(pieces)
        ]
        #: Whether no piece reaches from something else into white space.
        self.cuts_at_space = not any("▁" in p.lstrip("▁") or any(c in p for c in "\n\t") for p in pieces)

    def ids(self, text: str) -> list[int]:
        """Ids of a text that starts with a space."""
        return self.model.encode(text[1:])


# One document

def slices(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int]]:
    """The token numbers, in A and in B, at which groups end: where both have a token end."""
    at_a = dict(zip(ends_a, range(1, len(ends_a) + 1)))
    at_b = dict(zip(ends_b, range(1, len(ends_b) + 1)))
    common = sorted(filter(at_b.__contains__, at_a))
    return [at_a[e] for e in common], [at_b[e] for e in common]


def links(cuts_a: np.ndarray, cuts_b: np.ndarray, ends_a: list[int], ends_b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of linked tokens, by expanding each group: with one token on a side, that one links
    with all of the other side; else both sides are walked by their ends."""
    first_a, first_b = np.append(0, cuts_a[:-1]), np.append(0, cuts_b[:-1])
    wide_a, wide_b = cuts_a - first_a, cuts_b - first_b
    one = (wide_a == 1) | (wide_b == 1)
    n = np.where(one, wide_a * wide_b, 0)
    group = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(group)) - (np.cumsum(n) - n)[group]
    left, right = [], []
    for g in np.flatnonzero(~one).tolist():
        i, j, last_a, last_b = int(first_a[g]), int(first_b[g]), int(cuts_a[g]), int(cuts_b[g])
        while i < last_a and j < last_b:
            left.append(i)
            right.append(j)
            a, b = ends_a[i], ends_b[j]
            i, j = i + (a <= b), j + (b <= a)
    return (
        np.concatenate([first_a[group] + inner // wide_b[group], np.array(left, np.int64)]),
        np.concatenate([first_b[group] + inner % wide_b[group], np.array(right, np.int64)]),
    )


def written_order(cuts_a: np.ndarray, cuts_b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of A's and of B's tokens when groups follow each other, A's part first, and what comes
    after each place: 0 within a part, 1 after A's part, 2 after B's."""
    first_a, first_b = np.append(0, cuts_a[:-1]), np.append(0, cuts_b[:-1])
    place_a = np.arange(cuts_a[-1]) + np.repeat(first_b, cuts_a - first_a)
    place_b = np.arange(cuts_b[-1]) + np.repeat(cuts_a, cuts_b - first_b)
    after = np.zeros(n, np.int64)
    after[cuts_a + first_b - 1], after[cuts_a + cuts_b - 1] = 1, 2
    return place_a, place_b, after


class Alignment:
    """The alignment of one text, which starts with a space."""

    def __init__(self, tables: Aligner, text: str):
        ids_a, ids_b, self.bytes = tables.a.ids(text), tables.b.ids(text), text.encode()
        self.lossless = all(b"".join(map(t.bytes_of.__getitem__, ids)) == self.bytes for t, ids in ((tables.a, ids_a), (tables.b, ids_b)))
        if not self.lossless:
            return
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        self.ends_a, self.ends_b = np.cumsum(tables.long_a[a]), np.cumsum(tables.long_b[b])
        ends_a, ends_b = self.ends_a.tolist(), self.ends_b.tolist()
        self.cuts_a, self.cuts_b = map(np.array, slices(ends_a, ends_b))
        place_a, place_b, named = written_order(self.cuts_a, self.cuts_b, len(a) + len(b))
        named *= tables.ids
        named[place_a] += a
        named[place_b] += b
        self.written = list(map(tables.names.__getitem__, named.tolist()))
        left, right = links(self.cuts_a, self.cuts_b, ends_a, ends_b)
        order = np.argsort(left, kind="stable")
        self.left = left[order]
        self.codes = a[self.left] * len(tables.long_b) + b[right[order]]

    def parts(self, ends: np.ndarray) -> list[tuple[str, bytes, int]] | None:
        """The alignments of the stretches of the text that end at the byte offsets ``ends`` (the last is the
        text's), each as: its groups as written, its links' codes, its A tokens times 2**32 plus its groups.
        None if some offset is no end of a group."""
        group = np.searchsorted(self.ends_a[self.cuts_a - 1], ends)
        if (self.ends_a[self.cuts_a - 1][group] != ends).any():
            return None
        upto_a, upto_b = self.cuts_a[group], self.cuts_b[group]
        upto = np.append(0, upto_a + upto_b).tolist()
        link = np.append(0, np.searchsorted(self.left, upto_a)).tolist()
        size = (np.diff(upto_a, prepend=0) << 32) + np.diff(group + 1, prepend=0)
        return [
            ("".join(self.written[p:q])[:-1], self.codes[r:s].tobytes(), n)
            for p, q, r, s, n in zip(upto, upto[1:], link, link[1:], size.tolist())
        ]


class Aligner:
    """Both tokenizers. Both cut plain texts at the borders of units, so that a text's alignment is that of
    its units on end; units are aligned once, many in one text, and remembered in two generations: when the
    young one is full it becomes the old one, and units still in use move back."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.long_a = np.array([len(x) for x in self.a.bytes_of], np.int64)
        self.long_b = np.array([len(x) for x in self.b.bytes_of], np.int64)
        self.ids = max(len(self.long_a), len(self.long_b))
        self.names = [f"{i}{mark}" for mark in ",|;" for i in range(self.ids)]
        self.young: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}
        self.held = 0

    def _learn(self, units: set[str]) -> None:
        worded, blank = [], []
        for unit in units:
            self.held += len(unit)
            if unit in self.old:
                self.young[unit] = self.old[unit]
            elif unit.isspace():
                blank.append([unit])  # white space on end would be another unit
            else:
                worded.append(unit)
        for part in [worded[low : low + LEARNED] for low in range(0, len(worded), LEARNED)] + blank:
            together = Alignment(self, " x" + "".join(part))
            ends = 2 + np.cumsum([len(u.encode()) for u in part])
            found = together.parts(np.append(2, ends)) if together.lossless and self.b.cuts_at_space else None
            self.young.update(zip(part, found[1:] if found else [None] * len(part)))

    def documents(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, str, np.ndarray]]:
        """Per text: tokens of A and B, groups, links, the groups' digest, and the code of each link
        (A's id times B's vocabulary size plus B's id)."""
        if self.held > REMEMBERED:
            self.young, self.old, self.held = {}, self.young, 0
        units = [_UNITS.findall(" " + t) if t and _PLAIN.fullmatch(t) else [] for t in texts]
        young = self.young
        self._learn({u for us in units for u in us if u not in young})
        for text, us in zip(texts, units):
            found = list(map(young.__getitem__, us))
            if not found or None in found:
                found = self._whole(text)
            yield _result(found) if found else _NO_TOKENS

    def _whole(self, text: str | None) -> list[tuple] | None:
        if not text:
            return None
        alignment = Alignment(self, " " + text)
        return alignment.parts(np.array([len(alignment.bytes)])) if alignment.lossless else None


def _result(parts: list[tuple[str, bytes, int]]) -> tuple[int, int, int, int, str, np.ndarray]:
    codes = np.frombuffer(b"".join([p[1] for p in parts]), np.int64)
    n_a, n_groups = divmod(sum([p[2] for p in parts]), 1 << 32)
    # A group of n and m tokens has n + m - 1 links.
    n_b = len(codes) + n_groups - n_a
    return n_a, n_b, n_groups, len(codes), hashlib.sha256(";".join([p[0] for p in parts]).encode()).hexdigest(), codes


_NO_TOKENS = (0, 0, 0, 0, "", np.empty(0, np.int64))
_aligners: dict[tuple[str, str], Aligner] = {}


# Blocks of documents

def _lists(parts: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    offsets = np.cumsum([0, *map(len, parts)])
    return pa.array(offsets, pa.int32()), np.concatenate(parts) if parts else np.empty(0, np.int64)


def _block(block: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """The block's documents, then the row with its list of codes."""
    distinct = [np.unique(r[-1], return_counts=True) for r in rows]
    offsets, codes = _lists([d[0] for d in distinct])
    listed, places, holders = np.unique(codes, return_inverse=True, return_counts=True)
    times = _lists([d[1] for d in distinct])[1]
    n = len(rows)
    columns = [[r[k] for r in rows] for k in range(6)]
    yield pa.RecordBatch.from_arrays([
        pa.array([block] * n, pa.int64()), pa.array([False] * n), *(pa.array(c, _DOCS.field(2 + k).type) for k, c in enumerate(columns)),
        pa.ListArray.from_arrays(offsets, pa.array(places, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())),
        pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32())),
    ], schema=_DOCS)
    if len(listed):
        row = {"block": block, "is_list": True, "codes": listed, "holders": holders}
        yield pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in _DOCS], schema=_DOCS)


def _aligned(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, block_links: int) -> Iterator[pa.RecordBatch]:
    if (path_a, path_b) not in _aligners:
        _aligners.clear()
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    aligner, block, rows, held = _aligners[path_a, path_b], TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        low = 0
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and (high == low or size + len(texts[high] or "") <= TOGETHER):
                size, high = size + len(texts[high] or ""), high + 1
            for doc_id, found in zip(doc_ids[low:high], aligner.documents(texts[low:high])):
                if rows and (held + found[3] > block_links or len(rows) >= BLOCK_DOCS):
                    yield from _block(block, rows)
                    block, rows, held = block + 1, [], 0
                rows.append((doc_id, *found))
                held += found[3]
            low = high
    if rows:
        yield from _block(block, rows)


def _summed(docs: pa.Table, listed: pa.Table) -> pa.Table:
    """A block's documents with sums over their links; ``listed`` has the corpus-wide count of each place."""
    place = listed["place"].to_numpy()
    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    count[place], best[place] = listed["n"].to_numpy(), listed["is_best"].to_numpy().astype(np.int64)
    lengths = np.array(docs["places"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False), np.int64)
    ends = np.cumsum(lengths)
    places = docs["places"].combine_chunks().flatten().to_numpy()
    times = docs["times"].combine_chunks().flatten().to_numpy().astype(np.int64)

    def per_document(values: np.ndarray) -> np.ndarray:
        upto = np.append(0, np.cumsum(values * times))
        return upto[ends] - upto[ends - lengths]

    columns = {"n_best": per_document(best[places]), "count_sum": per_document(count[places])}
    return pa.table([columns.get(f.name, docs[f.name] if f.name not in columns else None) for f in _RESULT], schema=_RESULT)


def align(docs: DataFrame, path_a: str, path_b: str, block_links: int = BLOCK_LINKS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): n_a and n_b (tokens), n_groups,
    n_links, n_best (links whose id pair is held by as many documents as any pair of the same id of A),
    count_sum (over links, the number of documents that hold the link's id pair), groups_sha256.

    A text that is null, empty, or that a tokenizer does not give back byte for byte has no tokens: zeros
    and an empty digest. Repeated rows count as documents of their own and give equal rows. A null id stays
    null. A text of any length is tokenized whole. An empty table gives no rows. ``path_a`` and ``path_b``
    are read on every machine."""
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    folder = shared_folder(docs.sparkSession)
    blocks = written_to(folder, parts.mapInArrow(lambda b: _aligned(b, path_a, path_b, block_links), _DOCS_DDL), "alignment", compression="zstd")
    lists = blocks.filter("is_list")
    size_b = _vocabulary(path_b)
    pairs = (
        lists.select(F.explode(F.arrays_zip("codes", "holders")).alias("x")).groupBy(F.col("x.codes").alias("code")).agg(F.sum("x.holders").alias("n"))
    )
    of_a = Window.partitionBy(F.floor(F.col("code") / F.lit(size_b)))  # as many rows as B has ids, at most
    counts = written_to(folder, pairs.withColumn("is_best", F.col("n") == F.max("n").over(of_a)), "pairs")
    asked = lists.select(F.col("block").alias("asker"), F.posexplode("codes").alias("place", "code")).join(counts, "code").select("asker", "place", "n", "is_best")
    own = blocks.filter("not is_list").drop("is_list", "codes", "holders")
    return own.groupBy("block").cogroup(asked.groupBy("asker")).applyInArrow(_summed, _RESULT_DDL)


def _vocabulary(path_b: str) -> int:
    return len(Pieces(path_b).bytes_of)
