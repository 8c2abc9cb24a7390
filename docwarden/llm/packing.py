"""Packing of tokenized documents into sequences, as a cutting-stock problem.

Documents longer than a sequence give full sequences of their own and one rest. The rests are counted
by length class (``STEP`` tokens wide), and the linear program *use patterns, as few as possible, so
that every class is covered* is solved by column generation: a knapsack by dynamic programming over
the classes prices new patterns against the program's prices until none pays. Sizes of the program do
not depend on the input: classes and patterns are bounded by ``LENGTH / STEP``, and only the histogram
reaches the driver. Pattern uses are rounded down; the pieces left over (fewer than classes times
patterns) are placed first-fit by decreasing length.

The patterns are then dealt to the documents by rank. Pieces of a class are numbered (in buckets, so
that a frequent length is never ranked in one task); a pattern owns a range of numbers in each of its
classes, and number within range gives the sequence.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docwarden.llm.durable import written
from docwarden.llm.words import record_batch

LENGTH, END, STEP = 2048, 1, 16
#: Words whose ids a task remembers.
REMEMBERED = 500_000
#: Bytes of texts whose words are looked up together. A longer text is looked up alone.
TOGETHER = 1 << 23
#: The tokenizer's pre-tokens, what ends the last token of each, and words that go to it together (fixed values).
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
WORD_END = "</w>"
PLAIN = regex.compile(r"[\x21-\x7e\xa1-\u012f\u0131-\u024f]+")
#: Pieces of one class that are numbered together.
BUCKET = 65_536

_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("copy", pa.int64()),
])
_PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, copy long"


# Tokens

class _Ids:
    """Ids of space-separated words, for a tokenizer that drops white space and ends every pre-token with
    a token of its own kind (``WORD_END``): a text's ids are those of its words on end. Only words that
    are new go to the tokenizer, many in one text; the pre-tokens of a word are counted to find its ids
    again. Words of other than plain Latin characters, or with the marks of special tokens, go alone.

    Words are remembered in two generations: when the young one is full it becomes the old one, and
    words still in use move back."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _alone(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        last = np.cumsum([len(PRE_TOKEN.findall(w.lower())) for w in words])
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != last[-1] or cuts[-1] != len(ids):
            return self._alone(words)
        raw, upto = ids.tobytes(), [0, *(4 * cuts[last - 1]).tolist()]
        return [raw[low:high] for low, high in zip(upto, upto[1:])]

    def _learn(self, words: set[str]) -> None:
        young, plain, other = self.young, [], []
        for word in words:
            if word in self.old:
                young[word] = self.old[word]
            elif PLAIN.fullmatch(word) and "<|" not in word:
                plain.append(word)
            else:
                other.append(word)
        for low in range(0, len(plain), 512):
            part = plain[low : low + 512]
            young.update(zip(part, self._together(part)))
        if other:
            young.update(zip(other, self._alone(other)))

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, and where each text's ids begin and the last one's end. Words are
        encoded as a dictionary first: only distinct ones are looked up."""
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        get = self.young.get
        found = list(map(get, distinct))
        if None in found:
            self._learn({w for w, ids in zip(distinct, found) if ids is None})
            found = list(map(get, distinct))
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young
        table = np.frombuffer(b"".join(found), "<u4")
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first, each = (np.cumsum(lengths) - lengths)[codes], lengths[codes]
        upto = np.concatenate([[0], np.cumsum(each)])
        ids = table[np.repeat(first - upto[:-1], each) + np.arange(upto[-1])]
        offsets = words.offsets.to_numpy()
        return ids, upto[offsets - offsets[0]]


_tokenizers: dict[str, _Ids] = {}


def _tokenized(batches: Iterator[pa.RecordBatch], path: str, length: int) -> Iterator[pa.RecordBatch]:
    if path not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[path] = _Ids(path)
    tokenizer = _tokenizers[path]
    for batch in batches:
        texts = pc.fill_null(batch.column(1), "")
        block = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // TOGETHER
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            if low == high:
                continue
            ids, bounds = tokenizer.of(texts[low:high])
            rows = []
            for doc_id, begin, end in zip(batch.column(0)[low:high].to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                found = np.append(ids[begin:end], np.uint32(END)).tobytes()
                total = len(found) // 4
                copy = zlib.crc32(found)
                if total <= length:
                    rows.append((doc_id, 0, total, copy, total, copy))
                    continue
                for start in range(0, total, length):
                    piece = found[4 * start : 4 * (start + length)]
                    rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), total, copy))
            yield record_batch(_PIECES, *map(list, zip(*rows)))


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """One row per piece: its document, first token, length, CRC-32 of its ids, the document's tokens,
    and a digest of all the document's ids (``copy``)."""
    return docs.select("doc_id", "text").mapInArrow(lambda it: _tokenized(it, tokenizer, length), _PIECES_DDL)


# The program

def _best_pattern(prices: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: the pattern worth most at these prices."""
    worth, took = np.zeros(room + 1), np.full(room + 1, -1)
    for space in range(1, room + 1):
        fit = np.searchsorted(sizes, space, side="right")
        worth[space] = worth[space - 1]
        if fit:
            value = worth[space - sizes[:fit]] + prices[:fit]
            best = int(value.argmax())
            if value[best] > worth[space] + 1e-12:
                worth[space], took[space] = value[best], best
    pattern, space = np.zeros(len(sizes), np.int64), room
    while space > 0:
        if took[space] < 0:
            space -= 1
        else:
            pattern[took[space]] += 1
            space -= sizes[took[space]]
    return worth[room], pattern


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int = 5_000, gap: float = 0.003) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, times): whole patterns with whole numbers of uses that cover ``demand`` exactly.
    ``sizes`` are ascending and at most ``room``. ``gap`` (to a lower bound of the number of patterns) and
    ``rounds`` only end the search for better ones; what is found by then covers everything. Pricing
    leans on the prices *size / room*, which steadies the search (Wentges, 1997)."""
    kinds = len(sizes)
    if not kinds:
        return np.zeros((0, 0), np.int64), np.zeros(0, np.int64)
    basis = np.diag(room // sizes).astype(float)  # a column per pattern
    inverse = np.diag(1.0 / np.diag(basis))
    # Products are written as sums: the matrices are small, and threads of a linear algebra library only
    # get in each other's way on a busy driver.
    times_vector = lambda matrix, vector: (matrix * vector).sum(axis=1)
    uses = times_vector(inverse, demand)
    fair, lean = sizes / room, 0.9  # prices that no pattern beats; how far pricing leans on them
    bound = max(float((fair * demand).sum()), 1e-9)
    for turn in range(rounds):
        prices = inverse.sum(axis=0)
        value, pattern = _best_pattern(lean * fair + (1 - lean) * prices, sizes, room)
        if (prices * pattern).sum() <= 1 + 1e-6:  # the leaning prices miss: lean less
            if lean == 0:
                break
            lean = lean - 0.3 if lean > 0.3 else 0.0
            continue
        if lean == 0:
            bound = max(bound, uses.sum() / value)
        if uses.sum() <= (1 + gap) * bound:
            break
        lean = 0.9
        change = times_vector(inverse, pattern)
        ratio = np.where(change > 1e-9, uses / np.where(change > 1e-9, change, 1), np.inf)
        leaves = int(ratio.argmin())
        if not np.isfinite(ratio[leaves]):
            break
        basis[:, leaves] = pattern
        row = inverse[leaves] / change[leaves]
        inverse -= np.outer(change, row)
        inverse[leaves] = row
        uses = uses - change * ratio[leaves]
        uses[leaves] = ratio[leaves]
        if turn % 100 == 99 and np.abs(times_vector(basis, uses) - demand).max() > 1e-6 * demand.max():
            inverse = np.linalg.inv(basis)
            uses = times_vector(inverse, demand)
        uses = np.maximum(uses, 0)
    times = np.floor(uses + 1e-6).astype(np.int64)
    patterns = basis.T.round().astype(np.int64)
    left = demand - times @ patterns
    while (left < 0).any():  # rounding noise: take single uses back
        over = int(np.flatnonzero(left < 0)[0])
        at = int(np.flatnonzero((patterns[:, over] > 0) & (times > 0))[0])
        times[at] -= 1
        left = demand - times @ patterns
    extra = []
    bins: list[list] = []
    for kind in range(kinds - 1, -1, -1):
        for _ in range(left[kind]):
            at = next((b for b in bins if b[0] >= sizes[kind]), None)
            if at is None:
                at = [room, np.zeros(kinds, np.int64)]
                bins.append(at)
            at[0] -= sizes[kind]
            at[1][kind] += 1
    extra = [b[1] for b in bins]
    used = times > 0
    patterns = np.vstack([patterns[used], *[e[None] for e in extra]]) if extra else patterns[used]
    return patterns, np.concatenate([times[used], np.ones(len(extra), np.int64)])


# Assignment

def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """One row per piece with its sequence_id and its offset there.

    Null and empty texts are documents of the end token alone. Every row of ``docs`` is packed, also
    those that repeat or have no id. Other columns are ignored; an empty table gives no rows."""
    if length % STEP:
        raise ValueError(f"length must be a multiple of {STEP}")
    spark = docs.sparkSession
    found = written(pieces(docs, tokenizer, length).withColumn("size", F.ceil(F.col("length") / STEP).cast("int")), "pieces")
    counts = {r["size"]: r["count"] for r in found.groupBy("size").count().collect()}  # at most length / STEP rows
    sizes = np.array(sorted(counts), np.int64)
    patterns, times = solve_patterns(sizes, np.array([counts[s] for s in sizes.tolist()], np.int64), length // STEP)
    first_sequence = np.concatenate([[0], np.cumsum(times)])
    slots = []  # class, its first number, pieces per sequence, first sequence, first place
    for kind, size in enumerate(sizes.tolist()):
        number = 0
        for p in np.flatnonzero(patterns[:, kind]).tolist():
            each = int(patterns[p, kind])
            slots.append((size, number, number + each * int(times[p]), each, int(first_sequence[p])))
            number += each * int(times[p])
    schema = "size int, low long, high long, each long, first_sequence long"
    dealt = spark.createDataFrame(slots, schema)

    # Numbers within a class: buckets by hash, then ranks within a bucket.
    buckets = spark.createDataFrame([(s, n // BUCKET + 1) for s, n in counts.items()], "size int, buckets long")
    keyed = found.join(F.broadcast(buckets), "size").withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "start", "copy"), "buckets"))
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("size", "bucket").count().select(
        "size", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("doc_id", "start", "copy")) - 1
    numbered = keyed.withColumn("rank", rank).join(offsets, ["size", "bucket"]).withColumn("number", F.col("base") + F.col("rank"))

    # The program bounds the ranges (classes times patterns), whatever the input; a range per number.
    ranged = numbered.join(F.broadcast(dealt.withColumnRenamed("size", "of")), F.expr("of = size and number >= low and number < high"))
    placed = ranged.withColumn("sequence_id", F.col("first_sequence") + F.floor((F.col("number") - F.col("low")) / F.col("each")).cast("long"))
    within = Window.partitionBy("sequence_id").orderBy("size", "number").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(within), F.lit(0)).cast("long").alias("offset"),
    )
