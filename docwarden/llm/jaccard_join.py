"""Exact similarity join of documents on word shingles, by parity sketches.

*Sketch.* Every shingle of a document toggles one bit of a 2^48-bit word; what is kept is the list of
bits that are set. Two sketches differ in at most as many bits as the two sets differ in shingles
(each differing shingle toggles one bit), so their Hamming distance is a lower bound of the symmetric
difference. Folded to a few bits per shingle (halves XORed), the sketch bounds it too, in a few words.

*Pigeonhole.* Sets of sizes m and n with similarity 3/4 or more differ in at most D = (m + n) // 7
shingles, and only sizes with 4 * min >= 3 * max can meet. Take any common order of the bits. Before the
first shared bit a sketch has bits of its own only; the two numbers of own bits differ by m - n and their
sum is the Hamming distance, so the larger document has (D + m - n) / 2 before it at most. Whatever the
partner, that is less than a quarter of a document's bits, so its first n // 4 + SLACK bits suffice as join
keys (SLACK allows two shingles of a document to toggle the same of 2^48 bits), and a key joins two
documents only if the sizes and places of both fit. The order puts
frequent bits last, which keeps shared passages out of the keys. (Frequency is counted in every eighth
document and kept in bit filters of a fixed size; the order alone depends on it, never the result.)

*Verify.* Pairs are tested on the folded sketches, then on the sets themselves (64-bit hashes).

Bits that the same documents hold are one key (``_keys``), so a shared passage is met once, not once per
shingle. Pairs of a key are not all made. In STAR_ROUNDS rounds a document meets only the few documents of other
components that most of its keys offer; verified links are contracted to components. Then the keys that
still hold two components give the remaining pairs, all of them, across components only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docwarden.llm.components import components
from docwarden.llm.durable import written
from docwarden.llm.filters import bit_filter, passes
from docwarden.llm.words import Block, bits_to_long, blocks, mixed, record_batch, windows, word_hashes

SHINGLE = 5
SLACK = 2
#: One document of SAMPLE orders the bits; so many of the sample make a bit frequent, or very frequent.
SAMPLE, FREQUENT = 8, (3, 48)
#: Rounds in which documents meet few others, and how many. What they leave is compared pair by pair.
STAR_ROUNDS, MEETINGS = 1, 4

_SIGNATURE = pa.schema([
    ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sum_hash", pa.int64()), ("xor_hash", pa.int64()),
    ("sketch", pa.binary()), ("bits", pa.list_(pa.int64())),
])
_SIGNATURE_DDL = "doc_id long, n_shingles long, sum_hash long, xor_hash long, sketch binary, bits array<long>"
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_SET = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])


def _lower_split(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes: A-Z only


def _sets(block: Block, shingle: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a block."""
    hashes = word_hashes(block.words)
    runs = windows(hashes, shingle)
    for start, end in zip(block.starts, block.ends):
        if end - start >= shingle:
            yield np.unique(runs[start : end - shingle + 1])
        else:
            yield windows(hashes[start:end], int(end - start)) if end > start else runs[:0]


def _odd_bits(shingles: np.ndarray) -> np.ndarray:
    """The set bits of the parity sketch, ascending."""
    bits, counts = np.unique(shingles >> np.uint64(16), return_counts=True)
    return bits[counts % 2 == 1]


def _folded(bits: np.ndarray, n: int) -> bytes:
    """The sketch folded to a power of two of at least four bits per shingle."""
    width = 1 << max(6, int(4 * n - 1).bit_length())
    places, counts = np.unique(bits & np.uint64(width - 1), return_counts=True)
    flags = np.zeros(width, np.uint8)
    flags[places[counts % 2 == 1].astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def _signatures(batches, shingle: int, frequent: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, split=_lower_split):
        rows = []
        for (doc_id,), shingles in zip(block.keys, _sets(block, shingle)):
            n = len(shingles)
            if not n:
                rows.append((doc_id, 0, 0, 0, b"", []))
                continue
            bits = _odd_bits(shingles)
            often = sum(passes(f, bits).astype(np.int8) for f in frequent)
            first = bits[np.lexsort((bits, often))][: n // 4 + SLACK]
            spread = mixed(shingles)
            rows.append((
                doc_id, n, int(np.add.reduce(spread).view(np.int64)), int(np.bitwise_xor.reduce(spread * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)),
                _folded(bits, n), bits_to_long(first).tolist(),
            ))
        yield record_batch(_SIGNATURE, *map(list, zip(*rows)))


def _sampled_bits(batches, shingle: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("bit", pa.int64())])
    for block in blocks(batches, split=_lower_split):
        found = [_odd_bits(s) for s in _sets(block, shingle)]
        yield record_batch(schema, bits_to_long(np.concatenate(found)) if found else [])


def _frequent_bits(texts: DataFrame, shingle: int) -> list[np.ndarray]:
    """Filters of the bits that so many sampled documents hold."""
    sample = texts.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(SAMPLE)) == 0)
    counted = sample.mapInArrow(lambda it: _sampled_bits(it, shingle), "bit long").groupBy("bit").count().filter(F.col("count") >= FREQUENT[0])
    counted = written(counted, "frequent")
    return [bit_filter(counted.filter(F.col("count") >= least).select("bit")) for least in FREQUENT]


def _near_sketches(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, na, nb, sa, sb = (batch.column(n).to_pylist() for n in ("a", "b", "na", "nb", "sa", "sb"))
        keep = []
        for k in range(len(a)):
            x, y = np.frombuffer(sa[k], np.uint64), np.frombuffer(sb[k], np.uint64)
            while len(x) > len(y):
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            while len(y) > len(x):
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            if int(np.bitwise_count(x ^ y).sum()) <= (na[k] + nb[k]) // 7:
                keep.append(k)
        yield record_batch(_PAIR, [a[k] for k in keep], [b[k] for k in keep])


def _only(batches, listed: np.ndarray, inside: bool = True) -> Iterator[pa.RecordBatch]:
    """The rows whose slot, the last column, is in the filter, or those whose slot is not; without it."""
    for batch in batches:
        hit = passes(listed, batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False))
        yield batch.filter(pa.array(hit == inside)).select(range(batch.num_columns - 1))


def _sets_of(batches, shingle: int, listed: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The sets of the documents whose slot is in the filter."""
    for block in blocks(_only(batches, listed), split=_lower_split):
        yield record_batch(_SET, [k[0] for k in block.keys], [s.tobytes() for s in _sets(block, shingle)])


def _similar(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, sa, sb = (batch.column(n).to_pylist() for n in ("a", "b", "sa", "sb"))
        keep = []
        for k in range(len(a)):
            x, y = np.frombuffer(sa[k], np.uint64), np.frombuffer(sb[k], np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= 75 * (len(x) + len(y) - both):
                keep.append(k)
        yield record_batch(_PAIR, [a[k] for k in keep], [b[k] for k in keep])


def _verified(pairs: DataFrame, signatures: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Those of the candidate pairs (a, b) that are similar enough."""
    side = lambda x: signatures.select(
        F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    near = written(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_near_sketches, "a long, b long"), "near")
    slot = F.xxhash64("doc_id")
    found = bit_filter(near.select(F.col("a").alias("doc_id")).union(near.select("b")).select(slot))
    shared = texts.sparkSession.sparkContext.broadcast(found)
    sets = written(
        texts.select("doc_id", "text", slot.alias("slot")).filter("doc_id is not null")
        .mapInArrow(lambda it: _sets_of(it, shingle, shared.value), "doc_id long, shingles binary"), "sets",
    )
    of = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"s{x}"))
    return near.join(of("a"), "a").join(of("b"), "b").mapInArrow(_similar, "a long, b long")


#: Whether a key can be the first shared bit of two similar documents: sizes, and how many bits stand
#: before it in each (all bits of its own; a bit for a collision is allowed).
_FITS = (
    "4L * least({0}.n, {1}.n) >= 3L * greatest({0}.n, {1}.n)"
    " and 2L * ({0}.place - 1) <= (cast({0}.n as long) + {1}.n) div 7 + {0}.n - {1}.n"
    " and 2L * ({1}.place - 1) <= (cast({0}.n as long) + {1}.n) div 7 + {1}.n - {0}.n"
)


def _without(rows: DataFrame, left: DataFrame) -> DataFrame:
    """The rows whose first columns are not a row of ``left``. Only rows that a filter of ``left`` lets pass
    meet it in a join: the others, with their long lists of bits, are not exchanged."""
    listed = rows.sparkSession.sparkContext.broadcast(bit_filter(left.select(F.xxhash64(*left.columns))))
    slotted = rows.withColumn("slot", F.xxhash64(*left.columns))
    others = slotted.mapInArrow(lambda it: _only(it, listed.value, False), rows.schema)
    return others.union(slotted.mapInArrow(lambda it: _only(it, listed.value), rows.schema).join(left, left.columns, "left_anti"))


def _keys(bits: DataFrame) -> DataFrame:
    """Key rows (key, doc_id, n, place) from rows (doc_id, n, place, bit), without bits of one document.

    Bits that the same documents hold, as those of one shared passage, become one key: the sum of the
    hashes of its documents, with the first place that a document has for it. Sizes and first places let
    through every pair that one of the bits does, and so do two sets of documents whose sums are equal."""
    by_bit = Window.partitionBy("bit")
    held = bits.withColumns({
        "first": F.min("doc_id").over(by_bit), "last": F.max("doc_id").over(by_bit),
        "key": F.sum(F.shiftright(F.xxhash64("doc_id"), 24)).over(by_bit),
    })
    return held.filter("first < last").groupBy("key", "doc_id", "n").agg(F.min("place").alias("place"))


def _placed(members: DataFrame, stars: DataFrame) -> DataFrame:
    """Key rows with the component (``part``) of their document."""
    return members.join(stars.select(F.col("a").alias("doc_id"), F.col("b").alias("part")), "doc_id", "left").withColumn(
        "part", F.coalesce("part", "doc_id"))


def _meetings(placed: DataFrame) -> DataFrame:
    """Candidate pairs (a, b): for each document the MEETINGS documents of other components that most of
    its keys offer it. A key offers the first document of its first component, and to that component the
    last of its last."""
    by_key, one = Window.partitionBy("key"), F.struct("part", "doc_id", "n", "place")
    offered = (
        placed.withColumn("low", F.min(one).over(by_key)).withColumn("high", F.max(one).over(by_key)).filter("low.part < high.part")
        .select("doc_id", F.struct("n", "place").alias("own"), F.when(F.col("part") == F.col("low.part"), F.col("high")).otherwise(F.col("low")).alias("other"))
        .filter(_FITS.format("own", "other")).groupBy("doc_id", F.col("other.doc_id").alias("b")).count()
    )
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("count"), "b"))
    return offered.withColumn("rank", rank).filter(F.col("rank") <= MEETINGS).select(F.col("doc_id").alias("a"), "b")


def similarity_components(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_shingles and
    component_id, the smallest doc_id reachable over links of similarity 0.75 or more.

    A document of fewer than ``shingle`` words is one shingle; a null or blank text has none and links
    with nothing. A null id has a null component. Rows that share an id are one document that links
    wherever one of their texts does."""
    texts = docs.select("doc_id", "text")
    frequent = texts.sparkSession.sparkContext.broadcast(_frequent_bits(texts, shingle))
    signatures = written(texts.mapInArrow(lambda it: _signatures(it, shingle, frequent.value), _SIGNATURE_DDL), "signatures")
    known = signatures.filter("doc_id is not null and n_shingles > 0")

    # Equal sets: links to the smallest document, which alone goes on.
    # (Written, so that its keys are unique on a side of the join of its own and the other can be split.)
    same = written(
        known.groupBy("n_shingles", "sum_hash", "xor_hash").agg(F.min("doc_id").alias("b"), F.count("*").alias("rows")).filter("rows > 1").drop("rows"), "same")
    digest = ["n_shingles", "sum_hash", "xor_hash"]
    copied = written(known.select(F.col("doc_id").alias("a"), *digest).join(same, digest).filter("a <> b").distinct(), "copies")
    copies = copied.select("a", "b").distinct()

    # Only the copied set leaves: other texts under the same id keep their keys.
    alone = _without(known.select("doc_id", *digest, "bits"), copied.select(F.col("a").alias("doc_id"), *digest))
    bits = alone.select("doc_id", F.col("n_shingles").cast("int").alias("n"), F.posexplode("bits").alias("place", "bit"))
    members = written(_keys(bits), "members")
    stars = copies
    for _ in range(STAR_ROUNDS):
        placed = _placed(members, stars)
        links = _verified(_meetings(placed), signatures, texts, shingle)
        stars = components(stars.union(links)).select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))

    by_key = Window.partitionBy("key")
    low, high = F.min("part").over(by_key), F.max("part").over(by_key)
    mixed_keys = written(_placed(members, stars).withColumn("low", low).withColumn("high", high).filter("low < high").drop("low", "high"), "mixed")
    x, y = mixed_keys.alias("x"), mixed_keys.alias("y")
    rest = (
        x.join(y, (F.col("x.key") == F.col("y.key")) & F.expr("x.doc_id < y.doc_id and x.part <> y.part") & F.expr(_FITS.format("x", "y")))
        .select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
    )
    more = _verified(rest, signatures, texts, shingle)
    whole = components(stars.union(more))
    return signatures.select("doc_id", "n_shingles").join(whole, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without near copies: of each component the smallest document
    stays, of rows that share an id the first by text. Rows without an id stay."""
    first = similarity_components(docs).filter("doc_id = component_id").select(F.col("doc_id").alias("__first_id")).distinct()
    known = docs.filter("doc_id is not null").join(first, F.col("doc_id") == F.col("__first_id"), "left_semi")
    order = Window.partitionBy("doc_id").orderBy("text", F.xxhash64(*docs.columns))
    alone = known.select("*", F.row_number().over(order).alias("__place")).filter("__place = 1").drop("__place")
    return alone.union(docs.filter("doc_id is null"))
