"""Removal of passages that an earlier document already has.

The suffixes of all documents (one per word, to a depth of ``depth`` words) are grouped by hashes. No
suffix tree is built, no subtrees and no inner nodes; the words below name what the groups would be in one
truncated at ``depth``. Prefixes of three lengths are used, each for the suffixes that the shorter leaves
open:

1. A suffix's short prefix is the smallest hash among the ``depth // 2``-word runs that start in its
   first ``depth - depth // 2 + 1`` words. It is decided by the suffix's words alone, so equal suffixes
   fall under equal prefixes, and neighbouring suffixes mostly share theirs: one row per run of such
   neighbours, about four per ``depth`` words, describes them all; longer runs, as periodic texts have,
   are cut. A prefix that only one document has
   is a leaf edge; no repeat lies below it and its suffixes go no further.
2. Below a shared prefix, runs are told apart by all the words that their suffixes cover. A run whose
   words an earlier document has too is a maximal repeat of the whole run: all its suffixes go.
3. Where one short prefix has runs of different words (at the borders of a passage, at edits), their
   suffixes get the long prefix of ``depth`` words, for one run of each kind. A node at that depth with
   leaves in two documents is a deep internal node: everything above it is a repeat.

Nodes are minima over leaves, so a node with a third of all leaves is combined in the tasks that hold
them and never gathered. A leaf is removed when its node has a leaf in a document with a smaller id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwarden.llm.durable import written
from docwarden.llm.words import bits_to_long, blocks, joined, record_batch, windows, word_hashes

DEPTH = 50

_RUNS = pa.schema([
    ("doc_id", pa.int64()), ("prefix", pa.int64()), ("first", pa.int32()), ("suffixes", pa.int32()), ("head", pa.int64()), ("tail", pa.int64()),
])
_RUNS_DDL = "doc_id long, prefix long, first int, suffixes int, head long, tail long"
_LEAVES = pa.schema([("doc_id", pa.int64()), ("head", pa.int64()), ("tail", pa.int64()), ("place", pa.int32())])
_KEPT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string()),
])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _prefix_runs(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    short = depth // 2
    for block in blocks(batches):
        starts = block.window_starts(depth)
        if not len(starts):
            continue
        grams = windows(word_hashes(block.words), short)
        prefix = _sliding_min(grams, depth - short + 1)[starts]
        owner = block.owners()[starts]
        new = np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1]) | (owner[1:] != owner[:-1])])
        # Longer runs (periodic texts) are cut, so that the hashes below cover every word of a run.
        length = np.diff(np.r_[new, len(prefix)])
        most = min(depth - short + 1, 3 * short - depth + 2)
        new = np.flatnonzero((np.arange(len(prefix)) - np.repeat(new, length)) % most == 0)
        length = np.diff(np.r_[new, len(prefix)])
        # Short runs of words that together cover the words of a run, hashed in two ways.
        low, high = starts[new], starts[new] + length - 1 + depth - short
        low_half, high_half = low + (length - 1 + depth - short) // 2, low + (length + depth - short) // 2
        head = joined(joined(grams[low], grams[high]), length.astype(np.uint64))
        tail = joined(joined(grams[high], grams[low_half]), grams[high_half])
        ids = np.array([-1 if k[0] is None else k[0] for k in block.keys], np.int64)
        known = np.array([k[0] is not None for k in block.keys])[owner[new]]
        place = (starts - block.starts[owner])[new]
        yield record_batch(
            _RUNS, ids[owner[new]][known], bits_to_long(prefix[new])[known], place[known].astype(np.int32), length[known].astype(np.int32),
            bits_to_long(head)[known], bits_to_long(tail)[known],
        )


def _leaves(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Suffixes, with their long prefix, of the runs listed beside each text."""
    short = depth // 2
    for block in blocks(batches):
        runs = windows(word_hashes(block.words), short)
        rest = windows(word_hashes(block.words), depth - short) if depth - short != short else runs
        for (doc_id, listed), start, count in zip(block.keys, block.starts, block.counts):
            places = np.unique(np.concatenate([np.arange(r["first"], r["first"] + r["suffixes"]) for r in listed]))
            places = places[places + depth <= count]  # rows that share an id may have other texts
            yield record_batch(
                _LEAVES, np.full(len(places), doc_id), bits_to_long(runs[start + places]), bits_to_long(rest[start + places + short]),
                places.astype(np.int32),
            )


def _without(batches: Iterator[pa.RecordBatch], depth: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, block_words=1 << 16):
        rows = []
        for i, (doc_id, places) in enumerate(block.keys):
            words = block.words[block.starts[i] : block.ends[i]]
            if places:
                edge = np.zeros(len(words) + 1, np.int64)
                low = np.array([r["first"] for r in places])
                high = np.minimum(low + np.array([r["suffixes"] for r in places]) - 1 + depth, len(words))
                fits = low + depth <= len(words)
                np.add.at(edge, low[fits], 1)
                np.add.at(edge, high[fits], -1)
                kept = [words[j] for j in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
            else:
                kept = words
            text = b" ".join(kept)
            rows.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode() if with_text else None))
        yield record_batch(_KEPT, *map(list, zip(*rows)))


def remove_repeats(docs: DataFrame, depth: int = DEPTH, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): n_words, n_removed, the
    SHA-256 of the kept words joined by one space and, on request, that text.

    Null and blank texts have no words. Documents of fewer than ``depth`` words lose nothing. Equal ids
    are not smaller than each other, so repeated rows spare each other; rows that share an id share
    their removals. A null id is nobody's smaller id and loses nothing."""
    texts = docs.select("doc_id", "text")
    runs = texts.mapInArrow(lambda it: _prefix_runs(it, depth), _RUNS_DDL)
    # Aggregates are written before they are joined back: their keys are then unique on a side of its own,
    # and a key with many rows on the other side can be split between tasks.
    shared = written(
        runs.groupBy("prefix").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("prefix"), "prefixes"
    )
    below = written(runs.join(shared, "prefix"), "runs")
    kinds = written(below.groupBy("prefix", "suffixes", "head", "tail").agg(F.min("doc_id").alias("low")), "kinds")
    told = below.join(kinds, ["prefix", "suffixes", "head", "tail"])
    open_prefixes = kinds.groupBy("prefix").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("prefix")
    listed = (
        told.filter("doc_id = low").join(open_prefixes, "prefix").groupBy("doc_id").agg(F.collect_set(F.struct("first", "suffixes")).alias("runs"))
    )
    leaves = written(texts.join(listed, "doc_id").mapInArrow(lambda it: _leaves(it, depth), "doc_id long, head long, tail long, place int"), "leaves")
    nodes = written(
        leaves.groupBy("head", "tail").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
        .select("head", "tail", "low"), "nodes",
    )
    removed = (
        told.filter("doc_id > low").select("doc_id", "first", "suffixes")
        .union(leaves.join(nodes, ["head", "tail"]).filter("doc_id > low").select("doc_id", F.col("place").alias("first"), F.lit(1)))
        .groupBy("doc_id").agg(F.collect_set(F.struct("first", "suffixes")).alias("places"))
    )
    return texts.join(removed, "doc_id", "left").mapInArrow(
        lambda it: _without(it, depth, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )
