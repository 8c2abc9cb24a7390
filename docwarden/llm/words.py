"""Words and their hashes, over blocks of many documents at a time.

A word is ``[^\\x20\\x09-\\x0D]+``: what ``bytes.split()`` gives. A document's words stay in order; the
blocks hold whole documents, so a window never needs words of another block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

#: Words after which a block is closed. One longer document is a block of its own.
BLOCK_WORDS = 1 << 18
#: Odd multipliers of the rolling hashes; any fixed odd numbers do.
_LEFT, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(left * _LEFT + right)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k hashes, by its first place; built from runs of powers of two."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, run, size = None, 0, hashes, 1
    while True:
        if k & size:
            part = run[done : done + n]
            out = part.copy() if out is None else joined(out, part)
            done += size
        if size * 2 > k:
            return mixed(out + np.uint64(k))
        run, size = joined(run[:-size], run[size:]), size * 2


def bits_to_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Block:
    """Documents in order: their rows' other values, word counts, and all their words on end."""

    def __init__(self, keys: list[tuple], texts: list[bytes], split: Callable[[bytes], list[bytes]]):
        self.keys = keys
        words = [split(t) for t in texts]
        self.counts = np.array([len(w) for w in words], np.int64)
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts
        self.words = [w for ws in words for w in ws]

    def owners(self) -> np.ndarray:
        """For each word, the place of its document in the block."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def window_starts(self, k: int) -> np.ndarray:
        """The places of all words at which a window of k words of one document starts."""
        owner = self.owners()
        place = np.arange(len(owner))
        return place[self.ends[owner] - place >= k] if len(owner) else place


def blocks(
    batches: Iterator[pa.RecordBatch], text: str = "text", split: Callable[[bytes], list[bytes]] = bytes.split, block_words: int = BLOCK_WORDS
) -> Iterator[Block]:
    """Blocks of the rows of Arrow batches. A null text has no words; all other columns become the keys."""
    keys, texts, size = [], [], 0
    for batch in batches:
        others = [batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names) if name != text]
        column = batch.column(batch.schema.names.index(text)).cast(pa.binary())
        for i, value in enumerate(column):
            content = value.as_py() or b""
            if texts and size + len(content) // 6 > block_words:
                yield Block(keys, texts, split)
                keys, texts, size = [], [], 0
            keys.append(tuple(c[i] for c in others))
            texts.append(content)
            size += len(content) // 6
    if texts:
        yield Block(keys, texts, split)


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)
