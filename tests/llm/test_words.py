import re

import numpy as np
import pyarrow as pa

from docwarden.llm.words import blocks, windows, word_hashes


def batches(rows, size=3):
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})
    return iter(table.to_batches(max_chunksize=size))


def test_words_are_those_of_the_expression():
    text = "a\x1cb c   d\x0be\rf\tg\nh  i\x85"
    [block] = blocks(batches([(1, text)]))
    assert [w.decode() for w in block.words] == re.findall(r"[^\x20\x09-\x0D]+", text)


def test_windows_are_equal_exactly_for_equal_runs():
    rng = np.random.default_rng(0)
    words = [b"%d" % x for x in rng.integers(0, 3, 400)]
    for k in (1, 2, 3, 5, 8, 25, 50):
        found, runs = windows(word_hashes(words), k), [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
        assert len(found) == len(runs)
        assert len(set(found.tolist())) == len(set(runs)) == len(set(zip(found.tolist(), runs)))


def test_blocks_hold_whole_documents_and_window_starts_stay_inside():
    rows = [(i, "w " * (i % 7)) for i in range(50)] + [(None, None)]
    seen = []
    for block in blocks(batches(rows), block_words=10):
        starts = block.window_starts(3)
        owner = block.owners()
        assert all(owner[s] == owner[s + 2] for s in starts)
        seen += [(k[0], c) for k, c in zip(block.keys, block.counts)]
    assert seen == [(i, i % 7) for i in range(50)] + [(None, 0)]
