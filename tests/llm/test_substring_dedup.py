import hashlib
import random
import re

from docwarden.llm.substring_dedup import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def model(rows, depth):
    """Removed places by comparing every window with those of smaller ids."""
    first = {}
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        for s in range(len(words) - depth + 1):
            key = tuple(words[s : s + depth])
            if doc_id is not None:
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        gone = set()
        for s in range(len(words) - depth + 1):
            if doc_id is not None and first[tuple(words[s : s + depth])] < doc_id:
                gone |= set(range(s, s + depth))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((doc_id, len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=repr)


def test_shared_passages_edits_and_copies(frame):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 90))]
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(0, len(words) + 1)
            low = rng.randrange(0, 15)
            words[at:at] = passage[low : low + rng.randrange(5, 40)]
        rows.append((i * 3 % 61, " ".join(words)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, rows[5][1] + " " + rows[3][1])]
    assert rows_of(remove_repeats(frame(rows), depth=10)) == model(rows, 10)


def test_odd_rows(frame, odd_rows):
    assert rows_of(remove_repeats(frame(odd_rows))) == model([r[:2] for r in odd_rows], 50)


def test_kept_text_and_empty_table(frame):
    a = " ".join(f"a{i}" for i in range(60))
    got = {r.doc_id: r.kept_text for r in remove_repeats(frame([(1, a), (2, "x " + a + " y")]), with_text=True).collect()}
    assert got == {1: a, 2: "x y"}
    assert remove_repeats(frame([])).count() == 0


def test_periodic_texts_that_differ_in_one_word(frame):
    rows = []
    for k in range(60):
        for j, rare in enumerate(("r s t", "q s t", "r s u", "r v t")):
            a, b, c = rare.split()
            line = [f"z{k}"] * 5
            rows.append((4 * k + j, " ".join([*line, a, *line, b, *line, c, *line])))
    rows += [(1000 + k, "0 " * 90 + f"{k} " + "0 " * 40) for k in range(4)]
    for depth in (10, 11):
        assert rows_of(remove_repeats(frame(rows), depth=depth)) == model(rows, depth)
