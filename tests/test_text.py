"""Text expressions against small Python models, many cases per job."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from docwarden.functions import text as X

ALPHABET = ["a", "B", "é", "文", ".", "!", "?", " ", " ", "\n", "\n", "\t", "\r", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", "　", "𝄞"]


def texts(n, length, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, length))) for _ in range(n)]


def model_groups(lengths, limit, sep):
    starts, size = [], None
    for i, n in enumerate(lengths):
        if size is None or size + sep + n > limit:
            starts.append(i)
            size = n
        else:
            size += sep + n
    return starts


def test_strip_and_paragraphs_match_python(spark):
    cases = texts(400, 60, 1) + ["", " ", "\n\n", "a\n \n\nb", "​ x ​"]
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    rows = df.select("t", X.strip(F.col("t")).alias("s"), X.paragraphs(F.col("t")).alias("p"), X.sentences(F.col("t")).alias("q")).collect()
    for r in rows:
        assert r.s == r.t.strip()
        assert r.p == [b.strip() for b in re.split(r"\n\s*\n+", r.t) if b.strip()]
        assert r.q == [s for s in re.split(r"(?<=[.!?])\s+", r.t) if s]


def test_whitespace_is_exactly_pythons():
    assert set(X.WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


@pytest.mark.parametrize("limit,sep", [(10, 2), (25, 1), (1, 0)])
def test_greedy_starts_matches_model(spark, limit, sep):
    rng = random.Random(limit)
    cases = [[rng.randint(0, 15) for _ in range(rng.randint(0, 30))] for _ in range(200)] + [[]]
    df = spark.createDataFrame([(c,) for c in cases], "n array<int>")
    for r in df.select("n", X.greedy_starts(F.col("n"), limit, sep).alias("s")).collect():
        assert r.s == model_groups(r.n, limit, sep)


def test_hard_slices_are_lossless(spark):
    cases = ["x", "abcd", "𝄞é文a" * 5]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    for r in df.select("t", X.hard_slices(F.col("t"), 4).alias("s")).collect():
        assert "".join(r.s) == r.t and max(map(len, r.s)) <= 4


def test_stable_id(spark):
    df = spark.createDataFrame([("a", "bc", None), ("ab", "c", None), ("a", None, "x")], "x string, y string, z string")
    ids = [r[0] for r in df.select(X.stable_id(F.col("x"), F.col("y"))).collect()]
    assert ids == [hashlib.sha256(p.encode()).hexdigest()[:32] for p in ("a\x1fbc", "ab\x1fc", "a\x1f")]
    assert len(set(ids)) == 3
    with pytest.raises(ValueError):
        X.stable_id()


def test_estimated_tokens(spark):
    df = spark.createDataFrame([("",), ("abc",), ("x" * 8000,), ("é" * 9,)], "t string")
    assert [r[0] for r in df.select(X.estimated_tokens(F.col("t"))).collect()] == [1, 1, 2000, 2]
