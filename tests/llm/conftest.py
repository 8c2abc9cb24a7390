import pytest

#: Columns that an operator must neither need nor trip over.
CLASHES = ("place", "bucket", "count", "first", "part", "row_key", "spans", "slot", "number", "size")


@pytest.fixture(scope="session")
def frame(spark):
    """Rows (doc_id, text, ...) as a documents table with columns whose names operators use themselves."""

    def make(rows, clashes=CLASHES):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        for k, name in enumerate(clashes):
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit(k))
        return df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, blanks, a very long text, repeated rows, ties, a row without an id."""
    prose = " ".join(f"word{i * 7919 % 1000}" for i in range(120))
    return [
        (1, prose), (1, prose), (2, None), (3, ""), (4, " \n\t "), (5, "one"), (6, prose + " tail"), (None, prose), (7, "x " * 60_000),
        (8, "Ünïcode wörds   and  more 日本語 😀"), (9, prose.upper(), None, None), (10, "a b c d e"),
    ]
