"""Quality rules with thresholds that adapt to language and source.

Base measures (words, repeats, symbols, lines) come from one pass over the texts. Four integer rates
are made of them. For every (language, source) and every language a quantile sketch is kept of each
rate: a histogram with logarithmic bins (``SUB`` bins per doubling, so a relative error of at most
1 / SUB, as in HDR histograms), which is a sum over rows and so merges in any order and grouping, with
the same result every time. From the sketches come the fences: above the median by
``SPREAD`` times the way to the upper quartile, or by a multiple of the way to a tail quantile (``RATES``),
whichever is more. There is no fixed cutoff: a source whose normal texts are tables gets fences for tables.

The fences of n documents are drawn toward those of the coarser group with a weight of ``PRIOR`` documents:
those of a (language, source) toward its language's, those of a language toward those of all documents. So
a small group has fences near its language's, and there is no size at which the rule changes.

A document is judged by what its counts show at least (``_LEAST``: less two deviations of a count and 2),
so that one symbol in a short text is no evidence. Beyond one of its group's fences it goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docwarden.llm.durable import written
from docwarden.llm.words import blocks, record_batch, windows, word_hashes

#: Base rules (fixed values of the contract): fewer words than this, or a larger share of repeats in percent.
LEAST_WORDS, MOST_REPEATS = 50, 50
SUB, SPREAD, PRIOR = 32, 6, 30
#: Rates in thousandths (of characters, words, lines, and characters per word): tail quantile in percent, and
#: how many times the way to it from the median makes a fence.
RATES = {"symbol_rate": (95, 2), "repeat_rate": (95, 5), "line_rate": (95, 5), "length_rate": (90, 4)}

_MEASURES = pa.schema([
    ("row_key", pa.int64()), ("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()), ("n_words", pa.int64()), ("word_chars", pa.int64()),
    ("n_symbols", pa.int64()), ("n_lines", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
])
_MEASURES_DDL = (
    "row_key long, doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
)
#: What a count shows at least. SQL text.
_LEAST = "greatest({0} - 2L * cast(ceil(sqrt({0})) as long) - 2L, 0L)"
_SYMBOLS = b"#*$%&|<>"
_CONTINUED = bytes(range(0x80, 0xC0))  # bytes that do not begin a code point
_BLANK = b" \t\n\r\x0b\x0c"


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier one."""
    lines = [x for x in text.split(b"\n") if x.strip(_BLANK)]
    return len(lines), len(lines) - len(set(lines))


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts: list[bytes] = []

    def split(text: bytes) -> list[bytes]:
        texts.append(text)
        return text.split()

    for block in blocks(batches, split=split):
        hashes = word_hashes(block.words)
        owner = block.owners()
        starts = block.window_starts(3)
        repeated = np.zeros(len(block.words) + 3, bool)
        if len(starts):
            runs, of = windows(hashes, 3)[starts], owner[starts]
            order = np.lexsort((runs, of))
            same = (runs[order][1:] == runs[order][:-1]) & (of[order][1:] == of[order][:-1])
            found = starts[order[np.r_[False, same] | np.r_[same, False]]]
            for k in range(3):
                repeated[found + k] = True
        repeats = np.bincount(owner[repeated[: len(owner)]], minlength=len(block.counts))
        rows = []
        for key, text, words, repeat in zip(block.keys, texts, block.counts.tolist(), repeats.tolist()):
            lines, dup = _lines(text)
            chars = len(text.translate(None, _BLANK + _CONTINUED))
            rows.append((*key, words, chars, len(text) - len(text.translate(None, _SYMBOLS)), lines, dup, repeat))
        texts.clear()
        yield record_batch(_MEASURES, *map(list, zip(*rows)))


def _row_key():
    """The same for equal rows only; rows may share an id, or have none. (Hashes pass over nulls, so these
    are marked.)"""
    columns = ("doc_id", "lang", "source", "text")
    return F.xxhash64(*columns, *[F.isnull(c) for c in columns])


def measures(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: the base measures and rates beside row_key, doc_id, lang and source."""
    found = docs.select(_row_key().alias("row_key"), "doc_id", "lang", "source", "text").mapInArrow(_measures, _MEASURES_DDL)
    per = lambda part, whole: F.expr(f"1000L * {part} div {whole}")
    return found.withColumns({
        "symbol_rate": per("n_symbols", "greatest(word_chars, 1L)"),
        "repeat_rate": per("n_repeat_words", "greatest(n_words, 1L)"),
        "line_rate": per("n_dup_lines", "greatest(n_lines, 1L)"),
        "length_rate": per("word_chars", "greatest(n_words, 1L)"),
        "symbol_least": per(_LEAST.format("n_symbols"), "greatest(word_chars, 1L)"),
        "repeat_least": per(_LEAST.format("n_repeat_words"), "greatest(n_words, 1L)"),
        "line_least": per(_LEAST.format("n_dup_lines"), "greatest(n_lines, 1L)"),
        "length_least": per("word_chars", "greatest(n_words, 1L)"),
        "base_failed": F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATS} * n_words"),
    })


def _bin(value: str) -> str:
    """The sketch's bin of a whole number: exact below SUB, then SUB bins per doubling. SQL text."""
    bits = f"(length(bin({value})) - {SUB.bit_length()})"
    return f"case when {value} < {SUB} then {value} else {bits} * {SUB} + shiftright({value}, cast({bits} as int)) end"


def _upper(column: str) -> str:
    """The largest number of a bin."""
    return (f"case when {column} < {SUB} then {column} else shiftleft(pmod({column}, {SUB}) + {SUB} + 1L, cast({column} div {SUB} - 1 as int)) - 1 end")


def sketches(measured: DataFrame, *groups: str) -> DataFrame:
    """(groups..., rate, bin, n): the sketches of the rates of rows that pass the base rules."""
    rates = F.expr("stack({}, {}) as (rate, value)".format(len(RATES), ", ".join(f"'{r}', {r}" for r in RATES)))
    return (
        measured.filter("not base_failed").select(*groups, rates).withColumn("bin", F.expr(_bin("value")).cast("long"))
        .groupBy(*groups, "rate", "bin").agg(F.count("*").alias("n"))
    )


def merged(parts: DataFrame, *groups: str) -> DataFrame:
    """Sketches of finer groups merged to coarser ones."""
    return parts.groupBy(*groups, "rate", "bin").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, *groups: str) -> DataFrame:
    """(groups..., n_docs, and a fence for each rate) from sketches, of each group by itself."""
    by = Window.partitionBy(*groups, "rate")
    tail = F.expr("case rate {} end".format(" ".join(f"when '{r}' then {q}" for r, (q, _) in RATES.items())))
    times = F.expr("case rate {} end".format(" ".join(f"when '{r}' then {k}" for r, (_, k) in RATES.items())))
    at = lambda share: F.max(F.when((F.col("before") * 100 < F.col("total") * share) & (F.col("upto") * 100 >= F.col("total") * share), F.expr(_upper("bin"))))
    quantiles = (
        sketch.withColumn("upto", F.sum("n").over(by.orderBy("bin"))).withColumn("before", F.col("upto") - F.col("n")).withColumn("total", F.sum("n").over(by))
        .groupBy(*groups, "rate").agg(F.max("total").alias("n_docs"), at(F.lit(50)).alias("middle"), at(F.lit(75)).alias("upper"), at(tail).alias("tail"))
        .withColumn("fence", F.col("middle") + F.greatest(SPREAD * (F.col("upper") - F.col("middle")), times * (F.col("tail") - F.col("middle"))))
    )
    return quantiles.groupBy(*groups).agg(
        F.max("n_docs").alias("n_docs"), *[F.max(F.when(F.col("rate") == rate, F.col("fence"))).alias(f"{rate}_fence") for rate in RATES])


def group_fences(measured: DataFrame) -> DataFrame:
    """(lang, source, and a fence for each rate): one row per group that has a document which passes the base
    rules; own fences, drawn toward the language's, and these toward those of all documents."""
    fine = sketches(measured, "lang", "source")
    middle = merged(fine, "lang")
    # One row, of the sketch of all documents.
    whole = fences(merged(middle))

    def drawn(own: DataFrame, coarse: DataFrame, on: list, keep: list[str]) -> DataFrame:
        toward = coarse.select(*[F.col(c).alias(f"coarse_{c}") for c in coarse.columns if c != "n_docs"])
        joined = own.join(toward if on else F.broadcast(toward), on or F.lit(True))
        weighed = [F.expr(f"(n_docs * {r}_fence + {PRIOR}L * coarse_{r}_fence) div (n_docs + {PRIOR}L)").alias(f"{r}_fence") for r in RATES]
        return joined.select(*keep, *weighed)

    languages = drawn(fences(middle, "lang"), whole, [], ["lang"])
    return drawn(fences(fine, "lang", "source"), languages, [F.col("lang").eqNullSafe(F.col("coarse_lang"))], ["lang", "source"])


def judged(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang, source): row_key, the base measures, base_failed, kept, and
    the fences that applied. A null language or source is a group of its own, as in GROUP BY. Null and
    blank texts have no words and fail the base rules. Repeated rows count as often as they occur. Extra
    columns are ignored. A group in which no row passes the base rules has no fences, and nothing of it is kept."""
    measured = written(measures(docs), "measures")
    names = [f"{r}_fence" for r in RATES]
    limits = group_fences(measured).withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    measured = measured.join(limits, [F.col(g).eqNullSafe(F.col(f"of_{g}")) for g in ("lang", "source")], "left")
    inside = " and ".join(f"{r.replace('_rate', '_least')} <= {r}_fence" for r in RATES)
    return measured.withColumn("kept", F.expr(f"coalesce(not base_failed and {inside}, false)")).select(
        "row_key", "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *names)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept. Repeated rows stay repeated."""
    kept = judged(docs).filter("kept").select(F.col("row_key").alias("__kept_key")).distinct()
    return docs.join(kept, _row_key() == F.col("__kept_key"), "left_semi")
