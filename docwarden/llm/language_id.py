"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are the 2- to 4-character runs of the lower-cased words, their ends marked, hashed into
``BUCKETS``. A text is the mean of its subwords' embeddings; a linear layer and a softmax give the
languages. Both layers are trained by stochastic gradient descent in numpy on a bounded sample of the
labelled rows (``TRAIN_ROWS``, spread over the languages); whole texts are counted by Spark tasks and
only the counts reach the driver. A temperature makes the scores honest, and the score under which a
prediction is rejected is the ``REJECT`` quantile of the scores of correct predictions, both on rows
of the sample that training left out.

The mean is linear, so that prediction needs one product of two small layers: a row per bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.llm.words import record_batch

BUCKETS, DIMENSIONS, SIZES = 4096, 16, (2, 3, 4)
TRAIN_ROWS = 2_000
EPOCHS, RATE, BATCH = 30, 4.0, 32
REJECT = 0.01
UNKNOWN = "und"
#: Characters that are counted at once; a longer text is counted in parts.
PART = 1 << 20

_MARK = ord(" ")
_PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
_PREDICTED_DDL = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"
_COUNTS = pa.schema([("key", pa.int64()), ("lang", pa.string()), ("counts", pa.binary())])


def held_out(doc_id: Column) -> Column:
    """Whether the id's rows are kept from training. A null id is kept from it too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


_folded: list[np.ndarray] = []


def _fold_table() -> np.ndarray:
    """For every code point its lower-case letter, or a word end."""
    if not _folded:
        table = np.full(0x110000, _MARK, np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                table[c] = ord(low[0])
        _folded.append(table)
    return _folded[0]


def subword_counts(text: str) -> np.ndarray:
    """How often each bucket occurs in the whole text; all zero if it has no letter."""
    total = np.zeros(BUCKETS, np.int64)
    for low in range(0, len(text), PART):
        part = text[max(0, low - max(SIZES)) : low + PART] if low else text[:PART]
        codes = np.concatenate([[_MARK], _fold_table()[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)], [_MARK]]).astype(np.uint32)
        ends = codes == _MARK
        mixed = codes * np.uint32(0x9E3779B1)
        run = mixed
        for size in range(2, max(SIZES) + 1):
            run = (run[:-1] * np.uint32(0x85EBCA6B)) ^ (mixed[size - 1 :] >> np.uint32(size))
            # An end may only stand first or last, and not alone.
            inner = ends[:-1] & ends[1:] if size == 2 else np.logical_or.reduce([ends[k : len(ends) - size + 1 + k] for k in range(1, size - 1)])
            if size in SIZES:
                hashed = (run ^ (run >> np.uint32(15))) * np.uint32(0x2C1B3C6D + size)
                total += np.bincount((hashed >> np.uint32(20))[~inner], minlength=BUCKETS)
    return total


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # bucket x language: embeddings times output layer
    temperature: float = 1.0
    least: float = 0.0

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Probabilities of the languages for rows of counts."""
        total = counts.sum(axis=1, keepdims=True)
        logits = counts @ self.weights / np.maximum(total, 1) / self.temperature
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)


def train(counts: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 11) -> Model:
    """Counts (rows x buckets) with label numbers to a calibrated model. A fifth of the rows, spread
    evenly, calibrates; with fewer than ten rows all do both."""
    place = np.arange(len(labels))
    apart = place % 5 == 4 if len(labels) >= 10 else np.ones(len(labels), bool)
    rows = ~apart if len(labels) >= 10 else apart
    features = (counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out = np.zeros((DIMENSIONS, len(languages)), np.float32)
    known = np.flatnonzero(rows)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(known)
        for low in range(0, len(order), BATCH):
            at = order[low : low + BATCH]
            x, hidden = features[at], features[at] @ embed
            logits = hidden @ out
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = odds / odds.sum(axis=1, keepdims=True)
            error[np.arange(len(at)), labels[at]] -= 1
            error /= len(at)
            step = x.T @ (error @ out.T)
            out -= rate * (hidden.T @ error)
            embed -= rate * len(languages) * step
    model = Model(languages, (embed @ out).astype(np.float64))
    if apart.any():
        held, right = counts[apart], labels[apart]
        losses = []
        options = np.geomspace(0.05, 5, 41)
        for t in options:
            model.temperature = t
            losses.append(-np.log(np.maximum(model.scores(held)[np.arange(len(right)), right], 1e-12)).mean())
        model.temperature = float(options[int(np.argmin(losses))])
        found = model.scores(held)
        good = found.argmax(axis=1) == right
        model.least = float(np.quantile(found.max(axis=1)[good], REJECT)) if good.any() else 0.0
    return model


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, text, lang in zip(*(batch.column(i).to_pylist() for i in range(3))):
            counts = subword_counts(text)
            if counts.any():
                yield record_batch(_COUNTS, [key], [lang], [counts.astype(np.float32).tobytes()])


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Trains on rows (doc_id, text, lang) that are labelled and not held out: those with the smallest
    hashes of their ids, about as many of each language as of any other, ``train_rows`` at most."""
    labelled = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row per language
    if not sizes:
        return Model([UNKNOWN], np.zeros((BUCKETS, 1)))
    share = max(1, train_rows // len(sizes))
    spread = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30))
    cut = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1 << 30, int((1 << 30) * 1.3 * share / n) + 1))) for lang, n in sizes.items()])
    chosen = labelled.filter(spread < cut).select(F.xxhash64("doc_id", F.lit(3)).alias("key"), "text", "lang")
    rows = chosen.mapInArrow(_counted, "key long, lang string, counts binary").orderBy("key", "lang").limit(train_rows).collect()
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return Model([UNKNOWN], np.zeros((BUCKETS, 1)))
    counts = np.stack([np.frombuffer(r["counts"], np.float32) for r in rows])
    return train(counts, np.array([languages.index(r["lang"]) for r in rows]), languages)


def _predicted(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2)
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            counts = np.stack([subword_counts(t or "") for t in texts.slice(low, 256).to_pylist()]).astype(np.float64)
            scores = model.scores(counts)
            best = scores.argmax(axis=1)
            score = scores[np.arange(len(best)), best]
            some = counts.any(axis=1)
            yield record_batch(
                _PREDICTED, part.column(0), part.column(1), [model.languages[b] if s else UNKNOWN for b, s in zip(best, some)],
                np.where(some, score, 0.0), ~some | (score < model.least),
            )


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): held_out, lang_pred, score
    and rejected. A null text or one without letters is ``und`` with score 0, rejected. A rejected
    prediction keeps its language, so the caller decides."""
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(lambda it: _predicted(it, model), _PREDICTED_DDL)
