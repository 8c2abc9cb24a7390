"""Exact vector top-K, relevance threshold, greedy de-duplication and token budget.

Shape of the work for a batch of questions over a very large corpus:

* each task scores its own corpus rows with one matrix product per Arrow batch and keeps only its best K
  per question;
* before that, the first rows of every task are scored alone. The K-th best of them is a lower bound of the
  K-th best of all, so later rows below it never leave a task: what leaves all tasks together stays near K
  rows per question, however many tasks there are;
* tasks send ids and scores only. Vectors and other columns are fetched for the final winners by a join;
* the winners of the tasks are merged in two steps, first per (question, salt), then per question, so that
  no single task receives the winners of every partition of the corpus.

Up to ``MAX_QUERY_ROWS`` questions are shipped to the tasks, and no corpus row is shuffled. More questions
never pass through the driver: question groups and corpus splits are dealt to a grid of tasks, one for each
group and split.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from docwarden.functions.vectors import dot
from docwarden.sources.tables import written

# The retrieval defaults.
RELEVANCE_THRESHOLD = 0.5
DEDUP_THRESHOLD = 0.97
CANDIDATE_POOL = 40
MAX_CONTEXT_TOKENS = 6000

# Rows of the question side sent to all tasks: 4,096 vectors of 1,536 doubles are 50 MB.
MAX_QUERY_ROWS = 4096

# Questions of a group and corpus rows of a split in the grid of tasks, on average.
GROUP_ROWS, SPLIT_ROWS = 1024, 16_384

# Rows of each task that give the first lower bounds.
SAMPLE_ROWS = 512

# Parts into which one question's winners are split before the last merge.
MAX_SALTS = 1024

# Rounding head-room between the matrix product, which picks candidates, and the ordered sum
# that ranks them.
_SLACK = 1e-9

# Size of the score matrix (questions x rows) held at once by a task: 16 MB of doubles.
_SCORES_AT_ONCE = 2_000_000


def top_k(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = CANDIDATE_POOL,
    *,
    carry: Sequence[str] = (),
    keep_vectors_from: float | None = None,
) -> DataFrame:
    """The ``k`` nearest corpus rows of every question by cosine similarity.

    ``queries(query_id, embedding)``, ``corpus(chunk_id, embedding, *carry)``, where ``chunk_id`` names one
    row; rows without an embedding are not candidates, and a question without one has no hits. Ties go to the
    lower ``chunk_id``; a zero vector has NULL similarity and ranks last. With ``keep_vectors_from``, rows
    below that similarity come without their vector, as no later step looks at it.

    Returns ``query_id, rank, chunk_id, similarity, embedding, *carry``.
    """
    # Written, so that the join below knows their size and the scores are worked out once.
    hits = written(nearest(queries, corpus, k), "hits")
    found = hits.join(corpus.where(F.col("embedding").isNotNull()).select("chunk_id", "embedding", *carry), "chunk_id")
    if keep_vectors_from is not None:
        found = found.withColumn("embedding", F.when(F.col("similarity") >= keep_vectors_from, F.col("embedding")))
    return found.select("query_id", "rank", "chunk_id", "similarity", "embedding", *carry)


def nearest(queries: DataFrame, corpus: DataFrame, k: int = CANDIDATE_POOL) -> DataFrame:
    """``query_id, rank, chunk_id, similarity`` of :func:`top_k`, from the columns ``chunk_id`` and
    ``embedding`` of ``corpus`` alone."""
    return _merged(local_winners(queries, corpus, k), k)


def local_winners(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """``query_id, similarity, chunk_id`` of the rows that leave the tasks: each task's best ``k`` per
    question that reach the question's lower bound."""
    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = corpus.where(F.col("embedding").isNotNull()).select("chunk_id", "embedding")
    if asked.limit(MAX_QUERY_ROWS + 1).count() <= MAX_QUERY_ROWS:
        questions, kind = asked.toArrow(), asked.schema["query_id"].dataType
        floors = _floors(_shipped(rows, questions, kind, None, k, SAMPLE_ROWS), k).toArrow()
        return _shipped(rows, questions, kind, floors, k)
    # Tasks of a partial read: a split's rows come from all over the corpus.
    groups, splits = asked.count() // GROUP_ROWS + 1, corpus.count() // SPLIT_ROWS + 1
    sample = rows.mapInArrow(_heads, rows.schema)
    bounds = _floors(_grid(sample, asked.withColumn("floor", F.lit(None).cast("double")), groups, splits // 64 + 1, k), k)
    return _grid(rows, asked.join(written(bounds, "floors"), "query_id", "left"), groups, splits, k)


def _merged(local: DataFrame, k: int) -> DataFrame:
    best = [F.col("similarity").desc_nulls_last(), F.col("chunk_id")]
    salts = min(MAX_SALTS, int(local.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = local.withColumn("_salt", F.pmod(F.xxhash64("chunk_id"), F.lit(salts)))
    merged = _first_k(salted, Window.partitionBy("query_id", "_salt").orderBy(*best), k).drop("_salt", "rank")
    return _first_k(merged, Window.partitionBy("query_id").orderBy(*best), k).select("query_id", "rank", "chunk_id", "similarity")


def _floors(sampled: DataFrame, k: int) -> DataFrame:
    """``query_id, floor``: the k-th best score of a part of the corpus, where there is one."""
    return _merged(sampled, k).where((F.col("rank") == k) & F.col("similarity").isNotNull()).select("query_id", F.col("similarity").alias("floor"))


def _first_k(df: DataFrame, window, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(window).cast("long")).where(F.col("rank") <= k)


def _result_schema(query_type: T.DataType, corpus: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", query_type), T.StructField("similarity", T.DoubleType()), T.StructField("chunk_id", corpus.schema["chunk_id"].dataType),
    ])


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first ``SAMPLE_ROWS`` rows of a task; the rest of its input is not read."""
    left = SAMPLE_ROWS
    for batch in batches:
        yield batch.slice(0, left)
        left -= batch.num_rows
        if left <= 0:
            return


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    return np.array(vectors.to_pylist(), dtype=np.float64).reshape(len(vectors), -1 if len(vectors) else 0)


def _shipped(corpus: DataFrame, questions: pa.Table, query_type: T.DataType, floors: pa.Table | None, k: int, first_rows: int | None = None) -> DataFrame:
    """Winners of each corpus task, all questions being sent to every task."""
    ids = questions.column("query_id").combine_chunks()
    if len(ids.unique()) != len(ids):
        raise ValueError("query_id must be unique")
    known = dict(zip(floors.column("query_id").to_pylist(), floors.column("floor").to_pylist())) if floors is not None else {}
    bounds = np.array([known.get(i, -np.inf) for i in ids.to_pylist()])
    shipped = corpus.sparkSession.sparkContext.broadcast((ids, _matrix(questions.column("embedding")), bounds))

    def run(batches):
        names, vectors, low = shipped.value
        if not len(names):
            return
        best, left = _PartitionBest(vectors, k, low), first_rows
        for batch in batches:
            best.add(batch if left is None else batch.slice(0, left))
            left = None if left is None else left - batch.num_rows
            if left is not None and left <= 0:
                break
        yield from best.result(names)

    return corpus.mapInArrow(run, _result_schema(query_type, corpus))


def _every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def _grid(corpus: DataFrame, questions: DataFrame, groups: int, splits: int, k: int) -> DataFrame:
    """Winners of each cell (question group, corpus split). Every question meets every split once."""
    split, group = F.pmod(F.xxhash64("chunk_id"), F.lit(splits)), F.pmod(F.xxhash64("query_id"), F.lit(groups))
    rows = corpus.select(split.alias("split"), _every(groups).alias("group"), "chunk_id", "embedding")
    asked = questions.select(
        _every(splits).alias("of_split"), group.alias("of_group"), "query_id", "embedding", "floor")

    def cell(rows: pa.Table, asked: pa.Table) -> pa.Table:
        ids = asked.column("query_id").combine_chunks()
        if len(ids.unique()) != len(ids):
            raise ValueError("query_id must be unique")
        names = pa.schema([("query_id", ids.type), ("similarity", pa.float64()), ("chunk_id", rows.schema.field("chunk_id").type)])
        if not len(ids) or not rows.num_rows:
            return names.empty_table()
        floors = asked.column("floor").fill_null(-np.inf).to_numpy()
        best = _PartitionBest(_matrix(asked.column("embedding")), k, floors)
        for batch in rows.select(["chunk_id", "embedding"]).to_batches():
            best.add(batch)
        return pa.Table.from_batches(best.result(ids), schema=names)

    return rows.groupBy("split", "group").cogroup(asked.groupBy("of_split", "of_group")).applyInArrow(
        cell, _result_schema(questions.schema["query_id"].dataType, corpus))


class _PartitionBest:
    """Best ``k`` rows per question among the batches of one task, of those that reach ``floor``. Each row
    is stored once, however many questions it serves."""

    def __init__(self, vectors: np.ndarray, k: int, floor: np.ndarray):
        self.k = k
        self.given = floor
        self.vectors = vectors
        self.columns = np.ascontiguousarray(vectors.T)
        every = np.arange(len(vectors))
        self.squares = _ordered_dot(self.columns, every, self.columns, every)
        norms = np.sqrt(self.squares)
        self.unit = np.divide(vectors, norms[:, None], out=np.zeros_like(vectors), where=norms[:, None] > 0)
        self.floor = floor
        self.kind: pa.DataType | None = None
        self.ids = np.empty(0)
        self.query = np.empty(0, dtype=np.int64)
        self.row = np.empty(0, dtype=np.int64)
        self.sim = np.empty(0)

    def add(self, batch: pa.RecordBatch) -> None:
        step = max(1, _SCORES_AT_ONCE // max(1, len(self.vectors)))
        for start in range(0, batch.num_rows, step):
            self._add(batch.slice(start, step))

    def _add(self, batch: pa.RecordBatch) -> None:
        n, width = batch.num_rows, self.vectors.shape[1]
        lengths = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
        if (lengths != width).any():
            raise ValueError(f"corpus vector length differs from the query length {width}")
        stored = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(n, width)
        x = stored.astype(np.float64)
        norms = np.sqrt(np.einsum("ij,ij->i", x, x))
        unit = np.divide(x, norms[:, None], out=np.zeros_like(x), where=norms[:, None] > 0)
        approx = self.unit @ unit.T
        approx[~np.isfinite(approx)] = -2.0
        floor = self.floor
        if n > self.k:
            floor = np.maximum(floor, np.partition(approx, n - self.k, axis=1)[:, n - self.k])
        q, r = np.nonzero(approx >= (floor - _SLACK)[:, None])
        if len(q) == 0:
            return
        if len(q) > n:
            wanted = self._first_copies(batch, stored)[r]
            q, r = q[wanted], r[wanted]

        used, position = np.unique(r, return_inverse=True)
        columns = np.ascontiguousarray(x[used].T)
        every = np.arange(len(used))
        squares = _ordered_dot(columns, every, columns, every)
        with np.errstate(divide="ignore", invalid="ignore"):
            sim = _ordered_dot(self.columns, q, columns, position) / np.sqrt(self.squares[q] * squares[position])
        sim[~np.isfinite(sim)] = -np.inf

        self.kind = batch.column("chunk_id").type
        new_ids = np.array(batch.column("chunk_id").take(pa.array(used)).to_pylist())
        self.row = np.concatenate([self.row, len(self.ids) + position])
        self.ids = np.concatenate([self.ids, new_ids]) if len(self.ids) else new_ids
        self.query = np.concatenate([self.query, q])
        self.sim = np.concatenate([self.sim, sim])
        self._trim()
        if len(self.ids) > 4 * len(np.unique(self.row)) + 1000:
            self._compact()

    def _first_copies(self, batch: pa.RecordBatch, stored: np.ndarray) -> np.ndarray:
        """Marks the ``k`` lowest ids of each distinct vector. Further copies tie with these and
        lose, so a corpus full of copies costs no more than one without."""
        whole = np.ascontiguousarray(stored).view(np.dtype((np.void, stored.dtype.itemsize * stored.shape[1]))).ravel()
        _, vector = np.unique(whole, return_inverse=True)
        ids = np.array(batch.column("chunk_id").to_pylist())
        marked = np.zeros(len(ids), dtype=bool)
        marked[_first_of_each(vector, (ids,), self.k)] = True
        return marked

    def _trim(self) -> None:
        kept = _first_of_each(self.query, (self.ids[self.row], -self.sim), self.k)
        self.query, self.row, self.sim = self.query[kept], self.row[kept], self.sim[kept]
        full = np.bincount(self.query, minlength=len(self.vectors)) >= self.k
        low = np.full(len(self.vectors), np.inf)
        np.minimum.at(low, self.query, self.sim)
        # A floor of -inf would let every later row through; -2 lies below every similarity.
        self.floor = np.maximum(self.given, np.where(full, np.maximum(low, -2.0), -np.inf))

    def _compact(self) -> None:
        used, self.row = np.unique(self.row, return_inverse=True)
        self.ids = self.ids[used]

    def result(self, names: pa.Array) -> Iterator[pa.RecordBatch]:
        if not len(self.row):
            return
        unknown = np.isneginf(self.sim)
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(self.query)), pa.array(np.where(unknown, 0.0, self.sim), mask=unknown), pa.array(self.ids[self.row].tolist(), self.kind)],
            names=["query_id", "similarity", "chunk_id"])


def _first_of_each(group: np.ndarray, order: tuple, k: int) -> np.ndarray:
    """Positions of the ``k`` first members of each group; ``order`` is least significant first."""
    at = np.lexsort((*order, group))
    grouped = group[at]
    return at[np.arange(len(at)) - np.searchsorted(grouped, grouped, side="left") < k]


def _ordered_dot(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Dot products of the vectors ``i`` of ``a`` with the vectors ``j`` of ``b``, both stored by
    component. They are added up from the first component on, so that equal vectors score equally
    in whichever batch they stand."""
    total = np.zeros(len(i))
    for x, y in zip(a, b):
        total += x[i] * y[j]
    return total


def relevant(similarity: Column, threshold: float = RELEVANCE_THRESHOLD) -> Column:
    """Inclusive threshold. NULL and NaN never pass; NaN would compare as the largest value."""
    return F.coalesce((similarity >= threshold) & ~F.isnan(similarity), F.lit(False))


def greedy_kept_ranks(candidates: Column, dedup_threshold: float = DEDUP_THRESHOLD) -> Column:
    """Ranks that survive near-duplicate removal in an array of ``struct(rank, embedding, ...)``
    in rank order. A row is dropped if it is close to a row already *kept*; dropped rows
    suppress nothing, which is why a self-join would drop too many."""
    vectors = F.transform(candidates, lambda c: F.struct(c["rank"].alias("rank"), c["embedding"].alias("v")))
    none = F.slice(vectors, 1, 0)

    def step(kept, row):
        close = F.exists(kept, lambda other: dot(other["v"], row["v"]) >= dedup_threshold)
        return F.when(close, kept).otherwise(F.concat(kept, F.array(row)))

    return F.aggregate(vectors, none, step, lambda kept: F.transform(kept, lambda r: r["rank"]))


def deduplicate(candidates: DataFrame, dedup_threshold: float = DEDUP_THRESHOLD, *, carry: Sequence[str] = ()) -> DataFrame:
    """Greedy near-duplicate removal per question over at most one candidate pool of rows."""
    members = F.struct("rank", "chunk_id", "similarity", "embedding", *carry)
    per_query = candidates.groupBy("query_id").agg(F.sort_array(F.collect_list(members)).alias("pool"))
    kept = per_query.withColumn("kept", greedy_kept_ranks(F.col("pool"), dedup_threshold))
    flat = kept.select("query_id", "kept", F.explode("pool").alias("c"))
    return flat.where(F.array_contains("kept", F.col("c.rank"))).select("query_id", "c.*")


def token_budget(ranked: DataFrame, max_tokens: int = MAX_CONTEXT_TOKENS) -> DataFrame:
    """Keeps rows, in rank order, until the next would pass the budget; the first always stays.
    Estimates are at least 1, so the running total only grows and filtering on it is the same
    as stopping. Adds ``context_tokens``, the running total."""
    order = Window.partitionBy("query_id").orderBy("rank")
    running = ranked.withColumn("context_tokens", F.sum("est_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.row_number().over(order) == 1
    return running.withColumn("_first", first).where(F.col("_first") | (F.col("context_tokens") <= max_tokens)).drop("_first")


def retrieve(
    queries: DataFrame,
    corpus: DataFrame,
    *,
    threshold: float = RELEVANCE_THRESHOLD,
    dedup_threshold: float = DEDUP_THRESHOLD,
    pool: int = CANDIDATE_POOL,
    max_tokens: int = MAX_CONTEXT_TOKENS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Context passages per question: top-K, threshold, de-duplication, budget.

    ``corpus(chunk_id, embedding, est_tokens, *carry)``. One row per chosen passage; a question
    for which nothing is relevant gets one row with a NULL ``chunk_id``, so its counters are
    kept. Counters: ``candidates_considered, above_threshold, deduped_out``."""
    carried = ["est_tokens", *carry]
    hits = top_k(queries, corpus, pool, carry=carried, keep_vectors_from=threshold)
    members = F.struct("rank", "chunk_id", "similarity", "embedding", *carried)
    keep = relevant(F.col("similarity"), threshold)
    pools = hits.groupBy("query_id").agg(
        F.count("*").alias("candidates_considered"),
        F.sort_array(F.collect_list(F.when(keep, members))).alias("pool"),
    )
    # A question against an empty corpus has no hits at all; it still gets its row.
    asked = queries.select("query_id").join(pools, "query_id", "left")
    nothing = F.slice(F.col("pool"), 1, 0)
    asked = asked.withColumn("kept", greedy_kept_ranks(F.coalesce("pool", nothing), dedup_threshold))
    flat = asked.select(
        "query_id",
        F.coalesce("candidates_considered", F.lit(0)).cast("long").alias("candidates_considered"),
        F.coalesce(F.size("pool"), F.lit(0)).cast("long").alias("above_threshold"),
        F.coalesce(F.size("pool") - F.size("kept"), F.lit(0)).cast("long").alias("deduped_out"),
        F.explode_outer(F.filter("pool", lambda c: F.array_contains("kept", c["rank"]))).alias("c"),
    )
    wide = flat.select("*", "c.*").drop("c", "embedding")
    return token_budget(wide, max_tokens)


def retrieval_report(retrieved: DataFrame) -> DataFrame:
    """One row of counters per question."""
    return retrieved.groupBy("query_id", "candidates_considered", "above_threshold", "deduped_out").agg(
        F.count("chunk_id").alias("selected"),
        F.coalesce(F.max("context_tokens"), F.lit(0)).cast("long").alias("context_tokens_estimate"),
    )
