"""The whole question: from its text to an answer with citations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F, types as T

from docwarden.functions import text as X
from docwarden.functions.vectors import EMBEDDING_DIM, invalid_vector_reason
from docwarden.operators import retrieval as R
from docwarden.operators.grounding import RetryPolicy, answer_questions
from docwarden.sources.tables import written

_EMBEDDED = T.StructType([T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("failure", T.StringType())])


def embed_questions(
    questions: DataFrame, embed: Callable[[list[str]], list[list[float]]], *, dim: int = EMBEDDING_DIM, policy: RetryPolicy = RetryPolicy(),
) -> DataFrame:
    """``questions(query_id, question)`` with ``embedding`` and ``status``, which is NULL for a usable vector,
    else why there is none: ``blank_question``, ``question_too_long``, the kind of a failed call, or
    ``invalid_embedding``. Each question is a call of its own, made in the tasks; the first two never call."""
    asked = questions.select("query_id", "question", (
        F.when(F.coalesce(X.is_blank(F.col("question")), F.lit(True)), "blank_question")
        .when(F.length("question") > X.EMBEDDING_MAX_CHARS, "question_too_long")
    ).alias("status"))

    @F.udf(returnType=_EMBEDDED, useArrow=False)
    def answer(question: str | None) -> tuple:
        if question is None:
            return None, None
        try:
            return [float(x) for x in policy.call(embed, [question])[0]], None
        except (TypeError, ValueError, IndexError):
            return None, "invalid_embedding"
        except Exception as exc:
            return None, policy.kind(exc)

    called = F.when(F.col("status").isNull(), F.col("question"))
    embedded = asked.withColumn("_answer", answer.asNondeterministic()(called)).select(
        "query_id", "question", F.coalesce("status", "_answer.failure").alias("status"), F.col("_answer.embedding").alias("embedding"))
    wrong = F.col("status").isNull() & invalid_vector_reason(F.col("embedding"), dim).isNotNull()
    return embedded.withColumns({
        "status": F.when(wrong, "invalid_embedding").otherwise(F.col("status")), "embedding": F.when(~wrong, F.col("embedding")),
    })


def answer_query(
    questions: DataFrame,
    corpus: DataFrame,
    embed: Callable[[list[str]], list[list[float]]],
    model: Callable[[list[dict]], str],
    *,
    dim: int = EMBEDDING_DIM,
    policy: RetryPolicy = RetryPolicy(),
    retrieval: dict | None = None,
    **generation,
) -> DataFrame:
    """Answers ``questions(query_id, question)`` from ``corpus(chunk_id, embedding, est_tokens, chunk_text)``:
    embeds them, retrieves their passages (:func:`retrieval.retrieve` with the options ``retrieval``), asks
    the model and checks its citations (:func:`grounding.generate_answers` with the options ``generation``).

    One row per question, with a status for each that could not be embedded as well. Neither texts nor
    passages pass through the driver. Vectors are written down before they are used, so that no question is
    embedded once per use. Passages depend on the vector alone: each distinct one is searched once, and its
    passages are gathered once for all its questions."""
    embedded = embed_questions(questions, embed, dim=dim, policy=policy).withColumn("_vector", F.sha2(F.col("embedding").cast("string"), 256))
    embedded = written(embedded, "embedded")
    fit = embedded.where(F.col("status").isNull())
    vectors = fit.groupBy(F.col("_vector").alias("query_id")).agg(F.any_value("embedding").alias("embedding"))
    found = R.retrieve(vectors, corpus.select("chunk_id", "embedding", "est_tokens"), **(retrieval or {}))
    answers = answer_questions(
        found, fit.select("query_id", "question", "_vector"), corpus.select("chunk_id", "chunk_text"), model, shared_by="_vector", policy=policy, **generation)
    failed = embedded.where(F.col("status").isNotNull()).select("query_id", "question", "status")
    return answers.unionByName(failed, allowMissingColumns=True)
