"""Refusal and failure kinds, and the status each is reported with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docwarden.operators.grounding import NOT_IN_CORPUS_ANSWER, UNGROUNDED_ANSWER

# Refusal code of a command -> reported status.
REFUSAL_STATUS = {
    "invitation_cap": 429,
    "no_such_invitation": 404,
    "not_found": 404,
    "lock_not_available": 409,
    "insufficient_privilege": 403,
    "unique_violation": 409,
    "check_violation": 409,
    "invalid_parameter_value": 422,
    "account_needed": 422,
    "serialization_failure": 409,
    "connection_failure": 503,
}
# How answering a question ended -> reported status.
ANSWER_STATUS = {
    "ok": 200,
    "not_in_corpus": 200,
    "ungrounded": 200,
    "invalid": 502,
    "invalid_embedding": 502,
    "question_too_long": 400,
    "blank_question": 422,
    "rate_limited": 429,
    "timeout": 504,
}


def _status(code: Column, table: dict[str, int], otherwise: int) -> Column:
    out = F.lit(otherwise)
    for name, status in table.items():
        out = F.when(code == name, status).otherwise(out)
    return out.cast("long")


def refusal_status(code: Column, success: int = 204) -> Column:
    return F.when(code.isNull(), F.lit(success).cast("long")).otherwise(_status(code, REFUSAL_STATUS, 500))


def answer_status(outcome: Column) -> Column:
    return _status(outcome, ANSWER_STATUS, 500)


def query_response(answered: DataFrame) -> DataFrame:
    """What a client is told: status, answer text, whether the corpus covers the question. An
    ungrounded answer is inconclusive, which reads differently from a corpus without an answer."""
    ungrounded = F.col("status") == "ungrounded"
    status = answer_status(F.col("status"))
    return answered.withColumns({
        "http_status": status,
        "response_answer": F.when(ungrounded, UNGROUNDED_ANSWER).when(status == 200, F.coalesce("answer", F.lit(NOT_IN_CORPUS_ANSWER))),
        "response_not_in_corpus": F.when(status == 200, F.col("status") != "ok"),
    })
