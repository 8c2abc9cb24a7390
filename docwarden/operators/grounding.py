"""Prompts, reply validation, citation support and citation lookup.

The retrieved passages of a question travel on its row as ``chunks array<struct<chunk_id,
chunk_text>>``. Retrieval bounds them by its pool and token budget, so validation is a narrow
projection. Python appears twice: for strict JSON parsing and for the model call. Both take rows a
hundred at a time and only the column they read: Arrow would hand a worker ten thousand prompts at once."""

from __future__ import annotations

import json
import tempfile
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from docwarden.sources.tables import written

# Answers, support rule and its stop words.
NOT_IN_CORPUS_ANSWER = (
    "This isn't addressed in the available corpus — no retrieved source "
    "chunk was relevant enough to answer this question."
)
UNGROUNDED_ANSWER = (
    "This system found material that might be related to this question, but "
    "could not produce a source citation it trusts enough to answer "
    "confidently. This is inconclusive, not a confirmation that the records "
    "are silent on this topic — try rephrasing the question."
)
UNKNOWN_CITATION = "not a real chunk_id from REFERENCE MATERIAL"
UNSUPPORTED_CITATION = "chunk_id is real but its text doesn't support this claim"
MIN_SALIENT_LENGTH = 5
MIN_SALIENT_OVERLAP = 2
SUPPORT_STOPWORDS = tuple("""
    council committee committees meeting meetings motion request requests requested requesting
    program programs approve approves approved approval public chair madam member members
    councilmember councilmembers resolution resolutions clerk vote votes voting voted business
    update updates discussion district relevant other regarding second thank thanks please would
    could should there their which referral referrals referred energy petersburg pinellas florida
    county grant grants duke south north stpete street avenue resilience sustainability
""".split())

def user_message(question: Column, chunks: Column) -> Column:
    """Question and passages as data for the model, each passage tagged with its id only. The headings
    and separators are fixed values."""
    blocks = F.transform(chunks, lambda c: F.concat(F.lit("chunk_id="), c["chunk_id"], F.lit("\n"), c["chunk_text"]))
    return F.concat(
        F.lit("QUESTION:\n"), question,
        F.lit("\n\nREFERENCE MATERIAL:\n"), F.array_join(blocks, "\n\n---\n\n"), F.lit("\n"),
    )


def salient_tokens(text: Column, stopwords: tuple[str, ...] = SUPPORT_STOPWORDS) -> Column:
    """Distinct lower-cased ASCII words of at least five letters, without the stop words."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z]{%d,}" % MIN_SALIENT_LENGTH), F.lit(0))
    lowered = F.array_distinct(F.transform(words, F.lower))
    return F.array_except(lowered, F.array(*map(F.lit, stopwords))) if stopwords else lowered


def citation_supported(answer: Column, chunk_text: Column, stopwords: tuple[str, ...] = SUPPORT_STOPWORDS) -> Column:
    """Whether a passage shares enough salient words with the answer. An answer without any has
    nothing to check."""
    return tokens_supported(salient_tokens(answer, stopwords), salient_tokens(chunk_text, stopwords))


def tokens_supported(answer_tokens: Column, chunk_tokens: Column) -> Column:
    needed = F.least(F.lit(MIN_SALIENT_OVERLAP), F.size(answer_tokens))
    return (F.size(answer_tokens) == 0) | (F.size(F.array_intersect(answer_tokens, chunk_tokens)) >= needed)


_CITED = T.StructType().add("value", T.StringType()).add("is_string", T.BooleanType())
_PARSED = (
    T.StructType()
    .add("problem", T.StringType())
    .add("answer", T.StringType())
    .add("not_in_corpus", T.BooleanType())
    .add("citations", T.ArrayType(_CITED))
)


def _clean(text: str) -> str:
    return text.encode("utf-8", "replace").decode("utf-8")  # lone surrogates cannot leave Python


def _parse_reply(content: str | None) -> tuple:
    def bad(problem):
        return problem, None, None, None
    if content is None or not content.strip():
        return bad("empty content")
    try:
        reply = json.loads(content)
    except (json.JSONDecodeError, RecursionError):
        return bad("not JSON")
    if not isinstance(reply, dict):
        return bad("not an object")
    answer, flag, cited = reply.get("answer"), reply.get("not_in_corpus"), reply.get("citations")
    if not isinstance(answer, str) or not answer.strip():
        return bad("no answer")
    if not isinstance(flag, bool):
        return bad("not_in_corpus is not a boolean")
    if not isinstance(cited, list):
        return bad("citations is not a list")
    labels = [(_clean(c if isinstance(c, str) else repr(c)), isinstance(c, str)) for c in cited]
    return None, _clean(answer), flag, labels


@F.udf(returnType=_PARSED, useArrow=False)
def parse_reply(content: str | None) -> tuple:
    """Strict JSON reading. Spark's own JSON functions coerce types (a number becomes a string)
    and accept trailing text, so they cannot tell a valid reply from an invalid one."""
    return _parse_reply(content)


def validate_replies(replies: DataFrame, stopwords: tuple[str, ...] = SUPPORT_STOPWORDS) -> DataFrame:
    """Checks model replies ``(..., content, chunks)`` against the passages retrieved for them.

    Adds ``status`` (``ok``, ``not_in_corpus``, ``ungrounded``, ``invalid``), ``problem``,
    ``answer``, ``citations`` (valid ids, first mention first), ``dropped`` (what the reply cited
    in vain, in order) and ``rejected`` (the same with reasons, without ids dropped only because
    the reply said it had no answer). A row without passages is answered without a model."""
    asked = F.size("chunks") > 0
    # Not to be worked out again by every expression that reads it, which Spark may do with what is deterministic.
    parsed = replies.withColumn("_p", parse_reply.asNondeterministic()(F.when(asked, F.col("content")))).withColumn("_p", F.when(asked, F.col("_p")))

    def is_known(cited):
        return cited["is_string"] & F.exists("chunks", lambda c: c["chunk_id"] == cited["value"])

    split = parsed.withColumns({
        "_bad": F.transform(F.filter("_p.citations", lambda c: ~is_known(c)), lambda c: c["value"]),
        "_member": F.array_distinct(F.transform(F.filter("_p.citations", is_known), lambda c: c["value"])),
    })
    cited = F.get(F.filter("chunks", lambda c: c["chunk_id"] == F.get("_member", 0)), 0)["chunk_text"]
    split = split.withColumn(
        "_unsupported",
        F.when(F.size("_member") == 1, ~citation_supported(F.col("_p.answer"), cited, stopwords)).otherwise(False),
    )
    none = F.array().cast("array<string>")
    failed = F.when(F.col("_unsupported"), F.col("_member")).otherwise(none)
    grounded = F.when(F.col("_unsupported"), none).otherwise(F.col("_member"))
    silent = F.col("_p.not_in_corpus")

    def because(values, reason):
        return F.transform(values, lambda v: F.struct(v.alias("citation"), F.lit(reason).alias("reason")))

    status = (
        F.when(~asked, "not_in_corpus")
        .when(F.col("_p.problem").isNotNull(), "invalid")
        .when(silent, "not_in_corpus")
        .when(F.size(grounded) == 0, "ungrounded")
        .otherwise("ok")
    )
    done = split.withColumns({
        "status": status,
        "problem": F.col("_p.problem"),
        "answer": F.when(~asked, NOT_IN_CORPUS_ANSWER).otherwise(F.col("_p.answer")),
        "citations": F.when(silent, none).otherwise(F.coalesce(grounded, none)),
        "dropped": F.coalesce(F.concat("_bad", failed, F.when(silent, grounded).otherwise(none)), none),
        "rejected": F.concat(because(F.col("_bad"), UNKNOWN_CITATION), because(failed, UNSUPPORTED_CITATION)),
    })
    return done.drop("_p", "_bad", "_member", "_unsupported")


def rejection_lines(rejected: Column) -> Column:
    lines = F.transform(rejected, lambda r: F.concat(F.lit("- chunk_id="), r["citation"], F.lit(": "), r["reason"]))
    return F.when(F.size(rejected) == 0, "- (no citations were returned at all)").otherwise(F.array_join(lines, "\n"))


def citation_overlap(pairs: DataFrame, answer: str, chunk_text: str, stopwords: tuple[str, ...] = SUPPORT_STOPWORDS) -> DataFrame:
    """Adds ``answer_tokens``, ``shared_tokens`` (counts) and ``supported`` to answer/passage rows."""
    tok = pairs.withColumns({
        "_a": salient_tokens(F.col(answer), stopwords), "_c": salient_tokens(F.col(chunk_text), stopwords),
    })
    return tok.withColumns({
        "answer_tokens": F.size("_a").cast("long"),
        "shared_tokens": F.size(F.array_intersect("_a", "_c")).cast("long"),
        "supported": tokens_supported(F.col("_a"), F.col("_c")),
    }).drop("_a", "_c")


def lookup_citations(answers: DataFrame, chunks: DataFrame, key: str = "query_id") -> DataFrame:
    """One row per citation with the attributes of its chunk, in the order cited (``position``).
    Ids that are gone from the store are skipped."""
    # The outer form: see chunking.group_documents.
    cited = answers.select(key, F.posexplode_outer("citations").alias("position", "chunk_id"))
    cited = cited.where(F.col("chunk_id").isNotNull())
    wanted = chunks.select("chunk_id", "doc_type", "section_label", "source_url", "published_date")
    return cited.withColumn("position", F.col("position").cast("long")).join(wanted, "chunk_id")


# --- model boundary ---------------------------------------------------------


class RateLimited(Exception):
    """What a model or embedding function raises when its service asks for fewer calls."""


@dataclass(frozen=True)
class RetryPolicy:
    """Which failures of a model or embedding call are worth another try, and how often."""

    retryable: tuple[type[BaseException], ...] = (RateLimited, TimeoutError, ConnectionError)
    max_attempts: int = 3
    base_backoff_seconds: float = 1.0

    def call(self, fn: Callable, *args):
        for attempt in range(1, self.max_attempts + 1):
            try:
                return fn(*args)
            except self.retryable:
                if attempt == self.max_attempts:
                    raise
                time.sleep(self.base_backoff_seconds * 2 ** (attempt - 1))

    @staticmethod
    def kind(exc: BaseException) -> str:
        """How a failure is reported: rate_limited, timeout or call_failed."""
        return "rate_limited" if isinstance(exc, RateLimited) else "timeout" if isinstance(exc, TimeoutError) else "call_failed"


_REPLY = T.StructType([T.StructField(n, T.StringType()) for n in ("content", "call_error", "call_kind")])


def call_model(rows: DataFrame, model: Callable[[list[dict]], str], policy: RetryPolicy = RetryPolicy()) -> DataFrame:
    """Adds ``content``, ``call_error`` and its kind by calling ``model`` with each row's ``messages``
    (``array<struct<role, content>>``) in the tasks. A row without messages is not a call. Only the
    messages go to Python."""
    @F.udf(returnType=_REPLY, useArrow=False)
    def call(messages) -> tuple:
        if messages is None:
            return None, None, None
        try:
            return policy.call(model, [m.asDict() for m in messages]), None, None
        except Exception as exc:
            return None, f"{type(exc).__name__}: {exc}", policy.kind(exc)

    replied = rows.withColumn("_reply", call.asNondeterministic()("messages"))
    return replied.select(*rows.columns, "_reply.*")


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def durable(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the checkpoint folder of the cluster, so that paid calls are not
    repeated by a second consumer or a lost executor."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="docwarden-"))
    return df.checkpoint()


def generate_answers(
    questions: DataFrame,
    model: Callable[[list[dict]], str],
    *,
    system_prompt: str,
    correction: str,
    policy: RetryPolicy = RetryPolicy(),
    max_grounding_attempts: int = 2,
) -> DataFrame:
    """Answers ``questions(query_id, question, chunks)``. Rows without passages never reach the
    model. Ungrounded answers, and only those, are asked again with the rejected citations named;
    invalid replies are not.

    Returns ``query_id, question`` and the columns of the call and of :func:`validate_replies`. A
    question's prompts, replies and checks follow each other in one task, and only the results are
    written down, once: passages and prompts, which are many times their size, are neither stored
    nor returned."""
    system = _message("system", F.lit(system_prompt))
    first = _message("user", user_message(F.col("question"), F.col("chunks")))
    asked = F.when(F.size("chunks") > 0, F.array(system, first))
    rows = _checked(questions.select("query_id", "question", "chunks", asked.alias("messages")), model, policy)
    for _ in range(1, max_grounding_attempts):
        note = F.replace(F.lit(correction), F.lit("{rejection_lines}"), rejection_lines(F.col("rejected")))
        further = F.concat("messages", F.array(_message("assistant", F.col("content")), _message("user", note)))
        rows = _checked(rows.select(
            "query_id", "question", "chunks", F.when(F.col("status") == "ungrounded", further).alias("messages"), F.struct(*_RESULT).alias("_before"),
        ), model, policy)
        again = F.col("messages").isNotNull()
        rows = rows.select("query_id", "question", "chunks", "messages", *(F.when(again, F.col(c)).otherwise(F.col(f"_before.{c}")).alias(c) for c in _RESULT))
    return written(rows.drop("chunks", "messages"), "answers")


_RESULT = ("content", "call_error", "status", "problem", "answer", "citations", "dropped", "rejected")


def _checked(rows: DataFrame, model: Callable[[list[dict]], str], policy: RetryPolicy) -> DataFrame:
    checked = validate_replies(call_model(rows, model, policy))
    return checked.withColumn("status", F.coalesce("call_kind", "status")).drop("call_kind")


def answer_questions(retrieved: DataFrame, questions: DataFrame, passages: DataFrame, model, *, shared_by: str = "query_id", **options) -> DataFrame:
    """Retrieval results to answers: gathers passages in rank order and generates. ``retrieved`` comes
    from :func:`docwarden.operators.retrieval.retrieve`; ``passages(chunk_id, chunk_text)``.

    ``shared_by`` is the column of ``questions`` whose values ``retrieved`` has as ``query_id``: texts
    are gathered and written once for all questions that share a value, and meet them at the call."""
    wanted = written(retrieved.where(F.col("chunk_id").isNotNull()).select("query_id", "rank", "chunk_id"), "wanted")
    text = passages.join(wanted, "chunk_id")
    ordered = F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "chunk_text")))
    packed = text.groupBy(F.col("query_id").alias(shared_by)).agg(
        F.transform(ordered, lambda c: F.struct(c["chunk_id"].cast("string").alias("chunk_id"), c["chunk_text"].alias("chunk_text"))).alias("chunks")
    )
    asked = questions.join(written(packed, "contexts"), shared_by, "left")
    empty = F.array().cast("array<struct<chunk_id: string, chunk_text: string>>")
    return generate_answers(asked.withColumn("chunks", F.coalesce("chunks", empty)), model, **options)
