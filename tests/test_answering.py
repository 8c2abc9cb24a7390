"""From a question's text to its answer."""

import json

from docwarden.operators import answering, grounding as G, outcomes as O

POLICY = G.RetryPolicy(max_attempts=2, base_backoff_seconds=0)
OPTIONS = {"system_prompt": "s", "correction": "c {rejection_lines}", "policy": POLICY, "dim": 2}


def embed(texts):
    (text,) = texts
    if text == "busy":
        raise G.RateLimited("later")
    if text == "slow":
        raise TimeoutError("late")
    if text == "broken":
        raise ConnectionError("gone")
    return {"short": [[1.0]], "nothing": [None], "empty": [], "nan": [[float("nan"), 1.0]]}.get(text, [[1.0, 0.0] if "bread" in text else [0.0, -1.0]])


def model(messages):
    first = messages[1]["content"].split("chunk_id=", 1)[1].split("\n", 1)[0]
    return json.dumps({"answer": "rye bread needs sourdough", "citations": [first], "not_in_corpus": False})


def corpus(spark):
    rows = [("a", [1.0, 0.1], 5, "rye bread needs sourdough"), ("b", [0.9, -0.5], 5, "wheat bread"), ("c", [0.0, 1.0], 5, "stones"), ("n", None, 5, "no vector")]
    return spark.createDataFrame(rows, "chunk_id string, embedding array<float>, est_tokens long, chunk_text string")


def test_every_way_a_question_can_end(spark):
    texts = {
        "bread?": ("ok", 200), "stars?": ("not_in_corpus", 200), "busy": ("rate_limited", 429), "slow": ("timeout", 504), "broken": ("call_failed", 500),
        "short": ("invalid_embedding", 502), "nothing": ("invalid_embedding", 502), "empty": ("invalid_embedding", 502), "nan": ("invalid_embedding", 502),
        " \n": ("blank_question", 422), "bread " * 5000: ("question_too_long", 400), None: ("blank_question", 422),
    }
    questions = spark.createDataFrame(list(enumerate(texts)), "query_id long, question string")
    told = O.query_response(answering.answer_query(questions, corpus(spark), embed, model, **OPTIONS)).collect()
    assert {r.question: (r.status, r.http_status) for r in told} == texts and len(told) == len(texts)
    assert [r.citations for r in told if r.status == "ok"] == [["a"]]


def test_no_questions_and_no_passages(spark):
    questions = spark.createDataFrame([(1, "bread?")], "query_id long, question string")
    assert answering.answer_query(questions.limit(0), corpus(spark), embed, model, **OPTIONS).count() == 0
    (row,) = answering.answer_query(questions, corpus(spark).limit(0), embed, model, **OPTIONS).collect()
    assert row.status == "not_in_corpus"


def test_questions_with_one_vector_share_a_search(spark, monkeypatch):
    asked = []
    retrieve = answering.R.retrieve

    def counted(queries, *args, **options):
        asked.append(queries.count())
        return retrieve(queries, *args, **options)

    monkeypatch.setattr(answering.R, "retrieve", counted)
    questions = spark.range(60).selectExpr("id as query_id", "concat(if(id % 3 = 0, 'bread ', 'stars '), id) as question")
    got = answering.answer_query(questions, corpus(spark), embed, model, **OPTIONS).collect()
    assert asked == [2] and len(got) == 60
    assert all((r.status, r.citations) == (("ok", ["a"]) if r.query_id % 3 == 0 else ("not_in_corpus", [])) for r in got)
