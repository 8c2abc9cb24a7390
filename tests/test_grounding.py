"""Reply validation cases with their expected outcomes, and the two-pass generation."""

import json
import os

import pytest
from pyspark.sql import functions as F

from docwarden.operators import grounding as G, outcomes as O

SCHEMA = "id int, content string, chunks array<struct<chunk_id: string, chunk_text: string>>"
REAL = [("chunk-real", "text")]


def reply(answer="x", citations=("chunk-real",), silent=False):
    return json.dumps({"answer": answer, "citations": list(citations), "not_in_corpus": silent})


def check(spark, *cases):
    rows = [(i, content, chunks) for i, (content, chunks) in enumerate(cases)]
    return G.validate_replies(spark.createDataFrame(rows, SCHEMA)).orderBy("id").collect()


def test_citation_rules(spark):
    got = check(
        spark,
        (reply(citations=["chunk-real", "chunk-does-not-exist"]), REAL),
        (reply(citations=["chunk-fake-1", "chunk-fake-2"]), REAL),
        (reply("Not addressed.", ["chunk-real"], True), REAL),
        (reply("Not addressed.", [], True), REAL),
        (reply(citations=["chunk-real", 12345, None, 1.5, True, {"a": 1}]), REAL),
        (reply(citations=["chunk-real", "chunk-real"]), REAL),
        (None, []),
    )
    assert [r.status for r in got] == ["ok", "ungrounded", "not_in_corpus", "not_in_corpus", "ok", "ok", "not_in_corpus"]
    assert [list(r.citations) for r in got] == [["chunk-real"], [], [], [], ["chunk-real"], ["chunk-real"], []]
    assert [list(r.dropped) for r in got] == [
        ["chunk-does-not-exist"], ["chunk-fake-1", "chunk-fake-2"], ["chunk-real"], [], ["12345", "None", "1.5", "True", "{'a': 1}"], [], []]
    assert got[6].answer == G.NOT_IN_CORPUS_ANSWER
    assert [tuple(x) for x in got[1].rejected] == [(c, G.UNKNOWN_CITATION) for c in ("chunk-fake-1", "chunk-fake-2")]


@pytest.mark.parametrize("content,problem", [
    ("not json", "not JSON"), ('{"a": 1} trailing', "not JSON"), ("[1]", "not an object"), ("  ", "empty content"), (None, "empty content"),
    ('{"citations": [], "not_in_corpus": false}', "no answer"), ('{"answer": " ", "citations": [], "not_in_corpus": false}', "no answer"),
    ('{"answer": "x", "citations": "c", "not_in_corpus": false}', "citations is not a list"),
    ('{"answer": "x", "citations": [], "not_in_corpus": "false"}', "not_in_corpus is not a boolean"),
    ('{"answer": "x", "citations": [], "not_in_corpus": 0}', "not_in_corpus is not a boolean"),
])
def test_malformed_replies(spark, content, problem):
    (r,) = check(spark, (content, REAL))
    assert (r.status, r.problem) == ("invalid", problem)


def test_nan_and_repeated_keys_are_read_as_python_does(spark):
    got = check(spark, ('{"answer": "x", "score": NaN, "answer": "y", "citations": ["chunk-real"], "not_in_corpus": false}', REAL))
    assert (got[0].status, got[0].answer) == ("ok", "y")


SUPPORT = [
    ("Councilmember Gabbard requested a referral about the private lateral rebate program.",
     "councilmember gabbard respectfully requesting a referral for an update on the private lateral rebate program", True),
    ("Councilmember Gabbard requested a referral about the private lateral rebate program.", "For South St. Pete CRA", False),
    ("The committee approved the motion for the downtown streetscape.",
     "A completely unrelated agenda item was discussed at the meeting and the committee voted on the motion.", False),
    ("x", "anything at all", True),
    ("Councilmember Gabbard requested a referral about the private lateral rebate program.",
     "councilmember gabbard respectfully requesting city council approval of a transfer referral item a discussion regarding initiating "
     "a new sunrunner tod overlay package from the hers committee to the hlut committee for further discussion", False),
]


def test_lexical_support(spark):
    df = spark.createDataFrame(SUPPORT, "answer string, chunk string, want boolean")
    for r in df.select("want", G.citation_supported(F.col("answer"), F.col("chunk")).alias("got")).collect():
        assert r.got == r.want


def test_support_is_checked_only_for_a_single_citation(spark):
    chunks = [("a", "nothing in common"), ("b", "nor here")]
    answer = "Sky Isle loan maturity extended"
    got = check(spark, (reply(answer, ["a"]), chunks), (reply(answer, ["a", "b"]), chunks))
    assert [r.status for r in got] == ["ungrounded", "ok"]
    assert got[0].rejected[0].reason == G.UNSUPPORTED_CITATION and got[0].dropped == ["a"]


def test_prompt(spark):
    df = spark.createDataFrame([(0, "Q?", [("a", "one"), ("b", "two")])], SCHEMA.replace("content", "question"))
    (m,) = df.select(G.user_message(F.col("question"), F.col("chunks"))).first()
    assert m == "QUESTION:\nQ?\n\nREFERENCE MATERIAL:\nchunk_id=a\none\n\n---\n\nchunk_id=b\ntwo\n"


def test_generation_retries_only_ungrounded_answers(spark):
    def model(messages):
        asked, retried = messages[1]["content"], len(messages) > 2
        if "BROKEN" in asked:
            return "no json"
        if "BOOM" in asked:
            raise ValueError("bad request")
        if retried:
            assert "- chunk_id=nope: " + G.UNKNOWN_CITATION in messages[3]["content"]
            return reply("fine", ["nope" if "NEVER" in asked else "c1"])
        return reply("fine", ["nope" if "SECOND" in asked or "NEVER" in asked else "c1"])

    passages = [("c1", "some text")]
    rows = [(n, q, passages) for n, q in enumerate(["good", "SECOND", "NEVER", "BROKEN", "BOOM"])] + [(5, "nothing", [])]
    questions = spark.createDataFrame(rows, "query_id int, question string, chunks array<struct<chunk_id: string, chunk_text: string>>")
    got = {r.query_id: r for r in G.generate_answers(questions, model, system_prompt="s", correction="Again: {rejection_lines}").collect()}
    assert {q: r.status for q, r in got.items()} == {
        0: "ok", 1: "ok", 2: "ungrounded", 3: "invalid", 4: "call_failed", 5: "not_in_corpus"}
    assert "bad request" in got[4].call_error
    told = {r.query_id: r for r in O.query_response(spark.createDataFrame([(q, r.status, r.answer) for q, r in got.items()],
                                                                          "query_id int, status string, answer string")).collect()}
    assert told[2].response_answer == G.UNGROUNDED_ANSWER and told[2].response_not_in_corpus and told[3].http_status == 502
    assert told[0].response_not_in_corpus is False


def test_transport_retries():
    calls = []

    def flaky(_):
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return "ok"

    policy = G.RetryPolicy(base_backoff_seconds=0)
    assert policy.call(flaky, None) == "ok" and len(calls) == 3
    with pytest.raises(TimeoutError):
        policy.call(lambda: (_ for _ in ()).throw(TimeoutError()))
    once = []
    with pytest.raises(ValueError):
        policy.call(lambda: once.append(1) or (_ for _ in ()).throw(ValueError()))
    assert once == [1]


def test_citation_lookup_keeps_order_and_skips_missing(spark):
    answers = spark.createDataFrame([(1, ["b", "gone", "a"]), (2, [])], "query_id int, citations array<string>")
    chunks = spark.createDataFrame([("a", "t", "l", "u", None), ("b", "t", None, "u", None)],
                                   "chunk_id string, doc_type string, section_label string, source_url string, published_date date")
    got = G.lookup_citations(answers, chunks).orderBy("position").collect()
    assert [(r.query_id, r.position, r.chunk_id) for r in got] == [(1, 0, "b"), (1, 2, "a")]


def test_answering_end_to_end(spark):
    from docwarden.operators import retrieval as R

    corpus = spark.createDataFrame([("a", [1.0, 0.0], 5, "alpha text"), ("b", [0.9, 0.1], 5, "beta text"), ("c", [0.0, 1.0], 5, "gamma text")],
                                   "chunk_id string, embedding array<float>, est_tokens long, chunk_text string")
    questions = spark.createDataFrame([(1, "first", [1.0, 0.0]), (2, "nothing near", [-1.0, -1.0])], "query_id int, question string, embedding array<double>")
    found = R.retrieve(questions, corpus.drop("chunk_text"), dedup_threshold=2.0)

    def model(messages):
        assert messages[1]["content"] == "QUESTION:\nfirst\n\nREFERENCE MATERIAL:\nchunk_id=a\nalpha text\n\n---\n\nchunk_id=b\nbeta text\n"
        return reply("ok", ["b", "a"])

    out = G.answer_questions(found, questions.drop("embedding"), corpus.select("chunk_id", "chunk_text"), model, system_prompt="s", correction="Again: {rejection_lines}")
    got = {r.query_id: r for r in out.collect()}
    assert got[1].status == "ok" and got[1].citations == ["b", "a"]
    assert got[2].status == "not_in_corpus" and got[2].answer == G.NOT_IN_CORPUS_ANSWER


def test_python_gets_few_rows_at_once_and_no_passages_are_stored(spark, monkeypatch):
    """Arrow would hand a worker up to 10,000 prompts at once, whatever their size."""
    passages = [("c1", "w" * 200_000)]
    questions = spark.createDataFrame(
        [(n, "q", passages) for n in range(20)], "query_id int, question string, chunks array<struct<chunk_id: string, chunk_text: string>>")
    called = G.call_model(questions.selectExpr("query_id", "array(named_struct('role', 'user', 'content', question)) as messages"), lambda m: "x")
    plan = called._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "MapInPandas" not in plan
    answers = G.generate_answers(questions, lambda m: reply("fine", ["nope" if len(m) == 2 else "c1"]), system_prompt="s", correction="{rejection_lines}")
    assert [r.status for r in answers.collect()] == ["ok"] * 20
    assert sum(os.path.getsize(f.removeprefix("file:")) for f in answers.inputFiles()) < 200_000
