"""Question bank, practice, conversations, evaluation, answers, token streams."""

import random

import pytest
from pyspark.sql import functions as F

from citeloom.operators import answers, bank, conversations, evaluation, store, study
from citeloom.streaming import tokens

QUESTION = "question_id long, course_id string, question_type string, difficulty string, chapter string, status string, updated_at int, stem string"


def questions(spark, rows):
    return spark.createDataFrame(rows, QUESTION)


def test_blueprint_fill_is_greedy_and_unique(spark):
    rng = random.Random(2)
    rows = [
        (i, "c", rng.choice(["choice", "fill_blank"]), rng.choice(["easy", "hard"]), rng.choice(["a", "b"]),
         rng.choice(["draft", "reviewed"]), rng.randrange(5), f"s{i}")
        for i in range(40)
    ]
    rules = [(1, "choice", "easy", 2, 1.0, "a"), (2, "choice", "easy", 3, 2.0, ""), (3, "fill_blank", "hard", 20, 3.0, "")]
    plan = spark.createDataFrame(rules, "rule_no int, question_type string, difficulty string, count int, score double, chapter string")
    got = {(r["rule_no"], r["question_id"]) for r in bank.fill_blueprint(questions(spark, rows), plan).collect()}
    taken, want = set(), set()
    ordered = sorted(rows, key=lambda r: (r[5] != "reviewed", -r[6], -r[0]))
    for no, kind, level, count, _, chapter in rules:
        free = [r for r in ordered if r[2] == kind and r[3] == level and (not chapter or r[4] == chapter) and r[0] not in taken]
        for r in free[:count]:
            taken.add(r[0])
            want.add((no, r[0]))
    assert got == want
    gaps = bank.blueprint_gaps(bank.fill_blueprint(questions(spark, rows), plan), plan, spark.createDataFrame([("c",)], "course_id string"))
    missing = {r["rule_no"]: r["missing"] for r in gaps.collect()}
    assert missing.get(3) == 20 - sum(1 for n, _ in want if n == 3)


def test_paper_totals_keep_empty_papers(spark):
    papers = spark.createDataFrame([(1,), (2,)], "paper_id long")
    items = spark.createDataFrame([(1, 2.0), (1, 3.0)], "paper_id long, score double")
    got = {r["paper_id"]: (r["question_count"], r["total_score"]) for r in bank.paper_totals(papers, items).collect()}
    assert got == {1: (2, 5.0), 2: (0, 0.0)}


def test_choice_answer_must_be_unique(spark):
    def at(options, answer):
        o = F.array(*[F.lit(v) for v in options])
        return spark.range(1).select(bank.choice_answer(o, F.lit(answer)).alias("v")).first()["v"]

    assert at(["a", "b "], " b") == 1
    assert at(["a", "a"], "a") is None and at(["a"], "a") is None and at(["a", "b"], "c") is None


def test_usable_evidence(spark):
    df = spark.createDataFrame(
        [(1, [("exam", "2020-01-01", "2020-12-31")]), (2, [("all", "", "")]), (3, []), (4, None)],
        "id int, citations array<struct<applicability_scope:string,effective_from:string,effective_to:string>>",
    )
    ok = bank.usable_evidence("citations", F.lit("exam"), F.lit("2021-01-01"))
    assert [r["id"] for r in df.filter(ok).collect()] == [2]


ATTEMPT = (
    "attempt_id long, course_id string, question_id long, status string, grading_method string, correct boolean, "
    "previous_attempt_id long, created_at timestamp, submitted_at timestamp, user_answer string, selected_option int"
)


def test_practice_review(spark):
    from datetime import datetime as D

    d = lambda n: D(2024, 1, n)
    rows = [
        (1, "c", 1, "graded", "objective", False, None, d(1), d(1), "", None),
        (2, "c", 1, "graded", "objective", True, 1, d(2), d(2), "", None),
        (3, "c", 2, "graded", "self", False, None, d(3), d(3), "", None),
        (4, "c", 3, "started", "self", None, None, d(4), None, "", None),
        (5, "c", 4, "submitted", "self", None, None, d(5), d(5), "", None),
    ]
    a = spark.createDataFrame(rows, ATTEMPT)
    assert [r["question_id"] for r in bank.wrong_queue(a).collect()] == [2]
    s = bank.practice_stats(a, F.lit("2024-01-02").cast("timestamp")).first()
    assert (s["submitted"], s["wrong"], s["self_assessed"], s["awaiting_assessment"], s["retrained_correct"]) == (3, 1, 1, 1, 1)
    q = questions(spark, [(i, "c", "choice", "easy", "", "draft", i, "s") for i in range(1, 8)])
    got = [(r["question_id"], r["action"]) for r in bank.recommendations(q, a).orderBy("position").collect()]
    assert got == [(4, "resume"), (3, "resume"), (2, "retry"), (7, "start"), (6, "start")]


def test_practice_transitions(spark):
    base = [(i, "c", i, "started", "objective" if i == 1 else "self", None, None, None, None, "", None) for i in (1, 2, 3)]
    a = spark.createDataFrame(base, ATTEMPT)
    changes = spark.createDataFrame(
        [
            (1, 1, "submit", "x", 0, True, None), (1, 2, "submit", "y", 1, False, None),
            (2, 1, "submit", "text", None, None, None), (2, 2, "assess", None, None, False, None),
            (3, 1, "assess", None, None, True, None),
        ],
        "attempt_id long, seq int, kind string, user_answer string, selected_option int, correct boolean, at timestamp",
    )
    got = {r["attempt_id"]: (r["status"], r["correct"]) for r in store.practice_transition(a, changes).collect()}
    assert got == {1: ("graded", True), 2: ("graded", False), 3: ("started", None)}


def test_citation_status(spark):
    fields = "doc_id:string,source_version:string,effective_from:string,effective_to:string,applicability_scope:string,authority_level:int"
    q = spark.createDataFrame(
        [
            ("c", 1, "2024-01-02", [("1", "1", "2020-01-01", "2030-01-01", "all", 30)]),
            ("c", 2, "2024-01-02", [("1", "2", "2020-01-01", "2030-01-01", "all", 30)]),
            ("c", 3, "2023-01-01", [("1", "1", "2020-01-01", "2030-01-01", "all", 30)]),
            ("c", 4, "2024-01-02", []), ("c", 5, "2024-01-02", [("x", "1", "", "", "", 1)]),
        ],
        f"course_id string, question_id long, created_at string, citations array<struct<{fields}>>",
    )
    d = spark.createDataFrame(
        [(1, "c", True, "done", True, "2024-01-01", "1", "2020-01-01", "2030-01-01", "all", 30)],
        "doc_id long, course_id string, is_active boolean, status string, file_present boolean, updated_at string, "
        "source_version string, effective_from string, effective_to string, applicability_scope string, authority_level int",
    )
    got = {r["question_id"]: r["evidence_status"] for r in bank.citation_status(q, d, F.lit("2024-06-01")).collect()}
    assert got == {1: "current", 2: "stale", 3: "stale", 4: "unverified", 5: "stale"}


MESSAGE = "conv_id long, turn int, role string, text string"


def test_turns_and_history(spark):
    rows = [(1, 0, "user", "q1"), (1, 1, "user", "q2"), (1, 2, "assistant", "a2"), (1, 3, "assistant", "a3"), (1, 4, "system", "s"), (1, 5, "assistant", "a5")]
    m = spark.createDataFrame(rows, MESSAGE)
    assert [(r["question"], r["answer"]) for r in conversations.turn_pairs(m).collect()] == [("q2", "a2")]
    assert [r["text"] for r in conversations.history(m, 2).orderBy("seq").collect()] == ["s", "a5"]
    assert conversations.history(m, 0).count() == 0


def test_follow_up_chain_inherits(spark):
    rows = [
        (1, 0, "user", "期末考试能带书吗"), (1, 1, "user", "你好"), (1, 2, "user", "那这个呢"), (1, 3, "user", "那上面的规定呢"),
        (1, 4, "user", "什么是熵的含义"), (1, 5, "user", "那刚才的呢"), (2, 0, "user", "那这个呢"),
    ]
    got = {(r["conv_id"], r["turn"]): (r["task"], r["scenario"], r["layer"])
           for r in conversations.conversation_intents(spark.createDataFrame(rows, MESSAGE)).collect()}
    assert got[(1, 2)] == ("rule_query", "考试", "context") and got[(1, 3)] == ("rule_query", "考试", "context")
    assert got[(1, 5)] == ("concept", None, "context") and got[(1, 1)][0] == "conversation"
    assert got[(2, 0)] == ("qa", None, "default")


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (2, "x", 1)], "query_id int, source_file string, rank int")
    rel = spark.createDataFrame([(1, "b"), (1, "c"), (2, "")], "query_id int, source_file string")
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    got = {r["query_id"]: (r["recall_at_k"], round(r["mrr"], 6)) for r in evaluation.query_metrics(ranked, rel, q, 3).collect()}
    assert got == {1: (0.5, 0.333333), 2: (0.0, 0.0), 3: (0.0, 0.0)}
    assert {r["recall_at_k"] for r in evaluation.query_metrics(ranked, rel, q, 2).collect()} == {0.0}
    a = spark.createDataFrame([(1, "q"), (2, "q")], "id int, question string")
    b = spark.createDataFrame([(1, "other"), (3, "q")], "id int, question string")
    diff = {r["id"]: r["difference"] for r in evaluation.compare_reports(a, b, ["question"]).collect()}
    assert diff == {1: "changed", 2: "only_before", 3: "only_after"}


@pytest.mark.parametrize(
    "raw, grounded, cited, role",
    [
        ("正文\n<SOURCES>2,1,2</SOURCES>", True, [2, 1], "model_selected"),
        ("正文\n<SOURCES>4</SOURCES>", True, [1, 2, 3], "retrieval_candidate"),
        ("正文 <SOURCES>", True, [1, 2, 3], "retrieval_candidate"),
        ("**资料库中未找到相关内容**", False, [], "retrieval_candidate"),
        (" <NO_EVIDENCE> 解释", False, [], "retrieval_candidate"),
    ],
)
def test_finalise(spark, raw, grounded, cited, role):
    df = spark.createDataFrame([(1, raw, 3)], "query_id int, raw string, evidence int")
    r = answers.finalize_answers(df).first()
    assert (r["grounded"], r["cited"], r["evidence_role"]) == (grounded, cited, role)
    assert r["error"] is None
    assert answers.finalize_answers(df.withColumn("raw", F.lit("<SOURCES>1</SOURCES>"))).first()["error"] == "empty_answer"


def test_answer_without_hits_is_refused(spark):
    hits = spark.createDataFrame(
        [(1, 1, "a.md", "body", "text", "", 30, "")],
        "query_id int, position int, source_file string, text string, block_type string, authority_label string, authority_level int, source_version string",
    )
    q = spark.createDataFrame([(1, "x"), (2, "y")], "query_id int, query_text string")
    got = {r["query_id"]: (r["grounded"], r["cited"]) for r in answers.answer(hits, q, answers.echo_model).collect()}
    assert got == {1: (True, [1]), 2: (False, [])}


def emit(text, cuts):
    state, shown, start = ("", "", False, False), "", 0
    for end in [*cuts, len(text)]:
        state, visible = tokens.advance(state, text[start:end])
        shown, start = shown + visible, end
    return shown + state[1], state[2]


def test_markers_are_hidden_at_every_border():
    text = "值 < 3，a<b。\n<SOURCES>1,2</SOURCES>"
    for cut in range(len(text) + 1):
        assert emit(text, [cut]) == ("值 < 3，a<b。\n", True)
    assert emit(text, range(1, len(text))) == ("值 < 3，a<b。\n", True)
    for cut in range(14):
        assert emit(" <NO_EVIDENCE> 因为", [cut]) == ("", False)


def test_study_steps(spark):
    def val(c):
        return spark.range(1).select(c.alias("v")).first()["v"]

    items = F.array(*[
        F.struct(F.lit(s).alias("stem"), F.array(*[F.lit(v) for v in "wxyz"]).alias("options"), F.lit(a).alias("answer"))
        for s, a in (("q1", "w"), ("q2", "y"))
    ])
    letters = study.quiz_answers(F.lit("2：c，1:b"), items)
    assert val(letters) == ["B", "C"]
    assert [r["correct"] for r in val(study.grade_quiz(items, letters))] == [False, True]
    assert val(study.quiz_answers(F.lit("1:a 1:b"), items)) is None
    plan = F.array(*[
        F.struct(F.lit(i).alias("id"), F.lit(a).alias("action"), F.lit("f").alias("focus"), F.lit("r").alias("reason"), F.lit(s).alias("status"))
        for i, a, s in (("s1", "explain", "done"), ("s2", "self_test", "pending"))
    ])
    after = val(study.insert_followups(plan, F.lit("s2"), F.lit("retest"), F.lit("熵"), F.lit("错")))
    assert [s["id"] for s in after] == ["s1", "feedback_s2_review", "feedback_s2_test", "s2"]
    results = F.array(F.struct(F.lit(False).alias("correct")))
    assert val(study.feedback_issue(F.lit("continue"), results, plan, F.lit(0))) == "wrong_items_need_review"
    assert val(study.feedback_issue(F.lit("retest"), results, plan, F.lit(2))) == "retest_limit"
    assert val(study.plan_issue(plan, F.lit(0))) is None
    quizzes = F.array(F.struct(
        F.lit(True).alias("submitted"), F.lit(True).alias("assessed"), F.lit(False).alias("save_requested"),
        F.lit(False).alias("saved"), results.alias("results"), F.lit(1).alias("notes_before"),
    ))
    notes = lambda *v: F.array(*[F.lit(x) for x in v])
    assert val(study.goal_complete(quizzes, notes(True))) is False
    assert val(study.goal_complete(quizzes, notes(False, True))) is True
    assert val(study.next_tool(F.lit(False), quizzes, plan)) == "execute_study_step"
