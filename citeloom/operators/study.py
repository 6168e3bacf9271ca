"""Study tasks: quiz grading, plan changes from feedback, next step, evidence checks.

A task is a row with array columns (plan, quizzes, notes); every step is a
column expression over that row, so a table of tasks advances in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RETESTS = 2
MAX_REVISIONS = 2
ACTIONS = ("explain", "self_test", "review")
ANSWER = r"([1-5])\s*[:：、.．]\s*([A-Da-d])"


def quiz_answers(text: Column | str, items: Column) -> Column:
    """Selected letters by item, NULL unless every item is answered once."""
    t = F.col(text) if isinstance(text, str) else text
    numbers = F.transform(
        F.regexp_extract_all(t, F.lit(ANSWER), F.lit(1)), lambda v: v.cast("int")
    )
    letters = F.transform(F.regexp_extract_all(t, F.lit(ANSWER), F.lit(2)), F.upper)
    lone = (F.size(numbers) == 0) & (F.size(items) == 1) & F.trim(t).rlike(r"^[A-Da-d]\z")
    pairs = F.when(lone, F.array(F.struct(F.lit(1).alias("n"), F.upper(F.trim(t)).alias("a")))).otherwise(
        F.arrays_zip(numbers.alias("n"), letters.alias("a"))
    )
    ordered = F.array_sort(pairs)
    complete = F.transform(ordered, lambda p: p["n"]) == F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)))
    return F.when(complete, F.transform(ordered, lambda p: p["a"]))


def grade_quiz(items: Column, letters: Column) -> Column:
    """Result per item: selected letter and whether its option is the answer."""
    return F.zip_with(
        items,
        letters,
        lambda item, letter: F.struct(
            letter.alias("selected"),
            (F.get(item["options"], F.ascii(letter) - F.ascii(F.lit("A"))) == item["answer"]).alias("correct"),
            item["stem"].alias("stem"),
        ),
    )


def correct_count(results: Column) -> Column:
    return F.size(F.filter(results, lambda r: r["correct"]))


def insert_followups(plan: Column, quiz_id: Column, action: Column, focus: Column, reason: Column) -> Column:
    """Plan with the review or retest steps placed before the remaining ones."""

    def step(suffix: str, kind: str, why: Column) -> Column:
        return F.struct(
            F.concat(F.lit("feedback_"), quiz_id, F.lit(suffix)).alias("id"),
            F.lit(kind).alias("action"),
            focus.alias("focus"),
            why.alias("reason"),
            F.lit("pending").alias("status"),
        )

    review = step("_review", "review", reason)
    test = step("_test", "self_test", F.lit("补讲后用新题复核本轮错项"))
    done = F.filter(plan, lambda s: s["status"] == "done")
    rest = F.filter(plan, lambda s: s["status"] != "done")
    return (
        F.when(action == "review", F.concat(done, F.array(review), rest))
        .when(action == "retest", F.concat(done, F.array(review, test), rest))
        .otherwise(plan)
    )


def feedback_issue(action: Column, results: Column, plan: Column, retests: Column) -> Column:
    """Why a proposed feedback decision is refused, NULL when it is allowed."""
    wrong = F.exists(results, lambda r: ~r["correct"])
    teaches = F.exists(
        plan, lambda s: (s["status"] != "done") & s["action"].isin("explain", "review")
    )
    return (
        F.when(~action.isin("continue", "review", "retest"), "unknown_action")
        .when(wrong & (action == "continue") & ~teaches, "wrong_items_need_review")
        .when((action == "retest") & (retests >= MAX_RETESTS), "retest_limit")
    )


def plan_issue(steps: Column, revisions: Column) -> Column:
    """Why a proposed plan is refused, NULL when it is allowed."""
    actions = F.transform(steps, lambda s: s["action"])
    return (
        F.when(revisions > MAX_REVISIONS, "revision_limit")
        .when(~F.size(steps).between(1, 4), "step_count")
        .when(F.size(F.array_except(actions, F.array(*[F.lit(a) for a in ACTIONS]))) > 0, "unknown_action")
        .when(F.exists(steps, lambda s: ~F.length(F.trim(s["focus"])).between(1, 120)), "focus_length")
        .when(
            F.size(F.array_except(F.array(F.lit("explain"), F.lit("self_test")), actions)) > 0,
            "needs_explain_and_test",
        )
    )


def goal_complete(quizzes: Column, cited_notes: Column) -> Column:
    """No unassessed quiz, and every wrong one was followed by a cited note.

    ``quizzes``: submitted, assessed, results, notes_before; ``cited_notes``:
    booleans, one per note in order.
    """
    pending = F.exists(quizzes, lambda q: q["submitted"] & ~q["assessed"])
    covered = F.forall(
        F.filter(quizzes, lambda q: q["submitted"]),
        lambda q: ~F.exists(q["results"], lambda r: ~r["correct"])
        | F.exists(
            F.slice(cited_notes, q["notes_before"] + 1, F.greatest(F.size(cited_notes), F.lit(0))),
            lambda cited: cited,
        ),
    )
    return ~pending & covered


def next_tool(replan: Column, quizzes: Column, plan: Column) -> Column:
    """Ordered decision of the next step of a study task."""
    return (
        F.when(replan, "replan_study_goal")
        .when(F.exists(quizzes, lambda q: q["submitted"] & ~q["assessed"]), "assess_study_progress")
        .when(
            F.exists(quizzes, lambda q: q["submitted"] & q["save_requested"] & ~q["saved"]),
            "save_study_questions",
        )
        .when(F.exists(plan, lambda s: s["status"] != "done"), "execute_study_step")
        .otherwise("finish_study_goal")
    )


def matching_evidence(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence whose text contains the snippet a question cites.

    ``questions``: question_id, source_file, page, doc_id, snippet (one row per
    citation); ``evidence``: evidence_id, source_file, page, doc_id, text.  File,
    page and, where the citation names one, document join by equality, so the
    containment is checked among the few chunks of one page.
    """
    q = questions.withColumn("snippet", F.trim("snippet")).filter("snippet <> ''")
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    e = evidence.select(
        "evidence_id", "source_file", F.coalesce("page", F.lit(-1)).alias("page"),
        F.col("doc_id").cast("string").alias("doc"), F.col("text").alias("body"),
    )
    q = q.select(
        "question_id", "source_file", F.coalesce("page", F.lit(-1)).alias("page"),
        named.alias("doc"), "snippet",
    )
    both = (
        q.filter("doc <> ''").join(e, ["source_file", "page", "doc"]),
        q.filter("doc = ''").drop("doc").join(e.drop("doc"), ["source_file", "page"]),
    )
    found = [
        j.filter(F.contains("body", "snippet")).select("question_id", "evidence_id") for j in both
    ]
    return found[0].unionByName(found[1]).distinct()


def unresolved_ids(drafts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Drafts without evidence ids, or with one that does not resolve."""
    ids = drafts.select("draft_no", F.explode_outer("evidence_ids").alias("evidence_id"))
    return (
        ids.join(evidence.select("evidence_id"), "evidence_id", "left_anti")
        .select("draft_no")
        .distinct()
    )


def draft_issues(question_type: Column, options: Column, answer: Column) -> Column:
    """Structural issue of a draft, NULL when it is sound."""
    choice = question_type == "choice"
    bad = (
        (F.size(options) != 4)
        | (F.size(F.array_distinct(options)) != 4)
        | ~F.array_contains(options, answer)
    )
    return F.when(choice & bad, "options")
