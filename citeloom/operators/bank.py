"""Question bank: listing order, papers, blueprint assembly, practice review."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.text import stem_key
from citeloom.operators.evidence import is_applicable
from citeloom.operators.joins import first_rows, join_small, row_bound

REVIEW_DAYS, RECOMMENDATIONS, HISTORY = 7, 5, 50
MAX_RULES = 20


def question_order() -> list[Column]:
    """Reviewed first, then newest update, then largest id."""
    return [
        F.asc(F.when(F.col("status") == "reviewed", 0).otherwise(1)),
        F.desc("updated_at"),
        F.desc("question_id"),
    ]


def list_questions(questions: DataFrame, course_id: str, **filters: str | None) -> DataFrame:
    """Questions of a course; only non-empty filters apply."""
    if not course_id:
        raise ValueError("course_id is required")
    out = questions.filter(F.col("course_id") == course_id)
    for name, value in filters.items():
        if value:
            out = out.filter(F.col(name) == value)
    return out.orderBy(*question_order())


def paper_totals(papers: DataFrame, items: DataFrame) -> DataFrame:
    """Item count and total score of every paper, zero for an empty one.

    Items are aggregated before the join, so the shuffle carries one row per
    paper and map task.
    """
    totals = items.groupBy("paper_id").agg(
        F.count("*").alias("question_count"), F.sum("score").alias("total_score")
    )
    return papers.join(totals, "paper_id", "left").withColumns(
        {
            "question_count": F.coalesce("question_count", F.lit(0)),
            "total_score": F.coalesce("total_score", F.lit(0.0)),
        }
    )


def paper_items(items: DataFrame, questions: DataFrame) -> DataFrame:
    """Items of papers with their questions, one row per position."""
    cols = [c for c in questions.columns if c not in ("score", "position")]
    return items.join(questions.select(*cols), "question_id")


def usable_evidence(citations: Column | str, scenario: Column, as_of: Column) -> Column:
    """Some citation of the question fits scope and date; none is not enough."""
    c = F.col(citations) if isinstance(citations, str) else citations
    return F.coalesce(
        F.exists(
            c,
            lambda x: is_applicable(
                scenario, as_of, x["applicability_scope"], x["effective_from"], x["effective_to"]
            ),
        ),
        F.lit(False),
    )


def blueprint_candidates(questions: DataFrame, rules: DataFrame, need: int) -> DataFrame:
    """First ``need`` questions per course and rule, ``need`` the total count.

    Earlier rules can take at most ``need`` questions, so no rule ever looks
    past this prefix: the greedy fill below is exact on it.
    """
    if "chapter" in rules.columns:
        rules = rules.withColumnRenamed("chapter", "rule_chapter")
    matched = join_small(
        questions, rules, ["question_type", "difficulty"], rows=row_bound(rules, MAX_RULES)
    )
    if "rule_chapter" in rules.columns:
        any_chapter = F.coalesce(F.col("rule_chapter"), F.lit("")) == ""
        matched = matched.filter(any_chapter | (F.col("rule_chapter") == F.col("chapter")))
    return first_rows(matched, ["course_id", "rule_no"], question_order(), need, rank="place")


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    taken: set = set()
    out = []
    for _, rule in pdf.sort_values(["rule_no", "place"]).groupby("rule_no", sort=True):
        free = rule[~rule["question_id"].isin(taken)]
        chosen = free.head(int(rule["count"].iloc[0]))
        taken.update(chosen["question_id"])
        out.append(chosen)
    return pd.concat(out)[["course_id", "rule_no", "question_id", "score"]]


def fill_blueprint(questions: DataFrame, rules: DataFrame) -> DataFrame:
    """Questions chosen for an ordered blueprint, per course.

    ``rules``: rule_no, question_type, difficulty, count, score, optionally
    chapter; at most twenty.  A question serves one rule only.
    """
    need = rules.agg(F.sum("count")).first()[0] or 0
    cand = blueprint_candidates(questions, rules, int(need)).select(
        "course_id", "rule_no", "question_id", "place", "count", "score"
    )
    kind = questions.schema["question_id"].dataType.simpleString()
    return cand.groupBy("course_id").applyInPandas(
        _fill, f"course_id string, rule_no int, question_id {kind}, score double"
    )


def blueprint_gaps(chosen: DataFrame, rules: DataFrame, courses: DataFrame) -> DataFrame:
    """Missing questions per course and rule; an empty result means complete."""
    have = chosen.groupBy("course_id", "rule_no").agg(F.count("*").alias("have"))
    # A few rules per course: the rules travel as an array, not as a join.
    listed = rules.agg(F.collect_list(F.struct("rule_no", "count")).alias("r")).first()[0]
    wanted = F.array(
        *[F.struct(F.lit(r["rule_no"]).alias("rule_no"), F.lit(r["count"]).alias("count")) for r in listed]
    )
    asked = courses.select("course_id", F.inline(wanted))
    return (
        asked.join(have, ["course_id", "rule_no"], "left")
        .withColumn("missing", F.col("count") - F.coalesce("have", F.lit(0)))
        .filter("missing > 0")
        .select("course_id", "rule_no", "missing")
    )


def duplicate_stems(questions: DataFrame) -> DataFrame:
    """Stem identities used more than once in a course."""
    return (
        questions.withColumn("stem_key", stem_key("stem"))
        .groupBy("course_id", "stem_key")
        .agg(F.count("*").alias("uses"), F.min("question_id").alias("first_question"))
        .filter("uses > 1")
    )


def colliding_drafts(drafts: DataFrame, questions: DataFrame) -> DataFrame:
    """Drafts whose stem the bank or an earlier draft of the batch already has."""
    d = drafts.withColumn("stem_key", stem_key("stem"))
    bank = questions.select("course_id", stem_key("stem").alias("stem_key")).distinct()
    w = Window.partitionBy("course_id", "stem_key").orderBy("draft_no")
    return (
        d.withColumn("repeat", F.row_number().over(w) > 1)
        .join(bank.withColumn("in_bank", F.lit(True)), ["course_id", "stem_key"], "left")
        .filter(F.col("repeat") | F.col("in_bank"))
        .select("course_id", "draft_no", "stem", "repeat", F.coalesce("in_bank", F.lit(False)).alias("in_bank"))
    )


def choice_answer(options: Column | str, answer: Column | str) -> Column:
    """Index of the only option equal to the answer, NULL if not unique."""
    opts = F.transform(
        F.col(options) if isinstance(options, str) else options, lambda o: F.trim(o)
    )
    ans = F.trim(F.col(answer) if isinstance(answer, str) else answer)
    ok = (F.size(opts) >= 2) & (F.size(F.array_distinct(opts)) == F.size(opts))
    at = F.array_position(opts, ans)
    return F.when(ok & (at > 0), at - 1)


# --- practice ----------------------------------------------------------------


def attempt_order() -> list[Column]:
    return [F.desc(F.coalesce("submitted_at", "created_at")), F.desc("attempt_id")]


def latest_graded(attempts: DataFrame) -> DataFrame:
    """Newest graded attempt per course and question."""
    return first_rows(
        attempts.filter("status = 'graded'"), ["course_id", "question_id"], attempt_order(), 1
    )


def wrong_queue(attempts: DataFrame) -> DataFrame:
    """Questions whose newest graded attempt is wrong."""
    return latest_graded(attempts).filter(~F.col("correct"))


def practice_stats(attempts: DataFrame, cutoff: Column) -> DataFrame:
    """Counts per course over completed attempts since ``cutoff``.

    ``correct`` is three-valued: NULL means not assessed yet.
    """
    recent = attempts.filter((F.col("status") != "started") & (F.col("submitted_at") >= cutoff))
    return recent.groupBy("course_id").agg(
        F.count("*").alias("submitted"),
        F.count_if(~F.col("correct")).alias("wrong"),
        F.count_if((F.col("grading_method") == "self") & F.col("correct").isNotNull()).alias(
            "self_assessed"
        ),
        F.count_if(F.col("correct").isNull()).alias("awaiting_assessment"),
        F.count_if(F.col("previous_attempt_id").isNotNull() & F.col("correct")).alias(
            "retrained_correct"
        ),
    )


def never_practised(questions: DataFrame, attempts: DataFrame) -> DataFrame:
    return questions.join(
        attempts.select("course_id", "question_id").distinct(),
        ["course_id", "question_id"],
        "left_anti",
    )


def recommendations(
    questions: DataFrame, attempts: DataFrame, limit: int = RECOMMENDATIONS
) -> DataFrame:
    """Next questions per course: pending, then wrong, then never practised.

    Each source is cut to what the result can use before the union: ``limit``
    distinct questions.
    """
    pending = attempts.filter(F.col("status").isin("started", "submitted"))
    reason = F.when(F.col("status") == "started", "继续未完成练习").otherwise("提交后尚未自评")
    tries = pending.select(
        "course_id", "question_id", "attempt_id", "submitted_at", "created_at",
        F.lit(0).alias("tier"), F.lit("resume").alias("action"), reason.alias("reason"),
    ).unionByName(
        wrong_queue(attempts).select(
            "course_id", "question_id", "attempt_id", "submitted_at", "created_at",
            F.lit(1).alias("tier"), F.lit("retry").alias("action"),
            F.lit("最近一次作答错误，建议回看资料后重练").alias("reason"),
        )
    )
    order = [F.asc("tier"), *attempt_order()]
    tries = first_rows(tries, ["course_id", "question_id"], order, 1)
    tries = first_rows(tries, ["course_id"], order, limit, rank="place")
    fresh = first_rows(
        never_practised(questions, attempts), ["course_id"], question_order(), limit, rank="place"
    )
    both = tries.select(
        "course_id", "question_id", "attempt_id", "tier", "place", "action", "reason"
    ).unionByName(
        fresh.select(
            "course_id", "question_id", F.lit(None).cast("long").alias("attempt_id"),
            F.lit(2).alias("tier"), "place", F.lit("start").alias("action"),
            F.lit("尚未练习，先做一次自测").alias("reason"),
        )
    )
    # Tiers 0 and 1 share one ranking, so a flag orders them before tier 2.
    return first_rows(
        both, ["course_id"], [F.asc(F.col("tier") == 2), F.asc("place")], limit, rank="position"
    ).drop("place", "tier")


def practice_history(attempts: DataFrame, limit: int = HISTORY) -> DataFrame:
    return first_rows(
        attempts.filter("status <> 'started'"), ["course_id"], attempt_order(), limit, rank="position"
    )


def present_attempts(attempts: DataFrame) -> DataFrame:
    """Public view: answer and analysis stay hidden until submission."""
    shown = F.col("status") != "started"
    return attempts.drop("request_id").withColumns(
        {c: F.when(shown, F.col(c)) for c in ("answer", "analysis", "citations") if c in attempts.columns}
    )


def first_requests(starts: DataFrame) -> DataFrame:
    """Idempotent start: the first row of a request wins, conflicts are flagged."""
    first = first_rows(
        starts, ["course_id", "request_id"], [F.asc("created_at"), F.asc("attempt_id")], 1
    ).select(
        "course_id", "request_id", F.col("attempt_id").alias("__id"),
        F.struct("question_id", "previous_attempt_id").alias("__first"),
    )
    same = F.struct("question_id", "previous_attempt_id").eqNullSafe(F.col("__first"))
    return (
        starts.join(first, ["course_id", "request_id"])
        .withColumn(
            "outcome",
            F.when(F.col("attempt_id") == F.col("__id"), "created")
            .when(same, "existing")
            .otherwise("conflict"),
        )
        .drop("__id", "__first")
    )


def citation_status(questions: DataFrame, docs: DataFrame, today: Column) -> DataFrame:
    """Evidence status of questions: current, stale or unverified.

    ``questions``: course_id, question_id, created_at, citations; ``docs``: id,
    course, state and the five compared attributes.
    """
    fields = (
        "source_version", "effective_from", "effective_to", "applicability_scope",
        "authority_level",
    )
    c = questions.select(
        "course_id", "question_id", "created_at", F.explode_outer("citations").alias("c")
    ).withColumn("doc_id", F.try_to_number(F.col("c.doc_id"), F.lit("9" * 18)).cast("long"))
    d = docs.select(
        "doc_id", F.col("course_id").alias("d_course"), "is_active", "status", "file_present",
        "updated_at", *[F.col(f).alias(f"d_{f}") for f in fields],
    )
    same = F.lit(True)
    for f in fields:
        same = same & (F.col(f"c.{f}").isNull() | F.col(f"c.{f}").eqNullSafe(F.col(f"d_{f}")))
    valid = F.coalesce(
        (F.col("d_course") == F.col("course_id"))
        & F.col("is_active")
        & (F.col("status") == "done")
        & F.col("file_present")
        & same
        & (F.col("d_effective_from") <= today)
        & (F.col("d_effective_to") >= today)
        & (F.col("created_at").isNull() | ~(F.col("updated_at") > F.col("created_at"))),
        F.lit(False),
    )
    return (
        c.join(d, "doc_id", "left")
        .groupBy("course_id", "question_id")
        .agg(
            F.count("c").alias("citations"),
            F.bool_and(F.when(F.col("c").isNotNull(), valid)).alias("all_valid"),
        )
        .select(
            "course_id",
            "question_id",
            "citations",
            F.when(F.col("citations") == 0, "unverified")
            .when(F.col("all_valid"), "current")
            .otherwise("stale")
            .alias("evidence_status"),
        )
    )
