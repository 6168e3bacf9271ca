"""Task wording, study steps and retrieval tools over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import queries as q
from citeloom.functions import tasks
from citeloom.operators import study, tools
from citeloom.sources import tables as t

NUMERALS = ("一", "二", "两", "五", "十", "十二", "二十", "九十九")


def add(reg) -> None:
    @reg.add(
        "chinese_number",
        """SELECT l_orderkey, l_linenumber, ([1,2,2,5,10,12,20,99])[l_partkey % 8 + 1] * (CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE 0 END)
            + (CASE WHEN l_suppkey % 2 = 0 THEN 0 ELSE l_suppkey % 99 + 1 END) AS number FROM lineitem""",
    )
    def chinese_number(spark, sf):
        li = t.table(spark, sf, "lineitem")
        text = F.when(
            F.col("l_suppkey") % 2 == 0,
            F.element_at(F.array(*[F.lit(n) for n in NUMERALS]), (F.col("l_partkey") % 8 + 1).cast("int")),
        ).otherwise((F.col("l_suppkey") % 99 + 1).cast("string"))
        return li.select("l_orderkey", "l_linenumber", q.number_value(text).cast("long").alias("number"))

    @reg.add(
        "question_slots",
        """SELECT p_partkey, (['选择','填空','简答'])[p_partkey % 3 + 1] AS kind_word,
          (['choice','fill_blank','short_answer'])[p_partkey % 3 + 1] AS question_type,
          CAST(p_size % 10 + 1 AS INTEGER) AS count, p_name AS topic,
          CASE WHEN p_partkey % 2 = 0 THEN 'hard' ELSE 'medium' END AS difficulty FROM part""",
    )
    def question_slots(spark, sf):
        p = t.table(spark, sf, "part")
        k = F.col("p_partkey")
        word = F.element_at(F.array(F.lit("选择"), F.lit("填空"), F.lit("简答")), (k % 3 + 1).cast("int"))
        text = F.concat(
            F.lit("关于"), "p_name", F.lit("出"), (F.col("p_size") % 10 + 1).cast("string"), F.lit("道"),
            word, F.lit("题"), F.when(k % 2 == 0, "，困难").otherwise(""),
        )
        return p.select("p_partkey", word.alias("kind_word"), tasks.question_slots(text).alias("s")).select(
            "p_partkey", "kind_word", "s.question_type", "s.count", "s.topic", "s.difficulty"
        )

    @reg.add(
        "blueprint_totals",
        """SELECT p_partkey, CAST(p_size % 5 + 3 AS INTEGER) AS count, (p_size % 5 + 1) * 5e0 + 2 * 10e0 AS total_score,
          CASE WHEN p_partkey % 2 = 0 THEN 'ok' ELSE '蓝图合计与要求总分不一致' END AS issues FROM part""",
    )
    def blueprint_totals(spark, sf):
        p = t.table(spark, sf, "part")
        n = F.col("p_size") % 5 + 1
        total = n * 5 + 20 + F.when(F.col("p_partkey") % 2 == 0, 0).otherwise(1)
        text = F.concat(
            F.lit("组卷："), n.cast("string"), F.lit("道选择题，每题5分；两道简答题，困难，每题10分，总分"),
            total.cast("string"), F.lit("分"),
        )
        rules = tasks.blueprint_rules(text, F.lit(""), F.lit("medium"))
        staged = p.select("p_partkey", rules.alias("r"), text.alias("text"))
        return staged.select("p_partkey", tasks.blueprint_totals(F.col("r"), "text").alias("b")).select(
            "p_partkey", "b.count", "b.total_score",
            F.when(F.size("b.issues") == 0, "ok").otherwise(F.array_join("b.issues", ",")).alias("issues"),
        )

    @reg.add(
        "quiz_grading",
        """SELECT event_id, CAST((event_id % 4 = user_id % 4)::INTEGER + (user_id % 3 = 0)::INTEGER AS INTEGER) AS correct FROM events""",
    )
    def quiz_grading(spark, sf):
        e = t.table(spark, sf, "events")
        opts = F.array(*[F.lit(v) for v in "WXYZ"])

        def item(i, stem):
            return F.struct(F.lit(stem).alias("stem"), opts.alias("options"), F.get(opts, i).alias("answer"))

        items = F.array(
            item((F.col("user_id") % 4).cast("int"), "q1"), item((F.col("user_id") % 3).cast("int"), "q2")
        )
        letter = F.element_at(F.array(*[F.lit(v) for v in "abcd"]), (F.col("event_id") % 4 + 1).cast("int"))
        text = F.concat(F.lit("2：A，1:"), letter)
        graded = study.grade_quiz(items, study.quiz_answers(text, items))
        return e.select("event_id", study.correct_count(graded).alias("correct"))

    @reg.add(
        "citation_match",
        "WITH " + t.LINES_SQL + """
        SELECT q.doc_id * 100000 + q.chunk_index AS question_id, e.doc_id * 100000 + e.chunk_index AS evidence_id
        FROM line_chunks q JOIN line_chunks e ON e.course_id = q.course_id AND e.page = q.page AND e.doc_id = q.doc_id
          AND contains(e.text, trim(substr(q.text, 5)))
        WHERE trim(substr(q.text, 5)) <> ''""",
    )
    def citation_match(spark, sf):
        c = t.line_chunks(spark, sf)
        key = F.col("doc_id") * 100000 + F.col("chunk_index")
        asked = c.select(
            key.alias("question_id"), "source_file", "page", "doc_id",
            F.expr("substring(text, 5)").alias("snippet"),
        )
        return study.matching_evidence(
            asked, c.select(key.alias("evidence_id"), "source_file", "page", "doc_id", "text")
        )

    @reg.add(
        "read_page",
        "WITH " + t.LINES_SQL + """,
        req AS (SELECT DISTINCT doc_id, course_id, CAST(doc_id % 3 + 1 AS BIGINT) AS page FROM line_chunks)
        SELECT r.doc_id, count(l.doc_id) > 0 AS found, coalesce(length(string_agg(l.text, chr(10) || chr(10))), 0) AS chars
        FROM req r LEFT JOIN line_chunks l ON l.doc_id = r.doc_id AND l.page = r.page GROUP BY r.doc_id""",
    )
    def read_page(spark, sf):
        d = t.table(spark, sf, "documents")
        asked = d.select(
            F.col("doc_id").alias("request_id"), F.col("source").alias("course_id"), "doc_id",
            (F.col("doc_id") % 3 + 1).cast("int").alias("page"),
        )
        out = tools.read_page(t.line_chunks(spark, sf), asked)
        return out.select("doc_id", "found", F.length("text").cast("long").alias("chars"))
