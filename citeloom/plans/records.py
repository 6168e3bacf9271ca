"""Versions, conversations, question bank, practice and evaluation plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import intent
from citeloom.functions.text import logical_name, shingles
from citeloom.operators import bank, conversations, evaluation, lexical, versions
from citeloom.operators.joins import join_small, row_bound
from citeloom.plans.ranking import INDEX_SQL, LEXICAL_SQL, SCORE_SQL
from citeloom.sources import tables as t

# Distinct non-overlapping five-character pieces of the whitespace-free text.
SHINGLE_SQL = r"""
sets AS (
  SELECT source AS course_id, lang || '_' || (doc_id // 500) AS logical_name, doc_id, text,
    CASE WHEN length(n) = 0 THEN [] WHEN length(n) <= 5 THEN [n] ELSE
      list_distinct(list_transform(range(0, greatest(length(n) - 4, 1), 5), lambda i: substr(n, i + 1, 5)))
    END AS s
  FROM (SELECT *, lower(regexp_replace(text, '\s+', '', 'g')) AS n FROM documents))
"""


def families(spark, sf):
    """Documents with their version family: course and logical name.

    A file is named after its language and a block of ids, with a version mark.
    """
    d = t.table(spark, sf, "documents")
    block = F.floor(F.col("doc_id") / 500).cast("string")
    name = F.concat("lang", F.lit("_"), block, F.lit(" v"), (F.col("doc_id") % 4).cast("string"), F.lit(".pdf"))
    return d.select(
        F.col("source").alias("course_id"), logical_name(name).alias("logical_name"), "doc_id", "text"
    )


def add(reg) -> None:
    @reg.add(
        "content_hash_dedupe",
        """SELECT doc_id, CASE WHEN first_doc < doc_id THEN first_doc END AS same_as,
          CASE WHEN first_doc < doc_id THEN 'unchanged' ELSE 'created' END AS action
        FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY source, sha256(text)) AS first_doc FROM documents)""",
    )
    def content_hash_dedupe(spark, sf):
        d = t.table(spark, sf, "documents")
        hashed = versions.content_hash(d, "text").select("source", "doc_id", "content_hash")
        out = versions.duplicate_of(hashed, ["source"])
        return out.select(
            "doc_id",
            F.when(F.col("first_doc") < F.col("doc_id"), F.col("first_doc")).alias("same_as"),
            "action",
        )

    @reg.add(
        "shingle_sets",
        "WITH " + SHINGLE_SQL + "SELECT doc_id, CAST(len(s) AS BIGINT) AS n, list_aggregate(list_sort(s), 'string_agg', ' ') AS set FROM sets",
    )
    def shingle_sets(spark, sf):
        d = families(spark, sf).select("doc_id", F.sort_array(shingles("text", 5)).alias("s"))
        return d.select(
            "doc_id", F.size("s").cast("long").alias("n"), F.nullif(F.array_join("s", " "), F.lit("")).alias("set")
        )

    @reg.add(
        "version_argmax",
        "WITH " + SHINGLE_SQL + """,
        pairs AS (
          SELECT b.doc_id, a.doc_id AS best_doc, len(list_intersect(a.s, b.s)) AS c, len(a.s) AS na, len(b.s) AS nb
          FROM sets b LEFT JOIN sets a ON a.course_id = b.course_id AND a.logical_name = b.logical_name AND a.doc_id < b.doc_id
            AND len(a.s) > 0 AND len(b.s) > 0),
        sims AS (SELECT doc_id, best_doc, c / (na + nb - c) AS sim FROM pairs)
        SELECT doc_id, CASE WHEN sim >= 0.2 THEN best_doc END AS best_doc,
          CASE WHEN sim >= 0.2 THEN round(sim, 6) END AS similarity
        FROM sims QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC NULLS LAST, best_doc) = 1""",
    )
    def version_argmax(spark, sf):
        out = versions.similar_earlier(families(spark, sf), ["course_id", "logical_name"])
        return out.select("doc_id", "best_doc", F.round("similarity", 6).alias("similarity"))

    @reg.add(
        "scd2_promote",
        """SELECT o_orderkey AS doc_id, row_number() OVER w AS version_number,
          lag(o_orderkey) OVER w AS previous_doc_id, lead(o_orderkey) OVER w AS superseded_by,
          lead(o_orderkey) OVER w IS NULL AS is_active
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""",
    )
    def scd2_promote(spark, sf):
        o = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey", "o_orderkey")
        return versions.version_chain(o, ["o_custkey"], "o_orderkey").select(
            "doc_id", F.col("version_number").cast("long").alias("version_number"),
            "previous_doc_id", "superseded_by", "is_active",
        )

    @reg.add(
        "update_decision",
        "WITH " + SHINGLE_SQL + """,
        f AS (SELECT *, course_id || '/' || (doc_id // 200) AS path, sha256(text) AS h FROM sets),
        inc AS (SELECT * FROM f WHERE doc_id % 2 = 1), st AS (SELECT * FROM f WHERE doc_id % 2 = 0 AND doc_id % 3 > 0),
        same AS (SELECT course_id, h, max(doc_id) AS same_doc FROM st GROUP BY 1, 2),
        placed AS (SELECT course_id, path, max(doc_id) AS path_doc FROM st WHERE doc_id % 5 = 0 GROUP BY 1, 2),
        near AS (
          SELECT i.doc_id AS file_id, s.doc_id AS near_doc, len(list_intersect(i.s, s.s)) AS c, len(i.s) AS na, len(s.s) AS nb
          FROM inc i JOIN st s ON s.course_id = i.course_id AND s.logical_name = i.logical_name),
        best AS (SELECT file_id, near_doc, c / (na + nb - c) AS sim FROM near WHERE c > 0
          QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY sim DESC, near_doc DESC) = 1),
        j AS (SELECT i.doc_id AS file_id, same_doc, path_doc, CASE WHEN sim >= 0.2 THEN near_doc END AS near_doc, sim
          FROM inc i LEFT JOIN same ON same.course_id = i.course_id AND same.h = i.h
            LEFT JOIN placed p ON p.course_id = i.course_id AND p.path = i.path
            LEFT JOIN best ON best.file_id = i.doc_id AND same_doc IS NULL AND path_doc IS NULL)
        SELECT file_id, CASE WHEN same_doc IS NOT NULL THEN 'unchanged' WHEN coalesce(path_doc, near_doc) IS NOT NULL THEN 'updated'
            ELSE 'created' END AS action, CASE WHEN same_doc IS NULL THEN coalesce(path_doc, near_doc) END AS previous_doc_id,
          round(CASE WHEN same_doc IS NULL AND path_doc IS NOT NULL THEN 1 WHEN same_doc IS NULL THEN sim END, 6) AS similarity
        FROM j""",
    )
    def update_decision(spark, sf):
        k = F.col("doc_id")
        d = versions.content_hash(families(spark, sf), "text").withColumn(
            "path", F.concat("course_id", F.lit("/"), F.floor(k / 200).cast("string"))
        )
        # Of the stored files one in five lies at a path that files come from again.
        stored = d.filter("doc_id % 2 = 0 AND doc_id % 3 > 0").withColumns(
            {
                "path": F.when(k % 5 == 0, F.col("path")).otherwise(F.concat(F.lit("old/"), k.cast("string"))),
                "version_number": F.lit(1), "is_active": F.lit(True),
            }
        )
        incoming = d.filter("doc_id % 2 = 1").withColumnRenamed("doc_id", "file_id")
        return versions.match_candidates(incoming, stored).select(
            "file_id", "action", "previous_doc_id", F.round("similarity", 6).alias("similarity")
        )

    @reg.add(
        "promote_versions",
        """WITH ch AS (SELECT o_orderkey AS old_doc, o_orderkey + 1 AS new_doc FROM orders
          WHERE o_orderkey % 10 IN (0, 1) AND o_orderkey + 1 IN (SELECT o_orderkey FROM orders))
        SELECT o_orderkey AS doc_id, CASE WHEN a.old_doc IS NOT NULL THEN 'superseded' WHEN b.new_doc IS NOT NULL THEN 'done' ELSE o_orderstatus END AS status,
          CASE WHEN a.old_doc IS NOT NULL THEN false WHEN b.new_doc IS NOT NULL THEN true ELSE o_orderkey % 2 = 0 END AS is_active,
          CAST(CASE WHEN b.new_doc IS NOT NULL THEN b.old_doc % 4 + 1 ELSE o_orderkey % 4 END AS INTEGER) AS version_number,
          b.old_doc AS previous_doc_id, a.new_doc AS superseded_by
        FROM orders LEFT JOIN ch a ON a.old_doc = o_orderkey LEFT JOIN ch b ON b.new_doc = o_orderkey""",
    )
    def promote_versions(spark, sf):
        k = F.col("doc_id")
        docs = t.table(spark, sf, "orders").select(
            F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("status")
        ).withColumns(
            {
                "is_active": k % 2 == 0, "version_number": (k % 4).cast("int"),
                "previous_doc_id": F.lit(None).cast("long"), "superseded_by": F.lit(None).cast("long"),
            }
        )
        new = docs.select(F.col("doc_id").alias("new_doc"))
        changes = docs.filter("doc_id % 10 IN (0, 1)").select(k.alias("old_doc"), (k + 1).alias("new_doc"))
        return versions.promote_versions(docs, changes.join(new, "new_doc", "left_semi"))

    # --- conversations ---------------------------------------------------------

    @reg.add(
        "history_last_n",
        """SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq FROM (
          SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4)""",
    )
    def history_last_n(spark, sf):
        m = t.table(spark, sf, "conversations")
        return conversations.last_messages(m, 4).select(
            "conv_id", "turn", "role", F.col("seq").cast("long").alias("seq")
        )

    @reg.add(
        "turn_pairing",
        """SELECT conv_id, prev_turn AS question_turn, turn AS answer_turn, length(text) AS answer_chars FROM (
          SELECT *, lag(role) OVER w AS prev_role, lag(turn) OVER w AS prev_turn
          FROM conversations WHERE role IN ('user', 'assistant')
          WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        WHERE role = 'assistant' AND prev_role = 'user'""",
    )
    def turn_pairing(spark, sf):
        pairs = conversations.turn_pairs(t.table(spark, sf, "conversations"))
        return pairs.select(
            "conv_id", "question_turn", "answer_turn",
            F.length("answer").cast("long").alias("answer_chars"),
        )

    @reg.add(
        "latest_user_intent",
        """WITH m AS (
          SELECT conv_id, turn, (conv_id + turn) % 6 AS c FROM conversations WHERE role = 'user'),
        stop AS (SELECT *, c = 5 AS bad FROM m WHERE c <> 1)
        SELECT conv_id, turn, CASE c WHEN 0 THEN 'concept' WHEN 2 THEN 'rule_query' WHEN 3 THEN 'qa' ELSE 'chapter' END AS task
        FROM stop WHERE true QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1
          AND NOT bad AND c <> 4""",
    )
    def latest_user_intent(spark, sf):
        m = t.table(spark, sf, "conversations")
        c = (F.col("conv_id") + F.col("turn")) % 6
        stored = (
            F.when(c == 0, '{"task": "concept"}')
            .when(c == 1, '{"task": "conversation"}')
            .when(c == 2, '{"task": "rule_query", "scenario": "exam"}')
            .when(c == 3, '{"task": "qa", "mode": "qa"}')
            .when(c == 4, "")
            .otherwise("{broken")
        )
        out = conversations.latest_user_intent(m.withColumn("intent", stored))
        return out.select("conv_id", "turn", "task")

    @reg.add(
        "message_counts",
        "SELECT conv_id, count(*) AS messages FROM conversations GROUP BY conv_id",
    )
    def message_counts(spark, sf):
        return conversations.message_counts(t.table(spark, sf, "conversations"))

    intent_case = """CASE (conv_id * 3 + turn) % 10
      WHEN 0 THEN 'concept' WHEN 1 THEN 'rule_query' WHEN 2 THEN 'rule_query' WHEN 3 THEN 'chapter'
      WHEN 4 THEN 'version_compare' WHEN 5 THEN 'question_generate' WHEN 8 THEN 'rule_query'
      WHEN 9 THEN 'conversation' ELSE 'qa' END"""

    @reg.add(
        "intent_rules",
        "WITH " + t.ASKED_SQL + f"""
        SELECT conv_id, turn, {intent_case.replace("WHEN 0 THEN 'concept'", "WHEN 0 THEN 'qa'")} AS task,
          CASE (conv_id * 3 + turn) % 10 WHEN 1 THEN '考试' END AS scenario,
          CASE (conv_id * 3 + turn) % 10 WHEN 1 THEN '2024-03-05' WHEN 8 THEN '2024-06-01' END AS as_of
        FROM asked WHERE role = 'user'""",
    )
    def intent_rules(spark, sf):
        m = t.asked_messages(spark, sf).filter(F.col("role") == "user")
        d = intent.resolve_intent("text", today=F.lit("2024-06-01"))
        return m.select("conv_id", "turn", d.alias("d")).select(
            "conv_id", "turn", "d.task", "d.scenario", "d.as_of"
        )

    @reg.add(
        "intent_context_inherit",
        "WITH " + t.ASKED_SQL + f""",
        u AS (SELECT conv_id, turn, (conv_id * 3 + turn) % 10 AS c,
            {intent_case.replace("WHEN 0 THEN 'concept'", "WHEN 0 THEN 'qa'")} AS own FROM asked WHERE role = 'user'),
        f AS (SELECT *, min(turn) FILTER (WHERE c <> 9) OVER (PARTITION BY conv_id) AS first_turn FROM u),
        a AS (SELECT *, c IN (2, 6) AND turn <> first_turn AS inherits FROM f),
        g AS (SELECT *, last_value(CASE WHEN NOT inherits AND c <> 9 THEN own END IGNORE NULLS) OVER w AS prev,
              last_value(CASE WHEN NOT inherits AND c <> 9 THEN c END IGNORE NULLS) OVER w AS prev_c
              FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT conv_id, turn, CASE WHEN inherits THEN prev ELSE own END AS task,
          CASE WHEN CASE WHEN inherits THEN prev_c ELSE c END = 1 THEN '考试' END AS scenario,
          CASE WHEN c = 9 THEN 'rule' WHEN inherits THEN 'context' WHEN c IN (0, 6, 7) THEN 'default' ELSE 'rule' END AS layer
        FROM g""",
    )
    def intent_context_inherit(spark, sf):
        m = t.asked_messages(spark, sf)
        out = conversations.conversation_intents(m, today=F.lit("2024-06-01"))
        return out.select("conv_id", "turn", "task", "scenario", "layer")

    @reg.add(
        "save_permission",
        """SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN role = 'user'
            WHEN 3 THEN role = 'user' ELSE true END AS granted FROM conversations""",
    )
    def save_permission(spark, sf):
        m = t.table(spark, sf, "conversations")
        c = (F.col("conv_id") + F.col("turn")) % 5
        text = (
            F.when(c == 0, F.concat(F.lit("出题，并保存到题库 "), "text"))
            .when(c == 1, F.concat(F.lit("先不保存 "), "text"))
            .when(c == 2, F.concat(F.lit("能不能保存 "), "text"))
            .when(c == 3, F.concat(F.lit("他说“请保存” "), "text"))
            .otherwise(F.concat(F.lit("请把题目存入 "), "text"))
        )
        return m.select(
            "conv_id", "turn", intent.save_authorization(text, F.col("role") == "user").alias("granted")
        )

    # --- question bank -----------------------------------------------------------

    @reg.add(
        "paper_totals_left_join",
        """SELECT o_orderkey AS paper_id, count(l_orderkey) AS question_count,
          round(coalesce(sum(l_quantity), 0), 2) AS total_score
        FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
    )
    def paper_totals_left_join(spark, sf):
        papers = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("paper_id"))
        items = t.table(spark, sf, "lineitem").select(
            F.col("l_orderkey").alias("paper_id"), F.col("l_quantity").alias("score")
        )
        return bank.paper_totals(papers, items).withColumn("total_score", F.round("total_score", 2))

    @reg.add(
        "paper_items_inner_join",
        """SELECT l_orderkey AS paper_id, l_linenumber AS position, l_partkey AS question_id, l_quantity AS score,
          p_name AS stem, p_type AS course_id FROM lineitem JOIN part ON p_partkey = l_partkey""",
    )
    def paper_items_inner_join(spark, sf):
        items = t.table(spark, sf, "lineitem").select(
            F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("position"),
            F.col("l_partkey").alias("question_id"), F.col("l_quantity").alias("score"),
        )
        q = t.bank_questions(spark, sf).select("question_id", "stem", "course_id")
        return bank.paper_items(items, q).select(
            "paper_id", "position", "question_id", "score", "stem", "course_id"
        )

    @reg.add(
        "question_order",
        "WITH " + t.BANK_SQL + """
        SELECT course_id, question_id, row_number() OVER (PARTITION BY course_id ORDER BY
          CASE status WHEN 'reviewed' THEN 0 ELSE 1 END, updated_at DESC, question_id DESC) AS place
        FROM questions QUALIFY place <= 20""",
    )
    def question_order(spark, sf):
        from citeloom.operators.joins import first_rows

        top = first_rows(
            t.bank_questions(spark, sf), ["course_id"], bank.question_order(), 20, rank="place"
        )
        return top.select("course_id", "question_id", F.col("place").cast("long").alias("place"))

    rules = [(1, "choice", "easy", 3, 2.0, ""), (2, "choice", "easy", 2, 5.0, ""), (3, "fill_blank", "medium", 4, 3.0, "ch1"),
             (4, "short_answer", "hard", 2, 10.0, "")]
    pick = "row_number() OVER (PARTITION BY course_id ORDER BY CASE status WHEN 'reviewed' THEN 0 ELSE 1 END, updated_at DESC, question_id DESC)"

    @reg.add(
        "blueprint_fill",
        "WITH " + t.BANK_SQL + f""",
        r1 AS (SELECT *, {pick} AS n FROM questions WHERE question_type = 'choice' AND difficulty = 'easy' QUALIFY n <= 3),
        r2 AS (SELECT *, {pick} AS n FROM questions WHERE question_type = 'choice' AND difficulty = 'easy'
          AND question_id NOT IN (SELECT question_id FROM r1) QUALIFY n <= 2),
        r3 AS (SELECT *, {pick} AS n FROM questions WHERE question_type = 'fill_blank' AND difficulty = 'medium'
          AND chapter = 'ch1' QUALIFY n <= 4),
        r4 AS (SELECT *, {pick} AS n FROM questions WHERE question_type = 'short_answer' AND difficulty = 'hard' QUALIFY n <= 2)
        SELECT course_id, 1 AS rule_no, question_id, 2e0 AS score FROM r1 UNION ALL
        SELECT course_id, 2, question_id, 5e0 FROM r2 UNION ALL
        SELECT course_id, 3, question_id, 3e0 FROM r3 UNION ALL
        SELECT course_id, 4, question_id, 10e0 FROM r4""",
    )
    def blueprint_fill(spark, sf):
        plan = spark.createDataFrame(
            rules, "rule_no int, question_type string, difficulty string, count int, score double, chapter string"
        )
        return bank.fill_blueprint(t.bank_questions(spark, sf), plan)

    @reg.add(
        "duplicate_stem_check",
        "WITH " + t.BANK_SQL + r"""
        SELECT course_id, lower(regexp_replace(stem, '[^\w]', '', 'g')) AS stem_key, count(*) AS uses,
          min(question_id) AS first_question FROM questions GROUP BY 1, 2 HAVING count(*) > 1""",
    )
    def duplicate_stem_check(spark, sf):
        return bank.duplicate_stems(t.bank_questions(spark, sf))

    @reg.add(
        "usable_evidence",
        "WITH " + t.BANK_SQL + """
        SELECT course_id, count(*) AS usable FROM questions
        WHERE question_id % 5 <> 0 AND (question_id % 3 <> 2 OR question_id % 2 = 0) GROUP BY course_id""",
    )
    def usable_evidence(spark, sf):
        k = F.col("question_id")
        cite = F.array(
            F.struct(
                F.when(k % 3 == 2, "lab").otherwise("all").alias("applicability_scope"),
                F.lit("2020-01-01").alias("effective_from"), F.lit("2022-12-31").alias("effective_to"),
            ),
            F.struct(
                F.when(k % 2 == 0, "exam").otherwise("lab").alias("applicability_scope"),
                F.lit("").alias("effective_from"), F.lit("").alias("effective_to"),
            ),
        )
        q = t.bank_questions(spark, sf).withColumn("citations", F.when(k % 5 != 0, cite))
        ok = bank.usable_evidence("citations", F.lit("exam"), F.lit("2021-06-01"))
        return q.filter(ok).groupBy("course_id").agg(F.count("*").alias("usable"))

    # --- practice ------------------------------------------------------------------

    order = "coalesce(submitted_at, created_at) DESC, attempt_id DESC"
    graded = f""", graded AS (SELECT * FROM attempts WHERE status = 'graded'
        QUALIFY row_number() OVER (PARTITION BY course_id, question_id ORDER BY {order}) = 1)"""

    @reg.add(
        "practice_latest_graded",
        "WITH " + t.ATTEMPTS_SQL + graded + " SELECT course_id, question_id, attempt_id, correct FROM graded",
    )
    def practice_latest_graded(spark, sf):
        return bank.latest_graded(t.attempts(spark, sf)).select(
            "course_id", "question_id", "attempt_id", "correct"
        )

    @reg.add(
        "practice_wrong_queue",
        "WITH " + t.ATTEMPTS_SQL + graded + " SELECT course_id, question_id, attempt_id FROM graded WHERE NOT correct",
    )
    def practice_wrong_queue(spark, sf):
        return bank.wrong_queue(t.attempts(spark, sf)).select("course_id", "question_id", "attempt_id")

    @reg.add(
        "practice_stats_7d",
        "WITH " + t.ATTEMPTS_SQL + """
        SELECT course_id, count(*) AS submitted, count(*) FILTER (WHERE correct = false) AS wrong,
          count(*) FILTER (WHERE grading_method = 'self' AND correct IS NOT NULL) AS self_assessed,
          count(*) FILTER (WHERE correct IS NULL) AS awaiting_assessment,
          count(*) FILTER (WHERE previous_attempt_id IS NOT NULL AND correct) AS retrained_correct
        FROM attempts WHERE status <> 'started' AND submitted_at >= TIMESTAMP '2024-01-24 00:00:00'
        GROUP BY course_id""",
    )
    def practice_stats_7d(spark, sf):
        cutoff = F.lit("2024-01-31 00:00:00").cast("timestamp") - F.expr("INTERVAL 7 DAYS")
        return bank.practice_stats(t.attempts(spark, sf), cutoff)

    @reg.add(
        "never_practised",
        "WITH " + t.BANK_SQL + "," + t.ATTEMPTS_SQL + """
        SELECT course_id, question_id FROM questions q WHERE NOT EXISTS (
          SELECT 1 FROM attempts a WHERE a.course_id = q.course_id AND a.question_id = q.question_id)""",
    )
    def never_practised(spark, sf):
        return bank.never_practised(t.bank_questions(spark, sf), t.attempts(spark, sf)).select(
            "course_id", "question_id"
        )

    @reg.add(
        "recommendations_top5",
        "WITH " + t.BANK_SQL + "," + t.ATTEMPTS_SQL + graded + f""",
        tries AS (
          SELECT course_id, question_id, attempt_id, submitted_at, created_at, 0 AS tier, 'resume' AS action
          FROM attempts WHERE status IN ('started', 'submitted') UNION ALL
          SELECT course_id, question_id, attempt_id, submitted_at, created_at, 1, 'retry' FROM graded WHERE NOT correct),
        uniq AS (SELECT * FROM tries QUALIFY row_number() OVER (PARTITION BY course_id, question_id ORDER BY tier, {order}) = 1),
        placed AS (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY tier, {order}) AS place FROM uniq),
        fresh AS (SELECT course_id, question_id, {pick} AS place FROM questions q WHERE NOT EXISTS (
          SELECT 1 FROM attempts a WHERE a.course_id = q.course_id AND a.question_id = q.question_id)),
        both_ AS (SELECT course_id, question_id, attempt_id, action, 0 AS late, place FROM placed UNION ALL
          SELECT course_id, question_id, NULL, 'start', 1, place FROM fresh)
        SELECT course_id, question_id, attempt_id, action, row_number() OVER (PARTITION BY course_id ORDER BY late, place) AS position
        FROM both_ QUALIFY position <= 5""",
    )
    def recommendations_top5(spark, sf):
        out = bank.recommendations(t.bank_questions(spark, sf), t.attempts(spark, sf))
        return out.select(
            "course_id", "question_id", "attempt_id", "action",
            F.col("position").cast("long").alias("position"),
        )

    @reg.add(
        "idempotent_start",
        "WITH " + t.ATTEMPTS_SQL + """
        SELECT course_id, attempt_id, CASE WHEN n = 1 THEN 'created'
          WHEN q IS NOT DISTINCT FROM question_id AND p IS NOT DISTINCT FROM previous_attempt_id THEN 'existing'
          ELSE 'conflict' END AS outcome
        FROM (SELECT *, row_number() OVER w AS n, first_value(question_id) OVER w AS q,
                first_value(previous_attempt_id) OVER w AS p FROM attempts
              WINDOW w AS (PARTITION BY course_id, request_id ORDER BY created_at, attempt_id))""",
    )
    def idempotent_start(spark, sf):
        return bank.first_requests(t.attempts(spark, sf)).select("course_id", "attempt_id", "outcome")

    # --- set logic and evaluation ------------------------------------------------------

    @reg.add(
        "snapshot_diff",
        """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added'
            WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS difference
        FROM (SELECT doc_id, text FROM documents WHERE doc_id % 10 <> 1) a
        FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 10 = 2 THEN text || '!' ELSE text END AS text
                   FROM documents WHERE doc_id % 10 <> 3) b USING (doc_id)
        WHERE a.text IS DISTINCT FROM b.text""",
    )
    def snapshot_diff(spark, sf):
        d = t.table(spark, sf, "documents")
        k = F.col("doc_id") % 10
        digest = F.sha2("text", 256)
        edited = F.when(k == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
        old = d.filter(k != 1).select("doc_id", digest.alias("old"))
        new = d.filter(k != 3).select("doc_id", F.sha2(edited, 256).alias("new"))
        out = old.join(new, "doc_id", "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
        return out.select(
            "doc_id",
            F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed")
            .otherwise("changed").alias("difference"),
        )

    @reg.add(
        "semi_join_exists",
        "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    )
    def semi_join_exists(spark, sf):
        o = t.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
        return t.table(spark, sf, "customer").join(o, "c_custkey", "left_semi").select(
            "c_custkey", "c_mktsegment"
        )

    @reg.add(
        "anti_join_missing",
        "SELECT vec_id FROM embeddings WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = vec_id)",
    )
    def anti_join_missing(spark, sf):
        labelled = t.table(spark, sf, "labels").select(F.col("doc_id").alias("vec_id"))
        return t.table(spark, sf, "embeddings").select("vec_id").join(labelled, "vec_id", "left_anti")

    ranked = "WITH " + INDEX_SQL + "," + t.QUERIES_SQL + SCORE_SQL + LEXICAL_SQL.format(k=10) + """,
        hits AS (SELECT l.query_id, l.rank, c.source_file FROM lexical l JOIN chunks c USING (doc_id)),
        rel AS (SELECT DISTINCT q.query_id, c.source_file FROM queries q JOIN chunks c USING (course_id)
          JOIN labels b ON b.doc_id = c.doc_id AND b.quality = 1),
        m AS (SELECT q.query_id, q.course_id,
            (SELECT count(*) FROM rel r WHERE r.query_id = q.query_id) AS n_rel,
            (SELECT count(DISTINCT h.source_file) FROM hits h JOIN rel r USING (query_id, source_file)
              WHERE h.query_id = q.query_id AND h.rank <= 5) AS found,
            (SELECT min(h.rank) FROM hits h JOIN rel r USING (query_id, source_file) WHERE h.query_id = q.query_id) AS first_rank
          FROM queries q),
        e AS (SELECT query_id, course_id, CASE WHEN n_rel = 0 THEN 0e0 ELSE found / n_rel END AS recall_at_k,
            coalesce(1e0 / first_rank, 0e0) AS mrr FROM m)"""

    def measured(spark, sf):
        chunks, q = t.document_chunks(spark, sf), t.benchmark_queries(spark, sf)
        n = row_bound(q)
        top = lexical.bm25_topk(chunks, q, 10)
        files = chunks.select("course_id", "doc_id", "chunk_index", "source_file")
        hits = join_small(files, top, ["course_id", "doc_id", "chunk_index"], rows=n and n * 10)
        good = t.table(spark, sf, "labels").filter("quality = 1").select("doc_id")
        # Relevant files per course first: a course's files meet its queries
        # only after they are distinct.
        rel = chunks.join(good, "doc_id").select("course_id", "source_file").distinct()
        rel = rel.join(q.select("query_id", "course_id"), "course_id").select("query_id", "source_file")
        return evaluation.query_metrics(hits, rel, q.select("query_id", "course_id"), 5)

    @reg.add("recall_at_k", ranked + " SELECT query_id, round(recall_at_k, 6) AS recall_at_k FROM e")
    def recall_at_k(spark, sf):
        return measured(spark, sf).select("query_id", F.round("recall_at_k", 6).alias("recall_at_k"))

    @reg.add("mrr", ranked + " SELECT query_id, round(mrr, 6) AS mrr FROM e")
    def mrr(spark, sf):
        return measured(spark, sf).select("query_id", F.round("mrr", 6).alias("mrr"))

    @reg.add(
        "eval_by_course",
        ranked + """ SELECT course_id, round(avg(recall_at_k), 6) AS recall_at_k, round(avg(mrr), 6) AS mrr,
          CAST(count(*) AS DOUBLE) AS n FROM e GROUP BY course_id""",
    )
    def eval_by_course(spark, sf):
        out = evaluation.aggregate_metrics(measured(spark, sf), ["course_id"])
        return out.select(
            "course_id", F.round("recall_at_k", 6).alias("recall_at_k"), F.round("mrr", 6).alias("mrr"), "n"
        )

    @reg.add(
        "case_flags",
        """WITH c AS (
          SELECT doc_id, quality = 0 AS refuse, (doc_id % 4) <> 0 AS grounded, doc_id % 3 = 0 AS missing FROM labels),
        f AS (SELECT *, refuse AND grounded AS a, NOT refuse AND NOT grounded AS b, NOT refuse AND missing AS m FROM c)
        SELECT doc_id AS id, concat_ws(',', CASE WHEN a THEN 'refusal_mismatch' END,
          CASE WHEN b THEN 'unexpected_refusal' END, CASE WHEN m THEN 'expected_source_missing' END) AS flags FROM f""",
    )
    def case_flags(spark, sf):
        k = F.col("doc_id")
        cases = t.table(spark, sf, "labels").select(
            k.alias("id"), (F.col("quality") == 0).alias("expect_refusal"), (k % 4 != 0).alias("grounded"),
            F.lit("a.md").alias("source"),
            F.when(k % 3 == 0, F.array(F.lit("b.md"))).otherwise(F.array(F.lit("a.md"))).alias("cited_sources"),
        )
        return evaluation.case_flags(cases).select("id", F.array_join("flags", ",").alias("flags"))

