"""Stores, catalog, conversations, practice and study steps over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import markup, queries, tasks, text
from citeloom.operators import bank, catalog, conversations, store, study
from citeloom.sources import tables as t


def _documents(spark, sf):
    """Orders as document rows: the customer is the course, the priority the name."""
    o = t.table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("doc_id"),
        F.col("o_custkey").cast("string").alias("course_id"),
        F.when(F.col("o_orderkey") % 9 == 0, "").otherwise(F.col("o_orderpriority")).alias("logical_name"),
        F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "processing")
        .otherwise("failed").alias("status"),
        (F.col("o_orderkey") % 4 != 0).alias("is_active"),
        F.col("o_totalprice").alias("file_mtime"),
        (F.col("o_orderkey") % 50).cast("int").alias("chunk_count"),
    )


DOCS_SQL = """
docs AS (
  SELECT o_orderkey AS doc_id, CAST(o_custkey AS VARCHAR) AS course_id,
    CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE o_orderpriority END AS logical_name,
    CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'processing' ELSE 'failed' END AS status,
    o_orderkey % 4 <> 0 AS is_active, o_totalprice AS file_mtime, CAST(o_orderkey % 50 AS INTEGER) AS chunk_count
  FROM orders)
"""


def _conversations(spark, sf):
    """One row per conversation, its course and time from the key."""
    m = t.table(spark, sf, "conversations").select("conv_id").distinct()
    return m.select(
        "conv_id", F.concat(F.lit("c"), (F.col("conv_id") % 5).cast("string")).alias("course_id"),
        (F.col("conv_id") * 7919 % 1000).alias("updated_at"),
    )


CONV_SQL = """
conv AS (SELECT DISTINCT conv_id, 'c' || (conv_id % 5) AS course_id, conv_id * 7919 % 1000 AS updated_at FROM conversations)
"""


def add(reg) -> None:
    # --- stored rows --------------------------------------------------------------

    @reg.add(
        "append_missing_rows",
        "SELECT c_custkey, CASE WHEN c_nationkey < 12 THEN c_acctbal ELSE c_acctbal * 2 END AS balance FROM customer",
    )
    def append_missing_rows(spark, sf):
        c = t.table(spark, sf, "customer")
        old = c.filter("c_nationkey < 12").select("c_custkey", F.col("c_acctbal").alias("balance"))
        return store.append_missing(old, c.select("c_custkey", (F.col("c_acctbal") * 2).alias("balance")), ["c_custkey"])

    @reg.add("delete_rows", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'F'")
    def delete_rows(spark, sf):
        o = t.table(spark, sf, "orders")
        return store.delete(o.select("o_orderkey", "o_custkey"), o.filter("o_orderstatus = 'F'"), ["o_orderkey"])

    @reg.add(
        "chunk_store_rows",
        "WITH " + t.CHUNKS_SQL + """
        SELECT doc_id || '_' || chunk_index AS id, CASE WHEN doc_id % 3 = 0 THEN -1 ELSE page END AS page, true AS is_active,
          'content' AS content_role, CAST(replace(effective_from, '-', '') AS INTEGER) AS effective_from_sort,
          CAST(replace(effective_to, '-', '') AS INTEGER) AS effective_to_sort FROM chunks""",
    )
    def chunk_store_rows(spark, sf):
        c = t.document_chunks(spark, sf)
        c = c.withColumn("page", F.when(F.col("doc_id") % 3 != 0, F.col("page")))
        return store.chunk_rows(c).select(
            "id", "page", "is_active", "content_role", "effective_from_sort", "effective_to_sort"
        )

    @reg.add(
        "hit_read_rows",
        "WITH " + t.CHUNKS_SQL + """
        SELECT doc_id, nullif(CASE WHEN doc_id % 3 = 0 THEN -1 ELSE page END, -1) AS page,
          CASE WHEN doc_id % 4 = 0 THEN 30 ELSE authority_level END AS authority_level FROM chunks""",
    )
    def hit_read_rows(spark, sf):
        k = F.col("doc_id")
        c = t.document_chunks(spark, sf).withColumns(
            {
                "page": F.when(k % 3 == 0, F.lit(-1)).otherwise(F.col("page")),
                "authority_level": F.when(k % 4 == 0, F.lit(0)).otherwise(F.col("authority_level")),
            }
        )
        return store.hit_rows(c).select("doc_id", "page", "authority_level")

    @reg.add(
        "read_chunks_filtered",
        "WITH " + t.CHUNKS_SQL + """
        SELECT doc_id, chunk_index, md5(text) AS digest FROM chunks WHERE course_id = 'src3' AND block_type = 'text'
          AND applicability_scope IN ('exam', 'all') AND '2021-06-01' BETWEEN effective_from AND effective_to""",
    )
    def read_chunks_filtered(spark, sf):
        found = store.read_chunks(
            t.document_chunks(spark, sf), "src3", block_type="text", scenario="exam", as_of="2021-06-01"
        )
        return found.select("doc_id", "chunk_index", F.md5("text").alias("digest"))

    @reg.add(
        "set_active_docs",
        "WITH " + t.CHUNKS_SQL + """
        SELECT c.doc_id, chunk_index, coalesce(toxic = 0, true) AS is_active
        FROM chunks c LEFT JOIN labels l ON l.doc_id = c.doc_id""",
    )
    def set_active_docs(spark, sf):
        c = t.document_chunks(spark, sf).withColumn("is_active", F.lit(True))
        shown = t.table(spark, sf, "labels").select("doc_id", (F.col("toxic") == 0).alias("is_active"))
        return store.set_active(c, shown).select("doc_id", "chunk_index", "is_active")

    @reg.add(
        "set_evidence_merge",
        "WITH " + t.CHUNKS_SQL + """
        SELECT c.doc_id, CASE WHEN quality = 1 THEN '2019-05-06' ELSE effective_from END AS effective_from,
          CASE WHEN quality = 1 THEN 20190506 ELSE CAST(replace(effective_from, '-', '') AS INTEGER) END AS effective_from_sort,
          CAST(replace(effective_to, '-', '') AS INTEGER) AS effective_to_sort
        FROM chunks c LEFT JOIN labels l ON l.doc_id = c.doc_id""",
    )
    def set_evidence_merge(spark, sf):
        found = t.table(spark, sf, "labels").select(
            "doc_id", F.when(F.col("quality") == 1, "2019-05-06").alias("effective_from")
        )
        return store.set_evidence(t.document_chunks(spark, sf), found).select(
            "doc_id", "effective_from", "effective_from_sort", "effective_to_sort"
        )

    @reg.add(
        "rebind_course",
        "SELECT CASE source WHEN 'src3' THEN 'moved' ELSE source END AS course_id, count(*) AS chunks FROM documents GROUP BY 1",
    )
    def rebind_course(spark, sf):
        return store.rebind_course(t.document_chunks(spark, sf), "src3", "moved").groupBy("course_id").agg(
            F.count("*").alias("chunks")
        )

    @reg.add("guard_dimension", "SELECT vec_id, len(embedding)::INTEGER AS dim FROM embeddings")
    def guard_dimension(spark, sf):
        e = t.table(spark, sf, "embeddings")
        return store.guard_dimension(e, e).select("vec_id", F.size("embedding").alias("dim"))

    @reg.add(
        "rebuild_states",
        "WITH " + DOCS_SQL + """
        SELECT doc_id, 'failed' AS status, CASE WHEN status = 'done' THEN 0 ELSE chunk_count END AS chunk_count FROM docs""",
    )
    def rebuild_states(spark, sf):
        out = store.recover_processing(store.fail_after_rebuild(_documents(spark, sf)))
        return out.select("doc_id", "status", "chunk_count")

    @reg.add(
        "scan_plan",
        "WITH " + DOCS_SQL + r""",
        named AS (SELECT *, logical_name || '/' || doc_id % 5000 || (CASE WHEN doc_id % 3 = 0 THEN '.PDF' ELSE '.md' END) AS path FROM docs),
        last AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY path ORDER BY doc_id DESC) = 1),
        files AS (SELECT DISTINCT o_orderpriority || '/' || o_orderkey % 5000 || (CASE WHEN o_orderkey % 3 = 0 THEN '.PDF' ELSE '.md' END) AS path
          FROM orders)
        SELECT f.path, l.doc_id, CASE
          WHEN l.doc_id IS NOT NULL AND l.course_id <> '7' THEN 'skip_other_course'
          WHEN lower(f.path) LIKE '%.pdf' THEN 'fingerprint'
          WHEN l.doc_id IS NULL OR l.status = 'failed' OR (l.status = 'done' AND 150000 > l.file_mtime + 0.001) THEN 'ingest'
          ELSE 'unchanged' END AS action
        FROM files f LEFT JOIN last l ON l.path = f.path""",
    )
    def scan_plan(spark, sf):
        def path(name, key):
            end = F.when(key % 3 == 0, ".PDF").otherwise(".md")
            return F.concat(name, F.lit("/"), (key % 5000).cast("string"), end)

        docs = _documents(spark, sf)
        docs = docs.withColumn("path", path(F.col("logical_name"), F.col("doc_id")))
        files = t.table(spark, sf, "orders").select(
            path(F.col("o_orderpriority"), F.col("o_orderkey")).alias("path"), F.lit(150000.0).alias("mtime")
        ).distinct()
        return store.scan_plan(files, docs, "7").select("path", "doc_id", "action")

    @reg.add(
        "newest_document",
        "WITH " + DOCS_SQL + """
        SELECT course_id, logical_name, max(doc_id) AS doc_id FROM docs WHERE is_active AND logical_name <> '' GROUP BY 1, 2""",
    )
    def newest_document(spark, sf):
        return store.newest_by(_documents(spark, sf), "logical_name").select("course_id", "logical_name", "doc_id")

    @reg.add(
        "active_documents",
        "WITH " + DOCS_SQL + "SELECT course_id, logical_name, doc_id FROM docs WHERE is_active AND logical_name <> ''",
    )
    def active_documents(spark, sf):
        return store.active_by(_documents(spark, sf), "logical_name").select("course_id", "logical_name", "doc_id")

    @reg.add(
        "migrate_defaults",
        "SELECT event_id, coalesce(CASE WHEN event_type = 'error' THEN NULL ELSE event_type END, 'none') AS kind, 'all' AS scope FROM events",
    )
    def migrate_defaults(spark, sf):
        e = t.table(spark, sf, "events").select(
            "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind")
        )
        return store.migrate(e, {"kind": "none", "scope": "all"})

    @reg.add(
        "merged_listing",
        """SELECT coalesce(s.c_custkey, l.c_custkey) AS id, s.c_custkey IS NOT NULL AS on_server, l.c_custkey IS NOT NULL AS on_client
        FROM (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0) s
        FULL JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) l ON l.c_custkey = s.c_custkey""",
    )
    def merged_listing(spark, sf):
        c = t.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("updated_at"))
        return store.merge_listing(c.filter("id % 3 > 0"), c.filter("id % 2 = 0")).select("id", "on_server", "on_client")

    @reg.add(
        "save_once_rows",
        """SELECT p_type AS course_id, count(*) AS questions FROM part WHERE p_size % 2 = 1
          OR (p_brand, p_type) NOT IN (SELECT p_brand, p_type FROM part WHERE p_size % 2 = 1) GROUP BY 1""",
    )
    def save_once_rows(spark, sf):
        p = t.table(spark, sf, "part").select(
            F.col("p_brand").alias("task_id"), F.col("p_type").alias("course_id"), "p_partkey", "p_size"
        )
        before, batch = p.filter("p_size % 2 = 1"), p.filter("p_size % 2 = 0")
        table, _ = store.save_once(before.drop("task_id"), before.select("task_id", "course_id").distinct(), batch)
        return table.groupBy("course_id").agg(F.count("*").alias("questions"))

    @reg.add(
        "required_keys",
        "SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)",
    )
    def required_keys(spark, sf):
        wanted = t.table(spark, sf, "lineitem").select("l_partkey")
        have = t.table(spark, sf, "part").filter("p_size > 5").select(F.col("p_partkey").alias("l_partkey"))
        return store.require_all(wanted, have, ["l_partkey"])

    @reg.add(
        "snapshot_changes",
        """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'added' WHEN c_custkey % 5 = 0 THEN 'removed' ELSE 'changed' END AS difference
        FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 5 > 0 OR c_custkey % 5 = 0 AND c_custkey % 7 > 0
          OR c_custkey % 5 > 0 AND c_custkey % 7 > 0 AND c_custkey % 3 = 0""",
    )
    def snapshot_changes(spark, sf):
        c = t.table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
        old = c.filter("c_custkey % 7 <> 0")
        new = c.filter("c_custkey % 5 <> 0").withColumn(
            "c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "other").otherwise(F.col("c_mktsegment"))
        )
        return store.snapshot_changes(old, new, ["c_custkey"], ["c_acctbal", "c_mktsegment"])

    # --- papers and practice ------------------------------------------------------

    @reg.add(
        "paper_checks",
        """WITH items AS (SELECT l_orderkey, l_partkey, l_quantity * 3 AS score, l_linenumber FROM lineitem),
        q AS (SELECT * FROM part WHERE p_size > 3),
        bad AS (
          SELECT l_orderkey, l_partkey, unnest([
            CASE WHEN p_partkey IS NULL THEN 'missing_question' END,
            CASE WHEN p_type <> 'PROMO' THEN 'other_course' END,
            CASE WHEN p_size <> 10 THEN 'changed_since' END,
            CASE WHEN NOT (score > 0 AND score <= 100) THEN 'score_range' END]) AS issue
          FROM items LEFT JOIN q ON p_partkey = l_partkey)
        SELECT issue, count(*) AS items FROM (
          SELECT issue FROM bad WHERE issue IS NOT NULL UNION ALL
          SELECT 'duplicate_question' FROM items GROUP BY l_orderkey, l_partkey HAVING count(*) > 1) GROUP BY issue""",
    )
    def paper_checks(spark, sf):
        items = t.table(spark, sf, "lineitem").select(
            F.col("l_orderkey").alias("paper_id"), F.lit("PROMO").alias("course_id"),
            F.col("l_partkey").alias("question_id"), (F.col("l_quantity") * 3).alias("score"),
            F.lit(10).alias("seen_updated_at"),
        )
        q = t.table(spark, sf, "part").filter("p_size > 3").select(
            F.col("p_partkey").alias("question_id"), F.col("p_type").alias("course_id"), F.col("p_size").alias("updated_at")
        )
        return store.paper_issues(items, q).groupBy("issue").agg(F.count("*").alias("items"))

    @reg.add(
        "numbered_items",
        """SELECT l_orderkey AS paper_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) AS INTEGER) AS position,
          l_partkey AS question_id FROM lineitem""",
    )
    def numbered_items(spark, sf):
        papers = t.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("paper_id")).agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("l_partkey", "l_linenumber"))), lambda x: x["l_partkey"]
            ).alias("question_ids")
        )
        return store.number_items(papers)

    @reg.add(
        "deletable_questions",
        "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    )
    def deletable_questions(spark, sf):
        q = t.table(spark, sf, "part").select(F.col("p_partkey").alias("question_id"))
        items = t.table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("question_id"))
        return store.deletable(q, items).withColumnRenamed("question_id", "p_partkey")

    @reg.add(
        "practice_transitions",
        "WITH " + t.ATTEMPTS_SQL + """,
        ch AS (SELECT attempt_id, attempt_id % 2 = 0 AS submits, attempt_id % 6 IN (1, 2) AS assesses, attempt_id % 3 = 0 AS ok FROM attempts),
        a AS (SELECT a.*, ch.submits, ch.assesses, ch.ok, a.status = 'started' AND ch.submits AS goes FROM attempts a JOIN ch USING (attempt_id)),
        b AS (SELECT *, CASE WHEN goes AND grading_method = 'objective' THEN 'graded' WHEN goes THEN 'submitted' ELSE status END AS after FROM a),
        c AS (SELECT *, after = 'submitted' AND grading_method <> 'objective' AND assesses AS own FROM b)
        SELECT attempt_id, CASE WHEN own THEN 'graded' ELSE after END AS status,
          CASE WHEN own THEN true WHEN goes AND grading_method = 'objective' THEN ok ELSE correct END AS correct FROM c""",
    )
    def practice_transitions(spark, sf):
        a = t.attempts(spark, sf).withColumns(
            {"user_answer": F.lit(None).cast("string"), "selected_option": F.lit(None).cast("int")}
        )
        k = F.col("attempt_id")

        def change(kind, seq, correct):
            return a.select(
                "attempt_id", F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), F.lit("x").alias("user_answer"),
                F.lit(1).alias("selected_option"), correct.alias("correct"), F.col("created_at").alias("at"),
            )

        first = change("submit", 1, k % 3 == 0).filter(k % 2 == 0)
        again = change("submit", 2, k % 3 != 0).filter(k % 2 == 0)
        own = change("assess", 3, F.lit(True)).filter((k % 6).isin(1, 2))
        out = store.practice_transition(a, first.unionByName(again).unionByName(own))
        return out.select("attempt_id", "status", "correct")

    @reg.add(
        "attempt_history",
        "WITH " + t.ATTEMPTS_SQL + """
        SELECT course_id, attempt_id, row_number() OVER (PARTITION BY course_id ORDER BY coalesce(submitted_at, created_at) DESC, attempt_id DESC) AS position
        FROM attempts WHERE status <> 'started' QUALIFY position <= 50""",
    )
    def attempt_history(spark, sf):
        return bank.practice_history(t.attempts(spark, sf), 50).select(
            "course_id", "attempt_id", F.col("position").cast("long").alias("position")
        )

    @reg.add(
        "presented_attempts",
        "WITH " + t.ATTEMPTS_SQL + "SELECT attempt_id, CASE WHEN status <> 'started' THEN question_id || '!' END AS answer FROM attempts",
    )
    def presented_attempts(spark, sf):
        a = t.attempts(spark, sf).withColumn("answer", F.concat(F.col("question_id").cast("string"), F.lit("!")))
        return bank.present_attempts(a).select("attempt_id", "answer")

    @reg.add(
        "colliding_drafts",
        "WITH " + t.BANK_SQL + r""",
        d AS (SELECT course_id, question_id AS draft_no, upper(stem) || '?' AS stem, lower(regexp_replace(stem, '\W', '', 'g')) AS k FROM questions WHERE question_id % 4 > 0),
        b AS (SELECT DISTINCT course_id, lower(regexp_replace(stem, '\W', '', 'g')) AS k FROM questions WHERE question_id % 4 = 0),
        r AS (SELECT d.*, row_number() OVER (PARTITION BY d.course_id, d.k ORDER BY draft_no) > 1 AS repeat, b.k IS NOT NULL AS in_bank
          FROM d LEFT JOIN b ON b.course_id = d.course_id AND b.k = d.k)
        SELECT course_id, draft_no, stem, repeat, in_bank FROM r WHERE repeat OR in_bank""",
    )
    def colliding_drafts(spark, sf):
        q = t.bank_questions(spark, sf)
        drafts = q.filter("question_id % 4 > 0").select(
            "course_id", F.col("question_id").alias("draft_no"), F.concat(F.upper("stem"), F.lit("?")).alias("stem")
        )
        return bank.colliding_drafts(drafts, q.filter("question_id % 4 = 0"))

    @reg.add(
        "choice_answers",
        "SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE CAST(p_partkey % 5 AS BIGINT) END AS answer FROM part",
    )
    def choice_answers(spark, sf):
        p = t.table(spark, sf, "part")
        k = (F.col("p_partkey") % 5).cast("int")
        options = F.array(*[F.concat(F.col("p_name"), F.lit(f" {c} ")) for c in "abcd"])
        answer = F.concat(F.col("p_name"), F.lit(" "), F.element_at(F.array(*[F.lit(c) for c in "abcdx"]), k + 1))
        return p.select("p_partkey", bank.choice_answer(options, answer).alias("answer"))

    @reg.add(
        "evidence_status",
        """SELECT p_partkey AS question_id, CASE WHEN p_partkey % 6 = 0 THEN 'unverified' WHEN o_orderkey IS NULL THEN 'stale'
            WHEN o_orderstatus = 'F' AND o_orderkey % 4 > 0 AND p_size % 3 > 0 THEN 'current' ELSE 'stale' END AS evidence_status
        FROM part LEFT JOIN orders ON o_orderkey = p_partkey * 3""",
    )
    def evidence_status(spark, sf):
        k = F.col("p_partkey")
        fields = {
            "source_version": F.when(F.col("p_size") % 3 == 0, "2").otherwise("1"),
            "effective_from": F.lit(None).cast("string"), "effective_to": F.lit(None).cast("string"),
            "applicability_scope": F.lit("all"), "authority_level": F.lit(None).cast("int"),
        }
        cited = F.struct((k * 3).cast("string").alias("doc_id"), *[c.alias(n) for n, c in fields.items()])
        q = t.table(spark, sf, "part").select(
            F.lit("c").alias("course_id"), k.alias("question_id"), F.lit(100).alias("created_at"),
            F.when(k % 6 != 0, F.array(cited)).alias("citations"),
        )
        docs = _documents(spark, sf).select(
            "doc_id", F.lit("c").alias("course_id"), "is_active", "status", F.lit(True).alias("file_present"),
            F.lit(50).alias("updated_at"), F.lit("1").alias("source_version"), F.lit("2020-01-01").alias("effective_from"),
            F.lit("2030-01-01").alias("effective_to"), F.lit("all").alias("applicability_scope"), F.lit(30).alias("authority_level"),
        )
        return bank.citation_status(q, docs, F.lit("2024-01-01")).select("question_id", "evidence_status")

    # --- conversations and catalog ------------------------------------------------

    @reg.add("conversation_listing", "WITH " + CONV_SQL + "SELECT conv_id, updated_at FROM conv WHERE course_id = 'c2'")
    def conversation_listing(spark, sf):
        return conversations.list_conversations(_conversations(spark, sf), "c2").select("conv_id", "updated_at")

    @reg.add(
        "touched_conversations",
        "WITH " + CONV_SQL + """SELECT conv_id, greatest(updated_at, m) AS updated_at
        FROM conv JOIN (SELECT conv_id, max(turn * 100 + length(text)) AS m FROM conversations GROUP BY 1) USING (conv_id)""",
    )
    def touched_conversations(spark, sf):
        m = t.table(spark, sf, "conversations").select(
            "conv_id", (F.col("turn") * 100 + F.length("text")).alias("created_at")
        )
        return conversations.touch(_conversations(spark, sf), m).select("conv_id", "updated_at")

    @reg.add("conversation_delete", "SELECT conv_id, turn FROM conversations WHERE conv_id % 3 <> 1")
    def conversation_delete(spark, sf):
        gone = _conversations(spark, sf).filter("conv_id % 3 = 1")
        _, messages = conversations.delete_cascade(
            gone, _conversations(spark, sf), t.table(spark, sf, "conversations").select("conv_id", "turn")
        )
        return messages

    @reg.add(
        "message_history",
        """SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS seq, role, md5(text) AS digest FROM (
          SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4)""",
    )
    def message_history(spark, sf):
        out = conversations.history(t.table(spark, sf, "conversations"), 4)
        return out.select("conv_id", "seq", "role", F.md5("text").alias("digest"))

    @reg.add(
        "task_checkpoint",
        """SELECT conv_id, o.n AS task_id, CASE WHEN ok THEN 'done' ELSE status END AS status, ok AS accepted FROM (
          SELECT conv_id, conv_id % 7 AS n, CASE WHEN conv_id % 5 = 0 THEN 'cancelled' ELSE 'running' END AS status,
            conv_id % 2 = 0 AND conv_id % 5 > 0 AS ok FROM (SELECT DISTINCT conv_id FROM conversations)) o""",
    )
    def task_checkpoint(spark, sf):
        k = F.col("conv_id")
        now = _conversations(spark, sf).select(
            "conv_id", F.lit("c").alias("course_id"), (k % 7).alias("task_id"),
            F.when(k % 5 == 0, "cancelled").otherwise("running").alias("status"), F.lit("{}").alias("body"),
        )
        new = now.withColumns({"task_id": F.when(k % 2 == 0, k % 7).otherwise(k % 7 + 1), "status": F.lit("done")})
        return store.checkpoint_task(now, new).select("conv_id", "task_id", "status", "accepted")

    @reg.add("course_listing", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_nationkey = 7")
    def course_listing(spark, sf):
        c = t.table(spark, sf, "customer").select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("college_id")
        )
        return catalog.list_courses(c, 7).select("id", "name")

    @reg.add(
        "missing_courses",
        "SELECT DISTINCT o_custkey AS course_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 15)",
    )
    def missing_courses(spark, sf):
        rows = t.table(spark, sf, "orders").select(F.col("o_custkey").alias("course_id"))
        known = t.table(spark, sf, "customer").filter("c_nationkey < 15").select(F.col("c_custkey").alias("id"))
        return catalog.missing_courses(rows, known)

    @reg.add(
        "seeded_courses",
        "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'old' END AS name FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0",
    )
    def seeded_courses(spark, sf):
        c = t.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
        return catalog.seed(c.filter("id % 2 = 0").withColumn("name", F.lit("old")), c.filter("id % 3 = 0"))

    @reg.add(
        "legacy_migration",
        "SELECT CASE WHEN source IN ('src1', 'src2') THEN 'src0' ELSE source END AS course_id, count(*) AS documents FROM documents GROUP BY 1",
    )
    def legacy_migration(spark, sf):
        docs = t.table(spark, sf, "documents").select(F.col("source").alias("course_id"))
        courses = docs.distinct().select(F.col("course_id").alias("id"), F.lit("college").alias("college_id"))
        colleges = courses.select(F.col("college_id").alias("id")).distinct()
        _, _, moved = catalog.migrate_legacy(colleges, courses, docs, ["src1", "src2"], [], "src0")
        return moved.groupBy("course_id").agg(F.count("*").alias("documents"))

    # --- expressions over texts ---------------------------------------------------

    @reg.add(
        "search_topic",
        """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang || source WHEN 1 THEN lang || source WHEN 2 THEN lang || ' ' || source
            ELSE trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') || '，' END AS topic FROM documents""",
    )
    def search_topic(spark, sf):
        k = F.col("doc_id") % 4
        asked = (
            F.when(k == 0, F.concat(F.lit("请问什么是"), "lang", "source", F.lit("？")))
            .when(k == 1, F.concat(F.lit("介绍一下 "), "lang", "source"))
            .when(k == 2, F.concat("lang", F.lit(" "), "source", F.lit("的定义是什么")))
            .otherwise(F.concat(text.strip("text"), F.lit("，")))
        )
        return t.table(spark, sf, "documents").select("doc_id", queries.search_query(asked).alias("topic"))

    @reg.add(
        "item_numbers",
        """SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN '1' ELSE '1,' || (p_size % 9 + 1) END || ',12' AS numbers,
          CAST(p_size % 9 + 1 AS INTEGER) AS announced, (p_size % 9 + 1) || '-2' AS figures FROM part""",
    )
    def item_numbers(spark, sf):
        n = (F.col("p_size") % 9 + 1).cast("string")
        body = F.concat(
            F.lit("共有"), n, F.lit("个步骤，见图 "), n, F.lit(".2\n(1) "), "p_name", F.lit("\n　（"), n, F.lit("） x\n十二、y")
        )
        return t.table(spark, sf, "part").select(
            "p_partkey",
            F.array_join(queries.list_item_numbers(body), ",").alias("numbers"),
            queries.expected_list_count(body).alias("announced"),
            F.array_join(queries.figure_refs(body), ",").alias("figures"),
        )

    @reg.add(
        "type_labels",
        """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'markdown' WHEN 1 THEN 'pdf' WHEN 2 THEN 'word' ELSE 'other' END AS kind,
          CASE page_id % 4 WHEN 0 THEN 'Markdown 笔记' WHEN 1 THEN 'PDF 讲义' WHEN 2 THEN 'Word 文档' ELSE '其他' END AS label,
          CASE page_id % 4 WHEN 3 THEN 'image/jpeg' ELSE '' END AS media FROM pages""",
    )
    def type_labels(spark, sf):
        k = F.col("page_id") % 4
        end = F.when(k == 0, ".md").when(k == 1, ".PDF").when(k == 2, ".docx").otherwise(".JPEG")
        name = F.concat("url", F.lit("/x"), end)
        return t.table(spark, sf, "pages").select(
            "page_id", text.document_type(name).alias("kind"), text.document_type_label(name).alias("label"),
            text.image_mime(name).alias("media"),
        )

    @reg.add(
        "score_sigmoid",
        """SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(l_quantity - 25) / 10)), 9) AS score FROM lineitem""",
    )
    def score_sigmoid(spark, sf):
        x = (F.col("l_quantity") - 25) / 10
        return t.table(spark, sf, "lineitem").select(
            "l_orderkey", "l_linenumber", F.round(text.sigmoid(x), 9).alias("score")
        )

    @reg.add("context_tail", "SELECT doc_id, md5(right(text, 1200)) AS digest FROM documents")
    def context_tail(spark, sf):
        return t.table(spark, sf, "documents").select("doc_id", F.md5(text.tail("text")).alias("digest"))

    @reg.add(
        "joined_references",
        "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || '; ' || c_mktsegment ELSE c_name END AS refs FROM customer",
    )
    def joined_references(spark, sf):
        refs = F.array(
            F.concat(F.lit(" "), "c_name"), F.lit(""), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")),
            F.concat("c_name", F.lit("　")),
        )
        return t.table(spark, sf, "customer").select("c_custkey", text.join_references(refs).alias("refs"))

    @reg.add(
        "bare_formulas",
        "SELECT p_partkey, p_name AS latex FROM part",
    )
    def bare_formulas(spark, sf):
        k = F.col("p_partkey") % 5
        raw = (
            F.when(k == 0, F.concat(F.lit(" $$"), "p_name", F.lit(" $$ ")))
            .when(k == 1, F.concat(F.lit("\\[ "), "p_name", F.lit("\\]")))
            .when(k == 2, F.concat(F.lit("\\("), "p_name", F.lit("\\)")))
            .when(k == 3, F.concat(F.lit("$"), "p_name", F.lit("$")))
            .otherwise(F.col("p_name"))
        )
        return t.table(spark, sf, "part").select("p_partkey", markup.bare_latex(raw).alias("latex"))

    @reg.add(
        "bbox_union",
        """SELECT o_orderkey, printf('%.2f,1.00,%.2f,%.2f', least(o_custkey, 500)::DOUBLE, greatest(o_custkey, 500)::DOUBLE + 10, greatest(o_orderkey % 100 + 20, 3)::DOUBLE) AS bbox
        FROM orders""",
    )
    def bbox_union(spark, sf):
        def box(*v):
            return F.array(*[c.cast("double") for c in v])

        k, n = F.col("o_custkey"), F.col("o_orderkey") % 100
        boxes = F.array(
            box(k, F.lit(1), k + 10, n + 20), box(F.lit(500), F.lit(2), F.lit(510), F.lit(3)), F.array(F.lit(1.0))
        )
        return t.table(spark, sf, "orders").select("o_orderkey", markup.bbox_text(boxes).alias("bbox"))

    @reg.add(
        "tool_argument_bounds",
        """SELECT event_id, CAST(greatest(1, least(floor(value)::BIGINT, 10000)) AS INTEGER) AS page,
          CAST(greatest(1, least(user_id, 20)) AS INTEGER) AS top_k, event_type AS query FROM events""",
    )
    def tool_argument_bounds(spark, sf):
        e = t.table(spark, sf, "events")
        raw = F.to_json(
            F.struct(
                F.concat(F.lit("  "), "event_type", F.lit(" ")).alias("query"),
                F.floor("value").cast("int").alias("page"), F.col("user_id").cast("int").alias("top_k"),
            )
        )
        return e.select("event_id", tasks.tool_arguments(raw).alias("a")).select("event_id", "a.page", "a.top_k", "a.query")

    @reg.add(
        "draft_parsing",
        """SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE p_name END AS stem FROM part""",
    )
    def draft_parsing(spark, sf):
        k = F.col("p_partkey") % 3
        item = F.to_json(
            F.array(
                F.struct(F.col("p_name").alias("stem"), F.lit("a").alias("answer"), F.array().cast("array<string>").alias("options"))
            )
        )
        raw = (
            F.when(k == 0, F.concat(F.lit("```json\n"), item, F.lit("\n```")))
            .when(k == 1, F.concat(F.lit("Here [see] it: {\"questions\": "), item, F.lit("} done")))
            .otherwise(F.lit("[] nothing {"))
        )
        parsed = tasks.parsed_questions(raw, F.lit("short_answer"), F.lit(1))
        # Parsing takes far longer than reading: few files must not mean few tasks.
        part = t.table(spark, sf, "part").select("p_partkey", "p_name")
        return part.repartition(4 * spark.sparkContext.defaultParallelism).select("p_partkey", F.get(parsed, F.lit(0))["stem"].alias("stem"))

    # --- study steps --------------------------------------------------------------

    @reg.add(
        "next_study_tool",
        """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'replan_study_goal' WHEN event_id % 5 = 1 THEN 'assess_study_progress'
          WHEN event_id % 5 = 2 THEN 'save_study_questions' WHEN event_id % 5 = 3 THEN 'execute_study_step' ELSE 'finish_study_goal' END AS tool FROM events""",
    )
    def next_study_tool(spark, sf):
        k = F.col("event_id") % 5
        quizzes = F.array(
            F.struct(
                F.lit(True).alias("submitted"), (k != 1).alias("assessed"), F.lit(True).alias("save_requested"), (k != 2).alias("saved")
            )
        )
        plan = F.array(F.struct(F.when(k == 4, "done").otherwise("pending").alias("status")))
        return t.table(spark, sf, "events").select("event_id", study.next_tool(k == 0, quizzes, plan).alias("tool"))

    @reg.add(
        "plan_checks",
        """SELECT event_id, CASE WHEN event_id % 4 = 1 THEN 'unknown_action' WHEN event_id % 4 = 2 THEN 'focus_length'
          WHEN event_id % 4 = 3 THEN 'needs_explain_and_test' END AS issue FROM events""",
    )
    def plan_checks(spark, sf):
        k = F.col("event_id") % 4

        def step(action, focus):
            return F.struct(action.alias("action"), focus.alias("focus"))

        steps = F.array(
            step(F.when(k == 1, "dance").otherwise("explain"), F.when(k == 2, " ").otherwise(F.col("event_type"))),
            step(F.when(k == 3, "explain").otherwise("self_test"), F.col("event_type")),
        )
        return t.table(spark, sf, "events").select("event_id", study.plan_issue(steps, F.lit(0)).alias("issue"))

    @reg.add(
        "followup_steps",
        """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a,b' WHEN 1 THEN 'a,feedback_q_review,b' ELSE 'a,feedback_q_review,feedback_q_test,b' END AS steps,
          CASE WHEN event_id % 3 = 0 AND event_type = 'error' THEN 'wrong_items_need_review' END AS issue FROM events""",
    )
    def followup_steps(spark, sf):
        k = F.col("event_id") % 3
        action = F.when(k == 0, "continue").when(k == 1, "review").otherwise("retest")

        def step(name, status):
            return F.struct(
                F.lit(name).alias("id"), F.lit("self_test").alias("action"), F.col("event_type").alias("focus"),
                F.lit("r").alias("reason"), F.lit(status).alias("status"),
            )

        plan = F.array(step("a", "done"), step("b", "pending"))
        results = F.array(F.struct((F.col("event_type") != "error").alias("correct")))
        after = study.insert_followups(plan, F.lit("q"), action, F.col("event_type"), F.lit("w"))
        return t.table(spark, sf, "events").select(
            "event_id", F.array_join(F.transform(after, lambda s: s["id"]), ",").alias("steps"),
            study.feedback_issue(action, results, plan, F.lit(0)).alias("issue"),
        )
