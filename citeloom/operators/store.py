"""Mutations as pure functions: old table and changes in, new table out.

Plain Parquet tables take no UPDATE or MERGE; a new state is written as a new
version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.operators.evidence import OPEN_FROM_SORT, OPEN_TO_SORT, TEXT_DEFAULTS, date_sort_key
from citeloom.operators.joins import first_rows


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key of an append-only change log; deletions drop out."""
    newest = first_rows(log, keys, [F.desc(c) for c in order], 1)
    return newest.filter(~F.col("is_deleted")).drop("is_deleted") if "is_deleted" in log.columns else newest


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def append_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-or-ignore: only unseen keys are added, the first of a batch wins."""
    fresh = new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def patch(old: DataFrame, changes: DataFrame, keys: list[str], *, keep_null: bool = False) -> DataFrame:
    """Overwrite columns from ``changes``; NULL keeps the old value.

    With ``keep_null`` a NULL in the change is written as NULL.
    """
    cols = [c for c in changes.columns if c not in keys and c in old.columns]
    side = changes.select(*keys, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in cols])
    out = old.join(side, keys, "left")
    for c in cols:
        new = F.col(f"__{c}")
        value = F.when(F.col("__hit"), new).otherwise(F.col(c)) if keep_null else F.coalesce(new, F.col(c))
        out = out.withColumn(c, value)
    return out.drop("__hit", *[f"__{c}" for c in cols])


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """Stored form of chunks: id, defaults, page marker, sortable dates.

    Fails on a missing course and on an embedding whose length differs from the
    declared ``dim`` column.
    """
    out = chunks
    for name, default in TEXT_DEFAULTS.items():
        value = F.col(name) if name in out.columns else F.lit(None).cast("string")
        out = out.withColumn(name, F.coalesce(F.nullif(value, F.lit("")), F.lit(default)))
    checks = F.assert_true(
        F.coalesce(F.btrim("course_id"), F.lit("")) != "", F.lit("course_id is required")
    )
    out = out.withColumn("course_id", F.coalesce(checks.cast("string"), F.col("course_id")))
    if {"embedding", "dim"} <= set(out.columns):
        ragged = F.assert_true(F.size("embedding") == F.col("dim"), F.lit("ragged embedding"))
        out = out.withColumn(
            "embedding", F.when(ragged.isNull(), F.col("embedding"))
        )
    return out.withColumns(
        {
            "id": F.concat_ws("_", F.col("doc_id"), F.col("chunk_index")),
            "page": F.coalesce("page", F.lit(-1)),
            "is_active": F.coalesce("is_active", F.lit(True)) if "is_active" in out.columns else F.lit(True),
            "effective_from_sort": date_sort_key("effective_from", OPEN_FROM_SORT),
            "effective_to_sort": date_sort_key("effective_to", OPEN_TO_SORT),
        }
    )


def hit_rows(chunks: DataFrame) -> DataFrame:
    """Read form of stored chunks: page marker back to NULL, defaults filled."""
    out = chunks.withColumn("page", F.nullif(F.col("page"), F.lit(-1)))
    return out.withColumn(
        "authority_level", F.coalesce(F.nullif(F.col("authority_level"), F.lit(0)), F.lit(30))
    )


def read_chunks(
    chunks: DataFrame,
    course_id: str,
    *,
    doc_id: int | None = None,
    source_file: str | None = None,
    page: int | None = None,
    block_type: str | None = None,
    scenario: str | None = None,
    as_of: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Filtered read in chunk order; the limit applies after the order."""
    from citeloom.operators.evidence import evidence_filter

    out = evidence_filter(chunks, course_id, block_type=block_type, scenario=scenario, as_of=as_of)
    for name, value in (("doc_id", doc_id), ("source_file", source_file), ("page", page)):
        if value is not None:
            out = out.filter(F.col(name) == value)
    out = out.orderBy("chunk_index", "doc_id")
    return out if limit is None else out.limit(limit)


def set_active(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Visibility of all chunks of the given documents (doc_id, is_active)."""
    return patch(chunks, docs, ["doc_id"])


def set_evidence(chunks: DataFrame, metadata: DataFrame) -> DataFrame:
    """Merge non-NULL evidence attributes per document, renew the sort keys."""
    out = patch(chunks, metadata, ["doc_id"])
    return out.withColumns(
        {
            "effective_from_sort": date_sort_key("effective_from", OPEN_FROM_SORT),
            "effective_to_sort": date_sort_key("effective_to", OPEN_TO_SORT),
        }
    )


def rebind_course(chunks: DataFrame, old: str, new: str) -> DataFrame:
    return chunks.withColumn(
        "course_id", F.when(F.col("course_id") == old, F.lit(new)).otherwise(F.col("course_id"))
    )


def guard_dimension(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows, failing on a vector length other than the stored one.

    A changed dimension must be an explicit rebuild of every course.
    """
    first = stored.select(F.size("embedding")).first()
    if first is None:
        return incoming
    check = F.assert_true(
        F.size("embedding") == first[0], F.lit("embedding dimension differs from the stored one")
    )
    return incoming.withColumn("embedding", F.when(check.isNull(), F.col("embedding")))


def fail_after_rebuild(docs: DataFrame) -> DataFrame:
    """After all vectors were dropped, every finished document must be re-read."""
    done = F.col("status") == "done"
    return docs.withColumns(
        {
            "status": F.when(done, "failed").otherwise(F.col("status")),
            "chunk_count": F.when(done, 0).otherwise(F.col("chunk_count")),
        }
    )


def recover_processing(docs: DataFrame) -> DataFrame:
    return docs.withColumn(
        "status", F.when(F.col("status") == "processing", "failed").otherwise(F.col("status"))
    )


def needs_reindex(known: Column, status: Column, stored: Column, mtime: Column) -> Column:
    """New file, failed document, unknown or older stored modification time."""
    return (
        F.when(~known, True)
        .when(status != "done", status == "failed")
        .when(stored.isNull(), True)
        .otherwise(mtime > stored + 1e-3)
    )


def scan_plan(files: DataFrame, docs: DataFrame, course_id: str, force: bool = False) -> DataFrame:
    """What a directory scan does with each file.

    ``files``: path, mtime (seconds), ``docs``: document rows.  A path that
    belongs to another course is skipped; PDFs go through fingerprinting.
    """
    last = first_rows(
        docs.select("path", "doc_id", "course_id", "status", "file_mtime"), ["path"], [F.desc("doc_id")], 1
    ).withColumn("known", F.lit(True))
    out = files.join(last, "path", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    again = F.lit(force) | needs_reindex(
        F.col("known"), F.col("status"), F.col("file_mtime"), F.col("mtime")
    )
    return out.select(
        "path",
        "mtime",
        "doc_id",
        F.when(F.col("known") & (F.col("course_id") != course_id), "skip_other_course")
        .when(F.lower("path").endswith(".pdf"), "fingerprint")
        .when(again, "ingest")
        .otherwise("unchanged")
        .alias("action"),
    )


def newest_by(docs: DataFrame, key: str, course_id: str | None = None, active: bool = True) -> DataFrame:
    """Newest document per path, hash or logical name; blank keys never match."""
    out = docs.filter(F.coalesce(F.col(key), F.lit("")) != "")
    if active:
        out = out.filter("is_active")
    if course_id is not None:
        out = out.filter(F.col("course_id") == course_id)
    return first_rows(out, [key, "course_id"], [F.desc("doc_id")], 1)


def active_by(docs: DataFrame, key: str, course_id: str | None = None) -> DataFrame:
    """All active documents with a value of ``key``; blank values never match."""
    out = docs.filter((F.coalesce(F.col(key), F.lit("")) != "") & F.col("is_active"))
    return out if course_id is None else out.filter(F.col("course_id") == course_id)


def migrate(rows: DataFrame, defaults: dict) -> DataFrame:
    """Add absent columns with their default and fill NULLs of present ones."""
    for name, value in defaults.items():
        have = F.col(name) if name in rows.columns else F.lit(None)
        rows = rows.withColumn(name, F.coalesce(have, F.lit(value)))
    return rows


def orphan_rows(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Foreign-key check: child rows without a parent."""
    return child.join(parent.select(key).distinct(), key, "left_anti")


def require_all(wanted: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """Lookup check: wanted keys that do not resolve; must be empty."""
    return wanted.select(*keys).distinct().join(have.select(*keys), keys, "left_anti")


def snapshot_changes(old: DataFrame, new: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """Keys whose compared columns differ between two snapshots."""
    a = old.select(*key, F.struct(*cols).alias("__a"))
    b = new.select(*key, F.struct(*cols).alias("__b"))
    return (
        a.join(b, key, "full_outer")
        .filter(~F.col("__a").eqNullSafe(F.col("__b")))
        .select(
            *key,
            F.when(F.col("__a").isNull(), "added")
            .when(F.col("__b").isNull(), "removed")
            .otherwise("changed")
            .alias("difference"),
        )
    )


def merge_listing(server: DataFrame, local: DataFrame, key: str = "id") -> DataFrame:
    """Server rows flagged when known locally, unknown ones added, local-only kept."""
    s = server.withColumn("on_server", F.lit(True))
    mine = local.select(key, F.lit(True).alias("on_client"))
    known = s.join(mine, key, "left")
    rest = local.join(server.select(key), key, "left_anti").withColumns(
        {"on_server": F.lit(False), "on_client": F.lit(True)}
    )
    both = known.unionByName(rest, allowMissingColumns=True)
    return both.fillna({"on_client": False}).orderBy(F.desc("updated_at"), F.asc(key))


def save_once(table: DataFrame, ledger: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Idempotent batch insert keyed by (task_id, course_id).

    Returns the new table and ledger; a task already in the ledger adds nothing.
    """
    keys = ["task_id", "course_id"]
    fresh = batch.join(ledger.select(*keys), keys, "left_anti")
    rows = fresh.drop("task_id")
    return (
        table.unionByName(rows, allowMissingColumns=True),
        ledger.select(*keys).unionByName(fresh.select(*keys).distinct()),
    )


def paper_issues(items: DataFrame, questions: DataFrame) -> DataFrame:
    """Checks before a paper is saved: one row per violated rule.

    ``items``: paper_id, course_id, question_id, score, seen_updated_at.
    """
    q = questions.select(
        "question_id", F.col("course_id").alias("q_course"), F.col("updated_at").alias("q_updated")
    )
    joined = items.join(q, "question_id", "left")
    bad = joined.select(
        "paper_id",
        "question_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("q_course").isNull(), "missing_question"),
                    F.when(F.col("q_course") != F.col("course_id"), "other_course"),
                    F.when(F.col("q_updated") != F.col("seen_updated_at"), "changed_since"),
                    F.when(~((F.col("score") > 0) & (F.col("score") <= 100)), "score_range"),
                )
            )
        ).alias("issue"),
    )
    twice = (
        items.groupBy("paper_id", "question_id").count().filter("count > 1")
        .select("paper_id", "question_id", F.lit("duplicate_question").alias("issue"))
    )
    return bad.unionByName(twice)


def number_items(items: DataFrame) -> DataFrame:
    """Positions 1..n from the order of the question list of each paper."""
    return items.select(
        "paper_id", F.posexplode("question_ids").alias("__i", "question_id")
    ).select("paper_id", (F.col("__i") + 1).alias("position"), "question_id")


def deletable(questions: DataFrame, items: DataFrame) -> DataFrame:
    """Questions no paper refers to."""
    return questions.join(items.select("question_id").distinct(), "question_id", "left_anti")


def practice_transition(attempts: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply submissions and self-assessments; the first valid change wins.

    ``changes``: attempt_id, seq, kind (submit or assess), user_answer,
    selected_option, correct, at.  A repeat with equal content is accepted as
    existing, a differing one is a conflict; ``outcome`` reports which.
    """
    first = first_rows(changes, ["attempt_id", "kind"], [F.asc("seq")], 1)
    submit = first.filter("kind = 'submit'").select(
        "attempt_id", F.struct("user_answer", "selected_option", "correct", "at").alias("s")
    )
    assess = first.filter("kind = 'assess'").select(
        "attempt_id", F.col("correct").alias("a"), F.col("seq").alias("a_seq")
    )
    out = attempts.join(submit, "attempt_id", "left").join(assess, "attempt_id", "left")
    started = F.col("status") == "started"
    now_in = started & F.col("s").isNotNull()
    objective = F.col("grading_method") == "objective"
    after = (
        F.when(now_in & objective, "graded").when(now_in, "submitted").otherwise(F.col("status"))
    )
    self_graded = (after == "submitted") & ~objective & F.col("a").isNotNull()
    return out.withColumns(
        {
            "status": F.when(self_graded, "graded").otherwise(after),
            "correct": F.when(self_graded, F.col("a"))
            .when(now_in & objective, F.col("s.correct"))
            .otherwise(F.col("correct")),
            "user_answer": F.when(now_in, F.col("s.user_answer")).otherwise(F.col("user_answer")),
            "selected_option": F.when(now_in, F.col("s.selected_option")).otherwise(
                F.col("selected_option")
            ),
            "submitted_at": F.when(now_in, F.col("s.at")).otherwise(F.col("submitted_at")),
        }
    ).drop("s", "a", "a_seq")


def checkpoint_task(current: DataFrame, update: DataFrame) -> DataFrame:
    """Compare-and-set of task states: replaced or cancelled tasks stay so.

    Both: conv_id, course_id, task_id, status, body.  Output: the stored row
    and ``accepted``.
    """
    u = update.select(
        "conv_id", "course_id", F.col("task_id").alias("u_id"), F.col("status").alias("u_status"),
        F.col("body").alias("u_body"),
    )
    out = current.join(u, ["conv_id", "course_id"], "left")
    ok = (F.col("u_id") == F.col("task_id")) & (F.col("status") != "cancelled")
    ok = F.coalesce(ok, F.lit(False))
    return out.select(
        "conv_id", "course_id", "task_id",
        F.when(ok, F.col("u_status")).otherwise(F.col("status")).alias("status"),
        F.when(ok, F.col("u_body")).otherwise(F.col("body")).alias("body"),
        ok.alias("accepted"),
    )
