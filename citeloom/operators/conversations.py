"""Conversation history: last messages, turn pairing, latest intent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import intent
from citeloom.operators.joins import first_rows
from citeloom.operators.ordered import carry_last

MAX_HISTORY = 20


def last_messages(messages: DataFrame, limit: int = 200) -> DataFrame:
    """Newest ``limit`` messages per conversation, numbered oldest first."""
    n = max(1, limit)
    newest = first_rows(messages, ["conv_id"], [F.desc("turn")], n)
    from pyspark.sql import Window

    return newest.withColumn(
        "seq", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    )


def history(messages: DataFrame, max_messages: int = MAX_HISTORY) -> DataFrame:
    """Role and content of the newest messages; none for a limit below one."""
    if max_messages <= 0:
        return messages.limit(0).select("conv_id", "role", "text")
    return last_messages(messages, max_messages).select("conv_id", "seq", "role", "text")


def turn_pairs(messages: DataFrame) -> DataFrame:
    """Each answer with the question it answers.

    The nearest earlier message of either side must be a question: a question
    is used once, and an answer without an open question is dropped.
    """
    sides = messages.filter(F.col("role").isin("user", "assistant"))
    paired = carry_last(
        sides, ["conv_id"], "turn", F.struct("role", "turn", "text"), "previous"
    )
    return paired.filter(
        (F.col("role") == "assistant") & (F.col("previous.role") == "user")
    ).select(
        "conv_id",
        F.col("previous.turn").alias("question_turn"),
        F.col("turn").alias("answer_turn"),
        F.col("previous.text").alias("question"),
        F.col("text").alias("answer"),
    )


def message_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.count("*").alias("messages"))


def latest_user_intent(messages: DataFrame) -> DataFrame:
    """Newest stored user intent that is not small talk, per conversation.

    ``intent`` is JSON text.  Reading stops at the first malformed value going
    back, so an intent older than a malformed one does not count.
    """
    schema = "task string, mode string, scenario string, as_of string"
    raw = F.coalesce(F.nullif(F.col("intent"), F.lit("")), F.lit("{}"))
    parsed = (
        messages.filter(F.col("role") == "user")
        .withColumn("ok", F.try_parse_json(raw).isNotNull())
        .withColumn("data", F.from_json(raw, schema))
    )
    candidate = ~F.col("ok") | F.coalesce(F.col("data.task") != "conversation", F.lit(True))
    newest = parsed.filter(candidate).groupBy("conv_id").agg(
        F.max_by(F.struct("ok", "data", "turn"), "turn").alias("hit")
    )
    filled = F.greatest(
        *[F.length(F.coalesce(F.col(f"hit.data.{c}"), F.lit(""))) for c in
          ("task", "mode", "scenario", "as_of")]
    )
    return newest.filter(F.col("hit.ok") & (filled > 0)).select(
        "conv_id", F.col("hit.turn").alias("turn"), "hit.data.*"
    )


def conversation_intents(
    messages: DataFrame, question: Column | str = "text", today: Column | None = None
) -> DataFrame:
    """Resolved intent of every user message, follow-ups inheriting.

    A chain of follow-ups repeats the scope of the message it started from, so
    the inherited value is that of the last message that did not inherit: an
    as-of lookup rather than a row-by-row recursion.
    """
    q = F.col(question) if isinstance(question, str) else question
    users = messages.filter(F.col("role") == "user").withColumn("question", q)
    users = users.withColumn("talk", intent.classify_dialogue("question").isNotNull())
    rule = intent.rule_intent("question", today)
    users = users.withColumn("own", F.coalesce(rule, intent.default_intent()))
    inherits = intent.is_contextual("question") & (
        (F.col("own.layer") == "default")
        | ((F.col("own.task") == "rule_query") & intent.defers_to_context("question"))
    )
    # The first question of a conversation has nothing to inherit from.
    first = users.filter("NOT talk").groupBy("conv_id").agg(F.min("turn").alias("first_turn"))
    users = users.join(first, "conv_id", "left").withColumn(
        "inherits", inherits & (F.col("turn") != F.col("first_turn"))
    )
    anchor = F.when(~F.col("talk") & ~F.col("inherits"), F.col("own"))
    carried = carry_last(users, ["conv_id"], "turn", anchor, "previous")
    resolved = intent.resolve_intent("question", F.col("previous"), today=today)
    return carried.withColumn("intent", resolved).select(
        "conv_id", "turn", "question", "intent.*"
    )


def list_conversations(conversations: DataFrame, course_id: str) -> DataFrame:
    return conversations.filter(F.col("course_id") == course_id).orderBy(
        F.desc("updated_at"), F.desc("conv_id")
    )


def touch(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Update time of a conversation from its newest message."""
    newest = messages.groupBy("conv_id").agg(F.max("created_at").alias("__at"))
    return (
        conversations.join(newest, "conv_id", "left")
        .withColumn("updated_at", F.greatest("updated_at", "__at"))
        .drop("__at")
    )


def delete_cascade(gone: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """Tables without the rows of the deleted conversations."""
    from citeloom.operators.store import delete

    return [delete(table, gone, ["conv_id"]) for table in tables]
