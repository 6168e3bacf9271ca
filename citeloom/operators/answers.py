"""Answer side: prompt context, answer finalisation, model calls as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.text import is_blank, strip
from citeloom.operators.evidence import evidence_reason

# Markers and sentences of the answer protocol.
NO_EVIDENCE = "<NO_EVIDENCE>"
SOURCES = "<SOURCES>"
REFUSAL = "资料库中未找到相关内容"
REFUSAL_STARTS = (NO_EVIDENCE, REFUSAL, "资料未包含此内容")
KINDS = {"formula": "公式证据", "image": "图表证据", "image_summary": "图表证据"}


def evidence_block(index: Column) -> Column:
    """One numbered evidence block of a prompt."""
    source = F.regexp_replace(F.coalesce("source_file", F.lit("未知")), r"\.md|\.pdf|\.txt", "")
    text = F.coalesce(F.col("text"), F.lit(""))
    line = F.ltrim(strip(F.substring_index(text, "\n", 1)), F.lit("§ "))
    label = F.when(F.length(line) > 40, F.concat(F.substring(line, 1, 37), F.lit("..."))).otherwise(line)
    kind = F.lit("正文证据")
    for name, title in KINDS.items():
        kind = F.when(F.col("block_type") == name, F.lit(title)).otherwise(kind)
    return F.concat(
        F.lit("【证据编号="), index.cast("string"), F.lit(" · "), source, F.lit(" · "), label,
        F.lit(" · "), kind, F.lit("】\n证据属性："), evidence_reason(), F.lit("\n"), text,
    )


def format_context(hits: DataFrame) -> DataFrame:
    """Prompt context per query; hits are the few kept rows of each query."""
    index = F.row_number().over(Window.partitionBy("query_id").orderBy("position"))
    blocks = hits.withColumn("n", index).withColumn("block", evidence_block(F.col("n")))
    return blocks.groupBy("query_id").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("n", "block"))), lambda b: b["block"]
            ),
            "\n\n",
        ).alias("context"),
        F.count("*").alias("evidence"),
    )


def draft_context(hits: DataFrame, first: int = 12, chars: int = 2400) -> DataFrame:
    """Shorter context for question drafting: first hits, text cut per hit."""
    label = F.concat(
        F.lit("[资料 "), F.col("position").cast("string"), F.lit("（"),
        F.coalesce("source_file", F.lit("未知")), F.lit("，第 "),
        F.coalesce(F.nullif(F.col("page"), F.lit(0)).cast("string"), F.lit("?")), F.lit(" 页）]\n"),
        F.substring(F.coalesce("text", F.lit("")), 1, chars),
    )
    return hits.filter(F.col("position") <= first).groupBy("query_id").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("position", label.alias("t")))),
                lambda b: b["t"],
            ),
            "\n\n",
        ).alias("context")
    )


def finalize_answers(answers: DataFrame) -> DataFrame:
    """Split off the source footer, detect refusals, resolve cited indices.

    ``answers``: query_id, raw, evidence (number of context blocks).  An empty
    answer is an error of the model and is reported in ``error``.
    """
    raw = F.coalesce(F.col("raw"), F.lit(""))
    has_footer = F.contains(raw, F.lit(SOURCES))
    body = F.substring_index(raw, SOURCES, 1)
    answer = F.when(has_footer, F.regexp_replace(body, r"(?U)\s+$", "")).otherwise(raw)
    footer = F.substring(raw, F.length(body) + len(SOURCES) + 1, F.length(raw))
    listed = F.regexp_extract(
        footer, r"^\s*([0-9]{1,6}(?:\s*,\s*[0-9]{1,6})*)\s*</SOURCES>\s*$", 1
    )
    numbers = F.array_distinct(
        F.transform(F.split(listed, ","), lambda v: F.trim(v).cast("int"))
    )
    opening = strip(F.regexp_replace(answer, r"(?U)^[\s#*>`]+", ""))
    refused = F.lit(False)
    for start in REFUSAL_STARTS:
        refused = refused | F.startswith(opening, F.lit(start))
    staged = answers.select(
        "query_id", "evidence", answer.alias("answer"), refused.alias("refused"),
        F.when(has_footer & (listed != ""), numbers).otherwise(F.array().cast("array<int>")).alias("n"),
    )
    valid = (F.size("n") > 0) & F.forall(
        "n", lambda i: (i >= 1) & (i <= F.col("evidence"))
    )
    empty = is_blank("answer")
    return staged.select(
        "query_id",
        F.when(F.col("refused"), F.lit(REFUSAL)).otherwise(F.col("answer")).alias("answer"),
        (~F.col("refused") & ~empty).alias("grounded"),
        F.when(F.col("refused") | empty, F.array().cast("array<int>"))
        .when(valid, F.col("n"))
        .otherwise(
            F.when(F.col("evidence") > 0, F.sequence(F.lit(1), F.col("evidence").cast("int")))
            .otherwise(F.array().cast("array<int>"))
        )
        .alias("cited"),
        F.when(valid, "model_selected").otherwise("retrieval_candidate").alias("evidence_role"),
        F.when(empty, "empty_answer").alias("error"),
    )


def answer(hits: DataFrame, queries: DataFrame, model: Callable[[Column, Column], Column]) -> DataFrame:
    """Context, model call and finalised answer per question.

    ``model`` maps (question, context) columns to the raw answer column; a
    question without hits is refused without a call.
    """
    context = format_context(hits)
    asked = queries.select("query_id", "query_text").join(context, "query_id", "left")
    some = asked.filter("evidence > 0").withColumn("raw", model(F.col("query_text"), F.col("context")))
    none = asked.filter("evidence IS NULL").withColumn("raw", F.lit(NO_EVIDENCE)).fillna({"evidence": 0})
    return finalize_answers(some.select("query_id", "raw", "evidence").unionByName(
        none.select("query_id", "raw", "evidence")
    ))


def echo_model(question: Column, context: Column) -> Column:
    """Deterministic stand-in: quotes the first evidence block."""
    return F.concat(
        F.lit("依据资料："), F.substring_index(context, "\n", 1), F.lit("\n"), F.lit(SOURCES), F.lit("1</SOURCES>")
    )
