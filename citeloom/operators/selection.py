"""Ordering and pruning of retrieved candidates (bounded lists per query)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.queries import defines_topic
from citeloom.functions.text import passage_key
from citeloom.operators.evidence import authority_order
from citeloom.operators.fusion import renumber
from citeloom.operators.joins import first_rows

SCORE_THRESHOLD = 0.25


def above_threshold(hits: DataFrame, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """Inclusive score threshold; NULL counts as zero."""
    return hits.filter(F.coalesce(F.col("score"), F.lit(0.0)) >= threshold)


def select_evidence(hits: DataFrame, when: Column | None = None) -> DataFrame:
    """Authority order; previous position breaks ties.

    ``when`` limits the re-ordering to the queries it holds for.
    """
    if when is None:
        return renumber(hits, [*authority_order(), F.asc("position")])
    level, start, score = (
        F.when(when, F.coalesce(F.col("authority_level"), F.lit(0))),
        F.when(when, F.coalesce(F.nullif(F.col("effective_from"), F.lit("")), F.lit("0001-01-01"))),
        F.when(when, F.coalesce(F.col("score"), F.lit(0.0))),
    )
    return renumber(
        hits, [F.desc(level), F.desc(start), F.desc(score), F.asc("position")]
    )


def definition_first(hits: DataFrame, topic: Column | str = "topic") -> DataFrame:
    """Promote passages that define the query's topic, keeping order otherwise."""
    topic = F.col(topic) if isinstance(topic, str) else topic
    hit = F.when(topic.isNull() | (topic == ""), F.lit(False)).otherwise(
        defines_topic("text", topic)
    )
    return renumber(hits, [F.desc(hit), F.asc("position")])


def distinct_passages(hits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """First hit per collapsed text in each query; blank texts count by id."""
    ident = F.concat_ws("_", F.col("doc_id"), F.col("chunk_index"))
    keyed = hits.withColumn("__passage", passage_key("text", ident))
    kept = first_rows(keyed, [*(keys or ["query_id"]), "__passage"], [F.asc("position")], 1)
    return kept.drop("__passage")


def first_k(hits: DataFrame, k: int) -> DataFrame:
    """Cut each query to ``k`` rows by position and close the gaps."""
    return renumber(hits, [F.asc("position")]).filter(F.col("position") <= k)


def grade(hits: DataFrame, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """Best score per query and the resulting branch of the answer loop."""
    return (
        hits.groupBy("query_id")
        .agg(F.max("score").alias("best_score"), F.count("*").alias("hits"))
        .withColumn(
            "decision",
            F.when(F.col("best_score") >= threshold, F.lit("generate")).otherwise(F.lit("rewrite")),
        )
    )


def refusals(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Per query: number of kept hits and whether it must be refused."""
    counted = hits.groupBy("query_id").agg(F.count("*").alias("kept"))
    return (
        queries.select("query_id")
        .join(counted, "query_id", "left")
        .select(
            "query_id",
            F.coalesce("kept", F.lit(0)).alias("kept"),
            F.col("kept").isNull().alias("refused"),
        )
    )

