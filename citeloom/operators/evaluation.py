"""Retrieval metrics and report comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def relevance_hits(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """Ranked hits with a flag for relevant sources.

    ``ranked``: query_id, source_file, rank; ``relevant``: query_id, source_file.
    """
    rel = relevant.filter(F.coalesce(F.col("source_file"), F.lit("")) != "").distinct()
    return ranked.join(
        rel.withColumn("relevant", F.lit(True)), ["query_id", "source_file"], "left"
    ).withColumn("relevant", F.coalesce("relevant", F.lit(False)))


def query_metrics(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Recall@k over distinct sources and reciprocal rank, one row per query.

    A query without relevant sources scores zero on both.
    """
    rel = relevant.filter(F.coalesce(F.col("source_file"), F.lit("")) != "").distinct()
    sizes = rel.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    # One row per query and source first, so the flags below see distinct ones.
    best = ranked.groupBy("query_id", "source_file").agg(F.min("rank").alias("rank"))
    found = best.join(rel, ["query_id", "source_file"]).groupBy("query_id").agg(
        F.count_if(F.col("rank") <= k).alias("found"), F.min("rank").alias("first_rank")
    )
    return (
        queries.join(sizes, "query_id", "left")
        .join(found, "query_id", "left")
        .withColumns(
            {
                "recall_at_k": F.coalesce(
                    F.col("found") / F.col("n_relevant"), F.lit(0.0)
                ) if k > 0 else F.lit(0.0),
                "mrr": F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)),
            }
        )
        .drop("found", "first_rank", "n_relevant")
    )


def aggregate_metrics(per_query: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Macro averages and query count, overall or per key; zeros when empty."""
    return per_query.groupBy(*(keys or [])).agg(
        F.coalesce(F.avg("recall_at_k"), F.lit(0.0)).alias("recall_at_k"),
        F.coalesce(F.avg("mrr"), F.lit(0.0)).alias("mrr"),
        F.count("*").cast("double").alias("n"),
    )


def course_report(per_query: DataFrame) -> DataFrame:
    """Per course: metrics of answerable queries, empty rate of refusal ones.

    ``per_query`` adds course_id, expect_empty and hits to the query metrics.
    """
    answerable = ~F.col("expect_empty")
    return per_query.groupBy("course_id").agg(
        F.coalesce(F.avg(F.when(answerable, F.col("recall_at_k"))), F.lit(0.0)).alias("recall_at_k"),
        F.coalesce(F.avg(F.when(answerable, F.col("mrr"))), F.lit(0.0)).alias("mrr"),
        F.count_if(answerable).alias("answerable"),
        F.count_if(F.col("expect_empty")).alias("refusal_cases"),
        F.count_if(F.col("expect_empty") & (F.col("hits") == 0)).alias("refused"),
    )


def case_flags(cases: DataFrame) -> DataFrame:
    """Machine flags of answered cases.

    ``cases``: id, expect_refusal, grounded, source, cited_sources.
    """
    flags = F.array_compact(
        F.array(
            F.when(F.col("expect_refusal") & F.col("grounded"), "refusal_mismatch"),
            F.when(~F.col("expect_refusal") & ~F.col("grounded"), "unexpected_refusal"),
            F.when(
                ~F.col("expect_refusal") & ~F.array_contains("cited_sources", F.col("source")),
                "expected_source_missing",
            ),
        )
    )
    return cases.withColumn("flags", flags)


def compare_reports(before: DataFrame, after: DataFrame, same: list[str]) -> DataFrame:
    """Cases of two reports that cannot be compared: missing or asked differently."""
    a = before.select("id", F.struct(*same).alias("a"))
    b = after.select("id", F.struct(*same).alias("b"))
    return a.join(b, "id", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select(
        "id",
        F.when(F.col("a").isNull(), "only_after")
        .when(F.col("b").isNull(), "only_before")
        .otherwise("changed")
        .alias("difference"),
    )


def report_counts(cases: DataFrame) -> DataFrame:
    """Case totals of one report: answerable, source present, citations, flagged."""
    flagged = case_flags(cases)
    answerable = ~F.col("expect_refusal")
    return flagged.agg(
        F.count("*").alias("cases"),
        F.count_if(answerable).alias("answerable"),
        F.count_if(
            answerable & F.array_contains("cited_sources", F.col("source"))
        ).alias("source_present"),
        F.coalesce(F.sum(F.size("cited_sources")), F.lit(0)).alias("citations"),
        F.count_if(F.size("flags") > 0).alias("flagged"),
    )


def misplaced_anchors(cases: DataFrame, sources: DataFrame) -> DataFrame:
    """Cases whose anchor text is not part of their source file."""
    return (
        cases.filter("anchor IS NOT NULL AND source IS NOT NULL")
        .join(sources.withColumnRenamed("file", "source"), "source", "left")
        .filter(~F.coalesce(F.contains("text", "anchor"), F.lit(False)))
        .select("id", "source")
    )
