"""Chapter and document-type roll-ups of a course corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.text import document_type, document_type_label, strip
from citeloom.operators.evidence import is_applicable, or_default

# Fixed value: generated chapter names that only restate the page number.
PAGE_PLACEHOLDER = r"(?U)^第\s*\d+\s*页$"


def chapter_list(chunks: DataFrame) -> DataFrame:
    """Distinct non-empty chapters per course."""
    return (
        chunks.filter(F.coalesce(F.col("chapter"), F.lit("")) != "")
        .select("course_id", "chapter")
        .distinct()
    )


def _named(chunks: DataFrame) -> DataFrame:
    named = chunks.withColumn("chapter", strip(F.coalesce(F.col("chapter"), F.lit(""))))
    return named.filter((F.col("chapter") != "") & ~F.col("chapter").rlike(PAGE_PLACEHOLDER))


def chapter_rollup(chunks: DataFrame) -> DataFrame:
    """Chunk and source-file counts per named chapter."""
    files = (
        _named(chunks)
        .groupBy("course_id", "chapter", or_default("source_file", "未知").alias("source_file"))
        .agg(F.count("*").alias("chunks"))
    )
    return files.groupBy("course_id", "chapter").agg(
        F.sum("chunks").alias("chunk_count"), F.count("*").alias("source_count")
    )


def chapter_sources(chunks: DataFrame) -> DataFrame:
    """One row per chapter and source file (kept long: a chapter is unbounded)."""
    return (
        _named(chunks)
        .groupBy("course_id", "chapter", or_default("source_file", "未知").alias("source_file"))
        .agg(F.count("*").alias("chunk_count"))
    )


def type_rollup(docs: DataFrame, filename: str = "filename") -> DataFrame:
    """Documents and chunks per type group; unknown extensions are ``other``."""
    return (
        docs.withColumn("type", document_type(filename))
        .withColumn("label", document_type_label(filename))
        .groupBy("course_id", "type", "label")
        .agg(
            F.count("*").alias("document_count"),
            F.sum(F.coalesce(F.col("chunk_count"), F.lit(0))).alias("chunk_count"),
        )
    )


def typed_documents(docs: DataFrame, filename: str = "filename") -> DataFrame:
    """Documents with their type group, the row form of the nested listing."""
    return docs.withColumn("type", document_type(filename)).withColumn(
        "label", document_type_label(filename)
    )


def document_summary(docs: DataFrame) -> DataFrame:
    """Totals per course over active documents."""
    return (
        docs.filter("is_active")
        .groupBy("course_id")
        .agg(
            F.count("*").alias("document_count"),
            F.sum(F.coalesce(F.col("chunk_count"), F.lit(0))).alias("chunk_count"),
            F.count_if(F.col("status") == "failed").alias("failed_count"),
        )
    )


def match_chapters(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """Chunks of the chapters a request names.

    Exact chapter names win; only a request without any exact match falls back
    to chapters that contain its text.  The decision is made on the distinct
    chapter names of the course, the chunks then join by equality.
    """
    scope = [c for c in ("scenario", "as_of") if c in requests.columns]
    none = F.lit(None).cast("string")
    fits = is_applicable(
        F.col("scenario") if "scenario" in scope else none,
        F.col("as_of") if "as_of" in scope else none,
    )
    meta = ["applicability_scope", "effective_from", "effective_to"]
    names = chunks.select("course_id", "chapter", *meta).distinct()
    asked = requests.select(
        "query_id", "course_id", F.btrim("chapter").alias("wanted"), *scope
    ).filter("wanted <> ''")
    pairs = (
        names.join(asked, "course_id")
        .filter(fits)
        .withColumn("exact", F.coalesce(F.col("chapter"), F.lit("")) == F.col("wanted"))
        .filter(
            F.col("exact")
            | (
                (F.length("wanted") >= 2)
                & F.contains(F.lower(F.coalesce("chapter", F.lit(""))), F.lower("wanted"))
            )
        )
        .select("query_id", "course_id", "chapter", "exact", *scope)
        .distinct()
    )
    any_exact = F.max("exact").over(Window.partitionBy("query_id"))
    chosen = (
        pairs.withColumn("any_exact", any_exact)
        .filter(F.col("exact") == F.col("any_exact"))
        .withColumnRenamed("exact", "matched_exactly")
        .drop("any_exact")
    )
    return chunks.join(chosen, ["course_id", "chapter"]).filter(fits).drop(*scope)
