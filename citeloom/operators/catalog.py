"""Colleges and courses: small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.operators import store


def list_courses(courses: DataFrame, college_id: str | None = None) -> DataFrame:
    out = courses if college_id is None else courses.filter(F.col("college_id") == college_id)
    return out.orderBy("name", "id")


def missing_courses(rows: DataFrame, courses: DataFrame) -> DataFrame:
    """Course ids that rows refer to and the catalog does not have."""
    known = courses.select(F.col("id").alias("course_id"))
    return rows.select("course_id").distinct().join(known, "course_id", "left_anti")


def seed(table: DataFrame, defaults: DataFrame) -> DataFrame:
    """Insert missing default rows and restore the names of present ones."""
    added = store.append_missing(table, defaults, ["id"])
    names = defaults.select("id", *[c for c in ("name", "college_id") if c in defaults.columns])
    return store.patch(added, names, ["id"])


def migrate_legacy(
    colleges: DataFrame, courses: DataFrame, docs: DataFrame,
    legacy_courses: list[str], legacy_colleges: list[str], target: str,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Re-key documents of legacy courses, drop those and emptied legacy colleges."""
    moved = docs.withColumn(
        "course_id",
        F.when(F.col("course_id").isin(legacy_courses), F.lit(target)).otherwise(F.col("course_id")),
    )
    kept = courses.filter(~F.col("id").isin(legacy_courses))
    used = kept.select(F.col("college_id").alias("id")).distinct().withColumn("used", F.lit(True))
    left = (
        colleges.join(used, "id", "left")
        .filter(F.col("used") | ~F.col("id").isin(legacy_colleges))
        .drop("used")
    )
    return left, kept, moved
