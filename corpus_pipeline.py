"""From raw documents to token files: each stage works on all the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the next stage's documents.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citeloom.llm import decontam, mixing, overlap, quality, tokens
from citeloom.session import materialize


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))
    return docs.filter(quality.score(model, docs) >= quality.ACCEPT)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Documents are linked that share four fifths of their five-word shingles.  Of rows
    that share the id and the text one stays; null ids come last.  Extra columns pass.
    """
    return overlap.kept_rows(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontam.clean(docs, benchmark)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mixture(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files hold, read back from them."""
    return tokens.round_trip(docs)


STAGES = [
    ("quality classifier", classify),
    ("near-duplicates", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("source mixing", mix),
    ("token files", write_tokens),
]

#: Neither the classifier nor fingerprints nor tokens can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
