"""Reciprocal-rank fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.joins import first_rows

RRF_K = 60
HIT_KEY = ["course_id", "doc_id", "chunk_index"]


def rrf_fuse(lists: list[DataFrame], top_k: int, k: int = RRF_K) -> DataFrame:
    """Fuse ranked lists (query_id, hit key, score, rank) into one order.

    Only the order comes from the reciprocal ranks; each row keeps the larger
    of its raw scores, which is what the score threshold later applies to.
    Ties keep the order in which rows were first seen, list by list.
    Output adds ``rrf`` and ``position`` (1-based).
    """
    tagged = [
        df.select("query_id", *HIT_KEY, "score", "rank", F.lit(i).alias("list_no"))
        for i, df in enumerate(lists)
    ]
    merged = reduce(DataFrame.unionByName, tagged)
    # Integer-weighted parts would not help here: at most one row per list and
    # hit, added in list order by the sort-free two-row aggregate below.
    fused = merged.groupBy("query_id", *HIT_KEY).agg(
        *[
            F.max(F.when(F.col("list_no") == i, 1.0 / (k + F.col("rank")))).alias(f"part_{i}")
            for i in range(len(lists))
        ],
        F.max("score").alias("score"),
        F.min(F.struct("list_no", "rank")).alias("first_seen"),
    )
    rrf = reduce(
        lambda a, b: a + b, [F.coalesce(F.col(f"part_{i}"), F.lit(0.0)) for i in range(len(lists))]
    )
    return first_rows(
        fused.withColumn("rrf", rrf),
        ["query_id"],
        [F.desc("rrf"), F.asc("first_seen")],
        top_k,
        rank="position",
    ).select("query_id", *HIT_KEY, "score", "rrf", "position")


def renumber(df: DataFrame, order, name: str = "position") -> DataFrame:
    """Dense 1-based position per query in the given total order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
