"""Second-stage scoring of candidates with an injected model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import sigmoid, tokenize
from citeloom.operators.joins import first_rows

#: (query, text) columns to a raw logit.
Scorer = Callable[[Column, Column], Column]


def overlap_logit(query: Column, text: Column) -> Column:
    """Model-free stand-in: share of query tokens in the text, scaled to logits."""
    q, t = tokenize(query), tokenize(text)
    share = F.size(F.array_intersect(q, t)) / F.greatest(F.size(q), F.lit(1))
    return share * 8 - 4


def model_scorer(load: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Scorer:
    """Wrap a cross-encoder; ``load`` runs once per Python worker.

    The model must return one score per pair.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, texts in batches:
            values = list(model(queries.tolist(), texts.fillna("").tolist()))
            if len(values) != len(texts):
                raise ValueError(f"scores={len(values)} hits={len(texts)}")
            yield pd.Series(values, dtype="float64")

    return score


def rerank(hits: DataFrame, top_n: int, scorer: Scorer = overlap_logit) -> DataFrame:
    """Replace scores by ``sigmoid(logit)`` and keep the best ``top_n`` per query.

    ``hits`` carries query_text; a blank query keeps the incoming order.
    """
    blank = F.btrim("query_text") == ""
    scored = hits.withColumn("rerank_logit", scorer(F.col("query_text"), F.col("text")))
    scored = scored.withColumn(
        "score", F.when(blank, F.col("score")).otherwise(sigmoid("rerank_logit"))
    )
    order = F.when(blank, F.lit(0.0)).otherwise(F.col("score"))
    return (
        first_rows(
            scored.withColumnRenamed("position", "__before"),
            ["query_id"],
            [F.desc(order), F.asc("__before")],
            top_n,
            rank="position",
        )
        .drop("__before")
    )
