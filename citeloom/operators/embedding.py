"""Embedding columns: an injected model, or hashed tokens where there is none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.text import as_col, let, tokenize


def model_embedding(
    text: Column | str, load: Callable[[], Callable[[list[str]], list[list[float]]]]
) -> Column:
    """Vectors of a model; ``load`` runs once per Python worker.

    The model must return one vector per text.
    """

    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            vectors = list(model(texts.fillna("").tolist()))
            if len(vectors) != len(texts):
                raise ValueError(f"vectors={len(vectors)} texts={len(texts)}")
            yield pd.Series([[float(x) for x in v] for v in vectors])

    # Annotations are strings in this module; the wrapper needs the types.
    embed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(embed, "array<float>")(as_col(text))


def hash_embedding(text: Column | str, dim: int = 32) -> Column:
    """Unit vector of hashed token counts; all zero for a text without tokens.

    Token buckets are sorted once, so the cost is one lookup per dimension.
    """
    buckets = F.transform(tokenize(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int"))

    def counts(b: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)),
            lambda i: F.size(F.filter(b, lambda x: x == i)).cast("double"),
        )

    def unit(v: Column) -> Column:
        size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return let(size, lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0).cast("float")))

    return let(let(buckets, counts), unit)


def encodable(text: Column | str, vocabulary: Column) -> Column:
    """Whether any token of the text is known to the model."""
    return F.arrays_overlap(tokenize(text), vocabulary)
