"""Text vectors trained here: a truncated decomposition of the weighted term table.

A row of the table is a text, a column a term, an entry the term's idf divided by the
row's length.  The leading right singular vectors are found by randomised subspace
iteration: a random block of columns is multiplied by the table and its transpose, in
tasks that each hold one block of vocabulary by dimension, and orthonormalised.  The
vocabulary is bounded by a parameter, so the block is, whatever the number of texts;
texts themselves never leave their tasks.

A text's vector is its row times the singular vectors, at unit length.  A text without a
known term has no vector (``encodable`` tells), so the vector branch skips it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions.text import as_col, tokenize
from citeloom.operators.joins import unnest
from citeloom.session import materialize, release

#: Terms of the model, the most frequent ones; each is in two texts at least.
VOCABULARY, LEAST = 20_000, 2
DIM, EXTRA, ROUNDS, SEED = 32, 10, 4, 3


@dataclass
class Model:
    """Place and idf of each term, and the singular vectors, one row a term."""

    terms: dict[str, int]
    idf: np.ndarray
    vectors: np.ndarray
    values: np.ndarray


def vocabulary(texts: DataFrame, text: str = "text", size: int = VOCABULARY) -> tuple[dict[str, int], np.ndarray]:
    """The terms in most texts, ties by name, and their idf."""
    n = texts.count()
    counted = unnest(texts, tokenize(text), "token").groupBy("token").agg(F.count("*").alias("df"))
    top = counted.filter(F.col("df") >= LEAST).orderBy(F.desc("df"), "token").limit(size).toArrow()
    terms = {w: i for i, w in enumerate(top.column("token").to_pylist())}
    return terms, np.log((n + 1) / (top.column("df").to_numpy() + 0.5))


def _places(tokens: pa.Array, terms: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Text and term of the weighted table's entries, texts in order."""
    row, term = [], []
    for i, own in enumerate(tokens.to_pylist()):
        known = [terms[t] for t in own or () if t in terms]
        term += known
        row += [i] * len(known)
    return np.array(row, np.int64), np.array(term, np.int64)


def _entries(row: np.ndarray, term: np.ndarray, idf: np.ndarray) -> np.ndarray:
    value = idf[term] if len(term) else np.zeros(0)
    return value / np.sqrt(np.bincount(row, value * value))[row] if len(row) else value


def _summed(rows: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of each key; keys are in order."""
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    return key[starts], np.add.reduceat(rows, starts) if len(starts) else rows


def _coded(held) -> Callable:
    """Places of each text's known terms, looked up once for all rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, term = _places(batch.column("tokens"), held.value)
            offsets = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(offsets), pa.array(term.astype(np.int32)))], names=["terms"]
            )

    return run


def _products(held) -> Callable:
    """One task's part of the table's transpose times the table times the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, block = held.value
        total = np.zeros_like(block)
        for batch in batches:
            own = batch.column("terms")
            many = pa.compute.list_value_length(own).to_numpy(zero_copy_only=False)
            row, term = np.repeat(np.arange(len(many)), many), own.flatten().to_numpy().astype(np.int64)
            value = _entries(row, term, idf)
            for at in range(0, len(row), 1 << 15):
                # Cut between texts.
                a = np.searchsorted(row, row[at]) if at else 0
                b = np.searchsorted(row, row[at + (1 << 15)]) if at + (1 << 15) < len(row) else len(row)
                if a >= b:
                    continue
                r, t, v = row[a:b] - row[a], term[a:b], value[a:b, None]
                texts, found = _summed(v * block[t], r)
                image = np.zeros((int(r[-1]) + 1, block.shape[1]))
                image[texts] = found
                order = np.argsort(t, kind="stable")
                used, found = _summed((v * image[r])[order], t[order])
                total[used] += found
        used = np.flatnonzero(total.any(axis=1))
        for at in range(0, len(used), 4096):
            part = used[at : at + 4096]
            flat = pa.array(total[part].ravel())
            offsets = pa.array(np.arange(0, len(part) * block.shape[1] + 1, block.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.ListArray.from_arrays(offsets, flat)], names=["term", "v"])

    return run


def fit(texts: DataFrame, text: str = "text", dim: int = DIM, size: int = VOCABULARY, rounds: int = ROUNDS) -> Model:
    """Model of all texts; fewer dimensions if there are fewer terms."""
    terms, idf = vocabulary(texts, text, size)
    wide = min(dim + EXTRA, len(terms))
    if not wide:
        return Model({}, idf, np.zeros((0, dim)), np.zeros(dim))
    known = texts.sparkSession.sparkContext.broadcast(terms)
    coded = texts.select(tokenize(text).alias("tokens")).mapInArrow(_coded(known), "terms array<int>")
    coded = materialize(coded, "latent-terms")
    known.unpersist()
    block = np.linalg.qr(np.random.default_rng(SEED).normal(size=(len(terms), wide)))[0]
    for last in [False] * rounds + [True]:
        held = texts.sparkSession.sparkContext.broadcast((idf, block))
        parts = coded.mapInArrow(_products(held), "term long, v array<double>")
        summed = parts.groupBy("term").agg(Summarizer.sum(array_to_vector("v")).alias("v"))
        # One row a term of the bounded vocabulary.
        found = summed.select("term", vector_to_array("v").alias("v")).toArrow()
        image = np.zeros_like(block)
        image[found.column("term").to_numpy()] = found.column("v").combine_chunks().flatten().to_numpy().reshape(-1, wide)
        held.unpersist()
        if last:
            values, turn = np.linalg.eigh(block.T @ image)
            keep = np.argsort(-values, kind="stable")[:dim]
            vectors = block @ turn[:, keep]
            signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(keep))])
            release(coded)
            return Model(terms, idf, vectors * signs, np.sqrt(np.maximum(values[keep], 0)))
        block = np.linalg.qr(image)[0]
    raise AssertionError


def with_embedding(texts: DataFrame, model: Model, text: str = "text", name: str = "embedding") -> DataFrame:
    """``texts`` with a column of unit vectors, null where no term is known.

    The model travels to the tasks once; texts go through them in Arrow batches.
    """
    if name in texts.columns or "_tokens" in texts.columns:
        raise ValueError(f"columns {name} and _tokens must be free")
    held, columns = texts.sparkSession.sparkContext.broadcast(model), texts.columns

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = held.value
        for batch in batches:
            row, term = _places(batch.column("_tokens"), made.terms)
            value = _entries(row, term, made.idf)
            x = np.zeros((batch.num_rows, made.vectors.shape[1]))
            texts, found = _summed(value[:, None] * made.vectors[term], row)
            x[texts] = found
            size = np.linalg.norm(x, axis=1)
            known = size > 0
            unit = (x[known] / size[known, None]).astype(np.float32)
            offsets = np.concatenate([[0], np.cumsum(np.where(known, x.shape[1], 0))])
            vectors = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(unit.ravel()), mask=pa.array(~known))
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, vectors], names=[*columns, name])

    schema = T.StructType([*texts.schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))])
    return texts.withColumn("_tokens", tokenize(text)).mapInArrow(embed, schema)


def encodable(name: Column | str = "embedding") -> Column:
    """Whether a text has a term the model knows."""
    return as_col(name).isNotNull()
