"""Exact cosine search over stored embeddings.

Few questions are broadcast and scored in the JVM.  For many, vectors and questions of a
key are dealt to blocks of bounded size, and a matrix product of two blocks finds what can
be among the best; those are scored in the JVM's order of additions, so the scores are the
same to the last bit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.operators.evidence import is_applicable
from citeloom.operators.joins import first_rows, join_small


#: Questions that are broadcast; more are scored by blocks of at most, on average, so
#: many vectors and questions.
FEW_QUERIES, BLOCK, ASKED = 100, 8192, 1024
#: Matrix products add in another order.
SLACK = 1e-6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def norm(a: Column) -> Column:
    return F.sqrt(
        F.aggregate(
            a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")
        )
    )


def cosine_score(a: Column, b: Column, norm_b: Column | None = None) -> Column:
    """Cosine similarity floored at zero; a zero vector scores zero."""
    size = norm(a) * (norm(b) if norm_b is None else norm_b)
    return F.greatest(F.lit(0.0), F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0)))


def embedding_dim(chunks: DataFrame) -> DataFrame:
    """Dimension of a stored vector; no row when the table is empty."""
    return chunks.select(F.size("embedding").alias("dim")).limit(1)


def _dense(column: pa.ChunkedArray, d: int) -> np.ndarray:
    """Vectors as rows; one of another length or with a null entry, which scores zero, as
    a zero vector."""
    out = np.zeros((len(column), d))
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not d or not len(array):
        return out
    fits = pa.compute.equal(pa.compute.list_value_length(array), d).fill_null(False).to_numpy(zero_copy_only=False)
    flat = array.filter(pa.array(fits)).flatten()
    known = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, d).all(axis=1)
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d)
    out[np.flatnonzero(fits)[known]] = values[known]
    return out


def _sizes(x: np.ndarray) -> np.ndarray:
    """Norms, added from the first entry to the last as in the JVM."""
    return np.sqrt(np.add.accumulate(x * x, axis=1)[:, -1]) if x.shape[1] else np.zeros(len(x))


def best_rows(x: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Question, row and score of the ``k`` best rows of each question; ties by row."""
    size_x, size_q = _sizes(x), _sizes(q)
    # Copies have one score: a class is compared once, its first k members can be hits.
    _, first, own = np.unique(x, axis=0, return_index=True, return_inverse=True)
    own = own.ravel()
    order = np.argsort(own, kind="stable")
    begin = np.searchsorted(own[order], np.arange(len(first)))
    many = np.minimum(np.diff(np.append(begin, len(x))), k)
    rank = np.argsort(np.argsort(first))
    with np.errstate(all="ignore"):
        unit = np.where(size_x[first, None] == 0, 0.0, x[first] / size_x[first, None])
        asked = np.where(size_q[:, None] == 0, 0.0, q / size_q[:, None])
        near = asked @ unit.T
    near[np.isnan(near)] = np.inf
    least = np.partition(near, len(first) - k, axis=1)[:, len(first) - k] if len(first) > k else np.full(len(q), -np.inf)
    hit = near >= np.maximum(least, 0.0)[:, None] - SLACK
    # All scores below zero count as zero, so the first rows come first.
    low = np.flatnonzero(least <= SLACK)
    if len(low):
        below = ~hit[low]
        place = np.where(below, rank[None, :], len(first))
        cut = np.sort(place, axis=1)[:, min(k, len(first)) - 1]
        hit[low] |= below & (place <= cut[:, None])
    ask, of = np.nonzero(hit)
    n = many[of]
    ask, start = np.repeat(ask, n), np.repeat(begin[of], n)
    row = order[start + np.arange(len(start)) - np.repeat(np.cumsum(n) - n, n)]
    score = np.zeros(len(row))
    with np.errstate(all="ignore"):
        for at in range(0, len(row), 1 << 16):
            a, b = row[at : at + (1 << 16)], ask[at : at + (1 << 16)]
            size = size_x[a] * size_q[b]
            if x.shape[1]:
                dots = np.add.accumulate(x[a] * q[b], axis=1)[:, -1]
                score[at : at + len(a)] = np.maximum(0.0, np.where((size > 0) | np.isnan(size), dots / size, 0.0))
    by = np.lexsort([row, -np.where(np.isnan(score), np.inf, score), ask])
    ask, row, score = ask[by], row[by], score[by]
    place = np.arange(len(ask)) - np.searchsorted(ask, ask)
    return ask[place < k], row[place < k], score[place < k]


def nearest(side: DataFrame, queries: DataFrame, keys: list[str], k: int, block: int = BLOCK, asked: int = ASKED) -> DataFrame:
    """``query_id, course_id, doc_id, chunk_index, score``: among them the best ``k`` of
    each question's keys.  ``side``: keys, doc_id, chunk_index, embedding; ``queries``:
    keys, query_id, query_vec."""
    sizes = side.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("_is"))
    sizes = sizes.join(queries.groupBy(*keys).agg(F.ceil(F.count("*") / asked).cast("int").alias("_js")), keys)

    def dealt(rows: DataFrame, own: str, other: str, *ids: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(*ids), F.col(f"{own}s")).cast("int").alias(own)
        meets = F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)).alias(other)
        # Names of each side's own: both may come from one table.
        made = rows.join(sizes, keys).select(*rows.columns, mine, meets)
        made = made.toDF(*[f"{own}{c}" if c in (*keys, "_i", "_j") else c for c in made.columns])
        return made.groupBy(*[f"{own}{c}" for c in (*keys, "_i", "_j")])

    course = keys.index("course_id")

    def score(key: tuple, stored: pa.Table, wanted: pa.Table) -> pa.Table:
        stored = stored.sort_by([("doc_id", "ascending"), ("chunk_index", "ascending")])
        vectors, found = wanted.column("query_vec").combine_chunks(), []
        lengths = pa.compute.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False)
        for d in np.unique(lengths) if stored.num_rows else ():
            own = np.flatnonzero(lengths == d)
            ask, row, value = best_rows(_dense(stored.column("embedding"), d), _dense(vectors.take(pa.array(own)), d), k)
            found.append((own[ask], row, value))
        ask, row, value = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in range(3))
        return pa.table(
            {
                "query_id": wanted.column("query_id").take(pa.array(ask.astype(np.int64))),
                "course_id": pa.array([key[course].as_py()] * len(ask), stored.schema.field("_icourse_id").type),
                **{c: stored.column(c).take(pa.array(row.astype(np.int64))) for c in ("doc_id", "chunk_index")},
                "score": pa.array(value.astype(np.float64)),
            }
        )

    one = dealt(side.select(*keys, "doc_id", "chunk_index", "embedding"), "_i", "_j", "doc_id", "chunk_index")
    two = dealt(queries.select(*keys, "query_id", "query_vec"), "_j", "_i", "query_id")
    schema = T.StructType(
        [queries.schema["query_id"], *(side.schema[c] for c in ("course_id", "doc_id", "chunk_index")), T.StructField("score", T.DoubleType())]
    )
    return one.cogroup(two).applyInArrow(score, schema)


def vector_topk(
    chunks: DataFrame,
    queries: DataFrame,
    k: int,
    rows: int | None = None,
    *,
    block_type: str | None = None,
) -> DataFrame:
    """Best ``k`` chunks per query by cosine, filters applied before the cut.

    ``queries``: query_id, course_id, query_vec and optionally scenario, as_of.
    The join key is the course, so a query only meets chunks of its own course.
    """
    scope = [c for c in ("scenario", "as_of") if c in queries.columns]
    meta = ("applicability_scope", "effective_from", "effective_to") if scope else ()
    side = chunks if block_type is None else chunks.filter(F.col("block_type") == block_type)
    side = side.filter(F.col("embedding").isNotNull()).select(
        "course_id", "doc_id", "chunk_index", "embedding", *meta
    )
    q = queries.select(
        "query_id", "course_id", "query_vec", norm(F.col("query_vec")).alias("q_norm"), *scope
    )
    if not scope and (rows is None or rows > FEW_QUERIES):
        return _ranked(nearest(side, q, ["course_id"], k), k)
    pairs = join_small(side, q, "course_id", rows=rows)
    if scope:
        pairs = pairs.filter(
            is_applicable(
                F.col("scenario") if "scenario" in scope else F.lit(None).cast("string"),
                F.col("as_of") if "as_of" in scope else F.lit(None).cast("string"),
            )
        )
    scored = pairs.select(
        "query_id",
        "course_id",
        "doc_id",
        "chunk_index",
        cosine_score(F.col("embedding"), F.col("query_vec"), F.col("q_norm")).alias("score"),
    )
    return _ranked(scored, k)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    top = first_rows(
        scored,
        ["query_id"],
        [F.desc("score"), F.asc("doc_id"), F.asc("chunk_index")],
        k,
        rank="rank",
    )
    # Drop the last bits of the dot product, so that an exact match scores 1.0
    # and later comparisons with lexical scores see a tie as a tie.
    return top.withColumn("score", F.round("score", 9))
