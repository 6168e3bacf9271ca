"""Vector search by cells: an inverted file over k-means centres, with exact scores.

Centres are fitted on a bounded sample of the stored vectors; every vector is then put
into the cell of its nearest centre, and each cell of a course knows its reach, the
widest angle between its centre and a member.  A vector of a cell at angle t from the
question and of reach r has a cosine of at most cos(max(0, t - r)).

``topk`` scores the nearest cells of a question first.  With ``probes`` it stops there;
otherwise it goes on with every cell whose bound reaches the k-th score found, so that
no hit is lost and the result equals the exact search.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.operators.joins import first_rows, join_small, row_bound
from citeloom.operators.vector import FEW_QUERIES, cosine_score, nearest, norm
from citeloom.session import materialize

#: Vectors the centres are fitted on at most, those with the smallest hashes of ids.
SAMPLE = 100_000
#: Cells at most; a tenth of the sample's root is too few, its root enough.
CELLS = 1024
ROUNDS, SEED = 8, 7
#: Cells of a question that are scored first.
FIRST = 4
SLACK = 1e-6


@dataclass
class Cells:
    """``vectors``: course_id, doc_id, chunk_index, embedding, cell; ``reaches``:
    course_id, cell, reach, n; ``centres`` are unit vectors, one row a cell."""

    vectors: DataFrame
    reaches: DataFrame
    centres: np.ndarray


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d)


def centres(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Unit centres of a sample; as many as the root of its size unless given."""
    n = vectors.count()
    share = F.pmod(F.xxhash64("doc_id", "chunk_index"), F.lit(1 << 30))
    some = vectors.filter(share < int((1 << 30) * min(1.0, 2 * sample / max(1, n)))).orderBy(share, "doc_id", "chunk_index").limit(sample)
    unit = F.transform("embedding", lambda v: v.cast("double") / norm(F.col("embedding")))
    points = materialize(some.filter(norm(F.col("embedding")) > 0).select(array_to_vector(unit).alias("features")), "cells-sample")
    m = points.count()
    if not m:
        return np.zeros((1, 1))
    k = cells or int(min(CELLS, max(1, m**0.5)))
    if k < 2:
        return _unit(np.array([points.first()[0].toArray()]))
    return _unit(np.array(KMeans(k=k, maxIter=ROUNDS, seed=SEED, initSteps=1).fit(points).clusterCenters()))


def build(chunks: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> Cells:
    """Cells of all chunks that have a vector of the commonest length."""
    stored = chunks.filter(F.col("embedding").isNotNull())
    common = stored.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common["d"] if common else 1
    stored = stored.filter(F.size("embedding") == d)
    middle = centres(stored, cells, sample)
    held = chunks.sparkSession.sparkContext.broadcast(middle)

    def place(column: pa.Array) -> pa.Array:
        near = np.clip(_unit(_matrix(column, d)) @ held.value.T, -1, 1)
        cell = near.argmax(axis=1)
        angle = np.arccos(near[np.arange(len(cell)), cell])
        return pa.StructArray.from_arrays([pa.array(cell.astype(np.int32)), pa.array(angle)], ["cell", "angle"])

    placed = stored.withColumn("_place", F.arrow_udf(place, "cell int, angle double")("embedding"))
    keep = [c for c in stored.columns if c not in ("cell", "angle")]
    rows = placed.select(*keep, F.col("_place.cell").alias("cell"), F.col("_place.angle").alias("angle"))
    # A course's cells lie together, so that few row groups are opened for a question.
    rows = materialize(rows.repartition("course_id", "cell").sortWithinPartitions("course_id", "cell"), "cells")
    reaches = rows.groupBy("course_id", "cell").agg(F.max("angle").alias("reach"), F.count("*").alias("n"))
    return Cells(rows, materialize(reaches, "cells-reaches"), middle)


def bounds(index: Cells, queries: DataFrame) -> DataFrame:
    """``query_id, course_id, cell, bound, near`` of the cells of each question's course."""
    held = queries.sparkSession.sparkContext.broadcast(index.centres)
    d = index.centres.shape[1]

    def angles(column: pa.Array) -> pa.Array:
        t = np.arccos(np.clip(_unit(_matrix(column, d)) @ held.value.T, -1, 1))
        flat = pa.array(t.ravel())
        return pa.ListArray.from_arrays(pa.array(np.arange(0, t.size + 1, t.shape[1], dtype=np.int32)), flat)

    fits = queries.filter(F.size("query_vec") == d)
    met = fits.withColumn("angles", F.arrow_udf(angles, "array<double>")("query_vec"))
    rows = met.select("query_id", "course_id", "angles").join(index.reaches, "course_id")
    angle = F.element_at("angles", F.col("cell") + 1)
    return rows.select(
        "query_id", "course_id", "cell", angle.alias("near"),
        F.cos(F.greatest(F.lit(0.0), angle - F.col("reach"))).alias("bound"),
    )


def _scored(index: Cells, queries: DataFrame, probes: DataFrame, rows: int | None, k: int) -> DataFrame:
    """Scores of the probed cells, among them each question's best ``k``."""
    if rows is None or rows > FEW_QUERIES:
        return nearest(index.vectors, probes.join(queries.select("query_id", "query_vec"), "query_id"), ["course_id", "cell"], k)
    q = join_small(probes, queries.select("query_id", "query_vec", norm(F.col("query_vec")).alias("q_norm")), "query_id", rows=rows)
    pairs = join_small(index.vectors, q, ["course_id", "cell"], rows=row_bound(q))
    score = cosine_score(F.col("embedding"), F.col("query_vec"), F.col("q_norm"))
    return pairs.select("query_id", "course_id", "doc_id", "chunk_index", score.alias("score"))


def _order() -> list[Column]:
    return [F.desc("score"), F.asc("doc_id"), F.asc("chunk_index")]


def topk(index: Cells, queries: DataFrame, k: int, probes: int | None = None, first: int = FIRST) -> DataFrame:
    """Best ``k`` chunks per question by cosine; columns as of ``vector.vector_topk``.

    With ``probes`` only that many nearest cells are scored.
    """
    rows = row_bound(queries.select("query_id", "query_vec"))
    found = materialize(bounds(index, queries), "cells-bounds")
    probed = first_rows(found, ["query_id"], [F.asc("near"), F.asc("cell")], probes or first)
    probed = materialize(probed.select("query_id", "course_id", "cell"), "cells-probes")
    scored = _scored(index, queries, probed, rows, k)
    if probes is None:
        scored = materialize(scored, "cells-scored")
        least = first_rows(scored, ["query_id"], _order(), k, rank="rank").filter(F.col("rank") == k)
        least = least.select("query_id", F.col("score").alias("least"))
        # Scores below zero count as zero, so a k-th score of zero excludes no cell.
        reached = F.greatest(F.lit(0.0), F.col("bound")) >= F.coalesce("least", F.lit(0.0)) - SLACK
        more = found.join(least, "query_id", "left").filter(reached).select("query_id", "course_id", "cell")
        more = more.join(probed, ["query_id", "cell"], "left_anti").select("query_id", "course_id", "cell")
        scored = scored.unionByName(_scored(index, queries, materialize(more, "cells-more"), rows, k))
    top = first_rows(scored, ["query_id"], _order(), k, rank="rank")
    return top.withColumn("score", F.round("score", 9))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``query_id, hits, wanted`` of a search against the exact one."""
    key = ["query_id", "doc_id", "chunk_index"]
    both = exact.select(*key).join(found.select(*key, F.lit(1).alias("hit")), key, "left")
    return both.groupBy("query_id").agg(F.count("hit").alias("hits"), F.count("*").alias("wanted"))
