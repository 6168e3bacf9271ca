"""Quality classifier: votes of nearest labelled documents in a latent space.

A text becomes counts of hashed byte trigrams and of word shapes.  The leading
right singular vectors of the labelled rows' counts span the latent space.  The
labelled vectors, a sample of bounded size, are broadcast; every document's vector
is multiplied with all of them, block by block, and the labels of its nearest
neighbours vote with weights that grow with the cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.textscan import column_bytes, pieces, trim, words

BINS = 1 << 11
SHAPES = 9
#: Weight of the shape counts beside the trigrams, whose squares add up to 1.
SHAPE_WEIGHT = 1.0
#: Labelled rows of each label that the model keeps at most.
SAMPLE = 1500
RANK = 64
NEIGHBOURS = 15
SHARPNESS = 24
#: Score from which a document counts as good.
ACCEPT = 0.3

_ROWS = 512


def _shapes(column: pa.Array, n: int) -> np.ndarray:
    """Counts per text: words, repeats of the word before, capitals, symbols at the
    end, symbols alone, digits, very long, and one-letter words."""
    out = np.zeros((n, SHAPES), np.float64)
    last_doc, last_hash = -1, 0
    keep = np.arange(256, dtype=np.uint8)
    alnum = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
    upper = np.array([chr(b).isupper() if b < 128 else True for b in range(256)])
    digit = np.array([chr(b).isdigit() if b < 128 else False for b in range(256)])
    for w in words(column, keep):
        if not len(w.start):
            continue
        h, length = w.hashes(), w.end - w.start
        first, final = w.data[w.start], w.data[w.end - 1]
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
        same[0] = w.doc[0] == last_doc and h[0] == last_hash
        last_doc, last_hash = int(w.doc[-1]), h[-1]
        sums = [np.concatenate([[0], np.cumsum(t[w.data])]) for t in (alnum, upper, digit)]
        letters, capitals, digits = (s[w.end] - s[w.start] for s in sums)
        marks = length - letters
        flags = (
            np.ones(len(h), bool),
            same,
            (capitals == letters) & (letters > 1) & (digits < letters),
            (marks > 1) & (letters > 0),
            letters == 0,
            (digits > 0) & (digits == letters),
            length > 20,
            length == 1,
            ~alnum[final] & alnum[first],
        )
        for k, flag in enumerate(flags):
            out[:, k] += np.bincount(w.doc[flag], minlength=n)
    return out


def features(column: pa.Array) -> np.ndarray:
    """One row of weighted counts per text; zero for a text without words."""
    n = len(column)
    raw, offsets = column_bytes(column)
    counts = np.zeros((n, BINS), np.float32)
    for a, b in pieces(offsets, raw):
        more = raw[a : min(b + 2, len(raw))].astype(np.uint32)
        if len(more) < 3:
            continue
        code = more[:-2] | more[1:-1] << np.uint32(8) | more[2:] << np.uint32(16)
        code = (code * np.uint32(0x9E3779B1)) >> np.uint32(21)
        low, high = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b - 1, "right")
        doc = np.repeat(np.arange(low, high), np.diff(np.clip(offsets[low : high + 1], a, b)))[: len(code)]
        whole = a + np.arange(len(code)) + 3 <= offsets[doc + 1]
        flat = (doc[whole] - low) * BINS + code[whole]
        counts[low:high] += np.bincount(flat, minlength=(high - low) * BINS).reshape(-1, BINS)
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    shapes = _shapes(column, n)
    share = shapes / np.maximum(shapes[:, :1], 1)
    share[:, 0] = (counts > 0).sum(axis=1) / np.minimum(total[:, 0], BINS)
    share *= shapes[:, :1] > 0
    return np.concatenate([np.sqrt(counts / total), SHAPE_WEIGHT * np.sqrt(share)], axis=1).astype(np.float32)


@dataclass
class Voters:
    """Latent basis, unit vectors and labels of the labelled sample, and the share
    of label 1 among all labelled rows."""

    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def project(self, rows: np.ndarray) -> np.ndarray:
        x = rows @ self.basis
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(rows), self.prior)
        cosine = self.project(rows) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** SHARPNESS
        total = weight.sum(axis=1)
        votes = (weight * self.labels[near]).sum(axis=1)
        return np.where(total > 1e-12, votes / np.maximum(total, 1e-12), self.prior)


def latent_basis(rows: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Leading right singular vectors, by subspace iteration from a fixed start."""
    rank = min(rank, *rows.shape)
    wide = min(rank + 16, *rows.shape)
    q = np.random.default_rng(7).standard_normal((rows.shape[1], wide)).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(rows.T @ (rows @ q))
    _, _, vt = np.linalg.svd(rows @ q, full_matrices=False)
    return np.ascontiguousarray(q @ vt[:rank].T)


def held_out(key: Column, folds: int) -> Column:
    """Whether the CRC-32 of the key as text is a multiple of ``folds``."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    sample: int = SAMPLE, folds: int = 5,
) -> Voters:
    """The model from labelled rows outside the held-out fold.

    At most ``sample`` rows of each label are kept, those with the smallest hash of
    their key, so the model's size and the rows sent to the driver are bounded.
    """
    marked = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter("y IN (0, 1)")
    marked = marked.filter(~held_out(F.col("k"), folds))
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    # Only hashes low enough to be among the smallest take part in the ranking.
    spread = F.pmod(F.xxhash64("k"), F.lit(1 << 30))
    bound = F.lit(1 << 30)
    for y, n in counts.items():
        bound = F.when(F.col("y") == y, F.lit(int((1 << 30) * min(1, 2 * sample / n)))).otherwise(bound)
    order = Window.partitionBy("y").orderBy(spread, "k")
    chosen = (
        marked.filter(spread < bound)
        .withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= sample)
        .select("k", "y")
    )

    @F.arrow_udf("binary")
    def packed(column: pa.Array) -> pa.Array:
        rows = (features(column[i : i + _ROWS]) for i in range(0, len(column), _ROWS))
        return pa.array([x.tobytes() for block in rows for x in block], pa.binary())

    # Two rows per kept label at most: the join can be broadcast.
    texts = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    rows = (
        texts.join(F.broadcast(chosen), "k")
        .groupBy("k", "y").agg(F.min("t").alias("t"))
        .select("k", "y", packed("t").alias("x"))
        .orderBy("k")
        .collect()
    )
    if not rows:
        return Voters(np.zeros((BINS + SHAPES, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    matrix = np.stack([np.frombuffer(r["x"], np.float32) for r in rows])
    basis = latent_basis(matrix)
    model = Voters(basis, np.zeros((0, 1), np.float32), np.array([r["y"] for r in rows], np.float64), float(share))
    model.vectors = model.project(matrix).astype(np.float32)
    return model


def score(model: Voters, docs: DataFrame, text: str = "text") -> Column:
    """Score of a text column, 0 to 1; higher means label 1 is likelier."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            parts = [held.value.scores(features(column[i : i + _ROWS])) for i in range(0, len(column), _ROWS)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
            trim()

    return scored(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))


def classified(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Null texts count as empty; a text without words is near no other and gets the
    share of label 1 among the labelled rows, as does every text if there are no
    labels (0.5).  Labels other than 0 and 1, and labels of unknown ids, are left
    out.  Repeated rows are scored one by one; other columns are ignored.
    """
    model = fit(docs, labels, key, text)
    scored = docs.select(
        F.col(key).alias("doc_id"),
        held_out(F.col(key), 5).alias("held_out"),
        score(model, docs, text).alias("score"),
    )
    return scored.withColumn("predicted", F.when(F.col("score") >= ACCEPT, 1).otherwise(0))
