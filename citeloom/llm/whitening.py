"""Whitened embeddings from an exact, bit-sliced scatter matrix.

An entry c becomes the integer x = floor(1024 c) + 100000.  Each dimension is shifted
by its least x and cut into bit planes; the planes of a block of rows are packed across
rows, 64 rows a word.  The cross-product of two dimensions is then the sum, over pairs
of planes p and q, of 2**(p + q) times the ones of their AND.  All of it is integer
arithmetic, so sums do not depend on partitions or order; centring happens in integers
before the one division that makes the covariance, and only then comes ``eigh``.

The driver holds one matrix of dimension by dimension, never rows.  Planes without a one
in a block cost nothing there, so a single far outlier does not slow other blocks.

Defined results:

* A null vector and one with a null or non-finite entry is dropped; so is one whose
  length is not the commonest of the others (of equally common lengths, the longer).
* Entries beyond 2**62 / 1024 in size count as that bound.
* A component without variance (equal rows, fewer rows than components) whitens to 0
  and explains 0; ``identity_error`` then is 1.  Below 8 dimensions there are as many
  components as dimensions.
* A deviation beyond a long is null in ``deviation`` and whole in ``deviation_digits``.
* Repeated rows and null ids are rows like others; an empty table gives no rows.  Equal
  eigenvalues leave the choice of their vectors open; it is one for all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.session import materialize

UNIT, OFFSET = 1024.0, 100_000
COMPONENTS = 8
#: Rows whose planes are packed together, and bits of weight in one sum.
BLOCK, LIMB = 8192, 24
_LARGEST = 1 << 62

STATS = "dims int, dim int, n long, high long, low long, least long, most long"
SUMS = "i int, j int, limb int, part long"
OUTPUT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, "
    "identity_error double, deviation_digits string"
)


@dataclass
class Basis:
    """What turns a vector into whitened coordinates; sums are Python integers."""

    n: int
    least: np.ndarray
    width: np.ndarray
    total: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) if self.trace > 0 else 0.0 for v in self.values]


def integers(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and integer matrix of the usable vectors, one pair for each length."""
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False), nan=-1).astype(np.int64)
    for d in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == d)
        flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
        c = flat.to_numpy(zero_copy_only=False).reshape(-1, d)
        usable = np.isfinite(c).all(axis=1)
        with np.errstate(over="ignore"):
            x = np.clip(np.floor(UNIT * c[usable]), -_LARGEST, _LARGEST).astype(np.int64) + OFFSET
        yield rows[usable], x


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, x in integers(batch.column("embedding")):
            n, d = x.shape
            if not n:
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(d, d, np.int32)),
                    pa.array(np.arange(d, dtype=np.int32)),
                    pa.array(np.full(d, n, np.int64)),
                    pa.array((x >> 32).sum(axis=0)),
                    pa.array((x & 0xFFFFFFFF).sum(axis=0)),
                    pa.array(x.min(axis=0)),
                    pa.array(x.max(axis=0)),
                ],
                names=["dims", "dim", "n", "high", "low", "least", "most"],
            )


def planes(y: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Bit planes of all columns, low bits first, packed across rows into words."""
    rows = -(-len(y) // 64) * 64
    packed = np.zeros((int(width.sum()), rows // 8), np.uint8)
    at = 0
    for d, w in enumerate(width.tolist()):
        bits = ((y[:, d, None] >> np.arange(w, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        packed[at : at + w, : -(-len(y) // 8)] = np.packbits(bits, axis=0).T
        at += w
    return packed.view(np.uint64)


class Scatter:
    """Weighted AND-popcounts of plane pairs, summed by dimensions and limb."""

    def __init__(self, width: np.ndarray):
        self.width = width
        self.dim = np.repeat(np.arange(len(width)), width)
        self.bit = np.concatenate([np.arange(w) for w in width.tolist()]) if len(width) else np.zeros(0, np.int64)
        self.limbs = int(2 * width.max(initial=1) - 2) // LIMB + 1
        self.parts = np.zeros((self.limbs, len(width), len(width)), np.int64)

    def add(self, y: np.ndarray) -> None:
        words = planes(y, self.width)
        alive = np.flatnonzero(words.any(axis=1))
        words, dim, bit = words[alive], self.dim[alive], self.bit[alive]
        for k in range(len(words)):
            ones = np.bitwise_count(words[k] & words[k:]).sum(axis=1, dtype=np.int64)
            power, other = bit[k] + bit[k:], dim[k:]
            # Within a dimension a pair of planes stands for both of its orders.
            ones = ones << (power % LIMB + ((other == dim[k]) & (np.arange(len(other)) > 0)))
            begins = np.flatnonzero(np.diff(other, prepend=-1))
            for limb in range(self.limbs):
                held = ones if self.limbs == 1 else np.where(power // LIMB == limb, ones, 0)
                self.parts[limb, dim[k], other[begins]] += np.add.reduceat(held, begins)


def _sums(least: np.ndarray, width: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scatter, held, rows = Scatter(width), [], 0
        for batch in batches:
            for _, x in integers(batch.column("embedding")):
                if x.shape[1] != len(least) or not len(x):
                    continue
                held.append((x - least).view(np.uint64))
                rows += len(x)
                if rows >= BLOCK:
                    y = np.concatenate(held)
                    for at in range(0, rows - BLOCK + 1, BLOCK):
                        scatter.add(y[at : at + BLOCK])
                    held = [y[rows - rows % BLOCK :]]
                    rows %= BLOCK
        if rows:
            scatter.add(np.concatenate(held))
        i, j = np.triu_indices(len(least))
        for limb in range(scatter.limbs):
            part = scatter.parts[limb, i, j]
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.full(len(i), limb, np.int32)), pa.array(part)],
                names=["i", "j", "limb", "part"],
            )

    return run


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Basis | None:
    """Basis of all usable vectors; none if there is no vector."""
    exact = F.sum(F.col("part").cast("decimal(38,0)"))
    stats = (
        vectors.mapInArrow(_stats, STATS)
        .groupBy("dims", "dim")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("high").cast("decimal(38,0)")).alias("high"),
            F.sum(F.col("low").cast("decimal(38,0)")).alias("low"),
            F.min("least").alias("least"),
            F.max("most").alias("most"),
        )
    )
    common = stats.filter("dim = 0").orderBy(F.desc("n"), F.desc("dims")).select("dims").first()
    if common is None:
        return None
    # As many rows as a vector has entries.
    rows = stats.filter(F.col("dims") == common[0]).orderBy("dim").collect()
    n = rows[0]["n"]
    least = np.array([r["least"] for r in rows], np.int64)
    width = np.array([(r["most"] - r["least"]).bit_length() for r in rows], np.int64)
    total = [(int(r["high"]) << 32) + int(r["low"]) - n * r["least"] for r in rows]
    sums = vectors.mapInArrow(_sums(least, width), SUMS).groupBy("i", "j", "limb").agg(exact.alias("part"))
    d = len(rows)
    cross = [[0] * d for _ in range(d)]
    for i, j, limb, part in sums.collect():  # half a matrix of dimension by dimension
        cross[i][j] += int(part) << (LIMB * limb)
    cov = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            # Division of Python integers rounds once.
            cov[i, j] = cov[j, i] = (n * cross[i][j] - total[i] * total[j]) / (n * n)
    values, vectors_ = np.linalg.eigh(cov)
    k = min(components, d)
    values, vectors_ = values[::-1][:k], vectors_[:, ::-1][:, :k]
    # Eigenvalues of a covariance are not negative; what rounding leaves is none.
    values = np.where(values > max(values[0], 0.0) * d * np.finfo(float).eps, values, 0.0)
    signs = np.sign(vectors_[np.abs(vectors_).argmax(axis=0), np.arange(k)])
    trace = sum(n * cross[i][i] - total[i] * total[i] for i in range(d)) / (n * n)
    return Basis(n, least, width, total, values, vectors_ * signs, trace)


def deviations(basis: Basis, y: np.ndarray) -> list[int]:
    """Sums over dimensions of (n x - S)**2, exact."""
    n, total = basis.n, basis.total
    if int(basis.width.max(initial=0)) * 2 + len(total).bit_length() < 63:
        y = y.astype(np.int64)
        square = (y * y).sum(axis=1).tolist()
        # The sums in pieces of 30 bits, each of whose products fit.
        cross = [0] * len(y)
        shift = 0
        while any(t >> shift for t in total):
            piece = np.array([t >> shift & 0x3FFFFFFF for t in total], np.int64)
            if int(basis.width.max(initial=0)) + 30 + len(total).bit_length() < 63:
                dots = (y @ piece).tolist()
            else:
                dots = (y.astype(object) @ piece.astype(object)).tolist()
            cross = [c + (v << shift) for c, v in zip(cross, dots, strict=True)]
            shift += 30
        fixed = sum(t * t for t in total)
        return [n * n * s - 2 * n * c + fixed for s, c in zip(square, cross, strict=True)]
    return [sum((n * int(v) - t) ** 2 for v, t in zip(row, total, strict=True)) for row in y]


def centred(basis: Basis, y: np.ndarray) -> np.ndarray:
    """x - S / n in double precision; the numerator is exact where it fits a long."""
    if basis.n.bit_length() + int(basis.width.max(initial=0)) < 62:
        return (y.astype(np.int64) * basis.n - np.array(basis.total, np.int64)) / float(basis.n)
    return y.astype(np.float64) - np.array([t / basis.n for t in basis.total])


def _whiten(basis: Basis) -> Callable:
    scale = np.divide(1.0, np.sqrt(basis.values), out=np.zeros_like(basis.values), where=basis.values > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in integers(batch.column("embedding")):
                if x.shape[1] != len(basis.least) or not len(x):
                    continue
                y = (x - basis.least).view(np.uint64)
                w = centred(basis, y) @ basis.vectors * scale
                dev = deviations(basis, y)
                offsets = np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(rows)),
                        pa.array([v if v < 1 << 63 else None for v in dev], pa.int64()),
                        pa.array([str(v) for v in dev], pa.string()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(w.ravel())),
                    ],
                    names=["vec_id", "deviation", "deviation_digits", "w"],
                )

    return run


def _moments(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k + 1, k + 1))
        for batch in batches:
            w = batch.column("w").flatten().to_numpy().reshape(-1, k)
            w = np.concatenate([np.ones((len(w), 1)), w], axis=1)
            sums += w.T @ w
        i, j = np.indices(sums.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(sums.ravel())], names=["i", "j", "v"]
        )

    return run


def identity_error(coordinates: DataFrame, k: int) -> float:
    """Largest entry of the coordinates' covariance minus the identity, from the rows."""
    sums = np.zeros((k + 1, k + 1))
    moments = coordinates.select("w").mapInArrow(_moments(k), "i int, j int, v double")
    for i, j, v in moments.groupBy("i", "j").agg(F.sum("v")).collect():
        sums[i, j] = v
    mean = sums[0, 1:] / sums[0, 0]
    return float(np.abs(sums[1:, 1:] / sums[0, 0] - np.outer(mean, mean) - np.eye(k)).max())


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component, with the fit's own measures."""
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    basis = fit(vectors.select("embedding"), components)
    if basis is None:
        return embeddings.sparkSession.createDataFrame([], OUTPUT)
    k = len(basis.values)
    made = "vec_id long, deviation long, deviation_digits string, w array<double>"
    coordinates = materialize(vectors.mapInArrow(_whiten(basis), made), "whitened")
    error = identity_error(coordinates, k)
    explained = F.array(*[F.lit(v) for v in basis.explained])
    rows = coordinates.select("vec_id", "deviation", "deviation_digits", F.posexplode("w").alias("place", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(basis.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(explained, F.col("place") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
        "deviation_digits",
    )
