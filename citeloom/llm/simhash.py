"""SimHash near-duplicates by anchor-point covering.

Anchors are the 8192 words of a linear code of length 64: all affine functions on
GF(64) plus the functions Tr(b x^3).  A fingerprint's home is its nearest anchor;
h is the distance to it, its covering radius.  A fingerprint is replicated to
every anchor within h plus the threshold, and each anchor compares those at home
with those that visit.

No link is lost: let x and y differ in at most t bits and h(x) <= h(y).  The home
of x is within h(x) + t <= h(y) + t of y, so y visits it.

Equal fingerprints are compared once.  An anchor with many of them is cut into
cells of bounded size, each pair of a block at home and a block of visitors; a cell
returns a forest that joins what is linked in it instead of all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.components import components
from citeloom.session import materialize

WORDS = 4
THRESHOLD = 4
SEED = 42

#: Fingerprints of one side of a cell, on average.
CELL = 8192

_BLOCK = 8192
_FINGER = pa.schema([("doc_id", pa.int64()), ("finger", pa.int64())])


def shingle_hashes(text: bytes, k: int = WORDS) -> Iterator[np.ndarray]:
    """XXH64 of every k-word shingle, in blocks."""
    words = text.lower().split()
    if not words:
        return
    if len(words) < k:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
        return
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(length + 1) - 1
    start, end = (ends - length)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(start), _BLOCK):
        span = zip(start[at : at + _BLOCK], end[at : at + _BLOCK], strict=True)
        yield np.array([digest(joined[a:b], SEED) for a, b in span], np.uint64)


def fingerprint(text: bytes, k: int = WORDS) -> int:
    """Bit i is 1 if it is set in over half the hashes; zero without words."""
    count, ones = 0, np.zeros(64, np.int64)
    for hashes in shingle_hashes(text, k):
        count += len(hashes)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0]) if count else 0


def fingers(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS) -> DataFrame:
    """``doc_id, finger`` of every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint((t.as_py() or "").encode(), k) for t in batch.column("text")]
            signed = pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), signed], schema=_FINGER)

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, finger long")


def anchors() -> np.ndarray:
    """The 8192 code words as 64-bit integers."""
    power = [1]  # of a root of x^6 + x + 1
    for _ in range(62):
        x = power[-1] << 1
        power.append(x ^ 0x43 if x & 0x40 else x)
    log = {v: i for i, v in enumerate(power)}

    def times(a: int, b: int) -> int:
        return power[(log[a] + log[b]) % 63] if a and b else 0

    def trace(a: int) -> int:
        total = 0
        for _ in range(6):
            total ^= a
            a = times(a, a)
        return total & 1

    cubes = [times(x, times(x, x)) for x in range(64)]
    linear = [sum((bin(a & x).count("1") & 1) << x for x in range(64)) for a in range(64)]
    cubic = [sum(trace(times(b, cubes[x])) << x for x in range(64)) for b in range(64)]
    words = [w ^ c ^ f for c in cubic for w in linear for f in (0, (1 << 64) - 1)]
    return np.array(words, np.uint64)


def replicas(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``anchor, finger, home`` for the home of each fingerprint and all it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = anchors()
        for batch in batches:
            values = batch.column("finger").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(values), 256):
                part = values[at : at + 256]
                far = np.bitwise_count(part[:, None] ^ code[None, :])
                near = far.min(axis=1)
                home = far.argmin(axis=1)
                row, anchor = np.nonzero(far <= (near + threshold)[:, None])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([home, anchor]).astype(np.int32)),
                        pa.array(np.concatenate([part, part[row]]).view(np.int64)),
                        pa.array(np.arange(len(home) + len(row)) < len(home)),
                    ],
                    names=["anchor", "finger", "home"],
                )

    return distinct.select("finger").mapInArrow(run, "anchor int, finger long, home boolean")


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unite the sets of a[i] and b[i]."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        parent = _roots(parent)


def linked(home: np.ndarray, visiting: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what is linked between two sets of fingerprints."""
    values = np.unique(np.concatenate([home, visiting]))
    left, right = np.searchsorted(values, np.unique(home)), np.searchsorted(values, np.unique(visiting))
    parent = np.arange(len(values))
    for i in range(0, len(left), 512):
        rows = left[i : i + 512]
        for j in range(0, len(right), 2048):
            columns = right[j : j + 2048]
            near = np.bitwise_count(values[rows][:, None] ^ values[columns][None, :]) <= threshold
            near &= parent[rows][:, None] != parent[columns][None, :]
            while near.any():
                r, c = near.any(axis=1), near.any(axis=0)
                parent = _join(parent, rows[r], columns[near[r].argmax(axis=1)])
                parent = _join(parent, columns[c], rows[near[:, c].argmax(axis=0)])
                near &= parent[rows][:, None] != parent[columns][None, :]
    moved = np.flatnonzero(parent != np.arange(len(values)))
    return values[moved], values[parent[moved]]


def _compare(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(cell, finger, home):
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
            found = [
                linked(f[h], f[~h], threshold)
                for f, h in ((finger[a:b], home[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a)
            ]
            a, b = (np.concatenate([x[i] for x in found] or [np.zeros(0, np.uint64)]) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            cell, finger, home = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "finger", "home"))
            rows = [cell, finger.view(np.uint64), home.astype(bool)]
            if held is not None:
                rows = [np.concatenate([x, y]) for x, y in zip(held, rows, strict=True)]
            last = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            held = [x[last:] for x in rows]
            if last:
                yield out(*(x[:last] for x in rows))
        if held is not None and len(held[0]):
            yield out(*held)

    return run


def links(distinct: DataFrame, threshold: int = THRESHOLD, cell: int = CELL) -> DataFrame:
    """Edges ``a, b`` with the components of the links between fingerprints."""
    placed = materialize(replicas(distinct, threshold), "simhash-replicas")
    # One row per anchor, 8192 at most, so the table can be broadcast.
    sizes = placed.groupBy("anchor").agg(
        F.count_if("home").alias("at_home"), F.count_if(~F.col("home")).alias("visiting")
    )
    cut = sizes.filter("at_home > 0").select(
        "anchor",
        F.ceil(F.col("at_home") / cell).cast("int").alias("home_blocks"),
        F.ceil(F.col("visiting") / cell).cast("int").alias("visit_blocks"),
    )
    own, other = F.col("home_blocks"), F.col("visit_blocks")
    mine = F.pmod(F.xxhash64("finger"), F.when(F.col("home"), own).otherwise(other)).cast("int")
    meets = F.sequence(F.lit(0), F.when(F.col("home"), other).otherwise(own) - 1)
    spread = placed.join(F.broadcast(cut), "anchor").select(
        "anchor", "finger", "home", mine.alias("mine"), F.explode(meets).alias("meets"), "visit_blocks"
    )
    i = F.when(F.col("home"), F.col("mine")).otherwise(F.col("meets")).cast("long")
    j = F.when(F.col("home"), F.col("meets")).otherwise(F.col("mine")).cast("long")
    cells = spread.select(
        ((i * F.col("visit_blocks") + j) * F.lit(8192) + F.col("anchor")).alias("cell"), "finger", "home"
    )
    return (
        cells.repartition("cell")
        .sortWithinPartitions("cell")
        .mapInArrow(_compare(threshold), "a long, b long")
        .distinct()
    )


def near_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS, threshold: int = THRESHOLD
) -> DataFrame:
    """``doc_id, fingerprint, component_id, group_size`` of every row.

    Documents are linked whose fingerprints differ in at most ``threshold`` bits;
    component_id is the smallest id that links reach.  A null text counts as empty;
    texts without words have fingerprint zero and are linked like any other.  A
    null id is never a component's id unless the component has no other.  Rows that
    share an id are separate; other columns are ignored; an empty table gives an
    empty result.
    """
    rows = materialize(fingers(docs, key, text, k), "simhash-fingers")
    distinct = materialize(
        rows.groupBy("finger").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-distinct"
    )
    roots = components(links(distinct, threshold)).withColumnRenamed("node", "finger")
    rooted = distinct.join(roots, "finger", "left").withColumn("root", F.coalesce("root", "finger"))
    groups = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("group_size"))
    named = rooted.select("finger", "root").join(groups, "root").drop("root")
    return rows.join(named, "finger").select(
        "doc_id",
        F.lower(F.lpad(F.hex("finger"), 16, "0")).alias("fingerprint"),
        "component_id",
        "group_size",
    )
