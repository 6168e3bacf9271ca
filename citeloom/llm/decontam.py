"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are word sequences (letters and digits, A-Z
lower-cased).  Windows of ``TILE`` words are compared by their Karp-Rabin hashes;
windows that a document shares with an item are the seeds.  Seeds that continue
each other form matches.  The longest match whose words are all free is marked as
a tile, again and again; what is left of a partly marked match competes on.  An
item is in a document if tiles cover enough of its words, in whatever order.

Items are a table of windows, documents one of those windows whose bit is set in a
bitmap of fixed size that the items fill; the two are joined, the items' side broadcast
only if it was counted to be small.  Seeds are then gathered for each text and item,
copies of a text merged before they are shuffled, and tiled there.  Texts stay in place:
two 64-bit hashes name a text, and two a window.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.textscan import PLAIN, mix, trim, words
from citeloom.operators.joins import join_small, row_bound
from citeloom.session import materialize, release

#: Words of a seed, the shortest tile.
TILE = 5
#: Share of an item's words that tiles must cover.
COVERAGE = 0.6
#: Texts that hold an item, 16 bytes each, up to which they are broadcast.
BROADCAST_TEXTS = 1 << 20

#: Bits of the bitmap of one window size, as a power of two.
_BITS = 24
_STEP, _OTHER_STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_WINDOW = ["size", "value", "check"]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the bounds of each text among them."""
    found = [(w.hashes(), w.doc) for w in words(column, PLAIN)]
    hashes = np.concatenate([h for h, _ in found] or [np.zeros(0, np.uint64)])
    docs = np.concatenate([d for _, d in found] or [np.zeros(0, np.int64)])
    return hashes, np.searchsorted(docs, np.arange(len(column) + 1))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of every window of ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * _STEP + hashes[i : i + n]
    return mix(out)


def checks(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """A second hash, of the windows that begin at ``starts``."""
    out = np.zeros(len(starts), np.uint64)
    for i in range(size):
        out = out * _OTHER_STEP + hashes[starts + i]
    return mix(out)


def tiling(left: np.ndarray, right: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in a, start in b, length) from seeds of ``size`` words."""
    if not len(left):
        return []
    order = np.lexsort((left, left - right))
    left, right = left[order], right[order]
    breaks = np.flatnonzero((np.diff(left) != 1) | (np.diff(right) != 1)) + 1
    first = np.concatenate([[0], breaks])
    run = np.diff(np.concatenate([first, [len(left)]])) + size - 1
    queue = [(-int(n), int(left[f]), int(right[f])) for f, n in zip(first, run, strict=True)]
    heapq.heapify(queue)
    # Only words within a seed can be marked.
    low, tiles = int(left.min()), []
    marked_a = np.zeros(int(left.max()) - low + size, bool)
    marked_b = np.zeros(int(right.max()) + size, bool)
    while queue:
        n, i, j = heapq.heappop(queue)
        n = -n
        taken = marked_a[i - low : i - low + n] | marked_b[j : j + n]
        if not taken.any():
            marked_a[i - low : i - low + n] = marked_b[j : j + n] = True
            tiles.append((i, j, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[1], taken, [1]])))
        for s, e in zip(edges[::2], edges[1::2], strict=True):
            if e - s >= size:
                heapq.heappush(queue, (-int(e - s), i + int(s), j + int(s)))
    return tiles


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _item_windows(tile: int) -> Callable:
    """Windows of items; an item shorter than a tile is one, without words none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, bounds = word_hashes(batch.column("text"))
            total = np.diff(bounds)
            for size in np.unique(np.minimum(total[total > 0], tile)).tolist():
                own = np.flatnonzero(np.minimum(total, tile) == size)
                many = total[own] - size + 1
                place = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                start = np.repeat(bounds[own], many) + place
                of = pa.array(np.repeat(own, many))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(start), size, np.int32)), _signed(windows(hashes, size)[start]),
                        _signed(checks(hashes, start, size)), batch.column("item_id").take(of), batch.column("name").take(of),
                        pa.array(place.astype(np.int32)), pa.array(np.repeat(total[own], many).astype(np.int32)),
                    ],
                    names=[*_WINDOW, "item_id", "name", "place", "words"],
                )

    return run


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """``size, value, check, item_id, name, place, words`` of every window of the items."""
    own = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = benchmark.select(F.col(f"`{item}`").cast("long").alias("item_id"), own.alias("text")).distinct()
    return rows.withColumn("name", F.xxhash64("text")).mapInArrow(
        _item_windows(tile), "size int, value long, check long, item_id long, name long, place int, words int"
    )


def _bitmaps(seeds: DataFrame) -> dict[int, np.ndarray]:
    """For each window size, which leading bits of a hash occur: 2 MB, whatever the
    number of items."""
    slot = F.shiftrightunsigned("value", 64 - _BITS)
    rows = seeds.select("size", F.shiftright(slot, 6).cast("int").alias("slot"), slot.bitwiseAND(63).cast("int").alias("bit"))
    rows = rows.groupBy("size", "slot").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    got = rows.toArrow()
    size, slot, bits = (got.column(c).to_numpy() for c in ("size", "slot", "bits"))
    out = {}
    for s in np.unique(size).tolist():
        out[s] = np.zeros(1 << (_BITS - 6), np.uint64)
        out[s][slot[size == s]] = bits[size == s].view(np.uint64)
    return out


def _text_windows(held: Broadcast) -> Callable:
    """Windows of texts whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                hashes, bounds = word_hashes(part.column("text"))
                for size, bits in held.value.items():
                    for at in range(0, max(len(hashes) - size + 1, 0), 1 << 20):
                        value = windows(hashes[at : at + (1 << 20) + size - 1], size)
                        slot = value >> np.uint64(64 - _BITS)
                        hit = np.flatnonzero(bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1))
                        value, where = value[hit], hit + at
                        of = np.searchsorted(bounds, where, "right") - 1
                        inside = where + size <= bounds[of + 1]
                        value, where, of = value[inside], where[inside], of[inside]
                        take = pa.array(of)
                        yield pa.RecordBatch.from_arrays(
                            [
                                part.column("a").take(take), part.column("b").take(take),
                                pa.array(np.full(len(of), size, np.int32)), _signed(value),
                                _signed(checks(hashes, where, size)), pa.array((where - bounds[of]).astype(np.int32)),
                            ],
                            names=["a", "b", *_WINDOW, "at"],
                        )
                trim()

    return run


_TILED = pa.struct([("covered", pa.int32()), ("tiles", pa.int32()), ("longest", pa.int32())])


def _tiled(seeds: pa.Array, size: pa.Array) -> pa.Array:
    out = []
    for own, n in zip(seeds, size.to_pylist(), strict=True):
        left, right = (own.values.field(i).to_numpy().astype(np.int64) for i in (0, 1))
        lengths = [t[2] for t in tiling(left, right, n)]
        out.append({"covered": sum(lengths), "tiles": len(lengths), "longest": max(lengths, default=0)})
    return pa.array(out, _TILED)


def _named(text: str) -> list[Column]:
    """Two hashes of a text, null like empty."""
    own = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return [F.xxhash64(own), F.xxhash64(F.lit(1), own)]


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
         item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """``a, b, item_id, words, covered, tiles, longest`` for each text, named by ``a, b``,
    and each item in it; written, and to be released by the caller."""
    seeds = materialize(item_windows(benchmark, item, item_text), "decontam-items")
    held = docs.sparkSession.sparkContext.broadcast(_bitmaps(seeds))
    a, b = _named(text)
    texts = docs.select(a.alias("a"), b.alias("b"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    met = texts.mapInArrow(_text_windows(held), "a long, b long, size int, value long, check long, at int")
    shared = join_small(met, seeds, _WINDOW, rows=row_bound(seeds))
    # A set, so copies of a text merge before the shuffle.
    grouped = shared.groupBy("a", "b", "item_id", "name", "words", "size").agg(F.collect_set(F.struct("at", "place")).alias("seeds"))
    tile = F.arrow_udf(_tiled, "struct<covered:int,tiles:int,longest:int>")
    tiled = grouped.withColumn("tiled", tile("seeds", "size")).select("a", "b", "item_id", "words", "tiled.*")
    out = materialize(tiled.filter((F.col("covered") > 0) & (F.col("covered") >= coverage * F.col("words"))), "decontam-hits")
    held.unpersist()
    release(seeds)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
          item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that hold no item, columns as they are.

    Null and empty texts stay; without items, or without rows, all that there is stays.
    """
    # Names of their own, so that no column of the documents is meant.
    found = hits(docs, benchmark, text, item, item_text, coverage).select(F.col("a").alias("_hit_a"), F.col("b").alias("_hit_b")).distinct()
    a, b = _named(text)
    rows = row_bound(found, BROADCAST_TEXTS)
    return join_small(docs, found, (a == F.col("_hit_a")) & (b == F.col("_hit_b")), "left_anti", rows=rows, max_rows=BROADCAST_TEXTS)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                 item: str = "item_id", item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, item_id, coverage, covered, words, tiles, longest`` for each document
    that holds an item; clean documents have no row.

    Null and empty texts hold nothing; null or wordless items are in no document;
    equal benchmark rows count once, equal documents one by one.  Items of fewer
    words than a tile must occur whole.  Texts are read whole, however long; tables
    without rows give none.  Other columns are ignored.
    """
    found = hits(docs, benchmark, text, item, item_text, coverage)
    a, b = _named(text)
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), a.alias("a"), b.alias("b"))
    return join_small(rows, found, ["a", "b"], rows=row_bound(found)).select(
        "doc_id", "item_id", (F.col("covered") / F.col("words")).alias("coverage"), "covered", "words", "tiles", "longest"
    )
