"""Source divergence: how the sources of a language differ in their terms.

Terms are found by iceberg prefix refinement.  A level looks at the first ``LEVELS[k]``
bytes of terms (doubling beyond the last): terms that end there are complete, the others
are prefixes.  No term occurs in more documents than its prefix, so a prefix in fewer
than ``least`` documents of its language is discarded with all that begins with it, and
the next level looks only at longer terms of the prefixes left.  It ends when no prefix
is left; complete terms in enough documents are kept, with their counts by source.

A document is one row, so its distinct terms are found where it is read and a level
shuffles only (language, prefix, number) rows, merged by batch and by task before.
Surviving prefixes go to the tasks as a bitmap of hashes of at most ``BITMAP`` bits:
prefixes that share a bit let more through, which their own counts then drop.  Terms
themselves are compared as strings, never as hashes.

Kept terms are dealt in blocks of a language; a block holds a matrix of sources and
terms and gives the sums of all pairs of sources over its terms.

Defined results: null text, lang and source count as ''; every row is a document, also
repeated ones; texts without terms and languages without kept terms still have their
pairs, of value 0; ties rank by item in UTF-8 order; an empty table gives no rows.  Texts
are walked in pieces (``textscan``), and a term may be of any length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.textscan import Words, mix, trim, words
from citeloom.session import materialize

LEAST_DOCS = 10
#: Bytes of a prefix at each level; later levels double the last.
LEVELS = (6, 12)
#: Bits of the largest bitmap, and bits for each surviving prefix below that.
BITMAP, BITS_EACH = 1 << 26, 32
#: Cells of sources and terms that one block holds, about; with many sources more, so
#: that a block has 64 cells and more for each pair it gives.
CELLS = 1 << 16
SCALE = 1_000_000_000
TOP = 10

#: Lower-cases A-Z; every other ASCII byte but letters separates.
TERM_BYTES = np.arange(256, dtype=np.uint8)
TERM_BYTES[:128] = 0x20
TERM_BYTES[0x61:0x7B] = np.arange(0x61, 0x7B)
TERM_BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)

_PIECES = "lang string, source string, piece binary, complete boolean, docs long, uses long"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as one binary column."""
    size = end - start
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])])


def prefix_hash(langs: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each language's hash and byte range."""
    return mix(Words(data, start, start, end).hashes() ^ langs)


def lang_hash(lang: str) -> int:
    out = np.array([len(lang)], np.uint64)
    for b in lang.encode():
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + np.uint64(b + 1))
    return int(out[0])


class Bitmap:
    """Which hashes may be those of surviving prefixes."""

    def __init__(self, bits: int, words_: np.ndarray, values: np.ndarray):
        self.bits = bits
        self.words = np.zeros(bits >> 6, np.uint64)
        self.words[words_] = values.view(np.uint64)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(self.bits - 1)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _level(length: int, before: int, survivors) -> Callable:
    """Pieces of one level with their documents and uses, merged by batch.

    Rows of complete terms are by source, those of prefixes of no source.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = survivors.value if survivors is not None else None
        for batch in batches:
            lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
            n_source = max(len(source.dictionary), 1)
            code = lang.indices.to_numpy().astype(np.int64) * n_source + source.indices.to_numpy()
            hashed = np.array([lang_hash(v) for v in lang.dictionary.to_pylist()], np.uint64)
            tables = []
            last: tuple[int, set] | None = None
            for w in words(batch.column("text"), TERM_BYTES):
                size = w.end - w.start
                look = size > before
                doc, start, end = w.doc[look], w.start[look], w.end[look]
                if not len(doc):
                    continue
                own = code[doc] // n_source
                if bitmap is not None:
                    alive = bitmap.may_hold(prefix_hash(hashed[own], w.data, start, start + before))
                    doc, start, end, own = doc[alive], start[alive], end[alive], own[alive]
                    if not len(doc):
                        continue
                whole = end - start <= length
                cut = gathered(w.data, start, np.minimum(end, start + length)).dictionary_encode()
                piece = cut.indices.to_numpy().astype(np.int64) * 2 + whole
                n_piece = len(cut.dictionary) * 2
                # One row for each piece of a document, then for each piece of a key.
                pairs, uses = np.unique(doc * n_piece + piece, return_counts=True)
                pair_doc, pair_piece = pairs // n_piece, pairs % n_piece
                fresh = np.ones(len(pairs), bool)
                first, final = int(pair_doc[0]), int(pair_doc[-1])
                names = cut.dictionary
                if last is not None and last[0] == first:
                    # The text goes on from the piece before: what it had counts once.
                    at = np.flatnonzero(pair_doc == first)
                    seen = names.take(pa.array(pair_piece[at] // 2)).to_pylist()
                    fresh[at] = [(s, c & 1) not in last[1] for s, c in zip(seen, pair_piece[at].tolist(), strict=True)]
                at = np.flatnonzero(pair_doc == final)
                mine = set(zip(names.take(pa.array(pair_piece[at] // 2)).to_pylist(), (pair_piece[at] & 1).tolist(), strict=True))
                last = (final, mine | last[1] if last is not None and last[0] == final else mine)
                key = np.where(pair_piece & 1, code[pair_doc], -1 - code[pair_doc] // n_source)
                low = key.min()
                merged, back = np.unique((key - low) * n_piece + pair_piece, return_inverse=True)
                docs = np.bincount(back, weights=fresh).astype(np.int64)
                used = np.bincount(back, weights=uses).astype(np.int64)
                key, pair_piece = merged // n_piece + low, merged % n_piece
                complete = (pair_piece & 1).astype(bool)
                lang_at = np.where(complete, key // n_source, -1 - key)
                source_at = np.where(complete, key % n_source, 0)
                tables.append(
                    pa.table(
                        {
                            "lang": lang.dictionary.take(pa.array(lang_at)),
                            "source": pc.if_else(pa.array(complete), source.dictionary.take(pa.array(source_at)), pa.scalar(None, pa.string())),
                            "piece": names.take(pa.array(pair_piece // 2)).cast(pa.binary()),
                            "complete": pa.array(complete),
                            "docs": pa.array(docs),
                            "uses": pa.array(used),
                        }
                    )
                )
                if sum(t.num_rows for t in tables) > 1 << 18:
                    yield from _merged(tables)
                    tables = []
            if tables:
                yield from _merged(tables)
            trim()

    return run


def _merged(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    table = pa.concat_tables(tables)
    if len(tables) > 1:
        keys = ["lang", "source", "piece", "complete"]
        table = table.group_by(keys, use_threads=False).aggregate([("docs", "sum"), ("uses", "sum")])
        table = table.rename_columns({"docs_sum": "docs", "uses_sum": "uses"}).select([*keys, "docs", "uses"])
    yield from table.combine_chunks().to_batches(max_chunksize=1 << 16)


def _marked(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashed = np.array([lang_hash(v) for v in batch.column("lang").to_pylist()], np.uint64)
        pieces = batch.column("piece").cast(pa.large_binary())
        offsets = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
        data = np.frombuffer(pieces.buffers()[2], np.uint8)
        at = prefix_hash(hashed, data, offsets[:-1], offsets[1:]) & np.uint64(bits - 1)
        word = (at >> np.uint64(6)).astype(np.int32)
        bit = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit)], names=["word", "bits"])


def _bitmap(prefixes: DataFrame, most: int) -> Bitmap | None:
    """Bitmap of the prefixes; none if there are none.  At most ``most`` bits."""
    n = prefixes.count()
    if not n:
        return None
    bits = min(most, 1 << max(6, (BITS_EACH * n - 1).bit_length()))
    marks = prefixes.select("lang", "piece").mapInArrow(lambda b: _marked(b, bits), "word int, bits long")
    found = marks.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    return Bitmap(bits, found.column("word").to_numpy(), found.column("bits").to_numpy())


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS, bitmap: int = BITMAP, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """``lang, source, term, uses`` of the terms in ``least`` documents of the language."""
    texts = docs.select(_text("lang").alias("lang"), _text("source").alias("source"), _text("text").alias("text"))
    spark, found = docs.sparkSession, []
    before, survivors, level = 0, None, 0
    while True:
        length = levels[level] if level < len(levels) else 2 * before
        rows = texts.mapInArrow(_level(length, before, survivors), _PIECES)
        counted = rows.groupBy("lang", "source", "piece", "complete").agg(
            F.sum("docs").alias("docs"), F.sum("uses").alias("uses")
        )
        # As many rows as a term has sources.
        term = Window.partitionBy("lang", "piece", "complete")
        counted = counted.withColumn("all_docs", F.sum("docs").over(term)).filter(F.col("all_docs") >= least)
        counted = materialize(counted.drop("all_docs"), f"divergence-{length}")
        found.append(counted.filter("complete").select("lang", "source", F.col("piece").cast("string").alias("term"), "uses"))
        if survivors is not None:
            survivors.unpersist()
        left = _bitmap(counted.filter("NOT complete"), bitmap)
        if left is None:
            break
        survivors, before, level = spark.sparkContext.broadcast(left), length, level + 1
    terms = found[0]
    for more in found[1:]:
        terms = terms.unionByName(more)
    return terms


def _share(uses: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (uses + 2) / (total + 2 * kept)), in whole numbers."""
    top = (uses + 2).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return 1 + F.call_function("div", top, (total + 2 * kept).cast("decimal(20,0)"))


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pairs(key: tuple, uses: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums over the terms of a block for each pair of its language's sources."""
    groups = groups.sort_by("source")
    names = groups.column("source").combine_chunks()
    term = uses.column("term").combine_chunks().dictionary_encode()
    at = pc.index_in(uses.column("source").combine_chunks(), value_set=names).to_numpy(zero_copy_only=False)
    matrix = np.repeat(groups.column("absent").to_numpy()[:, None], len(term.dictionary), axis=1)
    matrix[at.astype(np.int64), term.indices.to_numpy()] = uses.column("p").to_numpy()
    first, second = np.triu_indices(len(names), 1)
    value = [np.zeros(0, np.int64)]
    for a in range(len(names) - 1):
        p, q = matrix[a], matrix[a + 1 :]
        value.append(((p - q) * (p - q) // (p + q)).sum(axis=1))
    return pa.table(
        {
            "lang": pa.array([key[0].as_py()] * len(first), pa.string()),
            "a": names.take(pa.array(first)),
            "b": names.take(pa.array(second)),
            "value": pa.array(np.concatenate(value)),
        }
    )


def audit(docs: DataFrame, least: int = LEAST_DOCS, cells: int = CELLS, bitmap: int = BITMAP) -> DataFrame:
    """``lang, source, part, item, value, rank`` for pairs of sources and for terms."""
    # A term's rows, one for each source that uses it, meet once for its counts in the
    # language; groups are (language, source) rows.
    terms = kept_terms(docs, least, bitmap)
    term = Window.partitionBy("lang", "term")
    terms = terms.withColumn("lang_uses", F.sum("uses").over(term))
    terms = materialize(terms.withColumn("first", F.row_number().over(term.orderBy("source")) == 1), "divergence-terms")
    langs = terms.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("kept"), F.sum("uses").alias("lang_total"))
    totals = terms.groupBy("lang", "source").agg(F.sum("uses").alias("total"))
    groups = docs.select(_text("lang").alias("lang"), _text("source").alias("source")).distinct()
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = F.lit(0).cast("long")
    groups = groups.select(
        "lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "kept", "lang_total")]
    )
    sources = F.count("*").over(Window.partitionBy("lang"))
    held = F.greatest(F.lit(cells), 32 * sources * sources)
    groups = groups.withColumn("blocks", (1 + F.col("kept") * sources / held).cast("int"))
    groups = groups.withColumn("absent", F.when(F.col("kept") > 0, _share(zero, F.col("total"), F.col("kept"))))
    groups = materialize(groups, "divergence-groups")

    shared = terms.join(groups, ["lang", "source"]).select(
        "lang", "source", "term",
        F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"),
        _share(F.col("uses"), F.col("total"), F.col("kept")).alias("p"),
        _share(F.col("lang_uses"), F.col("lang_total"), F.col("kept")).alias("q"),
    )
    dealt = groups.select(
        "lang", "source", F.coalesce("absent", zero).alias("absent"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
    )
    blocks = (
        shared.select("lang", "block", "source", "term", "p").groupBy("lang", "block")
        .cogroup(dealt.groupBy("lang", "block"))
        .applyInArrow(_pairs, "lang string, a string, b string, value long")
    )
    summed = blocks.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item")),
    )
    pairs = summed.select("lang", "value", F.explode(ways).alias("way")).select(
        "lang", "way.source", F.lit("pair").alias("part"), "way.item", "value"
    )
    marked = shared.filter(F.col("p") > F.col("q")).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    top = marked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)
    return ranked.unionByName(top)
