"""Language-model scores from a hierarchical Pitman-Yor process.

Tokens are words and one end per text.  A token's context is the whole word before it
(or the start of the text).  Each context has a restaurant; all share the root, whose
base is uniform over the known words and one unknown.  There are as many restaurants as
distinct words, so they grow with the corpus.

State is partitioned by context: a part holds restaurants with all their dishes, the
customers and tables of each.  A context with more than its share of all tokens is
spread over several parts by the next word; only the totals of such restaurants, at most
one for each part there is, are added up in the driver.  The dishes of the root are
partitioned by word.  Parts and root exchange table counts in each sweep: parts send the
tables of each word upward, where they are the root's customers, and get the root's
customers and tables of their words back.  The parts' dishes and the words that each part
asks the root for are written once, bucketed by receiver, so a sweep shuffles table counts
only.

Seating is sampled by Gibbs: a sweep reseats all customers of every dish in the contexts,
then in the root.  A dish is reseated given the tables of all other dishes as the sweep
before left them.  The wait for the next new table is drawn at once, so the work is in
proportion to tables, not customers.  Probabilities are averaged over the sampled seatings.

Texts are scored where the contexts are: each block of texts sends its words and text
numbers to the parts and gets sums per text back.  Words that only occur in texts that
are not learnt from are dishes without customers.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.quality import held_out
from citeloom.llm.textscan import column_bytes, mix, trim, words
from citeloom.session import materialize, release, shared_path

#: Sweeps before the first sample, and samples that are averaged.
BURN_IN, SAMPLES = 2, 3
#: Concentration of the restaurants of contexts and of the root.
STRENGTH = (2.0, 2.0)
#: Tokens of a part; a part with more is scored by several tasks.
PART_TOKENS = 2 << 20
#: Texts and bytes of a block; a longer text is a block of its own.
BLOCK_TEXTS, BLOCK_BYTES = 8192, 16 << 20
#: Bytes of a step between sorted hashes that are as good as random.
LOW_BYTES = 5
#: Dishes that are merged at once.
MERGED = 4 << 20

_END, _START = np.uint64(0x5EED_0F_E0D), np.uint64(0x5EED_0F_57A7)


_CODEC = pa.Codec("zstd", compression_level=1)


def _squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def _whole_again(cell: bytes) -> bytes:
    size = int.from_bytes(cell[:8], "little")
    return _CODEC.decompress(cell[8:], decompressed_size=size, asbytes=True) if size else b""


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers, most of them small, as a short cell."""
    top = int(values.max()) if len(values) else 0
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + _squeezed(values.astype(kind).tobytes())


def _unpack(cell: bytes) -> np.ndarray:
    return np.frombuffer(_whole_again(cell[1:]), f"u{cell[0]}").astype(np.int64)


def _pack_hashes(hashes: np.ndarray) -> bytes:
    """Sorted hashes as their steps, byte by byte; the low bytes do not compress."""
    steps = np.diff(hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    low = steps[:LOW_BYTES].tobytes()
    return low + _squeezed(steps[LOW_BYTES:].tobytes())


def _hashes(cell: bytes, n: int) -> np.ndarray:
    """The n hashes of a cell."""
    steps = np.frombuffer(cell[: LOW_BYTES * n] + _whole_again(cell[LOW_BYTES * n :]), np.uint8)
    return np.cumsum(np.ascontiguousarray(steps.reshape(8, n).T).view(np.uint64).reshape(n), dtype=np.uint64)


def _range(hashes: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of hashes each lies in."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


@dataclass
class Spread:
    """Number of parts, and over how many of them a frequent context is spread."""

    parts: int = 1
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    over: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def part(self, vocabulary: np.ndarray, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The part of each pair of places in the vocabulary."""
        over = np.ones(len(vocabulary), np.int64)
        at, there = _find(self.hot, vocabulary)
        over[there] = self.over[at[there]]
        turn = (mix(vocabulary) >> np.uint64(8)).astype(np.int64)
        return (_range(vocabulary, self.parts)[before] + turn[word] % over[before]) % self.parts


@dataclass
class Dishes:
    """Contexts (sorted), the number of dishes of each, the words of all (sorted), each
    dish's word and customers; and for texts to score, tokens of each dish and their texts."""

    before: np.ndarray
    runs: np.ndarray
    vocabulary: np.ndarray
    word: np.ndarray
    count: np.ndarray
    tokens: np.ndarray | None = None
    doc: np.ndarray | None = None

    def cells(self) -> list[bytes]:
        sizes = np.array([len(self.before), len(self.vocabulary)]).tobytes()
        return [
            sizes + _pack_hashes(self.before), _pack(self.runs), _pack_hashes(self.vocabulary), _pack(self.word),
            _pack(self.count),
        ]

    @staticmethod
    def read(cells: list[bytes]) -> "Dishes":
        houses, words_ = np.frombuffer(cells[0], np.int64, 2).tolist()
        return Dishes(
            _hashes(cells[0][16:], houses), _unpack(cells[1]), _hashes(cells[2], words_), _unpack(cells[3]), _unpack(cells[4])
        )

    @property
    def house(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.before)), self.runs)

    @property
    def key(self) -> np.ndarray:
        return self.house * max(len(self.vocabulary), 1) + self.word


def _find(sorted_: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted array, and whether the values are there."""
    if not len(sorted_):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return at, sorted_[at] == values


def _sequence(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text number of every token in order, and where each text begins."""
    hashes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for w in words(column):
        hashes.append(w.hashes())
        docs.append(w.doc)
    own, doc = np.concatenate(hashes), np.concatenate(docs)
    lengths = np.bincount(doc, minlength=len(column)) + 1
    sequence = np.full(len(own) + len(column), _END)
    sequence[np.arange(len(own)) + doc] = own
    return sequence, np.repeat(np.arange(len(column)), lengths), np.cumsum(lengths) - lengths


def dishes(column: pa.Array, train: np.ndarray, spread: Spread) -> Iterator[tuple[int, Dishes]]:
    """The dishes of some texts by part; customers are the tokens of training texts."""
    sequence, doc, begins = _sequence(column)
    if not len(sequence):
        return
    vocabulary, place = np.unique(np.append(sequence, _START), return_inverse=True)
    word = place[:-1]
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[begins] = place[-1]
    order = np.argsort(before * len(vocabulary) + word, kind="stable")
    part = spread.part(vocabulary, before[order], word[order])
    if spread.parts > 1:
        again = np.argsort(part, kind="stable")
        order, part = order[again], part[again]
    before, word, doc = before[order], word[order], doc[order]
    new = np.ones(len(order), bool)
    new[1:] = (before[1:] != before[:-1]) | (word[1:] != word[:-1])
    first = np.flatnonzero(new)
    count = np.add.reduceat(train[doc].astype(np.int64), first)
    tokens = np.diff(np.append(first, len(order)))
    before, word, part = before[first], word[first], part[first]
    ends = np.append(first, len(order))
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        starts = a + np.flatnonzero(np.concatenate([[True], before[a + 1 : b] != before[a : b - 1]]))
        own, at = np.unique(word[a:b], return_inverse=True)
        yield int(part[a]), Dishes(
            vocabulary[before[starts]], np.diff(np.append(starts, b)), vocabulary[own], at,
            count[a:b], tokens[a:b], doc[ends[a] : ends[b]],
        )


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in blocks of bounded bytes."""
    _, offsets = column_bytes(batch.column("text"))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1
        to = min(max(to, at + 1), at + BLOCK_TEXTS, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


_FREQUENT = pa.schema([("word", pa.int64()), ("n", pa.int64())])


def _frequent(parts: int):
    """Words with at least their share of a block's tokens, and its starts.

    A context with a share of all tokens has it in one block at least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _blocks(batch):
                sequence, _, begins = _sequence(some.column("text"))
                word, n = np.unique(sequence[sequence != _END], return_counts=True)
                keep = n * parts >= len(sequence)
                word, n = np.append(word[keep], _START), np.append(n[keep], len(begins))
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], schema=_FREQUENT)
            trim()

    return run


def _spread(texts: DataFrame, part_tokens: int) -> Spread:
    size = texts.agg(F.sum(F.octet_length("text") + 6)).first()[0] or 0
    parts = max(1, -(-size // (6 * part_tokens)))
    if parts == 1:
        return Spread()
    counted = texts.mapInArrow(_frequent(parts), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # No more rows than there are parts.
    hot = counted.filter(F.col("n") > size / 6 / parts).toArrow()
    word = hot.column("word").to_numpy().astype(np.int64).view(np.uint64)
    over = np.minimum(-(-hot.column("n").to_numpy() * parts * 6 // size) + 1, parts).astype(np.int64)
    order = np.argsort(word)
    return Spread(parts, word[order], over[order])


#: A cell of state or a message: kind, receiver (part or range of words), sender.
_CELL = "kind int, place int, tag long, data array<binary>, sums array<double>"
_CELL_SCHEMA = pa.schema(
    [("kind", pa.int32()), ("place", pa.int32()), ("tag", pa.int64()), ("data", pa.list_(pa.binary())),
     ("sums", pa.list_(pa.float64()))]
)
_DISHES, _TABLES, _UP, _ROOT, _DOWN, _TOTAL, _HOT, _ASKED = range(8)


def _cells(rows: list[tuple]) -> pa.Table:
    names = _CELL_SCHEMA.names
    return pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=_CELL_SCHEMA)


def _cells_sent(spread: Spread):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _blocks(batch):
                train = some.column("train").to_numpy(zero_copy_only=False)
                rows = [(_DISHES, p, 0, d.cells(), None) for p, d in dishes(some.column("text"), train, spread)]
                yield from _cells(rows).to_batches()
                del rows
                trim()

    return run


def merged(some: list[Dishes]) -> Dishes:
    vocabulary = np.unique(np.concatenate([d.vocabulary for d in some]))
    contexts = np.unique(np.concatenate([d.before for d in some]))
    width = max(len(vocabulary), 1)
    key = np.concatenate(
        [
            np.searchsorted(contexts, d.before)[d.house] * width + np.searchsorted(vocabulary, d.vocabulary)[d.word]
            for d in some
        ]
    )
    key, inverse = np.unique(key, return_inverse=True)
    count = np.bincount(inverse, np.concatenate([d.count for d in some]), len(key)).astype(np.int64)
    return Dishes(contexts, np.bincount(key // width, minlength=len(contexts)), vocabulary, key % width, count)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All dishes of one part, merged as they come."""
    held, waiting, size, place = None, [], 0, 0
    for batch in batches:
        for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            place = row["place"]
            waiting.append(Dishes.read(row["data"]))
            size += len(waiting[-1].word)
            if size > max(MERGED, 0 if held is None else len(held.word)):
                held = merged([held, *waiting] if held else waiting)
                waiting, size = [], 0
    held = merged([held, *waiting] if held else waiting)
    yield from _cells([(_DISHES, place, 0, held.cells(), None)]).to_batches()
    trim()


@dataclass
class Totals:
    """The root's customers and tables, restaurants of frequent contexts, parameters."""

    customers: float
    tables: float
    discount: tuple[float, float]
    base: float
    hot: np.ndarray
    hot_tables: np.ndarray
    hot_customers: np.ndarray

    def root(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        d, s = self.discount[1], STRENGTH[1]
        return (customers - d * tables + (s + d * self.tables) * self.base) / (s + self.customers)

    def houses(self, own: Dishes, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of the contexts, whole ones of those spread over parts."""
        house, n = own.house, len(own.before)
        sums = np.bincount(house, own.count, n), np.bincount(house, tables, n)
        at, there = _find(self.hot, own.before)
        for total, whole in zip(sums, (self.hot_customers, self.hot_tables), strict=True):
            total[there] = whole[at[there]]
        return sums

    def dishes(self, own: Dishes, tables: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Probability of every dish in its context; ``parent`` is the root's, by word."""
        customers, total = self.houses(own, tables)
        d, s, house = self.discount[0], STRENGTH[0], own.house
        rest = (s + d * total[house]) * parent[own.word]
        return (own.count - d * tables + rest) / (s + customers[house])


def seat(rng: np.random.Generator, customers: np.ndarray, others: np.ndarray, weight: np.ndarray, d: float) -> np.ndarray:
    """Tables after seating all customers of each dish from an empty start.

    The t-th table is opened with weight others + t * weight against n - t * d for
    the tables there are.  The number of customers until the next one is a Beta
    mixture of geometric draws.
    """
    tables = np.ones(len(customers), np.int64)
    seated = np.ones(len(customers), np.int64)
    open_ = np.flatnonzero(customers > 1)
    while len(open_):
        t = tables[open_]
        p = rng.beta(np.maximum(others[open_] + t * weight[open_], 1e-300), seated[open_] - d * t)
        p = np.clip(p, 1e-15, 1 - 1e-15)
        wait = np.minimum(np.floor(np.log(rng.random(len(open_))) / np.log1p(-p)), 1e15).astype(np.int64)
        seated[open_] += wait + 1
        more = seated[open_] <= customers[open_]
        tables[open_[more]] += 1
        open_ = open_[more & (seated[open_] < customers[open_])]
    return np.minimum(tables, customers)


def sweep(rng: np.random.Generator, own: Dishes, totals: Totals, tables: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Reseat the dishes of all contexts of a part once."""
    d, p = totals.discount[0], parent[own.word]
    others = np.maximum(totals.houses(own, tables)[1][own.house] - tables, 0)
    return seat(rng, own.count, (STRENGTH[0] + d * others) * p, d * p, d)


def sweep_root(rng: np.random.Generator, totals: Totals, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
    d, p = totals.discount[1], np.full(len(customers), totals.base)
    others = np.maximum(totals.tables - tables, 0)
    return seat(rng, customers, (STRENGTH[1] + d * others) * p, d * p, d)


def _upward(place: int, own: Dishes, tables: np.ndarray, ranges: int, spread: Spread, first: bool) -> list[tuple]:
    """The tables of a part's words for the root, its own tables, and totals.

    The words themselves and their tokens are sent the first time only.
    """
    n = len(own.vocabulary)
    sent, count = np.bincount(own.word, tables, n).astype(np.int64), np.bincount(own.word, own.count, n).astype(np.int64)
    rows = [(_TABLES, place, 0, [_pack(tables)], None)]
    to = _range(own.vocabulary, ranges)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [n]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        words_too = [_pack_hashes(own.vocabulary[a:b]), _pack(count[a:b])] if first else []
        rows.append((_UP, int(to[a]), place, [_pack(sent[a:b]), *words_too], None))
    ones = [float((own.count == 1).sum()), float((own.count == 2).sum())]
    rows.append((_TOTAL, place, 0, None, [*ones, float(own.count.sum())]))
    customers, total = np.bincount(own.house, own.count, len(own.before)), np.bincount(own.house, tables, len(own.before))
    for i in np.flatnonzero(_find(spread.hot, own.before)[1]):
        rows.append((_HOT, place, int(own.before[i : i + 1].view(np.int64)[0]), None, [float(total[i]), float(customers[i])]))
    return rows


def _first(spread: Spread, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                own = Dishes.read(row["data"])
                yield from _cells(_upward(row["place"], own, np.minimum(own.count, 1), ranges, spread, True)).to_batches()

    return run


def _root_values(rows: list[dict], n: int = 2) -> np.ndarray:
    """Customers and tables (and tokens) of a part's words, from all ranges, in order."""
    cells = [r["data"] for r in sorted((r for r in rows if r["kind"] == _DOWN), key=lambda r: r["tag"])]
    return np.array([np.concatenate([_unpack(c[i]) for c in cells]) for i in range(n)])


def _swept(totals: Totals, number: int, spread: Spread, ranges: int):
    def run(written: pa.Table, sent: pa.Table) -> pa.Table:
        own, rows = Dishes.read(written.column("data")[0].as_py()), sent.to_pylist()
        place = written.column("place")[0].as_py()
        tables = _unpack(next(r["data"] for r in rows if r["kind"] == _TABLES)[0])
        values = _root_values(rows)
        rng = np.random.default_rng((number, 0, place))
        new = sweep(rng, own, totals, tables, totals.root(values[0], values[1]))
        out = _cells(_upward(place, own, new, ranges, spread, False))
        trim()
        return out

    return run


def _rooted(totals: Totals | None, number: int):
    """Reseat one range of the root's dishes and answer the parts."""

    def run(roster: pa.Table, sent: pa.Table) -> pa.Table:
        rows = sorted(roster.to_pylist(), key=lambda r: r["tag"])
        place = rows[0]["place"]
        known = [_unpack(r["data"][2]) for r in rows]
        own_words = [_hashes(r["data"][1], len(k)) for r, k in zip(rows, known, strict=True)]
        word, inverse = np.unique(np.concatenate(own_words), return_inverse=True)
        messages = sent.to_pylist()
        new = {r["tag"]: r["data"] for r in (messages if number else rows) if r["kind"] == _UP}
        customers, count = (
            np.bincount(inverse, np.concatenate(v), len(word)).astype(np.int64)
            for v in ([_unpack(new[r["tag"]][0]) for r in rows], known)
        )
        if totals is None:
            tables = np.minimum(customers, 1)
        else:
            before = _unpack(next(r["data"] for r in messages if r["kind"] == _ROOT)[0])
            tables = sweep_root(np.random.default_rng((number, 1, place)), totals, customers, before)
        sums = [customers.sum(), tables.sum(), (count > 0).sum(), (customers == 1).sum(), (customers == 2).sum()]
        out = [(_ROOT, place, 0, [_pack(tables)], [float(v) for v in sums])]
        at = 0
        for r, k in zip(rows, known, strict=True):
            own = inverse[at : at + len(k)]
            at += len(own)
            values = (customers, tables) if number else (customers, tables, count)
            out.append((_DOWN, r["tag"], place, [_pack(v[own]) for v in values], None))
        return _cells(out)

    return run


def _sums(cells: DataFrame, kind: int) -> list[float]:
    each = cells.filter(F.col("kind") == kind).select(F.posexplode("sums").alias("i", "v"))
    return [r[1] for r in sorted(each.groupBy("i").agg(F.sum("v")).collect())]


def _whole(up: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Totals of the contexts that are spread over parts: at most one a part."""
    hot = up.filter(F.col("kind") == _HOT).groupBy("tag")
    rows = hot.agg(F.sum(F.col("sums")[0]).alias("t"), F.sum(F.col("sums")[1]).alias("c")).toArrow()
    word = rows.column("tag").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(word)
    return word[order], rows.column("t").to_numpy()[order], rows.column("c").to_numpy()[order]


def _discount(one: float, two: float) -> float:
    return float(np.clip(one / (one + 2 * two), 0.1, 0.9)) if one + two else 0.5


@dataclass
class Model:
    """The parts' dishes, tokens of their words, for each sample tables, root values, totals."""

    written: DataFrame
    counts: DataFrame
    samples: list[tuple[DataFrame, DataFrame, Totals]]
    tokens: int
    words: int
    spread: Spread


def _bucketed(cells: DataFrame, parts: int) -> DataFrame:
    """Write cells once, bucketed by receiver, so that cogroups need not shuffle them."""
    spark, name = cells.sparkSession, f"lm_{uuid.uuid4().hex}"
    writer = cells.write.format("parquet").option("path", shared_path(spark, "lm-dishes")).option("compression", "zstd")
    writer.bucketBy(min(parts, 10_000), "place").saveAsTable(name)
    return spark.table(name)


def _forget(df: DataFrame) -> None:
    """Have Spark remove the shuffle files of plans that nothing refers to any more.

    Its cleaner does so after the driver's garbage collection, which may be long in coming.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def fit(texts: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES, part_tokens: int = PART_TOKENS) -> Model:
    """Sample seatings from the rows of ``texts`` (doc_id, text, train) marked ``train``.

    The words of the other rows get a place in the state, so that they can be scored.
    """
    spread = _spread(texts, part_tokens)
    ranges = max(1, spread.parts // 4)
    sent = texts.select("text", "train").mapInArrow(_cells_sent(spread), _CELL)
    written = _bucketed(sent.groupBy("place").applyInArrow(_merged, _CELL), spread.parts)
    up = materialize(written.mapInArrow(_first(spread, ranges), _CELL), "lm-up", "zstd")
    roster = _bucketed(up.filter(F.col("kind") == _UP), ranges)
    del sent
    _forget(texts)
    totals, root, counts, kept = None, None, None, []
    for number in range(burn_in + samples + 1):
        swept, asked, inbox = up, up.limit(0), None
        if number:
            inbox = up.filter(F.col("kind") == _TABLES).unionByName(root.filter(F.col("kind") == _DOWN))
            swept = written.groupBy("place").cogroup(inbox.groupBy("place")).applyInArrow(
                _swept(totals, number, spread, ranges), _CELL
            )
            swept = materialize(swept, "lm-up", "zstd")
            asked = swept.filter(F.col("kind") == _UP).unionByName(root.filter(F.col("kind") == _ROOT))
        seated = roster.groupBy("place").cogroup(asked.groupBy("place")).applyInArrow(_rooted(totals, number), _CELL)
        seated = materialize(seated, "lm-root", "zstd")
        if number and number - 1 <= burn_in:  # those before were no sample
            release(up)
            if number > 1:
                release(root)
        if not number:
            counts = seated
        up, root = swept, seated
        sums = _sums(root, _ROOT) or [0.0] * 5
        if totals is None:
            ones = _sums(up, _TOTAL) or [0.0] * 3
            discount, known, tokens = (_discount(*ones[:2]), _discount(*sums[3:])), int(sums[2]), int(ones[2])
        totals = Totals(sums[0], sums[1], discount, 1 / (known + 1), *_whole(up))
        if number > burn_in:
            kept.append((up, root, totals))
        del inbox, seated, asked
        _forget(texts)
    return Model(written, counts, kept, tokens, known, spread)


_SENT = "place int, block long, data array<binary>, keys array<long>"
_SENT_SCHEMA = pa.schema(
    [("place", pa.int32()), ("block", pa.int64()), ("data", pa.list_(pa.binary())), ("keys", pa.list_(pa.int64()))]
)


def _sent(spread: Spread):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for some in _blocks(batch):
                rows, none = [], np.zeros(some.num_rows, bool)
                for part, d in dishes(some.column("text"), none, spread):
                    # The ids travel once, with the block's first part.
                    keys = None if rows else some.column("doc_id").to_pylist()
                    d.count = d.tokens
                    rows.append({"place": part, "block": block, "data": [*d.cells(), _pack(d.doc)], "keys": keys})
                yield from pa.Table.from_pylist(rows, schema=_SENT_SCHEMA).to_batches()
                block += 1
                del rows
                trim()

    return run


_SUMS_SCHEMA = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("data", pa.list_(pa.binary())), ("keys", pa.list_(pa.int64()))])
_SUMS = "block long, place int, data array<binary>, keys array<long>"


def _scored(totals: list[Totals], tokens: int, known: int):
    def run(written: pa.Table, mixed: pa.Table) -> pa.Table:
        rows = mixed.to_pylist()
        asked_rows = [r for r in rows if r["kind"] == _ASKED]
        if not asked_rows:  # a turn may get none
            return _SUMS_SCHEMA.empty_table()
        own = Dishes.read(written.column("data")[0].as_py())
        probability = np.zeros(len(own.word))
        for i, total in enumerate(totals):
            some = [r for r in rows if r["sample"] == i]
            tables = _unpack(next(r["data"] for r in some if r["kind"] == _TABLES)[0])
            values = _root_values(some)
            probability += total.dishes(own, tables, total.root(values[0], values[1]))
        count = _root_values([r for r in rows if r["sample"] < 0], 3)[2]
        log = np.log10(probability / len(totals))
        base = np.log10((count + 0.1) / (tokens + 0.1 * (known + 1)))
        key, out = own.key, []
        del rows
        for row in asked_rows:
            asked, doc = Dishes.read(row["data"]), _unpack(row["data"][5])
            word = np.searchsorted(own.vocabulary, asked.vocabulary)[asked.word]
            house = np.searchsorted(own.before, asked.before)[asked.house]
            at = np.searchsorted(key, house * max(len(own.vocabulary), 1) + word)
            n = int(doc.max()) + 1
            sums = [np.bincount(doc, np.repeat(v, asked.count), n) for v in (log[at], base[word], count[word] > 0)]
            each = np.bincount(doc, minlength=n)
            used = np.flatnonzero(each)
            data = [_pack(used), sums[0][used].tobytes(), sums[1][used].tobytes(), _pack(sums[2][used]), _pack(each[used])]
            out.append({"block": row["tag"], "place": row["place"], "data": data, "keys": row["keys"]})
        trim()
        return pa.Table.from_pylist(out, schema=_SUMS_SCHEMA)

    return run


_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
)


def _gathered(table: pa.Table) -> pa.Table:
    """The sums of one block's texts."""
    rows = sorted(table.to_pylist(), key=lambda r: r["place"])
    keys = next(r["keys"] for r in rows if r["keys"] is not None)
    logs, base = np.zeros(len(keys)), np.zeros(len(keys))
    known, tokens = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    for r in rows:
        doc = _unpack(r["data"][0])
        logs[doc] += np.frombuffer(r["data"][1], np.float64)
        base[doc] += np.frombuffer(r["data"][2], np.float64)
        known[doc] += _unpack(r["data"][3])
        tokens[doc] += _unpack(r["data"][4])
    return pa.Table.from_arrays([pa.array(keys, pa.int64()), *map(pa.array, (tokens, known, base, logs))], schema=_RESULT)


def scored(texts: DataFrame, model: Model, part_tokens: int = PART_TOKENS) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` of every row the model was made with."""
    # One row a part: how many tasks share its texts.
    load = model.samples[0][0].filter(F.col("kind") == _TOTAL).select("place", F.col("sums")[2].alias("n"))
    tasks = {r["place"]: int(-(-r["n"] // part_tokens)) for r in load.filter(F.col("n") > 2 * part_tokens).collect()}
    of = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in tasks.items() for x in kv]), F.col("place")), F.lit(1)) if tasks else F.lit(1)
    sent = texts.select("doc_id", "text").mapInArrow(_sent(model.spread), _SENT)
    mixed = sent.select(F.lit(_ASKED).alias("kind"), "place", F.col("block").alias("tag"), "data", "keys", F.lit(-1).alias("sample"))
    told = [(model.counts, _DOWN, -1)]
    for i, (up, root, _) in enumerate(model.samples):
        told += [(up, _TABLES, i), (root, _DOWN, i)]
    for cells, kind, i in told:
        own = cells.filter(F.col("kind") == kind).select(
            "kind", "place", "tag", "data", F.lit(None).cast("array<long>").alias("keys"), F.lit(i).alias("sample")
        )
        mixed = mixed.unionByName(own)
    run = _scored([t for _, _, t in model.samples], model.tokens, model.words)
    calm = mixed.filter(of == 1) if tasks else mixed
    sums = model.written.groupBy("place").cogroup(calm.groupBy("place")).applyInArrow(_known(run), _SUMS)
    if tasks:
        turns = F.sequence(F.lit(0), of - 1)
        own = F.when(F.col("kind") == _ASKED, F.array(F.pmod(F.col("tag"), of).cast("int"))).otherwise(turns)
        busy = mixed.filter(of > 1).withColumn("turn", F.explode(own))
        copies = model.written.filter(of > 1).withColumn("turn", F.explode(turns))
        sums = sums.unionByName(copies.groupBy("place", "turn").cogroup(busy.groupBy("place", "turn")).applyInArrow(run, _SUMS))
    return sums.groupBy("block").applyInArrow(
        _gathered, "doc_id long, n_tokens long, n_known long, base_score double, score double"
    )


def _known(run):
    """Parts that are scored by several tasks are left to those."""

    def guarded(written: pa.Table, mixed: pa.Table) -> pa.Table:
        return run(written, mixed) if mixed.num_rows else _SUMS_SCHEMA.empty_table()

    return guarded


def likelihoods(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 10) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    The model learns from the rows that are not held out.  Null texts count as
    empty and have one token, the end.  Without training rows every token has the
    base probability.  Repeated rows are learnt and scored one by one; other columns
    are ignored; an empty table gives an empty result.  Texts of any length are whole:
    one longer than a block is a block of its own.
    """
    own = F.col(key).cast("long")
    texts = docs.select(
        own.alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        (~held_out(own, folds)).alias("train"),
    )
    model = fit(texts)
    return scored(texts, model).select(
        "doc_id",
        held_out(F.col("doc_id"), folds).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
