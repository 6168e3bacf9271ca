"""Groups of texts whose five-word shingles overlap: fingerprints, then an exact join.

Two texts are linked if the Jaccard similarity of their shingle sets is 4/5 or more.
Operator 1's fingerprints, of five words here, come first: what its anchors link is
verified with the whole sets.  They do not reach all pairs of that similarity; an exact
set-similarity join finds the rest, between texts that they leave apart.

Linked sets of sizes m and n share one of the first n - ceil(4n/5) + 1 shingles of each
in any order common to all, so texts meet at those.  The order puts shingles that are
frequent in a sample last; it decides how many texts meet, not which are linked.

Where few texts meet, their pairs of fitting sizes are noted, each once however many
shingles it meets at; larger meetings are named by their members, so that one of many
shingles with the same members is left.  Only then are texts compared by the parities of
their shingles in as many classes as they have shingles, 2048 at least: sets differ in at
least as many shingles as parities differ, and linked sets in at most (m + n) / 9.  Of
two numbers of classes, both powers of two, the larger is folded to the smaller.  What is left is verified with the whole
sets, in two rounds: first the pairs and a forest of each larger meeting, then the pairs
of those meetings whose members the verified links leave apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm import simhash
from citeloom.llm.components import components
from citeloom.llm.simhash import _join, shingle_hashes
from citeloom.llm.textscan import mix
from citeloom.session import materialize, release

WORDS = 5
#: Texts of the sample, on average, and the number that makes a shingle frequent.
SAMPLE_TEXTS, FREQUENT = 4000, 3
#: Texts of the largest meeting that is noted as pairs.
FEW = 8
#: Texts of one meeting that are compared in one cell, on average.
CELL = 4096
#: Nodes that are broadcast to choose texts; more are joined by a shuffle of the texts.
BROADCAST_NODES = 1 << 20


def shingles(text: bytes) -> np.ndarray:
    """The sorted set of a text's shingles; texts without words share one."""
    found = list(shingle_hashes(text, WORDS))
    return np.unique(np.concatenate(found)) if found else np.zeros(1, np.uint64)


def prefix(n: int) -> int:
    """How many of n shingles meet those of other texts."""
    return n - (4 * n + 4) // 5 + 1


def node(text: str = "text") -> Column:
    """Equal texts are one node; a null text counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for batch in batches:
        yield batch.column("node"), [shingles((t.as_py() or "").encode()) for t in batch.column("text")]


def parities(shingle: np.ndarray) -> bytes:
    """Whether each class holds an odd number of the shingles, in bits."""
    classes = max(2048, 1 << (len(shingle) - 1).bit_length())
    place = (shingle & np.uint64(classes - 1)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=classes) & 1).tobytes()


def _folded(odd: list[bytes], size: int) -> np.ndarray:
    """Parities in ``size`` bytes, a row each; they have as many or a power of two more."""
    out = np.empty((len(odd), size // 8), np.uint64)
    for i, o in enumerate(odd):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(o, np.uint64).reshape(-1, size // 8), axis=0)
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for nodes, sets in _sets(batches):
        sizes = pa.array(np.array([len(s) for s in sets], np.int32))
        yield pa.RecordBatch.from_arrays(
            [nodes, sizes, pa.array([parities(s) for s in sets], pa.binary())], names=["node", "n", "odd"]
        )


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for nodes, sets in _sets(batches):
        offsets = np.cumsum([0, *map(len, sets)], dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [nodes, pa.ListArray.from_arrays(pa.array(offsets), _signed(np.concatenate(sets or [np.zeros(0, np.uint64)])))],
            names=["node", "whole"],
        )


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, sets in _sets(batches):
        yield pa.RecordBatch.from_arrays([_signed(np.concatenate([np.zeros(0, np.uint64), *sets]))], names=["shingle"])


def _firsts(frequent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = frequent.value
        for nodes, sets in _sets(batches):
            chosen = [np.zeros(0, np.uint64)]
            for s in sets:
                last = late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s if len(late) else np.zeros(len(s), bool)
                chosen.append(np.concatenate([s[~last], s[last]])[: prefix(len(s))])
            many = [len(c) for c in chosen[1:]]
            owner = np.repeat(nodes.to_numpy(zero_copy_only=False), many)
            size = np.repeat(np.array([len(s) for s in sets], np.int32), many)
            yield pa.RecordBatch.from_arrays(
                [_signed(np.concatenate(chosen)), pa.array(owner, pa.int64()), pa.array(size)], names=["shingle", "node", "n"]
            )

    return run


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Columns of whole runs of equal keys, and where each run begins."""
    held: pa.Table | None = None

    def cut(table: pa.Table):
        rows = {c: table.column(c).to_numpy() for c in table.column_names}
        new = np.ones(table.num_rows, bool)
        if table.num_rows:
            new[1:] = np.any([rows[k][1:] != rows[k][:-1] for k in keys], axis=0)
        return rows, np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        rows, starts = cut(held)
        if len(starts) > 1:
            at = int(starts[-1])
            yield {c: v[:at] for c, v in rows.items()}, starts[:-1]
            held = held.slice(at)
    if held is not None:
        yield cut(held)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Meetings of the runs of a shingle: pairs ``node, other`` where few meet, else
    rows of ``meeting, node``, the meeting named by its members."""
    for rows, starts in _runs(batches, ["shingle"]):
        key, own, n = rows["shingle"], rows["node"], rows["n"].astype(np.int64)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
        size = np.add.reduceat(new.astype(np.int64), starts)
        size = np.repeat(size, np.diff(np.append(starts, len(key))))[new]
        key, own, n = key[new], own[new], n[new]
        few = np.flatnonzero((size > 1) & (size <= FEW))
        found = [np.zeros((0, 2), np.int64)]
        for step in range(1, FEW):
            a = few[few + step < len(key)]
            a = a[(key[a] == key[a + step]) & (9 * np.abs(n[a] - n[a + step]) <= n[a] + n[a + step])]
            found.append(np.stack([own[a], own[a + step]], axis=1))
        # Members are sorted, so a pair reads the same at each of its shingles.
        pairs = np.unique(np.concatenate(found), axis=0)
        large = size > FEW
        begins = np.flatnonzero(np.diff(key[large], prepend=~key[large][:1]))
        name = np.zeros(0, np.uint64)
        if len(begins):
            many = np.diff(np.append(begins, int(large.sum())))
            hashed = mix(own[large].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            name = np.repeat(mix(np.add.reduceat(hashed, begins) ^ many.astype(np.uint64)), many)
        empty = pa.nulls(len(pairs), pa.int64()), pa.nulls(len(name), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([empty[0], _signed(name)]),
                pa.concat_arrays([pa.array(pairs[:, 0]), pa.array(own[large])]),
                pa.concat_arrays([pa.array(pairs[:, 1]), empty[1]]),
            ],
            names=["meeting", "node", "other"],
        )


def _close(n: np.ndarray, odd: np.ndarray, a, b) -> np.ndarray:
    """Whether size and parities allow a link."""
    most = n[a] + n[b]
    apart = np.bitwise_count(odd[a] ^ odd[b]).sum(axis=-1, dtype=np.int64)
    return (9 * apart <= most) & (9 * np.abs(n[a] - n[b]) <= most)


def _meeting(
    n: np.ndarray, odd: np.ndarray, label: np.ndarray, folded: np.ndarray, forest: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different labels that may be linked, all or a forest that joins them;
    two whose parities both are folded are left to their own number of classes."""
    _, first, own = np.unique(label, return_index=True, return_inverse=True)
    parent = first[own]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i in range(0, len(n), 128):
        rows = np.arange(i, min(i + 128, len(n)))
        for j in range(i, len(n), 512):
            columns = np.arange(j, min(j + 512, len(n)))
            near = (parent[rows][:, None] != parent[columns][None, :]) & (rows[:, None] < columns[None, :])
            near &= ~(folded[rows][:, None] & folded[columns][None, :])
            if not near.any():
                continue
            near &= _close(n, odd, rows[:, None], columns[None, :])
            if not forest:
                r, c = np.nonzero(near)
                found.append((rows[r], columns[c]))
            while forest and near.any():
                r, c = near.any(axis=1), near.any(axis=0)
                a = np.concatenate([rows[r], rows[near[:, c].argmax(axis=0)]])
                b = np.concatenate([columns[near[r].argmax(axis=1)], columns[c]])
                found.append((a, b))
                parent = _join(parent, a, b)
                near &= parent[rows][:, None] != parent[columns][None, :]
    a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1))
    return a, b


def _pairs(forest: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((0, 2), np.int64)
        for rows, starts in _runs(batches, ["meeting", "i", "j"]):
            own, n, label = rows["node"], rows["n"].astype(np.int64), rows["label"]
            odd = rows["odd"]
            wide = np.array([len(o) for o in odd], np.int64)
            size = np.diff(np.append(starts, len(own)))
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for at, m in zip(starts[size > 1].tolist(), size[size > 1].tolist(), strict=True):
                here = wide[at : at + m]
                for w in np.unique(here).tolist():
                    # Linked sizes are of one number of classes or of two that adjoin.
                    of = np.flatnonzero((here == w) | (here == 2 * w)) + at
                    if len(of) < 2:
                        continue
                    x, y = _meeting(n[of], _folded([odd[i] for i in of.tolist()], w), label[of], wide[of] > w, forest)
                    a.append(of[x])
                    b.append(of[y])
            a, b = own[np.concatenate(a)], own[np.concatenate(b)]
            seen = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(seen[:, 0]), pa.array(seen[:, 1])], names=["a", "b"])

    return run


def _fitting(n: pa.Array, m: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
    """Whether sizes and parities of pairs allow a link."""
    out = []
    for most, a, b in zip((n.to_numpy().astype(np.int64) + m.to_numpy()).tolist(), x.to_pylist(), y.to_pylist(), strict=True):
        one, other = _folded([a, b], min(len(a), len(b)))
        out.append(9 * int(np.bitwise_count(one ^ other).sum()) <= most)
    return pa.array(out, pa.bool_())


def _verified(texts: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """The pairs ``a, b`` whose whole sets are linked."""
    pairs = materialize(pairs.distinct(), f"{name}-pairs")
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    asked_rows = materialize(asked, f"{name}-asked")
    asked = F.broadcast(asked_rows) if asked_rows.count() <= BROADCAST_NODES else asked_rows
    needed = texts.join(asked, "node", "left_semi").dropDuplicates(["node"])
    sets = materialize(needed.mapInArrow(_whole, "node long, whole array<long>"), f"{name}-sets")
    # Row by row in the JVM: a Python batch would hold thousands of whole sets.
    both = F.size(F.array_intersect("x", "y"))
    one = sets.select(F.col("node").alias("a"), F.col("whole").alias("x"))
    other = sets.select(F.col("node").alias("b"), F.col("whole").alias("y"))
    found = pairs.join(one, "a").join(other, "b").filter(9 * both >= 4 * (F.size("x") + F.size("y"))).select("a", "b")
    found = materialize(found, f"{name}-links")
    for written in (sets, asked_rows, pairs):
        release(written)
    return found


def fingerprinted(texts: DataFrame) -> DataFrame:
    """Verified links ``a, b`` of what operator 1's anchors link: texts of one
    fingerprint, and the first texts of linked fingerprints."""
    rows = simhash.fingers(texts, "node", k=WORDS).withColumnRenamed("doc_id", "node").distinct()
    rows = materialize(rows, "overlap-fingers")
    firsts = materialize(rows.groupBy("finger").agg(F.min("node").alias("first")), "overlap-firsts")
    edges = simhash.links(firsts.select("finger"))
    for end in ("a", "b"):
        of = firsts.select(F.col("finger").alias(end), F.col("first").alias(f"{end}_first"))
        edges = edges.join(of, end)
    same = rows.join(firsts, "finger").select(F.col("first").alias("a"), F.col("node").alias("b"))
    both = edges.select(F.col("a_first").alias("a"), F.col("b_first").alias("b")).union(same).filter("a <> b")
    found = _verified(texts, both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "overlap-fingered")
    for written in (rows, firsts):
        release(written)
    return found


def links(docs: DataFrame, text: str = "text", cell: int = CELL, sample: int = SAMPLE_TEXTS) -> DataFrame:
    """Edges ``a, b`` with the components of the links between different texts."""
    texts = docs.select(node(text).alias("node"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    near = fingerprinted(texts)
    known = materialize(components(near).withColumnRenamed("root", "label"), "overlap-known")
    share = max(1, docs.count() // sample)
    some = texts.filter(F.pmod(F.xxhash64("node"), F.lit(share)) == 0).dropDuplicates(["node"])
    often = some.mapInArrow(_each, "shingle long").groupBy("shingle").count().filter(F.col("count") >= FREQUENT)
    late = np.sort(often.select("shingle").toArrow().column(0).to_numpy().view(np.uint64))
    frequent = docs.sparkSession.sparkContext.broadcast(late)

    firsts = texts.mapInArrow(_firsts(frequent), "shingle long, node long, n int")
    dealt = firsts.repartition("shingle").sortWithinPartitions("shingle", "node")
    shared = dealt.mapInArrow(_shared, "meeting long, node long, other long")
    shared = materialize(shared.distinct(), "overlap-shared")
    apart = shared.filter("meeting IS NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))
    members = shared.filter("meeting IS NOT NULL").select("meeting", "node")

    signed = texts.mapInArrow(_signatures, "node long, n int, odd binary")
    met = shared.select("node").union(shared.filter("meeting IS NULL").select("other")).distinct()
    signed = materialize(signed.dropDuplicates(["node"]).join(met, "node", "left_semi"), "overlap-signatures")
    one = signed.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("odd").alias("x"))
    other = signed.select(F.col("node").alias("b"), "n", F.col("odd").alias("y"))
    fitting = F.arrow_udf(_fitting, "boolean")
    apart = apart.join(one, "a").join(other, "b").filter(fitting("n", "m", "x", "y")).select("a", "b")
    for end in ("a", "b"):
        apart = apart.join(known.toDF(end, f"{end}_label"), end, "left")
    apart = apart.filter("coalesce(a_label, a) <> coalesce(b_label, b)").select("a", "b")

    # Rows divided by the cell at most.
    large = members.groupBy("meeting").count().filter(F.col("count") > cell)
    large = large.select("meeting", F.ceil(F.col("count") / cell).cast("int").alias("blocks"))

    def pairs(rows: DataFrame, forest: bool) -> DataFrame:
        """Pairs of the meetings; ``rows`` are meeting, node and label."""
        blocks = F.coalesce("blocks", F.lit(1))
        spread = rows.join(F.broadcast(large), "meeting", "left").select(
            "meeting", "node", "label", F.pmod(F.xxhash64("node", "meeting"), blocks).cast("int").alias("mine"),
            F.explode(F.sequence(F.lit(0), blocks - 1)).alias("meets"),
        )
        placed = spread.select(
            "meeting", "node", "label", F.least("mine", "meets").alias("i"), F.greatest("mine", "meets").alias("j")
        ).join(signed, "node")
        dealt = placed.repartition("meeting", "i", "j").sortWithinPartitions("meeting", "i", "j")
        return dealt.mapInArrow(_pairs(forest), "a long, b long")

    def named_by(roots: DataFrame) -> DataFrame:
        return members.join(roots, "node", "left").select("meeting", "node", F.coalesce("label", "node").alias("label"))

    first = near.unionByName(_verified(texts, apart.union(pairs(named_by(known), True)), "overlap-first"))
    named = named_by(components(first).withColumnRenamed("root", "label"))
    # Most meetings are of one label by now.
    open_ = named.groupBy("meeting").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    second = _verified(texts, pairs(named.join(open_.select("meeting"), "meeting", "left_semi"), False), "overlap-second")
    for written in (shared, signed, known):
        release(written)
    frequent.unpersist()
    return first.unionByName(second)


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, node, component_id, root`` of every row; component_id is the smallest
    id that links reach, null if all are."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), node(text).alias("node"))
    least = rows.groupBy("node").agg(F.min("doc_id").alias("first"))
    rooted = least.join(components(links(docs, text)), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(rooted.select("node", "root").join(named, "root"), "node")


def kept_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group: of the smallest id, nulls last, and then any one of the
    rows that share it.  Columns are those of ``docs``."""
    found = groups(docs, key, text)
    counted = found.groupBy("root", "doc_id", "node").agg(F.count("*").alias("rows"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "rows"))
    kept = counted.groupBy("root").agg(best.alias("best")).select(
        "root", F.col("best.doc_id").alias("id"), F.col("best.node").alias("of"), "best.rows"
    )
    # Names of their own, so that no column of the documents is meant.
    kept = materialize(kept.toDF(*[f"_kept_{c}" for c in kept.columns]), "overlap-kept")
    own = docs[key].cast("long").eqNullSafe(F.col("_kept_id")) & (node(text) == F.col("_kept_of"))
    single = docs.join(kept.filter("_kept_rows = 1"), own, "left_semi")
    repeated = docs.join(kept.filter("_kept_rows > 1"), own)
    place = F.row_number().over(Window.partitionBy("_kept_root").orderBy(F.lit(0)))
    one = repeated.withColumn("_kept_place", place).filter("_kept_place = 1")
    return single.unionByName(one.select(*[F.col(f"`{c}`") for c in docs.columns]))
