"""Document versions: fingerprints, similarity, promotion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from citeloom.functions.text import shingles
from citeloom.operators.joins import first_rows, join_small, row_bound, unnest
from citeloom.session import materialize, settle

SIMILARITY = 0.20
#: Characters of a shingle.
SHINGLE = 5
#: Bytes of a family's texts that are compared in one group; two such blocks at most meet.
BLOCK_BYTES = 8 << 20
#: Holders of shingles that are counted at once.
HELD = 1 << 21


def content_hash(df: DataFrame, column: str = "content") -> DataFrame:
    return df.withColumn("content_hash", F.sha2(F.col(column).cast("binary"), 256))


def duplicate_of(docs: DataFrame, keys: list[str], hash_col: str = "content_hash") -> DataFrame:
    """First document with the same fingerprint; unchanged copies point at it.

    ``min`` per fingerprint is a partial aggregate, so a group of copies that
    holds much of the table shrinks before the shuffle; the join back is skewed
    by the same group and left to adaptive splitting.
    """
    firsts = docs.groupBy(*keys, hash_col).agg(
        F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")
    )
    return docs.join(firsts.filter("copies > 1"), [*keys, hash_col], "left").withColumn(
        "action",
        F.when(F.col("first_doc") < F.col("doc_id"), "unchanged").otherwise("created"),
    )


def shingle_sets(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted shingle set of every document with its size and signature."""
    sets = docs.select(*keys, "doc_id", F.sort_array(shingles("text", SHINGLE)).alias("set"))
    return sets.withColumns(
        {"n": F.size("set"), "sig": F.xxhash64("set"), "sig2": F.hash("set")}
    )


def distinct_sets(sets: DataFrame, keys: list[str]) -> DataFrame:
    """One row per non-empty distinct set of a family, with its smallest document."""
    firsts = (
        sets.filter("n > 0")
        .groupBy(*keys, "n", "sig", "sig2")
        .agg(F.min("doc_id").alias("rep"))
    )
    return firsts


def similar_earlier(
    docs: DataFrame, keys: list[str], threshold: float = SIMILARITY, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Most similar earlier document of the same family, for every document.

    A shingle set travels once, as one text, to the task that compares its family, and
    only ids and similarities come back.  The comparison is exact, on the shingles
    themselves.  A family larger than a block is cut into blocks by document, and every
    two blocks meet in a group of their own: no task holds more than two blocks, and
    only the sets of such families travel more than once.

    Copies collapse to one representative set: later members match the first member
    with similarity one and take no part in the comparison.

    Output: doc_id, best_doc, similarity (NULL without a match at ``threshold``).
    """
    known = docs.dropna(subset=keys)
    size = F.sum(F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    sizes = known.groupBy(*keys).agg(size.alias("bytes")).filter(F.col("bytes") > block_bytes)
    large = settle(sizes.select(*keys, F.ceil(F.col("bytes") / block_bytes).cast("int").alias("blocks")))
    sets = join_small(shingle_sets(known, keys), large, keys, "left", rows=row_bound(large))
    dealt = sets.select(
        *keys, "doc_id", "n", "sig", "sig2", F.array_join("set", "").alias("shingles"),
        F.coalesce("blocks", F.lit(1)).alias("blocks"),
    ).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    met = met.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other")
    kind = docs.schema["doc_id"].dataType
    schema = StructType(
        [docs.schema[k] for k in keys]
        + [StructField("doc_id", kind), StructField("n", IntegerType()), StructField("sig", LongType()), StructField("sig2", IntegerType())]
        + [StructField("member", BooleanType()), StructField("near", kind), StructField("similarity", DoubleType())]
    )
    found = met.groupBy(*keys, "low", "high").applyInArrow(_nearest([*keys, "doc_id", "n", "sig", "sig2"], threshold), schema)
    found = materialize(found, "nearest")
    members = found.filter("member").select(*keys, "doc_id", "n", "sig", "sig2")
    reps = distinct_sets(members, keys)
    checked = (
        found.filter("near IS NOT NULL")
        .join(reps, [*keys, "n", "sig", "sig2"])
        .filter("rep = doc_id")
        .select(*keys, "doc_id", "near", "similarity")
    )
    best = first_rows(checked, [*keys, "doc_id"], [F.desc("similarity"), F.asc("near")], 1)
    matched = (
        members.join(reps, [*keys, "n", "sig", "sig2"], "left")
        .join(best, [*keys, "doc_id"], "left")
        .select(
            *keys,
            "doc_id",
            F.when(F.col("rep") < F.col("doc_id"), F.col("rep")).otherwise(F.col("near")).alias(
                "best_doc"
            ),
            F.when(F.col("rep") < F.col("doc_id"), F.lit(1.0))
            .otherwise(F.col("similarity"))
            .alias("similarity"),
        )
    )
    # Documents without a family match nothing.
    apart = docs.filter(~F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)))
    return matched.unionByName(
        apart.select(
            *keys, "doc_id", F.lit(None).cast(kind).alias("best_doc"), F.lit(None).cast("double").alias("similarity")
        )
    )


def _nearest(columns: list[str], threshold: float):
    """Group function: every document of one block, or of two blocks, with the most
    similar earlier one; of two blocks, the most similar one of the other."""

    def of_group(table: pa.Table) -> pa.Table:
        doc = table["doc_id"].combine_chunks()
        rank = pc.rank(doc, tiebreaker="dense").to_numpy().astype(np.int64)
        rows = np.argsort(rank, kind="stable")
        rows = rows[~doc.is_null().to_numpy(zero_copy_only=False)[rows]]
        # The first of equal sets stands for them.
        marks = list(zip(*(table[c].to_pylist() for c in ("n", "sig", "sig2")), strict=True))
        seen: set[tuple[int, int, int]] = set()
        rows = np.array([i for i in rows if marks[i][0] and not (marks[i] in seen or seen.add(marks[i]))], np.int64)
        block = table["block"].to_numpy()
        apart = bool(table.num_rows) and table["low"][0].as_py() != table["high"][0].as_py()
        near, similarity = np.full(table.num_rows, -1, np.int64), np.zeros(table.num_rows)
        if len(rows) > 1:
            sizes = table["n"].to_numpy()[rows].astype(np.int64)
            codes = _shingle_codes(table["shingles"].take(pa.array(rows)), sizes)
            for b, counts in _common(codes, sizes):
                ok = rank[rows[:b]] < rank[rows[b]]
                if apart:
                    ok &= block[rows[:b]] != block[rows[b]]
                alike = np.where(ok, counts / (sizes[:b] + sizes[b] - counts), 0.0)
                a = int(alike.argmax())
                if alike[a] >= threshold and alike[a] > 0:
                    near[rows[b]], similarity[rows[b]] = rows[a], alike[a]
        none = near < 0
        out = pa.table(
            {c: table[c] for c in columns}
            | {
                "member": pa.array(np.full(table.num_rows, not apart)),
                "near": doc.take(pa.array(near, mask=none)),
                "similarity": pa.array(similarity, mask=none),
            }
        )
        return out.filter(pa.array(~none)) if apart else out

    return of_group


def _shingle_codes(texts: pa.ChunkedArray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all sets in order as two numbers each, which tell all shingles apart.

    A code point has 21 bits.  A text shorter than a shingle is one; its end is filled
    up with a number beyond all code points.
    """
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    lengths = pc.utf8_length(texts).to_numpy().astype(np.int64)
    if (lengths != SHINGLE * sizes).any():
        filled = np.full(SHINGLE * int(sizes.sum()), 0x110000, np.uint32)
        shift = SHINGLE * (np.cumsum(sizes) - sizes) - (np.cumsum(lengths) - lengths)
        filled[np.repeat(shift, lengths) + np.arange(len(points))] = points
        points = filled
    c = points.reshape(-1, SHINGLE).T.astype(np.uint64)
    return c[0] << np.uint64(42) | c[1] << np.uint64(21) | c[2], c[3] << np.uint64(21) | c[4]


def _common(codes: tuple[np.ndarray, np.ndarray], sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For every set, but those that share nothing, its common shingles with each before it."""
    one, two = codes

    def starts(order: np.ndarray, *parts: np.ndarray) -> np.ndarray:
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([p[order[1:]] != p[order[:-1]] for p in parts])
        return new

    mixed = one * np.uint64(0x9E3779B97F4A7C15) + two * np.uint64(0xC2B2AE3D27D4EB4F)
    order = np.argsort(mixed, kind="stable")
    new = starts(order, one, two)
    if new.sum() != starts(order, mixed).sum():  # shingles of one sum may lie mixed up
        order = np.lexsort((two, one))
        new = starts(order, one, two)
    # Sets that hold a shingle, in order, lie together; the first of them at ``head``.
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    holder = np.repeat(np.arange(len(sizes)), sizes)[order]
    heads, before = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    heads[order], before[order] = head, np.arange(len(order)) - head
    ends = np.cumsum(sizes)
    for b in range(1, len(sizes)):
        part = slice(ends[b] - sizes[b], ends[b])
        first, many = heads[part], before[part]
        first, many = first[many > 0], many[many > 0]
        if not len(many):
            continue
        upto = np.cumsum(many)
        counts = np.zeros(b, np.int64)
        # Bounded slices: a shingle is held by as many sets as lie before at most.
        cuts = [0, *np.flatnonzero(np.diff(upto // HELD)) + 1, len(many)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            m = many[i:j]
            at = np.repeat(first[i:j] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            counts += np.bincount(holder[at], minlength=b)
        yield b, counts


def jaccard(a: str = "set_a", b: str = "set_b"):
    """Jaccard similarity of two set columns; zero when either is empty."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common / union)


def match_candidates(
    incoming: DataFrame, stored: DataFrame, threshold: float = SIMILARITY
) -> DataFrame:
    """Update decision for incoming files against active stored documents.

    ``incoming``: file_id, course_id, path, content_hash, logical_name, text.
    ``stored``: doc_id, course_id, path, content_hash, logical_name, text,
    version_number, is_active.  Order of the rules: unchanged content, same
    path, best similarity among documents of the same name, new document.
    Only the chosen document is superseded.
    """
    live = stored.filter("is_active")
    same = live.groupBy("course_id", "content_hash").agg(F.max("doc_id").alias("same_doc"))
    at_path = live.groupBy("course_id", "path").agg(F.max("doc_id").alias("path_doc"))
    staged = incoming.join(same, ["course_id", "content_hash"], "left").join(
        at_path, ["course_id", "path"], "left"
    )
    open_ = staged.filter("same_doc IS NULL AND path_doc IS NULL").select(
        "file_id", "course_id", "logical_name", shingles("text").alias("set_a")
    )
    # Shingle-wise counting: a pair exists only through a common shingle.
    a = unnest(
        open_, "set_a", "shingle", "file_id", "course_id", "logical_name", F.size("set_a").alias("na")
    )
    s = live.select("doc_id", "course_id", "logical_name", shingles("text").alias("set_b"))
    b = unnest(
        s, "set_b", "shingle", "doc_id", "course_id", "logical_name", F.size("set_b").alias("nb")
    )
    scored = (
        a.join(b, ["course_id", "logical_name", "shingle"])
        .groupBy("file_id", "doc_id", "na", "nb")
        .agg(F.count("*").alias("common"))
        .withColumn("sim", F.col("common") / (F.col("na") + F.col("nb") - F.col("common")))
    )
    best = first_rows(scored, ["file_id"], [F.desc("sim"), F.desc("doc_id")], 1).select(
        "file_id", F.col("doc_id").alias("near_doc"), "sim"
    )
    out = staged.join(best, "file_id", "left")
    near = F.when(F.col("sim") >= threshold, F.col("near_doc"))
    previous = F.coalesce(F.col("path_doc"), near)
    return out.select(
        "file_id",
        "course_id",
        F.when(F.col("same_doc").isNotNull(), "unchanged")
        .when(previous.isNotNull(), "updated")
        .otherwise("created")
        .alias("action"),
        F.when(F.col("same_doc").isNull(), previous).alias("previous_doc_id"),
        F.when(F.col("same_doc").isNull() & F.col("path_doc").isNotNull(), F.lit(1.0))
        .when(F.col("same_doc").isNull(), F.col("sim"))
        .alias("similarity"),
        F.col("same_doc").alias("doc_id"),
    )


def promote_versions(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply (old_doc, new_doc) pairs: retire the old row, activate the new one.

    Both sides of a pair are looked up by key, so a version chain is a pair of
    equality joins whatever its length.
    """
    old = changes.select(F.col("old_doc").alias("doc_id"), F.col("new_doc").alias("__next"))
    new = changes.join(
        docs.select(F.col("doc_id").alias("old_doc"), F.col("version_number").alias("__v")),
        "old_doc",
    ).select(F.col("new_doc").alias("doc_id"), F.col("old_doc").alias("__prev"), "__v")
    out = docs.join(old, "doc_id", "left").join(new, "doc_id", "left")
    gone, fresh = F.col("__next").isNotNull(), F.col("__prev").isNotNull()
    return out.withColumns(
        {
            "is_active": F.when(gone, False).when(fresh, True).otherwise(F.col("is_active")),
            "status": F.when(gone, "superseded").when(fresh, "done").otherwise(F.col("status")),
            "version_number": F.when(
                fresh, F.coalesce(F.col("__v"), F.lit(1)) + 1
            ).otherwise(F.col("version_number")),
            "previous_doc_id": F.coalesce("__prev", "previous_doc_id"),
            "superseded_by": F.coalesce("__next", "superseded_by"),
        }
    ).drop("__next", "__prev", "__v")


def version_chain(docs: DataFrame, family: list[str], order: str) -> DataFrame:
    """Version number and neighbours of every document of a family by order."""
    from citeloom.operators.ordered import carry_last, running_count

    numbered = running_count(docs, family, order, "version_number")
    linked = carry_last(numbered, family, order, F.col("doc_id"), "previous_doc_id")
    follow = linked.filter("previous_doc_id IS NOT NULL").select(
        F.col("previous_doc_id").alias("doc_id"), F.col("doc_id").alias("superseded_by")
    )
    return linked.join(follow, "doc_id", "left").withColumn(
        "is_active", F.col("superseded_by").isNull()
    )
