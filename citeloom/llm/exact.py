"""Exact deduplication by deterministic block naming, in DataFrame functions only.

The normalised text is cut into fixed-size byte blocks.  Distinct blocks are
sorted and numbered; then adjacent numbers are paired, distinct pairs sorted and
numbered, level by level, until a text is one number.  Two texts share level and
number if and only if their bytes are equal: names stand for contents compared in
full, not for digests.

Block contents are shuffled once, and only distinct per map task.  The 64-bit
hash of a block merely says where its name is looked up; blocks that share a hash
without being equal are found by counting and looked up by content.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.session import materialize

#: Runs of white space that count as one space.
WHITE = r"[\x20\x09-\x0D]+"

#: Bytes of a block.
BLOCK = 2048


def normalised(text: Column) -> Column:
    """Text with white space collapsed; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE, " ")


def _blocks(body: str, block: int) -> Column:
    """Consecutive blocks of a binary column; an empty text is one empty block."""
    last = F.greatest(F.lit(0), F.floor((F.length(body) - 1) / F.lit(block))).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.substring(F.col(body), i * F.lit(block) + F.lit(1), F.lit(block)),
    )


def _numbered(distinct: DataFrame, *by: str) -> DataFrame:
    """Sort distinct rows within their hash partitions and number them."""
    return distinct.sortWithinPartitions(*by).select(*by, F.monotonically_increasing_id().alias("name"))


def exact_groups(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    block: int = BLOCK,
    place: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of rows with equal normalised texts the one with the smallest key stays; a
    null key stays only where the group has no other, and of rows equal in key and
    text one stays.  A null text counts as empty, and empty texts are one group.
    An empty table gives an empty result; other columns are ignored.

    ``place`` spreads blocks over name partitions; any function is right.
    """
    bodies = docs.select(
        F.col(key).alias("doc_id"), F.encode(normalised(F.col(text)), "UTF-8").alias("body")
    )
    rows = materialize(
        bodies.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.sha2("body", 256).alias("text_sha256"),
            F.transform(_blocks("body", block), lambda b: place(b)).alias("at"),
        ),
        "exact-rows",
    )
    contents = bodies.select(F.explode(_blocks("body", block)).alias("block")).select(
        place(F.col("block")).alias("at"), "block"
    )
    names = materialize(_numbered(contents.distinct(), "at", "block").drop("block"), "exact-names")
    shared = names.groupBy("at").agg(F.count("*").alias("n")).filter("n > 1").select("at")
    steps = rows.select(
        "row", F.size("at").alias("n"), F.posexplode("at").alias("pos", "at")
    )
    level = steps.join(names.join(shared, "at", "left_anti"), "at").select("row", "n", "pos", "name")
    if not shared.isEmpty():
        level = level.unionByName(_by_content(bodies, rows, steps, contents, shared, block))
    level = materialize(level, "exact-level")
    done = level.filter("n = 1").select("row", F.lit(0).alias("level"), "name")
    longest, depth = level.agg(F.max("n")).first()[0] or 0, 0
    while longest > 1:
        depth, longest = depth + 1, (longest + 1) // 2
        pairs = materialize(
            level.filter("n > 1")
            .groupBy("row", "n", F.expr("pos div 2").alias("pos"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                # -1 closes an odd tail; names start at 0.
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
            )
            .select("row", F.expr("int((n + 1) div 2)").alias("n"), F.col("pos"), "left", "right"),
            "exact-pairs",
        )
        names = materialize(_numbered(pairs.select("left", "right").distinct(), "left", "right"), "exact-names")
        level = materialize(
            pairs.join(names, ["left", "right"]).select("row", "n", "pos", "name"), "exact-level"
        )
        done = done.unionByName(level.filter("n = 1").select("row", F.lit(depth).alias("level"), "name"))
    named = rows.select("row", "doc_id", "text_sha256").join(done, "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    groups = named.groupBy("level", "name").agg(first.alias("keep"), F.count("*").alias("group_size"))
    return named.join(groups, ["level", "name"]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        "text_sha256",
    )


def _by_content(
    bodies: DataFrame, rows: DataFrame, steps: DataFrame, contents: DataFrame, shared: DataFrame, block: int
) -> DataFrame:
    """Names of blocks whose hash is not theirs alone, looked up by content.

    They are numbered below -1, apart from the other names.
    """
    own = materialize(
        contents.join(shared, "at", "left_semi")
        .distinct()
        .sortWithinPartitions("at", "block")
        .select("block", (F.lit(-2) - F.monotonically_increasing_id()).alias("name")),
        "exact-shared",
    )
    touched = steps.join(shared, "at", "left_semi").select("row", "n", "pos")
    texts = bodies.select("doc_id", F.sha2("body", 256).alias("text_sha256"), "body").dropDuplicates(
        ["doc_id", "text_sha256"]
    )
    keyed = touched.join(rows.select("row", "doc_id", "text_sha256"), "row")
    same = (keyed["text_sha256"] == texts["text_sha256"]) & keyed["doc_id"].eqNullSafe(texts["doc_id"])
    cut = keyed.join(texts, same).select(
        "row", "n", "pos", F.expr(f"substring(body, pos * {int(block)} + 1, {int(block)})").alias("block")
    )
    return cut.join(own, "block").select("row", "n", "pos", "name")
