"""Mixing sources to target weights with hash-threshold histograms.

Every document has a 60-bit key that depends on its id and text alone.  A source
whose target is c times its size and a rest takes each document c times, and once
more those with a key below a threshold at which their words reach the rest.  The
threshold is found without sorting: words are summed by source and the key's next
12 bits, the bucket in which the sum passes the rest becomes the only one that is
split further.  Rounds end when every open bucket holds one key.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.session import materialize

#: Bits of a key, and of one round's buckets: at most 4096 sums a source.
KEY_BITS, ROUND_BITS = 60, 12

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2

#: Sources up to which their thresholds are broadcast; more are joined.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Words of a text, runs of other than white space; null has none."""
    parts = F.split(F.translate(text, "\t\n\u000b\u000c\r", "     "), " +")
    return F.coalesce(F.size(F.filter(parts, lambda w: w != "")).cast("long"), F.lit(0).cast("long"))


def mix_key(key: Column, text: Column) -> Column:
    """60 bits of the digest of id and text."""
    whole = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, KEY_BITS // 4), 16, 10).cast("long")


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, source, size, key`` of every row."""
    return docs.select(
        F.col(key).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(word_count(F.col(text))).alias("size"),
        mix_key(F.col(key), F.col(text)).alias("key"),
    )


def targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, limit: int = LIMIT
) -> DataFrame:
    """``source, source_size, target`` from one row per source.

    Weights repeat over the sources in code-point order, null last.  No target is
    above ``limit`` times its source; what that leaves over goes to the others by
    weight.  The windows run over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    cases = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn + 1).cast("int"))
    ranked = sizes.select("source", "source_size", cases.alias("weight")).withColumn(
        "full_at", F.col("source_size") * F.lit(float(limit)) / F.col("weight")
    )
    by_need = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("source_size").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything)
    level = (total * F.lit(float(share)) - before * F.lit(limit)) / left
    levelled = ranked.withColumn("level", level)
    lasting = F.max(F.when(F.col("full_at") > F.col("level"), F.col("level"))).over(everything)
    full = F.col("source_size") * F.lit(float(limit))
    return levelled.withColumn("lasting", lasting).select(
        "source",
        "source_size",
        F.when(F.col("lasting").isNull() | (F.col("full_at") <= F.col("lasting")), full)
        .otherwise(F.col("lasting") * F.col("weight"))
        .alias("target"),
    )


def _with(docs: DataFrame, table: DataFrame, few: bool) -> DataFrame:
    """Join documents to a table of one row per source, null like any other."""
    table = table.withColumnRenamed("source", "of")
    joined = docs.join(F.broadcast(table) if few else table, docs["source"].eqNullSafe(table["of"]))
    return joined.drop("of")


def thresholds(
    rows: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, limit: int = LIMIT
) -> tuple[DataFrame, bool]:
    """``source, source_size, target, copies, below`` and whether they are few.

    Keys under ``below`` are taken once more than ``copies`` times.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = materialize(targets(sizes, weights, share, limit), "mix-targets")
    few = goals.count() <= BROADCAST_SOURCES
    # A source without words has the target 0, which each of its documents meets.
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = goals.withColumn("copies", copies.cast("long")).withColumn(
        "rest", F.col("target") - F.col("copies") * F.col("source_size")
    )
    closed = state.filter("rest <= 0").withColumn("below", F.lit(0).cast("long"))
    columns = ["source", "source_size", "target", "copies", "below"]
    found = closed.select(columns)
    state = state.filter("rest > 0").select(
        "source", "source_size", "target", "copies", "rest", F.lit(0).cast("long").alias("prefix"),
        F.lit(0).cast("long").alias("under"),
    )
    state = materialize(state, "mix-open")
    for used in range(0, KEY_BITS, ROUND_BITS):
        if state.isEmpty():
            break
        inside = _with(rows, state.select("source", "prefix"), few).filter(
            F.shiftright("key", KEY_BITS - used) == F.col("prefix")
        )
        sums = inside.groupBy(
            "source", F.shiftright("key", KEY_BITS - used - ROUND_BITS).alias("bucket")
        ).agg(F.sum("size").alias("words"), F.min("key").alias("lowest"), F.max("key").alias("highest"))
        running = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("words").over(running))
        passing = _with(sums, state, few).filter(
            (F.col("under") + F.col("upto") >= F.col("rest"))
            & (F.col("under") + F.col("upto") - F.col("words") < F.col("rest"))
            & (F.col("words") > 0)
        )
        step = materialize(
            passing.select(
                "source", "source_size", "target", "copies", "rest",
                F.col("bucket").alias("prefix"),
                (F.col("under") + F.col("upto") - F.col("words")).alias("under"),
                "words", "lowest", "highest",
            ),
            "mix-step",
        )
        # The boundary key itself is taken if that comes nearer to the rest.
        nearer = F.col("under") + F.col("words") / 2 <= F.col("rest")
        last = step.filter("lowest = highest").withColumn(
            "below", F.col("lowest") + F.when(nearer, 1).otherwise(0)
        )
        found = found.unionByName(last.select(columns))
        state = step.filter("lowest < highest").select(
            "source", "source_size", "target", "copies", "rest", "prefix", "under"
        )
    return found, few


def mixed(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    limit: int = LIMIT,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of every row.

    ``taken`` counts words with repeats.  Rows equal in id and text share a key
    and are taken alike; a null source is one source; null texts have size 0; an
    empty table gives an empty result.  Other columns are ignored.
    """
    rows = materialize(measured(docs, key, text, source), "mix-rows")
    plan, few = thresholds(rows, weights, share, limit)
    times = F.col("copies") + F.when(F.col("key") < F.col("below"), 1).otherwise(0)
    return _with(rows, materialize(plan, "mix-plan"), few).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * times).alias("taken")
    )


def mixture(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed rows themselves with their columns, each as often as it is taken."""
    rows = materialize(measured(docs, key, text, source), "mix-rows")
    plan, few = thresholds(rows)
    plan = materialize(plan, "mix-plan").select(
        F.col("source").alias("_mix_source"), F.col("copies").alias("_mix_copies"), F.col("below").alias("_mix_below")
    )
    on = F.col(source).cast("string").eqNullSafe(F.col("_mix_source"))
    more = F.when(mix_key(F.col(key), F.col(text)) < F.col("_mix_below"), 1).otherwise(0)
    times = (F.col("_mix_copies") + more).cast("int")
    return (
        docs.join(F.broadcast(plan) if few else plan, on)
        .withColumn("_mix_times", times)
        .filter("_mix_times > 0")
        .withColumn("_mix_turn", F.explode(F.sequence(F.lit(1), F.col("_mix_times"))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
