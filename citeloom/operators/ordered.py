"""Order-dependent operators that do not put a whole key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions per block; the unit of work of one window partition.
BLOCK = 10_000


def carry_last(
    df: DataFrame,
    keys: list[str],
    pos: str,
    value: Column,
    name: str,
    *,
    inclusive: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """Last non-NULL ``value`` at an earlier position of the same key (as-of).

    A key is cut into blocks of positions.  Each block's last value is a partial
    aggregate, a window over the few blocks of a key carries it forward, and the
    fine-grained window runs per block.  A key holding a third of all rows thus
    spreads over its blocks instead of landing in one task.
    """
    staged = df.withColumn("__value", value).withColumn(
        "__block", F.floor(F.col(pos) / block).cast("long")
    )
    at = F.when(F.col("__value").isNotNull(), F.col(pos))
    blocks = staged.groupBy(*keys, "__block").agg(F.max_by("__value", at).alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = blocks.select(
        *keys, "__block", F.last("__end", ignorenulls=True).over(before).alias("__carried")
    )
    within = (
        Window.partitionBy(*keys, "__block")
        .orderBy(pos)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    return (
        staged.join(carried, [*keys, "__block"])
        .withColumn(
            name,
            F.coalesce(F.last("__value", ignorenulls=True).over(within), F.col("__carried")),
        )
        .drop("__value", "__block", "__carried")
    )


def running_count(
    df: DataFrame, keys: list[str], pos: str, name: str, *, block: int = BLOCK
) -> DataFrame:
    """1-based ordinal of each row of a key by position, blockwise as above."""
    staged = df.withColumn("__block", F.floor(F.col(pos) / block).cast("long"))
    sizes = staged.groupBy(*keys, "__block").agg(F.count("*").alias("__size"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        *keys, "__block", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset")
    )
    within = Window.partitionBy(*keys, "__block").orderBy(pos)
    return (
        staged.join(offsets, [*keys, "__block"])
        .withColumn(name, F.row_number().over(within) + F.col("__offset"))
        .drop("__block", "__offset")
    )
