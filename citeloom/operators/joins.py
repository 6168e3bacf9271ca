"""Join helpers: broadcast only behind a checked bound of rows and bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField

#: Largest side that is ever broadcast by hint, in rows and in bytes.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20


def _width(field: StructField) -> Column:
    """Bytes of a column's value, about."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, StringType | BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(field.dataType, ArrayType):
        inner = field.dataType.elementType
        if isinstance(inner, StringType | BinaryType):
            return F.coalesce(F.aggregate(c, F.lit(0), lambda n, v: n + F.octet_length(v) + 16), F.lit(0)) + 16
        return F.greatest(F.size(c), F.lit(0)) * 8 + 16
    return F.lit(16)


def row_width(df: DataFrame) -> Column:
    """Bytes of a row, about."""
    return sum((_width(f) for f in df.schema.fields), F.lit(0)).cast("long")


def row_bound(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> int | None:
    """Number of rows when rows and bytes are few enough to broadcast, else ``None``.

    One distributed aggregate, so nothing but two numbers reaches the driver.
    """
    n, size = df.agg(F.count("*"), F.sum(row_width(df))).first()
    return n if n <= max_rows and (size or 0) <= max_bytes else None


def unnest(df: DataFrame, array: Column | str, name: str, *keep, pos: str | None = None) -> DataFrame:
    """One row per array element.

    An inner explode makes the optimiser add a size test on the array below it,
    which would evaluate an expensive array expression a second time, on the
    scan.  The outer form does not; its filler row is dropped afterwards.
    """
    made = (
        F.posexplode_outer(array).alias(pos, name) if pos else F.explode_outer(array).alias(name)
    )
    return df.select(*keep, made).filter(F.col(name).isNotNull())


def join_small(
    big: DataFrame,
    small: DataFrame,
    on,
    how: str = "inner",
    *,
    rows: int | None = None,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join ``small`` to ``big``; broadcast only if ``rows`` proves it small.

    ``rows`` is an upper bound on the rows of ``small`` the caller has checked
    or derived (a counted query set times its result limit).  Without one the
    join is left to the optimiser: shuffled, with adaptive skew splitting.
    """
    if rows is not None and rows <= max_rows:
        small = F.broadcast(small)
    return big.join(small, on, how)


def first_rows(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    n: int = 1,
    rank: str | None = None,
) -> DataFrame:
    """The first ``n`` rows of each key in a total order.

    The rank filter is planned as a partial and a final group limit, so a hot
    key is cut to ``n`` rows per input partition before the shuffle.
    """
    from pyspark.sql import Window

    name = rank or "__rank"
    ranked = df.withColumn(
        name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ).filter(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)
