"""Running totals over data of any size, in two levels.

One window over a whole table, or over a group that holds a third of it, is one task. Here the order is cut into
buckets: each bucket has its own window, and bucket totals (about the square root of the rows) give the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(
    df: DataFrame, values: dict[str, str | Column], bucket: str, order: Sequence[str | Column], groups: Sequence[str] = ()
) -> DataFrame:
    """Add, for each ``out: value`` pair, the total of ``value`` over all rows before this one in its group.

    Rows of a group are ordered by ``bucket`` and, inside a bucket, by ``order``. Neither ``bucket`` nor ``groups``
    may hold nulls; a null value counts 0. Rows that tie in every order column get consecutive places in any order.
    """
    keys = [*groups, bucket]
    value = {k: F.coalesce(v if isinstance(v, Column) else F.col(v), F.lit(0).cast("long")) for k, v in values.items()}
    totals = df.groupBy(*keys).agg(*[F.sum(v).alias(f"_t_{k}") for k, v in value.items()])
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0).cast("long")).alias(f"_o_{k}") for k in value]
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.select(
        "*", *[F.coalesce(F.sum(v).over(inside), F.lit(0).cast("long")).alias(f"_l_{k}") for k, v in value.items()]
    )
    return (
        local.join(offsets, keys)
        .withColumns({k: F.col(f"_o_{k}") + F.col(f"_l_{k}") for k in value})
        .drop(*[f"{p}{k}" for k in value for p in ("_o_", "_l_")])
    )
