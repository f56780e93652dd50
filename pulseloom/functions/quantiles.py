"""Exact quantiles by distributed selection: a bounded sketch finds a narrow range around each rank, counts settle the rest."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import running_total

#: Entries of the sketch; its error is one part of as many.
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, col: str, shares: list[float]) -> list[float | None]:
    """The quantiles of a column at ``shares`` with linear interpolation, None without values; nulls and NaN are left out.

    No task holds the distinct values: the ranks' neighbours lie in ranges of about a ten-thousandth of the rows, values there
    are grouped, and running totals in two levels pick those at the ranks. A range that misses its rank is widened to all values.
    """
    x = df.select(F.col(col).cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    n = x.count()
    if not n:
        return [None for _ in shares]
    at = [(n - 1) * p for p in shares]
    ranks = sorted({k for h in at for k in (math.floor(h), math.ceil(h))})
    slack = 2 / ACCURACY
    ends = [min(1.0, max(0.0, v)) for k in ranks for v in ((k - 1) / n - slack, (k + 2) / n + slack)]
    found = x.agg(F.percentile_approx("x", ends, ACCURACY)).first()[0]
    value = _at_ranks(x, ranks, list(zip(found[::2], found[1::2])))
    if len(value) < len(ranks):
        value |= _at_ranks(x, [k for k in ranks if k not in value], [(-math.inf, math.inf)] * (len(ranks) - len(value)))
    return [value[math.floor(h)] + (h - math.floor(h)) * (value[math.ceil(h)] - value[math.floor(h)]) for h in at]


def _at_ranks(x: DataFrame, ranks: list[int], ranges: list[tuple[float, float]]) -> dict[int, float]:
    """The values at the ranks (from 0) whose range holds them."""
    merged: list[list[float]] = []
    for low, high in sorted(ranges):
        if merged and low <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    below = x.agg(*[F.count_if(F.col("x") < low).alias(f"b{i}") for i, (low, _) in enumerate(merged)]).first()
    own, inside = F.lit(None), F.lit(False)
    for i, (low, high) in enumerate(merged):
        held = (F.col("x") >= low) & (F.col("x") <= high)
        own, inside = F.when(held, i).otherwise(own), inside | held
    values = x.filter(inside).groupBy(own.cast("int").alias("range"), "x").agg(F.count(F.lit(1)).alias("n"))
    width = {i: (high - low) / 1024 for i, (low, high) in enumerate(merged)}
    bucket = F.lit(0).cast("long")
    for i, (low, _) in enumerate(merged):
        if 0 < width[i] < math.inf:
            bucket = F.when(F.col("range") == i, F.floor((F.col("x") - low) / width[i])).otherwise(bucket)
    placed = running_total(values.withColumn("bucket", bucket), {"before": "n"}, "bucket", ["x"], ["range"])
    place = F.lit(0).cast("long")
    for i in range(len(merged)):
        place = F.when(F.col("range") == i, F.col("before") + int(below[i])).otherwise(place)
    placed = placed.withColumn("place", place)
    wanted = F.lit(False)
    for k in ranks:
        wanted = wanted | ((F.col("place") <= k) & (F.col("place") + F.col("n") > k))
    rows = placed.filter(wanted).select("x", "place", "n").collect()
    return {k: r["x"] for r in rows for k in ranks if r["place"] <= k < r["place"] + r["n"]}
