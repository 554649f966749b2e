"""Exact quantiles of groups of any size, in two passes.

The first pass brackets each quantile by an approximate one of known rank error. The second meets the values with their
brackets where they are (brackets of up to BROADCAST_GROUPS groups are broadcast), folds what lies outside to a few counts in
each task, and sorts only the distinct values within. So no task holds a group's values, and none but those within a
bracket cross the network.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from castline.scratch import stored

ACCURACY = 10_000
BROADCAST_GROUPS = 10_000


def place(rule: str, fraction: float, n: Column) -> tuple[Column, Column, Column]:
    """(lower place, upper place, weight of the upper one), from 0, of a quantile among n sorted values.

    ``linear`` interpolates, ``nearest`` is the nearest rank (the least value that so large a share does not
    exceed), ``index`` rounds fraction * (n - 1) half to even.
    """
    if rule == "nearest":
        at = F.greatest(F.ceil(n * F.lit(fraction)).cast("long") - 1, F.lit(0).cast("long"))
        return at, at, F.lit(0.0)
    exact = F.lit(fraction) * (n - 1)
    if rule == "index":
        at = F.bround(exact, 0).cast("long")
        return at, at, F.lit(0.0)
    if rule != "linear":
        raise ValueError(f"unknown rule {rule!r}")
    low = F.floor(exact)
    return low, F.least(low + 1, (n - 1).cast("long")), exact - low


def quantiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """keys and a column for each ``wanted`` name (rule, fraction), of the values that are not null; groups without any are left out."""
    held = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    slack, names = 3 / ACCURACY, list(wanted)
    ends = [F.percentile_approx("_v", F.lit([max(0.0, f - slack), min(1.0, f + slack)]), F.lit(ACCURACY)).alias(f"_e{i}") for i, (_, f) in enumerate(wanted.values())]
    bracket = held.groupBy(*keys).agg(F.count("*").alias("_n"), *ends)
    bracket = stored(bracket.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n", *[f"_e{i}" for i in range(len(names))]), "brackets")
    b = F.broadcast(bracket) if bracket.count() <= BROADCAST_GROUPS else bracket
    match = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.lit(True))
    both = held.join(b, match) if keys else held.join(b, how="cross")  # without keys the bracket is one row
    outside = functools.reduce(Column.__and__, [(F.col("_v") < F.col(f"_e{i}")[0]) | (F.col("_v") > F.col(f"_e{i}")[1]) for i in range(len(names))])
    # Values outside every bracket become one row for each stretch between brackets: only their number matters.
    stretch = functools.reduce(Column.__add__, [F.when(F.col("_v") > F.col(f"_e{i}")[1], 1).otherwise(0) for i in range(len(names))])
    folded = both.groupBy(*keys, "_n", F.when(outside, F.lit(None)).otherwise(F.col("_v")).alias("_x"), F.when(outside, stretch).alias("_s")).agg(F.count("*").alias("_c"), F.min("_v").alias("_v"), F.max("_v").alias("_h"))
    w = W.partitionBy(*keys).orderBy("_v").rowsBetween(W.unboundedPreceding, 0) if keys else W.orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    run = folded.withColumn("_to", F.sum("_c").over(w)).withColumn("_from", F.col("_to") - F.col("_c"))
    out = []
    for name, (rule, fraction) in wanted.items():
        low, high, weight = place(rule, fraction, F.col("_n"))
        # In small groups a place may be the nearest value on either side of its bracket.
        there = lambda p: F.when(p == F.col("_from"), F.col("_v")).when(p == F.col("_to") - 1, F.col("_h")).otherwise(F.col("_x"))
        at = lambda p: F.max(F.when((F.col("_from") <= p) & (p < F.col("_to")), there(p)))  # noqa: E731, B023
        out.append((at(low), at(high), F.max(weight), name))
    made = run.groupBy(*keys).agg(*[x.alias(f"_{i}{j}") for i, o in enumerate(out) for j, x in enumerate(o[:3])])
    return made.select(*keys, *[(F.col(f"_{i}0") + (F.col(f"_{i}1") - F.col(f"_{i}0")) * F.col(f"_{i}2")).alias(o[3]) for i, o in enumerate(out)])
