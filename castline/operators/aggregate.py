"""Aggregation of levels in two units, and the group keys and metrics of a plan."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from castline.operators.quantiles import quantiles
from castline.scratch import stored

METRICS = ("mean", "count", "min", "max", "stddev", "median")


def metric(name: str, value: Column) -> Column:
    """One of the six metrics; stddev is that of a sample, median interpolates exactly."""
    return {
        "mean": lambda: F.avg(value), "count": lambda: F.count(value), "min": lambda: F.min(value), "max": lambda: F.max(value),
        "stddev": lambda: F.stddev_samp(value), "median": lambda: F.percentile(value, F.lit(0.5)),
    }[name]()


def depth_bin(pressure: Column, size: int) -> Column:
    """Lower edge of the bin, as double."""
    return F.floor(pressure / size).cast("double") * size


def key(name: str, bin_size: int = 100, region: str | None = None) -> Column:
    """A group key over the columns of ``Tables.selected``."""
    return {
        "month": lambda: F.date_format("observed_at", "yyyy-MM"), "day": lambda: F.date_format("observed_at", "yyyy-MM-dd"),
        "profile": lambda: F.col("profile_id"), "float": lambda: F.col("platform_number"),
        "depth_bin": lambda: depth_bin(F.col("p"), bin_size), "region": lambda: F.lit(region),
    }[name]().alias(name)


def aggregate(levels: DataFrame, keys: list[Column], names: list[str], values: dict[str, Column], metrics: tuple[str, ...], unit: str) -> DataFrame:
    """Metrics over levels ("measurement"), or over the means of each profile ("profile").

    A group with rows but no usable value is kept with null metrics and count 0.
    """
    if unit == "measurement":
        rows = levels.select(*keys, *[v.alias(n) for n, v in values.items()])
    elif unit == "profile":
        rows = levels.select(F.col("profile_id").alias("_profile"), *keys, *[v.alias(n) for n, v in values.items()])
        rows = rows.groupBy("_profile", *names).agg(*[F.avg(n).alias(n) for n in values])
    else:
        raise ValueError(f"unknown unit {unit!r}")
    if "median" in metrics:
        rows = stored(rows, "values")  # narrow, and gone over three times
    plain = [m for m in metrics if m != "median"]
    made = rows.groupBy(*names).agg(*[metric(m, F.col(n)).alias(f"{n}_{m}") for n in values for m in plain], F.count("*").alias("_rows"))
    if "median" in metrics:  # exact, without a task that holds a group's values
        for i, n in enumerate(values):
            middle = quantiles(rows, names, n, {f"{n}_median": ("linear", 0.5)})
            renamed = middle.select(*[F.col(k).alias(f"_{i}k{j}") for j, k in enumerate(names)], f"{n}_median")
            same = [F.col(k).eqNullSafe(F.col(f"_{i}k{j}")) for j, k in enumerate(names)]
            made = made.join(renamed, functools.reduce(Column.__and__, same, F.lit(True)), "left")
    return made.select(*names, *[f"{n}_{m}" for n in values for m in metrics])


def ordered_totals(df: DataFrame, key: str, value: str, order: str, *more: Column) -> DataFrame:
    """key, n, total, more: rows of each key and the sum of their doubles, added one after the other by ``order`` (then by value).

    A sum of doubles hangs on the order of adding, which partial sums leave open; a total near a half rounds either way then.
    Rows of one key are sorted in one task, on disk where they are many.
    """
    w = W.partitionBy(key).orderBy(order, value)
    run = F.sum(value).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return df.withColumns({"_at": F.row_number().over(w), "_run": run}).groupBy(key).agg(F.count("*").alias("n"), F.max_by("_run", "_at").alias("total"), *more)
