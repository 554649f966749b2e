"""Monthly series: spine, definitions, missing policy, seasonal naive, backtest; fitted models are in ``sarima``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A series needs so many months, and may lack this share and this long a run.
LEAST_MONTHS, MOST_MISSING, LONGEST_GAP = 36, 0.2, 2
FOLDS, HORIZONS, SEASON, LEAST_TRAINING = 12, 3, 12, 25
# A model is taken if its error is so much of the baseline's at most, and its residual is centred to such a share of its spread.
BETTER, CENTRED = 0.95, 0.1


def month_number(at: Column) -> Column:
    return (F.year(at) * 12 + F.month(at) - 1).cast("long")


def month_text(number: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor(number / 12), number % 12 + 1)


def monthly(levels: DataFrame, keys: list[str], least: int) -> DataFrame:
    """keys, m, y, n: profile-balanced monthly mean of column t, null under ``least`` profiles, every month present."""
    each = levels.groupBy(*keys, "profile_id", month_number(F.col("observed_at")).alias("m")).agg(F.avg("t").alias("t"))
    found = each.groupBy(*keys, "m").agg(F.avg("t").alias("y"), F.count("t").alias("n"))
    ends = found.groupBy(*keys).agg(F.min("m").alias("a"), F.max("m").alias("b"))
    months = ends.select(*keys, F.explode(F.sequence("a", "b")).alias("m"))
    return months.join(found, [*keys, "m"], "left").select(*keys, "m", F.when(F.col("n") >= least, F.col("y")).alias("y"), F.coalesce("n", F.lit(0)).alias("n"))


#: Side of the cells by which levels meet depth bands, in dbar.
BAND_CELL = 100


def defined_series(levels: DataFrame, placed: DataFrame, definitions: DataFrame) -> DataFrame:
    """series, m, y, n of every definition: profile-balanced monthly mean, null under its min_profiles, every month of its period present.

    ``definitions``: series, region, depth_min, depth_max, variable (temperature, salinity or pressure), min_profiles, start,
    end (month numbers, end exclusive). ``placed``: profile_id, region. ``levels``: profile_id, observed_at, p, t, s. A level meets its
    definitions by region and depth cell, an equi join, and one shuffle by (series, profile) serves all series.
    """
    cell = lambda c: F.floor(F.col(c) / BAND_CELL).cast("long")
    bands = definitions.select("*", F.explode(F.sequence(cell("depth_min"), cell("depth_max"))).alias("_cell"))
    rows = levels.where("p IS NOT NULL").select("profile_id", month_number(F.col("observed_at")).alias("m"), "p", "t", "s", cell("p").alias("_cell"))
    met = rows.join(placed.select("profile_id", "region"), "profile_id").join(bands, ["region", "_cell"])
    met = met.where(F.col("p").between(F.col("depth_min"), F.col("depth_max")) & (F.col("m") >= F.col("start")) & (F.col("m") < F.col("end")))
    value = F.when(F.col("variable") == "temperature", F.col("t")).when(F.col("variable") == "salinity", F.col("s")).when(F.col("variable") == "pressure", F.col("p"))
    each = met.groupBy("series", "profile_id", "m").agg(F.avg(value).alias("v"))
    found = each.groupBy("series", "m").agg(F.avg("v").alias("y"), F.count("v").alias("n"))
    months = definitions.select("series", "min_profiles", F.explode(F.sequence("start", F.col("end") - 1)).alias("m"))
    kept = F.when(F.col("n") >= F.col("min_profiles"), F.col("y")).alias("y")
    return months.join(found, ["series", "m"], "left").select("series", "m", kept, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def interpolated(series: DataFrame, keys: list[str]) -> DataFrame:
    """Edges cut off, inner gaps filled linearly and flagged."""
    w = W.partitionBy(*keys).orderBy("m")
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    at = F.when(F.col("y").isNotNull(), F.col("m"))
    z = series.select("*", F.last(at, True).over(back).alias("m0"), F.last("y", True).over(back).alias("y0"), F.first(at, True).over(ahead).alias("m1"), F.first("y", True).over(ahead).alias("y1"))
    linear = F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("m") - F.col("m0")) / F.nullif(F.col("m1") - F.col("m0"), F.lit(0))
    z = z.where("m0 IS NOT NULL AND m1 IS NOT NULL")
    return z.select(*keys, "m", F.coalesce("y", linear).alias("y"), F.col("y").isNull().alias("filled"))


def refusal(series: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_months, missing, longest_gap, verdict of the missing policy on the trimmed series."""
    w = W.partitionBy(*keys).orderBy("m")
    ends = series.where("y IS NOT NULL").groupBy(*keys).agg(F.min("m").alias("a"), F.max("m").alias("b"), F.count("*").alias("have"))
    gaps = series.where("y IS NOT NULL").withColumn("gap", F.coalesce(F.col("m") - F.lag("m").over(w) - 1, F.lit(0))).groupBy(*keys).agg(F.max("gap").alias("longest_gap"))
    both = ends.join(gaps, keys).withColumn("n_months", F.col("b") - F.col("a") + 1).withColumn("missing", F.col("b") - F.col("a") + 1 - F.col("have"))
    verdict = (
        F.when(F.col("n_months") < LEAST_MONTHS, "too_short").when(F.col("missing") > MOST_MISSING * F.col("n_months"), "too_many_missing")
        .when(F.col("longest_gap") > LONGEST_GAP, "gap_too_long").otherwise("ok")
    )
    return both.select(*keys, "n_months", "missing", "longest_gap", verdict.alias("verdict"))


def numbered(series: DataFrame, keys: list[str]) -> DataFrame:
    return series.withColumn("i", F.row_number().over(W.partitionBy(*keys).orderBy("m")) - 1)


def origins(series: DataFrame, keys: list[str], folds: int = FOLDS, horizons: int = HORIZONS) -> DataFrame:
    """keys, origin, h: expanding folds; an origin is the number of months before it."""
    size = series.groupBy(*keys).agg(F.count("*").cast("int").alias("size"))
    first = F.col("size") - folds - horizons + 1
    return size.select(*keys, "size", F.explode(F.sequence(first, first + folds - 1)).alias("origin")).where(F.col("origin") >= LEAST_TRAINING).select(
        *keys, "origin", F.explode(F.sequence(F.lit(1), F.lit(horizons))).alias("h"))


def backtest_naive(series: DataFrame, keys: list[str]) -> DataFrame:
    """keys, h, n, mae, rmse, mase of the value a season before."""
    y = numbered(series, keys).select(*keys, "i", "y")
    w = W.partitionBy(*keys).orderBy("i")
    d = y.withColumn("d", F.abs(F.col("y") - F.lag("y", SEASON).over(w)))
    scale = d.select(*keys, (F.col("i") + 1).alias("origin"), F.avg("d").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("scale"))
    plan = origins(series, keys)
    actual = y.select(*keys, F.col("i").alias("ti"), F.col("y").alias("actual"))
    past = y.select(*keys, F.col("i").alias("pi"), F.col("y").alias("predicted"))
    rows = plan.withColumn("ti", F.col("origin") + F.col("h") - 1).withColumn("pi", F.col("origin") - SEASON + (F.col("h") - 1) % SEASON)
    rows = rows.join(actual, [*keys, "ti"]).join(past, [*keys, "pi"]).join(scale, [*keys, "origin"])
    e = F.col("actual") - F.col("predicted")
    return rows.groupBy(*keys, "h").agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e) / F.col("scale")).alias("mase"))


def naive_widths(series: DataFrame, keys: list[str]) -> DataFrame:
    """keys, w80, w95, size: linear quantiles of the centred absolute seasonal differences, and the months of the series."""
    e = numbered(series, keys).withColumn("e", F.col("y") - F.lag("y", SEASON).over(W.partitionBy(*keys).orderBy("i"))).where("e IS NOT NULL")
    off = e.join(e.groupBy(*keys).agg(F.avg("e").alias("mean")), keys).withColumn("x", F.abs(F.col("e") - F.col("mean")))
    return off.groupBy(*keys).agg(F.percentile("x", F.lit(0.8)).alias("w80"), F.percentile("x", F.lit(0.95)).alias("w95"), (F.count("*") + SEASON).alias("size"))


def seasonal_naive(series: DataFrame, keys: list[str], horizons: int = HORIZONS) -> DataFrame:
    """keys, h, point, low80, high80, low95, high95: the value a season before, with empirical intervals."""
    y, ahead = numbered(series, keys).select(*keys, "i", "y"), naive_widths(series, keys)
    ahead = ahead.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizons))).alias("h")).withColumn("i", (F.col("size") - SEASON + (F.col("h") - 1) % SEASON).cast("int"))
    rows = ahead.join(y, [*keys, "i"])
    end = lambda w, sign, name: (F.col("y") + sign * F.col(w)).alias(name)
    return rows.select(*keys, "h", F.col("y").alias("point"), end("w80", -1, "low80"), end("w80", 1, "high80"), end("w95", -1, "low95"), end("w95", 1, "high95"))


def best_candidates(scores: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """The n best of each series by AICc, fewer parameters first, then by name (column ``candidate``), with their rank."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("aicc").asc_nulls_last(), "parameters", "candidate"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= n)


def lag_candidates(series: DataFrame, keys: list[str], lags: range) -> DataFrame:
    """keys, candidate, parameters, aicc, error, passes: for each lag the model that repeats the value so many months before.

    A lag counts as so many parameters; the likelihood is that of normal differences. ``error`` is the mean
    absolute difference, ``passes`` whether the differences are centred.
    """
    w = W.partitionBy(*keys).orderBy("i")
    y = numbered(series, keys)
    y = y.select(*keys, "y", *[F.lag("y", k).over(w).alias(f"_l{k}") for k in lags])
    gaps = F.array(*[F.struct(F.lit(k).alias("candidate"), (F.col("y") - F.col(f"_l{k}")).alias("e")) for k in lags])
    each = y.select(*keys, F.explode(gaps).alias("g")).select(*keys, "g.*").where("e IS NOT NULL")
    centred = F.abs(F.avg("e")) <= CENTRED * F.stddev_samp("e")
    fit = each.groupBy(*keys, "candidate").agg(F.count("*").alias("n"), F.avg(F.col("e") * F.col("e")).alias("v"), F.avg(F.abs("e")).alias("error"), centred.alias("passes"))
    k = F.col("candidate") + 1
    aicc = F.col("n") * F.log("v") + 2 * k + 2 * k * (k + 1) / (F.col("n") - k - 1)
    return fit.where(F.col("n") > k + 1).select(*keys, "candidate", k.alias("parameters"), aicc.alias("aicc"), "error", "passes")


def report(verdicts: DataFrame, errors: DataFrame, keys: list[str], horizons: int = HORIZONS) -> DataFrame:
    """Evaluation table: verdict, number of forecasts, and MASE at each horizon as columns mase_h1, ...; refused series have their reason and no figures."""
    wide = errors.groupBy(*keys).agg(F.sum("n").alias("forecasts"), *[F.max(F.when(F.col("h") == h, F.col("mase"))).alias(f"mase_h{h}") for h in range(1, horizons + 1)])
    ok = F.col("verdict") == "ok"
    shown = [F.when(ok, F.col(c)).alias(c) for c in ("forecasts", *[f"mase_h{h}" for h in range(1, horizons + 1)])]
    return verdicts.join(wide, keys, "left").select(*keys, F.when(ok, "forecast").otherwise("refused").alias("status"), F.when(~ok, F.col("verdict")).alias("reason"), *shown)


def select_model(scores: DataFrame, keys: list[str], baseline: int) -> DataFrame:
    """keys, chosen, status: the simplest candidate (fewest parameters, then least error) that beats the baseline by 5 % and passes; else the baseline, as experimental."""
    base = scores.where(F.col("candidate") == baseline).select(*keys, F.col("error").alias("_b"))
    good = scores.join(base, keys).where((F.col("candidate") != baseline) & F.col("passes") & (F.col("error") <= BETTER * F.col("_b")))
    best = good.groupBy(*keys).agg(F.min_by("candidate", F.struct("parameters", "error")).alias("_c"))
    return base.join(best, keys, "left").select(*keys, F.coalesce("_c", F.lit(baseline)).alias("chosen"), F.when(F.col("_c").isNull(), "experimental").otherwise("selected").alias("status"))


def diverged(point: Column, top: Column) -> Column:
    """Whether a point forecast is beyond a thousand times the largest value seen: a miss, not a forecast."""
    return F.abs(point) > 1000 * (top + 1)
