"""Seasonal ARIMA candidates: ranked on the first training window, refitted fold by fold, scored, and selected.

Fits are conditional least squares by Gauss-Newton. Spark deals them out by (series, some orders) and then by (series,
candidate); a task fits all parameter shifts, and all folds of a candidate, in one residual recursion over arrays. What
leaves a task are scores, forecasts and residuals as rows, and everything after that is DataFrame work.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from castline.operators.series import BETTER, CENTRED, FOLDS, HORIZONS, LEAST_TRAINING, SEASON, diverged, numbered

Order = tuple[int, int, int, int, int, int]
#: The grid: p, d, q, and the same of the season.
ORDERS: tuple[Order, ...] = tuple(itertools.product(range(3), range(2), range(3), range(2), range(2), range(2)))
STEPS, SHIFT, RIDGE, BOUND, START = 8, 1e-4, 1e-3, 0.98, 0.1
#: Shares of a Gauss-Newton step that are tried in turn.
SHARES = (1.0, 0.5, 0.25)
#: Candidates that go on to the folds, and orders that one row of the grid fits.
BEST, TOGETHER = 3, 12
# Two-sided 80 % and 95 % points of the normal distribution, and the least p of the Ljung-Box test.
Z80, Z95, LEAST_P = 1.2815515655446004, 1.959963984540054, 0.05


def name_of(order: Order) -> str:
    return ",".join(map(str, order))


def parameters(order: Order) -> int:
    """Coefficients, the variance, and a mean where nothing is differenced."""
    p, d, q, sp, sd, sq = order
    return p + q + sp + sq + 1 + (d + sd == 0)


def polynomials(order: Order, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(AR, MA) coefficients by lag, lag 0 first, for each row (mean, ar.., ma.., seasonal ar, seasonal ma) of ``theta``."""
    p, _, q, sp, _, sq = order
    cut = np.cumsum([1, p, q, sp, sq])
    mean_, ar, ma, far, fma = np.split(theta, cut[:-1], axis=1)
    one = np.ones((len(theta), 1))

    def times(plain: np.ndarray, season: np.ndarray) -> np.ndarray:
        if not season.shape[1]:
            return plain
        out = np.zeros((len(theta), plain.shape[1] + SEASON))
        out[:, : plain.shape[1]] += plain
        out[:, SEASON:] += season * plain
        return out

    return times(np.hstack([one, -ar]), -far), times(np.hstack([one, ma]), fma)


def differenced(y: np.ndarray, order: Order) -> np.ndarray:
    for _ in range(order[1]):
        y = np.diff(y, axis=1)
    for _ in range(order[4]):
        y = y[:, SEASON:] - y[:, :-SEASON]
    return y


def residuals(x: np.ndarray, sizes: np.ndarray, order: Order, theta: np.ndarray) -> np.ndarray:
    """One-step errors of each row of ``x`` up to its size; nothing is known before the sample, and nothing counts after the size."""
    ar, ma = polynomials(order, theta)
    z = x - theta[:, :1] * (order[1] + order[4] == 0)
    u = ar[:, :1] * z
    for lag in range(1, min(ar.shape[1], z.shape[1])):
        u[:, lag:] += ar[:, lag : lag + 1] * z[:, :-lag]
    if ma.shape[1] > 1:
        back = ma[:, :0:-1]  # the largest lag first
        width = back.shape[1]
        e = np.zeros((len(u), width + u.shape[1]))
        for t in range(u.shape[1]):
            e[:, width + t] = u[:, t] - (back * e[:, t : t + width]).sum(axis=1)
        u = e[:, width:]
    return np.where(np.arange(u.shape[1]) < sizes[:, None], u, 0.0)


def fit(windows: list[np.ndarray], order: Order, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parameters, residuals, residual counts) of each window of one series, all windows at once."""
    k, n = 1 + order[0] + order[2] + order[3] + order[5], len(windows)
    lost = order[1] + SEASON * order[4]
    y = np.zeros((n, max(map(len, windows))))
    for row, w in zip(y, windows, strict=True):
        row[: len(w)] = w
    x, sizes = differenced(y, order), np.array([max(len(w) - lost, 0) for w in windows])
    theta = np.zeros((n, k))
    theta[:, 0] = [w.mean() for w in windows]
    theta[:, 1:] = START  # at nought an AR and an MA term would be the same column
    e = residuals(x, sizes, order, theta)
    live = np.ones(n, bool)
    shifts = np.vstack([np.zeros((1, k)), SHIFT * np.eye(k)])
    for _ in range(steps):
        if not live.any():
            break
        with np.errstate(all="ignore"):
            at = np.repeat(theta, k + 1, axis=0) + np.tile(shifts, (n, 1))
            moved = residuals(np.repeat(x, k + 1, axis=0), np.repeat(sizes, k + 1), order, at).reshape(n, k + 1, -1)
            jac = (moved[:, 1:] - moved[:, :1]) / SHIFT
            square = jac @ jac.transpose(0, 2, 1)
            square = square + RIDGE * np.trace(square, axis1=1, axis2=2)[:, None, None] / k * np.eye(k) + 1e-9 * np.eye(k)
            step, better = np.zeros((n, k)), np.zeros(n, bool)
            sound = np.isfinite(square).all(axis=(1, 2)) & np.isfinite(e).all(axis=1) & live
            if sound.any():
                step[sound] = np.linalg.solve(square[sound], -(jac[sound] @ e[sound][:, :, None]))[:, :, 0]
            before = (e * e).sum(axis=1)
            for share in SHARES:
                new = theta + share * step
                new[:, 1:] = np.clip(new[:, 1:], -BOUND, BOUND)
                fresh = residuals(x, sizes, order, new)
                good = sound & ~better & np.isfinite(fresh).all(axis=1) & ((fresh * fresh).sum(axis=1) < before)
                theta[good], e[good] = new[good], fresh[good]
                better |= good
        live &= better
    return theta, e, sizes


def aicc(e: np.ndarray, size: int, count: int) -> float:
    """Of normal residuals; infinite where there are too few."""
    if size - count - 1 <= 0 or not np.isfinite(e).all():
        return float("inf")
    return float(size * np.log(max(e @ e, 1e-12) / size) + 2 * count + 2 * count * (count + 1) / (size - count - 1))


def forecast(y: np.ndarray, order: Order, theta: np.ndarray, e: np.ndarray, size: int, horizons: int) -> tuple[np.ndarray, np.ndarray]:
    """(points, standard errors) after the window ``y``."""
    (ar,), (ma,) = polynomials(order, theta[None])
    for _ in range(order[1]):
        ar = np.convolve(ar, [1, -1])
    for _ in range(order[4]):
        ar = np.convolve(ar, np.r_[1, np.zeros(SEASON - 1), -1])
    mean = theta[0] * (order[1] + order[4] == 0)
    past, errors = list(y - mean), [0.0] * (len(y) - size) + list(e[:size])
    psi = np.zeros(horizons)
    for h in range(horizons):
        n = len(past)
        point = -sum(ar[j] * past[n - j] for j in range(1, min(len(ar), n + 1)))
        past.append(point + sum(ma[j] * errors[n - j] for j in range(1, min(len(ma), n + 1))))
        errors.append(0.0)
        psi[h] = (h == 0) + (ma[h] if 0 < h < len(ma) else 0.0) - sum(ar[j] * psi[h - j] for j in range(1, min(len(ar) - 1, h) + 1))
    spread = np.sqrt(max(float(e[:size] @ e[:size]), 0.0) / max(size, 1))
    return np.array(past[-horizons:]) + mean, spread * np.sqrt(np.cumsum(psi * psi))


# Spark -------------------------------------------------------------------------------------------


def packed(series: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y: each series as an array. A series has a value for each month, so it is bounded by the calendar."""
    return series.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "y"))), lambda x: x["y"]).alias("y"))


def _schema(frame: DataFrame, keys: list[str], rest: str) -> str:
    return ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name in keys], rest])


def _dealt(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Fits are few and slow rows, so they are dealt to all cores and not merged into large partitions."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, *keys, by)


def rank_orders(series: DataFrame, keys: list[str], orders: tuple[Order, ...] = ORDERS, folds: int = FOLDS, horizons: int = HORIZONS, best: int = BEST) -> DataFrame:
    """keys, candidate, parameters, aicc, rank: every order fitted once to the months before the first fold; the best by AICc, fewer parameters first.

    A series too short for the folds has no candidates.
    """
    held = packed(series, keys).where(F.size("y") - folds - horizons + 1 >= LEAST_TRAINING)
    chunks = [orders[i : i + TOGETHER] for i in range(0, len(orders), TOGETHER)]
    dealt = _dealt(held.select(*keys, "y", F.explode(F.sequence(F.lit(0), F.lit(len(chunks) - 1))).alias("chunk")), keys, "chunk")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for row in rows.to_dict("records"):
                y = np.asarray(row["y"], float)
                train = y[: len(y) - folds - horizons + 1]
                for order in chunks[row["chunk"]]:
                    _, e, sizes = fit([train], order)
                    found.append((*[row[k] for k in keys], name_of(order), parameters(order), aicc(e[0][: sizes[0]], int(sizes[0]), parameters(order))))
            yield pd.DataFrame(found, columns=[*keys, "candidate", "parameters", "aicc"])

    scores = dealt.mapInPandas(run, _schema(held, keys, "candidate string, parameters int, aicc double")).where(~F.isnan("aicc") & (F.col("aicc") < float("inf")))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("aicc", "parameters", "candidate"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= best)


def fold_forecasts(series: DataFrame, ranked: DataFrame, keys: list[str], folds: int = FOLDS, horizons: int = HORIZONS) -> DataFrame:
    """keys, candidate, parameters, origin, h, point, low80, high80, low95, high95: each candidate refitted to each fold's months."""
    rows = _dealt(packed(series, keys).join(ranked.select(*keys, "candidate", "parameters"), keys), keys, "candidate")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row in batch.to_dict("records"):
                y, order = np.asarray(row["y"], float), tuple(map(int, row["candidate"].split(",")))
                first = len(y) - folds - horizons + 1
                windows = [y[: first + i] for i in range(folds)]
                theta, e, sizes = fit(windows, order)
                for i, w in enumerate(windows):
                    with np.errstate(all="ignore"):
                        points, errors = forecast(w, order, theta[i], e[i], int(sizes[i]), horizons)
                    for h in range(horizons):
                        ends = [points[h] + s * errors[h] for s in (-Z80, Z80, -Z95, Z95)]
                        found.append((*[row[k] for k in keys], row["candidate"], row["parameters"], len(w), h + 1, points[h], *ends))
            yield pd.DataFrame(found, columns=[*keys, "candidate", "parameters", "origin", "h", "point", "low80", "high80", "low95", "high95"])

    return rows.mapInPandas(run, _schema(series, keys, "candidate string, parameters int, origin int, h int, point double, low80 double, high80 double, low95 double, high95 double"))


def backtest_models(series: DataFrame, forecasts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, candidate, parameters, h, n, misses, mae, rmse, mase, coverage80, coverage95 of forecasts by fold.

    A forecast that is not finite or beyond a thousand times the largest value is a miss for all horizons of its fold.
    """
    y = numbered(series, keys).select(*keys, "i", "y")
    w = W.partitionBy(*keys).orderBy("i")
    scale = y.withColumn("d", F.abs(F.col("y") - F.lag("y", SEASON).over(w))).select(*keys, (F.col("i") + 1).alias("origin"), F.avg("d").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("scale"))
    top = y.groupBy(*keys).agg(F.max(F.abs("y")).alias("top"))
    fold = W.partitionBy(*keys, "candidate", "origin")
    wild = F.isnan("point") | diverged(F.col("point"), F.col("top"))
    rows = forecasts.join(top, keys).withColumn("miss", F.max(wild).over(fold)).withColumn("i", F.col("origin") + F.col("h") - 1)
    rows = rows.join(y, [*keys, "i"]).join(scale, [*keys, "origin"])
    hit = lambda c: F.when(~F.col("miss"), c)
    e = hit(F.col("y") - F.col("point"))
    inside = lambda k: hit(F.col("y").between(F.col(f"low{k}"), F.col(f"high{k}")).cast("double"))
    return rows.groupBy(*keys, "candidate", "parameters", "h").agg(
        F.count(e).alias("n"), F.count_if("miss").alias("misses"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e) / F.col("scale")).alias("mase"),
        F.avg(inside(80)).alias("coverage80"), F.avg(inside(95)).alias("coverage95"),
    )


def history_residuals(series: DataFrame, ranked: DataFrame, keys: list[str]) -> DataFrame:
    """keys, candidate, i, e: residuals of each candidate refitted to the whole history."""
    rows = _dealt(packed(series, keys).join(ranked.select(*keys, "candidate"), keys), keys, "candidate")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row in batch.to_dict("records"):
                y, order = np.asarray(row["y"], float), tuple(map(int, row["candidate"].split(",")))
                _, e, sizes = fit([y], order)
                found += [(*[row[k] for k in keys], row["candidate"], i, v) for i, v in enumerate(e[0][: sizes[0]].tolist())]
            yield pd.DataFrame(found, columns=[*keys, "candidate", "i", "e"])

    return rows.mapInPandas(run, _schema(series, keys, "candidate string, i int, e double"))


def ljung_box(values: DataFrame, keys: list[str], value: str, lag: int = SEASON) -> DataFrame:
    """keys, q, p, mean, spread: the Ljung-Box statistic of centred values in order of ``i``, its chi-square tail, mean and deviation.

    With an even number of degrees of freedom the tail is a finite sum.
    """
    if lag % 2:
        raise ValueError("the tail is a finite sum for even lags only")
    centre = values.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("spread"))
    d = values.join(centre, keys).select(*keys, "i", "mean", "spread", (F.col(value) - F.col("mean")).alias("d"))
    w = W.partitionBy(*keys).orderBy("i")
    x = d.select(*keys, "mean", "spread", "d", *[F.lag("d", k).over(w).alias(f"l{k}") for k in range(1, lag + 1)])
    sums = x.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.col("d") * F.col("d")).alias("dd"), F.first("mean").alias("mean"), F.first("spread").alias("spread"),
        *[F.sum(F.col("d") * F.col(f"l{k}")).alias(f"s{k}") for k in range(1, lag + 1)],
    )
    terms = [F.pow(F.col(f"s{k}") / F.col("dd"), 2) / (F.col("n") - k) for k in range(1, lag + 1)]
    sums = sums.where(F.col("n") > lag + 1).withColumn("q", F.col("n") * (F.col("n") + 2) * sum(terms[1:], terms[0]))
    tail, term = F.lit(1.0), F.lit(1.0)
    for k in range(1, lag // 2):
        term = term * F.col("q") / (2 * k)
        tail = tail + term
    return sums.select(*keys, "q", (F.exp(-F.col("q") / 2) * tail).alias("p"), "mean", "spread")


def passes() -> Column:
    """Residuals that look like noise around nought, on the columns of ``ljung_box``."""
    return (F.col("p") > LEAST_P) & ((F.col("spread") == 0) | (F.abs("mean") <= CENTRED * F.col("spread")))


def select_candidates(scores: DataFrame, baseline: DataFrame, diagnostics: DataFrame, keys: list[str]) -> DataFrame:
    """keys, chosen, status, mase, baseline_mase: the simplest candidate (fewest parameters, then least error) that is 5 % better
    than the season before, never diverged and passes its diagnostics; else the baseline, as experimental."""
    mean = lambda df, *by: df.groupBy(*keys, *by).agg(F.avg("mase").alias("mase"), *([F.sum("misses").alias("misses")] if by else []))
    base = mean(baseline).select(*keys, F.col("mase").alias("baseline_mase"))
    tried = mean(scores, "candidate", "parameters").join(base, keys).join(diagnostics.select(*keys, "candidate", passes().alias("passes")), [*keys, "candidate"])
    good = tried.where("passes AND misses = 0").where(F.col("mase") <= BETTER * F.col("baseline_mase"))
    best = good.groupBy(*keys).agg(F.min_by(F.struct("candidate", "mase"), F.struct("parameters", "mase", "candidate")).alias("b"))
    none = F.col("b").isNull()
    return base.join(best, keys, "left").select(
        *keys, F.coalesce("b.candidate", F.lit("seasonal_naive")).alias("chosen"), F.when(none, "experimental").otherwise("published").alias("status"),
        F.coalesce("b.mase", "baseline_mase").alias("mase"), "baseline_mase",
    )

