"""Series by definitions, and fitted models against a plain twin that goes one number at a time."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from castline.operators import sarima, series

ORDERS = [(1, 0, 1, 0, 1, 0), (0, 1, 2, 1, 0, 1), (2, 0, 0, 0, 0, 0)]


def _plain_residuals(y, order, theta):
    p, d, q, sp, sd, sq = order
    x = list(y)
    for _ in range(d):
        x = [b - a for a, b in zip(x, x[1:], strict=False)]
    for _ in range(sd):
        x = [b - a for a, b in zip(x, x[12:], strict=False)]
    mean = theta[0] if d + sd == 0 else 0.0
    x = [v - mean for v in x]
    ar, ma = {0: 1.0}, {0: 1.0}
    for k in range(p):
        ar[k + 1] = -theta[1 + k]
    for k in range(q):
        ma[k + 1] = theta[1 + p + k]
    if sp:
        ar = {k: ar.get(k, 0.0) - theta[1 + p + q] * ar.get(k - 12, 0.0) for k in range(max(ar) + 13)}
    if sq:
        ma = {k: ma.get(k, 0.0) + theta[1 + p + q + sp] * ma.get(k - 12, 0.0) for k in range(max(ma) + 13)}
    e = []
    for t in range(len(x)):
        u = sum(c * x[t - k] for k, c in ar.items() if t >= k)
        e.append(u - sum(c * e[t - k] for k, c in ma.items() if 0 < k <= t))
    return np.array(e)


def _plain_fit(y, order):
    k = 1 + order[0] + order[2] + order[3] + order[5]
    theta = np.zeros(k)
    theta[0], theta[1:] = np.mean(y), sarima.START
    e = _plain_residuals(y, order, theta)
    for _ in range(sarima.STEPS):
        jac = np.stack([(_plain_residuals(y, order, theta + sarima.SHIFT * np.eye(k)[j]) - e) / sarima.SHIFT for j in range(k)], axis=1)
        square = jac.T @ jac
        step = -np.linalg.solve(square + (sarima.RIDGE * np.trace(square) / k + 1e-9) * np.eye(k), jac.T @ e)
        for share in sarima.SHARES:
            new = theta + share * step
            new[1:] = np.clip(new[1:], -sarima.BOUND, sarima.BOUND)
            fresh = _plain_residuals(y, order, new)
            if fresh @ fresh < e @ e:
                theta, e = new, fresh
                break
        else:
            break
    return theta, e


def _series(seed, n=80):
    rng = np.random.default_rng(seed)
    y, noise = np.zeros(n), rng.normal(size=n)
    for t in range(n):
        y[t] = 0.5 * (y[t - 1] if t else 0) + noise[t]
    return 10 + y + 3 * np.sin(2 * np.pi * np.arange(n) / 12)


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(name, m, float(v)) for name, seed in (("a", 1), ("b", 2)) for m, v in enumerate(_series(seed))]
    rows += [("short", m, 1.0) for m in range(30)]
    return spark.createDataFrame(rows, "k string, m long, y double").cache()


@pytest.mark.parametrize("order", ORDERS)
def test_fits_of_all_folds_at_once_equal_the_plain_twin(order):
    y = _series(3)
    windows = [y[: 66 + i] for i in range(12)]
    theta, e, sizes = sarima.fit(windows, order)
    for w, got, errors, size in zip(windows, theta, e, sizes, strict=True):
        want, plain = _plain_fit(w, order)
        assert np.allclose(got, want, atol=1e-6) and len(plain) == size and np.allclose(errors[:size], plain, atol=1e-6) and not errors[size:].any()


@pytest.mark.parametrize("order", ORDERS)
def test_forecasts_continue_the_recursion(order):
    """A point forecast is the value that makes the next residual nought."""
    y = _series(5)
    (theta,), (e,), (size,) = sarima.fit([y], order)
    points, errors = sarima.forecast(y, order, theta, e, int(size), 3)
    again = _plain_residuals(np.r_[y, points], order, theta)
    assert np.allclose(again[-3:], 0, atol=1e-8) and (np.diff(errors) >= -1e-12).all()
    assert errors[0] == pytest.approx(math.sqrt(e[:size] @ e[:size] / size))


def test_ranks_by_aicc_of_the_first_window(spark, frame):
    got = sarima.rank_orders(frame, ["k"], tuple(ORDERS), best=3).collect()
    assert {r.k for r in got} == {"a", "b"}
    for k, seed in (("a", 1), ("b", 2)):
        y = _series(seed)[: 80 - 12 - 3 + 1]
        scores = []
        for o in ORDERS:
            _, e = _plain_fit(y, o)
            n, c = len(e), o[0] + o[2] + o[3] + o[5] + 1 + (o[1] + o[4] == 0)
            scores.append((n * math.log(e @ e / n) + 2 * c + 2 * c * (c + 1) / (n - c - 1), c, ",".join(map(str, o))))
        mine = sorted((r for r in got if r.k == k), key=lambda r: r["rank"])
        assert [r.candidate for r in mine] == [s[2] for s in sorted(scores)]
        assert [r.aicc for r in mine] == pytest.approx([s[0] for s in sorted(scores)], rel=1e-6)


def test_backtest_selection_and_diagnostics(spark, frame):
    long = frame.where("k <> 'short'")
    ranked = sarima.rank_orders(long, ["k"], tuple(ORDERS))
    folds = sarima.fold_forecasts(long, ranked, ["k"])
    scores = {(r.k, r.candidate, r.h): r for r in sarima.backtest_models(long, folds, ["k"]).collect()}
    for k, seed in (("a", 1), ("b", 2)):
        y = _series(seed)
        for o in ORDERS:
            errors, scaled, inside = [], [], []
            for origin in range(66, 78):
                theta, e = _plain_fit(y[:origin], o)
                point, spread = sarima.forecast(y[:origin], o, theta, e, len(e), 3)
                scale = np.abs(y[12:origin] - y[: origin - 12]).mean()
                errors.append(y[origin + 1] - point[1])
                scaled.append(abs(errors[-1]) / scale)
                inside.append(abs(errors[-1]) <= sarima.Z80 * spread[1])
            r = scores[k, ",".join(map(str, o)), 2]
            assert (r.n, r.misses) == (12, 0) and r.mase == pytest.approx(np.mean(scaled), rel=1e-6) and r.coverage80 == pytest.approx(np.mean(inside))
    checked = sarima.ljung_box(sarima.history_residuals(long, ranked, ["k"]), ["k", "candidate"], "e")
    chosen = sarima.select_candidates(sarima.backtest_models(long, folds, ["k"]), series.backtest_naive(long, ["k"]), checked, ["k"]).collect()
    good = {r.k: set() for r in chosen}
    for r in checked.select("*", sarima.passes().alias("ok")).collect():
        mean = np.mean([scores[r.k, r.candidate, h].mase for h in (1, 2, 3)])
        base = next(c.baseline_mase for c in chosen if c.k == r.k)
        if r.ok and mean <= 0.95 * base:
            good[r.k].add((sarima.parameters(tuple(map(int, r.candidate.split(",")))), mean, r.candidate))
    for c in chosen:
        assert (c.chosen, c.status) == ((min(good[c.k])[2], "published") if good[c.k] else ("seasonal_naive", "experimental"))


def test_diverged_folds_are_misses(spark, frame):
    one = frame.where("k = 'a'")
    wild = spark.createDataFrame([("a", "x", 2, 70, h, 1e9 if h == 2 else 10.0, 0.0, 20.0, 0.0, 20.0) for h in (1, 2, 3)], "k string, candidate string, parameters int, origin int, h int, point double, low80 double, high80 double, low95 double, high95 double")
    assert {(r.n, r.misses, r.mase) for r in sarima.backtest_models(one, wild, ["k"]).collect()} == {(0, 1, None)}


def test_ljung_box_by_hand(spark):
    x = np.random.default_rng(0).normal(size=60)
    d = x - x.mean()
    q = 60 * 62 * sum((d[k:] @ d[:-k] / (d @ d)) ** 2 / (60 - k) for k in range(1, 13))
    tail = math.exp(-q / 2) * sum((q / 2) ** k / math.factorial(k) for k in range(6))
    (r,) = sarima.ljung_box(spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(x)], "k string, i int, v double"), ["k"], "v").collect()
    assert (r.q, r.p, r["mean"], r.spread) == pytest.approx((q, tail, x.mean(), x.std()))


def test_definitions_share_levels_and_keep_empty_months(spark):
    levels = spark.createDataFrame([("p1", "1993-02-10", 5.0, 10.0, 30.0), ("p1", "1993-02-10", 150.0, 20.0, 31.0), ("p2", "1993-02-20", 100.0, 40.0, None), ("p3", "1993-04-01", 99.0, 7.0, 33.0), ("p4", "1993-02-01", None, 1.0, 1.0)],
                                   "profile_id string, at string, p double, t double, s double").withColumn("observed_at", F.to_timestamp("at"))
    placed = spark.createDataFrame([("p1", "r"), ("p2", "r"), ("p3", "r"), ("p1", "q"), ("p4", "r")], "profile_id string, region string")
    a = 1993 * 12
    rows = [("deep", "r", 100.0, 200.0, "temperature", 1, a, a + 3), ("least", "r", 0.0, 200.0, "temperature", 2, a, a + 3), ("salt", "q", 0.0, 200.0, "salinity", 1, a, a + 2), ("none", "x", 0.0, 9.0, "pressure", 1, a, a + 1)]
    definitions = spark.createDataFrame(rows, "series string, region string, depth_min double, depth_max double, variable string, min_profiles int, start long, end long")
    got = {(r.series, r.m - a): (r.y, r.n) for r in series.defined_series(levels, placed, definitions).collect()}
    assert got == {("deep", 0): (None, 0), ("deep", 1): (30.0, 2), ("deep", 2): (None, 0), ("least", 0): (None, 0), ("least", 1): (27.5, 2), ("least", 2): (None, 0), ("salt", 0): (None, 0), ("salt", 1): (30.5, 1), ("none", 0): (None, 0)}
