"""Series and forecasting over the monthly temperature of each direction."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from castline.operators import sarima
from castline.operators import series as ops
from castline.operators.regions import in_regions
from castline.queries.selection import _IN_REGION, EDGES
from castline.registry import query, r6
from castline.scratch import stored

KEYS = ["direction"]

_SERIES = """WITH each AS (SELECT direction, profile_id, CAST(date_part('year', observed_at) * 12 + date_part('month', observed_at) - 1 AS BIGINT) AS m, avg(t) AS t FROM b_sel WHERE p BETWEEN 0 AND 1000 GROUP BY 1, 2, 3),
 f AS (SELECT direction, m, avg(t) AS y, count(t) AS n FROM each GROUP BY 1, 2), e AS (SELECT direction, min(m) AS a, max(m) AS b FROM f GROUP BY 1),
 s AS (SELECT e.direction, x.m, CASE WHEN f.n >= 3 THEN f.y END AS y, coalesce(f.n, 0) AS n FROM e, LATERAL (SELECT unnest(range(a, b + 1)) AS m) x LEFT JOIN f ON f.direction = e.direction AND f.m = x.m)"""
_FILLED = _SERIES + """, z AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN m END IGNORE NULLS) OVER w AS m0, last_value(y IGNORE NULLS) OVER w AS y0, first_value(CASE WHEN y IS NOT NULL THEN m END IGNORE NULLS) OVER v AS m1, first_value(y IGNORE NULLS) OVER v AS y1
 FROM s WINDOW w AS (PARTITION BY direction ORDER BY m ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY direction ORDER BY m ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 g AS (SELECT direction, m, coalesce(y, y0 + (y1 - y0) * (m - m0) / nullif(m1 - m0, 0)) AS y, y IS NULL AS filled, row_number() OVER (PARTITION BY direction ORDER BY m) - 1 AS i, count(*) OVER (PARTITION BY direction) AS size FROM z WHERE m0 IS NOT NULL AND m1 IS NOT NULL)"""
_TEXT = "printf('%04d-%02d', m // 12, m % 12 + 1)"


def observed(t):
    return ops.monthly(t.selected().where(F.col("p").between(0, 1000)), KEYS, 3)


def filled(t):
    """The series without gaps, stored: the queries below go over it several times."""
    return stored(ops.interpolated(observed(t), KEYS), "series")


@query("fc_series", f"{_SERIES} SELECT direction, {_TEXT} AS month, round(y + 1e-9, 6) AS y, n FROM s")
def _(t):
    return observed(t).select("direction", ops.month_text(F.col("m")).alias("month"), r6(F.col("y"), "y"), "n")


@query("fc_missing_policy", f"""{_SERIES}, k AS (SELECT *, coalesce(m - lag(m) OVER (PARTITION BY direction ORDER BY m) - 1, 0) AS gap FROM s WHERE y IS NOT NULL),
 q AS (SELECT direction, max(m) - min(m) + 1 AS n_months, max(m) - min(m) + 1 - count(*) AS missing, max(gap) AS longest_gap FROM k GROUP BY 1)
 SELECT *, CASE WHEN n_months < 36 THEN 'too_short' WHEN missing > 0.2 * n_months THEN 'too_many_missing' WHEN longest_gap > 2 THEN 'gap_too_long' ELSE 'ok' END AS verdict FROM q""")
def _(t):
    return ops.refusal(observed(t), KEYS)


@query("fc_eligibility", f"{_FILLED} SELECT direction, count(*) AS n, CASE WHEN count(*) < 36 THEN 'too_short' WHEN stddev_samp(y) < 1e-9 THEN 'constant' WHEN 3 > count(*) / 4 THEN 'horizon_too_long' ELSE 'ok' END AS verdict FROM g GROUP BY 1")
def _(t):
    made = filled(t).groupBy("direction").agg(F.count("*").alias("n"), F.stddev_samp("y").alias("sd"))
    verdict = F.when(F.col("n") < 36, "too_short").when(F.col("sd") < 1e-9, "constant").when(F.lit(3) > F.col("n") / 4, "horizon_too_long").otherwise("ok")
    return made.select("direction", "n", verdict.alias("verdict"))


@query("fc_naive", f"""{_FILLED}, r AS (SELECT direction, i, y - lag(y, 12) OVER (PARTITION BY direction ORDER BY i) AS e FROM g), c AS (SELECT direction, avg(e) AS mean FROM r GROUP BY 1),
 w AS (SELECT r.direction, quantile_cont(abs(e - mean), 0.8) AS w80, quantile_cont(abs(e - mean), 0.95) AS w95 FROM r JOIN c ON c.direction = r.direction WHERE e IS NOT NULL GROUP BY 1)
 SELECT g.direction, CAST(i - size + 13 AS INT) AS h, round(y + 1e-9, 6) AS point, round(y - w80 + 1e-9, 6) AS low80, round(y + w80 + 1e-9, 6) AS high80, round(y - w95 + 1e-9, 6) AS low95, round(y + w95 + 1e-9, 6) AS high95 FROM g JOIN w ON w.direction = g.direction WHERE i >= size - 12 AND i < size - 9""")
def _(t):
    """Value a season before, with intervals from the centred absolute seasonal differences."""
    made = ops.seasonal_naive(filled(t), KEYS)
    return made.select("direction", "h", *[r6(F.col(c), c) for c in ("point", "low80", "high80", "low95", "high95")])


_ORIGINS = ", o AS (SELECT direction, size, unnest(range(size - 14, size - 2)) AS origin FROM (SELECT DISTINCT direction, size FROM g)), oh AS (SELECT direction, CAST(origin AS INT) AS origin, CAST(unnest([1, 2, 3]) AS INT) AS h FROM o WHERE origin >= 25)"


@query("fc_origins", f"{_FILLED}{_ORIGINS} SELECT * FROM oh")
def _(t):
    return ops.origins(filled(t), KEYS)


@query("fc_backtest_naive", f"""{_FILLED}{_ORIGINS}, d AS (SELECT direction, i, y, abs(y - lag(y, 12) OVER (PARTITION BY direction ORDER BY i)) AS d FROM g), sc AS (SELECT direction, i + 1 AS origin, avg(d) OVER (PARTITION BY direction ORDER BY i ROWS UNBOUNDED PRECEDING) AS scale FROM d),
 b AS (SELECT oh.direction, h, a.y - p.y AS e, scale FROM oh JOIN d a ON a.direction = oh.direction AND a.i = oh.origin + h - 1 JOIN d p ON p.direction = oh.direction AND p.i = oh.origin - 12 + h - 1 JOIN sc ON sc.direction = oh.direction AND sc.origin = oh.origin)
 SELECT direction, h, count(*) AS n, round(avg(abs(e)) + 1e-9, 6) AS mae, round(sqrt(avg(e * e)) + 1e-9, 6) AS rmse, round(avg(abs(e) / scale) + 1e-9, 6) AS mase FROM b GROUP BY 1, 2""")
def _(t):
    made = ops.backtest_naive(filled(t), KEYS)
    return made.select("direction", "h", "n", *[r6(F.col(c), c) for c in ("mae", "rmse", "mase")])


@query("fc_sarima_grid")
def _(t):
    """All 144 orders on each series' first training window; rows only, as the fit is numerical."""
    return sarima.rank_orders(filled(t), KEYS).select("direction", F.col("candidate").alias("order"), F.round("aicc", 3).alias("aicc"), "rank")


def _models(t):
    """(series, ranked candidates, forecasts by fold), each stored: what follows goes over them several times."""
    s = filled(t)
    ranked = stored(sarima.rank_orders(s, KEYS), "ranked")
    return s, ranked, stored(sarima.fold_forecasts(s, ranked, KEYS), "folds")


@query("fc_backtest_models")
def _(t):
    """The best three orders of each series, refitted to every fold: errors, scaled error and coverage by horizon."""
    s, _, folds = _models(t)
    made = sarima.backtest_models(s, folds, KEYS)
    return made.select("direction", "candidate", "parameters", "h", "n", "misses", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "mase", "coverage80", "coverage95")])


@query("fc_select_models")
def _(t):
    """The model of each series, chosen from its fitted candidates by error, parameters and residuals."""
    s, ranked, folds = _models(t)
    checked = sarima.ljung_box(sarima.history_residuals(s, ranked, KEYS), [*KEYS, "candidate"], "e")
    made = sarima.select_candidates(sarima.backtest_models(s, folds, KEYS), ops.backtest_naive(s, KEYS), checked, KEYS)
    return made.select("direction", "chosen", "status", F.round("mase", 4).alias("mase"), F.round("baseline_mase", 4).alias("baseline_mase"))


@query("fc_diagnostics_models")
def _(t):
    """Residuals of the refitted candidates: Ljung-Box at the season, mean and spread, and whether they pass."""
    s = filled(t)
    ranked = stored(sarima.rank_orders(s, KEYS), "ranked")
    checked = sarima.ljung_box(sarima.history_residuals(s, ranked, KEYS), [*KEYS, "candidate"], "e")
    return checked.select("direction", "candidate", *[F.round(c, 4).alias(c) for c in ("q", "p", "mean", "spread")], sarima.passes().alias("passes"))


# Eight definitions (region, band, variable, least profiles) over the test polygons.
DEFINITIONS = [
    ("west upper t", "west", 0.0, 200.0, "temperature", 3), ("west deep t", "west", 500.0, 1500.0, "temperature", 3), ("west s", "west", 0.0, 2000.0, "salinity", 2), ("ring upper t", "ring", 0.0, 100.0, "temperature", 2),
    ("ring s", "ring", 200.0, 1000.0, "salinity", 4), ("ring all t", "ring", 0.0, 2000.0, "temperature", 1), ("tri t", "tri", 0.0, 1000.0, "temperature", 2), ("tri none", "tri", 11000.0, 12000.0, "pressure", 1),
]
_DEFINED = ", ".join(f"('{n}', '{r}', {a}e0, {b}e0, '{v}', {k})" for n, r, a, b, v, k in DEFINITIONS)


@query("fc_series_defined", f"""{_IN_REGION}, d AS (SELECT * FROM (VALUES {_DEFINED}) v(series, region, depth_min, depth_max, variable, least)),
 each AS (SELECT series, profile_id, m, avg(CASE variable WHEN 'temperature' THEN t WHEN 'salinity' THEN s ELSE p END) AS v FROM (SELECT *, CAST(date_part('year', observed_at) * 12 + date_part('month', observed_at) - 1 AS BIGINT) AS m FROM b_sel) l JOIN h USING (profile_id) JOIN d USING (region)
  WHERE p BETWEEN depth_min AND depth_max AND m BETWEEN {1993 * 12} AND {1997 * 12 - 1} GROUP BY 1, 2, 3), f AS (SELECT series, m, avg(v) AS y, count(v) AS n FROM each GROUP BY 1, 2)
 SELECT d.series, x.m, round(CASE WHEN n >= least THEN y END + 1e-9, 6) AS y, coalesce(n, 0) AS n FROM d, (SELECT CAST(unnest(range({1993 * 12}, {1997 * 12})) AS BIGINT) AS m) x LEFT JOIN f ON f.series = d.series AND f.m = x.m""")
def _(t):
    """Four years of eight series that are rows of a table: one pass over the levels makes all of them."""
    made = ops.defined_series(t.selected(), placed(t), definitions(t))
    return made.select("series", "m", r6(F.col("y"), "y"), "n")


def definitions(t):
    rows = [(n, r, a, b, v, k, 1993 * 12, 1997 * 12) for n, r, a, b, v, k in DEFINITIONS]
    return t.spark.createDataFrame(rows, "series string, region string, depth_min double, depth_max double, variable string, min_profiles int, start long, end long")


def placed(t):
    return in_regions(t.profiles, t.spark.createDataFrame(EDGES, "region string, x1 double, y1 double, x2 double, y2 double"))


@query("fc_divergence", f"{_FILLED}, x AS (SELECT direction, max(abs(y)) AS top FROM g GROUP BY 1) SELECT g.direction, m, abs(y * CASE WHEN m % 17 = 0 THEN 1e6 ELSE 1 END) > 1000 * (top + 1) AS diverged FROM g JOIN x ON x.direction = g.direction")
def _(t):
    s = filled(t)
    top = s.groupBy(*KEYS).agg(F.max(F.abs("y")).alias("top"))
    point = F.col("y") * F.when(F.col("m") % 17 == 0, 1e6).otherwise(1.0)
    return s.join(top, KEYS).select("direction", "m", ops.diverged(point, F.col("top")).alias("diverged"))


_Q = " + ".join(f"pow(sum(d * l{k}) / sum(d * d), 2) / (count(*) - {k})" for k in range(1, 13))
_L = ", ".join(f"lag(d, {k}) OVER w AS l{k}" for k in range(1, 13))
_TAIL = " + ".join(f"pow(q / 2, {k}) / {f}e0" for k, f in enumerate((1, 1, 2, 6, 24, 120)))


@query("fc_diagnostics", f"{_FILLED}, v AS (SELECT direction, i, y - avg(y) OVER (PARTITION BY direction) AS d FROM g), x AS (SELECT direction, d, {_L} FROM v WINDOW w AS (PARTITION BY direction ORDER BY i)), c AS (SELECT direction, count(*) * (count(*) + 2) * ({_Q}) AS q FROM x GROUP BY 1) SELECT direction, round(q + 1e-9, 6) AS q, round(exp(-q / 2) * ({_TAIL}) + 1e-9, 6) AS p FROM c")
def _(t):
    """Ljung-Box at lag 12; with twelve degrees of freedom the chi-square tail is a finite sum."""
    s = ops.numbered(filled(t), KEYS)
    d = s.join(s.groupBy(*KEYS).agg(F.avg("y").alias("mean")), KEYS).select(*KEYS, "i", (F.col("y") - F.col("mean")).alias("d"))
    w = W.partitionBy(*KEYS).orderBy("i")
    x = d.select(*KEYS, "d", *[F.lag("d", k).over(w).alias(f"l{k}") for k in range(1, 13)])
    sums = x.groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum(F.col("d") * F.col("d")).alias("dd"), *[F.sum(F.col("d") * F.col(f"l{k}")).alias(f"s{k}") for k in range(1, 13)])
    q = F.col("n") * (F.col("n") + 2) * sum((F.pow(F.col(f"s{k}") / F.col("dd"), 2) / (F.col("n") - k) for k in range(2, 13)), F.pow(F.col("s1") / F.col("dd"), 2) / (F.col("n") - 1))
    sums = sums.withColumn("q", q)
    tail = sum((F.pow(F.col("q") / 2, k) / f for k, f in enumerate((1, 1, 2, 6, 24, 120)) if k), F.lit(1.0))
    return sums.select("direction", r6(F.col("q"), "q"), r6(F.exp(-F.col("q") / 2) * tail, "p"))


@query("fc_future", f"{_FILLED} SELECT direction, printf('%04d-%02d', (top + h) // 12, (top + h) % 12 + 1) AS month, CAST(h AS INT) AS h FROM (SELECT direction, max(m) AS top FROM g GROUP BY 1), (SELECT unnest([1, 2, 3]) AS h)")
def _(t):
    top = filled(t).groupBy(*KEYS).agg(F.max("m").alias("top"))
    return top.select("direction", "top", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("h")).select("direction", ops.month_text(F.col("top") + F.col("h")).alias("month"), "h")


@query("fc_snapshot", f"{_SERIES} SELECT direction, sha256(string_agg(m || ':' || n, ',' ORDER BY m)) AS digest FROM s GROUP BY 1")
def _(t):
    """Content digest of each series' months and counts."""
    rows = observed(t).groupBy("direction").agg(F.array_sort(F.collect_list(F.struct("m", "n"))).alias("x"))
    return rows.select("direction", F.sha2(F.array_join(F.transform("x", lambda v: F.concat_ws(":", v["m"].cast("string"), v["n"].cast("string"))), ","), 256).alias("digest"))


@query("fc_figure_rows", f"{_FILLED} SELECT direction, CAST(m AS BIGINT) AS m, CASE WHEN filled THEN 'interpolated' ELSE 'observed' END AS kind, round(y + 1e-9, 6) AS y FROM g UNION ALL SELECT direction, m + 12, 'forecast', round(y + 1e-9, 6) FROM g WHERE i >= size - 12 AND i < size - 9")
def _(t):
    s = ops.numbered(filled(t), KEYS)
    size = s.groupBy(*KEYS).agg(F.count("*").alias("size"))
    history = s.select("direction", "m", F.when(F.col("filled"), "interpolated").otherwise("observed").alias("kind"), r6(F.col("y"), "y"))
    ahead = s.join(size, KEYS).where("i >= size - 12 AND i < size - 9").select("direction", (F.col("m") + 12).alias("m"), F.lit("forecast").alias("kind"), r6(F.col("y"), "y"))
    return history.unionByName(ahead)


_BACKTEST = f"""{_FILLED}{_ORIGINS}, d AS (SELECT direction, i, y, abs(y - lag(y, 12) OVER (PARTITION BY direction ORDER BY i)) AS d FROM g), sc AS (SELECT direction, i + 1 AS origin, avg(d) OVER (PARTITION BY direction ORDER BY i ROWS UNBOUNDED PRECEDING) AS scale FROM d),
 b AS (SELECT oh.direction, h, a.y - p.y AS e, scale FROM oh JOIN d a ON a.direction = oh.direction AND a.i = oh.origin + h - 1 JOIN d p ON p.direction = oh.direction AND p.i = oh.origin - 12 + h - 1 JOIN sc ON sc.direction = oh.direction AND sc.origin = oh.origin),
 k AS (SELECT *, coalesce(m - lag(m) OVER (PARTITION BY direction ORDER BY m) - 1, 0) AS gap FROM s WHERE y IS NOT NULL), q AS (SELECT direction, max(m) - min(m) + 1 AS n_months, max(m) - min(m) + 1 - count(*) AS missing, max(gap) AS longest_gap FROM k GROUP BY 1),
 v AS (SELECT direction, CASE WHEN n_months < 36 THEN 'too_short' WHEN missing > 0.2 * n_months THEN 'too_many_missing' WHEN longest_gap > 2 THEN 'gap_too_long' ELSE 'ok' END AS verdict FROM q)"""


@query("fc_report", f"""{_BACKTEST} SELECT v.direction, CASE WHEN verdict = 'ok' THEN 'forecast' ELSE 'refused' END AS status, CASE WHEN verdict <> 'ok' THEN verdict END AS reason, CASE WHEN verdict = 'ok' THEN count(e) END AS forecasts,
 {', '.join(f"CASE WHEN verdict = 'ok' THEN round(avg(abs(e) / scale) FILTER (h = {h}) + 1e-9, 6) END AS mase_h{h}" for h in (1, 2, 3))} FROM v LEFT JOIN b ON b.direction = v.direction GROUP BY v.direction, verdict""")
def _(t):
    """Status and scaled error by horizon of each series; the series is made once and stored."""
    seen = stored(observed(t), "series")
    made = ops.report(ops.refusal(seen, KEYS), ops.backtest_naive(stored(ops.interpolated(seen, KEYS), "filled"), KEYS), KEYS)
    return made.select("direction", "status", "reason", "forecasts", *[r6(F.col(f"mase_h{h}"), f"mase_h{h}") for h in (1, 2, 3)])


_AICC = " UNION ALL ".join(f"SELECT direction, {k} AS candidate, count(e) AS n, avg(e * e) AS v FROM (SELECT direction, y - lag(y, {k}) OVER (PARTITION BY direction ORDER BY i) AS e FROM g) GROUP BY 1" for k in range(1, 13))


@query("top_aicc", f"""{_FILLED}, ff AS ({_AICC}), a AS (SELECT direction, candidate, candidate + 1 AS parameters, n * ln(v) + 2 * (candidate + 1) + 2e0 * (candidate + 1) * (candidate + 2) / (n - candidate - 2) AS aicc FROM ff WHERE n > candidate + 2)
 SELECT direction, candidate, parameters, round(aicc + 1e-9, 4) AS aicc, rank FROM (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY aicc, parameters, candidate) AS rank FROM a) WHERE rank <= 3""")
def _(t):
    """The best three of twelve models of each series."""
    made = ops.best_candidates(ops.lag_candidates(filled(t), KEYS, range(1, 13)), KEYS)
    return made.select("direction", "candidate", "parameters", F.round(F.col("aicc") + 1e-9, 4).alias("aicc"), "rank")


_FITS = " UNION ALL ".join(f"SELECT direction, {k} AS candidate, avg(abs(e)) AS error, abs(avg(e)) <= 0.1 * stddev_samp(e) AS passes FROM (SELECT direction, y - lag(y, {k}) OVER (PARTITION BY direction ORDER BY i) AS e FROM g) GROUP BY 1" for k in range(1, 13))


@query("fc_select", f"""{_FILLED}, ff AS ({_FITS}), bb AS (SELECT direction, error AS b FROM ff WHERE candidate = 12),
 cc AS (SELECT ff.direction, min(candidate) AS c FROM ff JOIN bb ON bb.direction = ff.direction WHERE candidate <> 12 AND passes AND error <= 0.95 * b GROUP BY 1)
 SELECT bb.direction, CAST(coalesce(c, 12) AS INT) AS chosen, CASE WHEN c IS NULL THEN 'experimental' ELSE 'selected' END AS status FROM bb LEFT JOIN cc ON cc.direction = bb.direction""")
def _(t):
    """Of eleven lags the shortest that is 5 % better than the season before and has a centred residual."""
    return ops.select_model(ops.lag_candidates(filled(t), KEYS, range(1, 13)), KEYS, 12)
