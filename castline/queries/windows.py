"""Window functions: flags over levels, latest rows, islands and trajectories."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from castline.operators import publication
from castline.registry import query, r6


@query("win_nonmonotonic", "SELECT profile_id, level_index, coalesce(p < last_value(p IGNORE NULLS) OVER (PARTITION BY profile_id ORDER BY level_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS nonmonotonic FROM b_sel")
def _(t):
    before = F.last("p", ignorenulls=True).over(W.partitionBy("profile_id").orderBy("level_index").rowsBetween(W.unboundedPreceding, -1))
    return t.selected().select("profile_id", "level_index", F.coalesce(F.col("p") < before, F.lit(False)).alias("nonmonotonic"))


@query("win_repeated", "SELECT profile_id, level_index, row_number() OVER (PARTITION BY profile_id, p ORDER BY level_index) > 1 AS repeated FROM b_delivered")
def _(t):
    return t.delivered.select("profile_id", "level_index", (F.row_number().over(W.partitionBy("profile_id", "p").orderBy("level_index")) > 1).alias("repeated"))


@query("win_newest", "SELECT platform_number, profile_id, longitude, latitude FROM (SELECT *, row_number() OVER (PARTITION BY platform_number ORDER BY observed_at DESC, profile_id DESC) AS r FROM b_profiles) WHERE r = 1")
def _(t):
    newest = t.profiles.groupBy("platform_number").agg(F.max_by(F.struct("profile_id", "longitude", "latitude"), F.struct("observed_at", "profile_id")).alias("m"))
    return newest.select("platform_number", "m.*")


@query("win_phase_timing", "SELECT event_type, CAST(sum(d) AS BIGINT) AS micros, count(*) AS n FROM (SELECT event_type, epoch_us(coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), TIMESTAMP '2024-02-01')) - epoch_us(ts) AS d FROM events) GROUP BY 1")
def _(t):
    following = F.lead("at").over(W.partitionBy("user_id").orderBy("at", "event_id"))
    rows = t.events.select("event_type", "event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    end = F.unix_micros(F.lit("2024-02-01").cast("timestamp"))
    return rows.select("event_type", (F.coalesce(following, end) - F.col("at")).alias("d")).groupBy("event_type").agg(F.sum("d").alias("micros"), F.count("*").alias("n"))


@query("win_last_accepted", """SELECT o_orderstatus AS chunk, o_custkey AS profile_id, max(o_orderkey) AS ordinal, arg_max(strftime(o_orderdate, '%Y-%m'), o_orderkey) AS slot, count(*) AS n FROM orders WHERE o_orderkey % 4 IN (0, 1) GROUP BY 1, 2""")
def _(t):
    """Orders play occurrences of a customer in a chunk; every second one is accepted."""
    k = F.col("o_orderkey")
    outcome = F.when(k % 4 == 0, "insert").when(k % 4 == 1, "newer").when(k % 4 == 2, "noop").otherwise("stale_skip")
    return publication.last_accepted(t.orders.select(F.col("o_orderstatus").alias("chunk"), F.col("o_custkey").alias("profile_id"), k.alias("ordinal"), outcome.alias("outcome"), F.date_format("o_orderdate", "yyyy-MM").alias("slot")))


@query("win_part_precedence", """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, o_custkey, n = o_orderkey % 4 + 1 AS complete FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM (SELECT l.*, o_custkey, o_orderkey, rank() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC) AS r FROM lineitem l JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P') WHERE r = 1)""")
def _(t):
    """Of parts that hold the same key the newest wins, ties stay; the manifest lists orders that are not pending, with levels that may not be as many."""
    keys = ("l_orderkey", "l_linenumber")
    rows = t.lineitem.select(*keys, "l_partkey", "l_extendedprice", F.col("l_shipdate").alias("generation"))
    orders = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", (F.col("o_orderkey") % 4 + 1).alias("levels"))
    manifest = rows.select(*keys).distinct().join(orders, "l_orderkey").withColumn("slot", F.struct(*keys))
    won = publication.newest_part(rows, manifest, *keys)
    checked = publication.merge_check(won, manifest, *keys).select("slot.*", "complete")
    return won.join(checked, list(keys)).join(orders.drop("levels"), "l_orderkey").select(*keys, "l_partkey", "l_extendedprice", "o_custkey", "complete")


_MONTHS = "b_months AS (SELECT platform_number, CAST(date_part('year', observed_at) * 12 + date_part('month', observed_at) - 1 AS BIGINT) AS m, avg(latitude) AS y, count(*) AS n FROM b_profiles GROUP BY 1, 2)"


def months(t):
    """Monthly mean latitude of each float by month number."""
    m = (F.year("observed_at") * 12 + F.month("observed_at") - 1).cast("long")
    return t.profiles.groupBy("platform_number", m.alias("m")).agg(F.avg("latitude").alias("y"), F.count("*").alias("n"))


@query("win_gap_runs", f"WITH {_MONTHS} SELECT platform_number, max(gap) AS longest_gap FROM (SELECT platform_number, coalesce(m - lag(m) OVER (PARTITION BY platform_number ORDER BY m) - 1, 0) AS gap FROM b_months) GROUP BY 1")
def _(t):
    gap = F.coalesce(F.col("m") - F.lag("m").over(W.partitionBy("platform_number").orderBy("m")) - 1, F.lit(0))
    return months(t).select("platform_number", gap.alias("gap")).groupBy("platform_number").agg(F.max("gap").alias("longest_gap"))


@query("win_trim", f"WITH {_MONTHS} SELECT platform_number, min(m) FILTER (n >= 2) AS first_month, max(m) FILTER (n >= 2) AS last_month FROM b_months GROUP BY 1")
def _(t):
    enough = F.when(F.col("n") >= 2, F.col("m"))
    return months(t).groupBy("platform_number").agg(F.min(enough).alias("first_month"), F.max(enough).alias("last_month"))


_SPINE = f"""WITH {_MONTHS}, b_ends AS (SELECT platform_number, min(m) AS a, max(m) AS b FROM b_months GROUP BY 1),
 b_spine AS (SELECT platform_number, unnest(range(a, b + 1)) AS m FROM b_ends), b_full AS (SELECT s.platform_number, s.m, y FROM b_spine s LEFT JOIN b_months x ON x.platform_number = s.platform_number AND x.m = s.m)"""


def spine(t):
    """Every month between a float's first and last, with a null where it has no profile."""
    x = months(t)
    ends = x.groupBy("platform_number").agg(F.min("m").alias("a"), F.max("m").alias("b"))
    return ends.select("platform_number", F.explode(F.sequence("a", "b")).alias("m")).join(x, ["platform_number", "m"], "left").select("platform_number", "m", "y")


@query("win_interpolate", f"""{_SPINE}, z AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN m END IGNORE NULLS) OVER w AS m0, last_value(y IGNORE NULLS) OVER w AS y0,
  first_value(CASE WHEN y IS NOT NULL THEN m END IGNORE NULLS) OVER v AS m1, first_value(y IGNORE NULLS) OVER v AS y1 FROM b_full
  WINDOW w AS (PARTITION BY platform_number ORDER BY m ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY platform_number ORDER BY m ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT platform_number, m, round(coalesce(y, y0 + (y1 - y0) * (m - m0) / (m1 - m0)) + 1e-9, 6) AS y, y IS NULL AS filled FROM z""")
def _(t):
    at = F.when(F.col("y").isNotNull(), F.col("m"))
    w = W.partitionBy("platform_number").orderBy("m")
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    z = spine(t).select("platform_number", "m", "y", F.last(at, True).over(back).alias("m0"), F.last("y", True).over(back).alias("y0"), F.first(at, True).over(ahead).alias("m1"), F.first("y", True).over(ahead).alias("y1"))
    linear = F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("m") - F.col("m0")) / F.nullif(F.col("m1") - F.col("m0"), F.lit(0))
    return z.select("platform_number", "m", r6(F.coalesce("y", linear), "y"), F.col("y").isNull().alias("filled"))


@query("win_seasonal_lag", f"{_SPINE} SELECT platform_number, m, round(lag(y, 12) OVER (PARTITION BY platform_number ORDER BY m) + 1e-9, 6) AS naive FROM b_full")
def _(t):
    return spine(t).select("platform_number", "m", r6(F.lag("y", 12).over(W.partitionBy("platform_number").orderBy("m")), "naive"))


@query("win_mase_scale", f"""{_SPINE}, d AS (SELECT platform_number, m, abs(y - lag(y, 12) OVER (PARTITION BY platform_number ORDER BY m)) AS d FROM b_full)
 SELECT platform_number, m, round(avg(d) OVER (PARTITION BY platform_number ORDER BY m ROWS UNBOUNDED PRECEDING) + 1e-9, 6) AS scale FROM d""")
def _(t):
    w = W.partitionBy("platform_number").orderBy("m")
    d = spine(t).withColumn("d", F.abs(F.col("y") - F.lag("y", 12).over(w)))
    return d.select("platform_number", "m", r6(F.avg("d").over(w.rowsBetween(W.unboundedPreceding, 0)), "scale"))


@query("win_month_islands", f"{_SPINE}, z AS (SELECT platform_number, m, m // 12 AS year, m - row_number() OVER (PARTITION BY platform_number, m // 12 ORDER BY m) AS g FROM b_full WHERE y IS NULL) SELECT platform_number, year, min(m) AS first_month, max(m) AS last_month, count(*) AS n FROM z GROUP BY platform_number, year, g")
def _(t):
    """Runs of missing months, cut at the turn of the year."""
    gone = spine(t).where("y IS NULL").withColumn("year", F.floor(F.col("m") / 12))
    run = gone.withColumn("g", F.col("m") - F.row_number().over(W.partitionBy("platform_number", "year").orderBy("m")))
    return run.groupBy("platform_number", "year", "g").agg(F.min("m").alias("first_month"), F.max("m").alias("last_month"), F.count("*").alias("n")).drop("g")


@query("win_coverage_gap", """WITH iv AS (SELECT l_suppkey AS cell, epoch_us(l_shipdate) // 86400000000 AS a, epoch_us(l_shipdate) // 86400000000 + 30 AS b FROM lineitem),
 r AS (SELECT cell, a, b, max(b) OVER (PARTITION BY cell ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM iv)
 SELECT cell, coalesce(bool_or(a > seen), false) AS has_gap, max(b) AS covered_to FROM r GROUP BY cell""")
def _(t):
    """Whether the union of a cell's intervals has a hole: a start beyond the largest end so far."""
    day = F.floor(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 86400000000)
    iv = t.lineitem.select(F.col("l_suppkey").alias("cell"), day.alias("a"), (day + 30).alias("b"))
    seen = F.max("b").over(W.partitionBy("cell").orderBy("a", "b").rowsBetween(W.unboundedPreceding, -1))
    return iv.withColumn("seen", seen).groupBy("cell").agg(F.coalesce(F.bool_or(F.col("a") > F.col("seen")), F.lit(False)).alias("has_gap"), F.max("b").alias("covered_to"))


@query("win_trajectory", "SELECT platform_number, profile_id, longitude, latitude, lead(longitude) OVER w AS next_longitude, lead(latitude) OVER w AS next_latitude FROM b_profiles WINDOW w AS (PARTITION BY platform_number ORDER BY observed_at, profile_id)")
def _(t):
    w = W.partitionBy("platform_number").orderBy("observed_at", "profile_id")
    return t.profiles.select("platform_number", "profile_id", "longitude", "latitude", F.lead("longitude").over(w).alias("next_longitude"), F.lead("latitude").over(w).alias("next_latitude"))


_ACF = ", ".join(f"round(sum(d * l{k}) / sum(d * d) + 1e-9, 6) AS r{k}" for k in (1, 2, 3))
_LAG = ", ".join(f"lag(d, {k}) OVER w AS l{k}" for k in (1, 2, 3))


@query("win_residual_acf", f"WITH v AS (SELECT user_id, event_id, ts, value - avg(value) OVER (PARTITION BY user_id) AS d FROM events), x AS (SELECT user_id, d, {_LAG} FROM v WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, {_ACF} FROM x GROUP BY user_id")
def _(t):
    """Autocorrelations of a user's values at lags 1 to 3."""
    mean = t.events.groupBy("user_id").agg(F.avg("value").alias("mean"))
    d = t.events.join(mean, "user_id").select("user_id", "ts", "event_id", (F.col("value") - F.col("mean")).alias("d"))
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    x = d.select("user_id", "d", *[F.lag("d", k).over(w).alias(f"l{k}") for k in (1, 2, 3)])
    return x.groupBy("user_id").agg(*[r6(F.sum(F.col("d") * F.col(f"l{k}")) / F.nullif(F.sum(F.col("d") * F.col("d")), F.lit(0.0)), f"r{k}") for k in (1, 2, 3)])


@query("j_asof_fill", f"""{_SPINE} SELECT platform_number, m, round(last_value(y IGNORE NULLS) OVER (PARTITION BY platform_number ORDER BY m ROWS UNBOUNDED PRECEDING) + 1e-9, 6) AS before,
 round(first_value(y IGNORE NULLS) OVER (PARTITION BY platform_number ORDER BY m ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) + 1e-9, 6) AS after FROM b_full""")
def _(t):
    w = W.partitionBy("platform_number").orderBy("m")
    return spine(t).select("platform_number", "m", r6(F.last("y", True).over(w.rowsBetween(W.unboundedPreceding, 0)), "before"), r6(F.first("y", True).over(w.rowsBetween(0, W.unboundedFollowing)), "after"))
