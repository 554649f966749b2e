"""Aggregations: metrics in both units, reports and tallies."""

from __future__ import annotations

from pyspark.sql import functions as F

from castline.functions.qc import VARIABLES, qc_value
from castline.operators import results
from castline.operators.aggregate import aggregate, key
from castline.operators.publication import group_requests
from castline.operators.quantiles import quantiles
from castline.operators.reporting import map_clusters, reconcile
from castline.registry import query, r6

_METRICS = ("mean", "count", "min", "max", "stddev", "median")
_M_SQL = {
    "mean": "round(avg({v}) + 1e-9, 6)", "count": "count({v})", "min": "round(min({v}) + 1e-9, 6)", "max": "round(max({v}) + 1e-9, 6)",
    "stddev": "round(stddev_samp({v}) + 1e-9, 6)", "median": "round(quantile_cont({v}, 0.5) + 1e-9, 6)",
}
_KEYS = {"month": "strftime(observed_at,'%Y-%m')", "day": "strftime(observed_at,'%Y-%m-%d')", "profile": "profile_id", "float": "platform_number", "depth_bin": "floor(p/100)*100e0", "region": "'Envelope'"}


def _aggregate_query(name: str, keys: tuple[str, ...], unit: str, band: tuple[int, int] | None = (0, 2000), metrics: tuple[str, ...] = _METRICS, bin_size: int = 100, stored: bool = False):
    """``stored``: over the slot store, which needs headers only for what a level row does not carry."""
    cols = {k: v.replace("100", str(bin_size)) if k == "depth_bin" else v for k, v in _KEYS.items()}
    where = f"WHERE p BETWEEN {band[0]} AND {band[1]}" if band else ""
    sel, names = ", ".join(f"{cols[k]} AS {k}" for k in keys), ", ".join(keys)
    parts = [f"{_M_SQL[m].format(v='t')} AS temperature_{m}" for m in metrics]
    if unit == "measurement":
        sql = f"SELECT {sel}, {', '.join(parts)} FROM b_sel {where} GROUP BY ALL"
    else:
        sql = f"SELECT {names}, {', '.join(parts)} FROM (SELECT profile_id AS pid, {sel}, avg(t) AS t FROM b_sel {where} GROUP BY ALL) GROUP BY {names}"

    @query(name, sql)
    def _(t):
        rows = t.store.selected(headers=("platform_number",) if "float" in keys else ()) if stored else t.selected()
        rows = rows if not band else rows.where(F.col("p").between(*band))
        month = F.date_format("observation_month", "yyyy-MM").alias("month")
        made = aggregate(rows, [month if stored and k == "month" else key(k, bin_size, "Envelope") for k in keys], list(keys), {"temperature": F.col("t")}, metrics, unit)
        return made.select(*[r6(F.col(c), c) if kind == "double" else F.col(c) for c, kind in made.dtypes])


_aggregate_query("agg_measurement", ("month",), "measurement")
_aggregate_query("agg_profile_balanced", ("month",), "profile")
_aggregate_query("agg_metrics", ("region",), "measurement", None)
_aggregate_query("key_month_day", ("month", "day"), "profile", metrics=("mean", "count"))
_aggregate_query("key_profile_float", ("float", "profile"), "measurement", metrics=("mean", "count"))
_aggregate_query("key_depth_bin", ("depth_bin",), "measurement", None)
_aggregate_query("key_region", ("region",), "profile")
# The ten plans of the latency matrix, over the slot store.
_aggregate_query("d01_month_profile", ("month",), "profile", None, ("mean", "count"), stored=True)
_aggregate_query("d03_month_measurement", ("month",), "measurement", None, ("mean", "count"), stored=True)
_aggregate_query("d04_month_depth100_profile", ("month", "depth_bin"), "profile", (0, 2000), ("mean", "count"), stored=True)
_aggregate_query("d05_month_depth100_measurement", ("month", "depth_bin"), "measurement", (0, 2000), ("mean", "count"), stored=True)
_aggregate_query("d06_month_depth50_profile", ("month", "depth_bin"), "profile", (0, 1000), ("mean", "count"), 50, stored=True)
_aggregate_query("d07_month_depth50_measurement", ("month", "depth_bin"), "measurement", (0, 1000), ("mean", "count"), 50, stored=True)
_aggregate_query("d08_month_float_profile", ("month", "float"), "profile", None, ("mean", "count"), stored=True)
_aggregate_query("d09_month_float_measurement", ("month", "float"), "measurement", None, ("mean", "count"), stored=True)
_aggregate_query("d10_month_depth50_whole", ("month", "depth_bin"), "profile", None, ("mean", "count"), 50, stored=True)


@query("agg_float_stats", """SELECT platform_number, count(*) AS profiles, min(observed_at) AS first_at, max(observed_at) AS last_at, min(cycle_number) AS first_cycle, max(cycle_number) AS last_cycle,
  arg_max(longitude, (observed_at, profile_id)) AS longitude, arg_max(latitude, (observed_at, profile_id)) AS latitude FROM b_profiles GROUP BY platform_number""")
def _(t):
    at = F.struct("observed_at", "profile_id")
    return t.profiles.groupBy("platform_number").agg(
        F.count("*").alias("profiles"), F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"), F.min("cycle_number").alias("first_cycle"),
        F.max("cycle_number").alias("last_cycle"), F.max_by("longitude", at).alias("longitude"), F.max_by("latitude", at).alias("latitude"))


@query("agg_cycles_per_float", "SELECT platform_number, count(DISTINCT cycle_number) AS cycles FROM b_profiles GROUP BY 1")
def _(t):
    return t.profiles.groupBy("platform_number").agg(F.countDistinct("cycle_number").alias("cycles"))


@query("agg_snapshot_counts", "SELECT count(*) AS profiles, CAST(sum(n) AS BIGINT) AS levels, CAST(bit_xor(CAST('0x' || substr(md5(profile_id || '|' || profile_hash || '|' || n), 1, 15) AS BIGINT)) AS BIGINT) AS digest FROM (SELECT m.profile_id, m.profile_hash, count(*) AS n FROM b_profiles m JOIN b_delivered l ON l.profile_id = m.profile_id GROUP BY ALL)")
def _(t):
    """Counts and an order-free digest: the exclusive-or of row hashes, so that no row set is gathered."""
    rows = t.delivered.groupBy("profile_id").agg(F.count("*").alias("n")).join(t.profiles.select("profile_id", "profile_hash"), "profile_id")
    mark = F.conv(F.substring(F.md5(F.concat_ws("|", "profile_id", "profile_hash", F.col("n").cast("string"))), 1, 15), 16, 10).cast("long")
    return rows.agg(F.count("*").alias("profiles"), F.sum("n").alias("levels"), F.bit_xor(mark).alias("digest"))


@query("agg_reconciliation", """WITH s AS (SELECT m.profile_id, m.observed_at, count(*) AS n FROM b_profiles m JOIN b_delivered l ON l.profile_id = m.profile_id GROUP BY ALL),
 u AS (SELECT 'stored_full' AS scope, n FROM s UNION ALL SELECT 'stored_eligible', n FROM s WHERE observed_at < TIMESTAMP '1998-01-01' UNION ALL SELECT 'snapshot_full', n FROM s WHERE n > 1 UNION ALL SELECT 'snapshot_eligible', n FROM s WHERE n > 1 AND observed_at < TIMESTAMP '1998-01-01')
 SELECT scope, count(*) AS profiles, CAST(sum(n) AS BIGINT) AS levels FROM u GROUP BY scope""")
def _(t):
    stored = t.delivered.groupBy("profile_id").agg(F.count("*").alias("n")).join(t.profiles.select("profile_id", "observed_at"), "profile_id")
    early = F.col("observed_at") < F.lit("1998-01-01").cast("timestamp")
    scopes = F.array_compact(F.array(F.lit("stored_full"), F.when(early, "stored_eligible"), F.when(F.col("n") > 1, "snapshot_full"), F.when((F.col("n") > 1) & early, "snapshot_eligible")))
    return stored.select(F.explode(scopes).alias("scope"), "n").groupBy("scope").agg(F.count("*").alias("profiles"), F.sum("n").alias("levels"))


@query("agg_retries", "SELECT user_id, CAST(sum(n - 1) AS BIGINT) AS retries FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("retries"))


@query("agg_ledger_balance", "SELECT a.k AS month, a.n AS reported, coalesce(b.n, 0) AS ledger, a.n = coalesce(b.n, 0) AS balanced FROM (SELECT strftime(o_orderdate, '%Y-%m') AS k, count(*) AS n FROM orders GROUP BY 1) a LEFT JOIN (SELECT strftime(l_shipdate, '%Y-%m') AS k, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) b ON a.k = b.k")
def _(t):
    a = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("reported"))
    b = t.lineitem.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.countDistinct("l_orderkey").alias("ledger"))
    both = a.join(b, "month", "left").withColumn("ledger", F.coalesce("ledger", F.lit(0)))
    return both.withColumn("balanced", F.col("reported") == F.col("ledger"))


@query("agg_slot_profiles", "SELECT CAST(observation_month AS VARCHAR) AS observation_month, CASE WHEN longitude = 120 THEN 110 ELSE floor((longitude - 20) / 10) * 10 + 20 END::BIGINT AS west, count(*) AS n FROM b_profiles GROUP BY 1, 2")
def _(t):
    west = F.when(F.col("longitude") == 120, 110).otherwise(F.floor((F.col("longitude") - 20) / 10) * 10 + 20).cast("long")
    return t.profiles.groupBy(F.col("observation_month").cast("string").alias("observation_month"), west.alias("west")).agg(F.count("*").alias("n"))


@query("agg_slot_census", "SELECT (SELECT max(n) FROM (SELECT count(*) AS n FROM b_profiles GROUP BY observation_month)) AS most, (SELECT count(*) FROM (SELECT cycle_number FROM b_profiles GROUP BY 1 HAVING count(DISTINCT direction) > 1)) AS shared")
def _(t):
    most = t.profiles.groupBy("observation_month").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"))
    shared = t.profiles.groupBy("cycle_number").agg(F.countDistinct("direction").alias("d")).agg(F.count_if(F.col("d") > 1).alias("shared"))
    return most.crossJoin(shared)  # one row each


@query("agg_compactable", "SELECT l_orderkey, count(*) AS parts FROM lineitem GROUP BY 1 HAVING count(*) >= 6")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("parts")).where("parts >= 6")


@query("agg_level_depth", """WITH c AS (SELECT direction, CASE WHEN cycle_number <> 13 THEN n END AS n FROM b_profiles m LEFT JOIN (SELECT profile_id, count(*) AS n FROM b_delivered GROUP BY 1) l ON l.profile_id = m.profile_id)
 SELECT direction, grouping(direction) = 1 AS overall, count(*) AS profiles, count(*) FILTER (n IS NULL) AS unknown, CAST(coalesce(sum(n), 0) AS BIGINT) AS levels, round(avg(n) + 1e-9, 6) AS mean, min(n) AS least, max(n) AS most FROM c GROUP BY GROUPING SETS ((direction), ())""")
def _(t):
    """Levels a profile by direction and overall; of cycle 13, and of profiles without levels, they are unknown."""
    n = t.delivered.groupBy("profile_id").agg(F.count("*").alias("n"))
    counts = t.profiles.join(n, "profile_id", "left").select("direction", F.when(F.col("cycle_number") != 13, F.col("n")).alias("levels"))
    return results.level_depth_stats(counts, "direction").withColumn("mean", F.round(F.col("mean") + 1e-9, 6))


@query("agg_qc_tally", "WITH x AS (" + " UNION ALL ".join(f"""SELECT '{v}' AS variable, CASE WHEN {v}_data_mode = 'R' AND {v}_qc IN ('1','2') THEN {v} WHEN {v}_data_mode IN ('A','D') AND {v}_adjusted_qc IN ('1','2') THEN {v}_adjusted END AS x,
 {v}_data_mode AS mode, CASE WHEN {v}_data_mode = 'R' THEN {v}_qc WHEN {v}_data_mode IN ('A','D') THEN {v}_adjusted_qc END AS qc FROM b_levels""" for v in VARIABLES) + """)
 SELECT variable, 'kept' AS kind, NULL AS code, count(*) AS n FROM x WHERE x IS NOT NULL GROUP BY 1 UNION ALL SELECT variable, 'mode', mode, count(*) FROM x WHERE mode IS NOT NULL GROUP BY 1, 3 UNION ALL SELECT variable, 'qc', qc, count(*) FROM x WHERE qc IS NOT NULL GROUP BY 1, 3""")
def _(t):
    return results.qc_mode_tally(t.levels, "science_ready")


@query("agg_empty_reason", """SELECT reason, count(*) AS n FROM (SELECT profile_id, CASE WHEN count(t) > 0 AND count(p) > 0 THEN 'usable' WHEN count(t) = 0 AND count(p) = 0 THEN 'no_good_values' WHEN count(t) = 0 THEN 'no_good_temperature' ELSE 'no_good_pressure' END AS reason
  FROM b_sel GROUP BY 1) GROUP BY 1""")
def _(t):
    rows = t.levels.select("profile_id", qc_value("temperature", "science_ready").alias("t"), qc_value("pressure", "science_ready").alias("p"))
    each = rows.groupBy("profile_id").agg(F.count("t").alias("t"), F.count("p").alias("p"))
    none_t, none_p = F.col("t") == 0, F.col("p") == 0
    reason = F.when(~none_t & ~none_p, "usable").when(none_t & none_p, "no_good_values").when(none_t, "no_good_temperature").otherwise("no_good_pressure")
    return each.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("agg_summary_stats", " UNION ALL ".join(f"""SELECT '{c}' AS "column", round(min({c}) + 1e-9, 6) AS lo, round(max({c}) + 1e-9, 6) AS hi, round(avg({c}) + 1e-9, 6) AS mean, count({c}) AS n FROM b_sel""" for c in ("level_index", "p", "t", "s", "cycle_number", "longitude", "latitude")))
def _(t):
    """Every numeric column of a result, whatever it holds."""
    return results.summarize(t.selected()).select("column", r6(F.col("lo"), "lo"), r6(F.col("hi"), "hi"), r6(F.col("mean"), "mean"), "n")


@query("agg_summary_rows", "SELECT profile_id, level_index, p, t, s FROM b_sel ORDER BY t DESC NULLS LAST, profile_id, level_index LIMIT 12")
def _(t):
    """The first rows beside a summary: warmest first."""
    rows = t.selected().select("profile_id", "level_index", "p", "t", "s")
    return results.first_rows(rows, F.desc_nulls_last("t"), "profile_id", "level_index")


@query("agg_histogram", """WITH m AS (SELECT profile_id, avg(t) AS t FROM b_sel GROUP BY 1 HAVING count(t) > 0), r AS (SELECT min(t) AS lo, max(t) AS hi FROM m),
 b AS (SELECT least(19, CAST(floor((t - lo) / (hi - lo) * 20) AS BIGINT)) AS bin, count(*) AS n FROM m, r GROUP BY 1) SELECT i AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(20)) AS i) LEFT JOIN b ON bin = i""")
def _(t):
    """Twenty equal bins of per-profile means, empty bins kept."""
    means = t.levels.select("profile_id", qc_value("temperature", "science_ready").alias("t")).groupBy("profile_id").agg(F.avg("t").alias("t")).where("t IS NOT NULL")
    rows = means.crossJoin(F.broadcast(means.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))))  # one row of bounds
    bins = rows.select(F.least(F.lit(19), F.floor((F.col("t") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 20)).cast("long").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    return t.spark.range(20).select(F.col("id").alias("bin")).join(bins, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


@query("agg_bounds", "SELECT min(longitude) AS west, min(latitude) AS south, max(longitude) AS east, max(latitude) AS north FROM b_profiles WHERE direction = 'U'")
def _(t):
    return t.profiles.where("direction = 'U'").agg(F.min("longitude").alias("west"), F.min("latitude").alias("south"), F.max("longitude").alias("east"), F.max("latitude").alias("north"))


@query("agg_map_clusters", """SELECT CAST(floor((longitude + 180) / 360 * 4096 / 36) AS BIGINT) AS cx, CAST(floor((1 - ln(tan(radians(latitude)) + 1 / cos(radians(latitude))) / pi()) / 2 * 4096 / 36) AS BIGINT) AS cy,
  count(*) AS n, round(avg(longitude) + 1e-9, 6) AS lon, round(avg(latitude) + 1e-9, 6) AS lat FROM b_profiles GROUP BY 1, 2""")
def _(t):
    """Web-Mercator cells of 36 px at zoom 4 (256 px tiles)."""
    lat = F.radians("latitude")
    cx = F.floor((F.col("longitude") + 180) / 360 * 4096 / 36)
    cy = F.floor((1 - F.log(F.tan(lat) + 1 / F.cos(lat)) / F.pi()) / 2 * 4096 / 36)
    return t.profiles.groupBy(cx.alias("cx"), cy.alias("cy")).agg(F.count("*").alias("n"), r6(F.avg("longitude"), "lon"), r6(F.avg("latitude"), "lat"))


@query("agg_series_chart", """WITH g AS (SELECT direction AS series, strftime(observed_at, '%Y-%m') AS x, avg(t) AS temperature, avg(s) AS salinity FROM b_sel GROUP BY 1, 2), p AS (SELECT 'temperature' AS metric, series, x, temperature AS y FROM g UNION ALL SELECT 'salinity', series, x, salinity FROM g),
 b AS (SELECT count(*) AS n_series, max(n) AS longest, CASE WHEN max(n) > 60 OR count(*) > 10 THEN 'result_too_large' END AS verdict FROM (SELECT count(*) AS n FROM p GROUP BY metric, series)) SELECT metric, series, x, round(y + 1e-9, 6) AS y, n_series, longest, verdict FROM p, b""")
def _(t):
    """Points of each (metric, direction) by month beside the check of the chart's bounds."""
    means = t.selected().groupBy(F.date_format("observed_at", "yyyy-MM").alias("x"), F.col("direction").alias("series")).agg(F.avg("t").alias("temperature"), F.avg("s").alias("salinity"))
    points = results.series_points(means, "x", "series", ("temperature", "salinity"))
    return points.crossJoin(F.broadcast(results.series_bounds(points, 60, 10))).select("metric", "series", "x", r6(F.col("y"), "y"), "n_series", "longest", "verdict")  # one row of bounds


@query("agg_ts_points", "SELECT profile_id, level_index, t, s FROM b_mode WHERE profile_id IN (SELECT profile_id FROM b_profiles ORDER BY observed_at DESC, profile_id DESC LIMIT 20) AND t IS NOT NULL AND s IS NOT NULL")
def _(t):
    newest = t.profiles.orderBy(F.desc("observed_at"), F.desc("profile_id")).limit(20).select("profile_id")
    values = t.levels.select("profile_id", "level_index", qc_value("temperature", "mode_selected").alias("t"), qc_value("salinity", "mode_selected").alias("s"))
    return values.join(F.broadcast(newest), "profile_id", "left_semi").where("t IS NOT NULL AND s IS NOT NULL")


@query("agg_llm_cost", "SELECT event_id, round(value * CASE event_type WHEN 'click' THEN 0.002e0 WHEN 'view' THEN 0.001e0 ELSE 0.01e0 END, 9) AS cost, event_type NOT IN ('click', 'view') AS by_default FROM events")
def _(t):
    prices = t.spark.createDataFrame([("click", 0.002), ("view", 0.001)], "event_type string, price double")
    joined = t.events.join(F.broadcast(prices), "event_type", "left")
    return joined.select("event_id", F.round(F.col("value") * F.coalesce("price", F.lit(0.01)), 9).alias("cost"), F.col("price").isNull().alias("by_default"))


@query("agg_percentile_rank", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def _(t):
    return quantiles(t.events, ["event_type"], "value", {"p50": ("nearest", 0.5), "p95": ("nearest", 0.95)})


@query("agg_percentile_index", "SELECT event_type, max(value) FILTER (r - 1 = CAST(round_even(0.9e0 * (n - 1), 0) AS BIGINT)) AS p90 FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY 1")
def _(t):
    """Value at index round(0.9 * (n - 1)), half to even."""
    return quantiles(t.events, ["event_type"], "value", {"p90": ("index", 0.9)})


_TRAITS = {"ascending": "direction = 'A'", "descending": "direction = 'D'", "unknown": "direction = 'U'", "sideways": "direction = 'S'", "last_cycle": "cycle_number = 399", "outer_edge": "longitude = 120", "southernmost": "latitude = -60", "beyond": "latitude > 30"}


@query("agg_witness", " UNION ALL ".join(f"SELECT '{n}' AS trait, count(*) FILTER ({c}) AS witnesses, min(profile_id) FILTER ({c}) AS first, count(*) FILTER ({c}) = 0 AS gap FROM b_profiles" for n, c in _TRAITS.items()))
def _(t):
    """Which traits some profile shows, and which none does."""
    return results.witness_matrix(t.profiles, "profile_id", {n: F.expr(c) for n, c in _TRAITS.items()})


@query("agg_store_growth", "SELECT o_orderpriority, a AS before, b AS after, b - a AS added FROM (SELECT o_orderpriority, count(*) FILTER (o_orderdate < TIMESTAMP '1997-01-01') AS a, count(*) AS b FROM orders GROUP BY 1)")
def _(t):
    early = F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp")
    made = t.orders.groupBy("o_orderpriority").agg(F.count_if(early).alias("before"), F.count("*").alias("after"))
    return made.withColumn("added", F.col("after") - F.col("before"))


@query("agg_attachment", """SELECT sha256('{"format":"csv","lang":' || coalesce('"' || lang || '"', 'null') || ',"n_chars":' || coalesce(n_chars % 50 || '', 'null') || ',"source":' || coalesce('"' || source || '"', 'null') || '}') AS request, arg_min(doc_id, (n_chars // 100, doc_id)) AS job, count(*) AS attached FROM documents GROUP BY 1""")
def _(t):
    """Requests whose canonical form is the same share the job that came first."""
    requests = t.documents.select(F.col("doc_id").alias("job_id"), F.floor(F.col("n_chars") / 100).alias("created_at"), "source", "lang", (F.col("n_chars") % 50).alias("n_chars"), F.lit("csv").alias("format"))
    return group_requests(requests, "source", "n_chars", "lang", "format")


_MEMBERS = "SELECT profile_id, CASE WHEN cycle_number % 90 = 3 THEN md5(profile_hash) ELSE profile_hash END AS hash, n AS levels FROM st WHERE observed_at >= TIMESTAMP '1996-01-01' OR cycle_number % 90 <> 4"


@query("agg_reconcile_scopes", f"""WITH st AS (SELECT m.profile_id, profile_hash, observed_at, cycle_number, count(*) AS n FROM b_profiles m JOIN b_delivered l ON l.profile_id = m.profile_id GROUP BY ALL), mb AS ({_MEMBERS}),
 u AS (SELECT 'full_stored' AS scope, profile_id, profile_hash AS hash, n AS levels FROM st UNION ALL SELECT 'full_snapshot', * FROM mb UNION ALL SELECT 'run_eligible_stored', profile_id, profile_hash, n FROM st WHERE observed_at >= TIMESTAMP '1996-01-01' AND observed_at < TIMESTAMP '1996-02-01'
  UNION ALL SELECT 'run_eligible_snapshot', mb.* FROM mb JOIN st USING (profile_id) WHERE observed_at >= TIMESTAMP '1996-01-01' AND observed_at < TIMESTAMP '1996-02-01'),
 g AS (SELECT scope, count(*) AS profiles, CAST(sum(levels) AS BIGINT) AS levels, CAST(sum(CAST('0x' || substr(sha256(profile_id || '|' || hash || '|' || levels), 1, 15) AS HUGEINT)) AS VARCHAR) AS digest FROM u GROUP BY scope)
 SELECT g.*, g.profiles = o.profiles AND g.levels = o.levels AND g.digest = o.digest AS balanced FROM g JOIN g o ON o.scope = CASE WHEN g.scope LIKE '%stored' THEN replace(g.scope, 'stored', 'snapshot') ELSE replace(g.scope, 'snapshot', 'stored') END""")
def _(t):
    """Four populations with counts, digest and balance; manifests list some profiles by an older hash, and lack some early ones."""
    counts = t.delivered.groupBy("profile_id").agg(F.count("*").alias("levels"))
    stored = counts.join(t.profiles.select("profile_id", F.col("profile_hash").alias("hash"), "observed_at", "cycle_number"), "profile_id")
    listed = stored.where((F.col("observed_at") >= F.lit("1996-01-01").cast("timestamp")) | (F.col("cycle_number") % 90 != 4)).withColumn("hash", F.when(F.col("cycle_number") % 90 == 3, F.md5("hash")).otherwise(F.col("hash")))
    return reconcile(stored, listed, "1996-01-01", "1996-02-01")


@query("agg_map_pyramid", """SELECT CAST(z AS INT) AS zoom, CAST(floor((longitude + 180) / 360 * 256 * pow(2, z) / 36) AS BIGINT) AS cx, CAST(floor((1 - ln(tan(radians(latitude)) + 1 / cos(radians(latitude))) / pi()) / 2 * 256 * pow(2, z) / 36) AS BIGINT) AS cy,
  count(*) AS n, round(avg(longitude) + 1e-9, 6) AS lon, round(avg(latitude) + 1e-9, 6) AS lat FROM b_profiles, (SELECT unnest(range(8)) AS z) GROUP BY 1, 2, 3""")
def _(t):
    """Clusters of zooms 0 to 7 from one scan."""
    return map_clusters(t.profiles).select("zoom", "cx", "cy", "n", r6(F.col("longitude"), "lon"), r6(F.col("latitude"), "lat"))
