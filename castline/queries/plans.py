"""Plan documents: run, checked, named and accounted for."""

from __future__ import annotations

from pyspark.sql import functions as F

from castline.functions.geo import distance_sql
from castline.plans import document
from castline.registry import query

MONTHLY = {
    "time_range": {"start": "1996-01-01T00:00:00Z", "end": "1997-01-01T01:00:00+01:00"}, "geography": {"kind": "bbox", "west": 40, "south": -30, "east": 90, "north": 25},
    "depth_dbar": {"min": 0, "max": 1000}, "variables": ["salinity", "temperature"], "operation": {"kind": "aggregate", "group_by": ["month", "depth_bin"], "metrics": ["mean", "count", "max"], "depth_bin_size": 100},
}
PAGE = MONTHLY | {"variables": ["temperature"], "operation": {"kind": "profiles", "limit": 50, "cursor": "1996-09-01 00:00:00|5"}, "qc_policy": "raw"}
NEAREST = MONTHLY | {"operation": {"kind": "nearest", "longitude": 72.5, "latitude": -5.0, "radius_km": 1500.0, "k": 20}}

_IN = "observed_at >= TIMESTAMP '1996-01-01' AND observed_at < TIMESTAMP '1997-01-01'"
_BOX = "longitude BETWEEN 40 AND 90 AND latitude BETWEEN -30 AND 25"
_ROWS = f"SELECT profile_id, strftime(observed_at, '%Y-%m') AS month, floor(p / 100) * 100e0 AS depth_bin, avg(t) AS t, avg(s) AS s FROM b_sel WHERE {_IN} AND {_BOX} AND p BETWEEN 0 AND 1000 GROUP BY ALL"
_MONTHLY = f"SELECT month, depth_bin, round(avg(t) + 1e-9, 5) AS temperature_mean, count(t) AS temperature_count, round(max(t) + 1e-9, 5) AS temperature_max, round(avg(s) + 1e-9, 5) AS salinity_mean, count(s) AS salinity_count, round(max(s) + 1e-9, 5) AS salinity_max FROM ({_ROWS}) GROUP BY ALL"


@query("plan_run", _MONTHLY)
def _(t):
    made = document.run_plan(MONTHLY, t.profiles, t.levels)
    return made.select(*[F.round(F.col(c) + 1e-9, 5).alias(c) if kind == "double" and c != "depth_bin" else F.col(c) for c, kind in made.dtypes])


@query("plan_run_profiles", f"""SELECT profile_id, observed_at FROM b_profiles m WHERE {_IN} AND {_BOX} AND EXISTS (SELECT 1 FROM b_mode l WHERE l.profile_id = m.profile_id AND p BETWEEN 0 AND 1000)
 AND (observed_at < TIMESTAMP '1996-09-01' OR (observed_at = TIMESTAMP '1996-09-01' AND profile_id < '5')) ORDER BY observed_at DESC, profile_id DESC LIMIT 51""")
def _(t):
    return document.run_plan(PAGE, t.profiles, t.levels).select("profile_id", "observed_at")


@query("plan_run_stored", _MONTHLY)
def _(t):
    """The same plan over stored slots: only its twelve months, and of these only row groups of its tiles."""
    made = document.run_plan(MONTHLY, t.store.profiles, t.store.levels)
    return made.select(*[F.round(F.col(c) + 1e-9, 5).alias(c) if kind == "double" and c != "depth_bin" else F.col(c) for c, kind in made.dtypes])


_RAW = ", ".join(f"l.{c.format(v=v)}" for v in ("pressure", "temperature") for c in ("{v}", "{v}_adjusted", "{v}_qc", "{v}_adjusted_qc", "{v}_data_mode"))


@query("plan_run_raw", f"""WITH page AS (SELECT profile_id, observed_at FROM b_profiles m WHERE {_IN} AND {_BOX} AND EXISTS (SELECT 1 FROM b_mode l WHERE l.profile_id = m.profile_id AND p BETWEEN 0 AND 1000)
 AND (observed_at < TIMESTAMP '1996-09-01' OR (observed_at = TIMESTAMP '1996-09-01' AND profile_id < '5')) ORDER BY observed_at DESC, profile_id DESC LIMIT 50)
 SELECT l.profile_id, page.observed_at, l.level_index, {_RAW} FROM page JOIN b_levels l ON l.profile_id = page.profile_id JOIN b_mode s ON s.profile_id = l.profile_id AND s.level_index = l.level_index WHERE s.p BETWEEN 0 AND 1000""")
def _(t):
    """The levels behind a raw page, as stored."""
    return document.run_raw(PAGE, t.store.profiles, t.store.levels)


_D = distance_sql("longitude", "latitude", "72.5e0", "-5e0")


@query("plan_run_nearest", f"SELECT profile_id, round({_D}, 3) AS metres FROM b_profiles m WHERE {_IN} AND {_D} <= 1500000 AND EXISTS (SELECT 1 FROM b_sel l WHERE l.profile_id = m.profile_id AND p BETWEEN 0 AND 1000) ORDER BY {_D}, profile_id LIMIT 20")
def _(t):
    return document.run_plan(NEAREST, t.profiles, t.levels).select("profile_id", F.round("metres", 3).alias("metres"))


def plan_rows(t):
    """A plan for each order: its fields are the order's columns."""
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    pick = lambda by, *values: F.get(F.array(*map(F.lit, values)), (by % len(values)).cast("int"))
    keys = F.when(k % 5 == 0, F.array(F.lit("month"), F.lit("depth_bin"))).when(k % 5 == 1, F.array(F.lit("float"))).when(k % 5 == 2, F.array(F.lit("day"), F.lit("day"))).otherwise(F.array(F.lit("profile")))
    return t.orders.select(
        "o_orderkey", at.alias("start"), F.timestamp_seconds(F.unix_timestamp(at) + (k % 400 - 10) * 86400).alias("end"),
        (k % 900).cast("double").alias("depth_min"), (F.col("o_custkey") % 1000).cast("double").alias("depth_max"), (k % 60).cast("double").alias("west"), F.lit(-30.0).alias("south"), (F.col("o_custkey") % 60).cast("double").alias("east"), (k % 50 - 40).cast("double").alias("north"),
        F.when(F.col("o_orderstatus") == "F", "aggregate").when(F.col("o_orderstatus") == "O", "profiles").otherwise("nearest").alias("kind"),
        F.when(k % 7 > 0, (k % 1500).cast("int")).alias("limit_"), (k % 120).cast("int").alias("k"), (k % 2500).cast("double").alias("radius_km"), keys.alias("group_by"),
        F.when(k % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("mean"), pick(k, "count", "mean", "max"))).alias("metrics"), F.when(k % 3 == 0, 100).alias("depth_bin_size"),
        pick(k, "science_ready", "mode_selected", "raw").alias("qc_policy"), pick(F.col("o_custkey"), *document.PRESENTATIONS).alias("presentation"),
        F.when(k % 13 == 0, (k % 300).cast("int")).alias("bins"), F.when(k % 17 == 0, (k % 3000).cast("double")).alias("geo_km"),
        F.when(k % 2 == 0, F.array(F.lit("salinity"), F.lit("temperature"))).otherwise(F.array(F.lit("pressure"))).alias("variables"),
        F.lit("bbox").alias("geography"), F.lit(None).cast("string").alias("region"), *[F.lit(None).cast("double").alias(c) for c in ("geo_longitude", "geo_latitude")],
        (k % 360 - 180).cast("double").alias("longitude"), (k % 180 - 90).cast("double").alias("latitude"), F.lit(None).cast("string").alias("cursor"), F.lit("profile").alias("unit"),
    )


_SHOWS = "['table','line_chart','scatter','profile_plot','ts_diagram','histogram','map'][1 + c % 7]"
_PLANS = f"""WITH r AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS began, CASE o_orderstatus WHEN 'F' THEN 'aggregate' WHEN 'O' THEN 'profiles' ELSE 'nearest' END AS kind, o_orderkey % 400 - 10 AS days FROM orders),
 v AS (SELECT *, k % 3 = 2 AS raw, {_SHOWS} AS shown, CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END AS repeated, CASE WHEN k % 13 = 0 THEN k % 300 END AS bins FROM r)"""
_CODES = """concat_ws(',', CASE WHEN days <= 0 THEN 'time_range:invalid_time_range' END, CASE WHEN days > 366 THEN 'time_range:unbounded_request' END, CASE WHEN k % 900 >= c % 1000 THEN 'depth_dbar:invalid_depth_range' END,
 CASE WHEN -30 >= k % 50 - 40 THEN 'geography:invalid_geography' END, CASE WHEN k % 60 = c % 60 THEN 'geography:invalid_geography' END, CASE WHEN k % 17 = 0 AND k % 3000 > 2000 THEN 'geography.radius_km:invalid_geography' END,
 CASE WHEN raw AND kind <> 'profiles' THEN 'qc_policy:operation_variable_mismatch' END, CASE WHEN shown = 'ts_diagram' AND k % 2 = 1 THEN 'presentation.kind:operation_variable_mismatch' END,
 CASE WHEN shown IN ('profile_plot', 'ts_diagram') AND kind <> 'profiles' THEN 'presentation.kind:operation_variable_mismatch' END, CASE WHEN shown IN ('line_chart', 'histogram', 'scatter') AND kind <> 'aggregate' THEN 'presentation.kind:operation_variable_mismatch' END,
 CASE WHEN shown = 'line_chart' AND kind = 'aggregate' AND k % 5 IN (1, 3, 4) THEN 'presentation.kind:operation_variable_mismatch' END, CASE WHEN shown = 'map' AND kind = 'aggregate' THEN 'presentation.kind:operation_variable_mismatch' END,
 CASE WHEN bins IS NOT NULL AND shown <> 'histogram' THEN 'presentation.bins:invalid_value' END, CASE WHEN shown = 'histogram' AND bins > 200 THEN 'presentation.bins:unbounded_request' END,
 CASE WHEN kind = 'profiles' AND (k % 7 = 0 OR k % 1500 > 1000) THEN 'operation.limit:unbounded_request' END,
 CASE WHEN kind = 'nearest' AND k % 2500 > 2000 THEN 'operation.radius_km:invalid_geography' END, CASE WHEN kind = 'nearest' AND k % 120 > 100 THEN 'operation.k:unbounded_request' END, CASE WHEN kind = 'nearest' AND shown NOT IN ('table', 'map') THEN 'presentation.kind:operation_variable_mismatch' END,
 CASE WHEN kind = 'aggregate' AND k % 11 = 0 THEN 'operation.metrics:unbounded_request' END, CASE WHEN kind = 'aggregate' AND k % 11 <> 0 AND repeated = 1 THEN 'operation.metrics:invalid_value' END,
 CASE WHEN kind = 'aggregate' AND k % 5 = 2 THEN 'operation.group_by:invalid_value' END, CASE WHEN kind = 'aggregate' AND (k % 5 = 0) <> (k % 3 = 0) THEN 'operation.depth_bin_size:invalid_value' END,
 CASE WHEN kind = 'aggregate' AND k % 5 = 1 AND days > 31 THEN 'operation.group_by:unbounded_request' END)"""


@query("plan_rules", f"{_PLANS} SELECT k AS o_orderkey, {_CODES} AS codes FROM v")
def _(t):
    """Every rule that each plan of a table of plans breaks."""
    return plan_rows(t).select("o_orderkey", F.array_join(document.codes(), ",").alias("codes"))


_REAL = lambda x: f"CAST(CAST({x} AS DOUBLE) AS VARCHAR)"
_OPERATION = f"""CASE kind WHEN 'aggregate' THEN '{{"depth_bin_size":' || CASE WHEN k % 3 = 0 THEN '100' ELSE 'null' END || ',"group_by":' || CASE WHEN k % 5 = 0 THEN '["month","depth_bin"]' WHEN k % 5 = 1 THEN '["float"]' WHEN k % 5 = 2 THEN '["day","day"]' ELSE '["profile"]' END ||
  ',"kind":"aggregate","metrics":' || CASE WHEN k % 11 = 0 THEN '[]' ELSE '["mean","' || (['count','mean','max'])[1 + k % 3] || '"]' END || ',"unit":"profile"}}'
 WHEN 'nearest' THEN '{{"k":' || (k % 120) || ',"kind":"nearest","latitude":' || {_REAL('k % 180 - 90')} || ',"longitude":' || {_REAL('k % 360 - 180')} || ',"radius_km":' || {_REAL('k % 2500')} || '}}'
 ELSE '{{"cursor":null,"kind":"profiles","limit":' || CASE WHEN k % 7 > 0 THEN CAST(k % 1500 AS VARCHAR) ELSE 'null' END || '}}' END"""


@query("plan_hash", f"""{_PLANS} SELECT k AS o_orderkey, sha256('{{"dataset":"core","depth_dbar":{{"max":' || {_REAL('c % 1000')} || ',"min":' || {_REAL('k % 900')} || '}},"geography":{{"east":' || {_REAL('c % 60')} || ',"kind":"bbox","north":' || {_REAL('k % 50 - 40')} || ',"south":-30.0,"west":' || {_REAL('k % 60')} || '}},"operation":' || {_OPERATION} ||
 ',"plan_schema":"stage2-plan-v1","presentation":{{"bins":' || coalesce(CAST(bins AS VARCHAR), 'null') || ',"kind":"' || shown || '"}},"qc_policy":"' || (['science_ready','mode_selected','raw'])[1 + k % 3] || '","time_range":{{"end":"' || strftime(began + to_days(CAST(days AS INT)), '%Y-%m-%dT%H:%M:%SZ') ||
 '","start":"' || strftime(began, '%Y-%m-%dT%H:%M:%SZ') || '"}},"variables":' || CASE WHEN k % 2 = 0 THEN '["temperature","salinity"]' ELSE '["pressure"]' END || '}}') AS plan_sha256 FROM v""")
def _(t):
    """Digests of a table of plans over all their fields: equal plans have equal digests, however their fields were written."""
    return plan_rows(t).select("o_orderkey", F.sha2(document.plan_text(), 256).alias("plan_sha256"))


@query("plan_provenance", f"""WITH q AS (SELECT profile_id FROM b_profiles WHERE {_IN} AND {_BOX}), h AS (SELECT sum(CAST('0x' || substr(sha256(profile_id), 1, 15) AS BIGINT)) AS s, count(*) AS n FROM q)
 SELECT '{document.plan_sha256(MONTHLY)}' AS plan_sha256, n AS row_count, sha256(n || ':' || coalesce(s, 0)) AS result_sha256, (SELECT count(DISTINCT observation_month) FROM b_profiles WHERE {_IN}) AS months_covered, (SELECT count(*) FROM b_profiles WHERE {_IN}) AS profiles_in_time,
 'science_ready' AS qc_policy, 'stage2-plan-v1' AS plan_schema FROM h""")
def _(t):
    """The row beside a result: here of the ids of the plan's profiles."""
    from castline.functions.geo import in_bbox

    p = document.canonical(MONTHLY)["time_range"]
    ids = t.profiles.where((F.col("observed_at") >= F.lit(p["start"]).cast("timestamp")) & (F.col("observed_at") < F.lit(p["end"]).cast("timestamp")) & in_bbox(40, -30, 90, 25)).select("profile_id")
    made = document.provenance(MONTHLY, ids, t.profiles)
    return made.select("plan_sha256", "row_count", "result_sha256", "months_covered", "profiles_in_time", "qc_policy", "plan_schema")


COUNTED = MONTHLY | {"operation": {"kind": "aggregate", "group_by": ["month", "profile"], "metrics": ["count"], "unit": "measurement"}, "variables": ["temperature"]}


@query("plan_provenance_result", f"""WITH q AS (SELECT strftime(observed_at, '%Y-%m') AS month, profile_id AS profile, count(t) AS n FROM b_sel WHERE {_IN} AND {_BOX} AND p BETWEEN 0 AND 1000 GROUP BY ALL),
 h AS (SELECT count(*) AS n, sum(CAST('0x' || substr(sha256(month || chr(31) || profile || chr(31) || n), 1, 15) AS HUGEINT)) AS s FROM q),
 g AS (SELECT m.m, x, y FROM (SELECT unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1996-12-01', INTERVAL 1 MONTH)) AS m) m, (SELECT unnest([40, 50, 60, 70, 80]) AS x), (SELECT unnest([-30, -20, -10, 0, 10]) AS y)),
 c AS (SELECT count(*) AS total, count(*) FILTER (EXISTS (SELECT 1 FROM b_profiles p WHERE p.observation_month = CAST(g.m AS DATE) AND floor((longitude - 20) / 10) * 10 + 20 = x AND floor((latitude + 60) / 10) * 10 - 60 = y)) AS covered FROM g)
 SELECT '{document.plan_sha256(COUNTED)}' AS plan_sha256, n AS row_count, sha256(n || ':' || coalesce(s, 0)) AS result_sha256, total AS slots_total, covered AS slots_covered, total - covered AS slots_missing, 'profiles and levels of the bridge' AS credit FROM h, c""")
def _(t):
    """The row beside a plan's own result, with the coverage of its slots and whom to credit."""
    from castline.operators.coverage import SLOT, request_slots

    time = t.spark.createDataFrame([("1996-01-01", "1997-01-01")], "a string, b string").select(F.col("a").cast("timestamp").alias("request_start"), F.col("b").cast("timestamp").alias("request_end"))
    slots = request_slots(time, t.spark.createDataFrame([(x, y) for x in (40, 50, 60, 70, 80) for y in (-30, -20, -10, 0, 10)], "west long, south long"))
    corner = lambda c, first: (F.floor((F.col(c) - first) / 10) * 10 + first).cast("long")
    held = t.profiles.select(F.col("observation_month").alias("month"), corner("longitude", 20).alias("west"), corner("latitude", -60).alias("south")).distinct().withColumn("held", F.lit(True))
    states = slots.join(held, list(SLOT), "left").select(F.when(F.col("held"), "covered").otherwise("fetch_coverage").alias("state"))
    result = document.run_plan(COUNTED, t.store.profiles, t.store.levels)
    made = document.provenance(COUNTED, result, t.profiles, states, {"bridge": "profiles and levels of the bridge"})
    return made.select("plan_sha256", "row_count", "result_sha256", "slots_total", "slots_covered", "slots_missing", F.col("attribution")["bridge"].alias("credit"))


@query("d02_quarter_profile", "SELECT month, round(avg(t) + 1e-9, 5) AS temperature_mean, count(t) AS temperature_count FROM (SELECT profile_id, strftime(observed_at, '%Y-%m') AS month, avg(t) AS t FROM b_sel WHERE observed_at >= TIMESTAMP '1996-01-01' AND observed_at < TIMESTAMP '1996-04-01' GROUP BY ALL) GROUP BY month")
def _(t):
    """The whole envelope over a quarter, by month, one value for each profile: run as a plan."""
    plan = {
        "time_range": {"start": "1996-01-01T00:00:00Z", "end": "1996-04-01T00:00:00Z"}, "geography": {"kind": "bbox", "west": -180, "south": -90, "east": 180, "north": 90}, "variables": ["temperature"],
        "operation": {"kind": "aggregate", "group_by": ["month"], "metrics": ["mean", "count"]},
    }
    made = document.run_plan(plan, t.store.profiles, t.store.levels)
    return made.select("month", F.round(F.col("temperature_mean") + 1e-9, 5).alias("temperature_mean"), "temperature_count")
