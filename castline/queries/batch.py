"""Decisions of a batch over the bridge frames: outcomes, moves, caps, receipts, the fetch plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from castline.functions.geo import tile_key
from castline.operators import ingestion
from castline.queries.accounting import SLOTS, slots
from castline.registry import query

_WEST = "CASE WHEN longitude = 120 THEN 110 ELSE CAST(floor((longitude - 20) / 10) * 10 + 20 AS INT) END"
_SOUTH = "CASE WHEN latitude = 30 THEN 20 ELSE CAST(floor((latitude + 60) / 10) * 10 - 60 AS INT) END"
_TILE = f"{_WEST} || '_' || {_SOUTH}"


@query("ing_classify", f"""SELECT profile_id, CASE WHEN cycle_number % 50 = 0 THEN 'outside_core' WHEN observed_at < TIMESTAMP '1996-01-01' OR observed_at >= TIMESTAMP '2001-01-01' THEN 'outside_time'
 WHEN longitude < 30 OR latitude < -50 THEN 'outside_region' WHEN {_WEST} <> (floor(longitude / 10 + CASE WHEN cycle_number % 11 = 3 THEN 1 ELSE 0 END) * 10) OR latitude = 30 THEN 'overlap_duplicate' WHEN direction = 'U' THEN 'excluded_source_loss' ELSE 'candidate' END AS outcome FROM b_profiles""")
def _(t):
    """A batch of tiles that overlap: one profile in eleven came with the next tile to the east, as did those on the envelope's outer edges."""
    p, cycle = t.profiles, F.col("cycle_number")
    names = F.when(cycle % 50 == 0, F.array(F.lit("doxy"), F.lit("doxy_argoqc"), F.lit("pressures"))).when(cycle % 2 == 0, F.array(F.lit("doxy"), F.lit("temperature_argoqc"))).otherwise(F.array(F.lit("pressure")))
    west = (F.floor(F.col("longitude") / 10 + F.when(cycle % 11 == 3, 1).otherwise(0)) * 10).cast("int")
    south = (F.floor((F.col("latitude") + 60) / 10) * 10 - 60).cast("int")
    rows = p.select("profile_id", "observed_at", "longitude", "latitude", names.alias("names"), (F.col("direction") == "U").alias("source_loss"), west.alias("west"), south.alias("south"))
    inside = (F.col("longitude") >= 30) & (F.col("latitude") >= -50)
    return ingestion.classify(rows, "1996-01-01", "2001-01-01", inside, F.col("west"), F.col("south")).select("profile_id", "outcome")


@query("ing_moved", f"""WITH a AS (SELECT profile_id, {_TILE} AS old FROM b_profiles), b AS (SELECT profile_id, {_TILE} AS new FROM (SELECT profile_id, least(120e0, longitude + cycle_number % 5 * 2) AS longitude, latitude FROM b_profiles WHERE cycle_number % 3 = 0)),
 m AS (SELECT profile_id, old, new FROM a JOIN b USING (profile_id) WHERE old <> new) SELECT profile_id, old AS slot, 'leaves' AS kind FROM m UNION ALL SELECT profile_id, new, 'enters' FROM m""")
def _(t):
    """Corrections of every third cycle's place, by up to 8 degrees."""
    slot = tile_key(F.col("longitude"), F.col("latitude")).alias("slot")
    moved = t.profiles.where("cycle_number % 3 = 0").withColumn("longitude", F.least(F.lit(120.0), F.col("longitude") + F.col("cycle_number") % 5 * 2))
    return ingestion.moved_profiles(t.profiles.select("profile_id", slot), moved.select("profile_id", slot))


@query("ing_chunk_caps", "SELECT strftime(o_orderdate, '%Y-%m') AS chunk, count(*) AS profiles, CAST(coalesce(sum(n), 0) AS BIGINT) AS levels, CASE WHEN count(*) > 190 THEN 'profile_count_limit' WHEN sum(n) > 720 THEN 'measurement_count_limit' END AS rejection FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1")
def _(t):
    """Months as chunks with their levels; caps fit for the tables."""
    counts = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("level_count"))
    staged = t.orders.join(counts, "o_orderkey", "left").select(F.date_format("o_orderdate", "yyyy-MM").alias("chunk"), "level_count")
    return ingestion.cap_check(staged, most_profiles=190, most_levels=720)


@query("ing_receipts", f"""WITH p AS (SELECT CAST(observation_month AS VARCHAR) || '/' || {_TILE} AS slot, observation_month AS m, cycle_number AS c, longitude < 100 AS sel FROM b_profiles),
 b AS (SELECT slot, count(*) AS n, count(*) FILTER (sel) AS s FROM p WHERE c % 2 = 0 GROUP BY 1), i AS (SELECT slot, count(*) AS n, count(*) FILTER (sel) AS s FROM p WHERE c % 4 = 1 AND m >= DATE '1997-01-01' GROUP BY 1),
 o AS (SELECT slot, count(*) AS n, count(*) FILTER (sel) AS s FROM p WHERE c % 4 = 0 AND m < DATE '1999-01-01' GROUP BY 1), w AS (SELECT slot, bool_or(c % 4 = 3) AS observed FROM p WHERE m >= DATE '1998-01-01' GROUP BY 1),
 j AS (SELECT k.slot, coalesce(b.n, 0) - coalesce(o.n, 0) + coalesce(i.n, 0) AS members, coalesce(b.s, 0) - coalesce(o.s, 0) + coalesce(i.s, 0) AS selected, i.slot IS NOT NULL OR o.slot IS NOT NULL AS changed, coalesce(observed, true) AS observed
  FROM (SELECT slot FROM i UNION SELECT slot FROM o UNION SELECT slot FROM w) k LEFT JOIN b USING (slot) LEFT JOIN i USING (slot) LEFT JOIN o USING (slot) LEFT JOIN w USING (slot))
 SELECT slot, members, selected, changed, CASE WHEN observed THEN 'profiles_returned' WHEN selected > 0 THEN 'source_absence_over_retained' ELSE 'verified_empty_fetch' END AS fetch_disposition,
  CASE WHEN changed AND members = 0 THEN 'empty_stored_domain' WHEN selected > 0 THEN 'active_generation' ELSE 'empty_stored_selection' END AS stored_disposition FROM j""")
def _(t):
    """Even cycles are stored, some depart, some odd ones arrive; slots from 1998 on were asked for."""
    slot = F.concat_ws("/", F.col("observation_month").cast("string"), tile_key(F.col("longitude"), F.col("latitude")))
    p = t.profiles.select(slot.alias("slot"), F.col("observation_month").alias("m"), F.col("cycle_number").alias("c"), (F.col("longitude") < 100).alias("selected"))
    before = p.where("c % 2 = 0").groupBy("slot").agg(F.count("*").alias("members"), F.count_if("selected").alias("selected"))
    own = p.where("m >= DATE '1998-01-01'").groupBy("slot").agg(F.bool_or(F.col("c") % 4 == 3).alias("observed"))
    return ingestion.receipts(before, p.where("c % 4 = 1 AND m >= DATE '1997-01-01'"), p.where("c % 4 = 0 AND m < DATE '1999-01-01'"), own)


_LISTED = "array_to_string([x.w || '_' || x.s FOR x IN list_sort(list(DISTINCT {'w': west, 's': south}))], ',') AS tiles"


def _tiles(column="tiles"):
    return F.array_join(F.transform(column, lambda x: F.concat_ws("_", x["west"].cast("string"), x["south"].cast("string"))), ",").alias("tiles")


@query("ing_fetch_plan", f"""WITH s AS ({SLOTS}), r AS (SELECT count(*) AS slots_total, count(*) FILTER (state <> 'missing') AS slots_reused, count(*) FILTER (state = 'missing') AS slots_missing, round(count(*) FILTER (state <> 'missing') / count(*) + 1e-9, 4) AS reuse_ratio FROM s),
 x AS (SELECT * FROM s WHERE state = 'missing' AND month + INTERVAL 1 MONTH <= TIMESTAMP '1998-03-15'),
 z AS (SELECT *, date_part('year', month) AS y, date_part('year', month) * 12 + date_part('month', month) - dense_rank() OVER (PARTITION BY date_part('year', month) ORDER BY month) AS g FROM x WHERE (west + date_part('month', month)) % 3 > 0 OR date_part('month', month) < 6),
 c AS (SELECT min(month) AS a, max(month) AS b, count(DISTINCT month) AS months, {_LISTED} FROM z GROUP BY y, g)
 SELECT CASE WHEN months = 1 THEN strftime(a, '%Y-%m') ELSE strftime(a, '%Y-%m') || '..' || strftime(b, '%Y-%m') END AS label, CAST(a AS VARCHAR) AS first_month, CAST(b AS VARCHAR) AS last_month, months, tiles, r.* FROM c, r""")
def _(t):
    """Chunks for missing slots that have ended, with the share of slots that need no fetch; some slots came in meanwhile."""
    found = slots(t)
    month = F.month("month")
    open_ = found.where(((F.col("west") + month) % 3 > 0) | (month < 6))
    plan = ingestion.plan_missing(open_, "1998-03-15")
    return plan.select("label", F.col("first_month").cast("string").alias("first_month"), F.col("last_month").cast("string").alias("last_month"), "months", _tiles()).crossJoin(F.broadcast(ingestion.reuse(found)))  # one row


@query("ing_narrow", f"SELECT state, CAST(min(month) AS VARCHAR) AS first_month, CAST(CAST(max(month) + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS end_month, {_LISTED} FROM ({SLOTS}) WHERE south > -10 AND month BETWEEN DATE '1996-03-01' AND DATE '1996-08-01' GROUP BY 1")
def _(t):
    """What holds the slots of each state, of a part of the sea over half a year."""
    asked = slots(t).where("south > -10 AND month BETWEEN DATE '1996-03-01' AND DATE '1996-08-01'")
    made = ingestion.narrow(asked, "state")
    return made.select("state", F.col("start").cast("string").alias("first_month"), F.col("end").cast("string").alias("end_month"), _tiles())
