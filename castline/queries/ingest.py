"""Batch quality and change operators: classification, duplicates, identity, revisions, merge, coverage."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from castline.functions.geo import tile_key
from castline.functions.qc import canonical_unit, implausible, place_variant
from castline.functions.text import file_parts
from castline.operators import coverage, matching, publication
from castline.operators.aggregate import ordered_totals
from castline.operators.flags import level_flags
from castline.operators.revisions import merge_batch, revision_outcome
from castline.registry import query
from castline.scratch import new_path
from castline.sinks import compaction
from castline.sinks.writers import digest


@query("ing_dedupe", """WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS n, min(l_partkey * 1000 + l_suppkey) AS first, count(DISTINCT (l_partkey % 3, l_shipdate > TIMESTAMP '1994-01-01', CASE WHEN l_suppkey % 4 > 0 THEN 1 ELSE 0 END)) AS forms FROM lineitem GROUP BY 1, 2)
 SELECT l_orderkey, l_linenumber, n, first, CASE WHEN forms > 1 THEN 'conflict' WHEN n > 1 THEN 'identical_duplicate' ELSE 'single' END AS outcome FROM g""")
def _(t):
    """Same identity, content and revision is a duplicate; where either differs, a conflict. A part's key by 3 plays content, date and supplier (null for one in four) the revision."""
    revision = F.struct((F.col("l_shipdate") > F.lit("1994-01-01").cast("timestamp")).alias("late"), F.when(F.col("l_suppkey") % 4 > 0, 1).alias("known"))
    rows = t.lineitem.select(F.struct("l_orderkey", "l_linenumber").alias("identity"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("ordinal"), (F.col("l_partkey") % 3).alias("hash"), revision.alias("revision"))
    return publication.dedupe(rows).select("identity.*", "n", "first", "outcome")


_IDENTITY = """WITH cand AS (SELECT o_orderkey AS cand, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS stable, o_custkey * 1000 + o_orderkey % 7 AS natural FROM orders),
 stored AS (SELECT min(o_orderkey) AS stored, CASE WHEN min(o_orderkey) % 3 = 0 THEN min(o_orderkey) END AS stable, o_custkey * 1000 + o_orderkey % 7 AS natural FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey * 1000 + o_orderkey % 7),
 j AS (SELECT cand, c.stable, a.stored AS by_id, b.stored AS by_natural, b.stable AS natural_stable FROM cand c LEFT JOIN stored a ON a.stable = c.stable LEFT JOIN stored b ON b.natural = c.natural)"""


@query("ing_identity", f"""{_IDENTITY} SELECT cand, coalesce(by_id, by_natural) AS matched, CASE WHEN by_id IS NOT NULL AND by_natural IS NOT NULL AND by_id <> by_natural THEN 'conflict' WHEN by_id IS NOT NULL THEN 'match_stable_id'
 WHEN by_natural IS NOT NULL AND stable IS NOT NULL AND natural_stable IS NULL THEN 'attach_stable_alias' WHEN by_natural IS NOT NULL AND stable IS NOT NULL THEN 'conflict' WHEN by_natural IS NOT NULL THEN 'match_natural_key' ELSE 'insert_identity' END AS action FROM j""")
def _(t):
    """Match by stable id, else by natural key."""
    natural = (F.col("o_custkey") * 1000 + F.col("o_orderkey") % 7).alias("natural")
    cand = t.orders.select(F.col("o_orderkey").alias("cand"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).alias("stable"), natural)
    stored = t.orders.where("o_orderstatus = 'F'").groupBy(natural).agg(F.min("o_orderkey").alias("stored"))
    return matching.match_identity(cand, stored.withColumn("stable", F.when(F.col("stored") % 3 == 0, F.col("stored")))).select("cand", "matched", "action")


@query("ing_revision", """WITH r AS (SELECT o_orderkey, o_orderkey % 9 AS k, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS sh, o_orderpriority AS pr FROM orders),
 z AS (SELECT *, CASE WHEN pr LIKE '%HIGH%' THEN coalesce(sh, o_orderkey::VARCHAR) ELSE 'x' END AS nh FROM r)
 SELECT o_orderkey, CASE WHEN sh IS NULL THEN 'insert' WHEN k = 0 THEN CASE WHEN sh = nh THEN 'noop' ELSE 'revision_conflict' END WHEN k = 1 THEN CASE WHEN sh = nh THEN 'unordered_noop' ELSE 'revision_conflict' END
  WHEN k IN (2, 3) THEN CASE WHEN sh = nh THEN 'noop' ELSE 'revision_conflict' END WHEN k IN (4, 5) THEN CASE WHEN sh = nh THEN 'revision_only' ELSE 'newer' END WHEN k IN (6, 7) THEN 'stale_skip'
  ELSE CASE WHEN sh = nh THEN 'unordered_noop' ELSE 'revision_conflict' END END AS outcome FROM z""")
def _(t):
    k = F.col("o_orderkey") % 9
    sh = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus"))
    nh = F.when(F.col("o_orderpriority").like("%HIGH%"), F.coalesce(sh, F.col("o_orderkey").cast("string"))).otherwise("x")
    pair = lambda a, b: F.map_from_arrays(F.array(F.lit("core"), F.lit("bgc")), F.array(a, b))
    stored = F.when(k > 1, pair(F.lit(5), F.lit(5)))
    new = F.when(k > 0, pair(F.when(k.isin(4, 5, 8), 6).when(k.isin(6, 7), 4).otherwise(5), F.when(k.isin(6, 7, 8), 4).otherwise(5)))
    return t.orders.select("o_orderkey", revision_outcome(sh, nh, stored, new).alias("outcome"))


_NEXT = """WITH s AS (SELECT o_custkey AS k, count(*) AS n, CAST(max(o_orderkey) AS BIGINT) AS r, CAST(round(sum(o_totalprice)) AS BIGINT) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' AND o_custkey % 5 <> 0 GROUP BY 1),
 c AS (SELECT o_custkey AS k, count(*) AS n, CAST(max(o_orderkey) AS BIGINT) AS r, CAST(round(sum(o_totalprice)) AS BIGINT) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01' AND o_custkey % 7 <> 0 GROUP BY 1),
 j AS (SELECT coalesce(s.k, c.k) AS k, s.n AS sn, s.r AS sr, s.v AS sv, c.n AS cn, c.r AS cr, c.v AS cv FROM s FULL JOIN c ON s.k = c.k),
 o AS (SELECT *, CASE WHEN cn IS NULL THEN 'keep' WHEN sn IS NULL THEN 'insert' WHEN cr = sr THEN CASE WHEN cn = sn THEN 'noop' ELSE 'revision_conflict' END WHEN cr > sr THEN CASE WHEN cn = sn THEN 'revision_only' ELSE 'newer' END ELSE 'stale_skip' END AS outcome FROM j)"""


@query("ing_merge", f"{_NEXT} SELECT k, outcome, CASE WHEN outcome IN ('insert', 'newer', 'revision_only') THEN cr ELSE sr END AS revision, CASE WHEN outcome IN ('insert', 'newer') THEN cv ELSE sv END AS content FROM o")
def _(t):
    """Next state of the store: a row's content follows its revision, its levels are replaced whole or not at all."""
    def side(df):
        made = ordered_totals(df.withColumnRenamed("o_custkey", "k"), "k", "o_totalprice", "o_orderkey", F.max("o_orderkey").alias("r"))
        return made.select("k", F.col("n").cast("string").alias("hash"), F.create_map(F.lit("core"), F.col("r")).alias("revision"), F.round("total").cast("long").alias("content"))

    stored = side(t.orders.where("o_orderdate < TIMESTAMP '1998-01-01' AND o_custkey % 5 <> 0"))
    new = side(t.orders.where("o_orderdate >= TIMESTAMP '1997-06-01' AND o_custkey % 7 <> 0"))
    return merge_batch(stored, new, "k").select("k", "outcome", F.col("revision")["core"].alias("revision"), "content")


@query("ing_plausible", "SELECT profile_id, level_index, concat_ws(',', CASE WHEN p * 7 NOT BETWEEN -5 AND 12000 THEN 'pressure' END, CASE WHEN t * 2 - 6 NOT BETWEEN -5 AND 50 THEN 'temperature' END, CASE WHEN s * 1.5 NOT BETWEEN 0 AND 50 THEN 'salinity' END) AS implausible FROM b_delivered")
def _(t):
    """Values beyond what a sensor in the sea can see. Delivered values are stretched so that some are."""
    rows = t.delivered.select("profile_id", "level_index", (F.col("p") * 7).alias("pressure"), (F.col("t") * 2 - 6).alias("temperature"), (F.col("s") * 1.5).alias("salinity"))
    return rows.select("profile_id", "level_index", F.array_join(implausible(), ",").alias("implausible"))


@query("ing_flags", """WITH f AS (SELECT profile_id, level_index, p, p_qc, row_number() OVER (PARTITION BY profile_id, p ORDER BY level_index) > 1 AS rep, p < lag(p) OVER (PARTITION BY profile_id ORDER BY level_index) AS dec FROM b_delivered)
 SELECT profile_id, level_index, concat_ws(',', CASE WHEN p_qc NOT IN ('1','2','3','4') THEN 'qc_unknown' END, CASE WHEN p NOT BETWEEN -5 AND 1900 THEN 'outside_plausibility_range' END, CASE WHEN rep THEN 'repeated_pressure' END, CASE WHEN dec THEN 'nonmonotonic_pressure' END) AS flags FROM f""")
def _(t):
    """Flags of a level in fixed order: QC, range, repeated, not monotonic."""
    w = W.partitionBy("profile_id").orderBy("level_index")
    repeated = F.row_number().over(W.partitionBy("profile_id", "p").orderBy("level_index")) > 1
    falling = F.col("p") < F.last("p", True).over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = t.delivered.withColumns({"rep": repeated, "dec": falling})
    flags = F.array_compact(F.array(
        F.when(~F.col("p_qc").isin("1", "2", "3", "4"), "qc_unknown"), F.when(~F.col("p").between(-5, 1900), "outside_plausibility_range"),
        F.when(F.col("rep"), "repeated_pressure"), F.when(F.col("dec"), "nonmonotonic_pressure"),
    ))
    return rows.select("profile_id", "level_index", F.array_join(flags, ",").alias("flags"))


@query("ing_units", """WITH l AS (SELECT l_orderkey, CASE l_linenumber % 5 WHEN 0 THEN 'decibar' WHEN 1 THEN 'dbar' WHEN 2 THEN 'degree_Celsius' WHEN 3 THEN 'psu' ELSE CASE WHEN l_suppkey % 3 = 0 THEN 'furlong' ELSE 'degree_C' END END AS spelling FROM lineitem)
 SELECT l_orderkey, bool_or(spelling = 'furlong') AS rejected, count(*) FILTER (spelling IN ('decibar', 'dbar')) AS dbar, count(*) FILTER (spelling IN ('degree_Celsius', 'degree_C')) AS degrees, count(*) FILTER (spelling = 'psu') AS ones FROM l GROUP BY 1""")
def _(t):
    """Spellings to canonical units; a value in a unit that nobody knows rejects its whole profile."""
    k = F.col("l_linenumber") % 5
    spelling = F.when(k == 0, "decibar").when(k == 1, "dbar").when(k == 2, "degree_Celsius").when(k == 3, "psu").when(F.col("l_suppkey") % 3 == 0, "furlong").otherwise("degree_C")
    unit = canonical_unit(spelling)
    return t.lineitem.withColumn("unit", unit).groupBy("l_orderkey").agg(
        F.bool_or(F.col("unit").isNull()).alias("rejected"), F.count_if(F.col("unit") == "dbar").alias("dbar"), F.count_if(F.col("unit") == "degree_C").alias("degrees"), F.count_if(F.col("unit") == "1").alias("ones"))


@query("ing_variant_place", """SELECT profile_id, level_index, CASE WHEN m = 'R' THEN t END AS temperature, CASE WHEN m IN ('A', 'D') THEN t END AS temperature_adjusted, CASE WHEN m = 'R' THEN t_qc END AS temperature_qc, CASE WHEN m IN ('A', 'D') THEN t_qc END AS temperature_adjusted_qc, m AS temperature_data_mode
 FROM (SELECT *, CASE WHEN level_index % 9 = 4 THEN 'X' ELSE data_mode END AS m FROM b_delivered)""")
def _(t):
    """The delivered value goes to the original in mode R and to the adjusted column in A and D; other modes deliver nothing."""
    mode = F.when(F.col("level_index") % 9 == 4, "X").otherwise(F.col("data_mode"))
    return t.delivered.select("profile_id", "level_index", *place_variant("temperature", F.col("t"), F.col("t_qc"), mode))


_SLOT = "CAST(observation_month AS VARCHAR) || direction"


@query("ing_quarantine", f"SELECT profile_id, bool_or(cycle_number = 13) OVER (PARTITION BY {_SLOT}) AS quarantined FROM b_profiles")
def _(t):
    """One bad profile blocks its whole slot."""
    bad = t.profiles.where("cycle_number = 13").select("observation_month", "direction").distinct().withColumn("bad", F.lit(True))
    return t.profiles.join(bad, ["observation_month", "direction"], "left").select("profile_id", F.coalesce("bad", F.lit(False)).alias("quarantined"))


@query("ing_manifest", """WITH m AS (SELECT CAST(observation_month AS VARCHAR) || '/' || w || '_' || s AS slot, profile_id, profile_hash, levels, row_number() OVER (PARTITION BY observation_month, w, s ORDER BY profile_id) - 1 AS k
 FROM (SELECT m.*, CASE WHEN longitude = 120 THEN 110 ELSE CAST(floor((longitude - 20) / 10) * 10 + 20 AS INT) END AS w, CASE WHEN latitude = 30 THEN 20 ELSE CAST(floor((latitude + 60) / 10) * 10 - 60 AS INT) END AS s, levels
  FROM b_profiles m JOIN (SELECT profile_id, count(*) AS levels FROM b_delivered GROUP BY 1) l ON l.profile_id = m.profile_id))
 SELECT slot, CAST(k // 2 AS BIGINT) AS part, count(*) AS n, CAST(sum(levels) AS BIGINT) AS levels, string_agg(profile_id || ':' || profile_hash || ':' || levels, ',' ORDER BY profile_id) AS members FROM m GROUP BY 1, 2""")
def _(t):
    """Members of each slot (a month of a tile) with their levels, sorted by id, written in parts of two."""
    levels = t.delivered.groupBy("profile_id").agg(F.count("*").alias("levels"))
    slot = F.concat_ws("/", F.col("observation_month").cast("string"), tile_key(F.col("longitude"), F.col("latitude")))
    members = t.profiles.join(levels, "profile_id").select(slot.alias("slot"), "profile_id", "profile_hash", "levels")
    made = publication.manifest_parts(members, most=2)
    return made.select("slot", "part", "n", "levels", F.array_join(F.transform("members", lambda x: F.concat_ws(":", x["profile_id"], x["profile_hash"], x["levels"].cast("string"))), ",").alias("members"))


@query("ing_compact", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, rank() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC) AS r FROM lineitem) WHERE r = 1 AND l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) >= 4)")
def _(t):
    """Slots with many parts, rewritten as one: the newest part wins for each key."""
    many = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n")).where("n >= 4").select("l_orderkey")
    rows = t.lineitem.join(many, "l_orderkey", "left_semi")
    newest = rows.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_shipdate").alias("l_shipdate"))
    return rows.join(newest, ["l_orderkey", "l_linenumber", "l_shipdate"], "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


_RECEIPTS = """WITH q AS (SELECT DISTINCT o_custkey AS slot, TIMESTAMP '1996-01-01' AS a, TIMESTAMP '1997-01-01' AS b FROM orders),
 r AS (SELECT o_custkey AS slot, greatest(o_orderdate, TIMESTAMP '1996-01-01') AS s, least(o_orderdate + to_days(CAST(90 + o_orderkey % 300 AS INT)), TIMESTAMP '1997-01-01') AS e, o_orderstatus AS st FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' AND o_orderdate + to_days(CAST(90 + o_orderkey % 300 AS INT)) > TIMESTAMP '1996-01-01'),
 w AS (SELECT *, coalesce(max(e) OVER (PARTITION BY slot ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TIMESTAMP '1996-01-01') AS before FROM r),
 g AS (SELECT slot, bool_or(s > before) OR max(e) < TIMESTAMP '1997-01-01' AS gap, bool_or(st = 'F') AS held, bool_or(st = 'O') AS verified FROM w GROUP BY 1)"""


@query("ing_coverage", f"{_RECEIPTS} SELECT q.slot, CASE WHEN gap IS NULL OR gap THEN 'fetch_coverage' WHEN held THEN 'covered' WHEN verified THEN 'empty_verified' ELSE 'stored_empty_not_verified' END AS state FROM q LEFT JOIN g ON g.slot = q.slot")
def _(t):
    """State of every slot over a year: its receipts' intervals are clipped to the request, and their union must leave no gap.

    Slots are platforms; an order is a receipt from its date on, and its status tells what the store holds.
    """
    at, day = F.col("o_orderdate").cast("timestamp"), 86_400_000_000
    receipts = t.orders.select(F.col("o_custkey").alias("slot"), at.alias("start"), F.timestamp_micros(F.unix_micros(at) + (F.col("o_orderkey") % 300 + 90) * day).alias("end"), "o_orderstatus")
    requests = t.orders.select(F.col("o_custkey").alias("slot")).distinct().withColumns({"req_start": F.lit("1996-01-01").cast("timestamp"), "req_end": F.lit("1997-01-01").cast("timestamp")})
    pieces = matching.interval_overlap(receipts, requests).select("slot", F.col("clip_start").alias("start"), F.col("clip_end").alias("end"), "req_start", "req_end", "o_orderstatus")
    held = pieces.groupBy("slot").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("held"), F.bool_or(F.col("o_orderstatus") == "O").alias("verified"))
    known = matching.interval_gaps(pieces.drop("o_orderstatus"), ["slot"]).join(held, "slot")
    state = F.when(F.coalesce("gap", F.lit(True)), "fetch_coverage").when(F.col("held"), "covered").when(F.col("verified"), "empty_verified").otherwise("stored_empty_not_verified")
    return requests.select("slot").join(known, "slot", "left").select("slot", state.alias("state"))


@query("ing_no_change", "SELECT 'levels' AS part, count(*) AS n_before, count(*) AS n_after, true AS same FROM lineitem UNION ALL SELECT 'profiles', count(*), count(*) FILTER (o_orderkey % 1000 <> 7), count(*) = count(*) FILTER (o_orderkey % 1000 <> 7) FROM orders")
def _(t):
    """Counts and digests before and after a rerun: the levels are the same rows in another order, of the profiles some are lost."""
    def compared(part, before, after):
        a, b = digest(before).select(F.struct("*").alias("a")), digest(after).select(F.struct("*").alias("b"))
        return a.join(b, how="cross").select(F.lit(part).alias("part"), F.col("a.n").alias("n_before"), F.col("b.n").alias("n_after"), (F.col("a") == F.col("b")).alias("same"))  # one row each

    return compared("levels", t.lineitem, t.lineitem.repartition("l_partkey")).unionByName(compared("profiles", t.orders, t.orders.where("o_orderkey % 1000 <> 7")))


@query("ing_index_match", "SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS matched, count(*) FILTER (b.k IS NULL) AS index_only, count(*) FILTER (a.k IS NULL) AS stored_only FROM (SELECT o_custkey || '_' || o_orderkey % 400 AS k FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1) a FULL JOIN (SELECT o_custkey || '_' || o_orderkey % 400 AS k FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) b ON a.k = b.k")
def _(t):
    """Identities in the file names of an index against the stored ones: platform and cycle."""
    name = F.concat(F.lit("R"), F.col("o_custkey").cast("string"), F.lit("_"), F.lpad((F.col("o_orderkey") % 400).cast("string"), 3, "0"), F.lit("D.nc"))
    index = t.orders.where("o_orderdate < TIMESTAMP '1999-01-01'").select(file_parts(name).alias("f")).where("f IS NOT NULL")
    a = index.select(F.concat_ws("_", "f.platform", F.col("f.cycle").cast("string")).alias("k")).distinct().withColumn("a", F.lit(1))
    b = t.orders.where("o_orderstatus <> 'P'").select(F.concat_ws("_", F.col("o_custkey").cast("string"), (F.col("o_orderkey") % 400).cast("string")).alias("k")).distinct().withColumn("b", F.lit(1))
    x, y = F.col("a").isNotNull(), F.col("b").isNotNull()
    return a.join(b, "k", "full").agg(F.count_if(x & y).alias("matched"), F.count_if(~y).alias("index_only"), F.count_if(~x).alias("stored_only"))


@query("ing_owner_tile_counts", "SELECT (CASE WHEN longitude = 120 THEN 110 ELSE CAST(floor((longitude - 20) / 10) * 10 + 20 AS INT) END) || '_' || (CASE WHEN latitude = 30 THEN 20 ELSE CAST(floor((latitude + 60) / 10) * 10 - 60 AS INT) END) AS tile, count(*) AS n FROM b_profiles GROUP BY 1")
def _(t):
    return t.profiles.groupBy(tile_key(F.col("longitude"), F.col("latitude")).alias("tile")).agg(F.count("*").alias("n"))


_TEXTS = {"pressure": "p", "temperature": "t", "salinity": "s"}


@query("ing_level_flags", """WITH f AS (SELECT d.*, direction, row_number() OVER (PARTITION BY d.profile_id, p ORDER BY level_index) > 1 AS rep, p < lag(p) OVER (PARTITION BY d.profile_id ORDER BY level_index) AS dec FROM b_delivered d JOIN b_profiles m ON m.profile_id = d.profile_id)
 SELECT profile_id, level_index, concat_ws(',', CASE WHEN CAST(round(p * 100) AS BIGINT) % 25 <> 0 THEN 'rounded' END, CASE WHEN p_qc = '5' THEN 'qc_unknown' END, CASE WHEN p > 12000 OR p < -5 THEN 'outside_plausibility_range' END, CASE WHEN rep THEN 'repeated_pressure' END, CASE WHEN dec THEN 'nonmonotonic_pressure' END) AS pressure_flags,
  concat_ws(',', 'rounded', CASE WHEN round(t, 3) + 0.0001 > 50 THEN 'outside_plausibility_range' END) AS temperature_flags, CASE WHEN direction = 'U' THEN 'variable_absent' ELSE concat_ws(',', CASE WHEN CAST(round(s * 100) AS BIGINT) % 25 <> 0 THEN 'rounded' END) END AS salinity_flags FROM f""")
def _(t):
    """Three variables at once, from the numbers as text; profiles of unknown direction have no salinity, QC 5 is delivered as ``x``."""
    rows = t.delivered.join(t.profiles.select("profile_id", "direction"), "profile_id")
    texts = {"pressure": F.format_string("%.2f", "p"), "temperature": F.concat(F.format_string("%.3f", "t"), F.lit("1")), "salinity": F.format_string("%.2f", "s")}
    code = lambda c: F.when(F.col(c) == "5", "x").otherwise(F.col(c))
    each = [x for v, c in _TEXTS.items() for x in (texts[v].alias(f"{v}_text"), code(f"{c}_qc").alias(f"{v}_code"), (F.lit(v != "salinity") | (F.col("direction") != "U")).alias(f"{v}_present"))]
    made = level_flags(rows.select("profile_id", "level_index", *each))
    return made.select("profile_id", "level_index", *[F.array_join(f"{v}_flags", ",").alias(f"{v}_flags") for v in _TEXTS])


# Coverage by receipts --------------------------------------------------------------------------------

# Orders play receipts: the key chooses the tile, the rectangle in it, the interval and what was found. A year of six tiles is asked for.
_RECEIPT_ROWS = """SELECT CAST(o_orderkey AS VARCHAR) AS receipt_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(20 + 10 * (k % 3) AS BIGINT) AS west, CAST(-60 + 10 * (k // 3 % 2) AS BIGINT) AS south, k % 2 AS slot_version,
 CASE WHEN k % 9 = 0 THEN 'source_absence_over_retained' ELSE 'fetched' END AS fetch_disposition, CASE WHEN k % 31 = 0 THEN 'empty_stored_domain' WHEN k % 5 < 4 THEN 'empty_stored_cell' ELSE 'stored' END AS stored_disposition,
 date_trunc('month', o_orderdate) - to_days(CAST(k % 4 AS INT)) AS r_start, date_trunc('month', o_orderdate) + to_days(CAST(14 + k % 20 AS INT)) AS r_end,
 CAST(20 + 10 * (k % 3) + CASE WHEN k % 7 < 4 THEN -2 ELSE 3 END AS BIGINT) AS r_west, CAST(-60 + 10 * (k // 3 % 2) AS BIGINT) AS r_south, CAST(CASE WHEN k % 7 < 2 THEN 14 ELSE 6 END AS BIGINT) AS r_width, CAST(CASE WHEN k % 3 = 2 THEN 4 ELSE 10 END AS BIGINT) AS r_height
 FROM (SELECT *, o_orderkey // 4 * 2 + o_orderkey % 4 AS k FROM orders)"""
_ASKED = """SELECT CAST(m AS DATE) AS month, w AS west, s AS south, greatest(m, TIMESTAMP '1996-01-10 06:00:00') AS a, least(m + INTERVAL 1 MONTH, TIMESTAMP '1996-12-20') AS b
 FROM (SELECT unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1996-12-01', INTERVAL 1 MONTH)) AS m), (SELECT CAST(unnest([20, 30, 40]) AS BIGINT) AS w), (SELECT CAST(unnest([-60, -50]) AS BIGINT) AS s)"""
_CELLS = lambda name, where: f"""{name}_c AS (SELECT q.month, q.west, q.south, a, b, x, y, greatest(r_start, a) AS f, least(r_end, b) AS t FROM q JOIN r USING (month, west, south), (SELECT unnest(range(-60, -40)) AS y), (SELECT unnest(range(20, 50)) AS x)
  WHERE {where} AND r_start < b AND r_end > a AND x >= q.west AND x < q.west + 10 AND x >= r_west AND x < r_west + r_width AND y >= q.south AND y < q.south + 10 AND y >= r_south AND y < r_south + r_height),
 {name}_s AS (SELECT *, f > coalesce(max(t) OVER (PARTITION BY month, west, south, x, y ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a) AS hole FROM {name}_c),
 {name} AS (SELECT month, west, south FROM (SELECT month, west, south, x, y FROM {name}_s GROUP BY ALL HAVING NOT bool_or(hole) AND max(t) >= any_value(b)) GROUP BY ALL HAVING count(*) = 100)"""  # noqa: E731


def _asked(t):
    request = t.spark.createDataFrame([("1996-01-10 06:00:00", "1996-12-20 00:00:00")], "a string, b string").select(F.col("a").cast("timestamp").alias("request_start"), F.col("b").cast("timestamp").alias("request_end"))
    tiles = t.spark.createDataFrame([(w, s) for w in (20, 30, 40) for s in (-60, -50)], "west long, south long")
    return coverage.request_slots(request, tiles)


@query("ing_coverage_resolved", f"""WITH r AS ({_RECEIPT_ROWS}), q AS ({_ASKED}), {_CELLS("fetched", "true")}, {_CELLS("proved", "slot_version = 1 AND stored_disposition LIKE 'empty_stored_%'")},
 l AS (SELECT month, west, south, count(*) AS n FROM q JOIN (SELECT observation_month AS month, observed_at, CAST(floor((longitude - 20) / 10) * 10 + 20 AS BIGINT) AS west, CAST(floor((latitude + 60) / 10) * 10 - 60 AS BIGINT) AS south FROM b_profiles WHERE cycle_number % 7 = 0) p USING (month, west, south) WHERE observed_at >= a AND observed_at < b GROUP BY ALL),
 d AS (SELECT month, west, south, count(*) FILTER (stored_disposition = 'empty_stored_domain') AS whole, count(*) FILTER (stored_disposition LIKE 'empty_stored_%') AS empties, count(*) FILTER (fetch_disposition LIKE 'source_absence%') AS absent FROM r WHERE slot_version = 1 GROUP BY ALL),
 p AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(20 + 10 * (o_custkey % 3) AS BIGINT) AS west, CAST(-60 + 10 * (o_custkey // 3 % 2) AS BIGINT) AS south FROM orders WHERE o_custkey % 4 = 0),
 z AS (SELECT q.*, coalesce(l.n, 0) AS n, fetched.month IS NULL AS gap, p.month IS NULL AS no_part, proved.month IS NOT NULL OR coalesce(d.whole, 0) > 0 AS stands, CASE WHEN coalesce(d.whole, 0) > 0 THEN d.whole ELSE coalesce(d.empties, 0) END AS proofs, coalesce(absent, 0) AS absent
  FROM q LEFT JOIN l USING (month, west, south) LEFT JOIN fetched USING (month, west, south) LEFT JOIN proved USING (month, west, south) LEFT JOIN d USING (month, west, south) LEFT JOIN p USING (month, west, south))
 SELECT CAST(month AS VARCHAR) AS month, west, south, n AS n_members, concat_ws(',', CASE WHEN gap THEN 'fetch_coverage' END, CASE WHEN n > 0 AND no_part THEN 'missing_active_generation' END, CASE WHEN n = 0 AND NOT stands THEN 'stored_empty_not_verified' END) AS gaps,
  CAST(CASE WHEN n = 0 AND stands THEN proofs ELSE 0 END AS INT) AS verified, CAST(CASE WHEN n > 0 THEN absent ELSE 0 END AS INT) AS absences FROM z""")
def _(t):
    """Slots of a request against receipts, parts and members: what is missing, and what proves that nothing is there."""
    at, key = F.trunc("o_orderdate", "month"), F.col("o_orderkey")
    o = t.orders.withColumn("k", F.floor(key / 4) * 2 + key % 4)
    k, day = F.col("k"), lambda n: F.make_interval(days=n)
    west, south, start = (k % 3 * 10 + 20).cast("long"), (F.floor(k / 3) % 2 * 10 - 60).cast("long"), F.date_trunc("month", "o_orderdate")
    receipts = o.select(
        key.cast("string").alias("receipt_id"), at.alias("month"), west.alias("west"), south.alias("south"), (k % 2).cast("long").alias("slot_version"), F.when(k % 9 == 0, coverage.ABSENT).otherwise("fetched").alias("fetch_disposition"),
        F.when(k % 31 == 0, coverage.WHOLE_SLOT_EMPTY).when(k % 5 < 4, "empty_stored_cell").otherwise("stored").alias("stored_disposition"), (start - day((k % 4).cast("int"))).alias("r_start"), (start + day((k % 20 + 14).cast("int"))).alias("r_end"),
        (west + F.when(k % 7 < 4, -2).otherwise(3)).cast("long").alias("r_west"), south.alias("r_south"), F.when(k % 7 < 2, 14).otherwise(6).cast("long").alias("r_width"), F.when(k % 3 == 2, 4).otherwise(10).cast("long").alias("r_height"),
    )
    slots = _asked(t)
    versions = slots.select(*coverage.SLOT, F.lit(1).cast("long").alias("slot_version"))
    c = F.col("o_custkey")
    parts = t.orders.where(c % 4 == 0).select(at.alias("month"), (c % 3 * 10 + 20).cast("long").alias("west"), (F.floor(c / 3) % 2 * 10 - 60).cast("long").alias("south"), c.cast("string").alias("part_id"))
    members = t.profiles.where("cycle_number % 7 = 0").select(F.col("observation_month").alias("month"), (F.floor((F.col("longitude") - 20) / 10) * 10 + 20).cast("long").alias("west"), (F.floor((F.col("latitude") + 60) / 10) * 10 - 60).cast("long").alias("south"), F.col("observed_at").alias("at"))
    made = coverage.resolve(slots, receipts, versions, parts, members)
    return made.select(F.col("month").cast("string").alias("month"), "west", "south", "n_members", F.array_join("gaps", ",").alias("gaps"), F.size("verified").alias("verified"), F.size("absences").alias("absences"))


# Compaction ------------------------------------------------------------------------------------------


def _compaction_parts(t):
    """(first part of every profile, part with revisions of every third cycle, members listed)."""
    slot = F.date_format("observation_month", "yyyy-MM").alias("slot")
    heads = t.profiles.select("profile_id", slot, "cycle_number")
    rows = t.delivered.select("profile_id", F.col("level_index").cast("long").alias("level_index"), "p", "t").join(heads, "profile_id")
    first = rows.select("slot", "profile_id", "level_index", "p", "t")
    second = rows.where("cycle_number % 3 = 0 AND level_index < 2 AND slot >= '1996-01'").select("slot", "profile_id", "level_index", "p", (F.col("t") + 100).alias("t"))
    return first, second, heads.where("cycle_number % 11 > 0").select("slot", "profile_id")


@query("ing_compact_store", """WITH r AS (SELECT strftime(observation_month, '%Y-%m') AS slot, l.profile_id, cycle_number, level_index, t FROM b_delivered l JOIN b_profiles m ON m.profile_id = l.profile_id),
 many AS (SELECT DISTINCT slot FROM r WHERE cycle_number % 3 = 0 AND level_index < 2 AND slot >= '1996-01'),
 n AS (SELECT slot, profile_id, level_index, CASE WHEN cycle_number % 3 = 0 AND slot >= '1996-01' THEN t + 100 ELSE t END AS t FROM r WHERE NOT (cycle_number % 3 = 0 AND slot >= '1996-01' AND level_index >= 2) AND (cycle_number % 11 > 0 OR slot NOT IN (SELECT slot FROM many)))
 SELECT slot, CAST(1 AS BIGINT) AS parts, count(*) AS n, count(DISTINCT profile_id) AS profiles, round(sum(t) + 1e-9, 4) AS total FROM n GROUP BY 1""")
def _(t):
    """Two parts committed, slots of both rewritten as one and swapped in: what a reader sees then."""
    first, second, members = _compaction_parts(t)
    path = new_path(t.spark, "compaction")
    compaction.commit_part(first, path, 0)
    compaction.commit_part(second, path, 1)
    compaction.compact(t.spark, path, first.schema, members)
    rows = compaction.read_current(t.spark, path, first.schema)
    one = rows.groupBy("slot", "profile_id", "generation").agg(F.count("*").alias("n"), F.sum("t").alias("total"))
    return one.groupBy("slot").agg(F.count_distinct("generation").alias("parts"), F.sum("n").alias("n"), F.count("*").alias("profiles"), F.round(F.sum("total") + 1e-9, 4).alias("total"))
