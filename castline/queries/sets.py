"""Set operations over the bridge frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from castline.operators import publication
from castline.registry import query


def _day(x: str):
    return F.lit(x).cast("timestamp")


@query("set_union_populations", "SELECT 'early' AS scope, profile_id FROM b_profiles WHERE observed_at < TIMESTAMP '1996-01-01' UNION ALL SELECT 'late', profile_id FROM b_profiles WHERE observed_at >= TIMESTAMP '2001-01-01'")
def _(t):
    part = lambda scope, cond: t.profiles.where(cond).select(F.lit(scope).alias("scope"), "profile_id")
    return part("early", F.col("observed_at") < _day("1996-01-01")).unionByName(part("late", F.col("observed_at") >= _day("2001-01-01")))


@query("set_manifest_edit", """WITH p AS (SELECT profile_id, profile_hash, cycle_number AS c, direction AS d, CAST(observation_month AS VARCHAR) AS m FROM b_profiles), l AS (SELECT m AS slot, profile_id, profile_hash, 1 AS levels FROM p WHERE d = 'A'),
 a AS (SELECT CASE WHEN c % 2 = 0 THEN m ELSE '1995-01-01' END AS slot, profile_id, md5(profile_hash) AS profile_hash, c AS levels FROM p WHERE c < 9), x AS (SELECT slot FROM a UNION SELECT slot FROM l WHERE profile_id IN (SELECT profile_id FROM a))
 SELECT *, 'kept' AS origin FROM l WHERE profile_id NOT IN (SELECT profile_id FROM a) AND slot IN (SELECT slot FROM x) UNION ALL SELECT *, 'added' FROM a""")
def _(t):
    """(old minus replaced) plus new, of changed slots: early cycles are corrected, every second one moves to another slot."""
    p, c, month = t.profiles, F.col("cycle_number"), F.col("observation_month").cast("string")
    listed = p.where("direction = 'A'").select(month.alias("slot"), "profile_id", "profile_hash", F.lit(1).cast("long").alias("levels"))
    accepted = p.where("cycle_number < 9").select(F.when(c % 2 == 0, month).otherwise("1995-01-01").alias("slot"), "profile_id", F.md5("profile_hash").alias("profile_hash"), c.alias("levels"))
    return publication.edited_manifest(listed, accepted)


@query("set_manifest_audit", "SELECT count(*) FILTER (a.k IS NULL) AS missing, count(*) FILTER (b.k IS NULL) AS extra FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F') a FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linestatus = 'F') b ON a.k = b.k")
def _(t):
    """Rows of each of two sets that the other lacks."""
    a = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    b = t.lineitem.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("k")).distinct()
    both = a.exceptAll(b).select(F.lit("extra").alias("side")).unionByName(b.exceptAll(a).select(F.lit("missing").alias("side")))
    return both.agg(F.count_if(F.col("side") == "missing").alias("missing"), F.count_if(F.col("side") == "extra").alias("extra"))


@query("set_inventory_equal", """WITH a AS (SELECT DISTINCT o_orderkey AS k FROM orders), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), c AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey % 1000 <> 7),
 u AS (SELECT k FROM a UNION SELECT k FROM b UNION SELECT k FROM c) SELECT 'all' AS part, (SELECT count(*) FROM a) AS n_before, (SELECT count(*) FROM b) AS n_data, (SELECT count(*) FROM c) AS n_after, (SELECT count(*) FROM a JOIN b USING (k) JOIN c USING (k)) AS n_common, (SELECT count(*) FROM u) = (SELECT count(*) FROM a JOIN b USING (k) JOIN c USING (k)) AS equal
 UNION ALL SELECT 'held', n, n, n, n, true FROM (SELECT count(*) AS n FROM b)""")
def _(t):
    """Inventory before a fetch, data, inventory after it: keys with levels agree, of all keys the inventory has lost some and some have no levels."""
    key = t.orders.select(F.col("o_orderkey").alias("k"))
    data = t.lineitem.select(F.col("l_orderkey").alias("k"))
    held = key.join(data, "k", "left_semi")
    named = lambda name, df: df.select(F.lit(name).alias("part"), "*")
    return named("all", publication.sets_equal(key, data, key.where("k % 1000 <> 7"))).unionByName(named("held", publication.sets_equal(held, data, held)))


@query("set_missing_slots", "SELECT DISTINCT CAST(observation_month AS VARCHAR) AS month, direction FROM b_profiles EXCEPT SELECT CAST(observation_month AS VARCHAR), direction FROM b_profiles WHERE latitude > 0")
def _(t):
    slot = lambda df: df.select(F.col("observation_month").cast("string").alias("month"), "direction").distinct()
    return slot(t.profiles).join(slot(t.profiles.where("latitude > 0")), ["month", "direction"], "left_anti")


@query("set_distinct_slots", "SELECT DISTINCT CAST(observation_month AS VARCHAR) AS month, direction FROM b_profiles WHERE cycle_number % 7 = 0")
def _(t):
    return t.profiles.where("cycle_number % 7 = 0").select(F.col("observation_month").cast("string").alias("month"), "direction").distinct()


@query("set_touched_slots", "SELECT strftime(o_orderdate, '%Y-%m') AS slot FROM orders WHERE o_orderstatus = 'P' UNION SELECT strftime(l_shipdate, '%Y-%m') FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'")
def _(t):
    held = t.orders.where("o_orderstatus = 'P'")
    old = held.select(F.date_format("o_orderdate", "yyyy-MM").alias("slot"))
    new = t.lineitem.join(held, F.col("l_orderkey") == F.col("o_orderkey")).select(F.date_format("l_shipdate", "yyyy-MM").alias("slot"))
    return old.union(new).distinct()
