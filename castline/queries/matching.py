"""Joins of ingestion and reporting, and rules on delivered documents, over the bridge frames."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from castline.operators import matching, payload
from castline.operators.regions import region_tiles
from castline.queries.sources import documents_json, manifest_rows
from castline.registry import query
from castline.sources import readers


def _ts(c):
    return F.col(c).cast("timestamp")


@query("j_semi_manifest", "SELECT profile_id, profile_hash FROM b_profiles WHERE cycle_number % 3 = 0")
def _(t):
    return matching.semi_manifest(t.profiles, manifest_rows(t)).select("profile_id", "profile_hash")


@query("j_region_tiles", """WITH b AS (SELECT platform_number AS region, min(longitude) AS w, min(latitude) AS s, max(longitude) AS e, max(latitude) AS n FROM b_profiles GROUP BY 1),
 x AS (SELECT unnest(range(0, 130, 10)) AS west), y AS (SELECT unnest(range(-80, 50, 10)) AS south) SELECT region, west, south FROM b, x, y WHERE west <= e AND west + 10 >= w AND south <= n AND south + 10 >= s""")
def _(t):
    """Tiles that each platform's box, taken as a polygon, meets."""
    b = t.profiles.groupBy(F.col("platform_number").alias("region")).agg(F.min("longitude").alias("w"), F.min("latitude").alias("s"), F.max("longitude").alias("e"), F.max("latitude").alias("n"))
    edge = lambda *c: F.struct(*[F.col(x).alias(n) for x, n in zip(c, ("x1", "y1", "x2", "y2"), strict=True)])
    edges = b.select("region", F.explode(F.array(edge("w", "s", "e", "s"), edge("e", "s", "e", "n"), edge("e", "n", "w", "n"), edge("w", "n", "w", "s"))).alias("x")).select("region", "x.*")
    return region_tiles(edges)


@query("j_interval_overlap", """SELECT o_orderkey, greatest(o_orderdate, r.a) AS clip_start, least(o_orderdate + to_days(CAST(o_orderkey % 40 AS INT)), r.b) AS clip_end
 FROM orders JOIN (SELECT c_custkey, TIMESTAMP '1996-01-01' + to_days(CAST(c_nationkey * 30 AS INT)) AS a, TIMESTAMP '1997-01-01' + to_days(CAST(c_nationkey * 30 AS INT)) AS b FROM customer) r ON r.c_custkey = o_custkey
 WHERE o_orderdate + to_days(CAST(o_orderkey % 40 AS INT)) > r.a AND o_orderdate < r.b""")
def _(t):
    day = lambda at, n: F.timestamp_micros(F.unix_micros(at) + n * 86_400_000_000)
    receipts = t.orders.select("o_orderkey", F.col("o_custkey").alias("slot"), _ts("o_orderdate").alias("start"), day(_ts("o_orderdate"), F.col("o_orderkey") % 40).alias("end"))
    first = lambda y: day(F.lit(f"{y}-01-01").cast("timestamp"), F.col("c_nationkey") * 30)
    requests = t.customer.select(F.col("c_custkey").alias("slot"), first(1996).alias("req_start"), first(1997).alias("req_end"))
    return matching.interval_overlap(receipts, requests).select("o_orderkey", "clip_start", "clip_end")


@query("j_tile_overlap", """WITH r AS (SELECT profile_id, CAST(floor(longitude) AS BIGINT) AS west, CAST(floor(latitude) AS BIGINT) AS south, 1 + CAST(profile_id AS BIGINT) % 4 AS width, 1 + CAST(profile_id AS BIGINT) % 3 AS height FROM b_profiles WHERE direction = 'U'),
 c AS (SELECT CAST(floor(longitude) AS BIGINT) AS x, CAST(floor(latitude) AS BIGINT) AS y, count(*) AS n FROM b_profiles GROUP BY 1, 2)
 SELECT profile_id, count(*) AS cells, CAST(sum(n) AS BIGINT) AS profiles FROM r JOIN c ON x >= west AND x < west + width AND y >= south AND y < south + height GROUP BY 1""")
def _(t):
    """Occupied degree cells that each receipt rectangle covers."""
    cell = lambda c: F.floor(F.col(c)).cast("long")
    k = F.col("profile_id").cast("long")
    receipts = t.profiles.where("direction = 'U'").select("profile_id", cell("longitude").alias("west"), cell("latitude").alias("south"), (k % 4 + 1).alias("width"), (k % 3 + 1).alias("height"))
    cells = t.profiles.groupBy(cell("longitude").alias("cell_x"), cell("latitude").alias("cell_y")).agg(F.count("*").alias("n"))
    return matching.tile_overlap(receipts, cells).groupBy("profile_id").agg(F.count("*").alias("cells"), F.sum("n").alias("profiles"))


@query("j_receipts", """SELECT o_orderkey AS receipt_id, o_custkey AS chunk_id, c_nationkey AS run_id FROM orders JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 JOIN nation ON n_nationkey = c_nationkey
 WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')""")
def _(t):
    receipts = t.orders.select(F.col("o_orderkey").alias("receipt_id"), F.col("o_custkey").alias("chunk_id"))
    chunks = t.customer.select(F.col("c_custkey").alias("chunk_id"), F.col("c_nationkey").alias("run_id"), F.when(F.col("c_acctbal") > 0, "complete").otherwise("open").alias("state"))
    intents = t.lineitem.select(F.col("l_orderkey").alias("receipt_id"), (F.col("l_linestatus") == "F").alias("committed"))
    return matching.committed_receipts(receipts, chunks, intents, t.nation.select(F.col("n_nationkey").alias("run_id"))).select("receipt_id", "chunk_id", "run_id")


@query("j_metadata", """WITH e AS (SELECT l_orderkey AS key, s_nationkey AS platform, s_suppkey FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_suppkey % 9 <> 0)
 SELECT key, CASE WHEN count(*) = count(s_suppkey) AND min(platform) = max(platform) THEN min(platform) END AS platform, CASE WHEN count(*) > count(s_suppkey) THEN 'unresolved_metadata' WHEN min(platform) <> max(platform) THEN 'conflicting_platform' END AS reason FROM e GROUP BY 1""")
def _(t):
    """Pointers of each order (its suppliers) must resolve to one platform (their nation)."""
    docs = t.lineitem.groupBy(F.col("l_orderkey").alias("key")).agg(F.collect_set("l_suppkey").alias("pointers"))
    return matching.resolved_platform(docs, t.supplier.where("s_suppkey % 9 <> 0").select(F.col("s_suppkey").alias("pointer"), F.col("s_nationkey").alias("platform")))


_IDENTITY = """WITH cand AS (SELECT o_orderkey AS cand, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS stable, o_custkey || '/' || strftime(o_orderdate, '%Y-%m') AS natural FROM orders),
 stored AS (SELECT min(o_orderkey) AS stored, CASE WHEN min(o_orderkey) % 3 = 0 THEN min(o_orderkey) END AS stable, o_custkey || '/' || strftime(o_orderdate, '%Y-%m') AS natural FROM orders WHERE o_orderstatus = 'F' GROUP BY 3)
 SELECT cand, coalesce(a.stored, b.stored) AS matched, CASE WHEN a.stored IS NOT NULL AND b.stored IS NOT NULL AND a.stored <> b.stored THEN 'conflict' WHEN a.stored IS NOT NULL THEN 'match_stable_id'
  WHEN b.stored IS NOT NULL AND c.stable IS NOT NULL AND b.stable IS NULL THEN 'attach_stable_alias' WHEN b.stored IS NOT NULL AND c.stable IS NOT NULL THEN 'conflict' WHEN b.stored IS NOT NULL THEN 'match_natural_key' ELSE 'insert_identity' END AS action
 FROM cand c LEFT JOIN stored a ON a.stable = c.stable LEFT JOIN stored b ON b.natural = c.natural"""


@query("j_identity", _IDENTITY)
def _(t):
    """Stable id first, then the natural key of platform and month."""
    natural = F.concat_ws("/", F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM"))
    cand = t.orders.select(F.col("o_orderkey").alias("cand"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).alias("stable"), natural.alias("natural"))
    stored = t.orders.where("o_orderstatus = 'F'").groupBy(natural.alias("natural")).agg(F.min("o_orderkey").alias("stored"))
    return matching.match_identity(cand, stored.withColumn("stable", F.when(F.col("stored") % 3 == 0, F.col("stored")))).select("cand", "matched", "action")


def _content(t):
    """(canonical content, typed rows): prices of one order key in 7 were written wrong, and one level in 50 is missing."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = t.lineitem.withColumn("i", (F.row_number().over(w) - 1).cast("int")).select("l_orderkey", "i", "l_partkey", "l_extendedprice")
    content = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("i", "l_partkey", "l_extendedprice"))).alias("content"))
    wrong = F.when(F.col("l_orderkey") % 7 == 0, F.col("l_extendedprice") + F.col("i")).otherwise(F.col("l_extendedprice"))
    return content, rows.withColumn("l_extendedprice", wrong).where("(l_orderkey + i) % 50 <> 0")


_DIFFERING = """SELECT l_orderkey, count(*) AS levels, count(*) FILTER ((l_orderkey % 7 = 0 AND i > 0) OR (l_orderkey + i) % 50 = 0) AS differing
 FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i FROM lineitem) GROUP BY 1"""


@query("j_explode_check", _DIFFERING)
def _(t):
    """Level arrays of the canonical content against the typed rows, field by field."""
    return matching.content_check(*_content(t), "l_orderkey", ["l_partkey", "l_extendedprice"])


@query("ing_audit_levels", f"SELECT * FROM ({_DIFFERING}) ORDER BY md5(CAST(l_orderkey AS VARCHAR)), l_orderkey LIMIT 200")
def _(t):
    """The same check of a sample that every run draws alike."""
    return matching.audited(*_content(t), "l_orderkey", ["l_partkey", "l_extendedprice"], 200)


@query("j_quarantined", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m') || '/' || o_orderstatus AS slot FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0 AND o_totalprice > 200000")
def _(t):
    slot = F.concat_ws("/", F.date_format("o_orderdate", "yyyy-MM"), "o_orderstatus")
    attempts = t.orders.select(slot.alias("slot"), F.col("o_custkey").alias("run_id"), (F.col("o_totalprice") > 200000).alias("quarantined"))
    return matching.quarantined_slots(attempts, t.customer.select(F.col("c_custkey").alias("run_id"), (F.col("c_acctbal") < 0).alias("closed")))


@query("ing_part_gap", "SELECT o_custkey, strftime(o_orderdate, '%Y') AS year, count(*) AS parts, bool_or(o_totalprice < 2000 OR o_orderpriority = '1-URGENT') AS gap FROM orders GROUP BY 1, 2")
def _(t):
    bad = (F.col("o_totalprice") < 2000) | (F.col("o_orderpriority") == "1-URGENT")
    return matching.part_gaps(t.orders.withColumn("year", F.date_format("o_orderdate", "yyyy")), bad, ["o_custkey", "year"])


_BY_MONTH = "SELECT strftime(observed_at, '%Y-%m') AS month, avg(t) AS m, count(t) AS n FROM {} GROUP BY 1"


@query("agg_agreement", f"""WITH a AS ({_BY_MONTH.format('b_sel')}), b AS ({_BY_MONTH.format('b_mode')}), j AS (SELECT a.m AS am, b.m AS bm, a.n AS an, b.n AS bn FROM a FULL JOIN b ON a.month = b.month)
 SELECT 'm' AS "column", count(*) AS cells, count(*) FILTER (abs(am - bm) / greatest(abs(am), abs(bm)) > 0.01) AS differing, count(*) FILTER ((am IS NULL) <> (bm IS NULL)) AS only_one, round(max(abs(am - bm) / greatest(abs(am), abs(bm))), 5) AS worst FROM j
 UNION ALL SELECT 'n', count(*), count(*) FILTER (abs(an - bn) / greatest(an, bn) > 0.01), count(*) FILTER ((an IS NULL) <> (bn IS NULL)), round(max(abs(an - bn) / greatest(an, bn)), 5) FROM j""")
def _(t):
    """Monthly means under two QC policies, cell by cell."""
    by = lambda policy: t.selected(policy).groupBy(F.date_format("observed_at", "yyyy-MM").alias("month")).agg(F.avg("t").alias("m"), F.count("t").alias("n"))
    made = matching.agreement(by("science_ready"), by("mode_selected"), ["month"], ["m", "n"], 0.01)
    return made.withColumn("worst", F.round("worst", 5))


# Delivered documents -----------------------------------------------------------------------------


def delivered(t):
    """Documents with all required fields, some with one missing, an unknown one, or no JSON at all."""
    extra = F.lit('"basin":1,"date_updated_argovis":"2025-01-01T00:00:00Z","source":[],')
    whole = documents_json(t).withColumn("json", F.regexp_replace("json", '^\\{"_id":"[0-9]+",', F.concat(F.lit("{"), extra)))
    k = F.col("cycle_number")
    changed = F.when(k % 10 == 1, F.replace("json", F.lit('"basin":1,'), F.lit(""))).when(k % 10 == 2, F.replace("json", F.lit('"basin":1,'), F.lit('"basin":1,"colour":"red",'))).when(k % 10 == 3, F.expr("substring(json, 2)"))
    return whole.withColumn("json", F.coalesce(changed, F.col("json")))


@query("f_required", "SELECT profile_id, CASE cycle_number % 10 WHEN 1 THEN 'missing_field' WHEN 2 THEN 'unknown_field' WHEN 3 THEN 'invalid_json' END AS verdict FROM b_profiles WHERE profile_id IN (SELECT profile_id FROM b_delivered)")
def _(t):
    return delivered(t).select("profile_id", payload.schema_verdict(F.col("json")).alias("verdict"))


_ARRAY_STATE = """SELECT m.profile_id, CASE WHEN any_value(cycle_number) % 6 = 1 THEN 'invalid_data_info' WHEN any_value(cycle_number) % 6 = 2 AND count(*) > 1 THEN 'mismatched_array_lengths' WHEN any_value(cycle_number) % 6 = 2 THEN 'invalid_array_length' END AS verdict
 FROM b_delivered d JOIN b_profiles m ON m.profile_id = d.profile_id GROUP BY 1"""


@query("f_array_shape", _ARRAY_STATE)
def _(t):
    """Some documents name a variable twice, in some an array lacks its last level."""
    docs = documents_json(t)
    parsed = readers.parsed(docs.withColumn("json", F.col("json"))).join(t.profiles.select(F.col("profile_id").alias("_id"), F.col("cycle_number").alias("_c")), "_id")
    names = F.when(F.col("_c") % 6 == 1, F.transform("names", lambda n: F.replace(n, F.lit("salinity"), F.lit("temperature")))).otherwise(F.col("names"))
    data = F.when(F.col("_c") % 6 == 2, F.transform("data", lambda a, i: F.when(i == 2, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a))).otherwise(F.col("data"))
    return parsed.select(F.col("_id").alias("profile_id"), payload.arrays_verdict(names, data).alias("verdict"))


@query("p_core_only", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'pressure' ELSE 'pressure,salinity' END AS core, CASE WHEN o_custkey % 2 = 0 THEN 2 ELSE 1 END AS other FROM orders")
def _(t):
    """Core variables of each delivered list of names, and how many others it has."""
    extra = F.when(F.col("o_custkey") % 2 == 0, F.lit("nitrate")).otherwise(F.lit("doxy"))
    names = F.array_compact(F.array(F.when(F.col("o_orderstatus") != "P", F.lit("salinity")), F.lit("pressure"), F.lit("pressure_argoqc"), F.lit("doxy"), extra))
    core, other = payload.core_names(names)
    return t.orders.select("o_orderkey", F.array_join(core, ",").alias("core"), other.alias("other"))


@query("map_revision_build", """WITH p AS (SELECT l_orderkey, l_partkey % 5 AS a, l_suppkey % 3 AS u, CASE WHEN l_discount > 0.09 THEN NULL ELSE CAST(epoch(l_shipdate) AS BIGINT) END AS d FROM lineitem),
 g AS (SELECT l_orderkey, count(*) AS n, count(d) AS dated, count(DISTINCT (a, u)) AS forms, CAST(sum(d) AS BIGINT) AS total FROM p GROUP BY 1)
 SELECT l_orderkey, CASE WHEN forms < n THEN 'duplicate_revision_component' END AS reject, CASE WHEN forms = n AND dated = n THEN n END AS components, CASE WHEN forms = n AND dated = n THEN CAST(total AS VARCHAR) END AS total FROM g""")
def _(t):
    """Source lists (an order's lines) as component maps."""
    date = F.when(~(F.col("l_discount") > 0.09), F.unix_timestamp(_ts("l_shipdate")))
    source = F.struct(F.array(F.concat(F.lit("s"), (F.col("l_partkey") % 5).cast("string")), F.lit("core")).alias("source"), (F.col("l_suppkey") % 3).cast("string").alias("url"), date.alias("date_updated"))
    docs = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(source).alias("s"))
    m = payload.revision_map(F.col("s"))
    total = F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, v: a + v)
    return docs.select("l_orderkey", payload.revision_reject(F.col("s")).alias("reject"), F.when(m.isNotNull(), F.size(m).cast("long")).alias("components"), total.cast("string").alias("total"))


@query("ing_warning_policy", """SELECT event_id, CASE event_type WHEN 'click' THEN 'exclude' WHEN 'view' THEN 'inform' WHEN 'error' THEN 'quarantine' ELSE 'none' END AS action FROM events""")
def _(t):
    """Warning lists made of the event type: a click is degenerate levels, a view lacks its basin, an error brings a warning nobody knows beside one that is."""
    kind = F.col("event_type")
    warnings = F.when(kind == "click", F.array(F.lit("degenerate_levels"), F.lit("missing_basin"))).when(kind == "view", F.array(F.lit("missing_basin"))).when(kind == "error", F.array(F.lit("degenerate_levels"), F.lit("clock_reset")))
    return t.events.select("event_id", payload.warning_action(F.coalesce(warnings, F.array().cast("array<string>"))).alias("action"))


@query("json_extract", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
