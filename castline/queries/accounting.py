"""Accounting of runs. Events play attempts and calls, orders play outcomes and chunks; each operator is a function of its own inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from castline.functions.qc import VARIABLES
from castline.operators import accounting as acc
from castline.registry import query

# Stand-ins ------------------------------------------------------------------------------------------

_ATTEMPTS = """SELECT event_id AS attempt_id, user_id AS chunk_id, CASE WHEN event_type IN ('click', 'view') THEN 'http' ELSE 'spool' END AS origin, CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'empty' ELSE 'received' END AS disposition,
 CASE WHEN event_id % 5 = 0 THEN event_type END AS error_category, CASE WHEN event_type IN ('click', 'view') THEN CASE WHEN event_id % 5 = 0 THEN 503 ELSE 200 END END AS http_status, length(props) AS bytes,
 ts AS started_at, CASE WHEN event_id % 7 <> 0 THEN ts + to_seconds(CAST(floor(value) AS BIGINT)) END AS finished_at FROM events"""


def _attempts(t):
    """An attempt lasts as many seconds as the event's value; one in seven is unfinished, one in five has failed."""
    e, http = F.col("event_id"), F.col("event_type").isin("click", "view")
    end = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.floor("value") * 1_000_000).cast("timestamp_ntz")
    return t.events.select(
        e.alias("attempt_id"), F.col("user_id").alias("chunk_id"), F.when(http, "http").otherwise("spool").alias("origin"), F.when(e % 5 == 0, "failed").when(e % 5 == 1, "empty").otherwise("received").alias("disposition"),
        F.when(e % 5 == 0, F.col("event_type")).alias("error_category"), F.when(http, F.when(e % 5 == 0, 503).otherwise(200)).alias("http_status"), F.length("props").alias("bytes"),
        F.col("ts").cast("timestamp_ntz").alias("started_at"), F.when(e % 7 != 0, end).alias("finished_at"),
    )


_OUTCOMES = """SELECT o_orderkey, o_orderpriority, o_custkey % 10 <> 0 AS leaf, CASE o_orderkey % 6 WHEN 0 THEN 'insert' WHEN 1 THEN 'newer' WHEN 2 THEN 'noop' WHEN 3 THEN 'unordered_noop' WHEN 4 THEN 'revision_only' ELSE 'stale_skip' END AS outcome,
 o_orderstatus <> 'P' AS committed, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 5 + 1 END AS old_levels, n AS levels, CASE WHEN o_custkey % 2 = 0 THEN 'not_delivered' ELSE 'rejected' END AS unknown_levels_reason
 FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""


def _outcomes(t):
    """An order is an occurrence with its lines as levels (unknown if it has none); what it replaces follows from its key."""
    k = F.col("o_orderkey")
    levels = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("levels"))
    outcome = F.element_at(F.array(*[F.lit(x) for x in ("insert", "newer", "noop", "unordered_noop", "revision_only", "stale_skip")]), (k % 6 + 1).cast("int"))
    return t.orders.join(levels, "o_orderkey", "left").select(
        "o_orderkey", "o_orderpriority", (F.col("o_custkey") % 10 != 0).alias("leaf"), outcome.alias("outcome"), (F.col("o_orderstatus") != "P").alias("committed"),
        F.when(k % 6 != 0, k % 5 + 1).alias("old_levels"), "levels", F.when(F.col("o_custkey") % 2 == 0, "not_delivered").otherwise("rejected").alias("unknown_levels_reason"),
    )


_TILE = "CAST(CASE WHEN longitude = 120 THEN 110 ELSE floor((longitude - 20) / 10) * 10 + 20 END AS BIGINT) AS west, CAST(CASE WHEN latitude = 30 THEN 20 ELSE floor((latitude + 60) / 10) * 10 - 60 END AS BIGINT) AS south"

SLOTS = f"""SELECT month, west, south, CASE (CAST(date_part('month', month) AS BIGINT) + west // 10 + (south + 60) // 10) % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'empty_verified' ELSE 'covered' END AS state, count(*) AS profiles, CAST(sum(n) AS BIGINT) AS levels, CAST(sum(n) * 240 AS BIGINT) AS bytes
 FROM (SELECT observation_month AS month, {_TILE}, 1 + CAST(profile_id AS BIGINT) % 7 AS n FROM b_profiles) GROUP BY 1, 2, 3"""


def _tile():
    west = F.when(F.col("longitude") == 120, 110).otherwise(F.floor((F.col("longitude") - 20) / 10) * 10 + 20).cast("long")
    south = F.when(F.col("latitude") == 30, 20).otherwise(F.floor((F.col("latitude") + 60) / 10) * 10 - 60).cast("long")
    return west.alias("west"), south.alias("south")


def slots(t):
    """Slots with their counts, as a manifest writes them: a header stands for 1 + key % 7 levels, and month and tile say which slots are missing."""
    made = t.profiles.groupBy(F.col("observation_month").alias("month"), *_tile()).agg(F.count("*").alias("profiles"), F.sum(F.col("profile_id").cast("long") % 7 + 1).alias("levels"))
    k = (F.month("month") + F.col("west") / 10 + (F.col("south") + 60) / 10) % 5
    return made.withColumns({"state": F.when(k == 0, "missing").when(k == 1, "empty_verified").otherwise("covered"), "bytes": F.col("levels") * 240})


_DELIVERED_SLOTS = f"""SELECT observation_month AS month, {_TILE}, CAST(sum(n) AS BIGINT) AS levels, CAST(sum(n) * 240 AS BIGINT) AS bytes
 FROM b_profiles m JOIN (SELECT profile_id, count(*) AS n FROM b_delivered GROUP BY 1) l ON l.profile_id = m.profile_id WHERE longitude BETWEEN 40 AND 90 GROUP BY 1, 2, 3"""


def _delivered_slots(t):
    """Slots between 40 and 90 degrees with the counts of their delivered levels; a slot that has levels is covered."""
    counts = t.delivered.groupBy("profile_id").agg(F.count("*").alias("n"))
    asked = t.profiles.where(F.col("longitude").between(40, 90)).select("profile_id", F.col("observation_month").alias("month"), *_tile())
    made = asked.join(counts, "profile_id").groupBy("month", "west", "south").agg(F.sum("n").alias("levels"))
    return made.withColumns({"state": F.lit("covered"), "bytes": F.col("levels") * 240})


# Queries --------------------------------------------------------------------------------------------

_SUFFIXES = {"original": "", "adjusted": "_adjusted", "qc": "_qc", "adjusted_qc": "_adjusted_qc"}


@query("agg_availability", "WITH x AS (SELECT l.*, observed_at FROM b_levels l JOIN b_profiles m ON m.profile_id = l.profile_id) " + " UNION ALL ".join(
    f"SELECT '{scope}' AS scope, '{v}' AS variable, '{name}' AS field, count({v}{suffix}) AS n FROM x{where}"
    for scope, where in (("whole", ""), ("window", " WHERE observed_at >= TIMESTAMP '1996-01-01' AND observed_at < TIMESTAMP '1997-01-01'")) for v in VARIABLES for name, suffix in _SUFFIXES.items()))
def _(t):
    return acc.availability(t.levels.join(t.profiles.select("profile_id", "observed_at"), "profile_id"), "1996-01-01", "1997-01-01")


@query("agg_payloads", f"""WITH a AS ({_ATTEMPTS}), m AS (SELECT event_id AS attempt_id, length(props) * 2 AS bytes FROM events WHERE event_id % 3 = 0 AND event_id % 5 <> 0 UNION ALL SELECT event_id, 7 FROM events WHERE event_id % 30 = 9),
 f AS (SELECT attempt_id, count(*) AS n, sum(bytes) AS b FROM m GROUP BY 1)
 SELECT origin, disposition, count(*) AS attempts, CAST(sum(bytes) AS BIGINT) AS received_bytes, CAST(coalesce(sum(n), 0) AS BIGINT) AS verified_payloads, CAST(coalesce(sum(b), 0) AS BIGINT) AS verified_bytes FROM a LEFT JOIN f USING (attempt_id) GROUP BY 1, 2""")
def _(t):
    """Some attempts have one payload, some two, many none."""
    one = t.events.where("event_id % 3 = 0 AND event_id % 5 <> 0").select(F.col("event_id").alias("attempt_id"), (F.length("props") * 2).alias("bytes"))
    two = t.events.where("event_id % 30 = 9").select(F.col("event_id").alias("attempt_id"), F.lit(7).alias("bytes"))
    return acc.payload_accounting(_attempts(t), one.unionByName(two))


@query("agg_outcomes", f"SELECT leaf, outcome, committed, count(*) AS occurrences, CAST(coalesce(sum(levels), 0) AS BIGINT) AS known_levels, count(*) FILTER (levels IS NULL) AS unknown_level_profiles FROM ({_OUTCOMES}) GROUP BY 1, 2, 3")
def _(t):
    return acc.outcome_accounting(_outcomes(t))


@query("agg_attempt_timing", f"""SELECT origin, disposition, count(*) AS attempts, count(*) FILTER (finished_at IS NULL) AS unfinished, CAST(sum(epoch_us(finished_at) - epoch_us(started_at)) AS BIGINT) AS elapsed_micros_sum,
 CAST(max(epoch_us(finished_at) - epoch_us(started_at)) AS BIGINT) AS elapsed_micros_max, min(started_at) AS first_started_at, max(finished_at) AS last_finished_at FROM ({_ATTEMPTS}) GROUP BY 1, 2""")
def _(t):
    return acc.attempt_timing(_attempts(t))


@query("agg_reasons", f"""WITH a AS ({_ATTEMPTS}), o AS ({_OUTCOMES})
 SELECT 'attempt' AS family, origin AS subject, disposition, error_category AS reason, CAST(http_status AS VARCHAR) AS code, count(*) AS n FROM a GROUP BY ALL
 UNION ALL SELECT 'state', event_type, NULL, CASE WHEN event_id % 4 > 0 THEN 'reason_' || event_id % 3 END AS r, NULL, count(*) FROM events GROUP BY event_type, r
 UNION ALL SELECT 'unknown_levels', NULL, NULL, unknown_levels_reason, NULL, count(*) FROM o WHERE leaf AND levels IS NULL GROUP BY unknown_levels_reason""")
def _(t):
    """Why attempts ended, states changed and levels are unknown; one event in four gives no reason."""
    reason = F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("reason_"), (F.col("event_id") % 3).cast("string")))
    return acc.reason_counts(_attempts(t), t.events.select(F.col("event_type").alias("new_state"), reason.alias("reason")), _outcomes(t))


@query("agg_level_delta", f"""WITH o AS ({_OUTCOMES}), d AS (SELECT o_orderpriority AS p, CAST(coalesce(sum(old_levels) FILTER (outcome = 'newer'), 0) AS BIGINT) AS removed, CAST(coalesce(sum(levels) FILTER (outcome IN ('insert', 'newer')), 0) AS BIGINT) AS inserted,
  CAST(coalesce(sum(levels) FILTER (outcome IN ('noop', 'unordered_noop', 'revision_only')), 0) AS BIGINT) AS no_op, CAST(coalesce(sum(levels) FILTER (outcome = 'stale_skip'), 0) AS BIGINT) AS stale_skipped FROM o WHERE leaf AND committed GROUP BY 1),
 s AS (SELECT o_orderpriority AS p, CAST(sum(coalesce(old_levels, 0)) AS BIGINT) AS before, CAST(sum(CASE WHEN o_orderpriority LIKE '1%' AND o_orderkey % 50 = 1 THEN 0 WHEN leaf AND committed AND outcome IN ('insert', 'newer') THEN coalesce(levels, 0) ELSE coalesce(old_levels, 0) END) AS BIGINT) AS after FROM o GROUP BY 1)
 SELECT s.p AS o_orderpriority, coalesce(removed, 0) AS removed, coalesce(inserted, 0) AS inserted, coalesce(no_op, 0) AS no_op, coalesce(stale_skipped, 0) AS stale_skipped, before, after, before - coalesce(removed, 0) + coalesce(inserted, 0) = after AS balanced FROM s LEFT JOIN d ON d.p = s.p""")
def _(t):
    """Levels replaced by priority, held against the store before and after; of the first priority the store has lost some."""
    o = _outcomes(t)
    old = F.coalesce("old_levels", F.lit(0))
    lost = F.col("o_orderpriority").startswith("1") & (F.col("o_orderkey") % 50 == 1)
    replaced = F.col("leaf") & F.col("committed") & F.col("outcome").isin("insert", "newer")
    key = "o_orderpriority"
    before = o.groupBy(key).agg(F.sum(old).alias("levels"))
    after = o.groupBy(key).agg(F.sum(F.when(lost, 0).when(replaced, F.coalesce("levels", F.lit(0))).otherwise(old)).alias("levels"))
    return acc.level_balance(acc.level_delta(o, key), before, after, key)


@query("agg_coverage_summary", f"""SELECT count(*) AS slots_total, count(*) FILTER (state = 'covered') AS slots_covered, count(*) FILTER (state = 'empty_verified') AS slots_empty_verified, count(*) FILTER (state = 'missing') AS slots_missing, count(DISTINCT month) AS months,
 CAST(coalesce(sum(profiles) FILTER (state = 'covered'), 0) AS BIGINT) AS estimated_profiles, CAST(coalesce(sum(levels) FILTER (state = 'covered'), 0) AS BIGINT) AS estimated_levels, CAST(coalesce(sum(bytes) FILTER (state = 'covered'), 0) AS BIGINT) AS object_bytes, count(*) FILTER (state = 'missing') > 0 AS partial FROM ({SLOTS})""")
def _(t):
    return acc.coverage_summary(slots(t))


@query("agg_cost_estimate", f"SELECT CAST(month AS VARCHAR) AS observation_month, count(*) AS slots, CAST(sum(levels) AS BIGINT) AS levels, CAST(sum(bytes) AS BIGINT) AS bytes FROM ({_DELIVERED_SLOTS}) GROUP BY 1")
def _(t):
    """Levels and bytes of every slot asked for, from the counts of all its delivered levels."""
    return acc.estimate_levels(_delivered_slots(t).withColumn("observation_month", F.col("month").cast("string")), "observation_month")


@query("agg_progress", """WITH c AS (SELECT o_custkey AS job_id, o_orderkey AS ordinal, CASE WHEN o_orderkey % 10 = 0 THEN 'export' ELSE 'fetch' END AS kind, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'running' ELSE 'failed' END AS state FROM orders),
 s AS (SELECT user_id AS job_id, count(*) AS total, count(*) FILTER (event_type = 'error') AS missing FROM events GROUP BY 1),
 g AS (SELECT job_id, count(*) AS chunks_total, count(*) FILTER (kind = 'fetch') AS fetch_total, count(*) FILTER (kind = 'fetch' AND state = 'complete') AS fetch_complete, count(*) FILTER (kind = 'fetch' AND state = 'failed') AS fetch_failed,
  count(*) FILTER (kind = 'fetch' AND state = 'running') AS fetch_running, coalesce(arg_min(state, ordinal) FILTER (kind = 'export'), 'pending') AS export_state FROM c GROUP BY 1)
 SELECT g.*, coalesce(total, 0) AS slots_total, coalesce(total - missing, 0) AS slots_reused, coalesce(missing, 0) AS slots_missing, CASE WHEN coalesce(total, 0) = 0 THEN 1e0 ELSE round((total - missing) / total + 1e-9, 4) END AS reuse_ratio FROM g LEFT JOIN s ON s.job_id = g.job_id""")
def _(t):
    """Chunks of a job by kind and state, and how many of its slots were there already."""
    s = F.col("o_orderstatus")
    chunks = t.orders.select(
        F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("ordinal"), F.when(F.col("o_orderkey") % 10 == 0, "export").otherwise("fetch").alias("kind"),
        F.when(s == "F", "complete").when(s == "O", "running").otherwise("failed").alias("state"),
    )
    return acc.chunk_progress(chunks, t.events.select(F.col("user_id").alias("job_id"), F.when(F.col("event_type") == "error", "missing").otherwise("covered").alias("state")))


_STATES = ", ".join(f"count(*) FILTER (leaf AND state = '{s}') AS {s}" for s in acc.STATES)
_BY_KEY = "CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(acc.STATES)) + " END"


@query("agg_run_status", f"""WITH c AS (SELECT o_orderkey AS chunk_id, o_custkey AS run_id, o_orderkey // 8 % 6 <> 0 AS leaf, {_BY_KEY} AS state, strftime(o_orderdate, '%Y-%m') || '/' || o_orderkey AS logical_key FROM orders),
 a AS (SELECT event_id // 2 AS chunk_id, count(*) AS n, count(*) FILTER (event_id % 2 + 1 > 1) AS again FROM events GROUP BY 1), r AS (SELECT run_id, sum(n) AS n, sum(again) AS again FROM c JOIN a USING (chunk_id) GROUP BY 1),
 g AS (SELECT run_id, {_STATES}, count(*) FILTER (leaf AND state IN ('quarantined', 'failed')) AS missing, coalesce(array_to_string((list(logical_key ORDER BY logical_key) FILTER (leaf AND state IN ('quarantined', 'failed')))[1:2], ','), '') AS missing_chunks FROM c GROUP BY 1)
 SELECT g.*, CAST(coalesce(n, 0) AS BIGINT) AS request_attempts, CAST(coalesce(again, 0) AS BIGINT) AS http_retries FROM g LEFT JOIN r ON r.run_id = g.run_id""")
def _(t):
    """Leaf states of a run, its missing leaves (the first two by key) and its retries."""
    state = F.element_at(F.array(*map(F.lit, acc.STATES)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    key = F.concat_ws("/", F.date_format("o_orderdate", "yyyy-MM"), F.col("o_orderkey").cast("string"))
    chunks = t.orders.select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("run_id"), (F.floor(F.col("o_orderkey") / 8) % 6 != 0).alias("leaf"), state.alias("state"), key.alias("logical_key"))
    attempts = t.events.select(F.floor(F.col("event_id") / 2).alias("chunk_id"), (F.col("event_id") % 2 + 1).alias("request_attempt"))
    return acc.run_status(chunks, attempts, most_listed=2).withColumn("missing_chunks", F.array_join("missing_chunks", ","))


@query("agg_llm_daily", """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS calls, CAST(CAST(sum(CAST(value AS DECIMAL(12,6))) AS DECIMAL(22,6)) AS VARCHAR) AS cost, CAST(sum(CAST(floor(value) AS BIGINT) + user_id + CASE WHEN event_id % 2 = 0 THEN 3 ELSE 0 END) AS BIGINT) AS tokens,
 sum(CAST(value AS DECIMAL(12,6))) >= 5000 OR sum(CAST(floor(value) AS BIGINT) + user_id + CASE WHEN event_id % 2 = 0 THEN 3 ELSE 0 END) >= 4000 AS over_cap FROM events GROUP BY 1""")
def _(t):
    calls = t.events.select(
        F.col("ts").alias("at"), F.col("value").cast("decimal(12,6)").alias("usd"), F.floor("value").alias("input_tokens"), F.col("user_id").alias("output_tokens"), F.when(F.col("event_id") % 2 == 0, 3).alias("thinking_tokens")
    )
    made = acc.daily_usage(calls, 5000, 4000)
    return made.select(F.col("day").cast("string").alias("day"), "calls", F.col("usd").cast("decimal(22,6)").cast("string").alias("cost"), "tokens", "over_cap")


@query("agg_latency_table", """WITH c AS (SELECT event_type AS label, event_id AS k, event_id % 10 = 0 AS cold, NOT (event_type IN ('error', 'click') AND event_id % 20 = 5) AS ok, 'timeout_' || event_id % 3 AS error, value AS ms FROM events),
 g AS (SELECT label, arg_min(ms, k) FILTER (cold AND ok) AS cold_ms, quantile_disc(ms, 0.5) FILTER (ok AND NOT cold) AS warm_p50, quantile_disc(ms, 0.95) FILTER (ok AND NOT cold) AS warm_p95, count(*) FILTER (NOT ok) AS failed_calls, coalesce(arg_min(error, k) FILTER (NOT ok), 'ok') AS status FROM c GROUP BY 1)
 SELECT *, CASE WHEN failed_calls > 0 THEN 'failed' WHEN warm_p95 IS NULL THEN 'no warm samples' WHEN warm_p95 >= 150 THEN 'slow' END AS problem, CASE WHEN failed_calls = 0 AND warm_p95 < 150 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM g""")
def _(t):
    """One call in ten is cold; some calls of two labels failed."""
    e = F.col("event_id")
    failed = F.col("event_type").isin("error", "click") & (e % 20 == 5)
    calls = t.events.select(F.col("event_type").alias("label"), e.alias("at"), (e % 10 == 0).alias("cold"), (~failed).alias("ok"), F.concat(F.lit("timeout_"), (e % 3).cast("string")).alias("error"), F.col("value").alias("ms"))
    return acc.latency_report(calls, 150)
