"""Accounting of runs and decisions of a batch on hand-made records."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from castline import catalogue
from castline.operators import accounting as acc
from castline.operators import ingestion as ing

D, T = dt.date, dt.datetime


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_payloads_of_an_attempt_do_not_count_it_twice(spark):
    attempts = spark.createDataFrame([(1, "http", "received", 10), (2, "http", "received", None), (3, "http", "failed", 4)], "attempt_id long, origin string, disposition string, bytes long")
    manifests = spark.createDataFrame([(1, 3), (1, 4), (9, 5)], "attempt_id long, bytes long")
    got = rows(acc.payload_accounting(attempts, manifests), "origin", "disposition", "attempts", "received_bytes", "verified_payloads", "verified_bytes")
    assert got == [("http", "failed", 1, 4, 0, 0), ("http", "received", 2, 10, 2, 7)]
    assert acc.payload_accounting(attempts.limit(0), manifests).count() == 0


def test_timing_of_unfinished_attempts(spark):
    at = lambda s: T(2024, 1, 1, 0, 0, s)
    data = [("http", "ok", at(0), at(5)), ("http", "ok", at(2), None), ("http", "ok", at(1), at(2)), ("spool", "ok", at(3), None)]
    got = acc.attempt_timing(spark.createDataFrame(data, "origin string, disposition string, started_at timestamp, finished_at timestamp"))
    assert rows(got, "origin", "attempts", "unfinished", "elapsed_micros_sum", "elapsed_micros_max", "first_started_at", "last_finished_at") == [
        ("http", 3, 1, 6_000_000, 5_000_000, at(0), at(5)), ("spool", 1, 1, None, None, at(3), None),
    ]


def test_reasons_keep_nulls_and_families_apart(spark):
    attempts = spark.createDataFrame([("http", "failed", "timeout", 503), ("http", "failed", None, None), ("http", "failed", None, None)], "origin string, disposition string, error_category string, http_status int")
    events = spark.createDataFrame([("failed", "timeout"), ("failed", None)], "new_state string, reason string")
    outcomes = spark.createDataFrame([(True, None, "rejected"), (True, 4, "rejected"), (False, None, "rejected"), (True, None, None)], "leaf boolean, levels long, unknown_levels_reason string")
    assert rows(acc.reason_counts(attempts, events, outcomes), "family", "subject", "disposition", "reason", "code", "n") == sorted([
        ("attempt", "http", "failed", "timeout", "503", 1), ("attempt", "http", "failed", None, None, 2), ("state", "failed", None, "timeout", None, 1),
        ("state", "failed", None, None, None, 1), ("unknown_levels", None, None, "rejected", None, 1), ("unknown_levels", None, None, None, None, 1),
    ], key=repr)


def test_level_delta_counts_committed_leaves_and_balances(spark):
    data = [("a", "newer", True, True, 5, 7), ("a", "insert", True, True, None, 3), ("a", "newer", False, True, 50, 70), ("a", "newer", True, False, 50, 70), ("a", "noop", True, True, 4, 4), ("b", "stale_skip", True, True, 9, 8)]
    outcomes = spark.createDataFrame(data, "k string, outcome string, committed boolean, leaf boolean, old_levels long, levels long")
    assert rows(acc.level_delta(outcomes), "removed", "inserted", "no_op", "stale_skipped") == [(5, 10, 4, 8)]
    assert rows(acc.level_delta(outcomes.limit(0)), "removed", "inserted", "no_op", "stale_skipped") == [(0, 0, 0, 0)]
    held = lambda pairs: spark.createDataFrame(pairs, "k string, levels long")
    got = acc.level_balance(acc.level_delta(outcomes, "k"), held([("a", 100), ("b", 9), ("c", 1)]), held([("a", 105), ("b", 8), ("c", 1), ("d", 2)]), "k")
    assert rows(got, "k", "balanced") == [("a", True), ("b", False), ("c", True), ("d", None)]


def test_run_status_lists_the_first_missing_and_counts_all(spark):
    chunks = [(i, "r", i != 9, "failed" if i > 2 else "complete", f"k{9 - i}") for i in range(10)] + [(20, "s", False, "failed", "x")]
    attempts = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (20, 1), (99, 2)], "chunk_id long, request_attempt int")
    got = acc.run_status(spark.createDataFrame(chunks, "chunk_id long, run_id string, leaf boolean, state string, logical_key string"), attempts, most_listed=2)
    assert rows(got, "run_id", "complete", "failed", "missing", "missing_chunks", "request_attempts", "http_retries") == [("r", 3, 6, 6, ["k1", "k2"], 3, 2), ("s", 0, 0, 0, [], 1, 0)]


def test_progress_of_jobs_without_export_or_slots(spark):
    chunks = spark.createDataFrame([("a", 1, "fetch", "complete"), ("a", 2, "export", "running"), ("a", 3, "export", "failed"), ("b", 1, "fetch", "failed")], "job_id string, ordinal int, kind string, state string")
    slots = spark.createDataFrame([("a", "missing"), ("a", "covered"), ("a", "empty_verified")], "job_id string, state string")
    got = acc.chunk_progress(chunks, slots)
    assert rows(got, "job_id", "chunks_total", "fetch_total", "fetch_failed", "export_state", "slots_total", "slots_reused", "reuse_ratio") == [("a", 3, 1, 0, "running", 3, 2, 0.6667), ("b", 1, 1, 1, "pending", 0, 0, 1.0)]


def test_caps_are_reached_by_cost_or_tokens_and_zero_is_none(spark):
    calls = spark.sql("SELECT * FROM VALUES (TIMESTAMP '2024-01-01 23:00:00', 1.5BD, 3, NULL, 2), (TIMESTAMP '2024-01-02 00:00:00', NULL, 10, 0, 0) AS t(at, usd, input_tokens, output_tokens, thinking_tokens)")
    over = lambda *caps: [r.over_cap for r in acc.daily_usage(calls, *caps).orderBy("day").collect()]
    assert over(1.5, 10) == [True, True] and over(1.6, 11) == [False, False] and over(0, 0) == [False, False]


def test_latency_verdicts(spark):
    data = [("a", 0, True, True, None, 9.0), ("a", 1, False, True, None, 5.0), ("b", 0, True, False, "down", 1.0), ("b", 1, False, False, "late", 1.0), ("b", 2, False, True, None, 1.0), ("c", 0, True, True, None, 3.0), ("d", 1, False, True, None, 10.0)]
    got = acc.latency_report(spark.createDataFrame(data, "label string, at int, cold boolean, ok boolean, error string, ms double"), 10)
    assert rows(got, "label", "cold_ms", "warm_p95", "failed_calls", "status", "verdict", "problem") == [
        ("a", 9.0, 5.0, 0, "ok", "PASS", None), ("b", None, 1.0, 2, "down", "FAIL", "failed"), ("c", 3.0, None, 0, "ok", "FAIL", "no warm samples"), ("d", None, 10.0, 0, "ok", "FAIL", "slow"),
    ]


def test_summary_of_no_slots(spark):
    none = spark.createDataFrame([], "month date, west long, south long, state string, profiles long, levels long, bytes long")
    assert rows(acc.coverage_summary(none), "slots_total", "months", "estimated_levels", "partial") == [(0, 0, 0, False)]
    assert rows(ing.reuse(none), "slots_total", "reuse_ratio") == [(0, 1.0)] and ing.plan_missing(none, "2024-01-01").count() == 0


CASES = [
    (["doxy"], "1990-01-01", 0.0, 0.0, True, "outside_core"), (None, "2024-01-05", 55.0, 5.0, True, "outside_core"), (["pressures"], "2024-01-05", 55.0, 5.0, False, "outside_core"),
    (["salinity_argoqc"], "2024-02-01", 55.0, 5.0, False, "outside_time"), (["pressure"], None, 55.0, 5.0, False, "outside_time"), (["pressure"], "2024-01-05", 20.5, 5.0, False, "outside_region"),
    (["pressure"], "2024-01-05", 60.0, 5.0, True, "overlap_duplicate"), (["pressure"], "2024-01-05", 50.0, 0.0, True, "excluded_source_loss"), (["pressure"], "2024-01-01", 50.0, 9.9, None, "candidate"),
]


def test_first_outcome_that_applies(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, names array<string>, at string, longitude double, latitude double, source_loss boolean, want string").withColumn("observed_at", F.col("at").cast("timestamp"))
    got = ing.classify(df, "2024-01-01", "2024-02-01", F.col("longitude") > 30, F.lit(50), F.lit(0))
    assert [r.outcome for r in got.orderBy("i").collect()] == [c[-1] for c in CASES]


def test_moves_and_caps(spark):
    pairs = lambda data: spark.createDataFrame(data, "profile_id string, slot string")
    assert rows(ing.moved_profiles(pairs([("a", "x"), ("b", "x"), ("c", "x")]), pairs([("a", "y"), ("b", "x"), ("n", "y")])), "profile_id", "slot", "kind") == [("a", "x", "leaves"), ("a", "y", "enters")]
    staged = spark.createDataFrame([("a", 1), ("a", 1), ("b", 5), ("c", None)], "chunk string, level_count long")
    assert rows(ing.cap_check(staged, 1, 4), "chunk", "levels", "rejection") == [("a", 2, "profile_count_limit"), ("b", 5, "measurement_count_limit"), ("c", 0, None)]


def test_receipts_of_touched_slots(spark):
    before = spark.createDataFrame([("kept", 3, 2), ("emptied", 1, 1), ("absent", 2, 0), ("untouched", 5, 5)], "slot string, members long, selected long")
    move = lambda data: spark.createDataFrame(data, "slot string, selected boolean")
    own = spark.createDataFrame([("kept", False), ("absent", False), ("seen", True)], "slot string, observed boolean")
    got = ing.receipts(before, move([("new", True), ("new", False)]), move([("emptied", True)]), own)
    assert rows(got, "slot", "members", "selected", "changed", "fetch_disposition", "stored_disposition") == [
        ("absent", 2, 0, False, "verified_empty_fetch", "empty_stored_selection"), ("emptied", 0, 0, True, "profiles_returned", "empty_stored_domain"),
        ("kept", 3, 2, False, "source_absence_over_retained", "active_generation"), ("new", 2, 1, True, "profiles_returned", "active_generation"),
        ("seen", 0, 0, False, "profiles_returned", "empty_stored_selection"),
    ]


@pytest.mark.parametrize("now, last", [("2024-03-01", "2024-02"), ("2024-02-29", "2024-01")])
def test_months_to_fetch_break_at_the_year_and_at_holes(spark, now, last):
    month = lambda y, m: D(y, m, 1)
    data = [(month(2023, 11), 30, 0, "missing"), (month(2023, 12), 20, 0, "missing"), (month(2023, 12), 30, 0, "missing"), (month(2024, 1), 20, 10, "missing"), (month(2024, 2), 20, 0, "missing"), (month(2023, 9), 20, 0, "missing"), (month(2023, 10), 20, 0, "covered")]
    slots = spark.createDataFrame(data, "month date, west long, south long, state string")
    got = ing.plan_missing(slots, now).orderBy("first_month").collect()
    labels = ["2023-09", "2023-11..2023-12", "2024-01..2024-02" if last == "2024-02" else "2024-01"]
    assert [r.label for r in got] == labels and [tuple(x) for x in got[1].tiles] == [(20, 0), (30, 0)]
    assert rows(ing.reuse(slots), "slots_total", "slots_reused", "reuse_ratio") == [(7, 1, 0.1429)]
    span = ing.narrow(slots.where("state = 'missing'")).first()
    assert (span.start, span.end, [tuple(x) for x in span.tiles]) == (month(2023, 9), month(2024, 3), [(20, 0), (20, 10), (30, 0)])


def test_cost_estimate_counts_every_level_asked_for(spark):
    sf = "/root/testdata/sf0.001"
    got = catalogue.queries()["agg_cost_estimate"](spark, sf)
    orders, lines = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("orders", "lineitem"))
    asked = orders.where("20 + ((o_orderkey * 7919) % 10001) / 100e0 BETWEEN 40 AND 90")
    read = lines.join(asked, lines.l_orderkey == asked.o_orderkey).groupBy(F.date_format("o_orderdate", "yyyy-MM-01").alias("m"))
    assert rows(got, "observation_month", "levels", "bytes") == rows(read.count().withColumn("bytes", F.col("count") * 240), "m", "count", "bytes")
