"""Accounting of runs as functions of their own records: attempts, outcomes, chunks, slots, model calls, latencies.

Every function takes DataFrames with the columns that its docstring names, and ignores further ones. Groups are aggregated
in each task before they are shuffled; the only lists that are gathered have a bound, which is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from castline.functions.qc import VARIABLES
from castline.operators.quantiles import quantiles

# The fields of a variable whose presence is counted, what outcomes do to stored levels, and states that end a chunk.
FIELDS = {"original": "", "adjusted": "_adjusted", "qc": "_qc", "adjusted_qc": "_adjusted_qc"}
REPLACES, INSERTS = ("newer",), ("insert", "newer")
LEAVES_ALONE, SKIPS = ("noop", "unordered_noop", "revision_only"), ("stale_skip",)
TERMINAL = ("complete", "quarantined", "failed")
STATES = ("planned", "fetching", "landed", "validating", "publishing", *TERMINAL)


def _total(condition: Column, value: str) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0)).cast("long")


def availability(levels: DataFrame, start: str, end: str) -> DataFrame:
    """scope (whole, window), variable, field, n: values that are there, over all levels and over those observed within [start, end).

    ``levels`` has observed_at and the stored columns of each variable; a column that it lacks is left out. One pass; an empty
    table has counts of 0.
    """
    inside = (F.col("observed_at") >= F.lit(start).cast("timestamp")) & (F.col("observed_at") < F.lit(end).cast("timestamp"))
    wanted = [(v, name, v + suffix) for v in VARIABLES for name, suffix in FIELDS.items() if v + suffix in levels.columns]
    counts = [F.count(c).alias(f"whole_{c}") for _, _, c in wanted] + [F.count_if(inside & F.col(c).isNotNull()).alias(f"window_{c}") for _, _, c in wanted]
    row = lambda scope, v, name, c: F.struct(F.lit(scope).alias("scope"), F.lit(v).alias("variable"), F.lit(name).alias("field"), F.col(f"{scope}_{c}").alias("n"))
    rows = F.array(*[row(scope, *w) for scope in ("whole", "window") for w in wanted])
    return levels.agg(*counts).select(F.explode(rows).alias("_r")).select("_r.*")


def payload_accounting(attempts: DataFrame, manifests: DataFrame) -> DataFrame:
    """origin, disposition, attempts, received_bytes, verified_payloads, verified_bytes.

    ``attempts``: attempt_id, origin, disposition, bytes; ``manifests``: attempt_id, bytes. Payloads are folded to one row an attempt
    first, so that an attempt with several counts once.
    """
    verified = manifests.groupBy("attempt_id").agg(F.count("*").alias("_n"), F.sum("bytes").alias("_bytes"))
    both = attempts.select("attempt_id", "origin", "disposition", "bytes").join(verified, "attempt_id", "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return both.groupBy("origin", "disposition").agg(
        F.count("*").alias("attempts"), zero("bytes").alias("received_bytes"), zero("_n").alias("verified_payloads"), zero("_bytes").alias("verified_bytes")
    )


def outcome_accounting(outcomes: DataFrame) -> DataFrame:
    """leaf, outcome, committed, occurrences, known_levels, unknown_level_profiles, of ``outcomes``: leaf, outcome, committed, levels (null: unknown)."""
    return outcomes.groupBy("leaf", "outcome", "committed").agg(
        F.count("*").alias("occurrences"), F.coalesce(F.sum("levels"), F.lit(0)).cast("long").alias("known_levels"), F.count_if(F.col("levels").isNull()).alias("unknown_level_profiles")
    )


def attempt_timing(attempts: DataFrame, *keys: str) -> DataFrame:
    """keys (origin and disposition by default), attempts, unfinished, elapsed_micros_sum, elapsed_micros_max, first_started_at, last_finished_at.

    An attempt without ``finished_at`` counts as unfinished and adds no time; a group of such only has nulls.
    """
    elapsed = F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    return attempts.groupBy(*(keys or ("origin", "disposition"))).agg(
        F.count("*").alias("attempts"), F.count_if(F.col("finished_at").isNull()).alias("unfinished"), F.sum(elapsed).alias("elapsed_micros_sum"),
        F.max(elapsed).alias("elapsed_micros_max"), F.min("started_at").alias("first_started_at"), F.max("finished_at").alias("last_finished_at"),
    )


def reason_counts(attempts: DataFrame, events: DataFrame, outcomes: DataFrame) -> DataFrame:
    """family, subject, disposition, reason, code, n: why attempts ended, states changed and levels are unknown.

    ``attempts``: origin, disposition, error_category, http_status; ``events``: new_state, reason; ``outcomes``: leaf, levels,
    unknown_levels_reason, of which only leaves without levels count. A column that a family has not got is null there.
    """
    none = F.lit(None).cast("string")
    families = (
        (attempts, "attempt", F.col("origin"), F.col("disposition"), F.col("error_category"), F.col("http_status").cast("string")),
        (events, "state", F.col("new_state"), none, F.col("reason"), none),
        (outcomes.where("leaf AND levels IS NULL"), "unknown_levels", none, none, F.col("unknown_levels_reason"), none),
    )
    names = ("family", "subject", "disposition", "reason", "code")
    rows = None
    for df, family, *columns in families:
        part = df.select(*[c.alias(n) for c, n in zip((F.lit(family), *columns), names, strict=True)]).groupBy(*names).agg(F.count("*").alias("n"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def level_delta(outcomes: DataFrame, *keys: str) -> DataFrame:
    """keys, removed, inserted, no_op, stale_skipped levels of committed outcomes in leaves.

    ``outcomes``: outcome, committed, leaf, old_levels (what a newer revision replaces), levels. Without keys there is one row, of zeros
    if nothing was committed.
    """
    done = outcomes.where("leaf AND committed")
    of = lambda names: F.col("outcome").isin(*names)
    return done.groupBy(*keys).agg(
        _total(of(REPLACES), "old_levels").alias("removed"), _total(of(INSERTS), "levels").alias("inserted"),
        _total(of(LEAVES_ALONE), "levels").alias("no_op"), _total(of(SKIPS), "levels").alias("stale_skipped"),
    )


def level_balance(delta: DataFrame, before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """``delta`` with before, after and balanced: before - removed + inserted = after; null where nothing is known of before.

    ``before`` and ``after``: keys (one at least), levels. A key that only one of the three has is listed too.
    """
    both = before.select(*keys, F.col("levels").alias("before")).join(after.select(*keys, F.col("levels").alias("after")), list(keys), "full")
    made = delta.join(both, list(keys), "full").fillna(0, ["removed", "inserted", "no_op", "stale_skipped", "after"])
    return made.withColumn("balanced", F.col("before") - F.col("removed") + F.col("inserted") == F.col("after"))


def coverage_summary(slots: DataFrame) -> DataFrame:
    """slots_total, slots_covered, slots_empty_verified, slots_missing, months, estimated_profiles, estimated_levels, object_bytes, partial: one row.

    ``slots``: month, state (covered, empty_verified, missing), profiles, levels, bytes. Only covered slots add to the estimates.
    """
    state, covered = F.col("state"), F.col("state") == "covered"
    return slots.agg(
        F.count("*").alias("slots_total"), F.count_if(covered).alias("slots_covered"), F.count_if(state == "empty_verified").alias("slots_empty_verified"),
        F.count_if(state == "missing").alias("slots_missing"), F.count_distinct("month").alias("months"), _total(covered, "profiles").alias("estimated_profiles"),
        _total(covered, "levels").alias("estimated_levels"), _total(covered, "bytes").alias("object_bytes"), (F.count_if(state == "missing") > 0).alias("partial"),
    )


def estimate_levels(slots: DataFrame, *keys: str) -> DataFrame:
    """keys, slots, levels, bytes that a plan over ``slots`` would read, from the slots' own counts: no level is scanned."""
    return slots.where("state = 'covered'").groupBy(*keys).agg(F.count("*").alias("slots"), F.coalesce(F.sum("levels"), F.lit(0)).cast("long").alias("levels"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))


def chunk_progress(chunks: DataFrame, slots: DataFrame) -> DataFrame:
    """job_id, chunks_total, fetch_total, fetch_complete, fetch_failed, fetch_running, export_state, slots_total, slots_reused, slots_missing, reuse_ratio.

    ``chunks``: job_id, ordinal, kind (fetch, export), state; ``slots``: job_id, state. A job without an export chunk waits for one
    (``pending``); one without slots reuses all (1.0).
    """
    fetch = F.col("kind") == "fetch"
    of = lambda state: F.count_if(fetch & (F.col("state") == state)).alias(f"fetch_{state}")
    export = F.min_by(F.when(F.col("kind") == "export", F.col("state")), F.when(F.col("kind") == "export", F.col("ordinal")))
    done = chunks.groupBy("job_id").agg(
        F.count("*").alias("chunks_total"), F.count_if(fetch).alias("fetch_total"), of("complete"), of("failed"), of("running"), F.coalesce(export, F.lit("pending")).alias("export_state")
    )
    missing = F.count_if(F.col("state") == "missing")
    reuse = slots.groupBy("job_id").agg(F.count("*").alias("slots_total"), (F.count("*") - missing).alias("slots_reused"), missing.alias("slots_missing"))
    both = done.join(reuse, "job_id", "left").fillna(0, ["slots_total", "slots_reused", "slots_missing"])
    ratio = F.when(F.col("slots_total") == 0, 1.0).otherwise(F.round(F.col("slots_reused") / F.col("slots_total") + 1e-9, 4))
    return both.withColumn("reuse_ratio", ratio)


def run_status(chunks: DataFrame, attempts: DataFrame, most_listed: int = 500) -> DataFrame:
    """run_id, a column for each of STATES (leaves in it), missing, missing_chunks, request_attempts, http_retries.

    ``chunks``: chunk_id, run_id, leaf, state, logical_key; ``attempts``: chunk_id, request_attempt. A leaf is missing if it ended
    otherwise than complete; ``missing`` counts all of them, ``missing_chunks`` lists the first ``most_listed`` keys, as the report shows.
    """
    leaves = chunks.where("leaf")
    gone = F.col("state").isin(*TERMINAL) & (F.col("state") != "complete")
    # Counted from chunks rather than pivoted, so that a run without leaves is listed with zeros.
    states = chunks.groupBy("run_id").agg(*[F.count_if(F.col("leaf") & (F.col("state") == s)).alias(s) for s in STATES], F.count_if(F.col("leaf") & gone).alias("missing"))
    first = leaves.where(gone).withColumn("_n", F.row_number().over(W.partitionBy("run_id").orderBy("logical_key", "chunk_id"))).where(F.col("_n") <= most_listed)
    listed = first.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "logical_key"))), lambda x: x["logical_key"]).alias("missing_chunks"))
    tries = attempts.groupBy("chunk_id").agg(F.count("*").alias("_all"), F.count_if(F.col("request_attempt") > 1).alias("_again"))
    counted = chunks.select("chunk_id", "run_id").join(tries, "chunk_id").groupBy("run_id").agg(F.sum("_all").alias("request_attempts"), F.sum("_again").alias("http_retries"))
    made = states.join(counted, "run_id", "left").fillna(0, ["request_attempts", "http_retries"]).join(listed, "run_id", "left")
    return made.withColumn("missing_chunks", F.coalesce("missing_chunks", F.array().cast("array<string>")))


def daily_usage(calls: DataFrame, cap_usd: float, cap_tokens: int) -> DataFrame:
    """day (UTC), calls, usd (exact), tokens, over_cap: whether the day has reached a cap.

    ``calls``: at, usd (decimal), input_tokens, output_tokens, thinking_tokens; a null adds nothing. A cap of 0 is none.
    """
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    tokens = F.sum(count("input_tokens") + count("output_tokens") + count("thinking_tokens"))
    made = calls.groupBy(F.to_date(F.col("at").cast("timestamp")).alias("day")).agg(F.count("*").alias("calls"), F.coalesce(F.sum("usd"), F.lit(0)).alias("usd"), tokens.alias("tokens"))
    reached = lambda value, cap: (F.lit(cap) > 0) & (F.col(value) >= F.lit(str(cap)).cast("decimal(22,6)"))
    return made.withColumn("over_cap", reached("usd", cap_usd) | reached("tokens", cap_tokens))


def latency_report(calls: DataFrame, objective_ms: float) -> DataFrame:
    """label, cold_ms, warm_p50, warm_p95, failed_calls, status, verdict, problem.

    ``calls``: label, at (order of the calls), cold, ok, error, ms. Failed calls have no part in the times; ``status`` is the first
    failed call's error, or ok. A label passes if no call failed and its warm p95 lies under the objective.
    """
    failed, cold = ~F.col("ok"), F.col("cold")
    each = calls.groupBy("label").agg(
        F.min_by(F.when(cold & F.col("ok"), F.col("ms")), F.when(cold & F.col("ok"), F.col("at"))).alias("cold_ms"), F.count_if(failed).alias("failed_calls"),
        F.coalesce(F.min_by(F.when(failed, F.col("error")), F.when(failed, F.col("at"))), F.lit("ok")).alias("status"),
    )
    warm = quantiles(calls.where(F.col("ok") & ~cold), ["label"], "ms", {"warm_p50": ("nearest", 0.5), "warm_p95": ("nearest", 0.95)})
    problem = F.when(F.col("failed_calls") > 0, "failed").when(F.col("warm_p95").isNull(), "no warm samples").when(F.col("warm_p95") >= objective_ms, "slow")
    both = each.join(warm, "label", "left").withColumn("problem", problem)
    return both.withColumn("verdict", F.when(F.col("problem").isNull(), "PASS").otherwise("FAIL"))
