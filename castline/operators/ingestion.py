"""Decisions of a batch as functions of its records: outcome of an occurrence, moves, caps, receipts, what to fetch.

Every function takes DataFrames with the columns that its docstring names. A tile list is gathered per chunk; a request
has at most the envelope's 90 tiles, so that list has a bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from castline.functions.geo import tile_key
from castline.operators.payload import CORE

# What a chunk may hold.
MOST_PROFILES, MOST_LEVELS = 2000, 2_000_000


def has_core(names: Column) -> Column:
    """Whether a core variable, or an array that belongs to one, is among the names; a null list has none."""
    return F.coalesce(F.exists(names, lambda n: n.rlike(f"^({'|'.join(CORE)})(_|$)")), F.lit(False))


def classify(rows: DataFrame, start: str, end: str, in_region: Column, west: Column, south: Column) -> DataFrame:
    """``rows`` with ``outcome``, the first that applies: outside_core, outside_time, outside_region, overlap_duplicate, excluded_source_loss, candidate.

    ``rows``: names (arrays delivered), observed_at, longitude, latitude, source_loss. The time asked for is [start, end); the tile
    (west, south) owns its west and south edges, and the envelope's outer ones. A null time lies outside, as does a place that
    the region does not know; a null source_loss is none.
    """
    at = F.col("observed_at")
    within = (at >= F.lit(start).cast("timestamp")) & (at < F.lit(end).cast("timestamp"))
    own = tile_key(F.col("longitude"), F.col("latitude")) == F.concat_ws("_", west.cast("string"), south.cast("string"))
    outcome = (
        F.when(~has_core(F.col("names")), "outside_core")
        .when(~F.coalesce(within, F.lit(False)), "outside_time")
        .when(~F.coalesce(in_region, F.lit(False)), "outside_region")
        .when(~own, "overlap_duplicate")
        .when(F.col("source_loss"), "excluded_source_loss")
        .otherwise("candidate")
    )
    return rows.withColumn("outcome", outcome)


def moved_profiles(stored: DataFrame, accepted: DataFrame) -> DataFrame:
    """profile_id, slot, kind: an accepted correction that changes a profile's slot leaves the old one and enters the new one.

    Both sides: profile_id, slot. Profiles that stay, and new ones, are not listed.
    """
    both = stored.select("profile_id", F.col("slot").alias("_old")).join(accepted.select("profile_id", F.col("slot").alias("_new")), "profile_id")
    event = lambda slot, kind: F.struct(F.col(slot).alias("slot"), F.lit(kind).alias("kind"))
    return both.where("_old <> _new").select("profile_id", F.explode(F.array(event("_old", "leaves"), event("_new", "enters"))).alias("_e")).select("profile_id", "_e.*")


def cap_check(staged: DataFrame, most_profiles: int = MOST_PROFILES, most_levels: int = MOST_LEVELS) -> DataFrame:
    """chunk, profiles, levels, rejection: profile_count_limit, measurement_count_limit or null, of ``staged``: chunk, level_count (null: none)."""
    made = staged.groupBy("chunk").agg(F.count("*").alias("profiles"), F.coalesce(F.sum("level_count"), F.lit(0)).cast("long").alias("levels"))
    return made.withColumn("rejection", F.when(F.col("profiles") > most_profiles, "profile_count_limit").when(F.col("levels") > most_levels, "measurement_count_limit"))


def receipts(before: DataFrame, arrivals: DataFrame, departures: DataFrame, own: DataFrame) -> DataFrame:
    """slot, members, selected, changed, fetch_disposition, stored_disposition: a receipt for each slot that a batch touches.

    ``before``: slot, members, selected (profiles stored, and those of them that the request selects); ``arrivals`` and ``departures``:
    slot, selected (one row a profile that comes in, or is replaced or moves out); ``own``: slot, observed (the slots that were
    asked for, and whether the source returned anything). What stands after the commit is what stood less what departs plus
    what arrives. A slot that is not known before has held nothing.
    """
    count = lambda df, name: df.groupBy("slot").agg(F.count("*").alias(f"_{name}"), F.count_if("selected").alias(f"_{name}_selected"))
    moves = count(arrivals, "in").join(count(departures, "out"), "slot", "full").withColumn("changed", F.lit(True))
    rows = moves.join(own.select("slot", "observed"), "slot", "full").join(before.select("slot", "members", "selected"), "slot", "left")
    rows = rows.fillna(0, ["members", "selected", "_in", "_in_selected", "_out", "_out_selected"]).fillna(False, ["changed"])
    rows = rows.withColumns({"members": F.col("members") - F.col("_out") + F.col("_in"), "selected": F.col("selected") - F.col("_out_selected") + F.col("_in_selected")})
    # A slot that changed without being asked for was changed by profiles that the source returned.
    fetch = F.when(F.coalesce("observed", F.lit(True)), "profiles_returned").when(F.col("selected") > 0, "source_absence_over_retained").otherwise("verified_empty_fetch")
    held = F.when(F.col("changed") & (F.col("members") == 0), "empty_stored_domain").when(F.col("selected") > 0, "active_generation").otherwise("empty_stored_selection")
    return rows.select("slot", "members", "selected", "changed", fetch.alias("fetch_disposition"), held.alias("stored_disposition"))


def reuse(slots: DataFrame) -> DataFrame:
    """slots_total, slots_reused, slots_missing, reuse_ratio: one row; a request without slots reuses all."""
    missing = F.count_if(F.col("state") == "missing")
    made = slots.agg(F.count("*").alias("slots_total"), (F.count("*") - missing).alias("slots_reused"), missing.alias("slots_missing"))
    ratio = F.when(F.col("slots_total") == 0, 1.0).otherwise(F.round(F.col("slots_reused") / F.col("slots_total") + 1e-9, 4))
    return made.withColumn("reuse_ratio", ratio)


def plan_missing(slots: DataFrame, now: str) -> DataFrame:
    """label, first_month, last_month, months, tiles: chunks to fetch, whole months that follow each other within a calendar year.

    ``slots``: month (its first day), west, south, state. A month that has not ended by ``now`` is not fetched. ``tiles`` lists, sorted,
    those that any month of the chunk misses.
    """
    ended = F.add_months("month", 1).cast("timestamp") <= F.lit(now).cast("timestamp")
    missing = slots.where((F.col("state") == "missing") & ended).select("month", "west", "south").distinct()
    number = (F.year("month") * 12 + F.month("month")).cast("long")
    months = missing.select("month").distinct().withColumn("_year", F.year("month"))
    runs = months.withColumn("_run", number - F.row_number().over(W.partitionBy("_year").orderBy("month")))
    made = missing.join(runs, "month").groupBy("_year", "_run").agg(
        F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.count_distinct("month").alias("months"), F.array_sort(F.collect_set(F.struct("west", "south"))).alias("tiles")
    )
    text = lambda c: F.date_format(c, "yyyy-MM")
    label = F.when(F.col("months") == 1, text("first_month")).otherwise(F.concat_ws("..", text("first_month"), text("last_month")))
    return made.select(label.alias("label"), "first_month", "last_month", "months", "tiles")


def narrow(slots: DataFrame, *keys: str) -> DataFrame:
    """keys, start, end, tiles: the smallest span of whole months [start, end) and the sorted tile list that hold ``slots`` (month, west, south)."""
    return slots.groupBy(*keys).agg(
        F.min("month").alias("start"), F.add_months(F.max("month"), 1).alias("end"), F.array_sort(F.collect_set(F.struct("west", "south"))).alias("tiles")
    )
